"""Spelling variants: a symmetric-delete join of a vocabulary, and the roots of its forms.

Every word emits itself and its distinct single deletions, each as a 128-bit digest
with the places that give that deletion: deleting any letter of a run of equal ones
gives one string, so the places are that run.  Words that share a digest meet.  They
are at distance one exactly if one of them is the shared string itself, or if their
runs overlap: then one place, deleted from both, leaves the same string, so that the
words differ there and nowhere else.  No other digest lets the same two words pass, so
a pair is met once.  Entries have the word's number and not its letters: a long word
costs as many short entries as it has runs.

A digest's entries are bounded by the alphabet: a string of L letters is a deletion of
at most (L + 1) * alphabet words, however often they occur.

All joins ask to be merge joins.  A vocabulary's file is small for its number of words
and entries are worked out from it, so by its size Spark would broadcast either, and
build it in the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import Workspace

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(doc_id, run) for every run of letters of every whole text, A-Z lower-cased; a null text has none."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(letters), F.lit(0))).alias("run"))


def entries(numbered: DataFrame) -> DataFrame:
    """(digest, first, last, id, n) of each word and of its distinct deletions; first and last are places from 1.

    The word itself has a run from 0 to beyond any place, which overlaps every run.
    """
    letters = numbered.withColumn("letters", F.split("word", ""))
    begun = letters.withColumn("begins", F.expr("filter(sequence(1, length(word)), i -> i = 1 OR letters[i - 1] <> letters[i - 2])"))
    deleted = "transform(begins, (x, i) -> struct(unhex(md5(concat(left(word, x - 1), substring(word, x + 1)))) AS digest, x AS first, coalesce(get(begins, i + 1), length(word) + 1) - 1 AS last))"
    itself = f"array(struct(unhex(md5(word)) AS digest, 0 AS first, {2**31 - 1} AS last))"
    return begun.select(F.explode(F.expr(f"concat({itself}, {deleted})")).alias("e"), "id", "n").select("e.digest", "e.first", "e.last", "id", "n")


def near_counts(numbered: DataFrame) -> DataFrame:
    """(id, n_near, best) of every word of numbered (id, word, n) that has a near one; best is (n, -id) of the commonest."""
    e = entries(numbered)
    a, b = e.alias("a"), e.alias("b")
    met = a.join(b.hint("merge"), F.expr("a.digest = b.digest AND a.id < b.id AND a.first <= b.last AND b.first <= a.last"))
    sides = F.expr("explode(array(struct(a.id AS id, struct(b.n AS n, -b.id AS rank) AS other), struct(b.id AS id, struct(a.n AS n, -a.id AS rank) AS other)))")
    return met.select(sides.alias("p")).groupBy("p.id").agg(F.count(F.lit(1)).alias("n_near"), F.max("p.other").alias("best"))


def ends(links: DataFrame, work: Workspace) -> DataFrame:
    """(id, to) with the last node that following (id, to) leads to; links have no cycles and one row an id.

    Each round every node takes over where its goal leads, so a chain of k links takes about log2(k) rounds.
    """
    now, k = work.write(links, "links-0"), 0
    while True:
        a, b = now.alias("a"), now.alias("b")
        further = a.join(b.hint("merge"), F.col("a.to") == F.col("b.id"), "left").select("a.id", F.coalesce("b.to", "a.to").alias("to"), F.col("b.to").isNotNull().alias("moved"))
        written = work.write(further, f"links-{k + 1}")
        work.drop(f"links-{k}")
        if written.filter("moved").isEmpty():
            return written.select("id", "to")
        now, k = written.select("id", "to"), k + 1


def spelling_variants(words: DataFrame, least_length: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word of words (word), an occurrence a row.

    Words are kept with at least `least_length` code points and `least_count` occurrences (n). Two are near if exactly one
    code point is inserted, deleted or replaced. The form is the near word with the largest n (ties: the first in
    code-point order), if its n is at least `times` (above 1) as large; the root is where forms lead to in the end.
    A null or empty word is none; no words give no rows; other columns are not read. A word of any length is compared
    whole, and a word that is a third of all rows is counted before it is shuffled.
    """
    if times <= 1:
        raise ValueError("times must be above 1, or forms could lead in circles")
    work = Workspace(words.sparkSession, "spelling")
    counted = words.filter(F.length("word") >= max(1, least_length)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)
    # sorted by word, numbers are in code-point order
    numbered = work.write(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    near = numbered.join(near_counts(numbered).hint("merge"), "id", "left")
    goal = F.when(F.col("best.n") >= times * F.col("n"), -F.col("best.rank"))
    judged = work.write(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), goal.alias("to"), F.when(goal.isNotNull(), F.col("best.n")).alias("form_n")), "judged")
    roots = ends(judged.filter("to IS NOT NULL").select("id", "to"), work).withColumnRenamed("to", "end")
    form, root = numbered.select(F.col("id").alias("to"), F.col("word").alias("form")), numbered.select(F.col("id").alias("end"), F.col("word").alias("root"))
    named = judged.join(form.hint("merge"), "to", "left").join(roots.hint("merge"), "id", "left").join(root.hint("merge"), "end", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
