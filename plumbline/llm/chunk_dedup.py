"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so: behind a blank between letters of two
classes, rare enough that cuts fall into step again behind a change, after `LEAST` code
points and at `MOST` at the latest.  Equal texts have equal cuts.  Each chunk is named by its 128-bit digest.  The names are verified:
all distinct chunks meet once, each text of a chunk moving once for each map task that
has it, and a name that two different chunks share gets a number for each of them.  A
document's recipe is the ordered list of its chunks' verified names; only recipes, of
16 bytes for some hundreds of code points, move from there on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import Workspace

LEAST, MOST = 384, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text in pieces; joined they are the text. Without a place to cut, a piece has `most` code points or is the rest."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?<=[ny][ \t\n])(?=[a-d])|.{{1,{most}}}"), F.lit(0))


def digest(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk))


def exact_duplicates(docs: DataFrame, name: Callable[[Column], Column] = digest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text).

    Texts are equal when they are identical after A-Z is lower-cased. keep_id is the largest doc_id of the equal texts
    and that row is kept; group_size counts rows.  A null text is an empty one, and all empty texts are equal.  A null
    doc_id is less than any other; keep_id is null if a group has no other.  Of rows repeated with one doc_id and equal
    texts one is kept.  An empty table gives no rows.  Other columns are not read, whatever their names are.
    A text of any length is read whole; its chunks are the only parts of it that are shuffled, and a group of any size
    is only counted and its members joined to one row, which Spark can split.

    name: what names a chunk before verification, any function of its text.
    """
    work = Workspace(docs.sparkSession, "chunk-dedup")
    texts = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("text"))
    named = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    # every distinct chunk meets every other of its name
    found = texts.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(name(F.col("chunk")).alias("name"), "chunk").distinct()
    shared = work.write(found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name"), "shared-names")
    recipes = named.select("doc_id", "text_sha256", F.transform("chunks", name).alias("names"))
    if shared.isEmpty():
        recipes = recipes.withColumn("numbers", F.lit(None).cast("array<struct<pos: int, number: int>>"))
    else:
        placed = named.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn("name", name(F.col("chunk")))
        placed = placed.join(shared, "name", "left_semi").distinct()
        number = placed.select("name", "chunk").distinct().withColumn("number", F.row_number().over(Window.partitionBy("name").orderBy("chunk")))
        numbers = placed.join(number, ["name", "chunk"]).groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "number"))).alias("numbers"))
        recipes = recipes.join(numbers, "text_sha256", "left")
    recipes = recipes.withColumn("numbers", F.coalesce("numbers", F.array().cast("array<struct<pos: int, number: int>>")))
    rows = recipes.groupBy("names", "numbers", "text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    groups = rows.groupBy("names", "numbers").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    joined = rows.join(groups, ["names", "numbers"])
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copies.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
