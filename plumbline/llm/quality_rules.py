"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes 1 (good), -1 (bad) or 0 (abstains) on text statistics.
Expectation-maximisation over the counts of vote patterns (at most 3 to the number
of rules, whatever the corpus) estimates each rule's accuracy and the share of good
texts, and the posterior probability of being good replaces all-must-pass filtering.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scans import unused
from ._shared import Workspace

SPACE = r"[\x20\x09-\x0D]+"
#: Steps of expectation-maximisation, the accuracies it begins with, and the range it keeps them in.
STEPS, BEGIN, LOWEST, HIGHEST = 20, 0.9, 0.55, 0.99
PRIOR_RANGE = (0.05, 0.95)

#: name -> (bad, good) conditions over the statistics of `text_statistics`; neither: the rule abstains.
#: A rule on one flaw has nothing to say of a text without it; `prose` sees the kinds of flaws again, more
#: strictly, so that each kind has two voters whose agreement tells their accuracies.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 10", "FALSE"),
    "symbols": ("10 * n_symbols > n_words", "FALSE"),
    "capitals": ("10 * n_upper > 4 * n_letters", "FALSE"),
    "shouting": ("10 * n_marks > 2 * n_words", "FALSE"),
    "lines": ("2 * n_dup_lines > n_lines", "FALSE"),
    "repeats": ("10 * n_repeat_words > n_words", "FALSE"),
    "word_size": ("word_chars < 2 * n_words OR word_chars > 15 * n_words", "FALSE"),
    "prose": (
        "n_words < 5 OR 16 * n_symbols > n_words OR 10 * n_upper > 3 * n_letters OR 10 * n_marks > n_words OR 10 * n_letters < 7 * word_chars OR 3 * n_dup_lines > n_lines",
        "n_words >= 10 AND 50 * n_symbols <= n_words AND 10 * n_upper <= 2 * n_letters AND 50 * n_marks <= n_words AND 10 * n_letters >= 8 * word_chars AND n_dup_lines = 0",
    ),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column, width: int = 5) -> Column:
    """How many words are in a window of `width` words that the text has twice or more."""

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(rows: Column) -> Column:
            same = lambda x, k: F.when((k >= 0) & (k < F.size(rows)), rows[k]["h"] == x["h"]).otherwise(False)
            starts = F.array_sort(F.filter(F.transform(rows, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["at"]).otherwise(-1)), lambda at: at >= 0))
            begin = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
            return F.aggregate(starts, begin, lambda s, at: F.struct((s["total"] + at + width - F.greatest(s["end"], at)).alias("total"), (at + width).alias("end")), lambda s: s["total"])

        rows = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(rows, of_sorted))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(words[i + k] for k in range(width))))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(_let(windows, of_hashes))


def text_statistics(text: Column) -> Column:
    """A struct of long counts of the whole text; null counts as empty.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines (equal to an earlier
    one), n_repeat_words (in five-word windows found twice or more), n_upper, n_letters,
    n_marks (exclamation and question marks).
    """

    def of_text(t: Column) -> Column:
        letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))

        def of_words(words: Column) -> Column:
            lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
            fields = {
                "n_words": F.size(words),
                "word_chars": F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)),
                "n_symbols": F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", "")),
                "n_lines": _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
                "n_repeat_words": _repeat_words(words),
                "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
                "n_letters": letters,
                "n_marks": F.length(t) - F.length(F.regexp_replace(t, r"[!?]+", "")),
            }
            return F.struct(*(v.alias(k) for k, v in fields.items()))

        return _let(F.filter(F.split(t, SPACE), lambda w: w != ""), of_words)

    s = _let(F.coalesce(text, F.lit("")), of_text)

    def flat(x: Column) -> Column:
        plain = ["n_words", "word_chars", "n_symbols", "n_repeat_words", "n_upper", "n_letters", "n_marks"]
        return F.struct(*(x[k].cast("long").alias(k) for k in plain), x["n_lines"]["n"].cast("long").alias("n_lines"), x["n_lines"]["dup"].cast("long").alias("n_dup_lines"))

    return _let(s, flat)


def votes(statistics: str) -> Column:
    """The rules' votes as an array of int, from a struct column of statistics."""
    names = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_lines", "n_dup_lines")

    def bind(condition: str) -> Column:
        for n in names:
            condition = condition.replace(n, f"{statistics}.{n}")
        return F.expr(condition)

    return F.array(*(F.when(bind(bad), F.lit(-1)).when(bind(good), F.lit(1)).otherwise(F.lit(0)) for bad, good in RULES.values()))


@dataclass(frozen=True)
class RuleModel:
    """P(good), and each rule's probability of voting rightly when it votes."""

    prior: float
    accuracies: tuple[float, ...]

    def posterior(self, vote: Column) -> Column:
        weights = F.array(*(F.lit(math.log(a / (1 - a))) for a in self.accuracies))
        logit = F.aggregate(F.zip_with(vote, weights, lambda v, w: v * w), F.lit(math.log(self.prior / (1 - self.prior))), lambda s, x: s + x)
        return 1 / (1 + F.exp(-logit))


def fit(voted: DataFrame, column: str = "votes") -> RuleModel:
    """Expectation-maximisation over the vote patterns; one row comes to the driver.  Without rows: the values it begins with."""
    patterns = voted.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"))
    count = len(RULES)

    def step(state: Column, patterns: Column) -> Column:
        """state: accuracies, then the prior; patterns: an array of (v, n)."""

        def weighed(s: Column) -> Column:
            logit = lambda x: F.aggregate(F.zip_with(x["v"], F.slice(s, 1, count), lambda v, a: v * F.log(a / (1 - a))), F.log(s[count] / (1 - s[count])), lambda t, y: t + y)
            return F.transform(patterns, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), (1 / (1 + F.exp(-logit(x)))).alias("p")))

        def updated(rows: Column) -> Column:
            zero = F.array_repeat(F.lit(0.0), count)
            right = F.aggregate(rows, zero, lambda t, x: F.zip_with(t, x["v"], lambda a, v: a + x["n"] * F.when(v == 1, x["p"]).when(v == -1, 1 - x["p"]).otherwise(0.0)))
            cast = F.aggregate(rows, zero, lambda t, x: F.zip_with(t, x["v"], lambda a, v: a + F.when(v == 0, F.lit(0.0)).otherwise(x["n"])))
            good = F.aggregate(rows, F.lit(0.0), lambda t, x: t + x["n"] * x["p"])
            every = F.aggregate(rows, F.lit(0.0), lambda t, x: t + x["n"])
            accuracy = F.zip_with(right, cast, lambda r, c: F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), (r + 1) / (c + 2))))
            return F.concat(accuracy, F.array(F.greatest(F.lit(PRIOR_RANGE[0]), F.least(F.lit(PRIOR_RANGE[1]), (good + 1) / (every + 2)))))

        return _let(weighed(state), updated)

    begin = F.array(*[F.lit(BEGIN)] * (count + 1))
    model = gathered.select(_let(F.col("p"), lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, lambda s, _: step(s, p))).alias("m")).first()["m"]
    return RuleModel(model[count], tuple(model[:count]))


def score_quality(docs: DataFrame, into: str = "quality_rules", threshold: float = 0.5, keep: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """docs (or its columns named in keep) with a struct column `into`, which replaces one of that name.

    Its fields: the statistics, votes, base_failed (fewer than ten words, or more than a fifth
    of them in repeated five-word windows), posterior and kept (not base_failed, and
    posterior >= threshold).  A null or wordless text is base_failed.  Copies are judged
    alike, a null text as an empty one; an empty table gives no rows.  Columns may have any
    names.  The statistics are written once to the shared folder, with the columns kept, and
    read for both fitting and scoring.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != into]
    work = Workspace(docs.sparkSession, "quality-rules")
    held = unused(names, "held")
    counted = docs.select(*(docs[f"`{c}`"] for c in names), text_statistics(docs[text_column]).alias(held))
    voted = work.write(counted.withColumn(held, F.struct(F.col(held).alias("s"), votes(f"`{held}`").alias("v"))), "votes")
    model = fit(voted, f"{held}.v")
    s = F.col(f"{held}.s")
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    posterior = model.posterior(F.col(f"{held}.v"))
    kept = ~failed & (posterior >= threshold)
    found = F.struct(f"{held}.s.*", F.col(f"{held}.v").alias("votes"), failed.alias("base_failed"), posterior.alias("posterior"), kept.alias("kept"))
    return voted.select(*(voted[f"`{c}`"] for c in names), found.alias(into))
