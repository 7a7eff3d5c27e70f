"""Running values in two levels against plain windows, and on one huge key."""

import random

from pyspark.sql import Window, functions as F

from plumbline.operators import blocks, catalog, scans


def items(spark):
    rng = random.Random(6)
    rows = [(d, p, rng.choice(["heading", "text"]) if p % 5 else "text", f"{d} {p}" if rng.random() < 0.9 else None, rng.randint(0, 9)) for d in (1, 2, None) for p in rng.sample(range(200), 60)]
    return spark.createDataFrame(rows + [(3, 7, "text", "x", 1)], "doc_id int, pos int, type string, text string, piece int")


def test_running_against_windows(spark):
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("type") == "heading", F.col("text"))
    rows = items(spark)
    want = rows.withColumns({"n": F.row_number().over(upto).cast("long"), "total": F.coalesce(F.sum(F.length("text")).over(upto), F.lit(0)), "head": F.last(head, ignorenulls=True).over(upto)})
    for piece in (1, 7, 64, scans.PIECE):
        got = scans.running(rows, ["doc_id"], "pos", sums={"n": F.lit(1), "total": F.length("text")}, lasts={"head": head}, piece=piece)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert scans.running(rows.limit(0), ["doc_id"], "pos", sums={"n": F.lit(1)}).collect() == []
    replaced = scans.running(rows, ["doc_id"], "pos", sums={"piece": F.lit(1)}, piece=9)
    assert replaced.count() == rows.count() and replaced.agg(F.max("piece")).first()[0] == 60


def test_one_huge_document_is_many_tasks(spark):
    """No task gets more than a piece of a document of 600,000 blocks, and the rows are the windows' rows."""
    n = 600_000
    doc = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.when(F.col("id") % 1000 == 5, "heading").otherwise("text").alias("type"), F.concat(F.lit("t"), "id").alias("text"))
    numbered = blocks.with_block_ids(blocks.running_section(doc))
    right = (F.col("section") == F.concat(F.lit("t"), (F.floor((F.col("pos") - 5) / 1000) * 1000 + 5).cast("string"))) | ((F.col("pos") < 5) & F.col("section").isNull())
    wrong = numbered.filter(~right | (F.regexp_extract("block_id", r"b0*(\d+)", 1) != F.col("pos").cast("string")))
    assert wrong.count() == 0 and numbered.count() == n
    most = scans.running(doc, ["doc_id"], "pos", sums={"k": F.lit(1)}, piece=4096).groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most < n / 2


def test_one_huge_sheet(spark):
    rows = spark.range(100_000).select(F.lit("f.csv").alias("path"), F.col("id").alias("row_index"), F.when(F.col("id") % 4 == 3, F.array(F.lit(""), F.lit(None).cast("string"))).otherwise(F.array(F.lit("x"), F.col("id").cast("string"))).alias("cells"))
    got = catalog.number_rows(rows, ["path"])
    assert got.filter(F.col("row_number") != F.col("row_index") - F.floor(F.col("row_index") / 4) + 1).count() == 0 and got.count() == 75_000


def test_similar_headers_against_difflib(spark):
    """Every header that is like a choice is found, with the same ratio, and few choices are compared."""
    from difflib import SequenceMatcher

    rng = random.Random(9)
    choices = [key for key, _, _ in catalog.FUZZY_CHOICES]
    near = ["".join(c for c in key if rng.random() > 0.06) + rng.choice(["", "", "s", " x"]) for key in choices * 6]
    swapped = [key[:3] + key[4:5] + key[3:4] + key[5:] for key in choices] + ["", " ", "!!!", "x" * 50_000, "length " * 3, "ﬁnish"]
    headers = sorted({*near, *swapped})
    normal = lambda h: "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in h.lower())
    got = {r.header: (r.target, r.method, round(r.confidence, 9)) for r in catalog.map_columns(spark.createDataFrame([(h,) for h in [*headers, None]], "header string")).collect()}
    assert set(got) == set(headers)
    for h in headers:
        if got[h][1] == "alias":
            continue
        n = " ".join(normal(h).split())
        ratios = [SequenceMatcher(None, n, key).ratio() for key in choices] if len(n) < 100 else [0.0]
        if max(ratios) >= catalog.FUZZY_LEAST:
            assert got[h] == (catalog.FUZZY_CHOICES[ratios.index(max(ratios))][1], "fuzzy", round(max(ratios), 9)), h
        else:
            assert got[h][1:] == ("custom_attribute", 0.0), h
    pairs = catalog.similar_candidates(spark.createDataFrame([(" ".join(normal(h).split()),) for h in headers], "normal string")).count()
    assert pairs < 0.05 * len(headers) * len(choices)
