"""Scalar functions against small plain-Python expectations."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import specs, text, units


def value(spark, column, **cells):
    return spark.range(1).select(*(F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in cells.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "v,u,number,unit",
    [("12", "V", 12.0, "V"), ("12V", None, 12.0, "V"), ("12 mV", "kV", 12.0, "mV"), ("1_000", "A", 1000.0, "A"), ("-4.5e1", None, -45.0, None), ("12f", None, 12.0, "f"), ("x12", "V", None, None), ("", "V", None, None)],
)
def test_parse_numeric(spark, v, u, number, unit):
    got = value(spark, units.parse_numeric(F.col("v"), F.col("u")), v=v, u=u)
    assert (None if got is None else (got["number"], got["unit"])) == (None if number is None else (number, unit))


@pytest.mark.parametrize("n,u,expected", [(1.0, "kV", (1000.0, "v")), (500.0, "mA", (0.5, "a")), (2.0, " IN ", (50.8, "mm")), (3.0, "parsec", None)])
def test_to_base(spark, n, u, expected):
    got = value(spark, units.to_base(F.col("n"), F.col("u")), n=n, u=u)
    assert (got and (pytest.approx(got["number"]), got["unit"])) == (expected and (expected[0], expected[1]))


@pytest.mark.parametrize("a,b,same", [(("12 V", None), ("12000", "mV"), True), (("12", "V"), ("12", "kV"), False), (("24 V", None), ("12000 mV", None), False), (("Steel", None), (" steel ", None), True), (("12", None), ("12", "V"), False)])
def test_comparable(spark, a, b, same):
    one, two = (value(spark, units.comparable(F.col("v"), F.col("u")), v=x[0], u=x[1]) for x in (a, b))
    assert (one == two) is same


@pytest.mark.parametrize("name,expected", [("Rated Voltage", "voltage_rating"), ("rated_voltage", "voltage_rating"), (" IP ", "ip_rating"), ("Operating_Temperature", "operating_temp"), ("colour", None), ("", None)])
def test_resolve_attribute(spark, name, expected):
    assert value(spark, specs.resolve_attribute(F.col("n")), n=name) == expected


@pytest.mark.parametrize(
    "a,v,u,outcome",
    [
        ("voltage_rating", "12V", None, "pass"), ("voltage_rating", "2", "kV", "fail"), ("current_rating", "50 mA", None, "fail"), ("current_rating", "500", "mA", "pass"), ("length", "0", "mm", "fail"),
        ("voltage_rating", "12 mm", None, "pass"), ("voltage_rating", "12 lightyears", None, "unverifiable"), ("voltage_rating", "high", None, "unverifiable"), ("thread_size", "M18×1", None, "pass"), ("thread_size", "M18 junk", None, "fail"),
        ("thread_size", "1/4in", None, "pass"), ("ip_rating", "IP67", None, "pass"), ("ip_rating", "ip67", None, "fail"), ("material", " Stainless Steel ", None, "pass"), ("material", "wood", None, "fail"), ("colour", "red", None, "unverifiable"),
    ],
)
def test_check(spark, a, v, u, outcome):
    assert value(spark, specs.check_spec(F.col("a"), F.col("v"), F.col("u"))["outcome"], a=a, v=v, u=u) == outcome


@pytest.mark.parametrize("v,t,expected", [("yes", "nothing", True), ("12 V", "rated 12V max", True), ("stainless steel", "plain brass", False), ("the of", "x", True), ("12", "13", False)])
def test_grounded(spark, v, t, expected):
    assert value(spark, specs.grounded(F.col("v"), F.col("t")), v=v, t=t) is expected


@pytest.mark.parametrize("status,source,outcome,expected", [("extracted", "document", "pass", 0.95), ("needs_review", "website", "pass", 0.355), ("needs_review", "document", "fail", 0.0), ("other", None, "unverifiable", 0.45)])
def test_score(spark, status, source, outcome, expected):
    assert math.isclose(value(spark, specs.score_spec(F.col("s"), F.col("t"), F.col("o")), s=status, t=source, o=outcome), expected, abs_tol=1e-9)


@pytest.mark.parametrize("raw,expected", [("in_stock", "in_stock"), ("Ships in 3 days", "in_stock"), ("PRE-ORDER", "preorder"), ("not available", "in_stock"), ("out-of-stock", None), ("", None), (None, None)])
def test_availability(spark, raw, expected):
    assert value(spark, specs.match_availability(F.col("r")), r=raw) == expected


@pytest.mark.parametrize("raw,expected", [("$1,234.50", 1234.5), ("12", 12.0), ("call", None), ("12f", None), (None, None)])
def test_price(spark, raw, expected):
    assert value(spark, specs.parse_price(F.col("r")), r=raw) == expected


@pytest.mark.parametrize("t,section,needle,expected", [
    ("short", "S", "x", "[S] short"),
    ("  two\n lines\t", None, "lines", "two lines"),
    ("", None, None, ""),
    ("word " * 100, None, None, "word " * 39 + "word…"),
    ("word " * 100, "Top", "absent", "[Top] " + "word " * 38 + "wor…"),
    ("needle " + "x" * 400, None, "needle", "needle " + "x" * 193),
    ("a b " * 60 + "needle" + " c d" * 80, "Sec", "NEEDLE", "… " + "a b " * 16 + "needle" + " c d" * 32),
])
def test_snippet(spark, t, section, needle, expected):
    got = value(spark, text.snippet(F.col("t"), F.col("s"), F.col("n")), t=t, s=section, n=needle)
    assert got == expected and len(got) <= 200


def test_small_text_functions(spark):
    assert value(spark, text.normalize_whitespace(F.col("t")), t=" a \t b\n\n\n\nc\n") == "a b\n\nc"
    assert value(spark, text.strip_code_fences(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert value(spark, text.custom_name(F.col("t")), t="Warehouse  Bin#") == "warehouse_bin"
    assert value(spark, text.block_id(F.lit(7)), t="") == "b0007"
    assert value(spark, specs.confidence_bucket(F.lit(0.8)), t="") == "high"
    got = value(spark, text.split_on_match(F.col("t"), F.col("n")), t="Rated 12V max", n="12v")
    assert tuple(got) == ("Rated ", "12V", " max")
    table = F.array(F.array(F.lit(" a "), F.lit(None).cast("string")), F.array(F.lit("b"), F.lit("c")))
    assert value(spark, text.table_to_text(table), t="") == "a | \nb | c"


def test_round2(spark):
    """As Python's round(), ties by their binary value included."""
    from plumbline.functions.units import round2

    values = [k / 200 for k in range(201)] + [k / 1000 for k in range(1001)] + [0.795, 0.7949999, 0.8225, 1 / 3, sum([0.85, 0.72]) / 2, 0.1 + 0.2, 0.285, 0.575]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(round2(F.col("v"))).collect()]
    assert got == [round(v, 2) for v in values]
