"""Merged records, and decisions on them in one step and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import feeds, merge
from plumbline.streaming import resolutions

SPEC = "array<struct<attribute: string, value: string, unit: string, confidence: double, status: string, source: struct<type: string, reference: string, snippet: string>>>"
RECORD = f"product string, record_ord int, product_id string, product_name string, brand string, description string, category struct<predicted: string, confidence: double>, identifiers struct<sku: string, gtin: string, mpn: string>, images array<string>, price struct<value: double, currency: string>, availability string, sources array<struct<id: string, type: string, reference: string>>, overall_confidence double, extracted_at timestamp, specifications {SPEC}"


def record(product, ord_, specs, name="N", brand="", source="document", **more):
    rows = [(a, v, u, c, "extracted", (source, "src-1", None) if c != 0.5 else None) for a, v, u, c in specs]
    fields = {"description": "", "category": ("", 0.0), "identifiers": (None, None, None), "images": [], "price": None, "availability": None, "confidence": 0.7} | more
    return (product, ord_, None, name, brand, fields["description"], fields["category"], fields["identifiers"], fields["images"], fields["price"], fields["availability"], [("src-1", source, f"{product}-{ord_}")], fields["confidence"], None, rows)


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        record("p", 1, [("length", "2 cm", None, 0.8), ("finish", "zinc", None, 0.9)], name="Second", brand="Acme", source="website", category=("bolt", 0.6), identifiers=("S", None, None), images=["b.png"], price=(5.0, "USD")),
        record("p", 0, [("length", "20", "mm", 0.9), ("weight", "5", "g", 0.705), ("finish", "Zinc ", None, 0.5), ("weight", "6", "g", 0.7)], name="First"),
        record("q", 0, [], confidence=0.42), record("q", 1, [], brand="B", confidence=0.9),
        record(None, 0, [("length", "1", "mm", 0.4)]), record(None, 1, [("length", "2", "mm", 0.4)]),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_merge_of_whole_records(records):
    got = {r["product"]: r for r in merge.merge_records(records).collect()}
    p = got["p"]
    assert (p.product_name, p.brand, p.category.predicted, p.images, p.price, p.provenance.brand, p.n_records) == ("First", "", "", [], None, 0, 2)
    assert [(s.attribute, s.value, s.status, s.source.reference if s.source else None) for s in p.specifications] == [
        ("length", "20", "extracted", "src-1"), ("weight", "5", "needs_review", "src-1"), ("finish", "Zinc ", "extracted", None), ("weight", "6", "needs_review", "src-1"), ("length", "2 cm", "extracted", "src-2"), ("finish", "zinc", "extracted", "src-2"),
    ]
    assert [(s.id, s.type, s.reference) for s in p.sources] == [("src-1", "document", "p-0"), ("src-2", "website", "p-1")]
    assert [(c.attribute, c["values"], c.sources) for c in p.conflicts] == [("weight", ["5", "6"], ["src-1", "src-1"])]
    assert p.overall_confidence == round((0.9 + 0.705 + 0.5 + 0.7 + 0.8 + 0.9) / 6, 2)
    assert (got["q"].overall_confidence, got["q"].specifications, got["q"].conflicts) == (0.42, [], [])
    assert [c["values"] for c in got[None].conflicts] == [["1", "2"]] and [s.id for s in got[None].sources] == ["src-1", "src-2"]
    assert merge.merge_records(records.limit(0)).collect() == []


def test_empty_fields_come_from_the_first_record_that_has_them(records):
    got = {r["product"]: r for r in merge.merge_records(records, fill=True).collect()}
    p = got["p"]
    assert (p.product_name, p.brand, p.category.predicted, p.identifiers.sku, p.images, p.price.value) == ("First", "Acme", "bolt", "S", ["b.png"], 5.0)
    assert (p.provenance.product_name, p.provenance.brand, p.provenance.price, p.provenance.availability) == (0, 1, 1, None) and got["q"].brand == "B"


def test_resolved_records_are_fed_anew(spark, records):
    merged = merge.merge_records(records)
    decisions = spark.createDataFrame([("p", "weight", 1), ("p", "weight", 0), ("p", "length", 1), ("q", "weight", 0), (None, "length", 7), ("z", "weight", 0)], "product string, attribute string, winner int")
    got = {r["product"]: r for r in feeds.map_to_all(merge.resolve_records(merged, decisions)).collect()}
    p = got["p"]
    assert [(s.attribute, s.value, s.confidence, s.status) for s in p.specifications if s.attribute == "weight"] == [("weight", "6", 0.97, "extracted")]
    assert len(p.specifications) == 5 and p.conflicts == [] and len(p.industrial.features) == 5
    assert p.overall_confidence == round((0.9 + 0.5 + 0.97 + 0.8 + 0.9) / 5, 2) and p.google.custom_label_0 == "high"
    assert len(got[None].conflicts) == 1 and got["q"].overall_confidence == 0.42 and "z" not in got


def test_a_stream_of_decisions_equals_the_batch_fold(spark, tmp_path):
    """Three runs on one checkpoint, the second of which breaks off: each product ends as all its decisions at once leave it."""
    rng = random.Random(3)
    rows = [record(f"p{k}", o, [(a, str(rng.randint(1, 3)), "mm", rng.choice([0.5, 0.6, 0.9])) for a in ("length", "width", "depth")]) for k in range(25) for o in range(3)]
    merged = merge.merge_records(spark.createDataFrame(rows, RECORD))
    decisions = [(f"p{rng.randint(0, 24)}", seq, None, rng.choice(["length", "width", "depth"]), rng.choice([0, 1, 2, 5, None])) for seq in range(1, 61)]
    source, found = tmp_path / "in", {}
    add = lambda frame: frame.coalesce(1).write.mode("append").parquet(str(source))
    events = lambda some: spark.createDataFrame(some, resolutions.EVENTS)
    wide = feeds.map_to_all(merged)

    def take(frame, k, breaks=False):
        batch = {r["product"]: r for r in frame.collect()}
        if breaks:
            raise RuntimeError("lost")
        sizes.append(len(batch))
        found.update(batch)

    def run(**more):
        stream = spark.readStream.schema(resolutions.EVENTS).parquet(str(source))
        resolutions.follow(stream, merged.schema, str(tmp_path / "at"), lambda f, k: take(f, k, **more), once=True).awaitTermination(120)

    sizes = []
    add(events(decisions[:10]))  # before their records are known
    add(resolutions.merged_as_events(merged))
    run()
    assert sizes[-1] == 25 or sum(sizes) == 25
    add(events(decisions[30:45]))
    with pytest.raises(Exception, match="lost"):
        run(breaks=True)
    add(events(decisions[10:30] + decisions[45:]))  # late ones among them
    run()
    assert sizes[-1] <= 25
    last = {}
    for product, seq, _, attribute, winner in sorted(decisions, key=lambda d: d[1]):
        last[product, attribute] = winner
    folded = spark.createDataFrame([(p, a, w) for (p, a), w in last.items() if w is not None], "product string, attribute string, winner int")
    want = {r["product"]: r for r in feeds.map_to_all(merge.resolve_records(merged, folded)).collect()}
    assert set(found) == set(want)
    for product, r in want.items():
        for name in ("specifications", "conflicts", "overall_confidence", "schema_org", "google", "industrial", "google_issues", "schema_org_issues", "industrial_issues", "sources"):
            assert found[product][name] == r[name], (product, name)
    assert wide.count() == 25
