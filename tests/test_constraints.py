"""Constraints on answers, and documents from blocks to records that feeds take."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import constraints, extract, feeds, flow
from plumbline.operators.constraints import Constraint

SPEC = {"attribute": "length", "value": "5"}


@pytest.fixture(scope="module")
def told(spark):
    def run(answers, table=constraints.RECORD):
        rows = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string")
        frame = rows.select("k", constraints.told(constraints.faults(F.try_parse_json("a"), table)).alias("f"))
        assert not any(x in frame._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
        return [r.f for r in frame.orderBy("k").collect()]

    return run


CASES = [
    ({"product_name": "N"}, None),
    ({"product_name": "N", "brand": None, "identifiers": {"gtin": None}, "commercial": {"price": None}, "specifications": [], "extra": [1]}, None),
    ({"product_name": "", "specifications": [SPEC | {"confidence": 0, "status": "inferred", "source": {"type": "website", "reference": "b1", "snippet": None}}]}, None),
    ({}, "product_name is missing"),
    ({"product_name": None}, "product_name is null"),
    ({"product_name": 5}, "product_name is not text"),
    ({"product_name": "N", "category": None}, "category is null"),
    ({"product_name": "N", "category": [1], "identifiers": "x"}, "category is not an object; identifiers is not an object"),
    ({"product_name": "N", "category": {"predicted": None, "confidence": 1.01}}, "category.predicted is null; category.confidence is above 1"),
    ({"product_name": "N", "category": {"confidence": True}}, "category.confidence is not a number"),
    ({"product_name": "N", "media": {"images": {"a": 1}}}, "media.images is not a list"),
    ({"product_name": "N", "media": {"images": ["a", 1, None]}}, "media.images[1] is not text; media.images[2] is null"),
    ({"product_name": "N", "commercial": {"price": {"value": "9", "currency": 1}}}, "commercial.price.value is not a number; commercial.price.currency is not text"),
    ({"product_name": "N", "specifications": None}, "specifications is null"),
    ({"product_name": "N", "specifications": [SPEC, 7, None]}, "specifications[1] is not an object; specifications[2] is null"),
    ({"product_name": "N", "specifications": [SPEC, {"value": 3}]}, "specifications[1].attribute is missing; specifications[1].value is not text"),
    ({"product_name": "N", "specifications": [SPEC | {"confidence": -0.5, "status": "guess"}]}, "specifications[0].confidence is below 0; specifications[0].status is none of extracted, inferred, needs_review"),
    ({"product_name": "N", "specifications": [SPEC | {"confidence": None, "status": None}]}, "specifications[0].confidence is null; specifications[0].status is null"),
    ({"product_name": "N", "specifications": [SPEC | {"source": {"type": "pdf"}}]}, "specifications[0].source.type is none of document, website; specifications[0].source.reference is missing"),
    ({"product_name": "N", "provenance": {"sources_used": [{"id": "s", "type": "document", "reference": "r", "page": 1.5}]}}, "provenance.sources_used[0].page is not a whole number"),
    ({"product_name": "N", "validation": {"overall_confidence": 2, "conflicts": [{"attribute": "a", "values": ["x", None]}]}}, "validation.overall_confidence is above 1; validation.conflicts[0].values[1] is null"),
    ([1], "is not an object"),
    ("text", "is not an object"),
]


def test_record_constraints(told):
    assert told([json.dumps(c) for c, _ in CASES]) == [want for _, want in CASES]
    assert told(["", "{", None, "null"]) == ["is not JSON"] * 3 + ["is not an object"]
    long = {"product_name": "n" * 100_000, "specifications": [SPEC] * 500 + [{}]}
    assert told([json.dumps(long)]) == ["specifications[500].attribute is missing; specifications[500].value is missing"]


def test_constraints_of_other_tables(told):
    table = [Constraint("a b", constraints.STRING, filled=True), Constraint("m[]", constraints.ARRAY), Constraint("m[][]", constraints.INTEGER, low=1, high=3), Constraint("x.y", constraints.BOOLEAN, required=True)]
    answers = [{"a b": "", "m": [[1, 2], [0, 4], 5], "x": {}}, {"m": [[]], "x": None}, {"x": {"y": False}}]
    assert told([json.dumps(a) for a in answers], table) == ["a b is empty; m[2] is not a list; m[1][0] is below 1; m[1][1] is above 3; x.y is missing", None, None]
    assert told(["{}"], []) == [None]


def test_answers_are_asked_for_once_more(spark):
    asked = spark.sparkContext.accumulator(0)

    def make():
        class Client:
            def complete(self, prompt):
                asked.add(1)
                if "gone" in prompt:
                    raise extract.ClientError("no quota", 429)
                better = "specifications[0].value is not text" in prompt
                return json.dumps({"product_name": "N", "specifications": [{"attribute": "Rated Voltage", "value": "12" if better and "stubborn" not in prompt else 12, "source": {"type": "document", "reference": "b0001"}}], "identifiers": {"sku": "S"}})

        return Client()

    prompts = spark.createDataFrame([(1, "x"), (2, "stubborn"), (3, "gone"), (4, None)], "doc_id long, prompt string")
    got = {r.doc_id: r for r in extract.extract_records(prompts, make).collect()}
    assert {k: (r.attempts, r.error) for k, r in got.items()} == {1: (2, None), 2: (2, "invalid record: specifications[0].value is not text"), 3: (1, "no quota"), 4: (2, None)}
    assert got[1].specifications[0].asDict() == {"attribute": "voltage_rating", "value": "12", "unit": None, "status": "extracted", "reference": "b0001"}
    assert got[1].identifiers.sku == "S" and got[1].category.predicted == "" and got[1].images == [] and got[1].price is None and got[2].product_name is None and got[2].specifications is None
    assert asked.value == 7  # no answer is asked for twice


def test_documents_to_feeds(spark):
    def make():
        class Client:
            def complete(self, prompt):
                if "Broken" in prompt:
                    return "no"
                specs = [{"attribute": "length", "value": "20", "unit": "mm", "source": {"type": "document", "reference": "b0001"}}, {"attribute": "material", "value": "steel", "source": {"type": "document", "reference": "b9999"}}]
                return json.dumps({"product_name": "Bolt", "brand": "Acme", "specifications": specs if "Length" in prompt else []})

        return Client()

    rows = [(1, "b0000", 0, "text", "Bolt", None, None, 1), (1, "b0001", 1, "text", "Length: 20 mm", None, "Sizes", 2), (2, "b0000", 0, "text", "Broken", None, None, 1), (3, "b0000", 0, "text", "Bare", None, None, 1), (4, "b0000", 0, "text", "Length of a stray", None, None, 1)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_id string, pos int, type string, text string, table array<array<string>>, section string, page int")
    files = spark.createDataFrame([(1, "document", "1.pdf"), (2, "document", "2.pdf"), (3, "website", "http://3"), (9, "document", "none.pdf")], "doc_id long, type string, reference string")
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    records, failures = flow.extract_documents(blocks, files, make, "Names: {canonical_names}", "{}", at)
    assert [tuple(r) for r in failures.collect()] == [(2, 2, "invalid record: is not JSON")]
    got = {r.doc_id: r for r in records.collect()}
    assert sorted(got) == [1, 3, 4] and {r.extracted_at for r in got.values()} == {datetime.datetime(2024, 5, 6, 7, 8, 9)}
    one = got[1]
    assert [(s.status, s.reference) for s in one.specifications] == [("extracted", "src-2"), ("needs_review", "b9999")] and one.specifications[1].confidence <= 0.3
    assert [(s.id, s.reference, s.page) for s in one.sources] == [("src-2", "1.pdf", 2)] and one.specifications[0].snippet == "[Sizes] Length: 20 mm"
    assert got[3].sources[0].type == "website" and got[3].overall_confidence == 0.0 and got[3].specifications == []
    assert [s.id for s in got[4].sources] == [] and got[4].overall_confidence > 0  # its document is not among the files
    fed = {r.doc_id: r for r in feeds.map_to_all(records).collect()}
    assert fed[1].schema_org.name == "Bolt" and fed[1].schema_org.dateModified == "2024-05-06T07:08:09+00:00" and len(fed[1].industrial.features) == 2 and fed[3].google.link == "http://3"
    assert flow.extract_documents(blocks.limit(0), files, make, "{canonical_names}", "{}")[0].collect() == []


def test_chain_of_the_sessions_providers(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Provider(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body["model"], self.headers.get("Authorization")))
            if self.path == "/busy":
                self.send_error(503)
                return
            text = json.dumps({"choices": [{"message": {"content": f"{self.path} {body['messages'][0]['content']}"}}]} if self.path == "/good" else {"odd": 1}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Provider)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    values = {"providers": "first, none, odd,second", "first.url": f"{at}/busy", "first.model": "m1", "first.attempts": "2", "odd.url": f"{at}/odd", "second.url": f"{at}/good", "second.model": "m2", "second.key": "k"}
    with pytest.raises(ValueError):
        extract.default_chain(spark)
    for name, value in values.items():
        spark.conf.set(f"plumbline.{name}", value)
    try:
        client = extract.default_chain(spark)()
        client.clients[0].pause = 0
        assert client.complete("hello") == "/good hello"
        assert asked == [("/busy", "m1", None)] * 2 + [("/odd", "", None), ("/good", "m2", "Bearer k")]
        spark.conf.set("plumbline.providers", "first,odd")
        client = extract.default_chain(spark)()
        client.clients[0].pause = 0
        with pytest.raises(extract.ClientError, match="Retrying: status 503; ChatClient: unexpected answer"):
            client.complete("x")
    finally:
        server.shutdown()
        for name in values:
            spark.conf.unset(f"plumbline.{name}")
    with pytest.raises(extract.ClientError):
        extract.ChatClient(f"{at}/good", "m", seconds=2).complete("x") if server.server_close() is None else None
