"""Operators on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators import blocks, catalog, citations, extract, feeds, flow, links, merge
from plumbline.sources import formats


def test_catalogue_end_to_end(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Spring list\n\nItem;Mfr;Item Code;Rated Volts;Unit Cost;Odd Thing\nBolt;Acme;S1;12V;$1,000.50;x\n;;;;;\n;Acme;S2;;2;\n;;;9V;;\n".encode())
    (tmp_path / "b.csv").write_bytes("Product Name,Brand\nCafé,Ünder\n".encode("cp1252"))
    (tmp_path / "c.txt").write_text("nothing")
    rows = formats.read_catalogs(spark, str(tmp_path))
    assert [r["error"] is not None for r in rows.filter("path like '%c.txt'").collect()] == [True]
    good = rows.filter("error is null")
    heads = catalog.detect_header(good, ["path"])
    assert {r["path"][-5:]: r["header_row"] for r in heads.collect()} == {"a.csv": 3, "b.csv": 1}
    cells = catalog.to_cells(good, heads, ["path"])
    mapped = catalog.map_rows(cells, catalog.map_columns(cells), ["path"]).orderBy("path", "row_number").collect()
    assert [(r["product_name"], r["sku"], r["price_value"], r["rejected"]) for r in mapped] == [("Bolt", "S1", 1000.5, False), ("S2", "S2", 2.0, False), (None, None, None, True), ("Café", None, None, False)]
    assert [(s["attribute"], s["value"], s["status"], s["source"]["snippet"]) for s in mapped[0]["specifications"]] == [("voltage_rating", "12V", "extracted", "row 1, column 'Rated Volts'"), ("odd_thing", "x", "needs_review", "row 1, column 'Odd Thing'")]
    counts = catalog.summarize(catalog.map_rows(cells, catalog.map_columns(cells), ["path"]), ["path"]).orderBy("path").collect()
    assert [(r["total_rows"], r["accepted_rows"], r["rejected_rows"]) for r in counts] == [(3, 2, 1), (1, 1, 0)]


def workbook() -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'
    sheet = lambda rows: f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(cell(f"{'ABC'[j]}{i + 1}", v) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows)) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Notes" r:id="r1"/><sheet name="Products" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", sheet([["read", "me"]]))
        z.writestr("xl/worksheets/s2.xml", sheet([["list"], ["Product Name", "Brand", "Current Rating"], ["Relay", None, 2.5]]))
    return out.getvalue()


def test_workbook():
    rows = formats.parse_xlsx(workbook())
    assert rows == [("Products", 0, ["list"]), ("Products", 1, ["Product Name", "Brand", "Current Rating"]), ("Products", 2, ["Relay", None, "2.5"])]


def test_word_document():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Top", "Heading1") + p("one  two") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('')}</w:tc></w:tr></w:tbl>" + p("Next", "T1") + p("three")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="T1"><w:name w:val="Title"/></w:style></w:styles>')
    assert formats.parse_docx(out.getvalue()) == [("heading", "Top", None, None, "Top"), ("text", "one two", None, None, "Top"), ("table", None, [["a", None]], None, "Top"), ("heading", "Next", None, None, "Next"), ("text", "three", None, None, "Next")]


def test_web_page():
    html = '<html><body><script type="application/ld+json">[{"@type": "Product", "name": "N", "offers": {"price": 3}, "tags": ["a", "b"]}, {"@type": "Org"}]</script><nav><p>skip</p></nav><h1>T</h1><div>lost<p>a <b>b<p>c</div><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></body></html>'
    assert [(b[0], b[1] or b[2], b[4]) for b in formats.parse_html(html)] == [("text", "name: N\noffers.price: 3\ntags: a\ntags: b", "JSON-LD Product"), ("heading", "T", "T"), ("text", "a b", "T"), ("text", "c", "T"), ("text", "one", "T"), ("text", "two", "T"), ("table", [["1", "2"]], "T")]
    assert formats.parse_html("") == []


def spec_rows(spark, rows):
    return spark.createDataFrame(rows, "product string, record_ord int, pos int, attribute string, value string, unit string, confidence double, status string, reference string")


def test_merge(spark):
    specs = spec_rows(spark, [("p", 1, 0, "voltage_rating", "12 V", None, 0.9, "extracted", "src-1"), ("p", 2, 0, "voltage_rating", "12000", "mV", 0.7, "extracted", "src-1"), ("p", 1, 1, "tensile_strength", "400", "MPa", 0.95, "extracted", "src-1"), ("p", 2, 1, "tensile_strength", "600", "MPa", 0.95, "extracted", None)])
    sources = spark.createDataFrame([("p", 1, 0, "src-1"), ("p", 2, 0, "src-1")], "product string, record_ord int, pos int, id string")
    pooled = merge.pool_specs(specs, merge.renumber_sources(sources))
    assert sorted((r["record_ord"], r["pos"], r["reference"]) for r in pooled.collect()) == [(1, 0, "src-1"), (1, 1, "src-1"), (2, 0, "src-2"), (2, 1, None)]
    found = merge.conflicts(pooled)
    assert [(r["attribute"], r["values"], r["sources"]) for r in found.collect()] == [("tensile_strength", ["400", "600"], ["src-1"])]
    flagged = merge.flag_conflicts(pooled, found)
    assert sorted((r["attribute"], r["status"]) for r in flagged.filter("record_ord = 1").collect()) == [("tensile_strength", "needs_review"), ("voltage_rating", "extracted")]
    left = merge.resolve(flagged.drop("conflicting"), spark.createDataFrame([("p", "tensile_strength", 1)], "product string, attribute string, winner int"))
    assert [(r["value"], r["confidence"], r["status"]) for r in left.filter("attribute = 'tensile_strength'").collect()] == [("600", 0.97, "extracted")]


def test_citations_and_their_idempotence(spark):
    block = spark.createDataFrame([("d", "b0000", 0, "12 V relay", None, "Specs", 2), ("d", "b0001", 1, "steel", None, None, None)], "doc_id string, block_id string, pos int, text string, table array<array<string>>, section string, page int")
    specs = spark.createDataFrame([("d", 0, "voltage", "12 V", "extracted", 0.9, "b0000"), ("d", 1, "material", "steel", "extracted", 0.9, "b0001"), ("d", 2, "x", "y", "extracted", 0.9, "b9999"), ("d", 3, "z", "y", "extracted", 0.2, None), ("d", 4, "w", "12", "extracted", 0.9, "b0000")], "doc_id string, pos int, attribute string, value string, status string, confidence double, reference string")
    sources = spark.createDataFrame([("d", 0, "src-1", "document", "f.pdf", None)], "doc_id string, pos int, id string, type string, reference string, page int")
    out, used = citations.resolve_citations(specs, block, sources)
    assert [(r["reference"], r["status"], r["confidence"], r["snippet"]) for r in out.orderBy("pos").collect()] == [("src-2", "extracted", 0.9, "[Specs] 12 V relay"), ("src-3", "extracted", 0.9, "steel"), ("b9999", "needs_review", 0.3, None), (None, "extracted", 0.2, None), ("src-2", "extracted", 0.9, "[Specs] 12 V relay")]
    assert [(r["id"], r["page"]) for r in used.orderBy("id").collect()] == [("src-2", 2), ("src-3", None)]
    again, kept = citations.resolve_citations(out.drop("snippet").select(*specs.columns), block, used)
    assert [r["reference"] for r in again.orderBy("pos").collect()] == ["src-2", "src-3", "b9999", None, "src-2"] and kept.count() == 2


def test_budget_and_layout(spark):
    b = spark.createDataFrame([("d", k, "x" * 40) for k in range(5)] + [("e", 0, "y")], "doc_id string, pos int, text string")
    got = blocks.bounded_payload(b, most_blocks=10, most_chars=100).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("truncated").alias("t"))
    assert {r["doc_id"]: (r["n"], r["t"]) for r in got.collect()} == {"d": (2, True), "e": (1, False)}


def test_links_and_cache(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://u@h:8/a/b?q", '<a href="/Item1">x</a><a class="c" href="http://other/Item2">y</a><a href="Item3">z</a><a href="/Item1">x</a>')], "page_id int, url string, html string")
    found = links.product_links(links.extract_links(pages), "/Item")
    assert sorted((r["link"], r["n_seen"]) for r in found.collect()) == [("http://u@h:8/Item1", 2), ("http://u@h:8/a/Item3", 1)]
    asked = []

    def fetch(urls):
        asked.extend(r["url"] for r in urls.collect())
        return urls.withColumn("html", F.concat(F.lit("<p>"), "url"))

    wanted = spark.createDataFrame([("u1",), ("u2",)], "url string")
    for _ in range(2):
        assert {r["url"]: r["html"] for r in links.ingest_urls(wanted, str(tmp_path / "cache"), fetch).collect()} == {"u1": "<p>u1", "u2": "<p>u2"}
    assert sorted(asked) == ["u1", "u2"]


class Flaky:
    def __init__(self, answers):
        self.answers, self.asked = list(answers), 0

    def complete(self, prompt):
        self.asked += 1
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_retry_and_fallback():
    client = Flaky([extract.ClientError("busy", 503), "ok"])
    assert extract.Retrying(client, pause=0).complete("p") == "ok" and client.asked == 2
    with pytest.raises(extract.ClientError):
        extract.Retrying(Flaky([extract.ClientError("gone", 404), "never"]), pause=0).complete("p")
    assert extract.Fallback([Flaky([extract.ClientError("a")]), Flaky(["second"])]).complete("p") == "second"
    third = Flaky(["unasked"])
    answer, failed = extract.first_answer(extract.attempts([Flaky([extract.ClientError("a", 429)]), Flaky(["b"]), third], "p"))
    assert answer == "b" and third.asked == 0 and failed == [extract.Attempt("Flaky", error="a", status=429)]
    with pytest.raises(extract.ClientError, match="Flaky: a; Flaky: b") as caught:
        extract.Fallback([Flaky([extract.ClientError("a")]), Flaky([extract.ClientError("b", 503)])]).complete("p")
    assert caught.value.status == 503
    with pytest.raises(ValueError):
        extract.Fallback([])


def test_extraction(spark):
    prompts = spark.createDataFrame([(1, "x"), (2, "bad")], "doc_id long, prompt string")

    class Stub:
        def complete(self, prompt):
            return "not json" if prompt.startswith("bad") else '```json\n{"product_name": "N", "specifications": [{"attribute": "Rated Voltage", "value": "12"}]}\n```'

    got = {r["doc_id"]: r for r in extract.extract_records(prompts, Stub).collect()}
    assert got[1]["specifications"][0]["attribute"] == "voltage_rating" and got[1]["attempts"] == 1 and got[1]["error"] is None
    assert got[2]["product_name"] is None and got[2]["attempts"] == 2 and "invalid record" in got[2]["error"]


def test_stream(spark, tmp_path):
    from plumbline.streaming.inbox import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x")
    seen = []
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, _: seen.extend(r["path"] for r in df.select("path").collect()), once=True).awaitTermination(60)
    assert len(seen) == 1


def test_bounded_payload_of_tables(spark):
    """A table counts with its rendered rows, wherever it stands; nothing is dropped without `truncated`."""
    rows = [(1, 0, None, [["a", None], ["b", "c"]]), (1, 1, "abc", None), (1, 2, None, None), (1, 3, "de", None), (2, 0, None, [["x" * 50]]), (2, 1, "tail", None)]
    b = spark.createDataFrame(rows, "doc_id int, pos int, text string, table array<array<string>>")
    got = {(r["doc_id"], r["pos"]): (r["text"], r["truncated"]) for r in blocks.bounded_payload(b, most_chars=40).collect()}
    assert got == {(1, 0): ("a | \nb | c", False), (1, 1): ("abc", False), (1, 2): ("", False), (1, 3): ("de", False)}
    first = {r["pos"]: r["truncated"] for r in blocks.bounded_payload(b.filter("doc_id = 1"), most_chars=13).collect()}
    assert first == {0: True, 1: True, 2: True}
    assert blocks.bounded_payload(b.drop("table"), most_chars=3).filter("doc_id = 1").count() == 3


def test_catalog_flow(spark, tmp_path):
    """Files to feeds: the two kinds of rows of FIXTURES.md, a price that cannot be read, and a row without a name."""
    head = "Product Name,Brand,SKU,Category,Rated Voltage,Current Rating,IP Rating,Operating Temperature,Thread Size,Tensile Strength,Material,Coating,Length,Weight,Price,Currency,Warehouse Bin"
    electrical = "Terminal Block,Acme,A1,Electrical,3V,0.7A,IP65,-40C,,,,,,48.5g,67.55,USD,W9"
    fastener = "Lock Nut,Acme,B1,Fasteners,,,,,M10,400MPa,steel,zinc plated,25mm,13.2g,call,USD,F4"
    (tmp_path / "demo.csv").write_text("\n".join([head, electrical, fastener, ",Acme,,,,,,,,,,,,,1,USD,"]))
    raw = formats.read_catalogs(spark, str(tmp_path))
    name = F.element_at(F.split("path", "/"), -1)
    records, warnings = flow.catalog_records(raw, ["path"], name)
    got = feeds.map_to_all(records).orderBy("row_number").collect()
    assert [(r["product_name"], r["overall_confidence"], r["google"]["price"], r["sources"][0]["reference"]) for r in got] == [("Terminal Block", 0.83, "67.55 USD", "demo.csv"), ("Lock Nut", 0.85, None, "demo.csv")]
    assert (got[1]["price"]["value"], got[1]["price"]["currency"], got[0]["category"]["confidence"]) == (None, "USD", 1.0)
    # Warnings of rows
    want = ["row 2: could not parse price 'call'", "row 3: no product name (and no sku/mpn fallback), skipped"]
    assert [r["warning"] for r in warnings.orderBy("row_number").collect()] == want


def test_document_flow(spark):
    """Scores against cited blocks, sources of cited blocks, failed and empty extractions."""
    spec = "array<struct<attribute:string,value:string,unit:string,status:string,reference:string>>"
    rows = [
        (1, "Bolt", [("length", "20 mm", None, "extracted", "b1"), ("material", "steel", None, "extracted", "b9"), ("length", "7 mm", None, "extracted", "b1")]),
        (2, "Nut", []),
        (3, None, None),
    ]
    extracted = spark.createDataFrame(rows, f"doc_id long, product_name string, specifications {spec}")
    blocks = spark.createDataFrame([(1, "b1", 0, "Length: 20 mm", None, "Sizes", 2)], "doc_id long, block_id string, pos int, text string, table array<array<string>>, section string, page int")
    files = spark.createDataFrame([(k, "document", f"{k}.pdf") for k in (1, 2, 3)], "doc_id long, type string, reference string")
    got = {r["doc_id"]: r for r in flow.document_records(extracted, blocks, files).collect()}
    assert sorted(got) == [1, 2] and got[2]["overall_confidence"] == 0.0 and got[2]["specifications"] == [] and [s["id"] for s in got[2]["sources"]] == ["src-1"]
    specs = got[1]["specifications"]
    assert [s["status"] for s in specs] == ["extracted", "needs_review", "needs_review"] and specs[1]["confidence"] <= 0.3
    assert specs[0]["reference"] == specs[2]["reference"] and specs[0]["reference"] in {s["id"] for s in got[1]["sources"]}
    assert specs[1]["reference"] == "b9" and [s["page"] for s in got[1]["sources"]] == [2]
    assert 0 < got[1]["overall_confidence"] < specs[0]["confidence"]
