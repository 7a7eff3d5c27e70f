"""Files of all formats in one scan, typed workbook cells, warnings, and envelopes."""

import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators import catalog, feeds, flow
from plumbline.sources import formats

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook(sheets, since_1904=False):
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    listed = "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, n in enumerate(sheets))
    formats_ = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm;@"/><numFmt numFmtId="165" formatCode="&quot;day&quot; 0.0"/><numFmt numFmtId="166" formatCode="[Red]0.00"/><numFmt numFmtId="167" formatCode="[h]:mm"/></numFmts>'
    styles = f"<styleSheet {S}>{formats_}<cellXfs>" + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 22, 21, 164, 165, 166, 167, 46)) + "</cellXfs></styleSheet>"
    parts = {
        "xl/workbook.xml": f'<workbook {S} {r}>{"<workbookPr date1904=" + chr(34) + "1" + chr(34) + "/>" if since_1904 else ""}<sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>",
        "xl/styles.xml": styles,
    }
    return packed(parts | {f"xl/worksheets/s{k}.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>" for k, rows in enumerate(sheets.values())})


def cell(value, style=0, kind=None):
    if kind == "inlineStr":
        return f'<c t="inlineStr"><is><t>{value}</t></is></c>'
    return f'<c s="{style}"{f" t={chr(34)}{kind}{chr(34)}" if kind else ""}><v>{value}</v></c>'


def test_workbook_cells_are_typed():
    head = "".join(cell(h, kind="inlineStr") for h in ("Product Name", "SKU", "Price"))
    values = cell(45000, 1) + cell("45000.75", 2) + cell("0.5", 3) + cell(45000, 4) + cell("12.5", 5) + cell("3", 6) + cell("1.25", 7) + cell("2.5", 8) + cell(1, 0, "b") + cell("#N/A", 0, "e") + cell("7.0") + cell("1E3") + cell("59", 1) + cell("2024-01-02T03:04:05", 0, "d")
    book = workbook({"notes": f"<row>{cell('a', kind='inlineStr')}</row>" * 40, "items": f'<row r="3">{head}</row><row r="5">{values}</row>'})
    rows = formats.parse_xlsx(book)
    assert rows[0] == ("items", 2, ["Product Name", "SKU", "Price"]) and rows[1][:2] == ("items", 4)
    day = str(datetime.datetime(2023, 3, 15))
    assert rows[1][2] == [day, "2023-03-15 18:00:00", "12:00:00", day, "12.5", "3", "1 day, 6:00:00", "2 days, 12:00:00", "True", "#N/A", "7.0", "1000.0", "1900-02-28 00:00:00", "2024-01-02 03:04:05"]
    assert formats.parse_xlsx(workbook({"x": f"<row>{cell(0.5 + 366, 2)}{cell(1)}</row>"}, since_1904=True)) == [("x", 0, ["1905-01-01 12:00:00", "1"])]


def test_a_csv_error_is_read_as_cp1252():
    big = '"' + "x" * 140_000 + '"'  # beyond the reader's field limit with commas
    with pytest.raises(Exception, match="field larger"):
        formats.parse_csv(f"a,{big}".encode())
    assert formats.parse_csv("Item;Größe\nBolt;5".encode("cp1252")) == [("", 0, ["Item;Größe"]), ("", 1, ["Bolt;5"])]
    assert formats.parse_csv("Item;Brand\nBolt;Acme".encode())[0][2] == ["Item", "Brand"]


def docx(*paragraphs):
    body = "".join(f'<w:p>{"<w:pPr><w:pStyle w:val=" + chr(34) + "Heading1" + chr(34) + "/></w:pPr>" if head else ""}<w:r><w:t>{text}</w:t></w:r></w:p>' for head, text in paragraphs)
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    files = {
        "good.CSV": b"Product Name,SKU,Price,Length\nBolt,1,$2,5 mm\n,,,\n,,x,\nNut,2,call,\n", "other.csv": b"x,y\n1,2\n", "head.docx": docx((True, "Sizes"), (False, "Length: 5 mm")), "plain.docx": docx((False, "text")), "empty.docx": docx(),
        "page.html": b"<h1>T</h1><p>x", "product.html": b'<script type="application/ld+json">{"@type": "Product", "name": "N"}</script><p>x', "none.html": b"<script>x</script>", "broken.docx": b"no zip", "what.txt": b"?", "nothing.csv": b"",
    }
    for name, data in files.items():
        (at / name).write_bytes(data)
    return at


def test_one_scan_of_all_formats(spark, folder, tmp_path):
    found = formats.scan_files(spark, str(folder), str(tmp_path / "scan"))
    name = F.regexp_extract("path", "([^/]+)$", 1).alias("name")
    count = {kind: {r.name: r["count"] for r in rows.groupBy(name).count().collect()} for kind, rows in found.items()}
    assert count == {
        "row": {"good.CSV": 5, "other.csv": 2}, "block": {"head.docx": 2, "plain.docx": 1, "page.html": 2, "product.html": 2},
        "warning": {"plain.docx": 1, "empty.docx": 1, "page.html": 1, "none.html": 1}, "error": {"broken.docx": 1, "what.txt": 1},
    }
    told = {r.path.rsplit("/", 1)[1]: r.warnings for r in formats.warnings_by_file(found["warning"]).collect()}
    assert told["empty.docx"] == ["document produced no extractable text or tables"] and told["plain.docx"][0].startswith("no heading styles found")
    assert told["none.html"][0].endswith("no extractable text, tables, or JSON-LD product data") and "no JSON-LD Product data" in told["page.html"][0]
    assert {r.text for r in found["error"].collect()} >= {"ValueError: unsupported format '.txt'; supported: .csv, .docx, .html, .pdf, .xlsm, .xlsx"}
    assert [tuple(r) for r in found["block"].filter("path like '%head.docx'").orderBy("pos").select("pos", "type", "text", "section").collect()] == [(0, "heading", "Sizes", "Sizes"), (1, "text", "Length: 5 mm", "Sizes")]
    assert formats.tables_only(found["block"]).count() == 0


def test_warnings_of_pages_come_in_order(monkeypatch):
    block = ("text", "t", None, 2, None)
    monkeypatch.setitem(formats.DOCUMENT_PARSERS, ".pdf", lambda data: [("warning", "page 1: blank", None, 1, None), block, ("warning", "page 3: blank", None, 3, None)])
    rows = list(formats.rows_of("f.pdf", ".pdf", b""))
    assert [(r[1], r[2], r[6], r[8]) for r in rows] == [("block", 0, "t", 2), ("warning", 0, "page 1: blank", 1), ("warning", 1, "page 3: blank", 3)]


def envelopes(spark, folder, at):
    rows = formats.scan_files(spark, str(folder), str(at / "scan"))["row"].select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("pos").alias("row_index"), "cells")
    return flow.catalog_envelopes(rows, ["file"], F.col("file"))


def test_envelopes_of_uploads(spark, folder, tmp_path):
    heads, items = envelopes(spark, folder, tmp_path)
    feeds.write_demo(heads, items, ["file"], "row_number", str(tmp_path / "demo"))
    found = {x["file"]: x for x in (json.loads(p.read_text()) for p in (tmp_path / "demo/objects").glob("file_=*/part-*"))}
    good, other = found["good.CSV"], found["other.csv"]
    assert [good[k] for k in ("error", "header_row", "total_rows", "accepted_rows", "rejected_rows")] == [None, 1, 3, 2, 1]
    assert good["row_warnings"] == ["row 2: no product name (and no sku/mpn fallback), skipped", "row 3: could not parse price 'call'"]
    assert good["column_mapping"]["Length"] == {"target": "length", "method": "alias", "confidence": 1.0}
    assert [(i["row_number"], i["product_name"], i["schema_org"]["offers"]) for i in good["items"]][0][:2] == (1, "Bolt") and len(good["items"]) == 2
    assert good["items"][0]["google"]["title"] == "Bolt" and good["items"][0]["specifications"][0]["attribute"] == "length" and good["items"][1]["price"] is None
    assert other["items"] == [] and other["accepted_rows"] == 0 and other["error"] == "not a product catalogue; detected headers: x, y"
    index = [json.loads(line) for p in sorted((tmp_path / "demo/index").glob("part-*")) for line in p.read_text().splitlines()]
    assert [x["file"] for x in index] == ["good.CSV", "other.csv"]
    back = feeds.read_objects(spark, str(tmp_path / "demo/objects"), "file string, total_rows long, items array<struct<row_number: int, product_name: string>>")
    assert sorted((r.file, r.total_rows, [i.product_name for i in r["items"]]) for r in back.collect()) == [("good.CSV", 3, ["Bolt", "Nut"]), ("other.csv", 1, [])]


def test_objects_of_many_items_and_of_a_failing_task(spark, tmp_path):
    heads = spark.createDataFrame([("a", 1), ("b", 2), ("", 3)], "k string, n int")
    items = spark.range(50_000).select(F.when(F.col("id") % 100 < 99, "a").otherwise("b").alias("k"), F.col("id").alias("at"), F.lit("é\n\"x\"").alias("t"))
    feeds.write_objects(heads, items.unionByName(spark.createDataFrame([("stray", 1, "t")], items.schema)), ["k"], "at", str(tmp_path / "out"))
    found = {x["k"]: x for x in (json.loads(p.read_text()) for p in (tmp_path / "out").glob("k_=*/part-*"))}
    assert {k: (x["n"], len(x["items"])) for k, x in found.items()} == {"a": (1, 49_500), "b": (2, 500), "": (3, 0)}
    assert [i["at"] for i in found["b"]["items"]] == [k * 100 + 99 for k in range(500)] and found["a"]["items"][0]["t"] == 'é\n"x"'
    bad = items.withColumn("t", F.when((F.col("k") == "b") & (F.col("at") > 40_000), F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        feeds.write_objects(heads, bad, ["k"], "at", str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").rglob("part-*") if "_temporary" not in str(p)]
