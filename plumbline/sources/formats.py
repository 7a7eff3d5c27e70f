"""File formats with the standard library: delimited text, workbooks, Word documents, web pages.

Each parser takes bytes and gives plain rows; `read_catalogs` and `read_documents` run them over
`binaryFile` scans, one file a row, and a broken file is an error row.
"""

from __future__ import annotations

import csv
import datetime
import io
import itertools
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..dims import ALIASES, CORE_COLUMNS

# Rows that may be the header, points of a known header and of a filled cell, and of how many cells.
WINDOW, KNOWN, FILLED, MOST_FILLED = 25, 3, 0.15, 12


def _header_score(cells: list[str | None]) -> float:
    full = [c for c in cells if c and c.strip()]
    normal = lambda c: re.sub(r"[^a-z0-9]+", " ", c.lower()).strip()
    key = lambda c: c.strip().lower()
    known = sum(normal(c) in CORE_COLUMNS or key(c) in ALIASES or key(c).replace(" ", "_") in ALIASES or key(c).replace("_", " ") in ALIASES for c in full)
    return KNOWN * known + FILLED * min(len(full), MOST_FILLED) if known else 0.0


def choose_header(rows: list[list[str | None]]) -> tuple[int | None, float]:
    """(index, score) of the header among the first rows; the fullest row of two cells at least where none is known."""
    best, at = 0.0, None
    for k, row in enumerate(rows[:WINDOW]):
        if (score := _header_score(row)) > best:
            best, at = score, k
    if at is None:
        full = [(sum(bool(c and c.strip()) for c in row), -k) for k, row in enumerate(rows[:WINDOW])]
        if full and max(full)[0] >= 2:
            at = -max(full)[1]
    return at, best


def parse_csv(data: bytes) -> list[tuple[str, int, list[str | None]]]:
    """('', row index, cells).  The delimiter among , ; tab whose header scores best, earlier rows first.

    A file that is no UTF-8, or that no delimiter or any of them cannot read, is read as cp1252 with commas.
    """
    try:
        text = data.decode("utf-8-sig")
        read = {d: list(csv.reader(io.StringIO(text, newline=""), delimiter=d)) for d in (",", ";", "\t")}
    except (UnicodeDecodeError, csv.Error):
        read = {",": list(csv.reader(io.StringIO(data.decode("cp1252", errors="replace"), newline="")))}

    def rank(d: str) -> tuple:
        at, score = choose_header(read[d][:WINDOW])
        return score, -(at if at is not None else WINDOW)

    return [("", k, row) for k, row in enumerate(read[max(read, key=rank)])]  # of equals the first


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(text: str) -> str:
    try:
        x = float(text)
    except ValueError:
        return text
    return str(int(x)) if x.is_integer() and "." not in text and "e" not in text.lower() else repr(x)


#: Numbers of built-in formats that show a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _shows_date(code: str) -> bool:
    """Whether a format code shows a date or time: it has d, m, y, h or s outside quotes, escapes and brackets, which may hold elapsed units."""
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower().split(";")[0])
    return bool(re.search(r"[dmyhs]", plain)) and "general" not in plain


class _Book:
    """An open workbook: its sheets, shared texts, which styles show dates, and where days are counted from."""

    def __init__(self, book: zipfile.ZipFile):
        self.book, names = book, set(book.namelist())
        tree = lambda name: ElementTree.fromstring(book.read(name))
        self.shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in tree("xl/_rels/workbook.xml.rels")}
        workbook = tree("xl/workbook.xml")
        self.sheets = [(x.get("name"), t if (t := targets[x.get(f"{_REL}id")]).startswith("xl/") else f"xl/{t}") for x in workbook.iter(f"{_MAIN}sheet")]
        since_1904 = any(x.get("date1904") in ("1", "true") for x in workbook.iter(f"{_MAIN}workbookPr"))
        self.epoch = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30)
        self.dates: list[str] = []  # for each style: date, elapsed, or nothing
        if "xl/styles.xml" in names:
            styles = tree("xl/styles.xml")
            codes = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(f"{_MAIN}numFmt")}
            for xf in next(styles.iter(f"{_MAIN}cellXfs"), ()):
                number = int(xf.get("numFmtId") or 0)
                code = codes.get(number, "[h]:mm:ss" if number == 46 else "")
                elapsed = bool(re.search(r"\[(h+|m+|s+)\]", code.lower()))
                self.dates.append("elapsed" if elapsed else "date" if (number in codes and _shows_date(code)) or (number not in codes and number in _DATE_FORMATS) else "")

    def moment(self, number: float, kind: str) -> str:
        """A date cell's text: a date with its time, a time alone below one day, or elapsed time."""
        day, part = divmod(number, 1)
        time = datetime.timedelta(milliseconds=round(part * 86_400_000))
        if kind == "elapsed":
            return str(datetime.timedelta(days=day) + time)
        if 0 <= number < 1 and time.days == 0:
            return str((datetime.datetime.min + time).time())
        if 0 < number < 60 and self.epoch.year == 1899:
            day += 1
        return str(self.epoch + datetime.timedelta(days=day) + time)

    def cell(self, cell) -> str | None:
        value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        if value is None or value.text is None:
            return None
        if kind == "s":
            return self.shared[int(value.text)]
        if kind == "b":
            return {"1": "True", "0": "False"}.get(value.text, value.text)
        if kind == "d":
            return str(datetime.datetime.fromisoformat(value.text))
        if kind in ("str", "e"):
            return value.text
        style = int(cell.get("s") or 0)
        shown = self.dates[style] if style < len(self.dates) else ""
        try:
            return self.moment(float(value.text), shown) if shown else _number(value.text)
        except (ValueError, OverflowError):
            return value.text

    def rows(self, part: str) -> Iterator[tuple[int, list[str | None]]]:
        """(row index, cells) of a sheet as it is read; rows that the file leaves out are left out."""
        index = -1
        with self.book.open(part) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                index = int(row.get("r")) - 1 if row.get("r") else index + 1
                cells: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self.cell(cell)
                row.clear()
                yield index, cells


def parse_xlsx(data: bytes) -> list[tuple[str, int, list[str | None]]]:
    """(sheet, row index, cells as text) of the sheet whose header scores best, the first of equals.

    Of the other sheets only the first rows are read. Numbers, truths, dates and times are written as Python writes them.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        book = _Book(package)
        best = None
        for name, part in book.sheets:
            head = dict(itertools.takewhile(lambda r: r[0] < WINDOW, book.rows(part)))
            _, score = choose_header([head.get(k, []) for k in range(max(head, default=-1) + 1)])
            if best is None or score > best[0]:
                best = score, name, part
        return [(best[1], k, cells) for k, cells in book.rows(best[2])] if best else []


Block = tuple[str, str | None, list[list[str | None]] | None, int | None, str | None]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def parse_docx(data: bytes) -> list[Block]:
    """(type, text, table, page, section) of the body in order; headings set the section."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in package.namelist():
            for style in ElementTree.fromstring(package.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                styles[style.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""

    def text_of(node) -> str:
        return "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else x.text or "" if x.tag == f"{_W}t" else "" for x in node.iter())

    out: list[Block] = []
    section = None
    for child in body if body is not None else []:
        if child.tag == f"{_W}p":
            if text := tidy(text_of(child)):
                style = child.find(f"{_W}pPr/{_W}pStyle")
                name = (styles.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else "").lower()
                heading = name.startswith("heading") or name == "title"
                section = text if heading else section
                out.append(("heading" if heading else "text", text, None, None, section))
        elif child.tag == f"{_W}tbl":
            rows = [[tidy("\n".join(text_of(p) for p in cell.iter(f"{_W}p"))) or None for cell in row.findall(f"{_W}tc")] for row in child.findall(f"{_W}tr")]
            if any(cell for row in rows for cell in row):
                out.append(("table", None, rows, None, section))
    return out


_SKIP, _VOID = {"script", "style", "nav", "footer", "noscript"}, {"br", "img", "hr", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr"}
_HEADINGS = {f"h{k}" for k in range(1, 7)}
_CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "section", "article", "footer", "nav", *_HEADINGS}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


class _Page(HTMLParser):
    """Blocks of a page: headings, tables, paragraphs and list items; an open p, li, tr or td is closed by what cannot stand in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[str] = []
        self.leaf: str | None = None  # the block element that takes text
        self.depth, self.skip = 0, 0
        self.text: list[str] = []
        self.rows: list[list[str | None]] = []
        self.cell: list[str] | None = None
        self.section: str | None = None
        self.json: list[str] | None = None
        self.products: list[dict] = []

    def _cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append(tidy(" ".join(self.cell)) or None)
            self.cell = None

    def _finish(self) -> None:
        if self.leaf == "table":
            self._cell()
            rows = [r for r in self.rows if any(r)]
            if rows:
                self.blocks.append(("table", None, rows, None, self.section))
        elif self.leaf:
            if text := tidy(" ".join(self.text)):
                heading = self.leaf in _HEADINGS
                self.section = text if heading else self.section
                self.blocks.append(("heading" if heading else "text", text, None, None, self.section))
        self.leaf, self.text, self.rows = None, [], []

    def _pop(self, tag: str) -> None:
        while self.open:
            top = self.open.pop()
            if self.leaf and len(self.open) < self.depth:
                self._finish()
            if top == tag:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "script" and ("type", "application/ld+json") in attrs:
            self.json = []
        if tag in _SKIP:
            self.skip += 1
            return
        if self.skip or tag in _VOID:
            return
        while self.open and tag in _CLOSED_BY.get(self.open[-1], ()) and not (self.leaf == "table" and self.open[-1] in ("p", "li")):
            self._pop(self.open[-1])
        if self.leaf == "p" and tag in _CLOSED_BY["p"] and "p" in self.open:
            self._pop("p")
        self.open.append(tag)
        if self.leaf is None and (tag in _HEADINGS or tag in ("p", "li", "table")):
            self.leaf, self.depth = tag, len(self.open)
        elif self.leaf == "table" and tag == "tr":
            self._cell()
            self.rows.append([])
        elif self.leaf == "table" and tag in ("td", "th"):
            self._cell()
            if not self.rows:
                self.rows.append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "script" and self.json is not None:
            try:
                data = json.loads("".join(self.json))
            except ValueError:
                data = []
            self.products += [x for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict) and x.get("@type") == "Product"]
            self.json = None
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in self.open:
            if self.leaf == "table" and tag in ("td", "th"):
                self._cell()
            self._pop(tag)

    def handle_data(self, data):
        if self.json is not None:
            self.json.append(data)
        elif not self.skip and data.strip():
            if self.cell is not None:
                self.cell.append(data.strip())
            elif self.leaf and self.leaf != "table":
                self.text.append(data.strip())

    def close(self):
        super().close()
        while self.open:
            self._pop(self.open[-1])


def flatten_product(product: dict) -> str:
    """`key: value` lines of a JSON-LD product; one level of nesting with dotted keys, lists repeated."""
    lines = []
    for key, value in product.items():
        if key in ("@type", "@context"):
            continue
        for item in value if isinstance(value, list) else [value]:
            if isinstance(item, dict):
                lines += [f"{key}.{k}: {v}" for k, v in item.items()]
            else:
                lines.append(f"{key}: {item}")
    return "\n".join(lines)


def parse_html(html: str) -> list[Block]:
    """JSON-LD products first, then headings, tables, paragraphs and list items in order."""
    page = _Page()
    page.feed(html)
    page.close()
    products = [("text", text, None, None, "JSON-LD Product") for p in page.products if (text := flatten_product(p))]
    return products + page.blocks


def parse_pdf(data: bytes) -> list[Block]:
    """Text and tables by page in reading order; needs pdfplumber."""
    try:
        import pdfplumber
    except ImportError as error:
        raise ValueError("PDF needs the optional package pdfplumber") from error
    out: list[Block] = []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for number, page in enumerate(pdf.pages, 1):
            tables = page.find_tables()
            boxes = [t.bbox for t in tables]
            middle = lambda o: ((o["x0"] + o["x1"]) / 2, (o["top"] + o["bottom"]) / 2)
            rest = page.filter(lambda o: o["object_type"] != "char" or not any(b[0] <= middle(o)[0] < b[2] and b[1] <= middle(o)[1] < b[3] for b in boxes))
            items = [(t.bbox[1], ("table", None, [[tidy(c) or None if c else None for c in row] for row in t.extract()], number, None)) for t in tables]
            items += [(line["top"], ("text", tidy(line["text"]), None, number, None)) for line in rest.extract_text_lines() if tidy(line["text"])]
            out += [x for _, x in sorted(items, key=lambda x: x[0])]
            if not items:
                out.append(("warning", f"page {number}: no extractable text or tables (likely scanned or image-only)", None, number, None))
    return out


def document_warnings(kind: str, name: str, blocks: list[Block]) -> list[str]:
    """What a reader of a document's blocks should know: nothing was found, or nothing to cite it by; pages' own warnings come with the blocks."""
    if kind == ".docx":
        if not blocks:
            return ["document produced no extractable text or tables"]
        return [] if any(b[0] == "heading" for b in blocks) else ["no heading styles found: blocks have no section, so citations name the file alone"]
    if kind == ".html":
        if not blocks:
            return [f"'{name}': no extractable text, tables, or JSON-LD product data"]
        return [] if any(b[4] == "JSON-LD Product" for b in blocks) else [f"'{name}': no JSON-LD Product data found, relying on tables and text alone"]
    return []


CATALOG_PARSERS: dict[str, Callable[[bytes], list]] = {".csv": parse_csv, ".xlsx": parse_xlsx, ".xlsm": parse_xlsx}
DOCUMENT_PARSERS: dict[str, Callable[[bytes], list[Block]]] = {".pdf": parse_pdf, ".docx": parse_docx, ".html": lambda data: parse_html(data.decode("utf-8", errors="replace"))}
_TABLE = pa.list_(pa.list_(pa.string()))
_BLOCK = "pos int, type string, text string, table array<array<string>>, page int, section string"


def extension(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def _blocks(rows: list[tuple], keys: list, key_type) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.string(), _TABLE, pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "pos", "type", "text", "table", "page", "section", "error"])


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc_id: the path, pos, type, text, table, page, section, error) of document files; unknown formats and broken files are error rows."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content", extension(F.col("path")).alias("format"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, kind in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    if kind not in DOCUMENT_PARSERS:
                        raise ValueError(f"unsupported format {kind!r}; supported: {', '.join(sorted(DOCUMENT_PARSERS))}")
                    rows = [(k, *b, None) for k, b in enumerate(b for b in DOCUMENT_PARSERS[kind](content) if b[0] != "warning")]
                except Exception as error:  # a file's fault is that file's row
                    rows = [(0, None, None, None, None, None, f"{type(error).__name__}: {error}")]
                yield _blocks(rows, [path] * len(rows), pa.string())

    return files.mapInArrow(run, f"doc_id string, {_BLOCK}, error string")


def html_blocks(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """(doc_id, pos, type, text, table, page, section, error) of a table of pages (id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(k, *b, None) for k, b in enumerate(parse_html(html or ""))]
                yield _blocks(rows, [key] * len(rows), pa.int64())

    return pages.select(F.col(page).cast("long").alias("doc_id"), "html").mapInArrow(run, f"doc_id long, {_BLOCK}, error string")


def read_catalogs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, sheet, row_index, cells, error) of all rows of catalogue files; see operators.catalog for headers and mapping."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content", extension(F.col("path")).alias("format"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, kind in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    if kind not in CATALOG_PARSERS:
                        raise ValueError(f"unsupported format {kind!r}; supported: {', '.join(sorted(CATALOG_PARSERS))}")
                    rows = [(*r, None) for r in CATALOG_PARSERS[kind](content)]
                except Exception as error:  # a file's fault is that file's row
                    rows = [(None, 0, None, f"{type(error).__name__}: {error}")]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.string())], names=["path", "sheet", "row_index", "cells", "error"])

    return files.mapInArrow(run, "path string, sheet string, row_index int, cells array<string>, error string")


#: Rows of files of any format: `kind` is row (of a catalogue), block, warning or error; a file's rows of one kind have pos from 0.
ROWS = "path string, kind string, pos int, sheet string, cells array<string>, type string, text string, table array<array<string>>, page int, section string"


def rows_of(path: str, kind: str, content: bytes) -> Iterator[tuple]:
    """One file's rows; a fault of the file, or an unknown format, is its only row."""
    try:
        if kind in CATALOG_PARSERS:
            yield from [(path, "row", k, sheet, cells, None, None, None, None, None) for sheet, k, cells in CATALOG_PARSERS[kind](content)]
            return
        if kind not in DOCUMENT_PARSERS:
            raise ValueError(f"unsupported format {kind!r}; supported: {', '.join(sorted([*CATALOG_PARSERS, *DOCUMENT_PARSERS]))}")
        found = DOCUMENT_PARSERS[kind](content)
    except Exception as error:  # a file's fault is that file's row
        yield path, "error", 0, None, None, None, f"{type(error).__name__}: {error}", None, None, None
        return
    blocks = [b for b in found if b[0] != "warning"]
    yield from [(path, "block", k, None, None, *b) for k, b in enumerate(blocks)]
    own = [(b[1], b[3]) for b in found if b[0] == "warning"]
    yield from [(path, "warning", k, None, None, None, text, None, page, None) for k, (text, page) in enumerate([*own, *((w, None) for w in document_warnings(kind, path, blocks))])]


def _row_batches(files: Iterator[tuple[str, str, bytes]], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for path, kind, content in files:
        for row in rows_of(path, kind, content):
            rows.append(row)
            if len(rows) >= most:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def scan(files: DataFrame, folder: str) -> dict[str, DataFrame]:
    """{kind: rows} of files (path, format, content): each is parsed once, into one table under `folder` that is split by kind.

    Kinds: row (path, pos, sheet, cells), block (path, pos, type, text, table, page, section), warning and error (path, pos, text, page).
    """
    schema = files.sparkSession.createDataFrame([], ROWS).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[str, str, bytes]]:
            for batch in batches:
                for k in range(batch.num_rows):  # one file's bytes at a time
                    path, kind, content = (batch.column(c)[k].as_py() for c in range(3))
                    yield path, kind, content if content is not None else b""

        yield from _row_batches(each(), schema)

    files.select("path", "format", F.col("content").cast("binary")).mapInArrow(run, ROWS).write.partitionBy("kind").parquet(folder)
    table = files.sparkSession.read.schema(ROWS).parquet(folder)
    columns = {"row": ["path", "pos", "sheet", "cells"], "block": ["path", "pos", "type", "text", "table", "page", "section"], "warning": ["path", "pos", "text", "page"], "error": ["path", "pos", "text", "page"]}
    return {kind: table.filter(F.col("kind") == kind).select(*names) for kind, names in columns.items()}


def scan_files(spark: SparkSession, paths: str | list[str], folder: str) -> dict[str, DataFrame]:
    """scan over files of any mix of formats, chosen by their names' last extension in lower case."""
    return scan(spark.read.format("binaryFile").load(paths).select("path", extension(F.col("path")).alias("format"), "content"), folder)


def tables_only(blocks: DataFrame) -> DataFrame:
    """The table blocks of documents."""
    return blocks.filter("type = 'table'")


def warnings_by_file(warnings: DataFrame) -> DataFrame:
    """(path, warnings): each file's warnings in order; a file without any has no row."""
    return warnings.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]).alias("warnings"))
