"""HTML, XML, multi-part submissions, ZIP archives and DOCX documents, by the standard library."""

from __future__ import annotations

import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "noscript", "template", "nav", "footer", "svg"}
_BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "td", "th", "title", "br"}


class _Scan(HTMLParser):
    """Text blocks, table cells and images in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, int, int, str]] = []  # kind, table, row, col, text
        self.skip, self.text, self.tag = 0, [], "p"
        self.tables, self.table, self.row, self.col = 0, [], 0, 0

    def _flush(self) -> None:
        body = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if body:
            cell = bool(self.table) and self.tag in ("td", "th")
            self.out.append(("cell" if cell else "heading" if re.fullmatch(r"h[1-6]|title", self.tag) else "text", self.table[-1] if cell else 0, self.row if cell else 0, self.col if cell else 0, body))

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if tag in _BLOCK or tag == "table":
            self._flush()
            self.tag = tag
        if tag == "table":
            self.tables += 1
            self.table.append(self.tables)
            self.row = self.col = 0
        elif tag == "tr":
            self.row, self.col = self.row + 1, 0
        elif tag in ("td", "th"):
            self.col += 1
        elif tag == "img":
            a = dict(attrs)
            self.out.append(("image", 0, 0, 0, (a.get("alt") or a.get("src") or "")))

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in _BLOCK or tag == "table":
            self._flush()
            self.tag = "p"
        if tag == "table" and self.table:
            self.table.pop()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_elements(html: str) -> list[tuple[str, int, int, int, str]]:
    scan = _Scan()
    scan.feed(html or "")
    scan.close()
    scan._flush()
    return scan.out


def html_scan(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """S08. (id, element, kind, table, row, col, text) of each page: text blocks, headings, cells and images, in order."""
    kind = pages.schema[id].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, n, *e) for i, h in zip(part[id], part[html], strict=True) for n, e in enumerate(html_elements(h))]
            yield pd.DataFrame(rows, columns=["id", "element", "kind", "table", "row", "col", "text"])

    return pages.select(id, html).mapInPandas(run, f"id {kind}, element int, kind string, table int, row int, col int, text string")


def main_text(html: Column) -> Column:
    """S09. Scripts, styles, navigation and the like go; a row's cells are joined by ``|``, blocks stand on lines of their own."""
    x = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|noscript|svg)\b.*?</\1>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</t[dh]>\s*<t[dh][^>]*>", " | ")
    x = F.regexp_replace(x, r"(?i)</?(?:p|div|li|h[1-6]|tr|section|article|title|br|table|ul|head|body)\b[^>]*>", "\n")
    from ..functions.text import unescaped

    x = unescaped(F.regexp_replace(x, r"<[^>]+>", ""))
    lines = F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    return F.array_join(lines, "\n")


def xml_tables(text: str) -> list[tuple[str, int, str, str]]:
    """(table, row, column, value): groups of repeated siblings; attributes as ``@name``, repeated children joined by `` | ``."""
    root = ElementTree.fromstring(text)
    out: list[tuple[str, int, str, str]] = []

    def walk(node, path: str) -> None:
        counts = Counter(c.tag for c in node)
        seen: Counter = Counter()
        for c in node:
            here = f"{path}/{c.tag}"
            if counts[c.tag] > 1:
                seen[c.tag] += 1
                values: dict[str, list[str]] = {f"@{k}": [v] for k, v in c.attrib.items()}
                for g in c:
                    values.setdefault(g.tag, []).append((g.text or "").strip())
                if not len(c) and (c.text or "").strip():
                    values["#text"] = [c.text.strip()]
                out.extend((here, seen[c.tag], k, " | ".join(v)) for k, v in values.items())
            if len(c):
                walk(c, here)

    walk(root, root.tag)
    return out


def xml_scan(docs: DataFrame, id: str, text: str) -> DataFrame:
    """S11. (id, table, row, column, value) of XML texts; a text that isn't well formed gives no rows."""
    kind = docs.schema[id].dataType.simpleString()

    def tables(t: str | None):
        try:
            return xml_tables(t or "")
        except ElementTree.ParseError:
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            at, rows = [], []
            for i in range(len(batch)):
                own = tables(batch.column(1)[i].as_py())
                at += [i] * len(own)
                rows += own
                if len(rows) >= 20_000 or i == len(batch) - 1:
                    parts = zip(*rows, strict=True) if rows else [()] * 4
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, parts, types)], names=["id", "table", "row", "column", "value"])
                    at, rows = [], []

    return docs.select(id, text).mapInArrow(run, f"id {kind}, table string, row int, column string, value string")


def submission_parts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """S12. (id, part, type, filename, body) of multi-part submissions: ``<DOCUMENT>`` to ``</DOCUMENT>``, in order."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))
    rows = docs.select(F.col(id).alias("id"), F.posexplode(parts).alias("part", "p"))
    field = lambda name: F.trim(F.regexp_extract("p", rf"<{name}>([^\n<]*)", 1))
    return rows.select("id", "part", field("TYPE").alias("type"), field("FILENAME").alias("filename"), F.regexp_extract("p", r"(?s)<TEXT>(.*?)(?:</TEXT>|$)", 1).alias("body"))


#: Limits of an archive: members, bytes of one, ratio of bytes to compressed bytes.
MEMBERS, MEMBER_BYTES, RATIO = 1000, 50_000_000, 200


def zip_members(data: bytes, prefix: str = "zip") -> Iterator[tuple[str, str, int, str | None, bytes | None]]:
    """(id, name, bytes, refused, content); a member over a limit, encrypted or with an unsafe name has a reason and no content."""
    try:
        z = zipfile.ZipFile(BytesIO(data))
    except zipfile.BadZipFile:
        yield f"{prefix}:0", "", len(data), "not_a_zip", None
        return
    with z:
        for n, m in enumerate(x for x in z.infolist() if not x.is_dir()):
            why = None
            if n >= MEMBERS:
                why = "too_many_members"
            elif m.flag_bits & 1:
                why = "encrypted"
            elif m.file_size > MEMBER_BYTES:
                why = "too_large"
            elif m.file_size > RATIO * max(m.compress_size, 1):
                why = "ratio"
            elif m.filename.startswith("/") or ".." in m.filename.split("/"):
                why = "unsafe_name"
            yield f"{prefix}:{n}", m.filename, m.file_size, why, None if why else z.read(m)


def zip_scan(files: DataFrame) -> DataFrame:
    """S13. (file, id, name, bytes, refused, content) of the members of the archives in ``files`` (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                for row in zip_members(bytes(data)):
                    yield pd.DataFrame([(file, *row)], columns=["file", "id", "name", "bytes", "refused", "content"])

    return files.mapInPandas(run, "file string, id string, name string, bytes long, refused string, content binary")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes) -> list[tuple[str, str | None, int, int, int, str]]:
    """(kind, heading, table, row, col, text): paragraphs under their active heading and table cells; deleted text isn't read."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out, heading, tables = [], None, 0
    for e in body:
        if e.tag == f"{_W}p" and text(e):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            if style is not None and (style.get(f"{_W}val") or "").lower().startswith(("heading", "title")):
                heading = text(e)
                out.append(("heading", heading, 0, 0, 0, heading))
            else:
                out.append(("paragraph", heading, 0, 0, 0, text(e)))
        elif e.tag == f"{_W}tbl":
            tables += 1
            for r, row in enumerate(e.findall(f"{_W}tr"), 1):
                out += [("cell", heading, tables, r, c, text(cell)) for c, cell in enumerate(row.findall(f"{_W}tc"), 1)]
    return out


def docx_scan(files: DataFrame) -> DataFrame:
    """S18, S22. (file, block, kind, heading, table, row, col, text) of the documents in ``files`` (path, content): passages under
    their headings, and cells."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                rows = [(file, n, *b) for n, b in enumerate(docx_blocks(bytes(data)))]
                yield pd.DataFrame(rows, columns=["file", "block", "kind", "heading", "table", "row", "col", "text"])

    return files.mapInPandas(run, "file string, block int, kind string, heading string, table int, row int, col int, text string")
