"""Queries on file formats (inventory S, D30, D35): a file per region is built in memory and read back."""

from __future__ import annotations

import hashlib
import zipfile
import zlib
from collections.abc import Callable, Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import markup as M
from ..sources import pages as G
from ..sources import tables as S
from .registry import Tables, query


def per_region(t: Tables, build: Callable[[list[str]], bytes]) -> DataFrame:
    """(path, content): a file of each region's nation names."""
    groups = t.nation.groupBy(F.col("n_regionkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "content": [build(list(n)) for n in part["names"]]})

    return groups.mapInPandas(run, "path string, content binary")


def zipped(members: dict[str, str]) -> bytes:
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def _workbook(names: list[str]) -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = "".join(f'<row><c r="A{i}" t="inlineStr"><is><t>{n}</t></is></c><c r="B{i}"><f>LEN(A{i})</f><v>{len(n)}</v></c></row>' for i, n in enumerate(names, 1))
    rule = '<conditionalFormatting sqref="B1:B9"><cfRule type="cellIs" operator="greaterThan"><formula>6</formula></cfRule></conditionalFormatting>'
    return zipped({
        "xl/workbook.xml": f'<workbook {ns} {rel}><sheets><sheet name="nations" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/worksheets/s.xml": f"<worksheet {ns}><sheetData>{rows}</sheetData>{rule}</worksheet>",
    })


def _document(names: list[str]) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    head = lambda x: f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{x}</w:t></w:r></w:p>'
    body = "".join(head(n) + f"<w:p><w:r><w:t>about {n}</w:t></w:r></w:p>" for n in names)
    return zipped({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})


def _pdf(names: list[str]) -> bytes:
    out, n = b"%PDF-1.4\n", 1
    for i, name in enumerate(names):
        stream = f"BT (Nation {name}) Tj T* [(of the) -250 ( region, page {i + 1} of this file)] TJ ET".encode()
        packed = zlib.compress(stream)
        out += b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n" % (n, n + 1)
        out += b"%d 0 obj << /Length %d /Filter /FlateDecode >> stream\n" % (n + 1, len(packed)) + packed + b"\nendstream endobj\n"
        n += 2
    return out


def _legacy(names: list[str]) -> bytes:
    """A legacy workbook: a sheet of names, their lengths and a date, and a hidden one; each record by number and body."""
    import struct

    rec = lambda number, body: struct.pack("<H H", number, len(body)) + body
    text = lambda x: struct.pack("<H B", len(x), 1) + x.encode("utf-16-le")
    bof, end = rec(0x809, struct.pack("<H H 12x", 0x600, 5)), rec(0x0A, b"")
    styles = rec(0xE0, struct.pack("<H H 16x", 0, 0)) + rec(0xE0, struct.pack("<H H 16x", 0, 14))
    strings = rec(0xFC, struct.pack("<I I", len(names), len(names)) + b"".join(map(text, names)))
    sheet = lambda at, state, name: rec(0x85, struct.pack("<I B B B B", at, state, 0, len(name), 0) + name.encode("latin-1"))
    cells = b"".join(rec(0xFD, struct.pack("<H H H I", i, 0, 0, i)) + rec(0x203, struct.pack("<H H H d", i, 1, 0, len(n))) + rec(0x27E, struct.pack("<H H H I", i, 2, 1, (45000 + i) << 2 | 2)) for i, n in enumerate(names))
    first, second = bof + cells + end, bof + rec(0x205, struct.pack("<H H H B B", 0, 0, 0, 1, 0)) + end
    head = len(bof + styles + strings + end) + len(sheet(0, 0, "nations")) + len(sheet(0, 1, "more"))
    book = bof + sheet(head, 0, "nations") + sheet(head + len(first), 1, "more") + styles + strings + end + first + second
    book += bytes(max(4096 - len(book), 0) + -max(len(book), 4096) % 512)
    n = len(book) // 512
    fat = struct.pack("<128I", 0xFFFFFFFD, 0xFFFFFFFE, *range(3, n + 2), 0xFFFFFFFE, *[0xFFFFFFFF] * (126 - n))
    entry = lambda name, kind, start, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<H B B 3I 36x I I I", 2 * len(name) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, 1 if kind == 5 else 0xFFFFFFFF, start, size, 0)).ljust(128, b"\0")
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(book)) + bytes(256)
    top = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<H H H H H 6x I I I I I I I I I", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return top + fat + directory + book


@query("S06_xls_cells", """WITH n AS (SELECT n_regionkey::VARCHAR AS file, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) SELECT file, 'nations' AS sheet, 'visible' AS state, 'A' || i AS address, n_name AS value, 'text' AS kind FROM n UNION ALL SELECT file, 'nations', 'visible', 'B' || i, length(n_name)::VARCHAR, 'number' FROM n
 UNION ALL SELECT file, 'nations', 'visible', 'C' || i, strftime(DATE '1899-12-30' + (45000 + i - 1)::INT, '%Y-%m-%d'), 'date' FROM n UNION ALL SELECT DISTINCT file, 'more', 'hidden', 'A1', 'TRUE', 'boolean' FROM n""")
def xls_cells(t: Tables):
    from ..sources.legacy import xls_cells as cells

    return cells(per_region(t, _legacy)).select("file", "sheet", "state", "address", "value", "kind")


def _tabular(names: list[str]) -> bytes:
    """A page with a title and a table of names and their lengths."""
    body = b"BT 1 0 0 1 50 800 Tm (Nations) Tj ET " + b"".join(b"BT 1 0 0 1 50 %d Tm (%s) Tj 150 0 Td (%d) Tj ET " % (760 - 20 * i, n.encode(), len(n)) for i, n in enumerate(names))
    return b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << /Length " + b"%d" % len(body) + b" >> stream\n" + body + b"\nendstream endobj\n"


@query("S15_table_cells", "WITH n AS (SELECT n_regionkey::VARCHAR AS file, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS row FROM nation) SELECT file, 1 AS page, row, 1 AS col, n_name AS text FROM n UNION ALL SELECT file, 1, row, 2, length(n_name)::VARCHAR FROM n")
def table_cells(t: Tables):
    return G.pdf_tables(per_region(t, _tabular))


@query("S05_xlsx_cells", "SELECT r AS file, 'A' || i AS address, n_name AS value, NULL::VARCHAR AS formula FROM (SELECT n_regionkey::VARCHAR AS r, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) UNION ALL SELECT r, 'B' || i, length(n_name)::VARCHAR, '=LEN(A' || i || ')' FROM (SELECT n_regionkey::VARCHAR AS r, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation)")
def xlsx_cells(t: Tables):
    return S.xlsx_cells(per_region(t, _workbook)).select("file", "address", "value", "formula")


@query("D35_format_rules", "SELECT r_regionkey::VARCHAR AS file, 'nations' AS sheet, 'B1:B9' AS range, 'cellIs' AS type, 'greaterThan' AS operator, '6' AS formula FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def format_rules(t: Tables):
    return S.format_rules(per_region(t, _workbook))


@query("S13_zip_scan", "SELECT n_regionkey::VARCHAR AS file, n_name || '.txt' AS name, length(n_name)::BIGINT AS bytes, n_name AS body FROM nation")
def zip_scan(t: Tables):
    return M.zip_scan(per_region(t, lambda names: zipped({f"{n}.txt": n for n in names}))).select("file", "name", "bytes", F.decode("content", "utf-8").alias("body"))


@query("S17_pdf_pages", "SELECT n_regionkey::VARCHAR AS file, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS page, 'Nation ' || n_name || chr(10) || 'of the region, page ' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) || ' of this file' AS text, 'direct' AS route FROM nation")
def pdf_pages(t: Tables):
    return G.pdf_scan(per_region(t, _pdf)).select("file", "page", "text", "route")


@query("S18_docx_scan", "SELECT n_regionkey::VARCHAR AS file, 'heading' AS kind, n_name AS heading, n_name AS text FROM nation UNION ALL SELECT n_regionkey::VARCHAR, 'paragraph', n_name, 'about ' || n_name FROM nation")
def docx_scan(t: Tables):
    return M.docx_scan(per_region(t, _document)).select("file", "kind", "heading", "text")


@query("S22_playbook_passages", "SELECT n_regionkey::VARCHAR AS file, n_name AS heading, 'about ' || n_name AS passage FROM nation")
def playbook_passages(t: Tables):
    rows = M.docx_scan(per_region(t, _document)).where("kind = 'paragraph'")
    return rows.groupBy("file", "heading").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("passage"))


def _recognise(data: bytes) -> list[tuple[str, float]]:
    return [(hashlib.sha256(data).hexdigest()[:8], 0.5)]


@query("S19_image_candidates")
def image_candidates(t: Tables):
    """A stand-in recogniser reads a digest: the seam, not a model."""
    return G.image_candidates(per_region(t, lambda names: "".join(names).encode()), _recognise)


@query("S26_web_references", r"SELECT min(page_id) AS id, 'https://' || lower(regexp_extract(url, '://([^/?#:]*)', 1)) || '/' AS url FROM pages GROUP BY 2")
def web_references(t: Tables):
    from ..functions.values import host

    ref = F.struct(F.concat(F.lit("HTTPS://"), host(F.col("url")), F.lit(":443/#x")).alias("url"), F.lit("t").alias("title"), F.lit("a  b").alias("content"), F.lit(0.5).alias("rerank_score"), F.lit("2024").alias("date"))
    rows = t.pages.select(F.col("page_id").alias("id"), F.to_json(F.struct(F.array(ref, ref).alias("references"))).alias("payload"))
    return G.web_references(rows).groupBy("url").agg(F.min("id").alias("id"))


@query("S27_fetch_guard", "SELECT page_id, CASE WHEN contains(url, '/de/') THEN 'robots' ELSE '' END AS refused FROM pages")
def fetch_guard(t: Tables):
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return t.pages.select("page_id", G.fetch_refused(F.col("url"), path, ["/de/"]).alias("refused"))


def _hashed(texts: list[str]) -> list[list[float]]:
    return [[b / 255 for b in hashlib.sha256(x.encode()).digest()[:8]] for x in texts]


@query("D30_encode")
def encode(t: Tables):
    """A stand-in encoder of hashes: the seam, not a model."""
    return G.encoded(t.documents, _hashed)
