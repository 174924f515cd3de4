"""JSON lines, CSV cells, text spans, vectors and snapshots."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S01. Objects by line; a byte-order mark, blank lines, and lines that aren't objects are passed over."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("v")).where("v like '{%'")
    return lines.select(F.from_json("v", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")


def json_lines_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S02. As above, but a line that isn't an object of the schema raises when it is read."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("v")).where("v <> ''")
    row = F.from_json("v", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    checked = lines.select(F.col("v"), row.alias("r")).withColumn("r", F.when(~bad, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.substring("v", 1, 80)))))
    return checked.select("r.*").drop("_corrupt")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """S03. Spark's commit protocol publishes all files or none."""
    rows.write.mode("overwrite").json(path)


def a1(row: Column, col: Column) -> Column:
    """The address of a cell, row and column from 1; columns up to ZZ."""
    letter = lambda n: F.char(n + 64)
    name = F.when(col <= 26, letter(col)).otherwise(F.concat(letter(F.floor((col - 1) / 26)), letter((col - 1) % 26 + 1)))
    return F.concat(name, row.cast("string"))


_DELIMITERS = ",;\t|"


def _decoded(data: bytes) -> tuple[str, str]:
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), "latin-1"


def csv_cells(spark: SparkSession, path: str, most_cells: int | None = None) -> DataFrame:
    """S04. (file, row, col, address, value) of every cell of the CSV files under ``path``.

    UTF-8 (with or without a mark), else GB18030; the delimiter of ``,;\\t|`` that the
    first line has most of. ``most_cells``: more in one file raises.
    """
    import csv
    import io

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                text, _ = _decoded(bytes(data))
                head = text.split("\n", 1)[0]
                delimiter = max(_DELIMITERS, key=head.count)
                rows, n = [], 0
                for r, cells in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), 1):
                    rows += [(file, r, c, v) for c, v in enumerate(cells, 1)]
                    n += len(cells)
                    if most_cells is not None and n > most_cells:
                        raise ValueError(f"{file} has over {most_cells} cells")
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=["file", "row", "col", "value"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "row", "col", "value"])

    cells = files(spark, path).mapInPandas(run, "file string, row int, col int, value string")
    return cells.withColumn("address", a1(F.col("row"), F.col("col")))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook(data: bytes) -> Iterator[tuple]:
    """(sheet, address, value, formula, merged) of an XLSX workbook's cells, by the standard library alone."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            path = "xl/" + targets[sheet.get(_REL)].removeprefix("/xl/").removeprefix("xl/")
            root = ElementTree.fromstring(z.read(path))
            merged = [m.get("ref") for m in root.findall("m:mergeCells/m:mergeCell", _NS)]
            starts = {m.split(":")[0]: m for m in merged}
            for cell in root.iter(f"{{{_NS['m']}}}c"):
                v, f, kind = cell.find("m:v", _NS), cell.find("m:f", _NS), cell.get("t")
                value = None if v is None else v.text
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                yield sheet.get("name"), cell.get("r"), value, None if f is None else "=" + (f.text or ""), starts.get(cell.get("r"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def conditional_formats(data: bytes) -> Iterator[tuple]:
    """(sheet, range, type, operator, formula) of a workbook's conditional formats, as they are written; none is evaluated."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            root = ElementTree.fromstring(z.read("xl/" + targets[sheet.get(_REL)].removeprefix("/xl/").removeprefix("xl/")))
            for block in root.findall("m:conditionalFormatting", _NS):
                for rule in block.findall("m:cfRule", _NS):
                    formulas = [f.text or "" for f in rule.findall("m:formula", _NS)]
                    yield sheet.get("name"), block.get("sqref"), rule.get("type"), rule.get("operator"), "; ".join(formulas)


def format_rules(files: DataFrame) -> DataFrame:
    """D35. (file, sheet, range, type, operator, formula) of the workbooks in ``files`` (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(file, *x) for x in conditional_formats(bytes(data))], columns=["file", "sheet", "range", "type", "operator", "formula"])

    return files.mapInPandas(run, "file string, sheet string, range string, type string, operator string, formula string")


def xlsx_cells(files: DataFrame) -> DataFrame:
    """S05. (file, sheet, address, value, formula, merged): cached values and formulas side by side, merged ranges at their first
    cell. files: path, content."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(file, *x) for x in workbook(bytes(data))], columns=["file", "sheet", "address", "value", "formula", "merged"])

    return files.mapInPandas(run, "file string, sheet string, address string, value string, formula string, merged string")


def xls_cells(files: DataFrame) -> DataFrame:
    """S06. (file, sheet, row, col, value) of legacy workbooks; needs the optional reader of that format (xlrd) on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xlrd

        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                book = xlrd.open_workbook(file_contents=bytes(data))
                rows = [(file, s.name, r + 1, c + 1, str(s.cell_value(r, c))) for s in book.sheets() if not s.visibility for r in range(s.nrows) for c in range(s.ncols)]
                yield pd.DataFrame(rows, columns=["file", "sheet", "row", "col", "value"])

    return files.mapInPandas(run, "file string, sheet string, row int, col int, value string")


def text_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = 8000) -> DataFrame:
    """S07. (id, paragraph, start, end, text): paragraphs that aren't blank with their offsets; longer ones are cut every ``most`` characters."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,body:string>>").alias("out"))
    parts = F.split(F.col(text), "\n")
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), p.alias("body")))).alias("out"))
    spans = F.aggregate(parts, start, step, lambda acc: F.filter(acc["out"], lambda x: F.trim(x["body"]) != ""))
    rows = docs.select(F.col(id).alias("id"), F.posexplode(spans).alias("paragraph", "p"))
    rows = rows.select("id", "paragraph", "p", F.explode(F.sequence(F.lit(0), F.length("p.body") - 1, F.lit(most))).alias("o"))
    body = F.substr("p.body", F.col("o") + 1, F.lit(most))
    return rows.select("id", "paragraph", (F.col("p.s") + F.col("o")).alias("start"), (F.col("p.s") + F.col("o") + F.length(body)).alias("end"), body.alias("text"))


def snapshots(rows: DataFrame, id: str) -> DataFrame:
    """S28. (id, payload, digest): each row as JSON, and its SHA-256."""
    payload = F.to_json(F.struct(*[c for c in rows.columns if c != id]))
    return rows.select(id, payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def merged_annotations(sources: list[DataFrame], key: str) -> DataFrame:
    """S30. One row per key: that of the last source which has it."""
    out = None
    for n, s in enumerate(sources):
        out = s.withColumn("_n", F.lit(n)) if out is None else out.unionByName(s.withColumn("_n", F.lit(n)))
    rest = [c for c in sources[0].columns if c != key]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "_n").alias("_r")).select(key, "_r.*")


def manifest_text(items: DataFrame) -> DataFrame:
    """S20. Page items with their active heading and the texts up to three positions away. items: doc, page, position, kind, text."""
    from ..operators.corpus import neighbours, running_heading

    rows = items.withColumn("_h", F.when(F.col("kind") == "title", F.col("text")))
    rows = running_heading(rows, ["doc"], "position", "_h")
    rows = rows.withColumn("_t", F.when(F.col("kind") == "text", F.col("text")))
    return neighbours(rows, ["doc", "page"], "position", "_t").drop("_h", "_t")


def case_records(lines: DataFrame, labels: list[str]) -> DataFrame:
    """S21. Records from ``label: value`` lines of pages: one per identity (the first label), pages and other values merged.

    lines: doc, page, line.
    """
    from ..functions.values import stable_id

    m = lines.withColumn("label", F.regexp_extract("line", r"^\s*([^:：]+?)\s*[:：]", 1)).withColumn("value", F.trim(F.regexp_extract("line", r"[:：]\s*(.*)$", 1)))
    wide = m.where(F.col("label").isin(labels)).groupBy("doc", "page").pivot("label", labels).agg(F.first("value"))
    wide = wide.where(F.col(f"`{labels[0]}`").isNotNull()).withColumn("id", stable_id(F.col(f"`{labels[0]}`")))
    return wide.groupBy("id", f"`{labels[0]}`").agg(F.count("*").alias("pages"), *[F.array_join(F.array_sort(F.collect_set(f"`{c}`")), "|").alias(c) for c in labels[1:]])


def vector_search(queries: DataFrame, vectors: DataFrame, allowed: DataFrame | None, most: int) -> DataFrame:
    """S25. Cosine top-k among allowed ids; an empty frame allows nothing, None all."""
    from ..operators.retrieval import cosine_top

    return cosine_top(queries, vectors if allowed is None else vectors.join(allowed, "id", "left_semi"), most)




_GLYPH = re.compile(r"/G([0-9A-Fa-f]{2})")


def glyphs(text: Column) -> Column:
    """S16. ``/G41`` as ``A`` where such marks make up 15 % of the text and the result is 90 % printable; else the text as it is."""

    def decode(values: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t or len("".join(_GLYPH.findall(t))) * 2 < 0.15 * len(t):
                return t
            out = _GLYPH.sub(lambda m: chr(int(m[1], 16)), t)
            return out if sum(c.isprintable() or c in "\n\t" for c in out) >= 0.9 * len(out) else t

        return values.map(one)

    return F.pandas_udf(decode, "string")(text)
