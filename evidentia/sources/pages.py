"""PDF pages by the standard library, image candidates, web responses and fetch guards, and vectors by a supplied model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]])*\]\s*TJ|<[0-9A-Fa-f\s]*>\s*Tj|T\*|\bT[dD]\b|\bET\b", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(s: bytes) -> str:
    if s.startswith(b"<"):
        digits = re.sub(rb"\s", b"", s[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")

    def escape(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", escape, s[1:-1], flags=re.S).decode("latin-1")


def _shown(stream: bytes) -> str:
    out: list[str] = []
    for m in _SHOW.finditer(stream):
        if m[0] in (b"T*", b"ET") or re.fullmatch(rb"T[dD]", m[0]):
            out.append("\n")
        else:
            out.append("".join(_literal(s) for s in _STRING.findall(m[0])))
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def pdf_pages(data: bytes) -> list[str]:
    """The text layer of each page, in the order of page objects: strings shown by its content streams, plain or deflated.
    Fonts with codes of their own aren't mapped: ``S14`` tells such pages by their quality."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    pages = []
    for n in sorted(objects):
        body = objects[n]
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        text = []
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", refs[1]) if refs else []:
            part = objects.get(int(ref), b"")
            m = _STREAM.search(part)
            if m:
                try:
                    text.append(_shown(zlib.decompress(m[1]) if b"FlateDecode" in part else m[1]))
                except zlib.error:
                    text.append("")
        pages.append("\n".join(t for t in text if t))
    return pages


def pdf_scan(files: DataFrame) -> DataFrame:
    """S17. (file, page, text, quality, route): each page's text layer, its quality (S14), and whether it is read directly or by vision."""
    from ..operators.evidence import page_quality

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(file, n, t) for n, t in enumerate(pdf_pages(bytes(data)), 1)], columns=["file", "page", "text"])

    rows = files.mapInPandas(run, "file string, page int, text string").withColumn("quality", page_quality(F.col("text")))
    return rows.withColumn("route", F.when(F.col("quality").isin("text_layer", "sparse_text"), "direct").otherwise("vision"))


_PLACED = re.compile(rb"(?P<m>(?:[-+.\d]+\s+){6})Tm|(?P<d>(?:[-+.\d]+\s+){2})T[dD]\b|(?P<l>[-+.\d]+)\s+TL|(?P<n>T\*)|(?P<b>\bBT\b)|(?P<s>\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]])*\]\s*TJ|<[0-9A-Fa-f\s]*>\s*Tj)", re.S)


def _fragments(stream: bytes) -> list[tuple[float, float, str]]:
    """(x, y, text) of what a content stream shows, at the start of its line of text."""
    x = y = lead = 0.0
    out = []
    for m in _PLACED.finditer(stream):
        if m["b"]:
            x = y = 0.0
        elif m["m"]:
            x, y = map(float, m["m"].split()[4:])
        elif m["d"]:
            dx, dy = map(float, m["d"].split())
            x, y = x + dx, y + dy
        elif m["l"]:
            lead = float(m["l"])
        elif m["n"]:
            y -= lead
        else:
            text = "".join(_literal(t) for t in _STRING.findall(m["s"])).strip()
            if text:
                out.append((x, y, text))
    return out


def table_cells(fragments: list[tuple[float, float, str]], near: float = 3.0) -> list[tuple[int, int, str]]:
    """S15 on one page: (row, column, text) of its table, from the top. Rows are fragments on a line; columns begin where fragments of two rows
    or more begin, on lines of two fragments or more. Without two such columns there is no table."""
    lines: list[list[tuple[float, float, str]]] = []
    for f in sorted(fragments, key=lambda f: (-f[1], f[0])):
        if lines and abs(lines[-1][0][1] - f[1]) <= near:
            lines[-1].append(f)
        else:
            lines.append([f])
    rows = [sorted(r) for r in lines if len(r) > 1]
    starts: list[list[float]] = []
    for x in sorted(f[0] for r in rows for f in r):
        if starts and x - starts[-1][-1] <= near:
            starts[-1].append(x)
        else:
            starts.append([x])
    edges = [s[0] for s in starts if len(s) > 1]
    if len(edges) < 2 or len(rows) < 2:
        return []
    out: dict[tuple[int, int], list[str]] = {}
    for n, r in enumerate(rows, 1):
        for x, _, text in r:
            column = sum(x >= e - near for e in edges) or 1
            out.setdefault((n, column), []).append(text)
    return [(r, c, " ".join(t)) for (r, c), t in sorted(out.items())]


def _streams(data: bytes) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(page, content streams, JPEG images) by page object."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}

    def inflated(part: bytes) -> bytes:
        m = _STREAM.search(part)
        try:
            return b"" if not m else zlib.decompress(m[1]) if b"FlateDecode" in part else m[1]
        except zlib.error:
            return b""

    pages = [n for n in sorted(objects) if re.search(rb"/Type\s*/Page\b(?!s)", objects[n])]
    for k, n in enumerate(pages, 1):
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", objects[n])
        contents = [inflated(objects.get(int(r), b"")) for r in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])] if refs else []
        named = re.search(rb"/XObject\s*<<(.*?)>>", objects[n], re.S)
        images = [m[1] for r in (re.findall(rb"(\d+)\s+\d+\s+R", named[1]) if named else []) if b"DCTDecode" in objects.get(int(r), b"") and (m := _STREAM.search(objects[int(r)]))]
        yield k, contents, images


def pdf_tables(files: DataFrame) -> DataFrame:
    """S15. (file, page, row, col, text) of the tables of pages, by where their text stands. A page without a table gives no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                rows = [(file, page, *cell) for page, contents, _ in _streams(bytes(data)) for cell in table_cells([f for c in contents for f in _fragments(c)])]
                yield pd.DataFrame(rows, columns=["file", "page", "row", "col", "text"])

    return files.mapInPandas(run, "file string, page int, row int, col int, text string")


def visual_recovery(files: DataFrame, recognise: Callable[[bytes], list[tuple[str, float]]]) -> DataFrame:
    """S17. (file, page, rank, text, confidence): what a supplied recogniser reads in the images of pages that ``pdf_scan`` routes to vision; pages
    without an image it can take are not read, and keep their route."""
    pages = pdf_scan(files).where("route = 'vision'").select("file", "page")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                rows = [(file, page, n, t, float(c)) for page, _, images in _streams(bytes(data)) for image in images for n, (t, c) in enumerate(recognise(image), 1)]
                yield pd.DataFrame(rows, columns=["file", "page", "rank", "text", "confidence"])

    return files.mapInPandas(run, "file string, page int, rank int, text string, confidence double").join(pages, ["file", "page"], "left_semi")


def image_candidates(files: DataFrame, recognise: Callable[[bytes], list[tuple[str, float]]]) -> DataFrame:
    """S19. (file, rank, text, confidence, confirmed): what a supplied recogniser reads in each image; never a confirmed fact."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f, n, t, float(c), False) for f, d in zip(part["path"], part["content"], strict=True) for n, (t, c) in enumerate(recognise(bytes(d)), 1)]
            yield pd.DataFrame(rows, columns=["file", "rank", "text", "confidence", "confirmed"])

    return files.mapInPandas(run, "file string, rank int, text string, confidence double, confirmed boolean")


REFERENCES = "array<struct<url:string,title:string,content:string,rerank_score:double,date:string>>"


def web_references(responses: DataFrame, id: str = "id", payload: str = "payload", most: int = 50) -> DataFrame:
    """S26. (id, original_rank, url, title, excerpt, score, date) of search responses (JSON with ``references``), the first of each
    canonical URL, ``most`` ranks at most. Calls themselves are the caller's: this engine has no network."""
    from ..functions.values import canonical_url

    refs = F.from_json(F.get_json_object(payload, "$.references"), REFERENCES)
    rows = responses.select(F.col(id).alias("id"), F.posexplode(refs).alias("n", "r"))
    rows = rows.select("id", (F.col("n") + 1).alias("original_rank"), canonical_url(F.col("r.url")).alias("url"), "r.title", F.regexp_replace("r.content", r"\s+", " ").alias("excerpt"), F.col("r.rerank_score").alias("score"), "r.date")
    first = rows.where("url <> ''").groupBy("id", "url").agg(F.min(F.struct("original_rank", "title", "excerpt", "score", "date")).alias("s"))
    return first.where(F.col("s.original_rank") <= most).select("id", "s.original_rank", "url", "s.title", "s.excerpt", "s.score", "s.date")


def fetch_refused(url: Column, path: Column, disallowed: list[str]) -> Column:
    """S27. Why a page may not be fetched, empty if it may: an unsafe or inner host, or a path that its robots file disallows."""
    from ..operators.web import rejection

    why = rejection(url, F.lit("page"), [])
    for prefix in disallowed:
        why = F.when((why == "") & path.startswith(prefix), "robots").otherwise(why)
    return why


def encoded(docs: DataFrame, encode: Callable[[list[str]], list[list[float]]], id: str = "doc_id", text: str = "text", batch: int = 8) -> DataFrame:
    """D30. (id, vector): texts encoded in batches by a supplied model, which each worker loads once with the function."""
    kind = docs.schema[id].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                rows = part.iloc[i : i + batch]
                yield pd.DataFrame({"id": rows[id], "vector": encode([t or "" for t in rows[text]])})

    return docs.select(id, text).mapInPandas(run, f"id {kind}, vector array<double>")
