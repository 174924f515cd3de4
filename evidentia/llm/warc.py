"""WARC archives: written by Spark's own writer, read back by a reader that salvages damaged files.

Archives are read in blocks, so memory is bounded by the longest record, not by an
archive or a gzip member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, words

#: Records of an archive file at most: a reading task holds a few files.
PER_FILE = 1000
#: Bytes read at once; of a header at most; of a record's block at most (a row's value can't be longer).
BLOCK, HEADER, LONGEST = 1 << 20, 1 << 20, (1 << 31) - 1
_ID = "<urn:x-page:%s>"
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "file string, start long, kind string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_bytes long, reason string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha: str, refers_to: int | None, date: str) -> bytes:
    """One record; ``payload`` None: a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", _ID % ("null" if page_id is None else page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)))
    if payload is None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _ID % ("null" if refers_to is None else refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends with a zero byte: its length's top byte is zero below 16 MB, and an empty member follows a longer one."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    if out[-1]:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += z.compress(b"") + z.flush()
    return out


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) under ``path``, one gzip member a record.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the
    largest page_id is a response and the others revisit it (rows that share that
    page_id are all responses; a null page_id revisits any other). A null html is an
    empty payload, a null url has no target. A payload may be as long as a row can be. Duplicates are found by an aggregate on
    digests, so a payload that very many pages share is one row there; only payloads
    whose digest may occur again are joined with it, the others go straight to the
    writer.

    Spark's text writer writes the members, so that any store and the commit
    protocol serve: each member's last byte, always zero, is the writer's separator.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("size", F.length("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    first = rows.where(F.col("size") >= min_bytes).groupBy(F.col("sha").alias("s"), F.col("size").alias("z")).agg(F.max("page_id").alias("held"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = scratch.written(first, "digests")
    slot = lambda sha: F.pmod(F.xxhash64(sha), F.lit(scratch.BITS))
    bits = spark.sparkContext.broadcast(scratch.slot_bitmap(first.select(slot("s"))))

    def part(again: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = scratch.in_bitmap(bits.value, batch.column(5).to_numpy())
                yield batch.filter(pa.array(hit == again)).select(range(5))

        return run

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = batch.slice(i, 200).to_pylist()
                made = [member(record(r["page_id"], r["url"], r["payload"], r["size"], base64.b32encode(r["sha"]).decode(), r.get("held"), date))[:-1] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["m"])

    lone = words.lean(lambda it: build(part(False)(it)))
    marked = rows.withColumn("slot", slot("sha"))
    once = marked.mapInArrow(lone, "m binary")
    twice = marked.mapInArrow(words.lean(part(True)), rows.schema).join(first, (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z")), "left")
    again = F.col("held").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("held"))
    twice = twice.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "sha", F.when(again, F.col("held")).alias("held"))
    made = once.union(twice.mapInArrow(words.lean(build), "m binary")).select(F.col("m").cast("string").alias("value"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", PER_FILE).text(path)
    scratch.forget(first)
    bits.destroy()


class Source:
    """An archive that is read in blocks: ``fetch(at, n)`` gives bytes of it."""

    def __init__(self, size: int, fetch: Callable[[int, int], bytes]):
        self.size, self.fetch, self.at, self.held = size, fetch, 0, b""
        self.next: dict[bytes, tuple[int, int]] = {}

    @classmethod
    def of(cls, data: bytes) -> Source:
        return cls(len(data), lambda at, n: data[at : at + n])

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the end."""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.fetch(at, max(n, BLOCK))
        return self.held[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int) -> int:
        """The first place of ``what`` from ``at`` on, the archive's size without one. What was found last is kept, as searches go forward."""
        low, found = self.next.get(what, (0, -1))
        if low <= at <= found:
            return found
        self.next[what] = (at, self._find(what, at))
        return self.next[what][1]

    def _find(self, what: bytes, at: int) -> int:
        while at < self.size:
            i = self.read(at, BLOCK).find(what)
            if i >= 0:
                return at + i
            at += BLOCK - len(what) + 1
        return self.size


class Member:
    """The inflated bytes of the gzip member at ``at``, as far as they go, a part at a time: those before ``base`` are forgotten."""

    def __init__(self, source: Source, at: int):
        self.source, self.end, self.z, self.step = source, at, zlib.decompressobj(31), 1 << 14
        self.base, self.buffer, self.done, self.broken = 0, bytearray(), False, ""

    def _more(self) -> None:
        part = self.source.read(self.end, self.step)
        if not part:
            self.done, self.broken = True, "the member is cut off"
            return
        before = self.z.copy()
        try:
            self.buffer += self.z.decompress(part)
        except zlib.error as e:
            self.done, self.broken = True, str(e)
            for i in range(len(part)):  # as far as it goes
                try:
                    self.buffer += before.decompress(part[i : i + 1])
                except zlib.error:
                    break
                self.end += 1
            return
        self.end += len(part) - len(self.z.unused_data)
        self.done = self.z.eof
        self.step = min(self.step * 2, BLOCK)

    def read(self, at: int, n: int) -> bytes:
        while not self.done and self.base + len(self.buffer) < at + n:
            self._more()
        return bytes(self.buffer[at - self.base : at - self.base + n])

    def find(self, what: bytes, at: int) -> int:
        """The first place of ``what`` from ``at`` on, the end of the bytes without one; all before it are forgotten."""
        while True:
            i = self.buffer.find(what, at - self.base)
            if i >= 0 or self.done:
                i = i if i >= 0 else len(self.buffer)
                self.forget(self.base + i)
                return self.base
            self.forget(max(at, self.base + len(self.buffer) - len(what) + 1))
            at = self.base
            self._more()

    def forget(self, at: int) -> None:
        del self.buffer[: at - self.base]
        self.base = at


def _id(value: str) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", value)
    return int(m[1]) if m else None


def parse(source: Source | Member, at: int = 0) -> tuple[dict, int]:
    """The record at a version line, and its end; raises ValueError if a check fails."""
    if source.read(at, len(_VERSION)) != _VERSION:
        raise ValueError("no version line")
    size = 1 << 12
    while (top := (text := source.read(at, size)).find(b"\r\n\r\n")) < 0 and len(text) == size and size < HEADER:
        size *= 4
    if top < 0:
        raise ValueError("the header doesn't end")
    head = {}
    for line in text[:top].decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        head[k.strip().lower()] = v.strip()
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    size, top = int(head["content-length"]), at + top
    if size > LONGEST or isinstance(source, Source) and top + size + 8 > source.size:
        raise ValueError("the block is cut off or too long")
    block = source.read(top + 4, size + 4)
    if len(block) < size + 4 or block[size:] != b"\r\n\r\n":
        raise ValueError("the block is cut off or too long")
    block, end = block[:size], top + 4 + size
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block digest differs")
    kind = head.get("warc-type", "")
    out = {"kind": "record", "record_type": kind, "page_id": _id(head.get("warc-record-id", "")), "refers_to": _id(head.get("warc-refers-to", ""))}
    url = head.get("warc-target-uri")
    out["url"] = url and re.sub(r"%(0[0-9A-F]|1[0-9A-F]|20|7F|25)", lambda m: chr(int(m[1], 16)), url)
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        m = re.search(rb"(?i)^content-length:[ \t]*(\d+)[ \t]*\r?$", http, re.M)
        sha = head.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response" and sha and sha != digest(payload):
            raise ValueError("the payload digest differs")
        out |= {"payload": payload if kind == "response" else None, "payload_bytes": len(payload) if kind == "response" else int(m[1]) if m else None, "payload_digest": sha or digest(payload)}
    return out, end + 4


def _held(member: Member, at: int) -> Iterator[dict]:
    """Records and gaps of the inflated bytes of the member at ``at``; without a record, gaps only."""
    i, bad, why = 0, None, ""
    while True:
        try:
            row, end = parse(member, i) if member.read(i, 1) else (None, i)
        except ValueError as e:
            if bad is None:
                bad, why = i, str(e)
            i = member.find(_VERSION, i + 1)
            if member.read(i, 1):
                continue
            row, end = None, i
        if bad is not None:
            yield {"kind": "gap", "start": at, "gap_bytes": i - bad, "reason": f"within a member: {why}"}
            bad = None
        if not row:
            return
        yield {**row, "start": at}
        i = end
        member.forget(i)


def salvage(data: bytes | Source) -> Iterator[dict]:
    """The records of one archive, gzip members or plain, in any mix, with a row for every quarantined gap.

    After a failed check the reader looks for the next gzip member or version line
    from which a whole record can be read; what lies between is a gap (start, bytes,
    the first reason). Within a member's inflated bytes, as far as they go, it looks
    for the next version line; such a gap has the member's start and counts inflated
    bytes. A damaged member that gave records ends in a gap from where it stopped.
    Zero bytes between members are padding.
    """
    source = Source.of(data) if isinstance(data, bytes) else data
    at, bad, why = 0, None, ""

    def gap(end: int) -> dict:
        return {"kind": "gap", "start": bad, "gap_bytes": end - bad, "reason": why}

    while at < source.size:
        lines, failed, member = at + 1, "", None
        if source.read(at, len(_MAGIC)) == _MAGIC:
            member, early = Member(source, at), []  # gaps before the first record wait for it
            for row in _held(member, at):
                if early is not None and row["kind"] == "gap":
                    early.append(row)
                    continue
                if early is not None:
                    if bad is not None:
                        yield gap(at)
                        bad = None
                    yield from early
                    early = None
                yield row
            if early is None:
                if not member.broken:
                    at = member.end
                    continue
                lines = member.end  # version lines before it were among the inflated bytes
            elif early or member.broken:
                member, failed = None, member.broken or early[0]["reason"].removeprefix("within a member: ")
            else:  # a member without content
                if bad is not None:
                    yield gap(at)
                    bad = None
                at = member.end
                continue
        elif bad is None and source.read(at, 1) == b"\0":
            at += 1
            continue
        else:
            try:
                row, end = parse(source, at)
            except ValueError as e:
                failed = "neither a member nor a version line" if str(e) == "no version line" else str(e)
            else:
                if bad is not None:
                    yield gap(at)
                    bad = None
                yield {**row, "start": at}
                at = end
                continue
        if failed and bad is None:
            bad, why = at, failed
        ahead = min(source.find(_MAGIC, at + 1), source.find(_VERSION, lines))
        if member is not None:
            bad, why = min(member.end, ahead), member.broken
        at = ahead
    if bad is not None:
        yield gap(source.size)


def _opened(path: str) -> pa.NativeFile:
    """A file by its URI, through pyarrow's own file systems."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, at = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@?=&"))
    return system.open_input_file(at)


def streams(path: str) -> bool:
    """Whether workers can open files of this scheme themselves; others come through Spark, each whole in its row."""
    if path.startswith("file:"):
        return True
    try:
        return bool(pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@?=&")))
    except (pa.ArrowInvalid, OSError):
        return False


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` (file, start, gap_bytes, reason) from the archives under ``path``.

    A response's payload is checked against its digest; a revisit has no payload but
    the size and digest of the full one. No files or empty files give no rows. Files
    are read in blocks where ``streams`` holds, one task a file.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    direct = streams(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString())

    def archive(file: str, content: bytes | None) -> Iterator[dict]:
        if not direct:
            yield from salvage(content or b"")
            return
        with _opened(file) as f:
            yield from salvage(Source(f.size(), lambda at, n: f.read_at(min(n, max(f.size() - at, 0)), at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

        for batch in batches:
            for i, file in enumerate(batch.column(0).to_pylist()):
                rows, size = [], 0
                for row in archive(file, None if direct else batch.column(1)[i].as_py()):
                    rows.append(row | {"file": file})
                    size += len(row.get("payload") or b"")
                    if len(rows) >= 200 or size > 16 * BLOCK:
                        yield out(rows)
                        rows, size = [], 0
                yield out(rows)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", *([] if direct else ["content"])).mapInArrow(words.lean(run), SCHEMA)
