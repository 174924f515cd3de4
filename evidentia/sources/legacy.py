"""Legacy workbooks (compound files of BIFF8 records), by the standard library."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import a1

_MAGIC, _FREE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFA
_STATES = ("visible", "hidden", "very_hidden")
#: Numbers of built-in formats that show a date or time (fixed values).
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def stream(data: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """The first of the named streams of a compound file; raises ValueError if it isn't one, or has none of them."""
    if data[:8] != _MAGIC:
        raise ValueError("not a compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    n_fat, first_dir, _, cutoff, first_mini, n_mini, first_more, n_more = struct.unpack_from("<I I I I I I I I", data, 44)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    numbers = lambda x: struct.unpack(f"<{len(x) // 4}I", x[: len(x) // 4 * 4])
    tables, more = list(numbers(data[76:512])), first_more
    for _ in range(n_more):
        held = numbers(sector(more))
        tables += held[:-1]
        more = held[-1]
    fat = [x for i in tables[:n_fat] if i < _FREE for x in numbers(sector(i))]

    def chain(i: int, table: list[int]) -> Iterator[int]:
        seen = 0
        while i < _FREE and i < len(table) and seen <= len(table):
            yield i
            i, seen = table[i], seen + 1

    whole = lambda i: b"".join(sector(k) for k in chain(i, fat))
    entries = {}
    directory = whole(first_dir)
    for at in range(0, len(directory) - 127, 128):
        e = directory[at : at + 128]
        n, kind = struct.unpack_from("<H B", e, 64)
        if kind:
            entries[e[: max(n - 2, 0)].decode("utf-16-le", "replace")] = (kind, *struct.unpack_from("<I I", e, 116))
    for name in names:
        if name in entries and entries[name][0] == 2:
            _, start, length = entries[name]
            if length >= cutoff:
                return whole(start)[:length]
            root = next(v for v in entries.values() if v[0] == 5)
            mini, table = whole(root[1])[: root[2]], [x for k in chain(first_mini, fat) for x in numbers(sector(k))] if n_mini else []
            return b"".join(mini[k * small : (k + 1) * small] for k in chain(start, table))[:length]
    raise ValueError("no workbook stream")


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, parts) of records, each with its continuations."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(data):
        number, n = struct.unpack_from("<H H", data, at)
        body = data[at + 4 : at + 4 + n]
        at += 4 + n
        if number == 0x3C and held:
            held[1].append(body)
            continue
        if held:
            yield held
            if held[0] == 0x0A:
                return
        held = (number, [body])
    if held:
        yield held


class _Parts:
    """Reads over a record's parts; the characters of a string that goes on in the next part begin there with a new flag."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            part = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + part, n - len(part), self.at + len(part)
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def string(self, wide: int = 2) -> str:
        head = self.take(wide + 1)
        if len(head) < wide + 1:
            return ""
        n, flags = int.from_bytes(head[:wide], "little"), head[wide]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = ""
        while n and self.k < len(self.parts):
            width = 2 if flags & 1 else 1
            here = min(n, (len(self.parts[self.k]) - self.at) // width)
            out += self.take(here * width).decode("utf-16-le" if width == 2 else "latin-1", "replace") if here else ""
            n -= here
            if n:
                self.k, self.at = self.k + 1, 0
                flags = self.take(1)[0] if self.k < len(self.parts) else 0
        self.take(4 * runs + more)
        return out


def _rk(x: int) -> float:
    v = float((x >> 2) - (1 << 30 if x & 0x80000000 else 0)) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    return v / 100 if x & 1 else v


def workbook(data: bytes) -> list[tuple[str, str, int, int, str, str]]:
    """S06. (sheet, state, row, column, value, kind: text, number, date, boolean or error) of the filled cells of a legacy workbook, by sheet
    and then as they are stored. A formula's cell has its stored result. Dates are ISO text."""
    book = stream(data)
    sheets, strings, formats, styles, base = [], [], {}, [], datetime(1899, 12, 30)
    for number, parts in _records(book):
        body = parts[0]
        if number == 0x85 and body[5] == 0:
            sheets.append((struct.unpack_from("<I", body)[0], _STATES[min(body[4] & 3, 2)], _Parts([body[6:]]).string(1)))
        elif number == 0xFC:
            reader = _Parts(parts)
            n = struct.unpack("<I I", reader.take(8))[1]
            strings = [reader.string() for _ in range(n)]
        elif number == 0x41E:
            formats[struct.unpack_from("<H", body)[0]] = _Parts([body[2:]]).string()
        elif number == 0xE0:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif number == 0x22 and struct.unpack_from("<H", body)[0]:
            base = datetime(1904, 1, 1)

    def shows_date(style: int) -> bool:
        f = styles[style] if style < len(styles) else 0
        return f in _DATES or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats.get(f, "").lower()).replace("general", "")))

    def figure(v: float, style: int) -> tuple[str, str]:
        if shows_date(style) and 0 <= v < 2_958_466:
            t = base + timedelta(seconds=round(v * 86_400))
            return (t.date().isoformat() if t.time() == t.min.time() else t.isoformat(" ")), "date"
        return (str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)), "number"

    def told(value: int, error: int) -> tuple[str, str]:
        return (_ERRORS.get(value, "#ERR"), "error") if error else (str(bool(value)).upper(), "boolean")

    out = []
    for start, state, name in sheets:
        waits = None
        for number, parts in _records(book, start):
            body = parts[0]
            if number == 0x207 and waits:  # the text result of the formula before
                out.append((name, state, *waits, _Parts(parts).string(), "text"))
                waits = None
                continue
            if number not in (0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06) or len(body) < 6:
                continue
            row, col, style = struct.unpack_from("<H H H", body)
            if number == 0xBD:
                for i in range((len(body) - 6) // 6):
                    style, rk = struct.unpack_from("<H I", body, 4 + 6 * i)
                    out.append((name, state, row + 1, col + i + 1, *figure(_rk(rk), style)))
                continue
            value: tuple[str, str] | None = None
            if number == 0xFD:
                i = struct.unpack_from("<I", body, 6)[0]
                value = (strings[i] if i < len(strings) else "", "text")
            elif number == 0x204:
                value = (_Parts([body[6:], *parts[1:]]).string(), "text")
            elif number == 0x203:
                value = figure(struct.unpack_from("<d", body, 6)[0], style)
            elif number == 0x27E:
                value = figure(_rk(struct.unpack_from("<I", body, 6)[0]), style)
            elif number == 0x205:
                value = told(body[6], body[7])
            elif body[12:14] != b"\xff\xff":
                value = figure(struct.unpack_from("<d", body, 6)[0], style)
            elif body[6] == 0:
                waits = (row + 1, col + 1)
            elif body[6] in (1, 2):
                value = told(body[8], body[6] == 2)
            if value is not None and value[0] != "":
                out.append((name, state, row + 1, col + 1, *value))
    return out


def xls_cells(files: DataFrame) -> DataFrame:
    """S06. (file, sheet, state, row, col, address, value, kind) of legacy workbooks; a file that is none, or is damaged, gives one row of kind
    ``unreadable`` with the reason as its value."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "sheet", "state", "row", "col", "value", "kind"]
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                try:
                    rows = [(file, *r) for r in workbook(bytes(data))]
                except (ValueError, IndexError, struct.error, StopIteration) as e:
                    rows = [(file, None, None, 0, 0, str(e) or type(e).__name__, "unreadable")]
                yield pd.DataFrame(rows, columns=columns)

    rows = files.mapInPandas(run, "file string, sheet string, state string, row int, col int, value string, kind string")
    return rows.select("file", "sheet", "state", "row", "col", F.when(F.col("row") > 0, a1(F.col("row"), F.col("col"))).alias("address"), "value", "kind")
