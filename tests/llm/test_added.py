"""Packing, layouts and manifests against plain versions, on the smallest tables and on awkward rows."""

import hashlib
import json
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import bpe, decontaminate, merkle, mixture, overwrite, queries, scratch, secrets

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, node string, block string, tree long, part int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    values = list(row[:5])
    if low and values[4] is not None:
        values[4] = values[4].translate({c: c + 32 for c in range(65, 91)})
    order = (values[0], values[1], values[2], values[3], values[4])
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in order))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda x: x[:3])
    trees = {s: climb([x[2] for x in sources[s]]) for s in names}
    top = climb([trees[s][-1][0] for s in names]) if names else []
    out = []
    for k, s in enumerate(names):
        for i, (known, doc, own, row) in enumerate(sources[s]):
            node = leaf(row, True) if known and zlib.crc32(str(doc).encode()) % 5 == 0 else own
            path = []
            for levels, j in ((trees[s], i), (top, k)):
                for nodes in levels[:-1]:
                    run = nodes[j // 16 * 16 : j // 16 * 16 + 16]
                    left, right = run[: j % 16], run[j % 16 + 1 :]
                    path += left + right
                    node, j = digest(*left, node, *right), j // 16
            out.append((row[0], own, trees[s][-1][0], top[-1][0], digest(*path), node, node == top[-1][0]))
    return sorted(out, key=repr)


def manifest(df):
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = merkle.manifest(df, altered, lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_of_whole_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted(map(tuple, queries.op13_merkle(spark, FOLDER).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)
    assert got == plain_manifest(rows) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [{"only": 1}, {None: 3, "": 1, "é": 16, "f": 17, "big": 600}, {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_manifest_of_awkward_rows(spark, sizes):
    """Sources of one leaf, of whole and partial runs and of several blocks; more sources than a block; nulls, repeated rows and ids, no text, clashing columns."""
    rows = [(i, s, None if i % 7 == 0 else "en", i, None if i % 11 == 0 else "" if i % 5 == 0 else f"Text {i} é😀") for s, n in sizes.items() for i in range(n)]
    rows += [rows[0], (None, rows[0][1], "en", None, None), (None, rows[0][1], "en", None, None), (3, rows[0][1], "x", 1, "Again " * 9)] if len(rows) > 1 else []
    df = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], DOCS)
    assert manifest(df) == plain_manifest(rows)


def test_manifest_of_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def held(pieces, docs, tokenizer, window=4096):
    """Holds pieces against the library's ids; returns the lengths of the sequences."""
    want = sorted((d, zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for d, t in docs if d is not None)
    ids = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t in docs}
    by_doc, used = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        used[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(ids) and len(want) <= len(docs)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[d]), zlib.crc32(ids[d][at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids[d])
    sizes = []
    for s in sorted(used):
        at = 0
        for offset, length in sorted(used[s]):
            assert offset == at and length > 0
            at += length
        sizes.append(at)
    total = sum(map(len, ids.values()))
    assert sizes == [window] * (total // window) + [1 << b for b in reversed(range(13)) if total % window >> b & 1]
    return sizes


def test_packing_of_whole_tables(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    held(queries.op11_packing(spark, FOLDER).collect(), docs, tokenizer)


def test_packing_to_a_mixture(spark, tokenizer):
    """Windows hold the target shares as long as all sources have tokens, then what is left; pieces carry their ids."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = [(i, ["a", "b", None][i % 3], " ".join(word() for _ in range(int(rng.integers(1, 900))))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    pieces = mixture.packed(df, bpe.Encoder(spark, queries.vocabulary()), {"a": 0.6, "b": 0.3, None: 0.1}, window=1024).collect()
    held(pieces, [(r[0], r[2]) for r in rows], tokenizer, 1024)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
    left = defaultdict(int)
    for p in pieces:
        left[p.source] += p.length
    target, seen, checked = {"a": 0.6, "b": 0.3, None: 0.1}, defaultdict(int), 0
    for k in range(max(p.sequence_id for p in pieces)):
        for p in pieces:
            if p.sequence_id == k:
                seen[p.source] += p.length
        if all(left[s] - seen[s] > 2048 for s in target):
            checked += 1
            assert all(abs(seen[s] - 1024 * (k + 1) * w) <= 64 * len(target) + 1 for s, w in target.items())
    assert checked > 10


def test_schedule_serves_every_token_once():
    """Rounds by formula against the queues served one round after the other."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        n = int(rng.integers(1, 6))
        tokens = rng.integers(0, 3000, n).tolist()
        shares = rng.integers(1, 30000, n).tolist()
        r = mixture.Rounds(tokens, shares, 256, 16)
        stream, done, turn = [], [0] * n, 0
        while sum(done) < sum(tokens):
            turn += 1
            for q in range(n):
                credit = turn * shares[q] * 256
                till = tokens[q] if credit >= tokens[q] * mixture.PARTS else min(tokens[q], credit // (mixture.PARTS * 16) * 16)
                stream += [(q, x) for x in range(done[q], till)]
                done[q] = max(done[q], till)
        place = {x: i for i, x in enumerate(stream)}
        for q in range(n):
            at = 0
            while at < tokens[q]:
                length = int(min(rng.integers(1, 400), tokens[q] - at))
                runs = [(int(a), int(b)) for a, b in zip(*(np.concatenate(x) for x in zip(*r.slices(q, at, length), strict=True)), strict=True)]
                flat = [a + i for a, b in runs for i in range(b)]
                assert flat == [place[q, x] for x in range(at, at + length)]
                at += length


def test_packing_awkward(spark, tokenizer, monkeypatch):
    """Null and empty texts, null sources and ids, a very long text, more sources than queues, clashing columns, no rows."""
    monkeypatch.setattr(mixture, "QUEUES", 3)
    schema = "doc_id long, source string, text string, ids string, part long, queue string, tokens string, start string"
    rows = [(1, "a", None), (2, None, ""), (3, "b", "w " * 40_000), (4, "c", "x"), (5, "d", "é😀 " * 99), (6, "a", " \t")] + [(i, f"s{i % 9}", "some words here") for i in range(10, 60)]
    df = spark.createDataFrame([(*r, "i", 1, "q", "t", "s") for r in rows], schema).repartition(3)
    encoder = bpe.Encoder(spark, queries.vocabulary())
    held(mixture.packed(df, encoder, with_ids=False).collect(), [(r[0], r[2]) for r in rows], tokenizer)
    twice = spark.createDataFrame([(7, "a", "one two"), (7, "a", "one two"), (None, None, "three")], "doc_id long, source string, text string")
    assert sorted((p.doc_id or 0, p.doc_tokens, p.length) for p in mixture.packed(twice, encoder).collect() if p.start == 0) == sorted((p.doc_id or 0, p.doc_tokens, p.length) for p in mixture.packed(twice, encoder).collect() if p.start == 0)
    assert sum(p.length for p in mixture.packed(twice, encoder).collect()) == 8
    assert mixture.packed(df.where("false"), encoder).count() == 0


def plain_layout(rows, per_file):
    """{(day, file_no): rows in order}; rows: (sale_id, total, sold_at, arrived_at)."""
    last = {}
    for r in rows:
        if r[0] not in last or (r[3] is not None and (last[r[0]][3] is None or r[3] > last[r[0]][3])):
            last[r[0]] = r
    days = defaultdict(list)
    for r in last.values():
        days[-1 if r[2] is None else (r[2] - datetime(1970, 1, 1)).days].append(r)
    out = {}
    for d, rs in days.items():
        rs.sort(key=lambda r: (r[2] or datetime.min, r[0] is not None, r[0] or 0))
        for i in range(0, len(rs), per_file):
            out[d, i // per_file] = rs[i : i + per_file]
    return out


def micros(t):
    return "" if t is None else str((t - datetime(1970, 1, 1)) // timedelta(microseconds=1))


def agrees(layout, report, early, everything, names):
    """Holds a report and its files against plain layouts of the early rows and of all."""
    start, final = plain_layout(early, layout.per_file), plain_layout(everything, layout.per_file)
    stood = {r[0]: d for (d, _), rs in start.items() for r in rs}
    before = {id_: r for rs in start.values() for r in rs for id_ in [r[0]]}
    touched = set()
    for (d, _), rs in final.items():
        for r in rs:
            if before.get(r[0]) != r:
                touched |= {d, stood.get(r[0], d)}
    got = {(r.day, r.file_no): r for r in report}
    assert set(got) == set(final) and len(got) == len(report)
    for key, rs in final.items():
        r = got[key]
        cents = sum(0 if x[1] is None else int(np.floor(100 * x[1] + 0.5)) for x in rs)
        crc = sum(zlib.crc32(f"{'' if a is None else a}:{micros(b)}:{micros(c)}".encode()) for a, _, b, c in rs)
        ids = hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in rs).encode()).hexdigest()
        assert (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten, r.columns) == (len(rs), cents, crc, ids, key[0] in touched, ",".join(names)), key
        table = pq.read_table(local(r.path), partitioning=None)
        assert table.column_names == names and table["sale_id"].to_pylist() == [x[0] for x in rs] and table["sold_at"].to_pylist() == [x[2] for x in rs]
    assert {str(p) for p in Path(local(layout.root)).rglob("*.parquet")} == {local(r.path) for r in report}


def local(path):
    return "/" + path.partition(":")[2].lstrip("/") if ":" in path else path


SALES = "sale_id long, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, day string, file_no int, x string, id long, t int"


@pytest.fixture(scope="module")
def sales():
    """Early and late rows: nulls, ties of time, a day that is emptied, sales that move, new sales, one day with most rows, a second of one day with most of its rows."""
    rng = np.random.default_rng(5)
    day = lambda d, s=0: datetime(2024, 1, 1) + timedelta(days=int(d), seconds=int(s))
    early = [(i, float(i) / 3, day(0 if i % 3 else rng.integers(0, 9), 0 if i % 2 else rng.integers(0, 86400)), day(10, i)) for i in range(400)]
    early += [(1000 + i, None, None, day(10, i)) for i in range(9)] + [(2000, 5.0, day(20), day(10)), (2001, 0.125, day(3, 5), None), (None, 1.0, day(2), day(9)), (None, 2.0, day(2, 1), day(8))]
    early += [(7, -1.0, day(5), day(9))]  # arrives before another row of its sale
    late = [(i, float(i), day(rng.integers(0, 4), 77), day(30, i)) for i in range(0, 60, 7)] + [(2000, 6.0, day(21), day(31)), (5000, 7.0, day(1), day(31)), (5000, 8.0, day(2), day(32)), (1001, 1.0, day(6), day(31)), (2001, 3.0, None, day(40))]
    late += [(11, 3.0, day(7), None)]  # no time of arrival: earlier than any other
    return early, late


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 3, "x", 9, 8) for r in rows], SALES)


def test_layout_and_overwrite(spark, sales):
    early, late = sales
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # times without a zone don't heed it
        layout = overwrite.Layout(frame(spark, early), scratch.path(spark, "layout"), per_file=23)
        layout.start(frame(spark, early))
        kept = {p: p.read_bytes() for p in Path(local(layout.root)).rglob("*.parquet")}
        again = layout.update(frame(spark, late))
        report = layout.report(again).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    names = [f.split()[0] for f in SALES.split(", ")]
    agrees(layout, report, early, early + late, names)
    assert not any(r.day == 19723 + 20 for r in report) and any(not r.rewritten for r in report)
    assert all(kept[Path(local(r.path))] == Path(local(r.path)).read_bytes() for r in report if not r.rewritten)
    assert layout.update(frame(spark, [])) == []
    assert sorted(map(tuple, layout.report([]).drop("rewritten").collect())) == sorted(tuple(r)[:-1] for r in report)


def test_layouts_without_rows(spark, sales):
    early, _ = sales
    layout = overwrite.Layout(frame(spark, []), scratch.path(spark, "layout"), per_file=5)
    layout.start(frame(spark, []))
    assert layout.report([]).count() == 0
    agrees(layout, layout.report(layout.update(frame(spark, early))).collect(), [], early, [f.split()[0] for f in SALES.split(", ")])


def test_overwrite_of_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/sales.parquet").select("sale_id", "total", "sold_at", "arrived_at").collect()]
    again = []
    for i, total, sold, arrived in rows:
        h = zlib.crc32(str(i).encode()) if i is not None else None
        if h is not None and h % 3 == 0 and sold is not None and (sold - datetime(1970, 1, 1)).days % 7 == 0:
            again.append((i, None if total is None else total + 1, sold + timedelta(days=h % 2), None if arrived is None else arrived + timedelta(days=1 + h % 97)))
    early = [r for r in rows + again if r[3] is not None and r[3] < datetime(2024, 4, 10)]
    report = queries.op12_overwrite(spark, FOLDER).collect()
    layout = overwrite.Layout(spark.read.parquet(f"{FOLDER}/sales.parquet"), report[0].path.rsplit("/", 3)[0], 1 + len(rows) // 700)
    agrees(layout, report, early, rows + again, ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"])
    assert report[0].path.startswith(spark.conf.get("spark.checkpoint.dir").replace("file://", "file:"))


def test_words_merged_together_are_those_merged_alone():
    """Merges of many words at once, over words with all kinds of lengths and bytes."""
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        codec = bpe.Codec(json.load(f))
    rng = np.random.default_rng(2)
    parts = [bytes(rng.choice(list(b"etaoin shrdlu".replace(b" ", b"") if i % 2 else bytes(range(33, 256))), int(rng.integers(1, 60)))) for i in range(3000)]
    ends = np.cumsum([len(p) for p in parts])
    flat, count = codec.merged_all(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends)
    edges = np.concatenate(([0], np.cumsum(count)))
    assert [flat[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [codec.merged(p) for p in parts]


def test_a_benchmark_in_shards_finds_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "CHARS", 4000)
    assert decontaminate._items(bench)[1] > 3
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == want
    clash = docs.withColumn("hits", F.lit(1)).withColumn("its_row", F.lit("x")).withColumn("__hits", F.lit(2))
    clean = decontaminate.clean(clash, bench)
    assert clean.columns == clash.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in want if not r[2]}


def test_every_token_has_as_many_decoys_from_the_whole_text(spark):
    key = "aB3dE5gH7jK9mN1pQ3sT5vX7zA9"
    early, late = "one two three four five six " * 4000, "zebra quagga okapi tapir " * 4000
    rows = spark.createDataFrame([(1, f"{late} {key}"), (2, f"{late} " + f"{key} " * 40), (3, f"{early}{late} {key}"), (4, "x " + "aB3" * 700)], "doc_id long, text string")
    got = {r.doc_id: (r.n, r.d) for r in secrets.found(rows).select("doc_id", F.size("__candidates").alias("n"), F.size("__decoys").alias("d")).collect()}
    assert got == {1: (1, 24), 2: (40, 960), 3: (1, 24), 4: (1, 24)}


def test_stages_with_columns_named_as_their_own(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ["score", "__score", "hits", "__hits", "__text", "its_text", "__base", "__spans", "__decoys", "__key", "__id", "key", "kept_key", "column0", "column7", "digest", "row", "n"]
    clash = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = {r.doc_id: r.text for r in stage(spark, docs, FOLDER).collect()}
        out = stage(spark, clash, FOLDER)
        assert out.columns == clash.columns, name
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == want and all(r[n] == i for r in rows for i, n in enumerate(names)), name
