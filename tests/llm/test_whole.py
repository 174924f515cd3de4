"""Operators do the whole job: near copies at any offset, clean rows kept, damaged archives read, similar branches merged."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
from evidentia.llm import decontaminate, warc




def test_decontamination_between_aligned_starts(spark):
    item = [f"q{i}" for i in range(80)]
    copy = ["x0", "x1", *item[2:40], "y0", "y1", "y2", "y3", *item[40:78], "x2", "x3"]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = spark.createDataFrame([(1, "before it " + " ".join(copy) + " after")], "doc_id long, text string")
    (hit,) = decontaminate.contaminated(rows, benchmark).collect()
    assert (hit["items"], hit.best) == ("1:4:80", round(68 / 84, 6))
    assert decontaminate.clean(rows, benchmark).count() == 0


def test_decontamination_with_inserted_and_deleted_words(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(3, 70))]) for i in range(12)] + [(12, ["w0"] * 30), (13, ["w1", "w2"] * 20)]
    docs = []
    for d in range(150):
        text = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(text) + 1)
            text[i : i + rng.choice((0, 1, 2))] = [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 3)))]
        docs.append((d, [*rng.choices(vocabulary, k=rng.randint(0, 9)), *text, *rng.choices(vocabulary, k=rng.randint(0, 9))]))
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    want = {}
    for d, w in docs:
        want[d] = {}
        for i, s in items:
            x = grams(s)
            for a in range(max(len(w) - len(s), 0) + 1):
                y = grams(w[a : a + len(s)])
                alike = sum((x & y).values()) / sum((x | y).values())
                aligned = any(s[j : j + 5] == w[a + j : a + j + 5] for j in range(max(len(s) - 4, 1)) if a + j + min(len(s), 5) <= len(w))
                if alike >= 0.8 and (alike, aligned) > want[d].get(i, (0, 0, 0))[1:]:
                    want[d][i] = (a, alike, aligned)
    frame = lambda rows, names: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], names)
    got = decontaminate.contaminated(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()
    found = {r.doc_id: {int(i): int(a) for i, a, _ in re.findall(r"(\d+):(\d+):(\d+)", r["items"])} for r in got}
    assert found == {d: {i: a for i, (a, _, _) in x.items()} for d, x in want.items()} and sum(map(bool, found.values())) > 50
    assert all(r.best == round(max((x for _, x, _ in want[r.doc_id].values()), default=0.0), 6) for r in got)


def test_near_duplicates_drop_only_near_copies(spark):
    said = lambda name, n=20: " ".join(f"{name}{i}" for i in range(n))
    rows = [
        (None, said("a")), (None, said("a")), (None, said("b")), (None, None),
        (7, said("c")), (7, said("d")), (7, said("d")), (7, said("e")), (7, said("e") + " more"),
        (8, said("c") + " tail"), (9, said("f")), (9, said("d")), (3, said("f") + " tail"), (4, said("g")), (5, None), (5, ""),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    out = corpus_pipeline.no_near_duplicates(spark, docs, "")
    got = Counter((r.doc_id, r.text) for r in out.collect())
    one = [r for r in ((7, said("e")), (7, said("e") + " more")) if r in got]
    assert out.columns == docs.columns and len(one) == 1
    assert got == Counter([(None, said("a")), (None, said("a")), (None, said("b")), (None, None), (7, said("c")), (7, said("d")), *one, (3, said("f") + " tail"), (4, said("g")), (5, None), (5, "")])
    unique = docs.where("doc_id is null or doc_id in (3, 4, 8)")
    assert corpus_pipeline.no_near_duplicates(spark, unique, "").count() == unique.count()


def test_salvage_within_members():
    def made(i):
        body = random.Random(i).randbytes(3000)
        return warc.record(i, f"http://x/{i}", body, len(body), warc.digest(body), None, "1970-01-01T00:00:00Z")

    def packed(*records):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(b"".join(records)) + z.flush()

    def read(data):
        rows = list(warc.salvage(data))
        return [r["page_id"] for r in rows if r["kind"] == "record"], [(r["start"], r["gap_bytes"]) for r in rows if r["kind"] == "gap"]

    bad = made(1).replace(made(1)[-50:-40], b"0123456789")
    whole = packed(made(0), bad, b"junk", made(2), made(3))
    assert read(whole + packed(made(4))) == ([0, 2, 3, 4], [(0, len(bad) + 4)])
    cut = packed(made(0), made(1), made(2))[:-1500]
    ids, gaps = read(packed(made(4)) + cut)
    assert ids == [4, 0, 1] and gaps[-1] == (len(packed(made(4)) + cut), 0) and sum(n for _, n in gaps) > 0
    ids, gaps = read(cut + packed(made(4)))
    assert ids == [0, 1, 4] and gaps
    assert read(packed(bad) + packed(made(4))) == ([4], [(0, len(packed(bad)))])
    assert read(packed(made(0), made(1))) == ([0, 1], [])


def test_archives_are_read_in_blocks(spark, monkeypatch):
    def made(i, n=3000):
        body = random.Random(i).randbytes(n)
        return warc.record(i, f"http://x/{i}", body, len(body), warc.digest(body), None, "1970-01-01T00:00:00Z")

    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = b"".join(made(i) for i in range(60))
    one = z.compress(whole) + z.flush()
    bad = made(99).replace(made(99)[-50:-40], b"0123456789")
    data = one + b"junk" * 9000 + warc.member(made(70)) + made(71) + bad + made(72, 40_000) + warc.member(made(73))[:-200]
    want = list(warc.salvage(data))
    ids = [*range(60), 70, 71, 72]
    assert [r["page_id"] for r in want if r["kind"] == "record"] == ids and sum(r["kind"] == "gap" for r in want) == 3
    monkeypatch.setattr(warc, "BLOCK", 4096)
    read = []

    def fetch(at, n):
        read.append(n)
        return data[at : at + n]

    assert list(warc.salvage(warc.Source(len(data), fetch))) == want and max(read) <= 41_000  # never more than a record
    cut = made(1).replace(b"Content-Length: 3", b"Content-Length: 9999999993")  # a length that the file hasn't
    rows = list(warc.salvage(cut + made(2)))
    assert [r["kind"] for r in rows] == ["gap", "record"]
    from evidentia.llm import scratch

    path = scratch.path(spark, "archives")
    local = path.removeprefix("file://")
    import pathlib

    pathlib.Path(local).mkdir(parents=True)
    pathlib.Path(local, "a b%20.warc.gz").write_bytes(data)
    monkeypatch.undo()
    got = [sorted((r.page_id, r.payload_bytes) for r in warc.read(spark, path).where("kind = 'record'").collect())]
    monkeypatch.setattr(warc, "streams", lambda path: False)
    got.append(sorted((r.page_id, r.payload_bytes) for r in warc.read(spark, path).where("kind = 'record'").collect()))
    assert got[0] == got[1] and [i for i, _ in got[0]] == ids


def test_hot_routes_are_cut_again(spark, monkeypatch):
    from tests.llm import brute

    from evidentia.llm import substrings

    monkeypatch.setattr(substrings, "SHARD", 300)
    monkeypatch.setattr(substrings, "ROUTE", 200)
    said = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(i, f"{said(f'l{i}x', 30)} {said('p', 60)} {said(f'r{i}x', 30)}") for i in range(60)]
    rows += [(100 + i, f"{said(f'm{i}x', 12)} {said('p', 8)} {said(f'n{i}x', 12)}") for i in range(60)]  # the n-gram alone is shared
    rows += [(300 + i, f"{said(f'v{i % 30}y', 20)} {said('p', 8)} {said(f'w{i % 30}y', 20)} z{i}") for i in range(60)]  # many passages with one n-gram
    rows += [(200, "q " * 300), (201, f"{said('l7x', 30)} {said('p', 20)}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (12, 35):
        got = sorted((r.doc_id, r.text, r.n_words, r.n_removed) for r in substrings.without_repeats(frame, least).collect())
        assert got == sorted(brute.without_repeats(rows, least))
