"""Near-duplicate vectors by tile products in int8 with rigorous error bounds.

A unit vector x is held as s * q with int8 q and the norm e of what is lost. For
two of them |x.y - s_x s_y q_x.q_y| <= e_x + e_y + 3 e_x e_y, so a product tells
which pairs are surely above the threshold, surely below, or possibly above. What
is lost is held in int8 once more; it decides nearly all pairs that the first
product leaves open. Only what is still open then is computed again in double
precision, from the vectors themselves, which never travel with the tiles.

Before a whole product a part of it prunes: with the largest few coordinates P,
x.y <= Px.Py + |x - Px| |y - Py|, so rows and columns in which no pair can reach
the threshold by that bound are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words
from .components import components

#: Vectors of a tile (about), rows of a product at once, and the part of the coordinates that prunes (one in LEAD).
TILE, ROWS, LEAD = 2048, 512, 2
#: Slack for rounding in single precision, far above it.
SLACK = 4e-6


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two (exact, against overflow), their norms, and unit vectors."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v, norm, v / norm[:, None]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, e) of vectors: x is s * q but for a rest with norm e at most."""
    s = np.maximum(np.abs(x).max(axis=1, initial=0) / 127, 1e-300)
    q = np.rint(x / s[:, None]).astype(np.int8)
    lost = x - q * s[:, None]
    return q, s, np.sqrt(np.einsum("ij,ij->i", lost, lost)) * (1 + 1e-9) + 1e-12


class Tile:
    """Quantised unit vectors: node, weight w, id, q and s and e, and the same of the rest (q2, s2, e2)."""

    def __init__(self, node, w, id, q, s, e, q2, s2, e2):
        self.node, self.w, self.id, self.q, self.s, self.e, self.q2, self.s2, self.e2 = node, w, id, q, s, e, q2, s2, e2

    @classmethod
    def of(cls, node, w, id, x: np.ndarray) -> Tile:
        q, s, e = quantised(x)
        return cls(node, w, id, q, s, e, *quantised(x - q * s[:, None]))

    def rows(self, pick) -> Tile:
        return Tile(*(getattr(self, k)[pick] for k in ("node", "w", "id", "q", "s", "e", "q2", "s2", "e2")))

    def fine(self, pick) -> np.ndarray:
        """Both levels together, in double precision."""
        return self.q[pick] * self.s[pick, None] + self.q2[pick] * self.s2[pick, None]


def _off(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, None] + b[None, :] + 3 * a[:, None] * b[None, :] + SLACK).astype(np.float32)


def _possible(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b with a pair that can reach the threshold by the coordinates that are largest in both."""
    d = a.q.shape[1]
    if d < 2 * LEAD:
        return np.arange(len(a.s)), np.arange(len(b.s))
    both = (a.q.astype(np.float32) ** 2).mean(axis=0) + (b.q.astype(np.float32) ** 2).mean(axis=0)
    order = np.argsort(-both, kind="stable")
    lead, rest = order[: d // LEAD], order[d // LEAD :]
    far = lambda t: (t.s * np.sqrt((t.q[:, rest].astype(np.float64) ** 2).sum(axis=1)) + t.e).astype(np.float32)
    near = (a.q[:, lead].astype(np.float32) @ b.q[:, lead].astype(np.float32).T) * a.s.astype(np.float32)[:, None] * b.s.astype(np.float32)[None, :]
    open_ = near + far(a)[:, None] * far(b)[None, :] + _off(a.e, b.e) >= threshold
    if a.node is not None:
        open_ &= a.node[:, None] != b.node[None, :]
    return np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))


def compared(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(linked, i, j): which vectors of a surely are at the threshold or above with which of b, and the pairs left open."""
    linked = np.zeros((len(a.s), len(b.s)), bool)
    rows, cols = _possible(a, b, threshold)
    if not len(rows):
        return linked, rows, cols
    x, y = a.rows(rows), b.rows(cols)
    kind = np.float32 if a.q.shape[1] <= 1000 else np.float64  # whole sums of products stay exact
    near = (x.q.astype(kind) @ y.q.astype(kind).T).astype(np.float32) * x.s.astype(np.float32)[:, None] * y.s.astype(np.float32)[None, :]
    off = _off(x.e, y.e)
    sure = near - off >= threshold
    i, j = np.nonzero((near + off >= threshold) & ~sure)
    keep = []
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        value = np.einsum("ij,ij->i", x.fine(p), y.fine(q))
        off2 = x.e2[p] + y.e2[q] + 3 * x.e2[p] * y.e2[q] + 1e-12
        sure[p, q] = value - off2 >= threshold
        keep.append(np.flatnonzero((value + off2 >= threshold) & ~sure[p, q]) + k)
    keep = np.concatenate(keep) if keep else np.empty(0, np.int64)
    linked[np.ix_(rows, cols)] = sure
    return linked, rows[i[keep]], cols[j[keep]]


def _smallest(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node that each row and column reaches within the links of one product."""
    a, b = a.copy(), b.copy()
    top = np.iinfo(np.int64).max
    while True:
        down = np.minimum(b, np.where(mask, a[:, None], top).min(axis=0, initial=top))
        across = np.minimum(a, np.where(mask, down[None, :], top).min(axis=1, initial=top))
        if np.array_equal(down, b) and np.array_equal(across, a):
            return a, b
        a, b = across, down


def _tile(col: pa.Array, i: int) -> Tile:
    part = col.slice(i, 1).flatten()
    n = len(part)
    plain = [part.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4, 5, 7, 8)]
    q, q2 = (np.frombuffer(b"".join(part.field(k).to_pylist()), np.int8).reshape(n, -1) for k in (3, 6))
    return Tile(plain[0], plain[1], plain[2], q, plain[3], plain[4], q2, plain[5], plain[6])


def _products(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, n, low, other): of the vectors of two tiles that link, the links with weights and the smallest node reached; with
    ``other`` a pair that is left open."""
    names, types = ["node", "n", "low", "other"], [pa.int64()] * 4
    for batch in batches:
        for i in range(batch.num_rows):
            own = batch.column(2)[i].as_py()
            a = _tile(batch.column(0), i)
            b = a if own else _tile(batch.column(1), i)
            mask, left = np.zeros((len(a.s), len(b.s)), bool), []
            for k in range(0, len(a.s), ROWS):
                part, p, q = compared(a.rows(slice(k, k + ROWS)), b, threshold)
                mask[k : k + ROWS] = part
                left.append((p + k, q))
            p, q = (np.concatenate(x) for x in zip(*left, strict=True))
            if own:
                np.fill_diagonal(mask, False)
                p, q = p[p < q], q[p < q]
            if len(p):
                none = pa.nulls(len(p), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a.node[p]), none, none, pa.array(b.node[q])], names=names)
            row, col = mask.any(axis=1), mask.any(axis=0)
            mask = mask[row][:, col]
            low_a, low_b = _smallest(mask, a.node[row], b.node[col])
            out = [(a.node[row], mask @ b.w[col], np.minimum(low_a, low_b) if own else low_a)]
            if not own:
                out.append((b.node[col], a.w[row] @ mask, low_b))
            for nodes, n, low in out:
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n.astype(np.int64)), pa.array(low), pa.nulls(len(nodes), pa.int64())], schema=pa.schema(list(zip(names, types, strict=True))))


def _exactly(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of rows (node, other, wa, wb, x, y) those whose cosine in double precision reaches the threshold, as links both ways."""
    for batch in batches:
        flat = [batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if len(set(np.diff(batch.column(k).offsets.to_numpy()))) == 1 else None for k in (4, 5)] if batch.num_rows else [None, None]
        if flat[0] is not None and flat[1] is not None:
            (va, na, _), (vb, nb, _) = unit(flat[0]), unit(flat[1])
            good = np.einsum("ij,ij->i", va, vb) / (na * nb) >= threshold
        else:  # of several dimensions, or none
            pairs = [[unit(np.array([batch.column(k)[i].as_py()]))[:2] for k in (4, 5)] for i in range(batch.num_rows)]
            good = np.array([float(np.einsum("ij,ij->i", x, y)[0] / (n[0] * m[0])) >= threshold for (x, n), (y, m) in pairs], bool)
        batch = batch.filter(pa.array(good, pa.bool_()))
        node, other, wa, wb = batch.columns[:4]
        low = pa.array(np.minimum(node.to_numpy(), other.to_numpy()))
        yield pa.RecordBatch.from_arrays([node, wb, low], names=["node", "n", "low"])
        yield pa.RecordBatch.from_arrays([other, wa, low], names=["node", "n", "low"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link where labels are equal and not null, dimensions are equal, and the
    cosine in double precision is ``threshold`` (above 0, 1 at most) or more. A
    vector that is null, empty, zero or holds null or non-finite numbers links with
    nothing, nor does a null label or vec_id. Equal vectors of a label are one node
    with a weight, so a group of copies is never its pairs; they count as links.
    n_links: other rows linked directly. A repeated vec_id is judged row by row.

    Tiles: a label's vectors are dealt by hash in tiles of about ``TILE``; every two
    tiles of a label meet once, in int8 (two bytes a number with what is lost).
    Products of tiles give per vector a count and the smallest node reached, not
    pairs. All pairs of a label are compared, as links must be whole: the work grows
    with the square of a label. Further columns are not read. No rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    nodes = rows.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    nodes = scratch.written(nodes.withColumn("d", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = nodes.groupBy("label", "d").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    placed = nodes.join(scratch.sized(sizes), ["label", "d"]).withColumn("sub", F.pmod(F.xxhash64("node"), "tiles"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(1).to_numpy()
            for k in np.unique(d).tolist():
                part = batch.filter(pa.array(d == k))
                x = unit(part.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, k))[2]
                t = Tile.of(None, None, None, x)
                raw = lambda q: pa.array([r.tobytes() for r in q], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:6], raw(t.q), pa.array(t.s), pa.array(t.e), raw(t.q2), pa.array(t.s2), pa.array(t.e2)], names=["label", "d", "sub", "node", "w", "id", "q", "s", "e", "q2", "s2", "e2"])

    label = nodes.schema["label"].dataType.simpleString()
    bare = placed.select("label", "d", "sub", "node", "w", F.col("rep").alias("id"), "v").mapInArrow(words.lean(held), f"label {label}, d int, sub long, node long, w long, id long, q binary, s double, e double, q2 binary, s2 double, e2 double")
    tiles = bare.groupBy("label", "d", "sub").agg(F.collect_list(F.struct("node", "w", "id", "q", "s", "e", "q2", "s2", "e2")).alias("held"))
    tiles = scratch.written(tiles, "tiles")
    meta = tiles.select("label", "d", F.col("sub").alias("t"))
    pairs = meta.withColumnRenamed("t", "a").join(meta.withColumnRenamed("t", "b"), ["label", "d"]).where("a <= b")
    one = pairs.join(tiles.select("label", "d", F.col("sub").alias("a"), F.col("held").alias("x")), ["label", "d", "a"])
    two = one.join(tiles.select("label", "d", F.col("sub").alias("b"), F.col("held").alias("y")), ["label", "d", "b"])
    two = two.select("x", F.when(F.col("a") != F.col("b"), F.col("y")).alias("y"), (F.col("a") == F.col("b")).alias("own"))
    found = scratch.written(two.mapInArrow(words.lean(lambda it: _products(it, threshold)), "node long, n long, low long, other long"), "links")
    scratch.forget(tiles)
    open_ = found.where("other is not null").select("node", "other")
    own = nodes.select("node", "w", "v")
    open_ = open_.join(own.select("node", F.col("w").alias("wa"), F.col("v").alias("x")), "node").join(own.select(F.col("node").alias("other"), F.col("w").alias("wb"), F.col("v").alias("y")), "other")
    exact = open_.select("node", "other", "wa", "wb", "x", "y").mapInArrow(words.lean(lambda it: _exactly(it, threshold)), "node long, n long, low long")
    links = scratch.written(found.where("other is null").select("node", "n", "low").union(exact), "links")
    scratch.forget(found)
    count = links.groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(links.select(F.col("node").alias("a"), F.col("low").alias("b")))
    per = nodes.join(count, "node", "left").join(comp, "node", "left").select("label", "v", "rep", F.coalesce("component", "node").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    per = scratch.written(per, "vectors")
    first = per.groupBy("c").agg(F.min("rep").alias("first"))
    per = per.join(first, "c").select(F.col("label").alias("l"), F.col("v").alias("u"), "n_links", "first")
    out = rows.alias("r").join(per.alias("p"), F.col("good") & (F.col("r.label") == F.col("p.l")) & (F.col("r.v") == F.col("p.u")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("good"), F.col("first")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
