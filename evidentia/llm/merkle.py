"""A Merkle manifest of a dataset: digests of rows, trees by source, one root, and the siblings that prove a row.

A tree's nodes are numbered in order, and ``FANOUT`` consecutive ones make a node of the next level. Work is
dealt out in aligned blocks of ``FANOUT ** LEVELS`` nodes: a block is one contiguous matrix of 64-byte hexadecimal
digests, reshaped by the fanout and hashed row by row, level by level. Its last digest is a node for the round
above, so a source of any size is as many blocks as it needs, in as many rounds as its logarithm. Going down
again, each block gets the siblings above it, and finds those within it by index arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks, scratch

#: Children of a node (of the contract), and levels of a block.
FANOUT, LEVELS = 16, 2
BLOCK, HEX = FANOUT**LEVELS, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*values: Column) -> Column:
    """SHA-256 over the values, each as its bytes' count, a colon and itself, or ``-`` if null: no two lists of values are alike."""
    each = (v.cast("string") for v in values)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in each)), 256)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, block), of batches that are sorted by them."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
        if not table.num_rows:
            continue
        new = [pc.not_equal(table[c].slice(1), table[c].slice(0, table.num_rows - 1)) for c in ("tree", "block")]
        cuts = [0, *(np.flatnonzero(pc.or_(*new).to_numpy()) + 1).tolist()]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, z - a)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def _depth(n: int) -> int:
    """Levels of a block of a tree with ``n`` nodes in this round."""
    depth = 0
    while n > 1 and depth < LEVELS:
        n, depth = -(-n // FANOUT), depth + 1
    return depth


def _matrix(nodes: list[str]) -> np.ndarray:
    return np.frombuffer("".join(nodes).encode("ascii"), np.uint8).reshape(-1, HEX)


def _levels(nodes: list[str], depth: int) -> list[np.ndarray]:
    """Digest matrices of a block: its nodes, then each level above them."""
    out = [_matrix(nodes)]
    for _ in range(depth):
        low = out[-1]
        full = len(low) // FANOUT
        rows = [*low[: full * FANOUT].reshape(full, FANOUT * HEX), *([low[full * FANOUT :].reshape(-1)] if len(low) % FANOUT else [])]
        out.append(_matrix([hashlib.sha256(r).hexdigest() for r in rows]))
    return out


def _siblings(levels: list[bytes], i: int) -> list[tuple[bytes, bytes]]:
    """By level, the run's digests left and right of the node that leads to node ``i``."""
    out = []
    for low in levels:
        run, own = i - i % FANOUT, i * HEX
        out.append((low[run * HEX : own], low[own + HEX : (run + FANOUT) * HEX]))
        i //= FANOUT
    return out


def _wrapped(pairs: list[tuple[bytes, bytes]]) -> str:
    return "|".join(f"{left.decode()},{right.decode()}" for left, right in pairs)


def _unwrapped(path: str) -> list[tuple[bytes, bytes]]:
    return [tuple(x.encode().split(b",")) for x in path.split("|")] if path else []


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node of each block, for the round above."""
    rows = []

    def out() -> pa.RecordBatch:
        trees, blocks, totals, nodes = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array(blocks, pa.int64()), pa.array(totals, pa.int64()), pa.array(nodes, pa.string())], names=["tree", "at", "total", "node"])

    for run in _runs(batches):
        total = run["total"][0].as_py()
        top = _levels(run["node"].to_pylist(), _depth(total))[-1]
        rows.append((run["tree"][0].as_py(), run["block"][0].as_py(), -(-total // BLOCK), top.tobytes().decode()))
        if len(rows) >= 4096:
            yield out()
            rows = []
    if rows:
        yield out()


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Siblings of each node, those within its block and those that the block's first row brings from above."""
    for path, subroot, levels, run in _opened(batches):
        paths = [_wrapped(_siblings(levels, i)) for i in range(run.num_rows)]
        paths = ["|".join(filter(None, (p, path))) for p in paths]
        yield pa.RecordBatch.from_arrays(
            [run["tree"].combine_chunks(), run["at"].combine_chunks(), pa.array(paths, pa.string()), pa.array([subroot] * run.num_rows, pa.string())], names=["tree", "block", "path", "subroot"]
        )


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[bytes], pa.Table]]:
    for run in _runs(batches):
        path, subroot, run = run["path"][0].as_py(), run["subroot"][0].as_py(), run.slice(1)
        depth = _depth(run["total"][0].as_py())
        yield path, subroot, [m.tobytes() for m in _levels(run["node"].to_pylist(), depth)[:depth]], run


def _proved(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, subroot, levels, rows in _opened(batches):
            above, proofs, folded = _unwrapped(path), [], []
            nodes = [b or a for a, b in zip(rows["node"].to_pylist(), rows["changed"].to_pylist(), strict=True)]
            for i, node in enumerate(nodes):
                proof, node = hashlib.sha256(), node.encode()
                for left, right in (*_siblings(levels, i), *above):
                    proof.update(left + right)
                    node = hashlib.sha256(left + node + right).hexdigest().encode()
                proofs.append(proof.hexdigest())
                folded.append(node.decode())
            n = rows.num_rows
            columns = [rows["doc_id"].combine_chunks(), rows["node"].combine_chunks(), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.asc_nulls_first("at"))


def _in_block() -> Column:
    return F.shiftright("at", (BLOCK - 1).bit_length()).alias("block")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Nodes of all trees (tree, at, total, node, ...), then of each round above, as long as a tree has several."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        several = _by_block(out[-1].where("total > 1").select("tree", "at", "total", "node", _in_block()))
        out.append(scratch.written(several.mapInArrow(_up, "tree string, at long, total long, node string"), "nodes"))
    return out


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """The one node left of each tree."""
    tops = [r.where("total = 1").select("tree", "node") for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


def _opened_blocks(nodes: DataFrame, above: DataFrame | None, tops: DataFrame) -> DataFrame:
    """Nodes of a round, each block led by a row with what is above it. ``tops``: of whole trees; a tree's only node is led by its own."""
    rows = nodes.withColumn("block", _in_block())
    single = nodes.where("total = 1").select("tree")
    led = tops.join(single, "tree", "left_semi").select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
    led = led if above is None else led.unionByName(above)
    return _by_block(rows.unionByName(led, allowMissingColumns=True))


def _paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame | None:
    """(tree, block, path, subroot): what stands above each block of the lowest round; None if no tree has several nodes."""
    above = None
    for nodes in reversed(rounds[1:]):
        above = scratch.written(_opened_blocks(nodes, above, tops).mapInArrow(_down, "tree string, block long, path string, subroot string"), "paths")
    return above


def manifest(docs: DataFrame, altered: Column | None = None, change: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf digests the five fields; leaves of a source ascend by doc_id (nulls first; of equal ids, by their digests), sources by their
    bytes (null first). proof_sha256 digests all siblings from leaf to root; folded_root is recomputed from the leaf and them, and
    verified where it is the root. ``altered`` and ``change``: rows whose leaf is taken again with ``change(text)`` for the folding, so
    that a changed row fails. Nulls are distinct from empty values; repeated rows are leaves of their own; a source of one row is its own
    subroot, a table of one source its own root. No rows give no rows. Further columns are not read.
    """
    text = F.col("text")
    again = F.when(altered, digest(*map(F.col, FIELDS[:-1]), change(text))) if altered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    leaves = scratch.written(docs.select("doc_id", tree.alias("tree"), digest(*map(F.col, FIELDS)).alias("node"), again.alias("changed")), "leaves")
    rounds = _rounds(scratch.written(ranks.placed(leaves, "tree", ["doc_id", "node"]), "placed"))
    sources = scratch.written(_tops(rounds).select(F.lit("").alias("all"), F.col("tree").alias("name"), "node"), "subroots")
    top = scratch.written(ranks.placed(sources, "all", ["name"]).withColumnRenamed("all", "tree"), "top")
    upper = _rounds(top)
    root = _tops(upper).first()
    root = root["node"] if root else ""
    whole = docs.sparkSession.createDataFrame([("", "", "")], "tree string, path string, subroot string")
    # each source's place in the top tree gives the siblings of its subroot
    lifted = _opened_blocks(top, _paths(upper, whole), whole).mapInArrow(_down, "tree string, block long, path string, subroot string")
    tops = scratch.written(top.join(lifted.select(F.col("block").alias("at"), "path"), "at").select(F.col("name").alias("tree"), "path", F.col("node").alias("subroot")), "tops")
    kind = docs.schema["doc_id"].dataType.simpleString()
    led = _opened_blocks(rounds[0], _paths(rounds, tops), tops)
    return led.mapInArrow(_proved(root), f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
