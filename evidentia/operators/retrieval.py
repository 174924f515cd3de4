"""Hybrid retrieval over batches of queries: BM25, exact cosine, fusion, pools, thresholds, selection.

Every frame is keyed by ``query_id``; ties go by id, so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..sources import workspace
from .catalog import sized_broadcast
from .containment import contained
from .ranks import ranked_within

#: Parameters of the model (fixed values): saturation, length weight, weight of a single Han character, rank constant of fusion.
K1, B, HAN_WEIGHT, RRF = 1.5, 0.75, 0.12, 60
#: Bytes of queries' vectors that are sent to every task at once; a larger batch goes in blocks.
BATCH_BYTES = 64 << 20
#: Bytes of vectors that a task multiplies at once, and scores that it holds at once.
VECTOR_BYTES, TILE = 16 << 20, 2 << 20


def term_counts(docs: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf): the postings, one row per distinct token of a row."""
    return docs.select(F.col(id).alias("id"), F.explode(T.tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """A02. (id, dl): tokens of each row, 1 at least."""
    return docs.select(F.col(id).alias("id"), F.greatest(F.size(T.tokens(F.col(text))), F.lit(1)).alias("dl"))


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """A01. (term, df) over distinct tokens of each row; a map-side count before the shuffle."""
    return docs.select(F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(queries: DataFrame, docs: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """R01. (query_id, id, score) above 0. queries: query_id, text; docs: id, text (already filtered by access).

    Statistics come from all of ``docs``; ``candidates`` (id) only restricts what is
    scored. The documents are tokenised once: their tokens are cut down to the
    queries' terms as they are exploded (a broadcast of checked size, before any
    shuffle), and the postings are written, with one row a document for the lengths.
    Document frequencies, the mean length and the scores are read from them.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    terms = q.select("term").union(q.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    toks = docs.select("id", T.tokens(F.col("text")).alias("t")).select("id", F.greatest(F.size("t"), F.lit(1)).alias("dl"), F.concat(F.array(F.lit("")), "t").alias("t"))
    hits = toks.select("id", "dl", F.explode("t").alias("term")).join(sized_broadcast(terms), "term", "left_semi")
    tf = workspace.written(hits.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")), "postings")
    stats = tf.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("dl")) / F.sum("tf")).alias("avg"))
    tf = tf.where("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    if candidates is not None:
        tf = tf.join(candidates, "id", "left_semi")
    weight = F.when((F.length("term") == 1) & F.col("term").rlike(T.HAN), HAN_WEIGHT).otherwise(1.0)
    idf = weight * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = q.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", idf.alias("idf"), "avg")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("dl") / F.col("avg")))
    rows = tf.join(sized_broadcast(wanted), "term")
    return rows.groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")


def ranked(scores: DataFrame, *keys: str, score: str = "score", id: str = "id", most: int | None = None) -> DataFrame:
    """W01. Adds ``rank``: 1 for the highest score of a key, ties by id; rows beyond ``most`` go before the window's sort is whole."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), id)
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= most) if most else out


def cosine_top(queries: DataFrame, vectors: DataFrame, most: int = 48) -> DataFrame:
    """R02. (query_id, id, score, rank): the ``most`` vectors nearest to each query by cosine.

    queries: query_id, vector. They go to every task as one matrix, or block by block if they are over ``BATCH_BYTES``: queries are dealt
    to blocks by a hash, and a block's best are written before the next is sent. Tasks multiply batches of vectors with the
    matrix, some queries at a time, and keep each query's ``most`` best before anything is shuffled. Scores are rounded to 9 digits before ranks, so that
    the order of sums does not matter. Null vectors and those of another dimension are left out.
    """
    rows = queries.select("query_id", F.col("vector").cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    size = rows.agg(F.sum(F.size("v") * 8 + 32)).first()[0] or 0
    if size <= BATCH_BYTES:
        return ranked(_nearest(rows, vectors, most), "query_id", most=most)
    blocks = -(-2 * size // BATCH_BYTES)
    rows = workspace.written(rows.withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks))), "queries")
    out = None
    for k in range(blocks):
        best = workspace.written(_nearest(rows.where(F.col("block") == k).drop("block"), vectors, most), "nearest")
        out = best if out is None else out.union(best)
    return ranked(out, "query_id", most=most)


def _nearest(queries: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """(query_id, id, score): the best of each query (query_id, v) in each batch of vectors."""
    got = queries.collect()
    groups: dict[int, tuple[list, np.ndarray]] = {}
    for d in sorted({len(r["v"]) for r in got}):
        own = [r for r in got if len(r["v"]) == d]
        groups[d] = ([r["query_id"] for r in own], _unit(np.array([r["v"] for r in own], np.float64)))
    sent = queries.sparkSession.sparkContext.broadcast(groups)
    kinds = [(c, f.schema[c].dataType.simpleString()) for f, c in ((queries, "query_id"), (vectors, "id"))]
    batch_type = to_arrow_type(queries.schema["query_id"].dataType)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(d: int) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held.pop(d)).combine_chunks()
            rows = rows.take(pa.compute.sort_indices(rows.column(0)))
            lists = rows.column(1).combine_chunks()
            names, q = sent.value[d]
            yield from tiles(rows.column(0).combine_chunks(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d), pa.array(names, batch_type), q, most)

        for batch in batches:
            size = np.array([x if x is not None else 0 for x in pa.compute.list_value_length(batch.column(1)).to_pylist()])
            for d in np.unique(size).tolist():
                if d not in sent.value:
                    continue
                held.setdefault(d, []).append(batch.filter(pa.array(size == d)))
                if sum(len(b) for b in held[d]) * d * 8 >= VECTOR_BYTES:
                    yield from flush(d)
        for d in list(held):
            yield from flush(d)

    some = vectors.select("id", F.col("vector").cast("array<double>").alias("v"))
    return some.mapInArrow(best, ", ".join(f"{c} {k}" for c, k in kinds) + ", score double")


def tiles(ids: pa.Array, v: np.ndarray, names: pa.Array, q: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """(query_id, id, score): the best of each query (a unit vector in ``q``) among rows that stand in order of their ids. A tile of scores is
    held at once, however many queries there are. Keys are a score in billionths and, below it, the place."""
    n = len(v)
    v, place = _unit(v), np.arange(n, dtype=np.int64)
    step, k = max(1, TILE // n), min(most, n)
    for lo in range(0, len(names), step):
        score = np.rint((q[lo : lo + step] @ v.T) * 1e9)
        key = np.where(np.isnan(score), -(2**31), score).astype(np.int64) * n + (n - 1 - place)
        key = key if k == n else np.partition(key, n - k, axis=1)[:, n - k :]
        value, rest = np.divmod(key.ravel(), n)
        own = np.repeat(np.arange(lo, lo + len(key)), k)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), ids.take(pa.array(n - 1 - rest)), pa.array(np.where(value == -(2**31), np.nan, value / 1e9))], names=["query_id", "id", "score"])


def _unit(v: np.ndarray) -> np.ndarray:
    """F42 on rows."""
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]


def fused(channels: list[DataFrame]) -> DataFrame:
    """W02. (query_id, id, score, rank): the sum of 1 / (60 + rank) over channels (query_id, id, rank); ties by id, descending."""
    rows = channels[0].select("query_id", "id", "rank")
    for c in channels[1:]:
        rows = rows.unionByName(c.select("query_id", "id", "rank"))
    scores = rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 12).alias("score"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))))


def rerank_pools(rows: DataFrame) -> DataFrame:
    """W03. The pools of texts and of visuals of each query, which don't share places.

    rows: as for ``pool``, kind text or visual, and ``predicate``: whether the question asks for what something is made of or measured by.
    24 texts (32 for a predicate question) with 8 and 4 reserved places; 8 visuals with 2 and 2.
    """
    visual = F.col("kind") == "visual"
    limit = F.when(visual, 8).when(F.coalesce("predicate", F.lit(False)), 32).otherwise(24)
    return pool(rows, limit, F.when(visual, 2).otherwise(8), F.when(visual, 2).otherwise(4))


def pool(rows: DataFrame, limit: int | Column = 24, lexical: int | Column = 8, dense_only: int | Column = 4) -> DataFrame:
    """W03. The rerank pool of each query and kind, in fused order.

    rows: query_id, kind, id, rank (fused), lexical_rank, dense_rank (null: not in the
    channel). The first ``lexical`` of the lexical channel and then the first
    ``dense_only`` of those only in the dense one have places; the rest fill up.
    """
    by = lambda *o: F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(*o))
    out = rows.withColumn("_l", F.when(F.col("lexical_rank").isNotNull(), by(F.col("lexical_rank").asc_nulls_last())))
    only = F.col("lexical_rank").isNull() & F.col("dense_rank").isNotNull()
    out = out.withColumn("_d", F.when(only, by(F.when(only, F.col("dense_rank")).asc_nulls_last())))
    held = F.coalesce(F.col("_l") <= lexical, F.lit(False)) | F.coalesce(F.col("_d") <= dense_only, F.lit(False))
    out = out.withColumn("reserved", held).withColumn("_n", by(F.desc("reserved"), F.col("rank")))
    return out.where(F.col("_n") <= limit).withColumn("position", by(F.col("rank"))).drop("_l", "_d", "_n")


def blended(rows: DataFrame, weight: float = 0.85) -> DataFrame:
    """R05. ``weight`` of the reranker's score and the rest of the fused score by its query's highest."""
    top = F.max("fusion").over(Window.partitionBy("query_id"))
    return rows.withColumn("score", F.round(weight * F.col("rerank") + (1 - weight) * F.coalesce(F.try_divide(F.col("fusion"), top), F.lit(0.0)), 9))


def strong(scores: DataFrame, hybrid: bool = False) -> DataFrame:
    """P07. Scores of 6 % of the best of their query and kind or more (hybrid: 12 %), 0.2 (0.05) at least."""
    least, share = (0.05, 0.12) if hybrid else (0.2, 0.06)
    best = F.max("score").over(Window.partitionBy("query_id", "kind"))
    return scores.withColumn("_best", best).where(F.col("score") >= F.greatest(F.lit(least), share * F.col("_best"))).drop("_best")


#: What each kind of request puts first: a list of a document, a value in it and its steps; the first that holds counts. Requests of several
#: kinds are served as the first (fixed values).
PRIORITIES = {
    "overview": (("labels", "canonical_product_profile", 6), ("categories", "enterprise_product_master_profile", 6), ("categories", "enterprise_product_catalogue", 2), ("categories", "internal_product_comparison", 1)),
    "procedure": (("domains", "03_construction_method", 3), ("domains", "04_node_atlas", 1)),
    "atlas": (("domains", "04_node_atlas", 3), ("domains", "03_construction_method", 2)),
    "standard": (("domains", "01_standard_specification", 3), ("domains", "03_construction_method", 1)),
}


def domain_priority(requests: Column, domains: Column, categories: Column, labels: Column, leading: Column) -> Column:
    """R04. Steps of priority, 0 to 7, of a document for a request.

    ``requests``: array of the kinds of ``PRIORITIES`` that it is of; the others are arrays of the document, null for none. A product's
    profile has one step more for an overview if its section leads (``leading``).
    """
    own = {"domains": domains, "categories": categories, "labels": labels}
    out = F.lit(0)
    for request, steps in reversed(PRIORITIES.items()):
        points = F.lit(0)
        for field, value, n in reversed(steps):
            n = F.when(F.coalesce(leading, F.lit(False)), n + 1).otherwise(n) if n == 6 else F.lit(n)
            points = F.when(F.coalesce(F.array_contains(own[field], value), F.lit(False)), n).otherwise(points)
        out = F.when(F.coalesce(F.array_contains(requests, request), F.lit(False)), points).otherwise(out)
    return out


def with_priority(scores: DataFrame, priority: Column, hybrid: bool = False) -> DataFrame:
    """R04. Adds 100 for each step of priority (hybrid: 0.1)."""
    return scores.withColumn("score", F.col("score") + priority * (0.1 if hybrid else 100))


def diverse(rows: DataFrame, limit: int = 5, share: float = 0.35) -> DataFrame:
    """R07. The two best of a query, then up to two that bring a new source at ``share`` of the best or more, then by score.

    rows: query_id, id, source, score. Ties by id.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = rows.withColumn("_n", F.row_number().over(w)).withColumn("_best", F.max("score").over(Window.partitionBy("query_id")))
    seen = F.max(F.when(F.col("_n") <= 2, 1).otherwise(0)).over(Window.partitionBy("query_id", "source"))
    first = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "id")) == 1
    fresh = (F.col("_n") > 2) & (seen == 0) & first & (F.col("score") >= share * F.col("_best"))
    out = out.withColumn("_fresh", fresh)
    out = out.withColumn("_k", F.sum(F.col("_fresh").cast("int")).over(w))
    tier = F.when(F.col("_n") <= 2, 0).when(F.col("_fresh") & (F.col("_k") <= 2), 1).otherwise(2)
    out = out.withColumn("tier", tier).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "id")))
    return out.where(F.col("position") <= limit).drop("_n", "_best", "_fresh", "_k")


def procedure(rows: DataFrame, limit: int = 6, pages: int = 2) -> DataFrame:
    """R08. The best step of each query and the steps after it, in the same document, up to ``pages`` pages on, in document order.

    rows: query_id, id, doc, page, position, score.
    """
    anchor = ranked(rows, "query_id", most=1).select("query_id", F.col("doc").alias("_doc"), F.col("page").alias("_page"), F.col("position").alias("_pos"))
    after = rows.join(anchor, "query_id").where("doc = _doc and position >= _pos and page <= _page + " + str(pages))
    return after.withColumn("step", F.row_number().over(Window.partitionBy("query_id").orderBy("position", "id"))).where(F.col("step") <= limit).drop("_doc", "_page", "_pos")


def gallery(rows: DataFrame, keys: list[str], variant: str, digest: str, limit: int) -> DataFrame:
    """R09. By score, priority and id: equal images once, the first of each variant before any second."""
    order = [F.desc("score"), F.desc("priority"), F.col("id")]
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, digest).orderBy(*order))).where("_n = 1")
    turn = F.row_number().over(Window.partitionBy(*keys, variant).orderBy(*order))
    out = one.withColumn("_turn", F.when(turn > 1, 1).otherwise(0))
    out = out.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("_turn", *order)))
    return out.where(F.col("position") <= limit).drop("_n", "_turn")


def round_robin(rows: DataFrame, keys: list[str], group: str, order: str) -> DataFrame:
    """W10. Adds ``turn`` and ``position``: the first of each group, then the second of each, groups in order."""
    return ranked_within(ranked_within(rows, [*keys, group], [order], "turn"), keys, ["turn", group], "position")


def stride(rows: DataFrame, group: str, order: str, most: int = 12) -> DataFrame:
    """W11. Up to ``most`` rows of each group at even distances, the first among them."""
    placed = ranked_within(rows, [group], [order], "_n", "_of")
    return placed.where((F.col("_n") - 1) % F.ceil(F.col("_of") / most) == 0).drop("_n", "_of")


def top_two(scores: DataFrame, least: float = 0.82, margin: float = 0.03) -> DataFrame:
    """W17. (query_id, id, score, second, accepted): the best of each query, and whether it is good and clear of the second."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = scores.withColumn("second", F.lead("score").over(w)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out.withColumn("accepted", (F.col("score") >= least) & (F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin))


def window_scores(queries: DataFrame, windows: DataFrame) -> DataFrame:
    """R11. (query_id, window_id, score) above 0: over terms of query and window, the log of their rarity times the saturated
    number of places where the term's string occurs in the lower-cased text. queries: query_id, text; windows: window_id, text.

    A term stands within a token, or a run of Han signs, so its places are counted once in each token of the vocabulary, and a
    window's are the sum over its tokens: its text isn't searched again for each term. The counts are written, so that rarity and scores
    read the same ones. Queries may have any number of terms: they are sent to every task only if they are few.
    """
    q = queries.select("query_id", F.explode(T.session_terms(F.col("text"))).alias("term"))
    known = workspace.written(q.select("term").distinct(), "terms")
    runs = F.concat(T.found(F.lower("text"), T.SESSION_TOKEN), T.found(F.col("text"), T.HAN + "{2,}"))
    tokens = windows.where("window_id is not null and text is not null").select("window_id", F.explode(runs).alias("token"))
    tokens = workspace.written(tokens.groupBy("window_id", "token").agg(F.count("*").alias("n")), "tokens")
    held = contained(tokens.select("token").distinct(), "token", "token", known, "term")
    places = (F.length("token") - F.length(F.replace("token", F.col("term"), F.lit("")))) / F.length("term")
    # a window has the terms that are its tokens, and the pairs in its runs of Han signs
    own = (F.col("token") == F.col("term")) | ((F.length("term") == 2) & F.col("term").rlike(T.HAN))
    held = workspace.written(held.select("token", "term", places.alias("places"), own.alias("own")), "held")
    c = tokens.join(sized_broadcast(held), "token").groupBy("window_id", "term").agg(F.sum(F.col("n") * F.col("places")).alias("c"), F.max("own").alias("own"))
    c = workspace.written(c.where("own").select("window_id", "term", "c"), "counts")
    df = c.groupBy("term").agg(F.count("*").alias("df"))
    n = windows.agg(F.count("*").alias("n"))
    wanted = q.join(df, "term").crossJoin(F.broadcast(n)).select("query_id", "term", F.log(1 + (F.col("n") + 1) / (F.col("df") + 1)).alias("rarity"))
    part = F.col("rarity") * (1 + F.col("c") / (F.col("c") + 1.5))
    return c.join(sized_broadcast(wanted), "term").groupBy("query_id", "window_id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")


def requirement_candidates(scores: DataFrame, keep: int) -> DataFrame:
    """R16. The ``keep`` best candidates of each requirement by facet score, full score and scope, then id."""
    w = Window.partitionBy("requirement_id").orderBy(F.desc("facet"), F.desc("score"), F.desc("in_scope"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def pool_fallback(scoped: DataFrame, category: DataFrame, everything: DataFrame) -> DataFrame:
    """U03. (query_id, id, score, tier): the scoped pool, else the category's, else all, by query: the first with a positive hit."""
    out = None
    for tier, frame in enumerate((scoped, category, everything)):
        rows = frame.where("score > 0").withColumn("tier", F.lit(tier))
        out = rows if out is None else out.unionByName(rows.join(out.select("query_id").distinct(), "query_id", "left_anti"))
    return out
