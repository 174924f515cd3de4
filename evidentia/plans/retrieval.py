"""Retrieval and ranking queries (inventory A01-A02, R, W) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.ranks import ranked_within
from ..sources.workspace import written
from .registry import Tables, query

_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[×*./-][a-z0-9]+)*')"


@query("A01_document_frequency", f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TOK})) AS term FROM documents) GROUP BY term")
def document_frequency(t: Tables):
    return R.document_frequency(t.documents)


@query("A02_lengths", f"SELECT lang, round(avg(greatest(len({_TOK}), 1)), 6) AS average, max(greatest(len({_TOK}), 1)) AS longest FROM documents GROUP BY lang")
def lengths(t: Tables):
    rows = R.lengths(t.documents, "doc_id").join(t.documents.select(F.col("doc_id").alias("id"), "lang"), "id")
    return rows.groupBy("lang").agg(F.round(F.avg("dl"), 6).alias("average"), F.max("dl").alias("longest"))


def _queries(t: Tables):
    """Benchmark items as queries, with their whole text: the stated set of those whose id is divisible by 20."""
    return t.benchmark.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def _docs(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


_BM25 = f"""q AS (SELECT DISTINCT query_id, unnest({_TOK}) AS term FROM (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0)),
 d AS (SELECT doc_id AS id, {_TOK} AS t FROM documents), s AS (SELECT count(*) AS n, avg(greatest(len(t), 1)) AS av FROM d),
 p AS (SELECT id, greatest(len(t), 1) AS dl, unnest(t) AS term FROM d), f AS (SELECT term, id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY term),
 bm AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score FROM q JOIN g USING (term) JOIN f USING (term), s GROUP BY ALL),
 lx AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bm WHERE score > 0)"""


def lexical(t: Tables, most: int):
    scores = R.bm25(_queries(t), _docs(t)).withColumn("score", F.round("score", 6))
    return R.ranked(scores, "query_id", most=most)


@query("R01_bm25", f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM lx WHERE rank <= 10")
def bm25(t: Tables):
    """Flagship: the ten best documents of each query."""
    return lexical(t, 10)


_COS = """cq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0), cs AS (SELECT query_id, vec_id AS id, round(list_dot_product(x, embedding::DOUBLE[]) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 9) AS score FROM cq, embeddings),
 dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs)"""


def dense(t: Tables, most: int):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.cosine_top(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, most)


@query("R02_cosine_top", f"WITH {_COS} SELECT query_id, id, round(score, 6) AS score, rank FROM dn WHERE rank <= 48")
def cosine_top(t: Tables):
    return dense(t, 48).withColumn("score", F.round("score", 6))


#: Both channels of the same queries: benchmark item i goes with vector i.
_DENSE = "d2 AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.x, e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 20 = 0) q, embeddings e)) WHERE rank <= 48)"
_RRF = f"{_BM25}, {_DENSE}, l2 AS (SELECT query_id, id, rank FROM lx WHERE rank <= 48), fs AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT * FROM l2 UNION ALL SELECT * FROM d2) GROUP BY ALL), fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM fs)"


def channels(t: Tables):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    dense = R.cosine_top(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 48)
    return written(lexical(t, 48), "lexical"), written(dense, "dense")  # fusion and pools read them again


@query("W01_channel_ranks", f"WITH {_RRF} SELECT 'lexical' AS channel, query_id, id, rank FROM l2 UNION ALL SELECT 'dense', query_id, id, rank FROM d2")
def channel_ranks(t: Tables):
    a, b = channels(t)
    return a.select(F.lit("lexical").alias("channel"), "query_id", "id", "rank").unionByName(b.select(F.lit("dense").alias("channel"), "query_id", "id", "rank"))


@query("W02_rank_fusion", f"WITH {_RRF} SELECT query_id, id, round(score, 9) AS score, rank FROM fu")
def rank_fusion(t: Tables):
    return R.fused(list(channels(t))).withColumn("score", F.round("score", 9))


@query("W03_rerank_pool", f"""WITH {_RRF}, al AS (SELECT fu.query_id, CASE WHEN fu.id % 10 = 0 THEN 'visual' ELSE 'text' END AS kind, fu.id, fu.rank, l2.rank AS lr, d2.rank AS dr FROM fu LEFT JOIN l2 USING (query_id, id) LEFT JOIN d2 USING (query_id, id)),
 qs AS (SELECT item_id AS query_id, CASE WHEN regexp_matches(text || CASE WHEN length(text) % 2 = 0 THEN ' 由哪些 材料组成' ELSE ' 的质量' END, '由哪些.{{0,12}}组成') THEN 32 ELSE 24 END AS texts FROM benchmark),
 rk AS (SELECT *, CASE WHEN lr IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, kind ORDER BY lr NULLS LAST) END AS ln, CASE WHEN lr IS NULL AND dr IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, kind ORDER BY CASE WHEN lr IS NULL THEN dr END NULLS LAST) END AS dn FROM al),
 fl AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY (coalesce(ln <= CASE kind WHEN 'visual' THEN 2 ELSE 8 END, false) OR coalesce(dn <= CASE kind WHEN 'visual' THEN 2 ELSE 4 END, false)) DESC, rank) AS n FROM rk)
 SELECT query_id, kind, id, rank, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) AS position FROM fl LEFT JOIN qs USING (query_id) WHERE n <= CASE WHEN kind = 'visual' THEN 8 ELSE coalesce(texts, 24) END""")
def rerank_pool(t: Tables):
    """Ids divisible by ten stand for visuals; questions of even length ask what something is made of."""
    from ..operators.selection import asks_for_form

    a, b = channels(t)
    rows = R.fused([a, b]).join(a.select("query_id", "id", F.col("rank").alias("lexical_rank")), ["query_id", "id"], "left").join(b.select("query_id", "id", F.col("rank").alias("dense_rank")), ["query_id", "id"], "left")
    said = F.concat("text", F.when(F.length("text") % 2 == 0, " 由哪些 材料组成").otherwise(" 的质量"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), asks_for_form(said).alias("predicate"))
    rows = rows.join(asked, "query_id", "left").withColumn("kind", F.when(F.col("id") % 10 == 0, "visual").otherwise("text"))
    return R.rerank_pools(rows).select("query_id", "kind", "id", "rank", "position")


@query("R04_domain_priority", f"""WITH {_BM25} SELECT query_id, id, round(round(lx.score, 6) + 100 * CASE (query_id // 20) % 4
 WHEN 0 THEN CASE WHEN lang = 'de' OR source = 'src6' THEN 6 + (id % 2 = 0)::INT WHEN source = 'src4' THEN 2 WHEN source = 'src5' THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN source IN ('src1', 'src3') THEN 3 WHEN source = 'src2' THEN 1 ELSE 0 END
 WHEN 2 THEN CASE WHEN source IN ('src2', 'src3') THEN 3 WHEN source = 'src1' THEN 2 ELSE 0 END ELSE CASE WHEN source = 'src0' THEN 3 WHEN source IN ('src1', 'src3') THEN 1 ELSE 0 END END, 6) AS score FROM lx JOIN documents ON id = doc_id WHERE rank <= 48""")
def domain_priority(t: Tables):
    """Queries are of the four kinds of requests in turn; sources stand for domains and categories, a language for a label."""
    rows = lexical(t, 48).join(t.documents.select(F.col("doc_id").alias("id"), "source", "lang"), "id")
    of = lambda pairs: F.filter(F.array(*(F.when(F.col("source").isin(*names), value) for value, names in pairs)), lambda x: x.isNotNull())
    domains = of([("01_standard_specification", ["src0"]), ("03_construction_method", ["src1", "src3"]), ("04_node_atlas", ["src2", "src3"])])
    categories = of([("enterprise_product_catalogue", ["src4"]), ("internal_product_comparison", ["src5"]), ("enterprise_product_master_profile", ["src6"])])
    request = F.array(F.get(F.array(*map(F.lit, R.PRIORITIES)), (F.floor(F.col("query_id") / 20) % 4).cast("int")))
    p = R.domain_priority(request, domains, categories, F.array(F.when(F.col("lang") == "de", "canonical_product_profile")), F.col("id") % 2 == 0)
    return R.with_priority(rows, p).select("query_id", "id", F.round("score", 6).alias("score"))


@query("R05_score_blend", f"WITH {_RRF} SELECT query_id, id, round(0.85::DOUBLE * ((id % 100) / 100.0::DOUBLE) + 0.15::DOUBLE * (score / max(score) OVER (PARTITION BY query_id)), 9) AS score FROM fu")
def score_blend(t: Tables):
    rows = R.fused(list(channels(t))).select("query_id", "id", F.col("score").alias("fusion"), ((F.col("id") % 100) / 100.0).alias("rerank"))
    return R.blended(rows).select("query_id", "id", "score")


@query("P07_weak_matches", f"WITH {_BM25} SELECT query_id, id FROM (SELECT query_id, id, round(score, 6) AS score, max(round(score, 6)) OVER (PARTITION BY query_id, id % 2) AS best FROM bm WHERE score > 0) WHERE score >= greatest(0.2, 0.06 * best)")
def weak_matches(t: Tables):
    scores = R.bm25(_queries(t), _docs(t)).withColumn("score", F.round("score", 6)).withColumn("kind", F.col("id") % 2)
    return R.strong(scores).select("query_id", "id")


@query("W04_source_rank", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS local_rank FROM documents")
def source_rank(t: Tables):
    return ranked_within(t.documents.select("doc_id", "source"), ["source"], ["doc_id"], "local_rank").select("doc_id", "local_rank")


@query("W05_best_per_source", f"WITH {_BM25} SELECT query_id, source, id FROM (SELECT query_id, source, id, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM lx JOIN documents ON id = doc_id) WHERE n = 1")
def best_per_source(t: Tables):
    rows = R.ranked(R.bm25(_queries(t), _docs(t)).withColumn("score", F.round("score", 6)), "query_id").join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id")
    w = Window.partitionBy("query_id", "source").orderBy("rank")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "source", "id")


@query("R07_diversity", """WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_orderpriority AS source, o_totalprice AS score FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS sn FROM r),
 b AS (SELECT *, n > 2 AND max(CASE WHEN n <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, source) = 0 AND sn = 1 AND score >= 0.35 * best AS fresh FROM a), c AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY query_id ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM b),
 d AS (SELECT *, CASE WHEN n <= 2 THEN 0 WHEN fresh AND k <= 2 THEN 1 ELSE 2 END AS tier FROM c), e AS (SELECT query_id, id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, id) AS position FROM d) SELECT * FROM e WHERE position <= 5""")
def diversity(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("score"))
    return R.diverse(rows).select("query_id", "id", "tier", "position")


@query("R08_procedure", """WITH r AS (SELECT l_suppkey AS q, l_orderkey AS doc, l_linenumber AS pos, min(l_quantity) AS score FROM lineitem GROUP BY ALL), a AS (SELECT q, doc, pos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc * 10 + pos) AS n FROM r) WHERE n = 1),
 s AS (SELECT r.q AS query_id, r.doc * 10 + r.pos AS id, row_number() OVER (PARTITION BY r.q ORDER BY r.pos, r.doc * 10 + r.pos) AS step FROM r JOIN a ON r.q = a.q AND r.doc = a.doc AND r.pos >= a.pos AND r.pos <= a.pos + 2) SELECT * FROM s WHERE step <= 6""")
def procedure(t: Tables):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("position")).agg(F.min("l_quantity").alias("score"))
    rows = rows.withColumn("id", F.col("doc") * 10 + F.col("position")).withColumn("page", F.col("position"))
    return R.procedure(rows).select("query_id", "id", "step")


@query("R09_gallery", """WITH r AS (SELECT p_brand AS k, p_partkey AS id, p_type AS v, p_name AS h, p_retailprice AS score, p_size AS priority FROM part), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, h ORDER BY score DESC, priority DESC, id) AS n FROM r) WHERE n = 1),
 u AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY k, v ORDER BY score DESC, priority DESC, id) > 1 THEN 1 ELSE 0 END AS turn FROM o), p AS (SELECT k AS p_brand, id, row_number() OVER (PARTITION BY k ORDER BY turn, score DESC, priority DESC, id) AS position FROM u) SELECT * FROM p WHERE position <= 12""")
def gallery(t: Tables):
    rows = t.part.select("p_brand", F.col("p_partkey").alias("id"), "p_type", "p_name", F.col("p_retailprice").alias("score"), F.col("p_size").alias("priority"))
    return R.gallery(rows, ["p_brand"], "p_type", "p_name", 12).select("p_brand", "id", "position")


_ST = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_./%-]+'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP) + ")))"


@query("R11_window_scores", f"""WITH q AS (SELECT item_id AS query_id, unnest({_ST}) AS term FROM (SELECT item_id, text FROM benchmark WHERE item_id % 20 = 0)), w AS (SELECT doc_id AS window_id, lower(text) AS t, unnest({_ST}) AS term FROM documents),
 c AS (SELECT window_id, term, floor((length(t) - length(replace(t, term, ''))) / length(term)) AS c FROM w WHERE term IN (SELECT term FROM q)), f AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
 SELECT query_id, window_id, round(sum(ln(1 + (n + 1) / (df + 1)) * (1 + c / (c + 1.5))), 9) AS score FROM q JOIN f USING (term) JOIN c USING (term), n GROUP BY query_id, window_id""")
def window_scores(t: Tables):
    return R.window_scores(_queries(t), t.documents.select(F.col("doc_id").alias("window_id"), "text"))


@query("R16_requirement_candidates", "SELECT requirement_id, id, rank FROM (SELECT l_suppkey AS requirement_id, l_orderkey * 1000 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_returnflag = 'R' DESC, l_orderkey * 1000 + l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def requirement_candidates(t: Tables):
    rows = t.lineitem.select(F.col("l_suppkey").alias("requirement_id"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("facet"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("in_scope"))
    return R.requirement_candidates(rows, 3).select("requirement_id", "id", "rank")


@query("R17_directory_rank", "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def directory_rank(t: Tables):
    return R.ranked(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", score="c_acctbal", id="c_custkey", most=3).select("c_nationkey", "c_custkey", "rank")


@query("R18_visual_selection", "SELECT * FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY n > 1, score DESC, l_partkey) AS rank FROM (SELECT l_orderkey, l_partkey, score, row_number() OVER (PARTITION BY l_orderkey, f ORDER BY score DESC, l_partkey) AS n FROM (SELECT l_orderkey, l_partkey, min(l_returnflag) AS f, max(l_quantity + 12 * (l_linenumber = 1)::INT + 10 * (l_linestatus = 'F')::INT) AS score FROM lineitem GROUP BY ALL))) WHERE rank <= 4")
def visual_selection(t: Tables):
    s = F.col("l_quantity") + 12 * (F.col("l_linenumber") == 1).cast("int") + 10 * (F.col("l_linestatus") == "F").cast("int")
    one = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("f"), F.max(s).alias("score"))
    one = one.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey", "f").orderBy(F.desc("score"), "l_partkey")))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("n") > 1, F.desc("score"), "l_partkey"))
    return one.withColumn("rank", rank).where("rank <= 4").select("l_orderkey", "l_partkey", "rank")


@query("R21_web_rank", "SELECT l_orderkey, id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN ok THEN -score ELSE 0 END, id) AS position, ok AS by_score FROM (SELECT *, bool_and(coalesce(score BETWEEN 0 AND 1, false)) OVER (PARTITION BY l_orderkey) AS ok FROM (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS id, min(CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity / 50 END) AS score FROM lineitem GROUP BY ALL))")
def web_rank(t: Tables):
    from ..operators.web import ranked

    rows = t.lineitem.groupBy("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min(F.when(F.col("l_quantity") != 50, F.col("l_quantity") / 50)).alias("score"))
    return ranked(rows, "l_orderkey", "score", "id").select("l_orderkey", "id", "position", "by_score")


@query("R23_context_ranking", """SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS position FROM (SELECT doc_id, round(60.0 / (60 + local_rank) + least(0.9, list_sum(list_transform(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['the', 'token', 'rights']), lambda x: 0.08 + 0.04 * ln(1 + length(x)))))
 + CASE lang WHEN 'en' THEN 0.30 WHEN 'de' THEN 0.25 WHEN 'fr' THEN 0.12 ELSE 0.06 END, 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS local_rank FROM documents) WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['the', 'token', 'rights'])) > 0) QUALIFY position <= 100""")
def context_ranking(t: Tables):
    from ..operators.evidence import context_score

    terms = F.array(*map(F.lit, ("the", "token", "rights")))
    local = ranked_within(t.documents.select("doc_id", "source"), ["source"], ["doc_id"], "local_rank").select("doc_id", "local_rank")
    rows = t.documents.join(local, "doc_id").withColumn("hits", F.array_intersect(terms, F.array_distinct(T.found(F.lower("text"), "[a-z0-9]+"))))
    authority = F.when(F.col("lang") == "en", 0.30).when(F.col("lang") == "de", 0.25).when(F.col("lang") == "fr", 0.12).otherwise(0.06)
    rows = rows.where(F.size("hits") > 0).select("doc_id", context_score(F.col("local_rank"), F.col("hits"), authority).alias("score"))
    top = rows.orderBy(F.desc("score"), "doc_id").limit(100)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


@query("R28_latest_traces", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_traces(t: Tables):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts")


@query("R29_case_top", f"WITH {_BM25} SELECT query_id, lang, id FROM (SELECT query_id, lang, id, row_number() OVER (PARTITION BY query_id, lang ORDER BY rank) AS n FROM lx JOIN documents ON id = doc_id WHERE lx.score >= 1) WHERE n = 1")
def case_top(t: Tables):
    rows = R.ranked(R.bm25(_queries(t), _docs(t)).withColumn("score", F.round("score", 6)), "query_id").where("score >= 1").join(t.documents.select(F.col("doc_id").alias("id"), "lang"), "id")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "lang").orderBy("rank"))).where("n = 1").select("query_id", "lang", "id")


@query("W10_round_robin", "SELECT doc_id, turn, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS position FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents)")
def round_robin(t: Tables):
    return R.round_robin(t.documents.select("doc_id", "lang", "source"), ["lang"], "source", "doc_id").select("doc_id", "turn", "position")


@query("W11_stride_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM documents) WHERE (n - 1) % ceil(c / 12.0)::INT = 0")
def stride_sample(t: Tables):
    return R.stride(t.documents.select("doc_id", "source"), "source", "doc_id")


@query("W17_margin_test", "WITH " + _COS + " SELECT query_id, id, round(score, 6) AS score, round(second, 6) AS second, score >= 0.82 AND score - coalesce(second, 0) >= 0.03 AS accepted FROM (SELECT query_id, id, score, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, id) AS second, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM cs WHERE query_id <> id) WHERE n = 1")
def margin_test(t: Tables):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    scores = R.cosine_top(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 3).where("query_id <> id")
    return R.top_two(scores.drop("rank")).select("query_id", "id", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"), "accepted")


@query("U02_union_first", "SELECT doc_id, min(tier) AS tier FROM (SELECT doc_id, 0 AS tier FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1 FROM documents WHERE lang = 'de') GROUP BY doc_id")
def union_first(t: Tables):
    rows = t.labels.where("quality = 1").select("doc_id", F.lit(0).alias("tier")).unionByName(t.documents.where("lang = 'de'").select("doc_id", F.lit(1).alias("tier")))
    return rows.groupBy("doc_id").agg(F.min("tier").alias("tier"))


@query("U03_pool_fallback", f"WITH {_BM25}, sc AS (SELECT query_id, id, score FROM lx JOIN documents ON id = doc_id WHERE source = 'src3' AND score > 4), ct AS (SELECT query_id, id, score FROM lx JOIN documents ON id = doc_id WHERE lang = 'de' AND score > 4) SELECT query_id, id, 0 AS tier FROM sc UNION ALL SELECT query_id, id, 1 FROM ct WHERE query_id NOT IN (SELECT query_id FROM sc) UNION ALL SELECT query_id, id, 2 FROM lx WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM sc) AND query_id NOT IN (SELECT query_id FROM ct)")
def pool_fallback(t: Tables):
    rows = R.ranked(R.bm25(_queries(t), _docs(t)).withColumn("score", F.round("score", 6)), "query_id").join(t.documents.select(F.col("doc_id").alias("id"), "lang", "source"), "id").select("query_id", "id", "score", "rank", "lang", "source")
    pick = lambda c: rows.where(c).select("query_id", "id", "score")
    return R.pool_fallback(pick("source = 'src3' and score > 4"), pick("lang = 'de' and score > 4"), pick("rank <= 10")).select("query_id", "id", "tier")
