"""Evidence, chunking, packing and audit queries (inventory A, D, R, W, U) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import evidence as E
from ..operators import greedy as G
from ..operators import memory as M
from ..operators.ranks import ranked_within
from ..operators.spread import spread
from .registry import Tables, query


@query("A09_coverage_matrix", "SELECT p_partkey AS requirement_id, count(DISTINCT l_orderkey) AS n, count(DISTINCT l_orderkey) > 0 AS covered FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45 GROUP BY p_partkey")
def coverage_matrix(t: Tables):
    edges = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("requirement_id"), F.col("l_orderkey").alias("evidence_id"))
    return E.coverage(t.part.select(F.col("p_partkey").alias("requirement_id")), edges)


@query("A10_disagreements", "SELECT l_partkey, l_linestatus, count(DISTINCT l_orderkey) AS n_evidence, count(DISTINCT l_tax) AS n_values, count(DISTINCT l_suppkey) AS n_sources, min(l_tax) AS lowest, max(l_tax) AS highest FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 2 AND count(DISTINCT l_tax) >= 2 AND count(DISTINCT l_suppkey) >= 2")
def disagreements(t: Tables):
    return E.disagreements(t.lineitem, ["l_partkey", "l_linestatus"], "l_tax", "l_orderkey", "l_suppkey")


@query("A11_conflict_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 7 AS q, l_partkey AS g, l_orderkey AS o FROM lineitem), lab(q, g, c) USING KEY (q, g) AS (SELECT DISTINCT q, g, g FROM e
 UNION SELECT n.q, n.g, n.c FROM (SELECT y.q, y.g, min(lab.c) AS c FROM lab JOIN e x ON lab.q = x.q AND lab.g = x.g JOIN e y ON x.q = y.q AND x.o = y.o GROUP BY ALL) n JOIN recurring.lab r ON r.q = n.q AND r.g = n.g WHERE n.c < r.c) SELECT q AS query_id, g AS group_id, c AS component FROM lab""")
def conflict_components(t: Tables):
    edges = t.lineitem.select((F.col("l_suppkey") % 7).alias("query_id"), F.col("l_partkey").alias("group_id"), F.col("l_orderkey").alias("evidence_id"))
    return G.conflict_components(edges)


@query("A18_stage_times", "SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY event_type")
def stage_times(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query("A19_token_usage", "SELECT user_id, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS tokens, sum((json_extract(props, '$.k') IS NULL)::INT)::BIGINT AS unknown FROM events GROUP BY user_id")
def token_usage(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("user_id").agg(F.sum(k).alias("tokens"), F.count_if(k.isNull()).alias("unknown"))


@query("A20_request_totals", "SELECT user_id, event_type, count(*) AS runs, round(avg(value), 6) AS mean, max(ts) AS last FROM events GROUP BY ALL")
def request_totals(t: Tables):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last"))


@query("A21_daily_quota", """WITH RECURSIVE e AS (SELECT event_id, ts::DATE AS d, event_type = 'error' AS gone, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT d, n, event_id, CASE WHEN gone THEN 0 ELSE 1 END AS used, CASE WHEN NOT gone THEN true END AS admitted FROM e WHERE n = 1
 UNION ALL SELECT e.d, e.n, e.event_id, CASE WHEN gone THEN greatest(used - 1, 0) ELSE least(used + 1, 45) END, CASE WHEN NOT gone THEN used < 45 END FROM r JOIN e ON e.d = r.d AND e.n = r.n + 1) SELECT event_id, used, admitted FROM r""")
def daily_quota(t: Tables):
    """An error releases a call of its day."""
    from ..operators.web import quota

    return quota(t.events, "ts", "event_id", 45, releases=F.col("event_type") == "error").select("event_id", "used", "admitted")


@query("A22_citation_counts", "SELECT l_partkey AS evidence, count(*) AS n FROM lineitem GROUP BY l_partkey")
def citation_counts(t: Tables):
    return t.lineitem.groupBy(F.col("l_partkey").alias("evidence")).agg(F.count("*").alias("n"))


@query("A23_repeated_entries", "SELECT doc_id AS id, 0 AS list, count(*) AS repeated, sum(c - 1)::BIGINT AS excess FROM (SELECT l_orderkey // 20 AS doc_id, l_returnflag || l_linestatus AS e, count(*) AS c FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY doc_id HAVING count(*) >= 3 AND sum(c - 1) >= 6")
def repeated_entries(t: Tables):
    """Orders as lists: a line per item, with its flag, status and tax."""
    line = F.concat(F.lit("- "), "l_returnflag", "l_linestatus", F.lit(" x"))
    texts = t.lineitem.groupBy((F.col("l_orderkey") / 20).cast("long").alias("doc_id")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return E.repeated_entries(texts)


@query("A25_status_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(t: Tables):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("A26_cycles")
def cycles(t: Tables):
    return G.cycles(t.documents)


@query("A27_multi_input_coverage", "SELECT o_custkey, count(*) AS expected, sum((o_orderstatus = 'F')::INT)::BIGINT AS cited, bool_and(o_orderstatus = 'F') AS complete FROM orders GROUP BY o_custkey")
def multi_input_coverage(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("expected"), F.count_if(F.col("o_orderstatus") == "F").alias("cited"), F.bool_and(F.col("o_orderstatus") == "F").alias("complete"))


@query("W08_flagged_headers", "SELECT doc, row, col, coalesce(array_to_string(h[-3:], ' / '), '') AS context FROM (SELECT doc, row, col, header, list(value) FILTER (WHERE header) OVER (PARTITION BY doc, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM (SELECT l_orderkey AS doc, l_linenumber AS row, l_suppkey % 3 AS col, min(l_returnflag) AS value, l_linenumber <= 2 AS header FROM lineitem GROUP BY ALL)) WHERE NOT header")
def flagged_headers(t: Tables):
    """Headers that are known to be such, without merges and sections."""
    cells = t.lineitem.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 3).alias("col")).agg(F.min("l_returnflag").alias("value"))
    return E.header_context(cells.withColumn("header", F.col("row") <= 2))


@query("W09_above_cell", "SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM events")
def above_cell(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") != "view", F.col("event_type")), True).over(w).alias("above"))


@query("W12_contiguous_ranges", "SELECT l_suppkey, min(i) AS first, max(i) AS last FROM (SELECT l_suppkey, i, i - row_number() OVER (PARTITION BY l_suppkey ORDER BY i) AS g FROM (SELECT DISTINCT l_suppkey, l_partkey AS i FROM lineitem)) GROUP BY l_suppkey, g")
def contiguous_ranges(t: Tables):
    return E.ranges(t.lineitem.select("l_suppkey", F.col("l_partkey").alias("i")).distinct(), ["l_suppkey"], "i")


@query("W14_interval_coverage", """WITH r AS (SELECT l_suppkey, l_partkey AS s, l_partkey + l_quantity::BIGINT AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
 g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM m) SELECT l_suppkey, count(*) AS pieces, sum(e - s)::BIGINT AS covered FROM (SELECT l_suppkey, p, min(s) AS s, max(e) AS e FROM g GROUP BY ALL) GROUP BY l_suppkey""")
def interval_coverage(t: Tables):
    rows = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e"))
    return E.merged_intervals(rows, ["l_suppkey"], "s", "e")


@query("W15_latest_state", "SELECT user_id, event_type, max_by(event_id, event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY ALL HAVING max_by(CAST(json_extract(props, '$.k') AS INTEGER), event_id) <> 0")
def latest_state(t: Tables):
    """The last event of each key; a last event with k = 0 retracts it."""
    from ..operators.memory import latest

    rows = t.events.withColumn("retracts", F.get_json_object("props", "$.k").cast("int") == 0)
    return latest(rows, ["user_id", "event_type"], "event_id", "retracts").select("user_id", "event_type", "event_id", "value")


@query("W16_bounded_log", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10")
def bounded_log(t: Tables):
    from ..operators.memory import bounded_log as log

    return log(t.events, ["user_id", "event_type"], "event_id", 10).select("event_id")


def _scored_orders(t: Tables):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id"))
    return rows.agg(F.min("l_suppkey").alias("doc"), F.max("l_quantity").alias("score"), F.min(F.concat("l_returnflag", "l_linestatus")).alias("text"), F.max("l_quantity").cast("int").alias("tokens"))


_SCORED = "SELECT l_orderkey AS query_id, l_linenumber * 1000000 + l_partkey AS id, min(l_suppkey) AS doc, max(l_quantity) AS score, min(l_returnflag || l_linestatus) AS text, max(l_quantity)::INT AS tokens FROM lineitem GROUP BY 1, 2"


@query("R06_near_duplicate_suppression")
def near_duplicate_suppression(t: Tables):
    return G.distinct_greedily(t.documents.select((F.col("doc_id") % 5).alias("query_id"), F.col("doc_id").alias("id"), F.col("source").alias("doc"), (-F.col("doc_id")).cast("double").alias("score"), "text"), 400)


@query("R12_budgeted_windows", f"""WITH RECURSIVE n AS (SELECT *, id % 50 AS s, id % 50 + 20 AS e, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS i FROM ({_SCORED})), f AS (SELECT DISTINCT query_id, 0::BIGINT AS i, 0::BIGINT AS id, 0 AS tokens, 0 AS used, []::STRUCT(doc BIGINT, s BIGINT, e BIGINT)[] AS taken, false AS ok FROM n
 UNION ALL SELECT query_id, i, id, tokens, CASE WHEN ok THEN used + tokens ELSE used END, CASE WHEN ok THEN list_append(taken, {{'doc': doc, 's': s, 'e': e}}) ELSE taken END, ok FROM (SELECT n.query_id, n.i, n.id, n.doc, n.s, n.e, n.tokens, f.used, f.taken, len(f.taken) < 4 AND f.used + n.tokens <= 100 AND len(list_filter(f.taken, lambda o: o.doc = n.doc AND least(o.e, n.e) - greatest(o.s, n.s) >= 13)) = 0 AS ok FROM f JOIN n ON n.query_id = f.query_id AND n.i = f.i + 1))
 SELECT query_id, id, len(taken)::INT AS position, tokens FROM f WHERE ok""")
def budgeted_windows(t: Tables):
    rows = _scored_orders(t).withColumn("start", (F.col("id") % 50).cast("int")).withColumn("end", F.col("start") + 20)
    return G.pick_windows(rows.select("query_id", "id", "doc", "start", "end", "tokens", "score"), 4, 100)


@query("R13_first_fit", "WITH RECURSIVE o AS (SELECT l_orderkey AS q, l_linenumber * 1000000 + l_partkey AS id, min(l_quantity)::BIGINT AS size FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY id) AS i FROM o), f AS (SELECT q, id, i, size <= 80 AS kept, CASE WHEN size <= 80 THEN size ELSE 0 END AS used FROM n WHERE i = 1 UNION ALL SELECT n.q, n.id, n.i, f.used + n.size <= 80, CASE WHEN f.used + n.size <= 80 THEN f.used + n.size ELSE f.used END FROM f JOIN n ON n.q = f.q AND n.i = f.i + 1) SELECT q AS l_orderkey, id, kept FROM f")
def first_fit(t: Tables):
    rows = t.lineitem.groupBy("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id")).agg(F.min("l_quantity").alias("size"))
    return E.first_fit(rows, ["l_orderkey"], ["id"], "id", "size", 80).select("l_orderkey", "id", "kept")


@query("R14_group_eviction", f"""WITH r AS ({_SCORED}), k AS (SELECT query_id, text, max(score) AS score, sum(tokens) AS tokens FROM r GROUP BY ALL), o AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id) AS total, coalesce(sum(CASE WHEN text = 'AF' THEN 0 ELSE tokens END) OVER (PARTITION BY query_id ORDER BY score, text DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM k)
 SELECT query_id, id, text = 'AF' OR total - gone <= 90 AS kept FROM r JOIN (SELECT query_id, text, total, gone FROM o) USING (query_id, text)""")
def group_eviction(t: Tables):
    rows = _scored_orders(t).select("query_id", "id", F.col("text").alias("group"), "score", "tokens", (F.col("text") == "AF").alias("protected"))
    return G.evict_groups(rows, 90)


def offered_evidence(t: Tables):
    """Orders as questions with their lines as evidence: odd lines of a part's parity leave together, some of these groups are sides of a conflict."""
    id_, p, s = F.col("l_linenumber") * 1000000 + F.col("l_partkey"), F.col("part"), F.col("supplier")
    # dealt out by question once, which its rows' grouping and fitting share
    rows = t.lineitem.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("query_id"), id_.alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    rows = rows.agg(F.min("l_suppkey").alias("supplier"), F.max("l_quantity").cast("int").alias("tokens"), F.min("l_discount").alias("score"), F.min("l_returnflag").alias("source"))
    grouped = F.col("line") % 2 == 1
    asked = F.array(F.concat(F.lit("p"), (p % 4).cast("string")), F.when(s % 3 > 0, F.concat(F.lit("s"), (s % 3).cast("string"))))
    flags = [(F.col("tokens") > 5).alias("factual"), (p % 37 == 0).alias("listed"), (s % 29 == 0).alias("mandatory"), (grouped & (p % 2 == 0)).alias("conflict")]
    return rows.select("query_id", "id", F.when(grouped, F.concat(F.lit("g"), (p % 2).cast("string"))).alias("group"), "source", s.cast("string").alias("document"), "score", "tokens", (F.col("tokens") + 2).alias("final_tokens"), asked.alias("requirements"), *flags, F.when(p % 3 == 0, 4).alias("reduced_tokens"))


@query("R14_budget_fit")
def budget_fit(t: Tables):
    """Tested against a plain loop: representatives are picked greedily, which SQL can't express for sets."""
    from ..operators.budget import fit

    return fit(offered_evidence(t), 90, 98)


@query("R14_requirement_coverage")
def requirement_coverage(t: Tables):
    from ..operators.budget import fit
    from ..operators.budget import requirement_coverage as coverage

    rows = offered_evidence(t)
    return coverage(rows, fit(rows, 90, 98, carry=("requirements",)))


@query("R15_set_cover", """WITH RECURSIVE s AS (SELECT l_suppkey % 10 AS q, l_orderkey AS e, list(DISTINCT l_partkey % 40) AS rs FROM lineitem GROUP BY ALL), f AS (SELECT DISTINCT q, 0 AS position, 0::BIGINT AS e, 0 AS newly, []::BIGINT[] AS done FROM s
 UNION ALL SELECT q, position + 1, e, n, d FROM (SELECT f.q, f.position, s.e, len(list_filter(rs, lambda x: NOT list_contains(done, x)))::INT AS n, list_concat(done, rs) AS d, row_number() OVER (PARTITION BY f.q ORDER BY len(list_filter(rs, lambda x: NOT list_contains(done, x))) DESC, s.e) AS k FROM f JOIN s USING (q) WHERE position < 12) WHERE k = 1 AND n > 0)
 SELECT q AS query_id, e AS evidence_id, position, newly FROM f WHERE position > 0""")
def set_cover(t: Tables):
    return G.set_cover(t.lineitem.select((F.col("l_suppkey") % 10).alias("query_id"), F.col("l_orderkey").alias("evidence_id"), (F.col("l_partkey") % 40).alias("requirement_id")).distinct(), 12)


@query("R19_query_windows", r"""WITH RECURSIVE w AS (SELECT doc_id, s AS start, substr(text, s + 1, 600) AS body FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 480)) AS s FROM documents WHERE text IS NOT NULL)), n AS (SELECT doc_id, start, length(body) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_intersect(list_distinct(regexp_extract_all(replace(lower(body), 'ß', 'ss'), '[a-z0-9]{2,}')), ['the', 'token', 'rights', 'stupid'])) DESC, start) AS i FROM w),
 f AS (SELECT doc_id, start, i, size <= 1800 AS ok, CASE WHEN size <= 1800 THEN size ELSE 0 END AS used FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.start, n.i, f.used + n.size <= 1800, CASE WHEN f.used + n.size <= 1800 THEN f.used + n.size ELSE f.used END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1) SELECT doc_id, start FROM f WHERE ok""")
def query_windows(t: Tables):
    """600-character windows every 480, by the query's terms and then by place, within 1,800 characters, in order of the text."""
    terms = F.array(*map(F.lit, ("the", "token", "rights", "stupid")))
    rows = t.documents.select(F.col("doc_id"), F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(480))).alias("start"), "text")
    body = F.substr("text", F.col("start") + 1, F.lit(600))
    rows = rows.select("doc_id", "start", F.length(body).alias("size"), (-F.size(F.array_intersect(terms, T.plain_terms(body, 2, False)))).alias("n"))
    return E.first_fit(rows, ["doc_id"], ["n", "start"], "start", "size", 1800).where("kept").select("doc_id", "start")


@query("R25_budget_expansion", "SELECT l_orderkey AS query_id, l_linenumber * 1000000 + l_partkey AS id, sum(min(l_quantity)::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 90 AS kept FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey".replace("min(l_quantity)", "max(l_quantity)"))
def budget_expansion(t: Tables):
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").cast("long").alias("tokens"))
    rows = rows.select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id"), "tokens")
    return G.expanded(rows.withColumn("position", F.col("id")), 90).select("query_id", "id", "kept")


@query("R26_extractive_compression")
def extractive_compression(t: Tables):
    return G.compressed(t.documents, ["the", "token", "rights", "stupid"])


@query("R27_payload_trim", "SELECT o_custkey AS query_id, o_orderkey AS id, sum(length(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 60 AS kept FROM orders")
def payload_trim(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("position"), F.length("o_orderpriority").alias("size"))
    return G.trimmed_reverse(rows, 60).select("query_id", "id", "kept")


@query("R32_primary_visuals", """WITH RECURSIVE r AS (SELECT l_suppkey AS query_id, l_orderkey AS case_id, max(l_quantity) AS score, list_sort(list_distinct(list(l_partkey % 40))) AS assets FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS i FROM r), f AS (SELECT DISTINCT query_id, 0::BIGINT AS i, 0::BIGINT AS case_id, []::BIGINT[] AS used, false AS ok FROM n
 UNION ALL SELECT query_id, i, case_id, CASE WHEN ok THEN list_append(used, own) ELSE used END, ok FROM (SELECT *, own IS NOT NULL AND len(used) < 10 AS ok FROM (SELECT n.query_id, n.i, n.case_id, f.used, list_filter(n.assets, lambda a: NOT list_contains(f.used, a))[1] AS own FROM f JOIN n ON n.query_id = f.query_id AND n.i = f.i + 1)))
 SELECT query_id, case_id, used[len(used)] AS asset_id, len(used)::INT AS position FROM f WHERE ok""")
def primary_visuals(t: Tables):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("case_id")).agg(F.max("l_quantity").alias("score"), F.array_sort(F.collect_set(F.col("l_partkey") % 40)).alias("assets"))
    return G.primary_visuals(rows, 10)


@query("U04_provenance_dedup", r"SELECT md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS fingerprint, min(doc_id) AS first_id, max(n_chars) AS best, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents WHERE length(text) >= 32 GROUP BY 1")
def provenance_dedup(t: Tables):
    rows = t.documents.where(F.length("text") >= 32).groupBy(F.md5(T.squeezed(F.col("text"))).alias("fingerprint"))
    return rows.agg(F.min("doc_id").alias("first_id"), F.max("n_chars").alias("best"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


_PASSAGES = r"""WITH d AS (SELECT doc_id, source, lang, n_chars, doc_id % 10 = 0 AS required, regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^0-9a-z\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+', '', 'g') AS f FROM documents),
 k AS (SELECT *, CASE WHEN required THEN 'd' || coalesce(source, '') ELSE '' END AS file, CASE WHEN length(f) + CASE WHEN required THEN 1 + length(coalesce(source, '')) ELSE 0 END >= 32 THEN 't' || md5(f) || '/' || file ELSE 'i' || doc_id END AS key FROM d)"""


def _passages(t: Tables):
    """Documents as passages of one question; required ones merge within their source. Goals are two of five, aspects a language and a source."""
    from ..operators.provenance import merged_passages

    id_ = F.col("doc_id")
    name = lambda a, k: F.concat(F.lit(a), (id_ % k).cast("string"))
    goals = F.create_map(name("a", 2), F.col("n_chars").cast("double"), name("b", 3), -F.col("n_chars").cast("double"))
    return merged_passages(t.documents.select(F.lit(0).alias("query_id"), id_.alias("id"), id_.alias("place"), "text", F.col("source").alias("document"), (id_ % 10 == 0).alias("required"), goals.alias("goals"), F.array("lang", "source", F.lit("all")).alias("aspects")))


@query("U04_goal_scores", _PASSAGES + """, g AS (SELECT key, goal, max(score) AS score FROM (SELECT key, 'a' || doc_id % 2 AS goal, n_chars AS score FROM k UNION ALL SELECT key, 'b' || doc_id % 3, -n_chars FROM k) WHERE score IS NOT NULL GROUP BY ALL),
 a AS (SELECT key, aspect, min(doc_id * 3 + i) AS first FROM (SELECT key, doc_id, 0 AS i, lang AS aspect FROM k UNION ALL SELECT key, doc_id, 1, source FROM k UNION ALL SELECT key, doc_id, 2, 'all' FROM k) WHERE aspect IS NOT NULL GROUP BY ALL)
 SELECT min(doc_id) AS id, count(*) AS n, any_value(gs) AS goals, any_value(names) AS aspects FROM k LEFT JOIN (SELECT key, string_agg(goal || '=' || score::BIGINT, ';' ORDER BY goal) AS gs FROM g GROUP BY key) USING (key) LEFT JOIN (SELECT key, string_agg(aspect, ';' ORDER BY first) AS names FROM a GROUP BY key) USING (key) GROUP BY key""")
def goal_scores(t: Tables):
    kept, _ = _passages(t)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("goals")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))), ";")
    return kept.select("id", "n", F.nullif(shown, F.lit("")).alias("goals"), F.array_join("aspects", ";").alias("aspects"))


@query("U04_passage_members", _PASSAGES + " SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY key) AS kept_id FROM k")
def passage_members(t: Tables):
    return _passages(t)[1].select("id", "kept_id")


@query("U05_web_dedup", r"SELECT page_id, publisher, text_key, min(page_id) OVER (PARTITION BY publisher, text_key) AS first_id, page_id <> min(page_id) OVER (PARTITION BY publisher, text_key) AS duplicate FROM (SELECT page_id, array_to_string(string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.')[-2:], '.') AS publisher, md5(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS text_key FROM pages)")
def web_dedup(t: Tables):
    from ..operators.web import deduplicated

    return deduplicated(t.pages, "page_id", "url", "html")


@query("U08_canonical_urls", r"""WITH c AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#:]*)', 1)) || CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g') END ||
 coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|from|spm|source|ref|referrer)(=|$)')), '&'), ''), '') AS canonical FROM pages)
 SELECT min(page_id) AS page_id, canonical FROM c GROUP BY canonical""")
def canonical_urls(t: Tables):
    from ..operators.web import first_seen

    return first_seen(t.pages, "page_id").select("page_id", "canonical")


@query("U10_set_differences", "SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'only_documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def set_differences(t: Tables):
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    return a.intersect(b).agg(F.lit("both").alias("side"), F.count("*").alias("n")).union(a.exceptAll(b).distinct().agg(F.lit("only_documents"), F.count("*")))


@query("U11_identity_merge", "SELECT DISTINCT CASE WHEN l_suppkey % 10 = 3 THEN l_suppkey - 1 ELSE l_suppkey END AS l_suppkey, l_partkey FROM lineitem")
def identity_merge(t: Tables):
    from ..operators.catalog import rekeyed

    aliases = t.supplier.where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("alias"), (F.col("s_suppkey") - 1).alias("canonical"))
    return rekeyed(t.lineitem.select("l_suppkey", "l_partkey"), aliases, "l_suppkey")


@query("U12_id_remap", "SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 THEN c_custkey - 7 ELSE c_custkey END AS canonical FROM customer")
def id_remap(t: Tables):
    a = t.customer.where("c_custkey % 100 = 7").select(F.col("c_custkey").alias("alias"), (F.col("c_custkey") - 7).alias("target"))
    return t.customer.join(a, F.col("c_custkey") == F.col("alias"), "left").select("c_custkey", F.coalesce("target", "c_custkey").alias("canonical"))


@query("D01_text_windows")
def text_windows(t: Tables):
    return G.windows(t.documents).drop("text")


@query("D05_derived_blocks", "SELECT doc_id, s AS start, md5(substr(text, s + 1, 1600)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1600)) AS s FROM documents)")
def derived_blocks(t: Tables):
    rows = t.documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(1600))).alias("start"))
    return rows.select("doc_id", "start", F.md5(F.substr("text", F.col("start") + 1, F.lit(1600))).alias("digest"))


@query("D06_structure_profiles", "SELECT source, count(*) AS blocks, max(n_chars) AS longest, sum((contains(text, chr(10)))::INT)::BIGINT AS multi_line, sum((regexp_matches(text, '[0-9]'))::INT)::BIGINT AS with_figures FROM documents GROUP BY source")
def structure_profiles(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("blocks"), F.max("n_chars").alias("longest"), F.count_if(F.contains("text", F.lit("\n"))).alias("multi_line"), F.count_if(F.col("text").rlike("[0-9]")).alias("with_figures"))


@query("D07_unpivot", "UNPIVOT (SELECT o_orderkey, o_totalprice AS price, (o_custkey * 1.0)::DOUBLE AS customer FROM orders) ON price, customer INTO NAME metric VALUE value")
def unpivot(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    return rows.unpivot("o_orderkey", ["price", "customer"], "metric", "value")


@query("D10_metric_resolution", """WITH l AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Price' WHEN 1 THEN p_name || ' mass' WHEN 2 THEN p_name || ' width and price' ELSE p_type || ' ' || p_brand END AS label FROM part),
 c AS (SELECT lower(p_type || p_brand) AS k, min(m) AS told FROM (SELECT *, CASE WHEN p_size < 25 THEN 'area' ELSE 'length' END AS m FROM part) GROUP BY 1 HAVING min(m) = max(m))
 SELECT p_partkey, CASE WHEN label = 'Price' THEN 'cost' WHEN ends_with(label, ' mass') THEN 'weight' WHEN ends_with(label, ' width and price') THEN NULL ELSE told END AS metric FROM l LEFT JOIN c ON replace(lower(label), ' ', '') = replace(k, ' ', '')""")
def metric_resolution(t: Tables):
    """Labels of parts: a name, one name among other words, two names, or none; candidates say of a type and brand what its sizes say alike."""
    from ..operators.sheets import resolved_metrics

    kind = F.concat("p_type", F.lit(" "), "p_brand")
    k = F.col("p_size") % 4
    label = F.when(k == 0, "Price").when(k == 1, F.concat("p_name", F.lit(" mass"))).when(k == 2, F.concat("p_name", F.lit(" width and price"))).otherwise(kind)
    told = t.part.select(kind.alias("label"), F.when(F.col("p_size") < 25, "area").otherwise("length").alias("metric"))
    return resolved_metrics(t.part.select("p_partkey", label.alias("label")), "label", told).select("p_partkey", "metric")


@query("D12_prose_facts", "SELECT p_partkey AS id, 0 AS ordinal, lower(p_brand) AS entity, 'thickness' AS metric, (p_size * 10)::DOUBLE AS value, 'mm' AS unit FROM part")
def prose_facts(t: Tables):
    text = F.concat("p_brand", F.lit(" has thickness: "), F.col("p_size").cast("string"), F.lit(" cm."))
    return E.prose_facts(t.part.select(F.col("p_partkey").alias("doc_id"), text.alias("text")), r"(\S+) has (\w+): ([0-9.,]+) (cm|mm|kg)")


@query("D13_fact_triples", "SELECT p_partkey AS id, 'cost' AS metric, round(p_retailprice, 2) AS value, 'USD' AS unit FROM part")
def fact_triples(t: Tables):
    text = F.concat(F.lit("item price: "), F.format_string("%.2f", "p_retailprice"), F.lit(" usd"))
    return E.prose_facts(t.part.select(F.col("p_partkey").alias("doc_id"), text.alias("text")), r"(\S+) (\w+): ([0-9.,]+) (usd|cny)").select("id", "metric", F.round("value", 2).alias("value"), "unit")


@query("D15_hierarchy", "SELECT doc, label, kind, count(*) AS members FROM (SELECT o_custkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'page:' || year(o_orderdate) ELSE 'block:' || o_orderkey END AS label, CASE o_orderkey % 3 WHEN 0 THEN 'section' WHEN 1 THEN 'page' ELSE 'block' END AS kind FROM orders) GROUP BY ALL")
def hierarchy(t: Tables):
    heading = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))
    page = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("page:"), F.year("o_orderdate").cast("string")))
    block = F.concat(F.lit("block:"), F.col("o_orderkey").cast("string"))
    rows = t.orders.select(F.col("o_custkey").alias("doc"), F.coalesce(heading, page, block).alias("label"), F.when(heading.isNotNull(), "section").when(page.isNotNull(), "page").otherwise("block").alias("kind"))
    return rows.groupBy("doc", "label", "kind").agg(F.count("*").alias("members"))


@query("D16_company_hierarchy", "SELECT n_regionkey AS document, n_nationkey AS section, count(c_custkey) AS members FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 3) GROUP BY ALL")
def company_hierarchy(t: Tables):
    gone = t.supplier.where("s_suppkey <= 3").select(F.col("s_nationkey").alias("n_nationkey"))
    rows = t.nation.join(gone, "n_nationkey", "left_anti").join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.groupBy(F.col("n_regionkey").alias("document"), F.col("n_nationkey").alias("section")).agg(F.count("c_custkey").alias("members"))


@query("D17_directory_packets", """WITH RECURSIVE n AS (SELECT c_mktsegment AS category, c_custkey AS member, length(c_name) + 1 AS size, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM customer), f AS (SELECT category, member, i, 0 AS packet, size AS used FROM n WHERE i = 1 UNION ALL SELECT n.category, n.member, n.i, CASE WHEN f.used + n.size > 500 THEN f.packet + 1 ELSE f.packet END, CASE WHEN f.used + n.size > 500 THEN n.size ELSE f.used + n.size END FROM f JOIN n ON n.category = f.category AND n.i = f.i + 1) SELECT category, member, packet FROM f""")
def directory_packets(t: Tables):
    return G.directory_packets(t.customer.select(F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("member"), F.col("c_name").alias("text")), 500)


@query("D20_extractive_fallback", "SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS chosen FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE i IN (0, floor((n - 1) / 3.0 + 0.5), floor(2 * (n - 1) / 3.0 + 0.5), n - 1) GROUP BY source")
def extractive_fallback(t: Tables):
    rows = ranked_within(t.documents.select("doc_id", "source"), ["source"], ["doc_id"], "k", "n")
    rows = rows.where(F.array_contains(G.stride(F.col("n")), (F.col("k") - 1).cast("int")))
    return rows.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("chosen"))


@query("D27_pack_violations", "SELECT o_orderkey AS id, 'group_incomplete' AS reason FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum((o_orderkey % 5 <> 0)::INT) BETWEEN 1 AND count(*) - 1) UNION ALL SELECT o_orderkey, 'digest_differs' FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 = 0")
def pack_violations(t: Tables):
    known = spread(t.orders, t.orders, "o_orderkey", each=200_000).select(F.col("o_orderkey").alias("id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"), F.col("o_custkey").alias("grp"))
    packed = known.where("id % 5 <> 0").withColumn("digest", F.when(F.col("id") % 11 == 0, F.lit("x")).otherwise(F.col("digest")))
    return E.violations(packed, known, "id", "digest", "grp")


@query("D34_finalise", "SELECT doc_id, 'doc-' || left(sha256(text), 16) AS id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS rendered FROM documents")
def finalise(t: Tables):
    body = F.when(F.length("text") > 2000, F.concat(F.substring("text", 1, 2000), F.lit("..."))).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.concat(F.lit("doc-"), F.substring(F.sha2("text", 256), 1, 16)).alias("id"), body.alias("rendered"))


@query("S14_page_quality", r"SELECT doc_id, CASE WHEN trim(text) = '' THEN 'no_text' WHEN len(regexp_extract_all(trim(text), '[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]')) / greatest(length(trim(text)), 1) > 0.02 THEN 'garbled_text' WHEN length(trim(text)) < 40 THEN 'sparse_text' ELSE 'text_layer' END AS quality FROM documents")
def page_quality(t: Tables):
    return t.documents.select("doc_id", E.page_quality(F.col("text")).alias("quality"))


@query("S15_table_page_score", r"SELECT doc_id, (len(regexp_extract_all(text, '[0-9]+')) >= 5)::INT + contains(text, '|')::INT + (len(regexp_extract_all(text, '\n')) >= 3)::INT AS score FROM documents")
def table_page_score(t: Tables):
    x = F.col("text")
    return t.documents.select("doc_id", ((T.counted(x, "[0-9]+") >= 5).cast("int") + F.contains(x, F.lit("|")).cast("int") + (T.counted(x, "\n") >= 3).cast("int")).alias("score"))


def _last_time(t: Tables):
    return t.events.agg(F.max("ts"))


@query("T01_cache_expiry", "SELECT key, ts, value FROM (SELECT user_id || ':' || event_type AS key, max(ts) AS ts, max_by(value, {'a': ts, 'b': event_id}) AS value FROM events GROUP BY 1) WHERE ts + INTERVAL 6 HOUR > (SELECT max(ts) FROM events)")
def cache_expiry(t: Tables):
    """What a cache by user and type of event holds when the last event has come."""
    rows = t.events.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.col("event_id").alias("id"), "value")
    return M.live_entries(rows, "6 HOURS", _last_time(t))


@query("T02_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention(t: Tables):
    return M.retained(t.events, "7 DAYS", _last_time(t)).select("event_id")


@query("T03_task_state", "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role FROM conversations GROUP BY conv_id")
def task_state(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("T04_daily_counts", "SELECT date_trunc('day', ts) AS day, count(*) AS n, least(count(*), 50) AS admitted FROM events GROUP BY 1")
def daily_counts(t: Tables):
    rows = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n", F.least(F.col("n"), F.lit(50)).alias("admitted"))


@query("T05_sessions", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS starts FROM events)) GROUP BY user_id, s""")
def sessions(t: Tables):
    rows = t.events.withColumn("at", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("T07_sliding_admission", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS s FROM events) GROUP BY s")
def sliding_admission(t: Tables):
    rows = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("T08_interrupted_runs", "SELECT run, ts, CASE WHEN ends THEN 'finished' WHEN ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) THEN 'interrupted' ELSE 'running' END AS state FROM (SELECT user_id AS run, max(ts) AS ts, max_by(event_type = 'purchase', {'a': ts, 'b': event_id}) AS ends FROM events GROUP BY 1)")
def interrupted_runs(t: Tables):
    """A user's run ends with a purchase."""
    rows = t.events.select(F.col("user_id").alias("run"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("ends"))
    return M.run_states(rows, "6 HOURS", _last_time(t))


