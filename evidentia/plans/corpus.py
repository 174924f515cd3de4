"""Corpus, catalogue and join queries (inventory P, J, A, U) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import catalog as C
from ..operators import corpus as K
from .registry import Tables, query

_SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def scoped(t: Tables):
    """Documents with an access scope: internal where the label says toxic; public without a label."""
    marks = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "internal").alias("access_scope"), "quality")
    return t.documents.join(marks, "doc_id", "left")


_SCOPED = "(SELECT d.*, CASE WHEN l.toxic = 1 THEN 'internal' END AS access_scope, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"


@query("P01_acl_filter", f"SELECT doc_id FROM {_SCOPED} WHERE coalesce(access_scope, 'public') = 'public'")
def acl_filter(t: Tables):
    return K.eligible(scoped(t), ["public"]).select("doc_id")


@query("P02_index_eligibility", f"SELECT doc_id FROM {_SCOPED} WHERE coalesce(access_scope, 'public') IN ('public', 'internal') AND coalesce(quality, 1) = 1 AND length(trim(text)) > 0 AND regexp_matches(lower(text), '[a-z0-9]')")
def index_eligibility(t: Tables):
    rows = K.eligible(scoped(t), ["public", "internal"])
    return rows.where((F.coalesce("quality", F.lit(1)) == 1) & (F.size(T.tokens(F.col("text"))) > 0)).select("doc_id")


@query("P03_visual_eligibility", "SELECT page_id, CASE WHEN contains(html, '<img') THEN contains(html, 'alt=') ELSE length(html) > 1000 END AS eligible FROM pages")
def visual_eligibility(t: Tables):
    h = F.col("html")
    return t.pages.select("page_id", F.when(F.contains(h, F.lit("<img")), F.contains(h, F.lit("alt="))).otherwise(F.length(h) > 1000).alias("eligible"))


@query("P04_boilerplate", r"SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') IN ('allrightsreserved.', 'cookies') OR contains(lower(text), 'all rights reserved') AS boilerplate, contains(text, '###') AS artefact FROM documents")
def boilerplate(t: Tables):
    c = T.compact(F.col("text"))
    return t.documents.select("doc_id", (c.isin("allrightsreserved.", "cookies") | F.contains(F.lower("text"), F.lit("all rights reserved"))).alias("boilerplate"), F.contains("text", F.lit("###")).alias("artefact"))


@query("P05_review_reasons", f"SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN access_scope = 'internal' THEN 'internal' END, CASE WHEN n_chars < 100 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS reasons FROM {_SCOPED}")
def review_reasons(t: Tables):
    r = F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("access_scope") == "internal", "internal"), F.when(F.col("n_chars") < 100, "short"))
    return scoped(t).select("doc_id", F.array_join(F.filter(r, lambda x: x.isNotNull()), ",").alias("reasons"))


_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[×*./-][a-z0-9]+)*')"


_CODED = "replace(lower(coalesce({}, '')), 'ß', 'ss')"


@query(
    "P09_web_admission",
    rf"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, trim(regexp_replace(regexp_extract(html, '<body>(?:.|\n)*'), '<[^>]+>', '', 'g')) AS body FROM pages),
 q AS (SELECT p.*, list_distinct(regexp_extract_all({_CODED.format("text")}, '[a-z0-9][a-z0-9._/-]{{1,}}')) AS terms FROM p LEFT JOIN conversations ON conv_id = page_id AND turn = 0)
 SELECT page_id, CASE WHEN trim(title) = '' AND body = '' THEN 'empty_source' WHEN regexp_matches(title, '[%*#]{{3}}') THEN 'noisy_title'
 WHEN h = 'spam-farm.example.org' OR ends_with(h, '.spam-farm.example.org') THEN 'blocked_domain' WHEN h = 'localhost' OR regexp_matches(h, '\.(local|internal|localhost)$') THEN 'non_public_url'
 WHEN NOT regexp_matches(url, '^https?://') OR h = '' THEN 'unsafe_url'
 WHEN len(terms) > 0 AND NOT list_bool_or(list_transform(terms, lambda x: contains({_CODED.format("title")}, x) OR contains(lower(title), x) OR contains(lower(body), x))) THEN 'no_query_overlap' ELSE '' END AS reason FROM q""",
)
def web_admission(t: Tables):
    """Pages as the sources of the question that opens the conversation of the same number; a page without one has no terms to miss."""
    from ..operators.web import admission

    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    body = F.trim(F.regexp_replace(F.regexp_extract("html", "(?s)<body>.*", 0), "<[^>]+>", ""))
    asked = t.conversations.where("turn = 0").select(F.col("conv_id").alias("page_id"), F.col("text").alias("question"))
    rows = t.pages.select("page_id", "url", title.alias("title"), body.alias("body")).join(asked, "page_id", "left")
    reason = admission(F.col("question"), F.col("url"), F.col("title"), F.col("body"), ["spam-farm.example.org"], [("noisy_title", "[%*#]{3}")])
    return rows.select("page_id", reason.alias("reason"))


@query("P10_fuzzy_like", "SELECT p_partkey, CASE WHEN lower(p_name) = 'red ring' THEN 0 WHEN p_name ILIKE 'red%' THEN 1 ELSE 2 END AS tier FROM part WHERE p_name ILIKE '%red%' OR p_brand ILIKE '%red%' OR p_type ILIKE '%red%' ORDER BY tier, p_partkey LIMIT 20")
def fuzzy_like(t: Tables):
    tier = F.when(F.lower("p_name") == "red ring", 0).when(F.col("p_name").ilike("red%"), 1).otherwise(2)
    some = F.col("p_name").ilike("%red%") | F.col("p_brand").ilike("%red%") | F.col("p_type").ilike("%red%")
    return t.part.where(some).select("p_partkey", tier.alias("tier")).orderBy("tier", "p_partkey").limit(20)


@query("P11_conjunctive_filter", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND n_regionkey IN (1, 2)")
def conjunctive_filter(t: Tables):
    wanted = {"c_mktsegment": ["BUILDING", "MACHINERY"], "n_regionkey": [1, 2]}
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    for field, values in wanted.items():
        rows = rows.where(F.col(field).isin(values))
    return rows.select("c_custkey")


@query("P12_all_values", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(source), 'src1')")
def all_values(t: Tables):
    has = lambda col, values: F.forall(F.array(*map(F.lit, values)), lambda v: F.contains(F.lower(col), v))
    return t.documents.where(has("text", ["the", "and"]) & has("source", ["src1"])).select("doc_id")


@query("P14_json_predicate", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 1")
def json_predicate(t: Tables):
    return t.events.where(F.get_json_object("props", "$.k").cast("int") == 1).select("event_id")


@query("P16_suspicion", "SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, d)) / len(q) END, 6)::DOUBLE AS overlap, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, d)) / len(q) END < 0.15 AS suspicious FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]{2,}')) AS q, ['the', 'and', 'that', 'with', 'for'] AS d FROM conversations)")
def suspicion(t: Tables):
    q = T.plain_terms(F.col("text"), 2, False)
    share = F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, F.array(*map(F.lit, ("the", "and", "that", "with", "for"))))) / F.size(q))
    return t.conversations.select("conv_id", "turn", F.round(share, 6).alias("overlap"), (share < 0.15).alias("suspicious"))


@query("P17_heading_only", r"SELECT doc_id, trim(text) <> '' AND length(trim(text)) <= 60 AND NOT contains(trim(text), chr(10)) AND NOT regexp_matches(trim(text), '[。！？.!?；;：:]|[0-9]+\s*(?:mm|kg|%|℃)') AND regexp_matches(trim(text), '^(?:[一二三四五六七八九十]+[、.]|[0-9]+[.、]\s*|第.+[章节])') AS heading FROM documents")
def heading_only(t: Tables):
    return t.documents.select("doc_id", T.heading_only(F.col("text")).alias("heading"))


@query("P18_time_sensitive", f"SELECT conv_id, turn, regexp_matches(text, '(?i){T.PRESENT}') AS time_sensitive FROM conversations")
def time_sensitive(t: Tables):
    return t.conversations.select("conv_id", "turn", F.col("text").rlike(f"(?i){T.PRESENT}").alias("time_sensitive"))


@query("P19_query_time_guard", "SELECT o_orderkey, strftime(o_orderdate, '%Y') <> '1995' AS rejected FROM orders")
def query_time_guard(t: Tables):
    from ..operators.web import invented_years

    question, rewrite = F.lit("prices in 1995"), F.concat(F.lit("prices "), F.date_format("o_orderdate", "yyyy"))
    return t.orders.select("o_orderkey", (F.size(invented_years(question, rewrite)) > 0).alias("rejected"))


@query("P21_metadata_only", r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\[(BLOCK|VISUAL|PROFILE) '))) = 0 AS metadata_only FROM documents")
def metadata_only(t: Tables):
    return t.documents.select("doc_id", F.forall(F.split("text", "\n"), lambda x: x.rlike(r"^\[(BLOCK|VISUAL|PROFILE) ")).alias("metadata_only"))


@query("P22_support_audit", f"SELECT doc_id, len(o)::BIGINT AS n_overlap, round(len(o) / 5.0, 4)::DOUBLE AS ratio, array_to_string(list_transform(list_sort(list_transform(o, lambda x: {{'a': -length(x), 'b': x}}))[:20], lambda x: x.b), ',') AS terms FROM (SELECT doc_id, list_intersect(['the', 'that', 'others', 'and', 'thing'], {_WORDS.format('text')}) AS o FROM documents)")
def support_audit(t: Tables):
    o = F.array_intersect(F.array(*map(F.lit, ("the", "that", "others", "and", "thing"))), T.tokens(F.col("text")))
    ranked = F.transform(F.slice(F.array_sort(F.transform("o", lambda x: F.struct((-F.length(x)).alias("a"), x.alias("b")))), 1, 20), lambda x: x["b"])
    return t.documents.select("doc_id", o.alias("o")).select("doc_id", F.size("o").cast("long").alias("n_overlap"), F.round(F.size("o") / 5.0, 4).alias("ratio"), F.array_join(ranked, ",").alias("terms"))


@query("P23_gallery_eligibility", "SELECT p_partkey FROM part WHERE p_size > 5 AND p_retailprice > 900 AND p_brand <> '' AND p_name <> '' AND NOT contains(p_type, 'PLATED') AND length(p_type) > 3")
def gallery_eligibility(t: Tables):
    c = F.col
    return t.part.where((c("p_size") > 5) & (c("p_retailprice") > 900) & (c("p_brand") != "") & (c("p_name") != "") & ~F.contains("p_type", F.lit("PLATED")) & (F.length("p_type") > 3)).select("p_partkey")


@query("P24_public_payload", "SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), ''), 'none') AS segment, round(c_acctbal / 7, 4) AS score FROM customer")
def public_payload(t: Tables):
    return t.customer.select("c_custkey", F.coalesce(F.nullif(F.trim("c_mktsegment"), F.lit("")), F.lit("none")).alias("segment"), F.round(F.col("c_acctbal") / 7, 4).alias("score"))


@query("J01_best_entry", "SELECT p_partkey, l_orderkey, l_linenumber FROM (SELECT p_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY p_partkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey) WHERE n = 1")
def best_entry(t: Tables):
    best = C.best_per(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_partkey"], F.desc("l_quantity"), F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))
    return t.part.join(best, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "l_orderkey", "l_linenumber")


@query("J02_bundle_asset", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def bundle_asset(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("J03_page_fallback", "SELECT o_orderkey, coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_partkey END), min(l_partkey)) AS visual FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def page_fallback(t: Tables):
    own = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_partkey").alias("own"))
    page = t.lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("page"))
    rows = t.orders.join(page, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("own", "page").alias("visual"))


@query("J04_page_text_links", """SELECT o_orderkey AS asset_id, l_linenumber AS chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, l_linenumber) AS rank FROM (SELECT o_orderkey, l_linenumber,
    (1 + CASE WHEN lower(o_orderstatus) = lower(l_linestatus) THEN 4 ELSE 0 END + CASE WHEN contains(lower(o_orderpriority), lower(l_returnflag)) THEN 6 ELSE 0 END + CASE WHEN l_quantity - 10 <= 80 THEN 3 ELSE 0 END)::DOUBLE AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey)) WHERE rank <= 4""")
def page_text_links(t: Tables):
    box = lambda x: F.array(x, F.lit(0.0), x + 10, F.lit(5.0))
    assets = t.orders.select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("o_orderstatus").alias("heading"), F.regexp_replace("o_orderpriority", " ", "").alias("nearby"), F.lit("").alias("caption"), box(F.lit(0.0)).alias("bbox"))
    texts = t.lineitem.select(F.col("l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_linestatus").alias("heading"), F.col("l_returnflag").alias("text"), box(F.col("l_quantity")).alias("bbox"), F.col("l_linenumber").alias("ordinal"))
    return K.linked_text(assets, texts)


@query("J05_case_visuals", "SELECT o_custkey, l_partkey, min(o_orderkey) AS first_page, max(l_quantity) AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey")
def case_visuals(t: Tables):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_custkey", "l_partkey").agg(F.min("o_orderkey").alias("first_page"), F.max("l_quantity").alias("score"))


_BARE = r"regexp_replace(lower({}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', '', 'g')"


@query("J06_fuzzy_catalogue", f"""WITH a AS (SELECT c_custkey AS id, {_BARE.format('c_name')} AS a FROM customer), b AS (SELECT s_suppkey AS match, {_BARE.format("replace(s_name, 'Supplier', 'Customer')")} AS b FROM supplier),
    e AS (SELECT id, min(match) AS match FROM a JOIN b ON a.a = b.b GROUP BY id), p AS (SELECT id, match FROM a JOIN b ON contains(a, b) OR contains(b, a) WHERE id NOT IN (SELECT id FROM e) AND length(a) >= 6 AND length(b) >= 6)
    SELECT id, match, 'equal' AS how FROM e UNION ALL SELECT id, min(match), 'contained' FROM p GROUP BY id HAVING count(*) = 1""")
def fuzzy_catalogue(t: Tables):
    names = t.supplier.select(F.col("s_suppkey").alias("match"), F.regexp_replace("s_name", "Supplier", "Customer").alias("label"))
    return C.fuzzy_matched(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), names)


@query("J07_location_lookup", "SELECT p_partkey, CASE WHEN contains(p_name, 'th') THEN 'north' WHEN contains(p_name, 'er') THEN 'east' END AS location FROM part")
def location_lookup(t: Tables):
    rules = t.spark.createDataFrame([(1, "th", "north"), (2, "er", "east")], "ordinal int, marker string, location string")
    return C.located(t.part.select("p_partkey", "p_name"), rules, "p_name").select("p_partkey", "location")


@query("J08_name_mentions", "SELECT doc_id, item_id AS name_id FROM documents, benchmark WHERE length(benchmark.text) >= 4 AND contains(documents.text, benchmark.text)")
def name_mentions(t: Tables):
    return C.mentions(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("name_id"), F.col("text").alias("name")))


@query("J09_source_identity", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN p_partkey WHEN l_linenumber = 2 THEN l_suppkey END AS document FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def source_identity(t: Tables):
    """By path, else by id, else by name if it is unique: three left joins, the first that finds one counts."""
    a = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).alias("k1"), F.when(F.col("l_linenumber") == 2, F.col("l_suppkey")).alias("k2"))
    by_path = t.part.select(F.col("p_partkey").alias("k1"), F.col("p_partkey").alias("d1"))
    by_id = t.supplier.select(F.col("s_suppkey").alias("k2"), F.col("s_suppkey").alias("d2"))
    return a.join(by_path, "k1", "left").join(by_id, "k2", "left").select("l_orderkey", "l_linenumber", F.coalesce("d1", "d2").alias("document"))


@query("J10_same_page", "SELECT DISTINCT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND (o_orderstatus = 'O' OR l_linenumber = 1)")
def same_page(t: Tables):
    rows = t.orders.join(t.lineitem, (F.col("o_orderkey") == F.col("l_orderkey")) & ((F.col("o_orderstatus") == "O") | (F.col("l_linenumber") == 1)))
    return rows.select("o_orderkey", "l_partkey").dropDuplicates()


@query("J11_edge_composition", "SELECT DISTINCT l_partkey AS product, o_custkey AS evidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def edge_composition(t: Tables):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("product"), F.col("o_custkey").alias("evidence")).distinct()


@query("J12_semi_join_gallery", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def semi_join_gallery(t: Tables):
    hit = t.lineitem.where("l_returnflag = 'R' and l_quantity > 40").select("l_partkey")
    return t.part.join(hit, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("J13_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphans(t: Tables):
    return t.documents.join(t.labels.where("doc_id is not null"), "doc_id", "left_anti").select("doc_id")


@query("J14_referential_cleanup", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def referential_cleanup(t: Tables):
    return t.labels.join(t.documents.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality", "toxic")


@query("J15_scope_closure", """WITH own AS (SELECT p_partkey FROM part WHERE p_size = 1), cases AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM own)),
    ev AS (SELECT DISTINCT l_suppkey AS e FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM own) UNION SELECT DISTINCT o_custkey + 1000000 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM cases))
    SELECT e AS evidence FROM ev WHERE NOT (e % 7 = 0)""")
def relation_scope(t: Tables):
    seeds = t.part.where("p_size = 1").select(F.col("p_partkey").alias("product"))
    pc = t.lineitem.select(F.col("l_partkey").alias("product"), F.col("l_orderkey").alias("case"))
    pe = t.lineitem.select(F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("evidence"))
    ce = t.orders.select(F.col("o_orderkey").alias("case"), (F.col("o_custkey") + 1000000).alias("evidence"))
    ids = t.supplier.select(F.col("s_suppkey").alias("evidence")).union(t.customer.select(F.col("c_custkey") + 1000000))
    evidence = ids.withColumn("access_scope", F.when(F.col("evidence") % 7 == 0, "internal"))
    return C.scope_closure(seeds, pc, pe, ce, evidence, ["public"])


@query("J16_citation_graph", """WITH declared AS (SELECT p_partkey AS doc, 'ST ' || (1000 + p_partkey // 2) AS code FROM part), cites AS (SELECT p_partkey AS doc, 'ST ' || (1000 + (p_partkey * 7 + p_size) % (SELECT count(*) FROM part)) AS code FROM part)
    SELECT DISTINCT c.doc AS citing, d.doc AS cited, replace(c.code, ' ', '') AS code FROM cites c JOIN declared d ON c.code = d.code WHERE c.doc <> d.doc AND NOT EXISTS (SELECT 1 FROM declared x WHERE x.doc = c.doc AND x.code = c.code)""")
def citation_graph(t: Tables):
    from ..operators.evidence import citations

    declared = t.part.select(F.col("p_partkey").alias("doc"), F.concat(F.lit("ST"), (1000 + F.floor(F.col("p_partkey") / 2)).cast("string")).alias("code"))
    cited = (F.col("p_partkey") * 7 + F.col("p_size")) % t.part.count()
    texts = t.part.select(F.col("p_partkey").alias("doc"), F.concat(F.lit("as in st "), (1000 + cited).cast("string"), F.lit(" said")).alias("text"))
    return citations(texts, declared)


@query("J17_quote_links", "SELECT item_id, min(doc_id) AS proof FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) WHERE length(benchmark.text) >= 4 GROUP BY item_id")
def quote_links(t: Tables):
    """Each benchmark item with the first document that quotes all of it."""
    found = C.mentions(t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("name_id"), F.col("text").alias("name")))
    return found.groupBy(F.col("name_id").alias("item_id")).agg(F.min("doc_id").alias("proof"))


@query("J20_peer_labels", "WITH p AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL) SELECT a.l_orderkey, a.l_linenumber, max(b.flag) AS peer_label FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY ALL")
def peer_labels(t: Tables):
    """What the others of a page have: from the page's two largest labels, so no self-join of pages is needed."""
    assets = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    top = assets.groupBy("l_orderkey").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("flag", "l_linenumber")))), 1, 2).alias("top"))
    rows = assets.join(top, "l_orderkey").where(F.size("top") > 1)
    other = F.when(F.col("top")[0]["l_linenumber"] == F.col("l_linenumber"), F.col("top")[1]["flag"]).otherwise(F.col("top")[0]["flag"])
    return rows.select("l_orderkey", "l_linenumber", other.alias("peer_label"))


@query("J21_label_assembly", "SELECT o_orderkey, c_mktsegment AS product, n_name AS project, count(DISTINCT l_suppkey) AS bindings, count(DISTINCT l_suppkey) > 1 AS multiple FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def label_assembly(t: Tables):
    bound = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("bindings"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(bound, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = F.coalesce("bindings", F.lit(0))
    return rows.select("o_orderkey", F.col("c_mktsegment").alias("product"), F.col("n_name").alias("project"), n.alias("bindings"), (n > 1).alias("multiple"))


@query("J24_finish_options", "SELECT p_partkey, r_regionkey, row_number() OVER (PARTITION BY p_partkey ORDER BY r_name) AS position FROM part, region")
def finish_options(t: Tables):
    """Every product with every option of a checked, small table; the order comes from the options alone."""
    options = t.region.select("r_regionkey", F.row_number().over(Window.orderBy("r_name")).alias("position"))
    return t.part.select("p_partkey").crossJoin(C.sized_broadcast(options, 1000))


@query("J25_document_sections", "SELECT n_regionkey AS document, count(*) AS n_sections, string_agg(n_name, ',' ORDER BY n_nationkey) AS sections FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA' GROUP BY n_regionkey")
def document_sections(t: Tables):
    rows = t.nation.join(t.region.where("r_name <> 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = rows.groupBy(F.col("n_regionkey").alias("document")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("s"))
    return out.select("document", F.size("s").cast("long").alias("n_sections"), F.array_join(F.transform("s", lambda x: x["n_name"]), ",").alias("sections"))


@query("J26_request_trace", "SELECT event_id, n_name FROM events JOIN nation ON CAST(json_extract(props, '$.k') AS INTEGER) = n_nationkey")
def request_trace(t: Tables):
    return t.events.join(t.nation, F.get_json_object("props", "$.k").cast("int") == F.col("n_nationkey")).select("event_id", "n_name")


@query("J27_unknown_ids", "SELECT l.doc_id FROM (SELECT doc_id FROM labels UNION SELECT 99999999) l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents)")
def unknown_ids(t: Tables):
    asked = t.labels.select("doc_id").union(t.spark.sql("SELECT 99999999L AS doc_id")).distinct()
    return asked.join(t.documents.select("doc_id"), "doc_id", "left_anti")


@query("J28_session_join", "SELECT e.event_id, s.first_ts FROM events e JOIN (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id) s ON e.user_id = s.user_id WHERE e.ts < s.first_ts + INTERVAL 1 DAY AND e.event_type <> 'logout'")
def session_join(t: Tables):
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    return t.events.join(first, "user_id").where("ts < first_ts + INTERVAL 1 DAY and event_type <> 'logout'").select("event_id", "first_ts")


@query("A03_exact_dedup", f"SELECT sha256({_SQUEEZED}) AS text_key, min(doc_id) AS first_id, count(*) AS n_members, count(DISTINCT md5(text)) AS n_variants FROM documents GROUP BY 1")
def exact_dedup(t: Tables):
    return K.exact_duplicates(t.documents)


@query("A04_compaction", f"SELECT doc_id, min(doc_id) OVER (PARTITION BY source, {_SQUEEZED}) AS canonical_id, doc_id <> min(doc_id) OVER (PARTITION BY source, {_SQUEEZED}) AS is_alias FROM documents")
def compaction(t: Tables):
    return K.compacted(t.documents, ["source"]).select("doc_id", "canonical_id", "is_alias")


_DIFFER = "min({0}) <> max({0})"


@query("A05_consolidation", f"SELECT o_custkey, CASE WHEN NOT {_DIFFER.format('o_orderstatus')} THEN min(o_orderstatus) END AS o_orderstatus, CASE WHEN NOT {_DIFFER.format('o_orderpriority')} THEN min(o_orderpriority) END AS o_orderpriority, concat_ws(';', CASE WHEN {_DIFFER.format('o_orderstatus')} THEN 'o_orderstatus' END, CASE WHEN {_DIFFER.format('o_orderpriority')} THEN 'o_orderpriority' END) AS conflicts FROM orders GROUP BY o_custkey")
def consolidation(t: Tables):
    return C.consolidated(t.orders, "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("A05_disagreement_values", "WITH x AS (SELECT o_custkey, 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT o_custkey, 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL) SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY o_custkey, field) > 1")
def disagreement_values(t: Tables):
    return C.disagreeing(t.orders, "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("A06_grouped_collection", "SELECT g AS c_mktsegment, c_custkey, row_number() OVER (PARTITION BY g ORDER BY c_custkey) AS position, count(*) OVER (PARTITION BY g) AS n, count(*) OVER () AS total FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '未登记' ELSE c_mktsegment END AS g FROM customer)")
def grouped_collection(t: Tables):
    rows = t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment")))
    return C.grouped_members(rows, ["c_mktsegment"], "c_custkey").join(C.grouped(rows, ["c_mktsegment"], "c_custkey"), "c_mktsegment")


@query("A07_hierarchy_rollup", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS p_type, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS p_size FROM part GROUP BY p_brand")
def hierarchy_rollup(t: Tables):
    out = C.rolled_up(t.part, "p_brand", ["p_type", "p_size"])
    return out.select("p_brand", F.array_join("p_type", ",").alias("p_type"), F.array_join(F.transform("p_size", lambda x: x.cast("string")), ",").alias("p_size"))


@query("A08_directory_coverage", "SELECT lang, count(*) AS expected, count(l.doc_id) AS retained, count(*) - count(l.doc_id) AS missing, CASE WHEN count(*) = count(l.doc_id) THEN 'complete' ELSE 'partial' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def directory_coverage(t: Tables):
    rows = t.documents.join(t.labels.select(F.col("doc_id").alias("kept")), F.col("doc_id") == F.col("kept"), "left").groupBy("lang").agg(F.count("*").alias("expected"), F.count("kept").alias("retained"))
    return rows.withColumn("missing", F.col("expected") - F.col("retained")).withColumn("status", F.when(F.col("missing") == 0, "complete").otherwise("partial"))


@query("A12_publisher_groups", r"SELECT array_to_string(string_split(h, '.')[-2:], '.') AS publisher, count(*) AS n FROM (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h FROM pages) GROUP BY 1")
def publisher_groups(t: Tables):
    return t.pages.groupBy(V.publisher(F.col("url")).alias("publisher")).agg(F.count("*").alias("n"))


@query("A13_source_quality", "SELECT count(*) AS n, sum((length(html) > 3000)::INT)::BIGINT AS long_pages, sum((contains(url, 'utm_'))::INT)::BIGINT AS tracked, sum((starts_with(url, 'https'))::INT)::BIGINT AS secure FROM pages")
def source_quality(t: Tables):
    return t.pages.agg(F.count("*").alias("n"), F.count_if(F.length("html") > 3000).alias("long_pages"), F.count_if(F.contains("url", F.lit("utm_"))).alias("tracked"), F.count_if(F.col("url").startswith("https")).alias("secure"))


@query("A14_context_audit", "SELECT source, sum((lang = 'en')::INT)::BIGINT AS en, sum((lang = 'de')::INT)::BIGINT AS de, sum((lang = 'fr')::INT)::BIGINT AS fr, sum((lang = 'es')::INT)::BIGINT AS es FROM documents GROUP BY source")
def context_audit(t: Tables):
    return t.documents.groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().fillna(0)


@query("A15_catalogue_statistics", "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes FROM part GROUP BY p_brand")
def catalogue_statistics(t: Tables):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("types"), F.count_distinct("p_size").alias("sizes"))


@query("A16_build_audit", "SELECT count(*) AS documents, sum((n_chars < 100)::INT)::BIGINT AS short, count(DISTINCT source) AS sources, sum((lang = 'en')::INT)::BIGINT AS english FROM documents")
def build_audit(t: Tables):
    return t.documents.agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") < 100).alias("short"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang") == "en").alias("english"))


@query("A17_fingerprint", "SELECT count(*) AS n, sum(('0x' || substr(h, 1, 12))::BIGINT::HUGEINT)::VARCHAR AS a, sum(('0x' || substr(h, 13, 12))::BIGINT::HUGEINT)::VARCHAR AS b FROM (SELECT sha256(doc_id::VARCHAR || chr(0) || text) AS h FROM documents)".replace("chr(0)", "'\0'").replace("'\0'", "chr(0)"))
def index_fingerprint(t: Tables):
    return K.fingerprint(t.documents)


@query("W06_running_heading", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active_heading FROM events")
def running_heading(t: Tables):
    rows = t.events.withColumn("heading", F.when(F.col("event_type") == "click", F.col("event_id"))).withColumn("at", F.struct("ts", "event_id"))
    return K.running_heading(rows, ["user_id"], "at", "heading").select("event_id", "active_heading")


@query("W07_neighbour_context", "SELECT l_orderkey, l_linenumber, coalesce(string_agg(l_partkey::VARCHAR, ',') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') || '|' || coalesce(string_agg(l_partkey::VARCHAR, ',') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS context FROM lineitem")
def neighbour_context(t: Tables):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    side = lambda a, b: F.array_join(F.transform(F.collect_list("l_partkey").over(w.rowsBetween(a, b)), lambda x: x.cast("string")), ",")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.concat(side(-3, -1), F.lit("|"), side(1, 2)).alias("context"))
