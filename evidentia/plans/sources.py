"""Source and sink queries (inventory S). Files are written from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import evidence as E
from ..sources import markup as M
from ..sources import tables as S
from ..sources import workspace
from ..operators.spread import spread
from .registry import Tables, query


@query("S01_jsonl_scan", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def jsonl_scan(t: Tables):
    path = workspace.new(t.spark, "jsonl")
    S.write_json_lines(t.documents, path)
    return S.json_lines(t.spark, path, "doc_id long, text string, lang string").select("doc_id", "lang", F.md5("text").alias("digest"))


@query("S02_jsonl_strict", "SELECT o_orderkey, o_totalprice FROM orders")
def jsonl_strict(t: Tables):
    path = workspace.new(t.spark, "jsonl")
    S.write_json_lines(t.orders.select("o_orderkey", "o_totalprice"), path)
    return S.json_lines_strict(t.spark, path, "o_orderkey long, o_totalprice double")


@query("S03_jsonl_sink", "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer")
def jsonl_sink(t: Tables):
    path = workspace.new(t.spark, "jsonl")
    S.write_json_lines(t.customer.select("c_custkey"), path)
    return S.json_lines(t.spark, path, "c_custkey long").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))


@query("S04_csv_cells", "SELECT chr((64 + col)::INT) AS letter, count(*) AS n, count(DISTINCT v) AS kinds FROM (SELECT 1 AS col, n_nationkey::VARCHAR AS v FROM nation UNION ALL SELECT 2, n_name FROM nation UNION ALL SELECT 3, n_regionkey::VARCHAR FROM nation) GROUP BY col")
def csv_cells(t: Tables):
    path = workspace.new(t.spark, "csv")
    t.nation.write.option("sep", ";").csv(path)
    cells = S.csv_cells(t.spark, path + "/*.csv")
    return cells.groupBy(F.regexp_extract("address", "^([A-Z]+)", 1).alias("letter")).agg(F.count("*").alias("n"), F.count_distinct("value").alias("kinds"))


@query("S07_text_spans", "SELECT doc_id AS id, sum((trim(p) <> '')::INT)::BIGINT AS paragraphs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY doc_id HAVING sum((trim(p) <> '')::INT) > 0")
def text_spans(t: Tables):
    return S.text_spans(t.documents).groupBy("id").agg(F.count_distinct("paragraph").alias("paragraphs"))


@query("S08_html_scan")
def html_scan(t: Tables):
    return M.html_scan(t.pages)


_MAIN = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<noscript\b.*?</noscript>|<svg\b.*?</svg>|<!--.*?-->', ' ', 'g'), '(?i)</t[dh]>\s*<t[dh][^>]*>', ' | ', 'g'), '(?i)</?(?:p|div|li|h[1-6]|tr|section|article|title|br|table|ul|head|body)\b[^>]*>', chr(10), 'g')"
_ENTITIES = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query("S09_main_text", "SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(" + _ENTITIES.format(f"regexp_replace({_MAIN}, '<[^>]+>', '', 'g')") + r", chr(10)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> ''), chr(10))) AS digest FROM pages")
def main_text(t: Tables):
    return t.pages.select("page_id", F.md5(M.main_text(F.col("html"))).alias("digest"))


@query("S10_excerpts", "SELECT page_id, md5(regexp_replace(regexp_replace(" + _ENTITIES.format("regexp_replace(regexp_replace(regexp_replace(html, '(?i)</(?:td|th)>', ' | ', 'g'), '(?i)</(?:tr|p|div)>', chr(10), 'g'), '<[^>]+>', ' ', 'g')") + r", '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM pages")
def excerpts(t: Tables):
    return t.pages.select("page_id", F.md5(T.excerpt(F.col("html"))).alias("digest"))


@query("S11_xml_scan", "SELECT l_orderkey AS id, count(*) AS n FROM (SELECT l_orderkey, unnest(['@k', 'part', 'flag']) AS c FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) GROUP BY l_orderkey")
def xml_scan(t: Tables):
    row = F.format_string("<row k=\"%s\"><part>%s</part><flag>%s</flag></row>", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_returnflag"))
    xml = spread(t.lineitem, t.lineitem, "l_orderkey", each=100_000).groupBy("l_orderkey").agg(F.concat(F.lit("<t>"), F.array_join(F.collect_list(row), ""), F.lit("</t>")).alias("xml"))
    return M.xml_scan(xml, "l_orderkey", "xml").groupBy("id").agg(F.count("*").alias("n"))


@query("S12_submissions", "SELECT o_orderkey AS id, 0 AS part, o_orderstatus AS type, 'f' || o_custkey || '.txt' AS filename, o_orderpriority AS body FROM orders")
def submissions(t: Tables):
    text = F.format_string("head\n<DOCUMENT>\n<TYPE>%s\n<FILENAME>f%s.txt\n<TEXT>%s</TEXT>\n</DOCUMENT>\n", F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_orderpriority"))
    return M.submission_parts(t.orders.select("o_orderkey", text.alias("x")), "o_orderkey", "x")


@query("S16_glyphs", "SELECT p_partkey, p_brand AS decoded FROM part")
def glyphs(t: Tables):
    marked = F.regexp_replace(F.hex(F.encode("p_brand", "utf-8")), "(..)", "/G$1")
    return t.part.select("p_partkey", S.glyphs(marked).alias("decoded"))


@query("S20_manifest", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active_heading FROM events")
def manifest(t: Tables):
    items = t.events.select("event_id", F.col("user_id").alias("doc"), F.lit(1).alias("page"), F.col("event_id").alias("position"), F.when(F.col("event_type") == "click", "title").otherwise("text").alias("kind"), F.col("event_id").cast("string").alias("text"))
    return S.manifest_text(items).select("event_id", "active_heading")


@query("S21_case_records", "SELECT left(sha256(c_mktsegment), 24) AS id, c_mktsegment AS project, count(*) AS pages, string_agg(DISTINCT c_nationkey::VARCHAR, '|' ORDER BY c_nationkey::VARCHAR) AS city FROM customer GROUP BY c_mktsegment")
def case_records(t: Tables):
    lines = t.customer.select(F.col("c_custkey").alias("doc"), F.lit(1).alias("page"), F.explode(F.array(F.concat(F.lit("project: "), "c_mktsegment"), F.concat(F.lit(" city："), F.col("c_nationkey").cast("string")), F.lit("noise"))).alias("line"))
    return S.case_records(lines, ["project", "city"])


@query("S23_catalogue_sink", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def catalogue_sink(t: Tables):
    path = workspace.new(t.spark, "catalogue")
    t.part.write.partitionBy("p_size").parquet(path)
    return t.spark.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("S24_vector_sink", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def vector_sink(t: Tables):
    path = workspace.new(t.spark, "vectors")
    t.embeddings.withColumn("model", F.lit("v1")).write.partitionBy("model").parquet(path)
    rows = t.spark.read.parquet(path).where("model = 'v1'")
    return rows.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("S25_vector_search", "SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.label = 1) WHERE rank <= 5")
def vector_search(t: Tables):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    allowed = t.embeddings.where("label = 1").select(F.col("vec_id").alias("id"))
    return S.vector_search(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, allowed, 5).select("query_id", "id", "rank")


@query("S28_snapshots", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS payload, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS digest FROM nation""")
def snapshots(t: Tables):
    return S.snapshots(t.nation, "n_nationkey")


@query("S29_identity_index", "SELECT label, round(list_sum(list_transform(list(s), lambda x: x)), 4) AS total FROM (SELECT label, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS s FROM embeddings) GROUP BY label".replace("list_sum(list_transform(list(s), lambda x: x))", "sum(s)"))
def identity_index(t: Tables):
    total = F.aggregate(V.normalised(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.groupBy("label").agg(F.round(F.sum(total), 4).alias("total"))


@query("S30_annotation_merge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS note FROM customer")
def annotation_merge(t: Tables):
    first = t.customer.select("c_custkey", F.lit("first").alias("note"))
    second = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("second").alias("note"))
    return S.merged_annotations([first, second], "c_custkey")


@query("S31_ingestion_graph", r"""WITH d AS (SELECT doc_id, 'doc-' || left(sha256(text), 16) AS document_id, CASE WHEN contains(source, 'src1') THEN 'catalogue' WHEN contains(source, 'src2') THEN 'project' ELSE 'unclassified' END AS domain, len(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x) <> '')) AS records, concat_ws(',', CASE WHEN contains(lower(text), 'token') OR contains(lower(text), 'password') THEN 'access' END, CASE WHEN contains(lower(text), 'rights') THEN 'legal' END) AS labels, trim(text) <> '' AS ok FROM documents)
 SELECT document_id, min(doc_id) AS first, domain, records, labels, CASE WHEN NOT ok THEN 'empty' WHEN domain = 'unclassified' THEN 'needs_review' ELSE 'packaged' END AS state FROM d GROUP BY document_id, domain, records, labels, ok""")
def ingestion_graph(t: Tables):
    from ..operators.corpus import ingested

    out = ingested(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), "text"), [("catalogue", ["src1"]), ("project", ["src2"])], {"access": ["token", "password"], "legal": ["rights"]})
    return out.withColumn("labels", F.array_join("labels", ","))
