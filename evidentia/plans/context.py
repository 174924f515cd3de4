"""Queries of sessions, contexts and facts with all their terms (inventory R11, R23, D12) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators.facts import row_facts
from ..operators.spread import spread
from .registry import Tables, query
from .retrieval import _BM25, lexical

_PIECE = "substr(text, start + 1, 1600)"
_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9_./%-]+'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP) + ")))"


@query("R11_session_windows", rf"""WITH p AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, unnest(range(0, greatest(length(coalesce(text, '')), 1), 1600)) AS start FROM documents),
 w AS (SELECT doc_id // 8 AS session, doc_id AS document, doc_id * 100000 + start // 1600 AS window_id, start = 0 AS f, start + 1600 >= length(text) AS l, CASE WHEN start < 3200 AND length(text) > 6400 THEN 'document_index' ELSE 'text' END AS kind,
  CASE lang WHEN 'de' THEN '[TABLE sheet=' || source || ' state=visible] 2024-0' || doc_id % 5 || chr(10) WHEN 'en' THEN 'kind=paragraph ' WHEN 'fr' THEN '[VISUAL 1] '
  ELSE 'source=pdf; A1=''' || replace(substr(text, start + 1, 300), '''', '') || ''' B1=''' || replace(substr(text, start + 301, 300), '''', '') || ''' ' END || {_PIECE} AS t FROM p),
 q AS (SELECT conv_id AS session, conv_id * 1000 + turn AS query_id, turn = 0 AS whole, coalesce(text, '') || ' src' || turn % 20 || ' 2024-0' || turn % 5 AS text FROM conversations WHERE role = 'user'),
 qt AS (SELECT query_id, session, unnest({_TERMS.format("text")}) AS term FROM q), k AS (SELECT DISTINCT session, term FROM qt), wt AS (SELECT session, window_id, lower(t) AS t, unnest({_TERMS.format("t")}) AS term FROM w),
 c AS (SELECT session, window_id, term, floor((length(t) - length(replace(t, term, ''))) / length(term)) AS c FROM wt JOIN k USING (session, term)), df AS (SELECT session, term, count(*) AS df FROM c GROUP BY ALL), n AS (SELECT session, count(*) AS n FROM w GROUP BY ALL),
 s AS (SELECT query_id, window_id, sum(ln(1 + (n + 1) / (df + 1)) * (1 + c / (c + 1.5::DOUBLE))) AS x FROM qt JOIN c USING (session, term) JOIN df USING (session, term) JOIN n USING (session) GROUP BY ALL),
 m AS (SELECT query_id, whole, w.*, coalesce(x, 0) AS x, regexp_extract(t, '\[TABLE[^\n]*? sheet=(.*?) state=', 1) AS sheet, q.text AS asked, kind = 'document_index' AS idx, kind = 'document_index' AND window_id = min(CASE WHEN kind = 'document_index' THEN window_id END) OVER (PARTITION BY query_id, document) AS leads,
  CASE WHEN starts_with(t, '[TABLE') THEN 2.5 WHEN starts_with(t, 'kind=') THEN 2.0 WHEN starts_with(t, '[VISUAL') THEN 0.5 ELSE 1.2 END::DOUBLE AS weight FROM q JOIN w USING (session) LEFT JOIN s USING (query_id, window_id)),
 o AS (SELECT query_id, window_id, whole AND leads AS reserved, round((x + CASE WHEN sheet <> '' AND regexp_matches(lower(asked), '(^|[^a-z0-9_])' || lower(sheet) || '($|[^a-z0-9_])') THEN 4 ELSE 0 END
  + 8 * list_sum([0] || list_transform(regexp_extract_all(asked, '\b[0-9]{{4}}[/\-][0-9]{{2,4}}\b'), lambda i: contains(t, i)::INT))
  + CASE WHEN idx AND whole THEN CASE WHEN leads THEN 8 ELSE -1000 END WHEN idx THEN -0.25 WHEN whole THEN CASE WHEN f OR (l AND starts_with(t, '[TABLE')) THEN weight ELSE least(0.15, weight / 10) END ELSE 0 END)
  * CASE WHEN starts_with(t, 'source=pdf;') AND len(list_filter(regexp_extract_all(t, '=''([^'']*)''', 1), lambda v: len(regexp_extract_all(v, '[A-Za-z]+')) >= 14)) >= 2 THEN 0.25 ELSE 1 END, 6)::DOUBLE AS score FROM m)
 SELECT query_id, window_id, score, reserved, row_number() OVER (PARTITION BY query_id ORDER BY reserved DESC, score DESC, window_id) AS position FROM o WHERE score > 0 QUALIFY position <= 48""")
def session_windows(t: Tables):
    """Users' turns as questions of sessions of eight documents, cut into windows; a first turn asks about whole files. Languages stand for
    kinds of content: sheets, paragraphs, visuals, and text layers that were taken for tables."""
    text, start = F.coalesce("text", F.lit("")), F.col("start")
    p = t.documents.select("doc_id", "lang", "source", text.alias("text"), F.explode(F.sequence(F.lit(0), F.greatest(F.length(text), F.lit(1)) - 1, F.lit(1600))).alias("start"))
    part = lambda at, n: F.substr("text", start + at, F.lit(n))
    plain = lambda x: F.replace(x, F.lit("'"), F.lit(""))
    table = F.concat(F.lit("[TABLE sheet="), "source", F.lit(" state=visible] 2024-0"), (F.col("doc_id") % 5).cast("string"), F.lit("\n"))
    layer = F.concat(F.lit("source=pdf; A1='"), plain(part(1, 300)), F.lit("' B1='"), plain(part(301, 300)), F.lit("' "))
    head = F.when(F.col("lang") == "de", table).when(F.col("lang") == "en", "kind=paragraph ").when(F.col("lang") == "fr", "[VISUAL 1] ").otherwise(layer)
    at = F.col("doc_id") * 100000 + F.floor(start / 1600)
    kind = F.when((start < 3200) & (F.length("text") > 6400), "document_index").otherwise("text")
    w = p.select(at.alias("window_id"), F.floor(F.col("doc_id") / 8).alias("session"), F.col("doc_id").alias("document"), at.alias("order"), F.concat(head, part(1, 1600)).alias("text"), F.lit(None).cast("string").alias("ranking"), kind.alias("kind"), (start == 0).alias("first"), (start + 1600 >= F.length("text")).alias("last"))
    said = F.concat(text, F.lit(" src"), (F.col("turn") % 20).cast("string"), F.lit(" 2024-0"), (F.col("turn") % 5).cast("string"))
    q = t.conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("conv_id").cast("long").alias("session"), said.alias("text"), (F.col("turn") == 0).alias("whole"))
    return C.session_windows(q, w, 48)


_ALL = "list_filter(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z0-9]+(?:[._/-][a-z0-9]+)*'), lambda x: length(x) >= 2)"
_CTX = f"list_distinct({_ALL})"


@query("R23_ordered_context", rf"""WITH {_BM25},
 e AS (SELECT query_id, id, rank AS ordinal, b.text || ' ' || d.source || ' 2024-0' || query_id % 7 AS question, CASE lang WHEN 'en' THEN 'customer_document' WHEN 'de' THEN 'company_rag' WHEN 'fr' THEN 'visual' ELSE 'public_web' END AS source_type, d.source, lang, (id % 100) / 100.0::DOUBLE AS goal,
  CASE lang WHEN 'de' THEN '[ROW 2] A=''' || replace(substr(d.text, 1, 200), '''', '') || ''' B=''' || n_chars || '''' || chr(10) || '[TABLE_CONTEXT ' || substr(b.text, 1, 40) || ']' || chr(10) ELSE '' END || d.text || ' 2024-0' || id % 7 AS text FROM lx JOIN documents d ON id = doc_id JOIN benchmark b ON query_id = item_id WHERE rank <= 48),
 t AS (SELECT *, {_CTX.format("question")} AS qt, {_CTX.format("text")} AS tt, row_number() OVER (PARTITION BY query_id, source_type ORDER BY ordinal) AS local_rank,
  strpos(text, '[TABLE_CONTEXT') AS cut FROM e), u AS (SELECT *, list_filter({_ALL.format("question")}, lambda x, i: list_position({_ALL.format("question")}, x) = i)[:2] AS targets, list_intersect(qt, tt) AS hits, CASE WHEN cut > 0 THEN regexp_extract_all(substr(text, 1, cut - 1), '=''([^'']*)''', 1) END AS v FROM t),
 z AS (SELECT *, 60.0::DOUBLE / (60 + local_rank) + least(0.9, coalesce(list_sum(list_transform(hits, lambda x: 0.08::DOUBLE + 0.04 * ln(1 + length(x)))), 0)) + 4 * goal
  + CASE WHEN cut > 0 AND len(list_intersect(qt, {_CTX.format("substr(text, cut + 14)")})) > 0 THEN least(1.2, 0.4::DOUBLE * len(list_intersect(qt, {_CTX.format("v[1]")}))) ELSE 0 END
  + least(0.9, 0.3::DOUBLE * len(list_filter(targets, lambda x: contains(regexp_replace(lower(text), '\s+', '', 'g'), x))) + CASE WHEN id % 3 = 0 THEN 0.55 ELSE 0 END)
  + least(0.35, 0.08::DOUBLE * ((regexp_matches(text, '(?i)-?[0-9]+(?:[,.][0-9]+)?\s*(?:mm|cm|m²|m2|㎡|m|kg/m²|kg/m2|kg|%|℃|°c|天|小时|元|万元|亿元)') AND len(hits) > 0)::INT
   + regexp_matches(text, '\[ROW|\[COLUMNS\]|\[TABLE|Sheet|sheet=')::INT + regexp_matches(replace(lower(text), 'ß', 'ss'), '不得|禁止|not |must |only |unless |except ')::INT + (source_type = 'visual')::INT))
  + CASE WHEN contains(text, '2024-0' || query_id % 7) THEN 0.5 ELSE 0 END + 0.7 + CASE source_type WHEN 'customer_document' THEN 0.3 WHEN 'company_rag' THEN 0.25 WHEN 'visual' THEN 0.08 ELSE 0.06 END + CASE id % 4 WHEN 0 THEN 0.16 WHEN 1 THEN 0.08 ELSE 0 END AS s FROM u),
 fin AS (SELECT query_id, id, ordinal, local_rank, round(CASE WHEN query_id % 40 = 0 THEN 6 * goal + 0.15::DOUBLE * round(s, 6) ELSE s END, 6)::DOUBLE AS score FROM z)
 SELECT query_id, id, local_rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS position FROM fin""")
def ordered_context(t: Tables):
    """The 48 best documents of each query as its evidence. Languages stand for kinds of sources, German texts carry a table's row, whose
    cells hold tabs for line ends, as a row is one line, and queries of even tens were reranked."""
    id, lang = F.col("id"), F.col("lang")
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "lang", "source", "n_chars")
    b = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    rows = lexical(t, 48).select("query_id", "id", F.col("rank").alias("ordinal")).join(d, "id").join(b, "query_id")
    row = F.concat(F.lit("[ROW 2] A='"), F.translate(F.substr("body", F.lit(1), F.lit(200)), "\r\n'", "\t\t"), F.lit("' B='"), F.col("n_chars").cast("string"), F.lit("'\n[TABLE_CONTEXT "), F.substr("item", F.lit(1), F.lit(40)), F.lit("]\n"))
    question = F.concat("item", F.lit(" "), "source", F.lit(" 2024-0"), (F.col("query_id") % 7).cast("string"))
    targets = F.slice(T.context_terms(question), 1, 2)
    e = rows.select(
        "query_id", "id", "ordinal", question.alias("question"),
        F.when(lang == "en", "customer_document").when(lang == "de", "company_rag").when(lang == "fr", "visual").otherwise("public_web").alias("source_type"),
        F.concat(F.when(lang == "de", row).otherwise(""), "body", F.lit(" 2024-0"), (id % 7).cast("string")).alias("text"), F.lit(None).cast("string").alias("ranking"),
        targets.alias("targets"), F.when(id % 3 == 0, F.get(targets, F.lit(0))).alias("aspect"), F.create_map(F.lit("goal"), ((id % 100) / 100.0)).alias("goals"), (F.col("query_id") % 40 == 0).alias("reranked"),
        F.col("source").alias("source_group"), F.lit(None).cast("string").alias("chunk"), F.when(id % 4 == 0, "T1_standard").when(id % 4 == 1, "company_reviewed_material").alias("authority"), F.lit(False).alias("navigation"),
    )
    return C.ordered_context(e).select("query_id", "id", "local_rank", "score", "position")


@query("D12_row_facts", """SELECT p_partkey AS id, line, entity, metric, round(value, 6)::DOUBLE AS value, unit, scope FROM (
 SELECT p_partkey, 1 AS line, replace(lower(p_name), ' ', '') AS entity, 'thickness' AS metric, p_size * 10.0::DOUBLE AS value, 'mm' AS unit, '2024' AS scope FROM part UNION ALL
 SELECT p_partkey, 1, replace(lower(p_name), ' ', ''), 'cost', round(p_retailprice, 2)::DOUBLE, 'USD', '2024' FROM part UNION ALL
 SELECT p_partkey, 2, lower(p_brand), 'weight', p_size * 0.001::DOUBLE, 'kg', p_type FROM part UNION ALL
 SELECT p_partkey, 2, lower(p_brand) || 'hasmass:' || p_size || 'gand', 'width', p_size * 1000.0::DOUBLE, 'mm', p_type FROM part)""")
def table_row_facts(t: Tables):
    """A row under headings and a line of prose for each part."""
    size, price = F.col("p_size").cast("string"), F.format_string("%.2f", "p_retailprice")
    row = F.concat(F.lit("A2='"), "p_name", F.lit("' B2='"), size, F.lit("' C2='cm' D2[price]='"), price, F.lit(" usd' E2='2024'"))
    prose = F.concat("p_brand", F.lit(" has mass: "), size, F.lit(" g and width "), size, F.lit("m."))
    text = F.concat(F.lit("[COLUMNS] A=Product | B=Thickness | C=unit | E=Year\n"), row, F.lit("\n[BLOCK id=b1] "), prose)
    facts = row_facts(spread(t.part, t.part, each=20_000).select(F.col("p_partkey").alias("doc_id"), text.alias("text"), "p_type"), scope=F.col("p_type"))
    return facts.select("id", "line", "entity", "metric", F.round("value", 6).alias("value"), "unit", "scope")
