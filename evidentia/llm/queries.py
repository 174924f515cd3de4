"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, lengths, merkle, minhash, mixture, overwrite, scratch, secrets, substrings, toxicity, urls, vectors, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), percent=85, k=5)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return bpe.Encoder(spark, vocabulary(), corpus=docs).digests(docs)


#: The rules of the query, as its contract states them.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page whose id is that of a document of quality 0 is bad; pages have no labels of their own."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return urls.judged(pages, labels, RULES)


def op5_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return lengths.limits(lengths.histogram(docs, bpe.Encoder(spark, vocabulary(), corpus=docs)))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(_documents(spark, sf_dir), least=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch.small_batches(spark)
    path = scratch.path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, min_bytes=0)
    records = warc.read(spark, path).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target shares: those that the sources have, so that every window is a sample of the whole mixture."""
    pieces = mixture.packed(_documents(spark, sf_dir), bpe.Encoder(spark, vocabulary()), with_ids=False)
    return pieces.drop("source")


def op12_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with h % 3 = 0 (h: crc32 of the id) and a day divisible by 7 arrive again; a null id or time has no copy, a null arrival is late."""
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet")
    kinds = {f.name: f.dataType.simpleString() for f in sales.schema}
    time = lambda c: overwrite.micros(F.col(c), kinds[c])
    h = F.crc32(F.col("sale_id").cast("string"))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    again = sales.where((h % 3 == 0) & (overwrite.day_of(time("sold_at")) % 7 == 0))
    again = again.withColumns({"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)})
    both = sales.unionByName(again)
    early = F.coalesce(time("arrived_at") < LATE, F.lit(False))
    layout = overwrite.Layout(sales, scratch.lasting(spark, "sales"), per_file=1 + sales.count() // overwrite.FILES)
    layout.start(both.where(early))
    return layout.report(layout.update(both.where(~early)))


#: 2024-04-10 00:00 in microseconds since 1970: rows that arrive from then on are late.
LATE = 1_712_707_200_000_000


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows where 5 divides the crc32 of the id are tampered with: their text's A-Z are lower-cased."""
    docs = _documents(spark, sf_dir)
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(docs, altered, lambda text: F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_decontaminate, op3_bpe, op4_urls, op5_lengths, op6_substrings, op7_warc, op8_secrets, op9_toxicity, op10_vectors, op11_packing, op12_overwrite, op13_merkle)}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links by shared shingles, then the smallest id reachable by repeated minima along links.
_OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
 n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
 r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
 SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id, n.doc_id = min(r.reach) AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n"""

_OP6 = f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
 x AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM w)),
 y AS (SELECT doc_id, list(i) AS starts FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM x) WHERE n > 1 GROUP BY doc_id),
 g AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 35)))) AS gone FROM y),
 t AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id)),
 e AS (SELECT doc_id, k, w[k] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM t)),
 q AS (SELECT e.doc_id, string_agg(v, ' ' ORDER BY k) AS kept FROM e LEFT JOIN (SELECT doc_id, unnest(gone) AS k FROM t) d USING (doc_id, k) WHERE d.k IS NULL GROUP BY e.doc_id)
 SELECT t.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN q USING (doc_id)"""

_BASE32 = " || ".join(f"translate(to_base(('0x' || substr(h, {i}, 10))::BIGINT, 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in (1, 11, 21, 31))
_OP7 = f"""SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
 FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)"""

_OP10 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
 r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
 SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(reach) AS component_id, vec_id = min(reach) AS kept FROM v JOIN r ON r.node = vec_id GROUP BY vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": _OP1, "op6_substrings": _OP6, "op7_warc": _OP7, "op10_vectors": _OP10}
