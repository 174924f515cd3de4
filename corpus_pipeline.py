"""A corpus pipeline of five operators: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, decontaminate, minhash, queries, scratch, secrets, toxicity


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored 0.5 or more; learns from the labels of ``docs``. Every row is judged by its own text, whatever its id; a null or
    empty text is one without words. Columns and their order stay."""
    scratch.small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, back = scratch.plain(docs, "doc_id", "text")
    return back(toxicity.scored(rows, toxicity.train(rows, labels), tuple(rows.columns), "score").where("score < 0.5"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five words, similarity 0.8), the one with the smallest id; of rows that
    share that id, the one with the smallest digest of its text. Rows that share an id are otherwise unrelated. Rows with a null id stay."""
    scratch.small_batches(spark)
    rows, back = scratch.plain(docs, "doc_id", "text")
    known = rows.where("doc_id is not null")
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").agg(F.count_if(F.col("doc_id").isNull()), F.count("doc_id")).first()
    keyed = _keyed(known) if odd[1] else known.withColumn("key", F.col("doc_id"))
    groups = minhash.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), percent=80, k=5).where("kept").select(F.col("doc_id").alias("kept_key"))
    kept = back(keyed.join(groups, F.col("key") == F.col("kept_key"), "left_semi"))
    return kept.unionByName(docs.where("doc_id is null")) if odd[0] else kept


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each id and text (key), in their order; of rows with the same id and text, one."""
    rows = docs.withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit(""))).withColumn("row", F.xxhash64(*docs.columns))
    keys = rows.groupBy(F.col("doc_id").alias("i"), F.col("digest").alias("t")).agg(F.min("row").alias("r"))
    keys = scratch.written(keys.orderBy("i", "t").withColumn("key", F.monotonically_increasing_id()), "keys")
    out = rows.join(keys, (F.col("doc_id") == F.col("i")) & (F.col("digest") == F.col("t")) & (F.col("row") == F.col("r")))
    return scratch.written(out.select(*docs.columns, "key").dropDuplicates(["key"]), "keyed")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a near copy of a benchmark item, whole texts searched; null and empty texts, and repeated ids, have nothing to
    do with it. Columns and their order stay."""
    scratch.small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by ``[secret]``; n_chars follows. No document is dropped; a null text stays null."""
    columns = docs.columns
    out = secrets.redacted(docs)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids, a row per row; a null or empty text has none."""
    scratch.small_batches(spark)
    return bpe.Encoder(spark, queries.vocabulary(), corpus=docs).encode(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", no_near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("encoding", encoded),
]

#: None: SQL can't express the trained classifier, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # the next stage reads this one's table only
            scratch.forget(before)
        before = docs
    return docs
