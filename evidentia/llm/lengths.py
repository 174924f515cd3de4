"""Token counts by an exact histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .bpe import Encoder

#: Lengths in a block of the two-level suffix sums.
SPAN = 256


def histogram(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """(n_tokens, n_docs) over all rows: a null or empty text has length 0; no rows give no rows. Written once, as every use would encode again."""
    return scratch.written(encoder.lengths(docs).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def limits(hist: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a context limit:

    n_tokens (L), n_docs (documents of this length), docs_over (longer ones),
    tokens_within (all tokens of documents of L or fewer), tokens_truncated (all
    tokens if documents are cut at L), docs_total, tokens_total, share_within
    (of documents; its first row of q or more is the quantile q).

    Lengths are summed within blocks of ``SPAN`` and then over blocks, so no task
    holds more than a block's lengths or the blocks' totals. Documents of equal
    length are one row; null and empty texts are those of length 0; an empty
    histogram gives no rows.
    """
    rows = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("t"), F.floor(F.col("n_tokens") / SPAN).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("block").alias("b"),
        F.coalesce(F.sum("bd").over(over), F.lit(0)).alias("over_d"),
        F.coalesce(F.sum("bt").over(over), F.lit(0)).alias("over_t"),
        F.sum("bd").over(every).alias("docs_total"),
        F.sum("bt").over(every).alias("tokens_total"),
    )
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("in_d", F.coalesce(F.sum("n_docs").over(inner), F.lit(0))).withColumn("in_t", F.coalesce(F.sum("t").over(inner), F.lit(0)))
    out = summed.join(blocks, F.col("block") == F.col("b")).select("n_tokens", "n_docs", (F.col("in_d") + F.col("over_d")).alias("docs_over"), (F.col("in_t") + F.col("over_t")).alias("tokens_over"), "docs_total", "tokens_total")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_over",
        (F.col("tokens_total") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("tokens_total") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("tokens_truncated"),
        "docs_total",
        "tokens_total",
        (1 - F.col("docs_over") / F.col("docs_total")).alias("share_within"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: documents, tokens, and tokens left if every document is cut at ``limit`` (any number, whether it occurs or not)."""
    cut = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(cut), F.lit(0)).alias("tokens_truncated"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share ``q`` of documents does not exceed (null without documents). ``table``: of ``limits``."""
    return table.where(F.col("share_within") >= q - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))
