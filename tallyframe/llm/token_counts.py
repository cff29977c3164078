"""Exact length histogram of a corpus, and every total that follows from it.

Documents are aggregated by encoded length; suffix sums over the histogram
answer totals, quantiles and truncated totals for every context limit. Texts are
encoded once, into a written histogram with a row per length that occurs. Suffix
sums run within blocks of BLOCK lengths; one task orders the blocks' totals, of
which there are as many as the longest document has tokens, divided by BLOCK.

Null text has no tokens, an empty table gives an empty histogram, and repeated
rows count each time. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise
from .tokens import with_length

#: Lengths in one block of the suffix sums.
BLOCK = 4096


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""
    lengths = with_length(docs.select(F.lit(0).alias("key"), F.col(f"`{text}`").alias("text")), "key", "text", tokenizer)
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """The histogram with, for each length L that occurs:

    docs_from, tokens_from: documents of at least L tokens, and their tokens;
    docs_total, tokens_total: those of the whole corpus;
    truncated_total: tokens left if every document is cut to L tokens;
    quantile: share of documents of at most L tokens.
    """
    held = materialise(histogram, "histogram").select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / block).alias("block"))
    blocks = held.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = blocks.select(
        "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_above") for c in "dt"), *(F.sum(c).over(everything).alias(f"{c}_all") for c in "dt")
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    summed = held.select("*", F.sum("n_docs").over(within).alias("d_in"), F.sum("tokens").over(within).alias("t_in")).join(above, "block")
    docs_from, tokens_from = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    return summed.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        F.col("d_all").alias("docs_total"),
        F.col("t_all").alias("tokens_total"),
        (F.col("t_all") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_total"),
        ((F.col("d_all") - docs_from + F.col("n_docs")) / F.col("d_all")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> Column:
    """Aggregate over suffix_sums(): tokens left if every document is cut to `limit` tokens, for any limit."""
    return F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0))


def length_quantile(sums: DataFrame, q: float) -> Column:
    """Aggregate over suffix_sums(): the smallest length that at least a share q of documents do not exceed."""
    return F.min(F.when(F.col("quantile") >= q, F.col("n_tokens")))
