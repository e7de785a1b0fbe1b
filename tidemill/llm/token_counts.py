"""Token counts: an exact histogram of encoded lengths and its suffix sums.

The histogram has one row for each length that occurs, so it answers every
question on totals, quantiles and truncation without the texts. Suffix sums are
taken in two levels, inside blocks of lengths and over the blocks, so no task
holds all lengths.

Null texts count as empty (length 0). An empty table gives an empty histogram.
Repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.tokens import TOKENIZER, encoder

BLOCK = 64


def token_lengths(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``n_tokens`` of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t.as_py() or "")) for t in b.column(0)], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``n_tokens, n_docs``: a row for each length; map tasks combine theirs before the shuffle."""
    return token_lengths(docs, text_col, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length that occurs: what lies at it, at or above it and below it.

    ``docs_from`` and ``tokens_from`` are suffix sums over lengths of at least
    ``n_tokens``. ``truncated_total`` is the tokens left when each text is cut
    to ``n_tokens``, ``docs_cut`` the texts that this shortens, and ``quantile``
    the part of texts no longer than ``n_tokens``.
    """
    h = histogram.withColumn("_block", F.floor(F.col("n_tokens") / block)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    inside = W.partitionBy("_block").orderBy(F.desc("n_tokens"))
    over = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    blocks = blocks.select(
        "_block", F.coalesce(F.sum("_d").over(over), F.lit(0)).alias("_d_above"), F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_t_above"),
        F.sum("_d").over(everything).alias("docs_total"), F.sum("_t").over(everything).alias("tokens_total"),
    )
    s = h.withColumn("_d_in", F.sum("n_docs").over(inside)).withColumn("_t_in", F.sum("_tokens").over(inside)).join(blocks, "_block")
    docs_from, tokens_from = F.col("_d_in") + F.col("_d_above"), F.col("_t_in") + F.col("_t_above")
    return s.select(
        "n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), (docs_from - F.col("n_docs")).alias("docs_cut"),
        (F.col("tokens_total") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_total"),
        ((F.col("docs_total") - docs_from + F.col("n_docs")) / F.col("docs_total")).alias("quantile"), "docs_total", "tokens_total",
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens and shortened texts for context limits that need not occur as lengths."""
    n = F.col("n_tokens")
    above = [F.sum(F.when(n > c, F.col("n_docs")).otherwise(0)) for c in limits]
    below = [F.sum(F.when(n <= c, n * F.col("n_docs")).otherwise(0)) for c in limits]
    each = [F.struct(F.lit(c).cast("long").alias("limit"), F.coalesce(b + a * F.lit(c), F.lit(0)).alias("truncated_total"), F.coalesce(a, F.lit(0)).alias("docs_cut")) for c, a, b in zip(limits, above, below, strict=True)]
    return sums.agg(F.array(*each).alias("_x")).select(F.inline("_x"))


def length_quantiles(sums: DataFrame, at: list[float]) -> DataFrame:
    """The least length that at least the part ``at`` of texts does not exceed."""
    found = [F.struct(F.lit(float(q)).alias("q"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in at]
    return sums.agg(F.array(*found).alias("_x")).select(F.inline("_x"))
