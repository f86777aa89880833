"""Token counts: the exact length histogram of the documents, and what its suffix sums answer.

Documents are aggregated by their encoded length. One row per distinct length then says, for a
context limit of that length: how many documents and tokens are longer, how many tokens remain if
every document is cut at the limit, and the share of documents that fit (exact quantiles). The
sums run in two levels (blocks of 1,024 lengths, then inside a block), so no task holds more than
the lengths of one block or one row per block.

Defined results: a null or empty text has 0 tokens and counts as a document of length 0; repeated
rows count each time; an empty table gives an empty histogram; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cadence.llm.common import materialise
from cadence.llm.tokenizer import TOKENIZER_FILE, load

BLOCK = 1024


def length_udf(tokenizer: str = TOKENIZER_FILE):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load(tokenizer).encode_text
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """``(length, n_docs)``: documents by encoded length, partially summed in every task."""
    n = docs.select(length_udf(tokenizer)(docs[text_col].cast("string")).alias("length"))
    return n.groupBy("length").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """One row per distinct length, taken as a context limit."""
    h = histogram.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    h = materialise(h, "length-histogram")
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    everything = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
                           F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
                           F.sum("d").over(everything).alias("docs_total"), F.sum("t").over(everything).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = h.join(blocks, "block")
    longer = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_later")
    longer_tokens = F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("t_later")
    out = h.select("length", "n_docs", "docs_total", "tokens_total", longer.alias("docs_longer"), longer_tokens.alias("tokens_longer"))
    return out.select("length", "n_docs", "docs_total", "tokens_total", "docs_longer", "tokens_longer",
                      (F.col("tokens_total") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("tokens_truncated"),
                      ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("share_fitting"))


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left if every document is cut at any ``limit`` (also between lengths)."""
    return limits.agg(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")).alias("tokens_truncated"))


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length within which at least the share ``q`` of documents fits."""
    return limits.where(F.col("share_fitting") >= q).agg(F.min("length").alias("length"))
