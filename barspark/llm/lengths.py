"""Exact histogram of encoded document lengths.

Documents are counted by token count first, so every later step works on one
row per distinct length.  Suffix sums over the histogram then answer totals,
quantiles and truncated totals for every context limit at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import Workspace, raw, texts
from barspark.llm.tokens import encoder


def _counts(tokenizer: str, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(ids) + extra for ids in encode.encode(raw(batch))], pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str, extra: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every whole text; ``extra`` ids are added to each.

    Null and empty texts count ``extra`` tokens; repeated rows count each.
    """
    return texts(documents, key, text).mapInArrow(_counts(tokenizer, extra), "doc_id long, n_tokens long")


def length_histogram(counts: DataFrame, block: int = 1024) -> DataFrame:
    """One row per distinct length of ``counts(n_tokens)``, with suffix sums.

    n_tokens; n_docs of that length; docs_from and tokens_from: documents of at
    least that length and their tokens; docs_below and tokens_below; n_total and
    tokens_total of all documents; truncated_total: tokens left when every
    document is cut to n_tokens; quantile: share of documents of at most this
    length.  Null counts are no documents.  An empty table gives no rows.

    The counts are read once; what they come to is written, a row per length.
    Suffix sums run inside blocks of ``block`` adjacent lengths and over the
    blocks' totals, so no task sees more than the larger of the two.
    """
    work = Workspace(counts.sparkSession, "lengths")
    by_length = counts.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    by_length = work.table("histogram", by_length.withColumn("block", F.floor(F.col("n_tokens") / block)))
    totals = by_length.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    zero = F.lit(0).cast("long")
    totals = totals.select(
        "block",
        F.coalesce(F.sum("docs").over(later), zero).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(later), zero).alias("tokens_after"),
        F.sum("docs").over(everything).alias("n_total"),
        F.sum("tokens").over(everything).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    rows = by_length.join(totals, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_after") + F.sum("n_docs").over(inside)).alias("docs_from"),
        (F.col("tokens_after") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)).alias("tokens_from"),
        "n_total",
        "tokens_total",
    )
    below = rows.withColumn("docs_below", F.col("n_total") - F.col("docs_from")).withColumn("tokens_below", F.col("tokens_total") - F.col("tokens_from"))
    return below.withColumn("truncated_total", F.col("tokens_below") + F.col("docs_from") * F.col("n_tokens")).withColumn(
        "quantile", (F.col("docs_below") + F.col("n_docs")) / F.col("n_total")
    )


def truncated_total(histogram: DataFrame, limit: int) -> Column:
    """Aggregate over a histogram: tokens left when every document is cut to ``limit``."""
    return F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit)))


def quantile(histogram: DataFrame, share: float) -> Column:
    """Aggregate over a histogram: the least length that ``share`` of all documents do not exceed."""
    return F.min(F.when(F.col("quantile") >= share, F.col("n_tokens")))
