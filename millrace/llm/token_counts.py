"""Exact length histogram: token totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, slices
from millrace.llm.tokens import encoder, vocabulary_path

#: Lengths are summed in runs of this many, so no window holds more than a run or the list of runs.
RUN = 4096


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens of every row of ``docs`` (null and empty texts: 0), by the encoder that writes token files."""
    path = path or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_many = encoder(path).count_many
        for batch in batches:
            for part in slices(batch, 0):
                counts = count_many([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens long")


def length_histogram(counted: DataFrame) -> DataFrame:
    """For each distinct length L of ``counted.n_tokens``, everything a context limit of L tokens decides.

    limit_tokens, n_docs (of exactly that length), docs_within (at most L), docs_over,
    tokens_within, total_tokens, truncated_total (sum of min(length, L)), cumulative_share
    (docs_within over all: its inverse gives the quantiles). Documents are first counted by
    length, so everything after is as small as the list of distinct lengths. Null lengths are
    left out; an empty table gives an empty result.
    """
    counts = counted.where("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = materialize(counts, "lengths").withColumn("tokens", F.col("n_docs") * F.col("n_tokens")).withColumn("run", F.expr(f"n_tokens div {RUN}"))
    after = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    zero = F.lit(0).cast("long")
    every = Window.partitionBy()
    runs = runs.select(
        "run", F.coalesce(F.sum("d").over(after), zero).alias("docs_after"), F.coalesce(F.sum("t").over(after), zero).alias("tokens_after"),
        F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"),
    )
    own = Window.partitionBy("run").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = counts.join(runs, "run").select(
        "*",
        (F.col("docs_after") + F.coalesce(F.sum("n_docs").over(own), zero)).alias("docs_over"),
        (F.col("tokens_after") + F.coalesce(F.sum("tokens").over(own), zero)).alias("tokens_over"),
    )
    within = F.col("total_tokens") - F.col("tokens_over")
    return over.select(
        F.col("n_tokens").alias("limit_tokens"), "n_docs", (F.col("total_docs") - F.col("docs_over")).alias("docs_within"), "docs_over",
        within.alias("tokens_within"), "total_tokens", (within + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("cumulative_share"),
    )


def answer(histogram: DataFrame, limit: int) -> DataFrame:
    """Totals for any context limit, distinct length or not: docs_within, docs_over, total_tokens, truncated_total."""
    below = F.col("limit_tokens") <= limit
    docs, tokens = F.col("n_docs"), F.col("n_docs") * F.col("limit_tokens")
    zero = F.lit(0).cast("long")
    total = lambda value, where: F.coalesce(F.sum(F.when(where, value)), zero)
    return histogram.agg(
        total(docs, below).alias("docs_within"), total(docs, ~below).alias("docs_over"), F.coalesce(F.sum(tokens), zero).alias("total_tokens"),
        (total(tokens, below) + total(docs * limit, ~below)).alias("truncated_total"),
    )


def quantile(histogram: DataFrame, share: float) -> int | None:
    """The least length that at least this share of documents does not exceed."""
    return histogram.where(F.col("cumulative_share") >= share).agg(F.min("limit_tokens")).first()[0]
