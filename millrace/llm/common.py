"""What the training-data operators share: shared-folder tables, row numbers, reading."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import materialize, release, shared_dir, written

__all__ = ["materialize", "release", "shared_dir", "slices", "table", "with_row_numbers", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_numbers(df: DataFrame, order: list[Column], name: str = "row_no") -> tuple[DataFrame, int]:
    """Number all rows from 0 in the given order without gathering them in one task.

    Rows are dealt by range, each range is numbered alone, and ranges are shifted by the
    sizes of those before. Only those sizes (one per partition) are broadcast. Rows that
    tie in every order column get their numbers in any order, and are dealt over several ranges
    if they are many.
    """
    dealt = df.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(*order, "_spread").withColumn("_range", F.spark_partition_id())
    kept = materialize(dealt, "ranges")
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_spread"))
    numbered = kept.withColumn("_within", within).join(F.broadcast(starts), "_range")
    total = kept.count()
    return numbered.withColumn(name, F.col("_start") + F.col("_within") - 1).drop("_range", "_within", "_start", "_spread"), total


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most so many bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)
