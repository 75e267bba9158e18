"""Extension: density of arrivals over a stream, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(start, cnt) by tumbling hours of event time; also works on a batch."""
    at = stream.select(F.col(ts).cast("timestamp").alias("at"))
    at = at.withWatermark("at", late) if stream.isStreaming else at
    return at.groupBy(F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("window.start").alias("start"), "cnt")
