"""Extension: audits and densities over streams of tables, kept exact across restarts.

A query's batches are written each under its own number, so a batch that runs again after a failure
replaces what it had written, and its checkpoint holds state and places. What a folder of batches says is
read by ``appended`` (every row once) or ``latest`` (the last state of each key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import shared_dir

_BATCH = "batch"


def stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files, those there and those to come."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def drain(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over all there is now and return its batches, those of earlier runs included.

    The folder holds the query's checkpoint and its batches; the next run goes on where this one ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{_BATCH}={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    spark = df.sparkSession
    schema = df.schema.add(_BATCH, "long")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, for a query that is run once."""
    import uuid

    return f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}-{name}"


def appended(batches: DataFrame) -> DataFrame:
    return batches.drop(_BATCH)


def latest(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last state of each key."""
    rest = [c for c in batches.columns if c not in (*keys, _BATCH)]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), _BATCH).alias("s")).select(*keys, "s.*")


def family_states(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """(key, children, parents) of every key of two streams, as it changes; null keys are left out. Mode ``update``.

    One counted state for each key: a child may come before its parent, however long.
    """
    both = child.select(F.col(fk).cast("string").alias("key"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(parent.select(F.col(pk).cast("string").alias("key"), F.lit(0).alias("c"), F.lit(1).alias("p")))
    return both.where("key is not null").groupBy("key").agg(F.sum("c").alias("children"), F.sum("p").alias("parents"))


def orphans(states: DataFrame) -> DataFrame:
    """orphans: children whose key no parent has, by what the streams have brought so far."""
    return states.agg(F.coalesce(F.sum(F.when(F.col("parents") == 0, F.col("children"))), F.lit(0)).cast("long").alias("orphans"))


def early_children(child: DataFrame, fk: str, ts: str, parent: DataFrame, pk: str, parent_ts: str, late: str | None = None) -> DataFrame:
    """(key, at, parent_at) of children earlier than their parent, joined as either comes. Mode ``append``.

    Without ``late`` both sides wait as long as it takes, so state grows with the streams. With it, rows older than the
    newest by more are dropped, and a child waits for a parent that is up to so much later than itself.
    """
    c = child.select(F.col(fk).alias("key"), F.col(ts).cast("timestamp").alias("at")).where("key is not null and at is not null")
    p = parent.select(F.col(pk).alias("_key"), F.col(parent_ts).cast("timestamp").alias("parent_at")).where("_key is not null and parent_at is not null")
    on = (F.col("key") == F.col("_key")) & (F.col("at") < F.col("parent_at"))
    if late:
        c, p = c.withWatermark("at", late), p.withWatermark("parent_at", late)
        on &= F.col("parent_at") <= F.col("at") + F.expr(f"interval {late}")
    return c.join(p, on).select("key", "at", "parent_at")


def densities(rows: DataFrame, ts: str) -> DataFrame:
    """(kind, at, n): counts by month (yyyy-MM) and by hour of the day, as they change. Mode ``update``."""
    at = F.col(ts).cast("timestamp")
    both = F.explode(F.array(F.struct(F.lit("month").alias("kind"), F.date_format(at, "yyyy-MM").alias("at")), F.struct(F.lit("hour").alias("kind"), F.hour(at).cast("string").alias("at"))))
    return rows.where(F.col(ts).isNotNull()).select(both.alias("x")).select("x.*").groupBy("kind", "at").agg(F.count(F.lit(1)).alias("n"))
