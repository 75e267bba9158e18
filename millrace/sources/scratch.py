"""Tables written on the way in the folder that all executors share, where lineage ends."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, one in the warehouse.

    Only a session whose executors are threads of the driver gets a temporary folder of this machine.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/millrace-scratch"
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="millrace-")
    return _own_dir


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    The files survive the loss of executors. They go with ``release``, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}-{label}"
    if not _written:
        atexit.register(_release_all, spark)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``materialize`` has written; a mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int, until: int) -> None:
    """Delete the tables written between two marks; no DataFrame that reads them may be used afterwards."""
    for at in range(since, until):
        if _written[at]:
            _remove(spark, _written[at])
            _written[at] = ""


def _release_all(spark: SparkSession) -> None:
    release(spark, 0, len(_written))
