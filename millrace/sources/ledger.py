"""Inserts with serials in one transaction over several tables, on any store that Spark reaches.

Rows are staged as Parquet by Spark's own writer, where nothing reads them. A commit is one entry of a
numbered log: which staged files of which table count, and from which serial each file's rows are
numbered. The store creates an entry once or not at all, so a transaction is seen whole or not at all, and of two
that began together one commits. A transaction with a token that the log knows is done already.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIAL = "id"


class ConflictError(RuntimeError):
    """Another transaction committed since this one began."""


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def entries(spark: SparkSession, root: str) -> list[dict]:
    """The log in its order: a small document for each transaction."""
    store, at, jvm = _store(spark, f"{root}/log")
    if not store.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in store.listStatus(at) if s.getPath().getName().endswith(".json"))
    out = []
    for name in names:
        stream = store.open(_store(spark, f"{root}/log/{name}")[1])
        try:
            out.append(json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")))
        finally:
            stream.close()
    return out


def _numbered(spark: SparkSession, root: str, files: Sequence[tuple[str, int]]) -> DataFrame:
    """The rows of files below the root, each with its serial: its file's first one and its place in the file."""
    rows = spark.read.parquet(*[f"{root}/{name}" for name, _ in files])
    place = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    starts = spark.createDataFrame([(name.rpartition("/")[2], start) for name, start in files], "_file string, _start long")
    return place.join(F.broadcast(starts), "_file").select((F.col("_start") + F.col("_at")).alias(SERIAL), *rows.columns)  # a row for each file


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All committed rows of a table with their serials."""
    files = [(f, start) for e in entries(spark, root) for f, start, _ in e["tables"].get(table, {}).get("files", [])]
    if not files:
        raise LookupError(f"no rows of {table} in {root}")
    return _numbered(spark, root, files)


class Transaction:
    """``with Transaction(spark, root) as t: people = t.insert("people", df)`` commits at its end, or leaves nothing.

    ``insert`` returns the rows with the serials they will have, for the rows of other tables to point to.
    """

    def __init__(self, spark: SparkSession, root: str, token: str | None = None):
        self.spark, self.root, self.token = spark, root.rstrip("/"), token
        log = entries(spark, self.root)
        self.number = len(log)
        self.done = next((e for e in log if token is not None and e["token"] == token), None)
        self.next = {t: x["next"] for e in log for t, x in e["tables"].items()}
        self.tables: dict[str, dict] = {}
        self.staged: list[str] = []

    def insert(self, table: str, df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        """Stage rows; serials go on from the table's last one, in the given order if there is one. Empty tables are fine.

        What was committed under this transaction's token is returned as it is, and nothing is written.
        """
        if self.done is not None:
            files = [(f, start) for f, start, _ in self.done["tables"].get(table, {}).get("files", [])]
            return _numbered(self.spark, self.root, files) if files else self._none(df)
        name = f"data/{table}/{uuid.uuid4().hex}"
        self.staged.append(name)
        dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        dealt.write.parquet(f"{self.root}/{name}")
        back = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
        sizes = back.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)).alias("n")).orderBy("f").collect()  # a row for each file
        start, files = self.next.get(table, 1), []
        for r in sizes:
            files.append((f"{name}/{r.f}", start, r.n))
            start += r.n
        own = self.tables.setdefault(table, {"files": [], "next": start})
        own["files"] += files
        self.next[table] = own["next"] = start
        return _numbered(self.spark, self.root, [(f, s) for f, s, _ in files]) if files else self._none(df)

    def _none(self, df: DataFrame) -> DataFrame:
        return self.spark.createDataFrame([], df.schema).select(F.lit(None).cast("long").alias(SERIAL), *df.columns)

    def commit(self) -> None:
        """Write the log's next entry. It fails, and nothing counts, if another transaction has written that one."""
        if self.done is not None:
            return
        text = json.dumps({"token": self.token, "tables": self.tables}).encode("utf-8")
        log, here = f"{self.root}/log", f"{self.number:012d}.json"
        store, draft, _ = _store(self.spark, f"{log}/.{uuid.uuid4().hex}")
        out = store.create(draft, False)
        try:
            out.write(bytearray(text))
        finally:
            out.close()
        final = _store(self.spark, f"{log}/{here}")[1]
        if store.exists(final) or not store.rename(draft, final):  # a rename does not replace
            store.delete(draft, False)
            raise ConflictError(f"entry {self.number} of {self.root}")
        self.done = {"token": self.token, "tables": self.tables}

    def abort(self) -> None:
        """Delete what was staged."""
        for name in self.staged:
            store, at, _ = _store(self.spark, f"{self.root}/{name}")
            store.delete(at, True)
        self.staged.clear()

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        try:
            if kind is None:
                self.commit()
        except BaseException:
            self.abort()
            raise
        if kind is not None:
            self.abort()
