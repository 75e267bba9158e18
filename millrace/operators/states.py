"""Profiles that add up: states of a table's parts, kept by input file, merged and finished.

A state is a few rows: counts, exact sums, means and squares of a column, counts by the leading bits of its
values, its texts' digests, counts by month and hour. States of disjoint parts merge by sums, least and
greatest values, so a table that grows is profiled by reading its new files only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.profile import PERCENTILES, bits_of, percent
from millrace.sources.scratch import materialize

#: Bits of a value that are not kept in counts: 12 bits of the fraction stay, so a percentile is off by one part in 4,096 at most.
DROPPED = 40
SCHEMA = "file string, column string, part string, key string, n long, low double, high double, mean double, m2 double, total double, rest double"
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _measured(df: DataFrame, c: str) -> tuple[str, Column] | None:
    """What is measured of a column: the part's name and a number; None for types that are not profiled."""
    x, kind = F.col(f"`{c}`"), df.schema[c].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "value", (x.cast("int") if isinstance(kind, T.BooleanType) else x).cast("double")
    if isinstance(kind, T.StringType):
        return "length", F.char_length(x).cast("double")
    if isinstance(kind, _TIMES):
        return "time", F.unix_micros(x.cast("timestamp")).cast("double")
    return None


def _keyed(df: DataFrame, c: str) -> list[tuple[str, Column]]:
    """What is counted of a column: the part's name and a key."""
    x, kind = F.col(f"`{c}`"), df.schema[c].dataType
    if isinstance(kind, T.StringType):
        return [("digest", F.md5(x))]
    if isinstance(kind, _TIMES):
        at = x.cast("timestamp")
        return [("month", F.date_format(at, "yyyy-MM")), ("hour", F.hour(at).cast("string")), ("weekday", (F.weekday(at) < 5).cast("string"))]
    return []


def exact_sum(v: np.ndarray) -> tuple[float, float]:
    """The sum of doubles as a double and what it lacks, by sums of pairs whose errors are kept."""
    high, low = np.asarray(v, np.float64), np.zeros(len(v))
    with np.errstate(invalid="ignore", over="ignore"):
        while len(high) > 1:
            if len(high) % 2:
                high, low = np.append(high, 0.0), np.append(low, 0.0)
            a, b = high[::2], high[1::2]
            s = a + b
            part = s - a
            high, low = s, low[::2] + low[1::2] + ((a - (s - part)) + (b - part))
    total, rest = (float(high[0]), float(low[0])) if len(high) else (0.0, 0.0)
    return (total, rest) if math.isfinite(total) and math.isfinite(rest) else (total, 0.0)


def _numbers(rows: DataFrame, columns: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Exact sums of all measured columns, and counts of numbers by their leading bits: one row a task for each.

    ``rows`` has the file, then a number or null for each column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[float, float]] = {}
        bits: dict[tuple[str, str], np.ndarray] = {}
        counts: dict[tuple[str, str], np.ndarray] = {}

        def count(at: tuple[str, str], prefixes: np.ndarray) -> None:
            found, n = np.unique(prefixes, return_counts=True)
            if at in bits:
                both, where = np.unique(np.concatenate([bits[at], found]), return_inverse=True)
                n = np.bincount(where, np.concatenate([counts[at], n]), len(both)).astype(np.int64)
                found = both
            bits[at], counts[at] = found, n

        for batch in batches:
            names = batch.column(0)
            for name in names.unique().to_pylist():
                own = batch if len(names.unique()) == 1 else batch.filter(pc.equal(names, name))
                for c, column in zip(columns, own.columns[1:], strict=True):
                    v = column.drop_null().to_numpy(zero_copy_only=False)
                    if len(v):
                        have = sums.get((name, c), (0.0, 0.0))
                        new = exact_sum(v)
                        total, rest = exact_sum(np.array([have[0], new[0]]))
                        sums[name, c] = (total, rest + have[1] + new[1] if math.isfinite(total) else 0.0)
                        if c in numeric:
                            count((name, c), bits_of(v) >> DROPPED)
        out = [(name, c, "sum", "", 0, total, rest) for (name, c), (total, rest) in sums.items()]
        out += [(name, c, "bits", str(k), n, None, None) for (name, c), own in bits.items() for k, n in zip(own.tolist(), counts[name, c].tolist(), strict=True)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64())
        for a in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out[a : a + 10_000]], t) for i, t in enumerate(kinds)], names=["file", "column", "part", "key", "n", "total", "rest"])

    return rows.mapInArrow(run, "file string, column string, part string, key string, n long, total double, rest double")


def _exact(pairs: Column) -> tuple[Column, Column]:
    """Sums of (total, rest) pairs, as such a pair; the number of pairs is that of tasks, files or parts."""

    def add(have: Column, new: Column) -> Column:
        a, b = have["total"], new["total"]
        s = a + b
        error = (a - (s - (s - a))) + (b - (s - a))
        fine = F.abs(s) < float("inf")
        return F.struct(s.alias("total"), F.when(fine, have["rest"] + new["rest"] + error).otherwise(0.0).alias("rest"))

    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("rest"))
    some = F.filter(F.collect_list(F.struct(pairs["total"].alias("total"), pairs["rest"].alias("rest"))), lambda x: x["total"].isNotNull())
    done = F.aggregate(F.sort_array(some), zero, add)
    return F.when(F.size(some) > 0, done["total"]), F.when(F.size(some) > 0, done["rest"])


def states(df: DataFrame, columns: Sequence[str] | None = None, by_file: bool = False) -> DataFrame:
    """The state of a table, or one for each of its input files, by three scans. Column "*" counts rows.

    Numbers, texts, booleans, dates and times are profiled, other types left out. Nulls are what the rows exceed the
    values by. One scan measures all columns side by side, one sums them exactly and counts numbers by their leading
    bits in arrays, one counts keys, which combine before the shuffle; of texts only digests and lengths leave a task.
    """
    columns = [c for c in (columns or df.columns) if _measured(df, c)]
    file = F.input_file_name() if by_file else F.lit("")
    measured = {c: _measured(df, c) for c in columns}
    wide = df.select(file.alias("file"), *[x.alias(f"v{i}") for i, (_, x) in enumerate(measured.values())])

    def one(part: str, name: str, v: Column | None) -> Column:
        low, high, mean, m2 = (F.lit(None).cast("double"),) * 4 if v is None else (F.min(v), F.max(v), F.avg(v), F.var_pop(v) * F.count(v))
        return F.struct(F.lit(name).alias("column"), F.lit(part).alias("part"), (F.count(F.lit(1)) if v is None else F.count(v)).alias("n"), low.alias("low"), high.alias("high"), mean.alias("mean"), m2.alias("m2"))

    each = F.array(one("rows", "*", None), *[one(part, c, F.col(f"v{i}")) for i, (c, (part, _)) in enumerate(measured.items())])
    values = wide.groupBy("file").agg(each.alias("all")).select("file", F.explode("all").alias("x")).select("file", "x.*").where("n > 0").withColumn("key", F.lit(""))
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    nothing = [F.lit(None).cast("double").alias(x) for x in ("low", "high", "mean", "m2")]
    order = ["file", "column", "part", "key", "n", "low", "high", "mean", "m2", "total", "rest"]
    if columns:
        found = _numbers(wide, columns, numeric)
        total, rest = _exact({"total": F.col("total"), "rest": F.col("rest")})
        sums = found.where("part = 'sum'").groupBy("file", "column").agg(total.alias("total"), rest.alias("rest"))
        values = values.join(sums, ["file", "column"], "left").select(*order)
        bits = found.where("part = 'bits'").groupBy("file", "column", "part", "key").agg(F.sum("n").alias("n"))
    else:
        values = values.withColumn("total", F.lit(None).cast("double")).withColumn("rest", F.lit(None).cast("double")).select(*order)
    out, nil = [values], [F.lit(None).cast("double").alias(x) for x in ("total", "rest")]
    if numeric:
        out.append(bits.select("file", "column", "part", "key", "n", *nothing, *nil))
    keyed = [F.struct(F.lit(c).alias("column"), F.lit(part).alias("part"), key.alias("key")) for c in columns for part, key in _keyed(df, c)]
    if keyed:
        rows = df.select(file.alias("file"), F.explode(F.array(*keyed)).alias("e")).select("file", "e.*").where("key is not null")
        out.append(rows.groupBy("file", "column", "part", "key").agg(F.count(F.lit(1)).alias("n")).select("file", "column", "part", "key", "n", *nothing, *nil))
    return union(out)


def merged(parts: DataFrame) -> DataFrame:
    """One state of many, whose rows must not overlap: counts and squares add up, also those between the parts' means.

    Means come from exact sums, so they don't depend on the parts; states kept without sums add up their means.
    """
    n, sums = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - sums * sums / n
    measured = parts.where("mean is not null").groupBy("column", "part", "key")
    total, rest = _exact({"total": F.coalesce("total", F.col("n") * F.col("mean")), "rest": F.coalesce("rest", F.lit(0.0))})
    numbers = measured.agg(n.alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (sums / n).alias("_mean"), (F.sum("m2") + F.greatest(between, F.lit(0.0))).alias("m2"), total.alias("total"), rest.alias("rest"))
    exact = (F.col("total") + F.col("rest")) / F.col("n")
    numbers = numbers.withColumn("mean", F.when(F.abs(exact) < float("inf"), exact).otherwise(F.col("_mean")))
    counts = parts.where("mean is null").groupBy("column", "part", "key").agg(n.alias("n"), *[F.lit(None).cast("double").alias(x) for x in ("low", "high", "mean", "m2", "total", "rest")])
    names = [f.split()[0] for f in SCHEMA.split(", ")[1:]]
    return numbers.select(F.lit("").alias("file"), *names).unionByName(counts.select(F.lit("").alias("file"), *names))


def _edges(state: DataFrame) -> DataFrame:
    """(column, p25 ..): the prefix that holds the value of each rank floor(share * (n - 1))."""
    bits = state.where("part = 'bits'").select("column", F.col("key").try_cast("long").alias("prefix"), "n")
    before = Window.partitionBy("column").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # a row for each prefix
    sums = bits.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("column")))
    rank = lambda q: F.floor(F.lit(q) * (F.col("total") - 1))
    return sums.groupBy("column").agg(*[F.max(F.when((F.col("start") <= rank(q)) & (rank(q) < F.col("start") + F.col("n")), F.col("prefix"))).alias(f"p{int(q * 100)}") for q in PERCENTILES])


def _lower(prefix: Column) -> Column:
    """The value nearest zero that has a prefix: the lower edge of positive ones, the upper edge of negative ones."""
    size = F.when(prefix < 0, -(prefix + 1)).otherwise(prefix)
    e, fraction = F.floor(size / (1 << (52 - DROPPED))), F.pmod(size, F.lit(1 << (52 - DROPPED))) / float(1 << (52 - DROPPED))
    x = F.when(e == 0, fraction * 2.0**-1022).otherwise((fraction + 1.0) * F.pow(F.lit(2.0), e - 1023))
    return F.when(prefix < 0, -x).otherwise(x)


def numeric_profile(state: DataFrame) -> DataFrame:
    """(column, n, min_val, max_val, mean_val, stddev_val, p25 .. p99, null_rate) of the numeric columns of one state.

    Percentiles are the edge, towards zero, of the range of values that agree in sign, exponent and 12 bits.
    """
    state = materialize(state.where("part in ('rows', 'value', 'bits')"), "numeric_state")  # small, and read three times
    rows = state.where("column = '*'").select(F.col("n").alias("_rows"))
    own = state.where("part = 'value'").join(_edges(state), "column").join(F.broadcast(rows))  # one row
    return own.select(
        "column", "n", F.col("low").alias("min_val"), F.col("high").alias("max_val"), F.round("mean", 6).alias("mean_val"), F.round(F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))), 6).alias("stddev_val"),
        *[F.round(_lower(F.col(f"p{int(q * 100)}")), 6).alias(f"p{int(q * 100)}") for q in PERCENTILES], percent(F.col("_rows") - F.col("n"), F.col("_rows")).alias("null_rate"),
    )


def text_profile(state: DataFrame) -> DataFrame:
    """(column, cardinality, avg_length, min_length, max_length) of the text columns; distinct texts are counted by digest."""
    digests = state.where("part = 'digest'").groupBy("column").agg(F.count_distinct("key").alias("cardinality"))
    own = state.where("part = 'length'").select("column", F.round("mean", 6).alias("avg_length"), F.col("low").cast("long").alias("min_length"), F.col("high").cast("long").alias("max_length"))
    return own.join(digests, "column")


def counts_by(state: DataFrame, part: str) -> DataFrame:
    """(column, key, n) of ``month``, ``hour`` or ``weekday``."""
    return state.where(F.col("part") == part).select("column", "key", "n")


def refreshed(spark: SparkSession, table: str, kept: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The merged state of a Parquet table, whose files' states are kept in a folder: only files without one are read.

    States are appended after their files were read whole; a run that fails appends none. Files that are gone, or
    were replaced under another name, count no more.
    """
    now = spark.read.parquet(table)
    files = set(now.inputFiles())
    have = _kept(spark, kept)
    known = {r.file for r in have.select("file").distinct().collect()}  # a name for each file, as listed by the reader
    new = sorted(files - known)
    if new:
        states(spark.read.schema(now.schema).parquet(*new), columns, by_file=True).write.mode("append").parquet(kept)
        have = _kept(spark, kept)
    return merged(have.join(F.broadcast(spark.createDataFrame([(f,) for f in sorted(files)], "file string")), "file"))


def _kept(spark: SparkSession, path: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(SCHEMA).parquet(path) if there else spark.createDataFrame([], SCHEMA)


def union(parts: Iterable[DataFrame]) -> DataFrame:
    """States one below the other, for ``merged``."""
    first, *rest = parts
    for more in rest:
        first = first.unionByName(more)
    return first
