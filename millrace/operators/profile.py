"""Profile statistics: exact aggregates of one table each, as DataFrames.

Each function reads only the columns it names. Rates are percentages. Several columns of one
table share a scan through ``wide_stats``. Nothing gathers the values of a column in one
place: percentiles come from counts of digits, distinct
texts are counted by their 128-bit digests, and totals are joined as one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

PERCENTILES = (0.25, 0.5, 0.75, 0.95, 0.99)
#: The values of so many rows fit into one aggregate's buffer (16 bytes each); more are selected by radix. Both are exact.
SMALL = 200_000


def _double(x: Column) -> Column:
    return x.cast("double")


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent; null if there is no whole."""
    return _double(part) * 100.0 / F.nullif(_double(whole), F.lit(0.0))


def null_rate(c: str) -> Column:
    return percent(F.count_if(F.col(c).isNull()), F.count(F.lit(1)))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def numeric_aggregates(c: str) -> list[Column]:
    """All numeric statistics of one column but its percentiles."""
    x = _double(F.col(c))
    return [F.min(x).alias("min_val"), F.max(x).alias("max_val"), F.round(F.avg(x), 6).alias("mean_val"), F.round(F.stddev_samp(x), 6).alias("stddev_val"), null_rate(c).alias("null_rate")]


def ordered_bits(v: Column) -> Column:
    """A 64-bit integer for each double, in the order of doubles; -0.0 is 0.0, and NaN comes last.

    It is the number's exponent and fraction in the usual layout, negated for numbers below zero. Powers
    and quotients of powers of two are exact, so every double has its own integer.
    """
    a = F.abs(v)
    e = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023))
    e = F.greatest(e + F.when(a >= F.pow(F.lit(2.0), e + 1), 1).when(a < F.pow(F.lit(2.0), e), -1).otherwise(0), F.lit(-1022))
    normal = (e + 1023) * F.lit(1 << 52) + ((a / F.pow(F.lit(2.0), e) - 1.0) * float(1 << 52)).cast("long")
    bits = F.when(a == 0.0, F.lit(0).cast("long")).when(F.isnan(a), F.lit((2047 << 52) + 1)).when(a == float("inf"), F.lit(2047 << 52)).when(a < 2.0**-1022, (a / 5e-324).cast("long")).otherwise(normal)
    return F.when(v < 0.0, -bits).otherwise(bits)


def double_of(bits: int) -> float:
    """The double that ``ordered_bits`` made an integer of."""
    size = abs(bits)
    e, fraction = size >> 52, size & ((1 << 52) - 1)
    if e == 2047:
        x = math.nan if fraction else math.inf
    else:
        x = math.ldexp(fraction, -1074) if e == 0 else math.ldexp((1 << 52) + fraction, e - 1075)
    return -x if bits < 0 else x


def bits_of(v: np.ndarray) -> np.ndarray:
    """``ordered_bits`` of an array of doubles, read from their own layout."""
    bits = (v + 0.0).view(np.int64)
    out = np.where(bits < 0, -(bits & np.int64((1 << 63) - 1)), bits)
    out[np.isnan(v)] = (2047 << 52) + 1
    return out


#: Counters of a task are filled from so many values at a time.
AT_ONCE = 1 << 20


class _Counters:
    """Counts of small whole numbers, given in arrays."""

    def __init__(self, size: int):
        self.counts, self.held, self.waiting = np.zeros(size, np.int64), 0, []

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.held += len(codes)
        if self.held >= AT_ONCE:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=len(self.counts))
        self.held, self.waiting = 0, []


def _digit_counts(values: DataFrame, ups: Sequence[Sequence[int]], shift: int) -> DataFrame:
    """(i, up, prefix, n): how many values of column i have a prefix, of those whose first bits are one of its ``ups``.

    A task holds 65,536 counters for each column and ``up``, and hands over those above 0.
    """
    sought = [np.array(sorted(own), np.int64) for own in ups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [_Counters(len(own) << 16) for own in sought]
        for batch in batches:
            for column, own, counter in zip(batch.columns, sought, counters, strict=True):
                bits = bits_of(column.drop_null().to_numpy(zero_copy_only=False)) if len(own) else ()
                if not len(bits):
                    continue
                if shift == 48:
                    counter.add((bits >> 48) + 32_768)
                    continue
                up = bits >> (shift + 16)
                at = np.searchsorted(own, up).clip(max=len(own) - 1)
                fits = own[at] == up
                counter.add((at[fits] << 16) + ((bits[fits] >> shift) & 65_535))
        for i, (own, counter) in enumerate(zip(sought, counters, strict=True)):
            counter.flush()
            codes = np.nonzero(counter.counts)[0]
            up = own[codes >> 16]
            prefix = codes - 32_768 if shift == 48 else (up << 16) + (codes & 65_535)
            for a in range(0, len(codes), 10_000):
                part = slice(a, a + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes[part]), i, np.int32)), pa.array(up[part]), pa.array(prefix[part]), pa.array(counter.counts[codes[part]])], names=["i", "up", "prefix", "n"])

    parts = values.mapInArrow(run, "i int, up long, prefix long, n long")
    return parts.groupBy("i", "up", "prefix").agg(F.sum("n").alias("n"))


#: Bits that a bucket leaves out: 1,024 buckets lie between a power of two and the next, 2**22 in all.
BUCKET_BITS = 42
N_BUCKETS = 1 << (64 - BUCKET_BITS)


def buckets_of(v: np.ndarray) -> np.ndarray:
    """The bucket of each double, in the order of doubles."""
    return (bits_of(v) >> BUCKET_BITS) + N_BUCKETS // 2


def bucket_counts(values: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each column of doubles its buckets in order, how many values each has, and whether they are all the same.

    Tasks count by arrays, so no value is shuffled; what comes to the driver is bounded by the number of buckets.
    """
    width = len(values.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [_Counters(N_BUCKETS) for _ in range(width)]
        seen, mixed = np.zeros((2, width, N_BUCKETS), bool)
        firsts = np.zeros((width, N_BUCKETS))
        for batch in batches:
            for column, counter, known, several, first in zip(batch.columns, counters, seen, mixed, firsts, strict=True):
                v = column.drop_null().to_numpy(zero_copy_only=False) + 0.0
                at = buckets_of(v)
                new = ~known[at]
                first[at[new]], known[at[new]] = v[new], True
                several[at[v != first[at]]] = True
                counter.add(at)
        for i, counter in enumerate(counters):
            counter.flush()
            codes = np.nonzero(counter.counts)[0]
            for k in range(0, len(codes), 10_000):
                own = codes[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(own), pa.array(counter.counts[own]), pa.array(firsts[i][own]), pa.array(mixed[i][own])], names=["i", "bucket", "n", "first", "mixed"])

    parts = values.mapInArrow(run, "i int, bucket long, n long, first double, mixed boolean").groupBy("i", "bucket")
    one = (~F.bool_or("mixed") & (F.min("first") == F.max("first"))).alias("one")
    found = parts.agg(F.sum("n").alias("n"), one).toArrow()
    i, bucket, n, one = (found[c].to_numpy() for c in ("i", "bucket", "n", "one"))
    order = np.lexsort((bucket, i))
    return [(bucket[own], n[own], one[own].astype(bool)) for own in (order[i[order] == k] for k in range(width))]


def percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = PERCENTILES) -> DataFrame:
    """(column, p25, p50, p75, p95, p99 or what shares are asked for): exact interpolated percentiles of each column that has a value.

    Radix selection in four scans: each counts, by 16 bits of the ordered integers, the values that share the
    bits found so far with a wanted rank, and so finds the next bits. Only counts are shuffled, at most 65,536
    for each column and prefix, however the values are spread; two prefixes for each share come to the driver.
    """
    values = df.select(*[_double(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    spark = df.sparkSession
    #: By column and prefix: the ranks (name, position, rank among the values with that prefix) wanted there.
    wanted: dict[tuple[int, int], list[tuple[str, float, int]]] = {}
    for shift in (48, 32, 16, 0):
        ups = [[0] if shift == 48 else [up for j, up in wanted if j == i] for i in range(len(columns))]
        counts = _digit_counts(values, ups, shift)
        before = Window.partitionBy("i", "up").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        if shift == 48:
            sums = sums.persist()  # 65,536 rows a column at most, read twice
            wanted = {}
            for r in sums.groupBy("i").agg(F.sum("n").alias("total")).collect():
                for q in shares:
                    pos = q * (r.total - 1)
                    for rank in sorted({math.floor(pos), math.ceil(pos)}):
                        wanted.setdefault((r.i, 0), []).append((f"p{q * 100:g}", pos, rank))
            if not wanted:
                break
        asked = spark.createDataFrame([(i, up, rank) for (i, up), ranks in wanted.items() for rank in sorted({r for _, _, r in ranks})], "i int, up long, rank long")
        hits = sums.join(F.broadcast(asked), ["i", "up"]).where("start <= rank and rank < start + n").select("i", "up", "rank", "prefix", "start")
        found = {(r.i, r.up, r["rank"]): (r.prefix, r["rank"] - r.start) for r in hits.collect()}
        if shift == 48:
            sums.unpersist()
        narrower: dict[tuple[int, int], list[tuple[str, float, int]]] = {}
        for (i, up), ranks in wanted.items():
            for name, pos, rank in ranks:
                at, rest = found[i, up, rank]
                narrower.setdefault((i, at), []).append((name, pos, rest))
        wanted = narrower
    return spark.createDataFrame(_interpolated(wanted, columns, shares), "column string, " + ", ".join(f"`p{q * 100:g}` double" for q in shares))


def _interpolated(found: dict[tuple[int, int], list[tuple[str, float, int]]], columns: Sequence[str], shares: Sequence[float]) -> list[tuple]:
    """One row for each column from the values at the ranks beside each percentile."""
    ends: dict[tuple[int, str], list[tuple[float, float]]] = {}
    for (i, bits), ranks in found.items():
        for name, pos, _ in ranks:
            ends.setdefault((i, name), []).append((double_of(bits), pos))
    out = {}
    for (i, name), near in ends.items():
        near.sort()  # the lower rank has the lower value
        (low, pos), high = near[0], near[-1][0]
        weight = pos - math.floor(pos)
        out.setdefault(i, {})[name] = low if low == high or not weight else low * (1 - weight) + high * weight
    return [(columns[i], *[_rounded(row[f"p{q * 100:g}"]) for q in shares]) for i, row in sorted(out.items())]


def _rounded(x: float) -> float:
    """To six places, halves away from zero, as Spark rounds."""
    return x if not math.isfinite(x) else float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if abs(x) < 1e15 else x


_NAMES = ("min_val", "max_val", "mean_val", "stddev_val", *(f"p{int(q * 100)}" for q in PERCENTILES), "null_rate")


def numeric_stats(df: DataFrame, c: str) -> DataFrame:
    return wide_stats(df, [c]).drop("column")


def wide_stats(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Numeric statistics of many columns by five scans, one row for each column; a table of SMALL rows takes one."""
    few = df.limit(SMALL + 1).count() <= SMALL
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.struct(*numeric_aggregates(c), *(_buffered(c) if few else [])).alias(c) for c in numeric])
    one = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in numeric])).alias("x")).select("x.column", "x.s.*")
    if not few:
        one = one.join(F.broadcast(percentiles(df, numeric)), "column", "left")  # one row for each column
    return one.select("column", *_NAMES)


def _buffered(c: str) -> list[Column]:
    p = F.percentile(_double(F.col(c)), F.array(*map(F.lit, PERCENTILES)))
    return [F.round(p[k], 6).alias(f"p{int(q * 100)}") for k, q in enumerate(PERCENTILES)]


#: Bins of equal shares in which columns are profiled together.
BINS = 8


def joint_shape(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict:
    """How the ranks of neighbouring columns go together: edges of their bins and counts of rows by pair of bins.

    Rows with a null in any of the columns are left out. Edges are exact quantiles; a bin holds the values from
    its lower edge to below its upper one. All pairs share one scan; bins squared counts a pair come to the driver.
    """
    own = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).dropna()
    found = percentiles(own, own.columns, [k / bins for k in range(bins)] + [1.0]).orderBy("column").collect()
    edges = {r["column"]: list(r[1:]) for r in found}

    def bin_of(c: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, edges.get(c, [0.0] * (bins + 1))[1:-1])), lambda e: e <= F.col(c)))

    at = [bin_of(c) for c in own.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), at[k].alias("a"), at[k + 1].alias("b")) for k in range(len(columns) - 1)]))
    counts = [[[0] * bins for _ in range(bins)] for _ in range(len(columns) - 1)]
    for r in own.select(pairs.alias("x")).select("x.*").groupBy("k", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.k][r.a][r.b] = r.n
    return {"columns": list(columns), "bins": bins, "edges": [edges.get(c, []) for c in own.columns], "counts": counts}


def _distinct(df: DataFrame, c: str) -> Column:
    """Number of distinct values; of texts by their digests, so that no text is shuffled."""
    x = F.col(c)
    return F.count_distinct(F.unhex(F.md5(x)) if isinstance(df.schema[c].dataType, T.StringType) else x)


def cardinality(df: DataFrame, c: str) -> DataFrame:
    return df.agg(_distinct(df, c).alias("distinct_count"), null_rate(c).alias("null_rate"))


def _counted(df: DataFrame, key: Column, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _shares(counts: DataFrame, key: str) -> DataFrame:
    """key and pct of the total, which is joined as one row."""
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select(key, percent(F.col("n"), F.col("_total")).alias("pct"))


def categorical(df: DataFrame, c: str) -> DataFrame:
    """value and pct of the non-null rows."""
    return _shares(_counted(df, F.col(c).cast("string").alias("value"), c), "value")


def guarded_categorical(df: DataFrame, c: str, threshold: int = 50) -> DataFrame:
    """As ``categorical``, but without rows if the column has more distinct values than ``threshold``.

    The guard is a one-row side of the same plan, so values never leave a column that is over it.
    """
    counts = _counted(df, F.col(c).cast("string").alias("value"), c)
    guard = df.agg(_distinct(df, c).alias("_d")).where(F.col("_d") <= threshold).select("_d")
    kept = counts.join(F.broadcast(guard))  # one row at most
    return _shares(kept.select("value", "n"), "value")


def boolean_aggregates(c: str) -> list[Column]:
    return [percent(F.count_if(F.col(c)), F.count(F.lit(1))).alias("true_rate"), null_rate(c).alias("null_rate")]


def boolean_stats(df: DataFrame, c: str) -> DataFrame:
    return df.agg(*boolean_aggregates(c))


def length_aggregates(c: str) -> list[Column]:
    n = F.char_length(F.col(c))
    return [
        F.round(F.avg(n), 6).alias("avg_length"), F.min(n).cast("long").alias("min_length"),
        F.max(n).cast("long").alias("max_length"), null_rate(c).alias("null_rate"),
    ]


def string_stats(df: DataFrame, c: str) -> DataFrame:
    """Lengths in characters; never a value."""
    return df.agg(_distinct(df, c).alias("cardinality"), *length_aggregates(c))


def cardinalities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, cardinality) of every column that has a value: digests are grouped by column, each once before the shuffle.

    A row is not multiplied within one aggregate, as several distinct counts side by side would.
    """
    digests = F.array(*[F.struct(F.lit(c).alias("column"), F.unhex(F.md5(F.col(f"`{c}`").cast("string"))).alias("d")) for c in columns])
    return df.select(F.explode(digests).alias("x")).select("x.*").where("d is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("cardinality"))


def timestamp_aggregates(c: str) -> list[Column]:
    x = F.col(c)
    return [
        F.min(x).cast("string").alias("min_ts"), F.max(x).cast("string").alias("max_ts"), null_rate(c).alias("null_rate"),
        percent(F.count_if(F.weekday(x) < 5), F.count(x)).alias("weekday_ratio"),
    ]


def timestamp_stats(df: DataFrame, c: str) -> DataFrame:
    return df.agg(*timestamp_aggregates(c))


def monthly_density(df: DataFrame, c: str) -> DataFrame:
    month = F.date_format(F.date_trunc("month", F.col(c)), "yyyy-MM").alias("month")
    return df.where(F.col(c).isNotNull()).groupBy(month).agg(F.count(F.lit(1)).alias("cnt"))


def hourly_density(df: DataFrame, c: str) -> DataFrame:
    return _shares(_counted(df, F.hour(F.col(c)).alias("hour"), c), "hour")


def parent_ratio(child: DataFrame, fk: str) -> DataFrame:
    """Children per parent that has any; a null key is a group of its own."""
    per = child.groupBy(fk).agg(F.count(F.lit(1)).cast("double").alias("cnt"))
    p = F.percentile("cnt", F.array(*map(F.lit, PERCENTILES)))
    names = ("p25_ratio", "median_ratio", "p75_ratio", "p95_ratio", "p99_ratio")
    return per.agg(
        F.round(F.avg("cnt"), 6).alias("avg_ratio"), F.min("cnt").cast("long").alias("min_ratio"), F.max("cnt").cast("long").alias("max_ratio"),
        F.round(F.stddev_samp("cnt"), 6).alias("stddev_ratio"), *[F.round(p[k], 6).alias(n) for k, n in enumerate(names)],
    )


def childless(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """zero_count (parents without a child) and zero_rate in percent of all parents, null without parents.

    Child keys are made distinct first, which combines before the shuffle, so a parent with most of the children is one row.
    """
    keys = child.select(F.col(fk).alias("_fk")).where("_fk is not null").distinct()
    zero = parent.join(keys, F.col(pk) == F.col("_fk"), "left_anti").agg(F.count(F.lit(1)).alias("zero_count"))
    return zero.join(F.broadcast(parent.agg(F.count(F.lit(1)).alias("_n")))).select("zero_count", percent(F.col("zero_count"), F.col("_n")).alias("zero_rate"))


def long_profile(df: DataFrame, table: str) -> DataFrame:
    """(table, column, stat, value) of every numeric column, and the row count."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("short", "integer", "long", "float", "double", "decimal")]
    rows = df.agg(F.lit("*").alias("column"), F.lit("row_count").alias("stat"), F.count(F.lit(1)).cast("double").alias("value"))
    if numeric:
        wide = wide_stats(df, numeric)
        stats = [c for c in wide.columns if c != "column"]
        rows = rows.unionByName(wide.unpivot("column", stats, "stat", "value"))
    return rows.select(F.lit(table).alias("table"), "column", "stat", "value")
