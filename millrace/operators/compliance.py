"""Drift of generated data from a profile: comparisons with tolerance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.profile import N_BUCKETS, bucket_counts, buckets_of, percent
from millrace.operators.temporal import running_sums

TOLERANCE = 5.0


def distribution_gap(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """max_gap: greatest difference in percentage points over the values of either side, a missing one being 0."""
    a, b = expected.select("value", F.col("pct").alias("_e")), actual.select("value", F.col("pct").alias("_a"))
    gap = F.abs(F.coalesce("_e", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0)))
    return a.join(b, "value", "full_outer").agg(F.round(F.coalesce(F.max(gap), F.lit(0.0)), 6).alias("max_gap"))


def ks_gap(expected: DataFrame, c: str, actual: DataFrame, d: str) -> DataFrame:
    """ks_gap: greatest difference between the shares of values up to any value (0 to 1); null if either side has none.

    Values are counted by bucket in their tasks. Shares only grow, so those before and after a bucket tell how great a gap
    inside it can be at most; only buckets that can hold a greater gap than the one found at the ends of all are looked
    into value by value, their values summed in order by two levels.
    """
    sides = [expected.select(F.col(c).cast("double").alias("v")), actual.select(F.col(d).cast("double").alias("v"))]
    counted = [bucket_counts(side)[0] for side in sides]
    buckets = np.union1d(counted[0][0], counted[1][0])
    n = np.zeros((2, len(buckets)), np.int64)
    for own, (at, count, _) in zip(n, counted, strict=True):
        own[np.searchsorted(buckets, at)] = count
    after, total = n.cumsum(axis=1), n.sum(axis=1)
    if not total.all():
        return expected.sparkSession.range(1).select(F.lit(None).cast("double").alias("ks_gap"))
    before = after - n
    shares = lambda x: x / total[:, None]
    low, high = shares(before), shares(after)
    least = float(np.abs(high[0] - high[1]).max())
    opened = np.maximum(high[0] - low[1], high[1] - low[0]) > least
    if not opened.any():
        return expected.sparkSession.range(1).select(F.round(F.lit(least), 6).alias("ks_gap"))
    sought, inside = buckets[opened], n[:, opened]
    skipped = before[:, opened] - (inside.cumsum(axis=1) - inside)  # rows in buckets that are not looked into, up to each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False) + 0.0
            bucket = buckets_of(v)
            at = np.searchsorted(sought, bucket).clip(max=len(sought) - 1)
            kept = sought[at] == bucket
            own = at[kept]
            yield pa.RecordBatch.from_arrays([pa.array(v[kept]), batch.column(1).filter(pa.array(kept)), pa.array(skipped[0][own]), pa.array(skipped[1][own])], names=["v", "e", "skipped_e", "skipped_a"])

    rows = sides[0].withColumn("e", F.lit(1)).unionByName(sides[1].withColumn("e", F.lit(0))).where("v is not null")
    values = rows.mapInArrow(run, "v double, e int, skipped_e long, skipped_a long").groupBy("v", "skipped_e", "skipped_a").agg(F.sum("e").alias("e"), F.sum(1 - F.col("e")).alias("a"))
    sums = running_sums(values, "v", "e", "a")
    shares = [(F.col(f"before_{x}") + F.col(f"skipped_{x}")) / F.lit(int(t)) for x, t in zip("ea", total, strict=True)]
    return sums.agg(F.round(F.greatest(F.lit(least), F.max(F.abs(shares[0] - shares[1]))), 6).alias("ks_gap"))


def _ranks(df: DataFrame, c: str) -> DataFrame:
    """(value, rank): the mean rank, from 1, of all rows with a value."""
    counts = df.groupBy(F.col(c).alias(f"_{c}")).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, f"_{c}", "n").select(f"_{c}", (F.col("before_n") - (F.col("n") - 1) / 2).alias(f"rank_{c}"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """correlation: that of the ranks of two columns, ties sharing their mean rank, over rows that have both.

    Equal pairs are counted first, so a frequent pair is one row of the joins with the ranks.
    """
    own = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    pairs = own.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    ranked = pairs.join(_ranks(own, "x"), F.col("x") == F.col("_x")).join(_ranks(own, "y"), F.col("y") == F.col("_y"))
    total = own.agg(((F.count(F.lit(1)) + 1) / 2).alias("_mean"))
    a, b, w = F.col("rank_x") - F.col("_mean"), F.col("rank_y") - F.col("_mean"), F.col("w")
    sums = ranked.join(F.broadcast(total)).agg(F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    return sums.select(F.round(F.col("ab") / F.nullif(F.sqrt(F.col("aa") * F.col("bb")), F.lit(0.0)), 6).alias("correlation"))


def correlation_bounds(df: DataFrame, x: str, y: str) -> tuple[float, float] | None:
    """Between which numbers ``rank_correlation`` lies, without a shuffle of values; None if a column has but one bucket.

    A row's rank is the mean rank of its bucket and a rest. Rests sum to nothing in each bucket, so the ranks' squares are those of
    the means and of the rests, and the rests' squares are at most those of a bucket without ties, and nothing for one value.
    What rests add to the products is at most the product of the lengths (Cauchy-Schwarz).
    """
    own = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    found = bucket_counts(own)
    means, squares, rests = [], [], []
    for _, n, one in found:
        n = n.astype(float)
        means.append(n.cumsum() - n / 2 - n.sum() / 2)
        squares.append(float((n * means[-1] ** 2).sum()))
        rests.append(float(np.where(one, 0.0, n**3 - n).sum()) / 12)
    if not all(squares):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, N_BUCKETS))
        for table, (bucket, *_), mean in zip(tables, found, means, strict=True):
            table[bucket] = mean
        total = 0.0
        for batch in batches:
            a, b = (table[buckets_of(column.to_numpy(zero_copy_only=False))] for table, column in zip(tables, batch.columns, strict=True))
            total += float(a @ b)
        yield pa.RecordBatch.from_pydict({"product": [total]})

    product = own.mapInArrow(run, "product double").agg(F.sum("product")).first()[0]
    (aa, bb), (da, db) = squares, rests
    rest = math.sqrt(da * bb) + math.sqrt(aa * db) + math.sqrt(da * db)
    least, most = math.sqrt(aa * bb), math.sqrt((aa + da) * (bb + db))
    low, high = product - rest, product + rest
    return low / (most if low > 0 else least), high / (least if high > 0 else most)


#: Six places of two correlations, and what doubles lose in their bounds.
_ROUNDING = 2e-6


def correlations_near(expected: DataFrame, actual: DataFrame, x: str, y: str, tolerance: float) -> DataFrame:
    """held: whether the rank correlations of two frames differ by no more than the tolerance.

    Bounds decide it without a shuffle of values where they lie clear of the tolerance; else both are worked out.
    """
    e, a = (correlation_bounds(df, x, y) for df in (expected, actual))
    if e and a:
        least, most = max(e[0] - a[1], a[0] - e[1]), max(e[1] - a[0], a[1] - e[0])
        if most < tolerance - _ROUNDING or least > tolerance + _ROUNDING:
            return expected.sparkSession.range(1).select(F.lit(most < tolerance).alias("held"))
    e, a = (rank_correlation(df, x, y).toDF(n) for df, n in ((expected, "e"), (actual, "a")))
    return e.join(a).select((F.abs(F.col("e") - F.col("a")) <= tolerance).alias("held"))


def rows_per_parent(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Child rows over parent rows, 0 without parents."""
    n = child.agg(F.count(F.lit(1)).cast("double").alias("_c")).join(F.broadcast(parent.agg(F.count(F.lit(1)).cast("double").alias("_p"))))
    return n.select(F.coalesce(F.col("_c") / F.nullif(F.col("_p"), F.lit(0.0)), F.lit(0.0)).alias("ratio"))


def within_relative(expected: Column, actual: Column, tolerance: float = TOLERANCE) -> Column:
    """Ratios: relative to the expected one in percent; an expected 0 asks for 0."""
    near_zero = F.abs(expected) < 1e-9
    return F.when(near_zero, F.abs(actual) < 1e-9).otherwise(F.abs(actual - expected) * 100 <= tolerance * F.abs(expected))


def within_absolute(expected: Column, actual: Column, tolerance: float = TOLERANCE) -> Column:
    """Rates: percentage points."""
    return F.abs(actual - expected) <= tolerance


def check(name: str, kind: str, expected: DataFrame, actual: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One check row from one-row, one-column frames. kind: ``ratio`` or ``rate``."""
    e, a = expected.select(F.col(expected.columns[0]).cast("double").alias("expected")), actual.select(F.col(actual.columns[0]).cast("double").alias("actual"))
    rule = within_relative if kind == "ratio" else within_absolute
    passed = rule(F.coalesce("expected", F.lit(0.0)), F.coalesce("actual", F.lit(0.0)), tolerance)
    return e.join(F.broadcast(a)).select(F.lit(name).alias("check"), F.lit(kind).alias("kind"), F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"), passed.alias("passed"))


def _rates(df: DataFrame, table: str, columns: Mapping[str, Mapping[str, Any]]) -> DataFrame | None:
    """Null and true rates of all columns by one aggregate."""
    found = []
    for name, stats in sorted(columns.items()):
        share = lambda x: F.coalesce(percent(F.count_if(x), F.count(F.lit(1))), F.lit(0.0))
        if stats["type"] == "boolean":
            found.append(("true_rate", name, stats["true_rate"], share(F.col(name))))
        if "null_rate" in stats:
            found.append(("null_rate", name, stats["null_rate"], share(F.col(name).isNull())))
    if not found:
        return None
    one = df.agg(F.array(*[F.struct(F.lit(kind).alias("check"), F.lit(table).alias("table"), F.lit(name).alias("subject"), F.lit(float(expected or 0)).alias("expected"), actual.alias("actual")) for kind, name, expected, actual in found]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


def _drifts(df: DataFrame, table: str, columns: Mapping[str, Mapping[str, Any]]) -> DataFrame | None:
    """Greatest gap of each categorical column, all by one grouping of (column, value)."""
    known = {name: stats["distribution"] for name, stats in sorted(columns.items()) if stats["type"] == "categorical"}
    if not known:
        return None
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).cast("string").alias("value")) for c in known]))
    counts = df.select(pairs.alias("x")).select("x.*").where("value is not null").groupBy("subject", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("subject").agg(F.sum("n").alias("total"))
    actual = counts.join(F.broadcast(totals), "subject").select("subject", "value", percent(F.col("n"), F.col("total")).alias("a"))  # one row for each column
    rows = [(c, str(k), float(w)) for c, d in known.items() for k, w in d.items()] or [("", "", 0.0)]
    expected = df.sparkSession.createDataFrame(rows, "subject string, value string, e double")
    gap = F.abs(F.coalesce("e", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)))
    gaps = expected.join(actual, ["subject", "value"], "full_outer").groupBy("subject").agg(F.max(gap).alias("actual"))
    return gaps.where(F.col("subject").isin(list(known))).select(F.lit("distribution").alias("check"), F.lit(table).alias("table"), "subject", F.lit(0.0).alias("expected"), "actual")


def profile_checks(profile: Mapping[str, Any], frames: Mapping[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """(check, table, subject, expected, actual, passed): every check that a profile document asks of tables.

    ``ratio``: child rows over parent rows, expected the profile's average over parents that have
    any times the share of those that have (relative tolerance). ``null_rate``, ``true_rate`` and
    ``distribution`` (the greatest gap of a value) are held in percentage points. Tables that
    ``frames`` lacks are not checked; skipped and serial columns ask for nothing. A table is read
    twice, whatever its number of columns.
    """
    parts = []
    for table, t in sorted(profile["tables"].items()):
        if table not in frames:
            continue
        df = frames[table]
        columns = {c: s for c, s in t.get("columns", {}).items() if c in df.columns}
        parts += [x for x in (_rates(df, table, columns), _drifts(df, table, columns)) if x is not None]
        for key, r in sorted((t.get("parent_ratios") or {}).items()):
            parent = key.split(".")[0]
            if parent in frames:
                expected = float(r["avg"]) * (1 - float(r.get("zero_rate") or 0.0) / 100)
                actual = rows_per_parent(df.select(F.lit(1)), frames[parent].select(F.lit(1)))
                parts.append(actual.select(F.lit("ratio").alias("check"), F.lit(table).alias("table"), F.lit(key).alias("subject"), F.lit(expected).alias("expected"), F.col("ratio").alias("actual")))
    if not parts:
        raise ValueError("the profile asks nothing of these tables")
    passed = F.when(F.col("check") == "ratio", within_relative(F.col("expected"), F.col("actual"), tolerance)).otherwise(within_absolute(F.col("expected"), F.col("actual"), tolerance))
    return report(parts).select("check", "table", "subject", F.round("expected", 6).alias("expected"), F.round("actual", 6).alias("actual"), passed.alias("passed"))


def report(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks in one frame."""
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


def summary(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
