"""As-of and interval joins of tables, and counts of open intervals.

Rows are dealt by range of (key, time), so a key with most of the rows lies in many ranges. What
has to pass from one range to the next is one value a range (as-of) or one sum a range (sweep).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import materialize

#: Times are compared as microseconds; an interval of the least level is no longer than a bin of so many.
LEAST_BIN = 1 << 20


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_time: str, right_time: str, columns: Sequence[str], ties: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Every left row with the named columns of the last right row of its key whose time is not later (earlier, if strict).

    Of right rows of one key and time the one with the greatest ``ties`` counts. Null keys or times match nothing
    and left rows without a match have nulls there; repeated left rows stay. Both sides are shuffled once
    by range and once by (range, key); per range one right row is carried to those after it.
    """
    own = [F.col(f"`{a}`") for a, _ in keys]
    names = [f"_k{i}" for i in range(len(keys))]
    found = F.struct(*[F.col(f"`{c}`") for c in columns])
    tie = F.struct(*[F.col(f"`{c}`") for c in ties]) if ties else F.struct(F.lit(0).alias("none"))
    r = right.select(*[F.col(f"`{b}`").alias(n) for (_, b), n in zip(keys, names, strict=True)], _micros(F.col(f"`{right_time}`")).alias("_t"), F.lit(1 if strict else 0).alias("_side"), tie.alias("_tie"), found.alias("_r")).dropna(subset=[*names, "_t"])
    r = r.groupBy(*names, "_t", "_side").agg(F.max_by("_r", "_tie").alias("_r"))
    l = left.select(*[c.alias(n) for c, n in zip(own, names, strict=True)], _micros(F.col(f"`{left_time}`")).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"))
    order = [*names, "_t", "_side"]
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_spread", F.monotonically_increasing_id())
    dealt = materialize(both.repartitionByRange(*order, "_spread").withColumn("_range", F.spark_partition_id()), "asof")
    # In its range a row sees what stands before it; the last right row of each range's last key is what goes on.
    last = dealt.groupBy("_range").agg(F.max(F.struct(*names)).alias("_key"))
    ends = dealt.where("_r is not null").join(F.broadcast(last), "_range").where(F.struct(*names) == F.col("_key"))  # a row for each range
    ends = ends.groupBy("_range", *names).agg(F.max_by("_r", "_t").alias("_carried"))
    # A key that ends several ranges: the nearest range before that has a right row counts.
    firsts = dealt.groupBy("_range").agg(F.min(F.struct(*names)).alias("_key")).select("_range", "_key.*", F.lit(None).cast(dealt.schema["_r"].dataType).alias("_carried"))
    before = Window.partitionBy(*names).orderBy("_range", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    marks = firsts.withColumn("_kind", F.lit(0)).unionByName(ends.withColumn("_kind", F.lit(1)))
    carried = marks.withColumn("_before", F.last("_carried", ignorenulls=True).over(before)).where("_kind = 0 and _before is not null").select("_range", *names, "_before")
    here = Window.partitionBy("_range", *names).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("_seen", F.last("_r", ignorenulls=True).over(here)).where("_l is not null")
    out = seen.join(F.broadcast(carried), ["_range", *names], "left")  # a row for each range at most
    match = F.when(F.col("_t").isNotNull(), F.coalesce("_seen", "_before"))
    return out.select("_l.*", *[match[c].alias(c if c not in left.columns else f"{c}_right") for c in columns])


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, keys: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of a point and an interval with start <= at < end, and equal keys, if any; columns of both, those of the interval
    with _right behind where names clash.

    An interval's level is the least whose bins are as long as it, so it lies in two bins of that level at
    most; a point looks into its one bin of each level that occurs. A long interval among short ones makes no
    more rows than they do. Null times, ends not after starts and null keys match nothing.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    marked = lambda df, mark: [F.col(f"`{x}`").alias(f"_{mark}{n}") for n, x in enumerate(df.columns)]
    s, e = _micros(F.col(f"`{start}`")), _micros(F.col(f"`{end}`"))
    wide = intervals.select(s.alias("_s"), e.alias("_e"), *[F.col(f"`{b}`").alias(n) for (_, b), n in zip(keys, names, strict=True)], *marked(intervals, "i")).where("_s < _e")
    length = F.ceil(F.log2((F.col("_e") - F.col("_s")) / F.lit(float(LEAST_BIN)))).cast("int")
    wide = wide.withColumn("_level", F.greatest(length, F.lit(0)) + 1)  # one more than needed, against rounding
    size = F.expr(f"shiftleft({LEAST_BIN}L, _level)")
    binned = wide.withColumn("_bin", F.explode(F.array_distinct(F.array(F.floor(F.col("_s") / size), F.floor((F.col("_e") - 1) / size)))))
    levels = wide.groupBy().agg(F.collect_set("_level").alias("_levels"))  # 50 at most
    probes = points.select(_micros(F.col(f"`{at}`")).alias("_p"), *[F.col(f"`{a}`").alias(n) for (a, _), n in zip(keys, names, strict=True)], *marked(points, "o")).where("_p is not null")
    probes = probes.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")  # one row beside
    probes = probes.withColumn("_bin", F.floor(F.col("_p") / size))
    pairs = probes.join(binned, [*names, "_level", "_bin"]).where("_p >= _s and _p < _e")
    own = [F.col(f"_o{n}").alias(c) for n, c in enumerate(points.columns)]
    return pairs.select(*own, *[F.col(f"_i{n}").alias(c if c not in points.columns else f"{c}_right") for n, c in enumerate(intervals.columns)])


def running_sums(deltas: DataFrame, order: str, *values: str) -> DataFrame:
    """deltas (one row for each ``order``) with ``before_`` and a value's name: its sum over all rows up to this one, by two levels.

    Rows are dealt by range, each range sums alone, and starts where those before it end.
    """
    dealt = materialize(deltas.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "sweep")
    sums = dealt.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_start_{v}") for v in values])  # a row for each range
    here = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.select("*", *[F.sum(v).over(here).alias(f"_here_{v}") for v in values]).join(F.broadcast(starts), "_range")
    return own.select(*deltas.columns, *[(F.col(f"_start_{v}") + F.col(f"_here_{v}")).alias(f"before_{v}") for v in values])


def open_counts(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str) -> DataFrame:
    """points with ``n_open``: how many intervals have start <= at < end; no pair of both is made.

    Starts and ends are counted by time, which combines before the shuffle, and summed in time's order; points
    are joined with the sums by their own distinct times. A null time has a null count; empty or reversed intervals
    and those with a null end count nowhere.
    """
    s, e = _micros(F.col(f"`{start}`")), _micros(F.col(f"`{end}`"))
    both = intervals.select(s.alias("s"), e.alias("e")).where("s < e")
    steps = both.select(F.explode(F.array(F.struct(F.col("s").alias("_t"), F.lit(1).alias("_step")), F.struct(F.col("e").alias("_t"), F.lit(-1).alias("_step")))).alias("x")).select("x.*")
    p = points.withColumn("_t", _micros(F.col(f"`{at}`")))
    asked = p.where("_t is not null").select("_t", F.lit(0).alias("_step"))
    changes = steps.unionByName(asked).groupBy("_t").agg(F.sum("_step").alias("_step"))
    sums = running_sums(changes, "_t", "_step").select("_t", F.col("before__step").alias("n_open"))
    return p.join(sums, "_t", "left").drop("_t")


def days(frame: DataFrame, first: str, last: str) -> DataFrame:
    """(day): every day from the least ``first`` to the greatest ``last``, as timestamps at midnight."""
    ends = frame.agg(F.to_date(F.min(F.col(first))).alias("a"), F.to_date(F.max(F.col(last))).alias("b"))
    return ends.where("a is not null and b is not null").select(F.explode(F.sequence("a", "b")).alias("day")).select(F.col("day").cast("timestamp_ntz").alias("day"))
