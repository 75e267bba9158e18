"""Simulation over calendar buckets without a bucket loop.

Only tables depend on each other; buckets are rows. Entities meet entities by merge joins: compressed,
a large table of ids looks small enough to be broadcast, and isn't. A table of entities has id, created_b
(bucket of birth), created_at, churn_b (bucket of churn or null) and churned_at.
"""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.prf import draw, unit


def _months_on(d: date, months: int) -> date:
    year, month = divmod(d.year * 12 + d.month - 1 + months, 12)
    return date(year, month + 1, min(d.day, calendar.monthrange(year, month + 1)[1]))


def bucket_bounds(start: date, end: date, unit_name: str) -> list[tuple[int, date, date]]:
    """[start, end) of each bucket, emitted while its start is before ``end``. Months step one by one, the day being held to the month's length each time."""
    steps = {"day": lambda d: d + timedelta(days=1), "week": lambda d: d + timedelta(days=7), "month": lambda d: _months_on(d, 1), "quarter": lambda d: _months_on(d, 3)}
    out, at = [], start
    while at < end:
        after = steps[unit_name](at)
        out.append((len(out), at, after))
        at = after
    return out


def buckets(spark: SparkSession, start: date, end: date, unit_name: str = "month") -> DataFrame:
    return spark.createDataFrame(bucket_bounds(start, end, unit_name), "b int, b_start date, b_end date")


def label(b_start: Column, unit_name: str = "month") -> Column:
    return F.date_format(b_start, "yyyy-MM" if unit_name in ("month", "quarter") else "yyyy-MM-dd")


def _whole(x: Column) -> Column:
    """Nearest whole number, halves away from zero, nothing below zero."""
    return F.when(x > 0, F.floor(x + 0.5)).otherwise(F.lit(0)).cast("long")


def linear(b: Column, initial: float, rate: float) -> Column:
    return _whole(F.lit(float(initial)) + F.lit(float(rate)) * b)


def exponential(b: Column, initial: float, rate: float) -> Column:
    return _whole(F.lit(float(initial)) * F.pow(F.lit(1.0 + rate), b))


def logistic(b: Column, initial: float, capacity: float, rate: float, midpoint: float | Column) -> Column:
    """Held between 0 and the capacity, and at bucket 0 not under the initial population."""
    if capacity <= 0:
        return F.lit(0).cast("long")
    value = F.lit(float(capacity)) / (1 + F.exp(F.lit(-float(rate)) * (b - midpoint)))
    cap = _whole(F.lit(float(capacity)))
    floor = F.when(b == 0, F.least(_whole(F.lit(float(initial))), cap)).otherwise(F.lit(0))
    return F.least(F.greatest(_whole(value), floor), cap)


def s_curve(b: Column, initial: float, capacity: float, rate: float) -> Column:
    middle = F.log(F.lit(float(capacity) / float(initial))) / F.lit(float(rate)) if initial > 0 and capacity > 0 and rate else F.lit(0.0)
    return logistic(b, initial, capacity, rate, middle)


def custom(b: Column, values: Sequence[int]) -> Column:
    """New entities by bucket; 0 beyond the list."""
    return F.coalesce(F.get(F.array(*[F.lit(int(v)) for v in values]), b.cast("int")), F.lit(0)).cast("long")


def season(b_start: Column, monthly: Sequence[float] = (), quarterly: Sequence[float] = (), weekly: Sequence[float] = ()) -> Column:
    """The factor of a bucket's first day; 1 where a list does not reach."""
    for values, at in ((monthly, F.month(b_start) - 1), (quarterly, F.quarter(b_start) - 1), (weekly, F.weekday(b_start))):
        if values:
            return F.coalesce(F.get(F.array(*[F.lit(float(v)) for v in values]), at), F.lit(1.0))
    return F.lit(1.0)


def new_counts(bucket_table: DataFrame, target: Column, cumulative: bool = True, factor: Column | None = None) -> DataFrame:
    """Bucket columns and ``new``: the rise of a cumulative target, or the target itself, times the season."""
    before = F.lag(target, 1, 0).over(Window.partitionBy().orderBy("b"))
    new = F.greatest(target - before, F.lit(0)) if cumulative else target
    return bucket_table.withColumn("new", _whole(new * (F.lit(1.0) if factor is None else factor)))


def _time_in_bucket(key: str, seed: int, i: Column) -> Column:
    start = F.col("b_start").cast("timestamp_ntz")
    span = F.datediff("b_end", "b_start").cast("long") * 86_400
    return F.timestamp_add("SECOND", (draw(seed, key, i) % span).cast("int"), start)


#: Entities are made in chunks of so many by so many tasks at least, and active parents numbered in runs of ids of this width.
CHUNK, TASKS, RUN = 100_000, 16, 1_000_000


def entities(counts: DataFrame, name: str, seed: int) -> DataFrame:
    """One row for each new entity: id (from 1 over all buckets), created_b, created_at.

    A bucket's rows come from chunks dealt over all tasks, so a large bucket is no large task. The
    number of tasks is stated, as the few bytes of the chunks themselves would all go to one.
    """
    first = F.coalesce(F.sum("new").over(Window.partitionBy().orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = counts.withColumn("_first", first).where("new > 0").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(new - 1) div {CHUNK}")))).repartition(max(TASKS, 2 * counts.sparkSession.sparkContext.defaultParallelism), "b", "_c")
    rows = chunks.withColumn("_k", F.explode(F.sequence(F.col("_c") * CHUNK + 1, F.least((F.col("_c") + 1) * CHUNK, F.col("new")))))
    rows = rows.withColumn("id", F.col("_first") + F.col("_k"))
    return rows.select("id", F.col("b").alias("created_b"), _time_in_bucket(f"{name}.created_at", seed, F.col("id")).alias("created_at"))


def churned(rows: DataFrame, bucket_table: DataFrame, name: str, seed: int, rate: float, grace: int = 0) -> DataFrame:
    """Add churn_b and churned_at: one geometric draw in place of a trial in every bucket.

    The first possible bucket is created_b + max(grace, 1). Null where it is after the last bucket.
    """
    first = F.col("created_b") + max(grace, 1)
    if rate <= 0:
        at = F.lit(None).cast("int")
    elif rate >= 1:
        at = first
    else:
        u = unit(draw(seed, f"{name}.churn", F.col("id")))
        at = (first + F.floor(F.log(1 - u) / F.log(F.lit(1.0 - rate)))).cast("int")
    bounds = bucket_table.select(F.col("b").alias("churn_b"), "b_start", "b_end")
    out = rows.withColumn("churn_b", at).join(F.broadcast(bounds), "churn_b", "left")  # one row for each bucket
    last = F.col("b_start").isNotNull()
    return out.select(*rows.columns, F.when(last, F.col("churn_b")).alias("churn_b"), F.when(last, _time_in_bucket(f"{name}.churned_at", seed, F.col("id"))).alias("churned_at"))


def active_counts(rows: DataFrame, bucket_table: DataFrame) -> DataFrame:
    """(b, born, churned, active, total): running sums over buckets, no row for each pair of entity and bucket."""
    born = rows.groupBy(F.col("created_b").alias("b")).agg(F.count(F.lit(1)).alias("born"))
    gone = rows.where("churn_b is not null").groupBy(F.col("churn_b").alias("b")).agg(F.count(F.lit(1)).alias("churned"))
    both = bucket_table.select("b").join(born, "b", "left").join(gone, "b", "left").na.fill(0, ["born", "churned"])
    upto = Window.partitionBy().orderBy("b")
    total = F.sum("born").over(upto)
    return both.select("b", "born", "churned", (total - F.sum("churned").over(upto)).alias("active"), total.alias("total"))


def active_pairs(rows: DataFrame, last_bucket: int) -> DataFrame:
    """(b, id): every bucket in which each entity is active, by explosion of its own interval."""
    until = F.least(F.coalesce(F.col("churn_b") - 1, F.lit(last_bucket)), F.lit(last_bucket))
    return rows.where(until >= F.col("created_b")).select(F.explode(F.sequence("created_b", until)).alias("b"), "id")


def follow_ratio(active: DataFrame, name: str, seed: int, ratio: float, variance: float = 0.0) -> DataFrame:
    """(b, new): active parents x ratio x (1 +- variance), one draw for each bucket."""
    spread = 1 + (2 * unit(draw(seed, f"{name}.variance", F.col("b"))) - 1) * F.lit(float(variance)) if variance > 0 else F.lit(1.0)
    return active.select("b", _whole(F.col("active") * F.lit(float(ratio)) * spread).alias("new"))


def follow_per_parent(pairs: DataFrame, name: str, seed: int, low: int, high: int) -> DataFrame:
    """(b, new): every active parent has low..high children in every bucket."""
    low, high = min(low, high), max(low, high)
    key = F.concat_ws(":", F.col("id").cast("string"), F.col("b").cast("string"))
    return pairs.groupBy("b").agg(F.sum(F.lit(low) + draw(seed, f"{name}.children", key) % (high - low + 1)).alias("new"))


#: Keyframes are written by hand; so many dates fit into one array.
MAX_KEYFRAMES = 10_000


def interpolated(keyframes: DataFrame, dates: DataFrame) -> DataFrame:
    """(d, key, weight): weights at each date, linear between keyframes (at, key, weight), held outside.

    A key that a keyframe lacks has weight 0 there. The keyframes' dates come to each date as one
    array (of MAX_KEYFRAMES at most, else the query fails), so no date meets each keyframe as a row.
    """
    ats = F.sort_array(F.collect_set("at"))
    ats = keyframes.agg(F.when(F.size(ats) <= MAX_KEYFRAMES, ats).otherwise(F.raise_error(F.lit("too many keyframes"))).alias("_ats"))
    lo = F.array_max(F.filter("_ats", lambda x: x <= F.col("d")))
    hi = F.array_min(F.filter("_ats", lambda x: x >= F.col("d")))
    around = dates.select("d").distinct().join(F.broadcast(ats)).select("d", F.coalesce(lo, hi).alias("lo"), F.coalesce(hi, lo).alias("hi"))
    a = around.join(keyframes, F.col("lo") == F.col("at")).select("d", "key", F.col("weight").alias("wa"))
    b = around.join(keyframes, F.col("hi") == F.col("at")).select("d", "key", F.col("weight").alias("wb"))
    both = a.join(b, ["d", "key"], "full_outer").join(around, "d")
    share = F.coalesce(F.datediff("d", "lo") / F.nullif(F.datediff("hi", "lo").cast("double"), F.lit(0.0)), F.lit(0.0))
    wa, wb = F.coalesce("wa", F.lit(0.0)), F.coalesce("wb", F.lit(0.0))
    return both.select("d", "key", F.round(wa + (wb - wa) * share, 6).alias("weight"))


def relative_time(parent_ts: Column, h: Column, relation: str, low_s: int, high_s: int) -> Column:
    """A time after, before or at the parent's by a uniform number of seconds; swapped bounds are put in order."""
    low_s, high_s = min(low_s, high_s), max(low_s, high_s)
    off = (F.lit(low_s) + h % (high_s - low_s + 1)).cast("int")
    return {"after": F.timestamp_add("SECOND", off, parent_ts), "before": F.timestamp_add("SECOND", -off, parent_ts), "equals": parent_ts}[relation]


def clamped(ts: Column, parent_ts: Column, b_start: Column, b_end: Column, relation: str = "after") -> Column:
    """Into the bucket: not before the parent or the bucket's start, not after its last second.

    "equals" is left alone; "before" is held to the upper bound only, as it could not hold otherwise.
    """
    if relation == "equals":
        return ts
    upper = F.timestamp_add("SECOND", F.lit(-1), b_end.cast("timestamp_ntz"))
    if relation == "before":
        return F.least(ts, upper)
    lower = F.greatest(parent_ts, b_start.cast("timestamp_ntz"))
    return F.least(F.greatest(ts, lower), F.greatest(upper, lower))


def _numbered(pairs: DataFrame) -> DataFrame:
    """Pairs with _n, their number from 0 by id in their bucket: numbered in runs of ids, which are then shifted."""
    run = pairs.withColumn("_run", F.expr(f"id div {RUN}"))
    before = Window.partitionBy("b").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = run.groupBy("b", "_run").agg(F.count(F.lit(1)).alias("_c")).select("b", "_run", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("b", "_run").orderBy("id"))
    return run.withColumn("_in", inside).join(starts, ["b", "_run"]).select("b", "id", (F.col("_start") + F.col("_in") - 1).alias("_n"))


def renumbered(rows: DataFrame) -> DataFrame:
    """Rows (id, created_b, ...) with ids from 1 without gaps, in the order of buckets and old ids."""
    numbered = _numbered(rows.select(F.col("created_b").alias("b"), "id"))
    sizes = rows.groupBy(F.col("created_b").alias("b")).agg(F.count(F.lit(1)).alias("_c"))
    first = F.coalesce(F.sum("_c").over(Window.partitionBy().orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = numbered.join(F.broadcast(sizes.select("b", first.alias("_first"))), "b").select("id", (F.col("_first") + F.col("_n") + 1).alias("_id"))  # one row for each bucket
    return rows.join(ids.hint("merge"), "id").withColumn("id", F.col("_id")).select(*rows.columns)


def with_active_parent(rows: DataFrame, pairs: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """Give each row a parent drawn among those active in its bucket: (bucket, number) is joined.

    ``pairs`` are the active parents (b, id), which are numbered within their bucket. Rows of
    buckets without an active parent go.
    """
    sizes = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_size")).withColumnRenamed("b", "created_b")
    drawn = rows.join(F.broadcast(sizes), "created_b").withColumn("_n", draw(seed, key, F.col("id")) % F.col("_size")).drop("_size")
    numbered = _numbered(pairs).select(F.col("b").alias("created_b"), F.col("id").alias(column), "_n")
    return drawn.join(numbered.hint("merge"), ["created_b", "_n"]).drop("_n")


def with_born_parent(rows: DataFrame, totals: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """As ``with_active_parent``, among all that are born by then, churned or not.

    Ids run over all buckets in order of birth, so the draw is the id; ``totals`` has (b, total).
    """
    totals = totals.select(F.col("b").alias("created_b"), F.col("total").alias("_total")).where("_total > 0")
    return rows.join(F.broadcast(totals), "created_b").withColumn(column, draw(seed, key, F.col("id")) % F.col("_total") + 1).drop("_total")


def children(counts: DataFrame, pairs: DataFrame, parents: DataFrame, bucket_table: DataFrame, name: str, seed: int, relation: str = "after", low_s: int = 0, high_s: int = 0) -> DataFrame:
    """(id, created_b, parent_id, created_at): each child's parent is drawn among those active in its bucket."""
    rows = entities(counts.join(bucket_table, "b"), name, seed).drop("created_at")
    chosen = with_active_parent(rows, pairs, "parent_id", f"{name}.parent", seed)
    return with_time_by_parent(chosen, parents.select("id", F.col("created_at").alias("at")), "parent_id", "created_at", bucket_table, f"{name}.offset", seed, relation, low_s, high_s)


def with_time_by_parent(rows: DataFrame, times: DataFrame, fk: str, column: str, bucket_table: DataFrame, key: str, seed: int, relation: str, low_s: int, high_s: int) -> DataFrame:
    """Set ``column`` relative to the parent's time (``times``: id, at), held to the row's bucket.

    Rows without a parent, or whose parent has no time, keep what they have.
    """
    times = times.select(F.col("id").alias("_pid"), F.col("at").cast("timestamp_ntz").alias("_born"))
    bounds = bucket_table.select(F.col("b").alias("created_b"), "b_start", "b_end")
    met = rows.join(times.hint("merge"), F.col(fk) == F.col("_pid"), "left").join(F.broadcast(bounds), "created_b")  # one row for each bucket
    ts = relative_time(F.col("_born"), draw(seed, key, F.col("id")), relation, low_s, high_s)
    own = F.col(column) if column in rows.columns else F.lit(None).cast("timestamp_ntz")
    value = F.coalesce(clamped(ts, F.col("_born"), F.col("b_start"), F.col("b_end"), relation), own)
    return met.withColumn(column, F.when(F.col("_born").isNotNull(), value).otherwise(own)).select(*[c for c in rows.columns if c != column], column)
