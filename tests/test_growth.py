"""Steps whose cost must grow no faster than their input."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import discovery, profile, relations, states


def test_bits_are_read_not_computed(spark):
    xs = [-math.inf, -1.5, -2.0**-1030, -5e-324, 0.0, -0.0, 5e-324, 2.0**-1022, 0.1, 1.0, 3.5, 1e300, math.inf, math.nan]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", profile.ordered_bits(F.col("x")).alias("b")).orderBy("i").collect()
    assert profile.bits_of(np.array(xs)).tolist() == [r.b for r in rows]


def test_percentile_scans_hand_over_counts_only(spark):
    """A task gives a row for each digit it met, not one for each value."""
    df = spark.range(40_000, numPartitions=2).select((F.col("id") % 100).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, -F.col("id").cast("double")).alias("y"))
    counts = profile._digit_counts(df, [[0], [0]], 48)
    assert "Generate" not in counts._jdf.queryExecution().toString()
    assert {r.i: r.n for r in counts.groupBy("i").agg(F.sum("n").alias("n")).collect()} == {0: 40_000, 1: 20_000}
    got = {r["column"]: tuple(r)[1:] for r in profile.percentiles(df, ["x", "y"]).collect()}
    for name, values in (("x", [i % 100 for i in range(40_000)]), ("y", [-float(i) for i in range(0, 40_000, 2)])):
        assert got[name] == tuple(round(float(q), 6) for q in np.quantile(values, profile.PERCENTILES))


def test_merged_means_are_of_exact_sums(spark):
    """Three values whose sum in doubles depends on their order, dealt over parts."""
    df = spark.createDataFrame([(0, 1e16), (1, 1.0), (2, -1e16), (0, 1.0), (1, 1.0), (2, None)], "part int, x double")
    for parts in ([df], [df.where(f"part = {k}") for k in range(3)]):
        state = states.merged(states.union(states.states(p, ["x"]) for p in parts))
        row = states.numeric_profile(state).first()
        assert (row.n, row.mean_val, row.min_val, row.max_val) == (5, 0.6, -1e16, 1e16)
    high, low = states.exact_sum(np.array([0.1] * 10 + [1e17, -1e17]))
    assert high + low == math.fsum([0.1] * 10)


def test_two_coordinates_look_their_shifts_up(spark):
    """No row is hashed: the plan draws over the parents' numbers only, with the same combinations as row by row."""
    rows = spark.range(60).withColumnRenamed("id", "row_no")
    got = relations.unique_combinations(rows, "row_no", [10, 7], ["a", "b"], "stock", 42)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2 * relations.ROUNDS

    def shift(key, x, n):
        return int(hashlib.md5(f"42|{key}|{x}|0".encode()).hexdigest()[:13], 16) % n

    for r in got.collect():
        a, b = r.row_no % 10, r.row_no // 10 % 7
        for k in range(relations.ROUNDS):
            a = (a + shift(f"stock.{k}.0", b, 10)) % 10
            b = (b + shift(f"stock.{k}.1", a, 7)) % 7
        assert (r.a, r.b) == (a, b)


def test_unique_sets_count_only_what_survives(spark, monkeypatch):
    """Sets refuted by the first rows are not counted whole; one duplicate far from them still counts."""
    monkeypatch.setattr(discovery, "HEAD", 50)
    i = F.col("id")
    df = spark.range(1000, numPartitions=2).select((i % 500).alias("a"), F.when(i == 999, 0).otherwise(F.floor(i / 500)).alias("b"), (i % 5).alias("c"), F.when(i != 5, i).alias("d"))
    whole, real = [], discovery._grouped
    monkeypatch.setattr(discovery, "_grouped", lambda d, sets, slices: (whole.extend(sets) if slices == 1 and d is df else None, real(d, sets, slices))[1])
    assert discovery.unique_sets(df) == [(("d",), False)]
    assert ("c",) not in whole and ("a", "c") not in whole
