"""Discovery, as-of and interval joins against plain Python."""

from __future__ import annotations

import bisect
import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import discovery, profile, relations, states, temporal
from millrace.plans.schema import ForeignKey

T0 = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def _events(spark, rows, names):
    return spark.createDataFrame([(k, at(t), *rest) for k, t, *rest in rows], f"k string, t timestamp_ntz, {names}")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_asof_equals_loops(spark, strict, hot):
    """With one key that has 90 % of the rows, ties, nulls and repeated rows."""
    r = random.Random(hot * 2 + strict)
    key = lambda: "hot" if hot and r.random() < 0.9 else r.choice(["a", "b", "c", None])
    left = [(key(), r.choice([None, *range(-5, 400)]), i % 50) for i in range(900)]
    right = [(key(), r.choice([None, *range(0, 400, 3)]), i) for i in range(500)]
    got = temporal.asof_join(_events(spark, left, "id int").repartition(7), _events(spark, right, "v int").repartition(5), [("k", "k")], "t", "t", ["v", "t"], ["v"], strict).collect()
    want = []
    for k, t, i in left:
        fits = [(s, v) for q, s, v in right if q == k and None not in (k, t, s) and (s < t if strict else s <= t)]
        s, v = max(fits, default=(None, None))
        want.append((k, at(t), i, v, at(s)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_asof_of_empty_tables(spark):
    some, none = _events(spark, [("a", 1, 5)], "v int"), _events(spark, [], "v int")
    assert [tuple(r) for r in temporal.asof_join(some, none, [("k", "k")], "t", "t", ["v"]).collect()] == [("a", at(1), 5, None)]
    assert temporal.asof_join(none, some, [("k", "k")], "t", "t", ["v"]).collect() == []


def test_asof_deals_a_hot_key_over_ranges(spark):
    rows = _events(spark, [("hot", i, i) for i in range(4000)], "v int")
    dealt = rows.repartitionByRange(8, "k", "t").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 1500
    got = temporal.asof_join(rows, rows.where("v % 1000 = 0"), [("k", "k")], "t", "t", ["v"]).where("v_right <> v - v % 1000 or v_right is null")
    assert got.count() == 0


def test_intervals_equal_loops(spark):
    r = random.Random(8)
    points = [(r.choice("ab"), r.choice([None, *range(3000)]), i) for i in range(150)] + [("a", 0, 1000), ("a", 10**8, 1001)]
    spans = [(r.choice(["a", "b", None]), s := r.randrange(3000), r.choice([None, s, s - 5, s + 1, s + r.randrange(1, 60), s + r.randrange(1, 3000)]), i) for i in range(300)] + [("a", 0, 10**8, 1)]
    p = spark.createDataFrame([(k, at(t), i) for k, t, i in points], "k string, t timestamp_ntz, id int")
    s = spark.createDataFrame([(k, at(a), at(b), i) for k, a, b, i in spans], "k string, a timestamp_ntz, b timestamp_ntz, id int")
    fits = [(x, y) for x, y in itertools.product(points, spans) if None not in (x[1], y[1], y[2]) and y[1] <= x[1] < y[2]]
    keyed = temporal.interval_join(p, "t", s, "a", "b", [("k", "k")])
    assert keyed.columns == ["k", "t", "id", "k_right", "a", "b", "id_right"]
    assert sorted((r.id, r.id_right) for r in keyed.collect()) == sorted((x[2], y[3]) for x, y in fits if x[0] == y[0])
    assert sorted((r.id, r.id_right) for r in temporal.interval_join(p, "t", s, "a", "b").collect()) == sorted((x[2], y[3]) for x, y in fits)
    opened = {r.id: r.n_open for r in temporal.open_counts(p, "t", s, "a", "b").collect()}
    assert opened == {x[2]: None if x[1] is None else sum(1 for q, _ in fits if q is x) for x in points}
    assert temporal.interval_join(p, "t", s.where("false"), "a", "b").count() == 0
    assert {r.n_open for r in temporal.open_counts(p.where("t is not null"), "t", s.where("false"), "a", "b").collect()} == {0}


def test_sweep_makes_no_pairs(spark):
    """Many intervals are open at once, and the plan joins on equal ranges and equal times only."""
    spans = spark.range(2000).select(F.lit(T0).cast("timestamp_ntz").alias("a"), F.timestamp_add("SECOND", F.lit(1).cast("int") + F.col("id").cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("b"))
    points = spark.range(2000).select("id", F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("t"))
    got = temporal.open_counts(points, "t", spans, "a", "b")
    assert got.where("n_open <> 2000 - id").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 2 and all(" = " in line and "<" not in line for line in joins)


def test_keys_of_small_tables(spark):
    shops = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, code string")
    sales = spark.createDataFrame([(10, 1, "x"), (11, 1, None), (12, 3, "q"), (13, None, "y")], "id long, shop_id long, code string")
    found = {(r.table, r.column, r.parent, r.parent_column): (r.coverage, r.named) for r in discovery.inclusions({"shops": shops, "sales": sales}, 0.5).collect()}
    assert found["sales", "shop_id", "shops", "id"] == (1.0, True) and found["sales", "code", "shops", "code"] == (0.666667, True)
    assert discovery.foreign_keys({"shops": shops, "sales": sales}) == [ForeignKey("sales", "shop_id", "shops", "id")]
    assert discovery.inclusions({"empty": shops.where("false")}).collect() == []
    assert discovery.inclusions({"odd": spark.createDataFrame([(0.5,)], "x double")}).collect() == []


def test_keys_of_many_columns(spark):
    """More columns than one integer has bits."""
    wide = spark.range(20).select("id", *[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(70)])
    found = discovery.inclusions({"wide": wide}, 1.0).collect()
    parents = {i for i in range(70) if i + 2 >= 20}
    assert {(r.column, r.parent_column) for r in found if r.parent_column == "id"} == {(f"c{i}", "id") for i in range(70)}
    assert {r.parent_column for r in found} == {"id", *(f"c{i}" for i in parents)}


def test_given_keys_are_found(spark):
    from conftest import SF

    from millrace.sources import catalog

    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in catalog.table_names(spark, SF)}
    declared = {(k.table, k.column, k.parent, k.parent_column) for k in catalog.DRIVER_KEYS if k.table != "events"}
    assert declared <= {(k.table, k.column, k.parent, k.parent_column) for k in discovery.foreign_keys(tables)}


@pytest.mark.parametrize("slices", [1, 3])
def test_unique_sets_equal_all_combinations(spark, slices):
    r = random.Random(slices)
    rows = sorted({(r.randrange(6), r.randrange(9), r.choice("xyz"), r.randrange(9), r.choice([None, 1, 2, 3])) for _ in range(22)}, key=repr)
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "a int, b long, c string, d int, e int")
    unique = lambda s: (own := [tuple(row[names.index(c)] for c in s) for row in rows]) and len(keep := [v for v in own if None not in v]) == len(set(keep))
    want = []
    for width in (1, 2, 3):
        want += [s for s in itertools.combinations(names, width) if unique(s) and not any(set(w) <= set(s) for w in want)]
    got = discovery.unique_sets(df, 3, slices)
    assert want and [s for s, _ in got] == want and all(whole == ("e" not in s) for s, whole in got)
    assert discovery.unique_sets(df.where("false")) == []
    assert [c.columns for c in discovery.key_constraints(got)] == want


def test_labels_stop_at_the_threshold(spark):
    df = spark.range(1000).select(F.col("id").alias("wide"), (F.col("id") % 3).alias("few"), (F.col("id") % 51).alias("over"), (F.col("id") % 50).alias("edge"), F.when(F.col("id") % 2 == 0, "x").alias("half"), (F.col("id") > 5).alias("flag"), F.lit(None).cast("string").alias("none")).repartition(6)
    shuffled = discovery.saturating_counts(df, ["wide", "few", "over", "edge"]).collect()
    assert max(sum(1 for r in shuffled if r.column == c) for c in ("wide", "over")) <= 51 * 6 and all(r.value is None for r in shuffled if r.column == "wide")
    got = discovery.labels(df).collect()
    assert {r.column for r in got} == {"few", "edge", "half", "flag"}
    assert {(r.value, r.n) for r in got if r.column in ("half", "flag")} == {("x", 500), ("true", 994), ("false", 6)}
    assert abs(sum(r.pct for r in got if r.column == "edge") - 100) < 1e-9
    assert discovery.labels(df.where("false")).collect() == []


def test_command_line_finds_or_reads_keys(spark, tmp_path, capsys):
    import json

    from millrace import cli

    spark.createDataFrame([(1, "x"), (2, "y")], "id int, kind string").write.parquet(str(tmp_path / "shops.parquet"))
    spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id int, shop_id int").write.parquet(str(tmp_path / "sales.parquet"))
    (tmp_path / "keys.json").write_text(json.dumps([["sales", "shop_id", "shops", "id"], ["sales", "none", "shops", "id"]]))
    want = [{"table": "sales", "column": "shop_id", "parent": "shops", "parent_column": "id"}]
    for flags in (["--discover"], ["--keys", str(tmp_path / "keys.json")]):
        assert cli.main(["introspect", str(tmp_path), *flags]) == 0
        assert json.loads(capsys.readouterr().out)["foreign_keys"] == want


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.0, 1.0 - 2**-53, 1.0 + 2**-52, 2.0**1023, 1.7976931348623157e308, math.inf, -math.inf, 0.1, -0.1, 3.0, 7.0, 8.0, 1e22, 1e-300, 2.0**52 + 1]


def test_ordered_bits_are_exact_and_in_order(spark):
    r = random.Random(4)
    xs = sorted({*EDGES, *(-x for x in EDGES), *(r.uniform(-1, 1) * 10.0 ** r.randrange(-320, 308) for _ in range(3000)), *(math.ldexp(1 - 2**-53 * (i % 3), i - 1000) for i in range(1900))})
    got = [x.b for x in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", profile.ordered_bits(F.col("x")).alias("b")).orderBy("i").collect()]
    assert got == sorted(set(got)) and [profile.double_of(b) for b in got] == xs
    assert spark.createDataFrame([(math.nan,)], "x double").select(profile.ordered_bits(F.col("x")).alias("b")).first().b > max(got)


@pytest.mark.parametrize("spoil", [[], [1e300], [math.inf, -math.inf], [-1e300, 1e300, 5e-324]])
def test_percentiles_of_skewed_columns(spark, spoil):
    """One outlier or infinity beside values that lie close together, a hot value, and a column of nulls."""
    r = random.Random(6)
    xs = [r.random() * 1e-3 for _ in range(500)] + [0.25] * 800 + spoil
    df = spark.createDataFrame([(x, i % 3, None) for i, x in enumerate(xs)], "x double, k int, none double").repartition(5)
    got = {r.column: r for r in profile.percentiles(df, ["x", "k", "none"]).collect()}
    assert set(got) == {"x", "k"}
    for column, own in (("x", sorted(xs)), ("k", sorted(i % 3 for i in range(len(xs))))):
        for q in profile.PERCENTILES:
            pos = q * (len(own) - 1)
            low, high = own[math.floor(pos)], own[math.ceil(pos)]
            want = low if low == high else low + (high - low) * (pos - math.floor(pos))
            assert math.isclose(got[column][f"p{int(q * 100)}"], want, abs_tol=1e-6)
    assert profile.percentiles(df.where("false"), ["x"]).collect() == []


def test_childless_with_a_hot_parent(spark):
    parents = spark.range(100)
    children = spark.range(5000).select(F.when(F.col("id") % 10 > 0, F.lit(7)).when(F.col("id") % 50 == 0, F.col("id") % 90).alias("p"))
    want = 100 - len({7, *(i % 90 for i in range(0, 5000, 50))})
    assert profile.childless(parents, "id", children, "p").first().zero_count == want


@pytest.mark.parametrize("sizes", [[7, 5], [1, 9], [3, 4, 6], [11]])
def test_combinations_are_a_permutation(spark, sizes):
    total = math.prod(sizes)
    names = [f"x{k}" for k in range(len(sizes))]
    got = [tuple(r[n] for n in names) for r in relations.unique_combinations(spark.range(total), "id", sizes, names, "k", 3).orderBy("id").collect()]
    assert sorted(got) == sorted(itertools.product(*[range(n) for n in sizes]))
    assert total < 20 or got != sorted(got)


def test_unique_parents_lose_no_row(spark):
    left, right = spark.range(10, 40), spark.range(5)
    rows = spark.range(150).withColumnRenamed("id", "n")
    pairs = relations.assign_unique_parents(rows, "n", 150, [(left, "id", "a"), (right, "id", "b")], "k", 1)
    assert pairs.count() == pairs.select("a", "b").distinct().count() == 150
    with pytest.raises(relations.TooFewCombinationsError):
        relations.assign_unique_parents(rows, "n", 151, [(left, "id", "a"), (right, "id", "b")], "k", 1)
    lines = relations.assign_unique_parents(rows, "n", 150, [(right, "id", "b")], "k", 1, counted="line").select("b", "line").distinct()
    assert lines.count() == 150 and lines.agg(F.max("line")).first()[0] == 30
    with pytest.raises(relations.MissingParentError):
        relations.assign_unique_parents(rows, "n", 150, [(right.where("false"), "id", "b")], "k", 1)


def test_pairs_of_many_parents_are_made_without_a_join(spark, monkeypatch):
    """More parents than are broadcast: pairs come from row numbers alone, and are those that rows get one by one."""
    from conftest import SF

    from millrace import table_queries as Q

    monkeypatch.setattr(relations, "BROADCAST_KEYS", 8)
    plan = Q.QUERIES["unique_part_suppliers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    left = spark.createDataFrame([(k,) for k in (None, -3, 900, *range(20, 60))], "a int").repartition(3)
    right = spark.createDataFrame([(None,), (5,), (1 << 40,), (-7,)], "b long")
    parents = [(left, "a", "x"), (right, "b", "y")]
    for n in (126, 125, 1, 0):
        rows = relations.assign_unique_parents(spark.range(n).withColumnRenamed("id", "n"), "n", n, parents, "k", 7).select("n", "x", "y")
        monkeypatch.setattr(relations, "PAIRS_AT_ONCE", 11)
        made = relations.unique_pairs(spark, n, parents, "k", 7, "n")
        assert [f.simpleString() for f in made.schema] == [f.simpleString() for f in rows.schema]
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, rows.collect()))
        assert made.select("x", "y").distinct().count() == n
    with pytest.raises(relations.TooFewCombinationsError):
        relations.unique_pairs(spark, 127, parents, "k", 7)
    with pytest.raises(relations.MissingParentError):
        relations.unique_pairs(spark, 3, [(left.where("false"), "a", "x"), (right, "b", "y")], "k", 7)


@pytest.mark.parametrize("bulk", [False, True])
def test_generated_tables_keep_composite_keys_and_rows(spark, bulk):
    from pyspark.sql import types as T

    from millrace.plans import generate, scenario
    from millrace.plans.schema import Column, Constraint, SchemaGraph, Table

    key = Column("id", T.LongType(), identity=True)
    long = lambda n: Column(n, T.LongType())
    graph = SchemaGraph(
        (Table("posts", (key,)), Table("tags", (key,)), Table("post_tags", (long("post_id"), long("tag_id"), Column("note", T.StringType())), (Constraint("primary_key", ("post_id", "tag_id")),)),
         Table("lines", (key, long("post_id"), Column("line", T.IntegerType())), (Constraint("unique", ("post_id", "line")),))),
        (ForeignKey("post_tags", "post_id", "posts", "id"), ForeignKey("post_tags", "tag_id", "tags", "id"), ForeignKey("lines", "post_id", "posts", "id")),
    )
    plan = scenario.parse({"tables": {"posts": {"count": 40}, "tags": {"count": 6}, "post_tags": {"count": 240}, "lines": {"count": 333}}})
    out = (generate.generate if bulk else generate.generated)(spark, graph, plan, 9)
    assert out["post_tags"].count() == out["post_tags"].select("post_id", "tag_id").distinct().count() == 240
    assert out["lines"].count() == out["lines"].select("post_id", "line").distinct().count() == 333


def test_update_repeats_no_row(spark):
    table = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id int, v int")
    changes = spark.createDataFrame([(1, 8), (1, 9), (2, None), (9, 1)], "id int, value int")
    assert sorted(map(tuple, relations.update_from(table, "id", changes, "v").collect())) == [(1, 9), (2, 6), (3, 7)]


def test_shapes_come_back(spark):
    """Heavy tails, hours and weekends of a profile, and a correlation that independent draws would lose."""
    from conftest import SF

    from millrace import table_queries as Q

    got = {r.measure: r.held for r in Q.QUERIES["shape_fit"](spark, SF).collect()}
    assert got == dict.fromkeys(Q._TOLERANCE, True)
    from millrace.functions import generators as G
    from millrace.operators import compliance

    df = spark.range(4000).select((F.col("id") % 97).cast("double").alias("x"), F.exp(-(F.col("id") % 97) / 9.0).alias("y"), F.lit(None).cast("double").alias("none"))
    shape = profile.joint_shape(df, ["x", "y"])
    u = G.joint_ranks(F.col("id"), 5, "k", shape["counts"])
    knots = [[(k / 8, v) for k, v in enumerate(e)] for e in shape["edges"]]
    made = spark.range(4000).select(*[G.inverse(a, b).alias(c) for a, b, c in zip(u, knots, "xy", strict=True)])
    assert compliance.rank_correlation(made, "x", "y").first()[0] < -0.97 and compliance.rank_correlation(df, "x", "y").first()[0] == -1.0
    assert compliance.ks_gap(df, "y", made, "y").first()[0] < 0.08
    assert compliance.ks_gap(df, "none", made, "y").first()[0] is None and compliance.rank_correlation(df, "x", "none").first()[0] is None
    assert profile.joint_shape(df, ["x", "none"])["edges"] == [[], []]


@pytest.mark.parametrize("case", ["apart", "ties", "same", "odd"])
def test_gaps_are_exact_though_few_values_are_dealt(spark, monkeypatch, case):
    """The gap is that of all values, but only buckets that can hold it are looked into value by value."""
    from millrace.operators import compliance

    r = random.Random(5)
    left = [r.gauss(1000, 200) for _ in range(6000)]
    right = {"apart": [r.gauss(1020, 200) for _ in range(5000)], "ties": [float(r.randrange(400, 1600, 50)) for _ in range(5000)], "same": left, "odd": [math.nan, math.inf, -math.inf, -0.0, 0.0, 5e-324, -1e300, *left[:40]]}[case]
    values = sorted(set(left) | {x for x in right if x == x})
    share = lambda xs: [bisect.bisect_right(sorted(x for x in xs if x == x), v) / len(xs) for v in values]
    gap = max(abs(a - b) for a, b in zip(share(left), share(right), strict=True))
    dealt, own = [], compliance.running_sums
    monkeypatch.setattr(compliance, "running_sums", lambda deltas, *a: (dealt.append(deltas.count()), own(deltas, *a))[1])
    frames = [spark.createDataFrame([(x,) for x in xs] + [(None,)], "v double").repartition(3) for xs in (left, right)]
    assert compliance.ks_gap(frames[0], "v", frames[1], "v").first()[0] == pytest.approx(gap, abs=6e-7)
    assert case == "same" or sum(dealt) < len(values) / 4  # no gap at all: any value could hold the greatest


def test_bounds_hold_a_rank_correlation(spark, monkeypatch):
    from millrace.operators import compliance

    r = random.Random(6)
    rows = [(float(r.randrange(1, 51)), r.gauss(0, 3)) for _ in range(4000)]
    near = spark.createDataFrame([(q, q + e) for q, e in rows] + [(None, 1.0), (1.0, None)], "x double, y double")
    far = spark.createDataFrame([(q, e - q) for q, e in rows], "x double, y double")
    for df in (near, far):
        low, high = compliance.correlation_bounds(df, "x", "y")
        assert low - 1e-6 <= compliance.rank_correlation(df, "x", "y").first()[0] <= high + 1e-6 and high - low < 0.05
    assert compliance.correlation_bounds(near.where("x = 1"), "x", "y") is None
    exact = compliance.rank_correlation
    monkeypatch.setattr(compliance, "rank_correlation", None)  # the bounds are enough
    assert compliance.correlations_near(near, near, "x", "y", 0.1).first().held is True
    assert compliance.correlations_near(near, far, "x", "y", 0.1).first().held is False
    monkeypatch.setattr(compliance, "rank_correlation", exact)
    assert compliance.correlations_near(near, near, "x", "y", 0.0).first().held is True
    assert compliance.correlations_near(near, near.where("x = 1"), "x", "y", 0.1).first().held is None


def test_unread_keys_are_left_out(spark):
    from pyspark.sql import types as T

    from millrace.plans import generate, scenario
    from millrace.plans.schema import Column, Constraint, SchemaGraph, Table

    key, parent, size = Column("id", T.LongType(), identity=True), Column("post_id", T.LongType()), Column("size", T.DoubleType())
    keys = (ForeignKey("lines", "post_id", "posts", "id"),)
    plan = scenario.parse({"tables": {"posts": {"count": 40}, "lines": {"count": 333}}})
    graph = SchemaGraph((Table("posts", (key,)), Table("lines", (key, parent, size))), keys)
    made, bare = generate.generate(spark, graph, plan, 9)["lines"], generate.generate(spark, graph, plan, 9, keyless=["lines"])["lines"]
    assert bare.columns == ["id", "size"] and "Join" not in bare._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, made.select("id", "size").collect()))
    held = SchemaGraph((Table("posts", (key,)), Table("lines", (key, parent, size), (Constraint("unique", ("post_id", "size")),))), keys)
    assert "post_id" in generate.generate(spark, held, plan, 9, keyless=["lines"])["lines"].columns


def test_dates_by_density(spark):
    from millrace.functions import generators as G

    at = G.dated(F.col("id"), 3, "k", {"2023-12": 10, "2024-02": 30}, {"9": 25.0, "17": 75.0}, 20.0, "2023-12-04 00:00:00", "2024-02-29 23:59:59")
    got = [r.at for r in spark.range(4000).select(at.alias("at")).collect()]
    assert {(x.year, x.month) for x in got} == {(2023, 12), (2024, 2)} and min(got) >= datetime(2023, 12, 4)
    assert abs(sum(x.month == 2 for x in got) / 4000 - 0.75) < 0.03 and abs(sum(x.hour == 17 for x in got) / 4000 - 0.75) < 0.03
    assert abs(sum(x.weekday() < 5 for x in got) / 4000 - 0.2) < 0.05


def test_merged_parts_equal_the_whole(spark):
    r = random.Random(11)
    rows = [(i, r.choice([None, 0.0, -0.0, r.gauss(0, 1), -1e300, 5e-324, r.random() * 1e6, -3.5]), r.choice([None, "a", "bb", "", "é" * 9]), at(r.choice([None, r.randrange(10**7)])), r.random() < 0.3) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, x double, s string, t timestamp_ntz, f boolean")
    whole = states.states(df)
    parts = states.merged(states.union([states.states(df.where("k < 10")), states.states(df.where("k between 10 and 400")), states.states(df.where("k > 400")), states.states(df.where("false"))]))
    for make in (states.numeric_profile, states.text_profile, lambda s: states.counts_by(s, "hour"), lambda s: states.counts_by(s, "weekday")):
        assert sorted(map(repr, make(whole).drop("mean_val", "stddev_val").collect())) == sorted(map(repr, make(parts).drop("mean_val", "stddev_val").collect()))
    got = {r["column"]: r for r in states.numeric_profile(parts).collect()}
    xs = sorted(x for _, x, *_ in rows if x is not None)
    for q in profile.PERCENTILES:
        true, found = xs[math.floor(q * (len(xs) - 1))], got["x"][f"p{int(q * 100)}"]
        assert abs(found - true) <= abs(true) / 4096 + 1e-6
    assert math.isclose(got["k"].stddev_val, 600 * math.sqrt(1 / 12 + 1 / 12 / 600), rel_tol=1e-3) and got["x"].null_rate == 100 * (600 - len(xs)) / 600


def test_only_new_files_are_read(spark, tmp_path):
    table, kept = str(tmp_path / "t"), str(tmp_path / "states")
    spark.range(100).selectExpr("id", "cast(id % 7 as string) as s").coalesce(1).write.parquet(table)
    first = states.refreshed(spark, table, kept)
    assert states.numeric_profile(first).first().n == 100
    spark.range(100, 160).selectExpr("id", "cast(id % 9 as string) as s").coalesce(1).write.mode("append").parquet(table)
    before = {r.file for r in spark.read.parquet(kept).select("file").distinct().collect()}
    second = states.refreshed(spark, table, kept)
    assert sorted(map(repr, states.numeric_profile(second).collect())) == sorted(map(repr, states.numeric_profile(states.states(spark.read.parquet(table))).collect()))
    assert states.text_profile(second).first().cardinality == 9
    files = spark.read.parquet(kept).groupBy("file").count().collect()
    assert len(files) == 2 and before < {r.file for r in files}
    states.refreshed(spark, table, kept)
    assert spark.read.parquet(kept).groupBy("file", "column", "part", "key").count().where("count > 1").count() == 0


def _put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """Children come before their parents, files one by one, and each run goes on where the last one ended."""
    from millrace.streaming import audits

    c, p = str(tmp_path / "c"), str(tmp_path / "p")
    kids, folks = "fk int, at timestamp_ntz", "pk int, born timestamp_ntz"
    _put(spark, c, [(1, at(5)), (2, at(50)), (None, at(1)), (9, None)], kids)
    _put(spark, p, [(2, at(60)), (3, at(0))], folks)

    def run():
        families = audits.family_states(audits.stream(spark, c, 1), "fk", audits.stream(spark, p, 1), "pk")
        lost = audits.orphans(audits.latest(audits.drain(families, str(tmp_path / "f"), "update"), ["key"])).first().orphans
        early = audits.early_children(audits.stream(spark, c, 1), "fk", "at", audits.stream(spark, p, 1), "pk", "born")
        return lost, sorted(r.key for r in audits.appended(audits.drain(early, str(tmp_path / "e"))).collect())

    assert run() == (2, [2])
    _put(spark, p, [(1, at(9))], folks)
    _put(spark, c, [(2, at(70)), (3, at(-1)), (3, at(1))], kids)
    assert run() == (1, [1, 2, 3])
    assert run() == (1, [1, 2, 3])


def test_a_batch_that_runs_again_writes_once(spark, tmp_path):
    import shutil

    from millrace.streaming import audits

    table, folder = str(tmp_path / "t"), str(tmp_path / "q")
    _put(spark, table, [(i, at(i)) for i in range(10)], "k int, at timestamp_ntz")
    rows = lambda: audits.stream(spark, table).select("k")
    assert audits.drain(rows(), folder).count() == 10
    shutil.rmtree(f"{folder}/state/commits")  # as if the run had ended before it could say so
    assert sorted(r.k for r in audits.appended(audits.drain(rows(), folder)).collect()) == list(range(10))


def test_late_rows_are_dropped(spark, tmp_path):
    from millrace.streaming import audits
    from millrace.streaming.density import hourly_counts

    table, hour = str(tmp_path / "t"), 3600
    _put(spark, table, [(at(10),), (at(20),), (at(9 * hour),)], "ts timestamp_ntz")
    run = lambda: {r.start.hour: r.cnt for r in audits.appended(audits.drain(hourly_counts(audits.stream(spark, table, 1)), str(tmp_path / "q"))).collect()}
    run()
    _put(spark, table, [(at(30),), (at(9 * hour + 5),), (at(20 * hour),)], "ts timestamp_ntz")
    run()
    _put(spark, table, [(at(40 * hour),)], "ts timestamp_ntz")
    got = run()
    assert got[0] == 2 and got[9] == 2  # the row of 0 h that came after the watermark is in none


def test_late_children_wait_no_longer(spark, tmp_path):
    from millrace.streaming import audits

    c, p, day = str(tmp_path / "c"), str(tmp_path / "p"), 86_400
    kids, folks = "fk int, at timestamp_ntz", "pk int, born timestamp_ntz"
    _put(spark, c, [(1, at(0)), (2, at(0))], kids)
    _put(spark, p, [(1, at(3600)), (2, at(5 * day))], folks)
    early = audits.early_children(audits.stream(spark, c), "fk", "at", audits.stream(spark, p), "pk", "born", late="2 days")
    assert [r.key for r in audits.appended(audits.drain(early, str(tmp_path / "q"))).collect()] == [1]


def test_transactions_are_whole_or_nothing(spark, tmp_path):
    from millrace.sources import ledger

    root = str(tmp_path / "db")
    people = spark.range(100).select(F.concat(F.lit("p"), "id").alias("name"))
    with ledger.Transaction(spark, root, "first") as t:
        ids = t.insert("people", people.repartition(4), ["name"])
        t.insert("notes", ids.select(F.col("id").alias("person"), F.length("name").alias("n")))
    want = sorted(r.name for r in people.collect())
    assert [(r.id, r.name) for r in ledger.read(spark, root, "people").orderBy("id").collect()] == list(enumerate(want, 1))
    assert ledger.read(spark, root, "notes").select("person").distinct().count() == 100

    broken = spark.range(50).select(F.when(F.col("id") == 37, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("name"))
    with pytest.raises(Exception, match="lost"):
        with ledger.Transaction(spark, root) as t:
            t.insert("notes", spark.range(3).select(F.col("id").alias("person"), F.lit(1).alias("n")))
            t.insert("people", broken)
    assert ledger.read(spark, root, "people").count() == 100 and ledger.read(spark, root, "notes").count() == 100
    assert sum(len(list((tmp_path / "db" / "data" / x).iterdir())) for x in ("people", "notes")) == 2  # nothing staged is left

    for _ in range(2):  # a retry under its token writes once and gives the same serials
        with ledger.Transaction(spark, root, "second") as t:
            again = t.insert("people", spark.range(5).select(F.col("id").cast("string").alias("name")), ["name"])
        assert sorted(r.id for r in again.collect()) == [101, 102, 103, 104, 105]
    assert ledger.read(spark, root, "people").count() == 105

    one, two = ledger.Transaction(spark, root), ledger.Transaction(spark, root)
    one.insert("people", spark.createDataFrame([("a",)], "name string"))
    two.insert("people", spark.createDataFrame([("b",)], "name string"))
    one.commit()
    with pytest.raises(ledger.ConflictError):
        two.commit()
    two.abort()
    assert sorted(r.name for r in ledger.read(spark, root, "people").where("id > 105").collect()) == ["a"]
    with ledger.Transaction(spark, root) as t:
        assert t.insert("empty", people.where("false")).collect() == []


def test_sql_files_load_in_one_transaction(spark, tmp_path):
    from millrace.sources import sinks

    path = tmp_path / "people"
    sinks.write_sql(spark.range(2500).repartition(3).withColumnRenamed("id", "k"), "people", str(path))
    lines = (path / sinks.LOADER).read_text().splitlines()
    parts = sorted(p.name for p in path.iterdir() if p.name.startswith("part-"))
    assert lines[0] == "BEGIN;" and lines[-1] == "COMMIT;" and [x[4:] for x in lines if x.startswith("\\ir ")] == parts and len(parts) == 3
    text = "".join((path / p).read_text() for p in parts)
    assert "BEGIN" not in text and text.count("INSERT INTO") == 3 and text.count("(") == 2500 + 3
