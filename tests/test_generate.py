"""Generated databases keep their keys, uniqueness and counts, whatever the partitioning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.audit import duplicate_count, orphans
from millrace.operators.relations import MissingParentError
from millrace.plans import generate, scenario, simulate
from millrace.plans.schema import Column, Constraint, ForeignKey, SchemaGraph, Table

ID = Column("id", T.LongType(), identity=True)
USERS = Table("users", (ID, Column("email", T.StringType(), max_length=60), Column("name", T.StringType()), Column("is_active", T.BooleanType()), Column("created_at", T.TimestampNTZType()), Column("manager_id", T.LongType())), (Constraint("unique", ("email",)),))
POSTS = Table("posts", (ID, Column("user_id", T.LongType()), Column("status", T.StringType()), Column("score", T.IntegerType()), Column("title", T.StringType(), max_length=40), Column("author", T.StringType())))
GRAPH = SchemaGraph((POSTS, USERS), (ForeignKey("posts", "user_id", "users", "id"), ForeignKey("users", "manager_id", "users", "id", nullable=True)))
PLAN = scenario.parse({"seed": 7, "tables": {"users": {"count": 200}, "posts": {"count": "per_parent(users, 2..4)", "overrides": {"status": {"distribution": {"draft": "20%", "live": "80%"}}, "score": {"range": [1, 5]}, "author": {"from_parent": "users.name"}}}}})


def test_keys_uniqueness_and_overrides(spark):
    out = generate.generate(spark, GRAPH, PLAN)
    users, posts = out["users"], out["posts"]
    assert users.count() == 200 and posts.count() == 600
    assert duplicate_count(users, "email").first().duplicate_rows == 0
    assert orphans(posts, "user_id", users, "id").first().orphans == 0
    assert users.where("manager_id >= id").count() == 0 and users.where("manager_id is null").count() == 1
    assert {r.status for r in posts.select("status").distinct().collect()} == {"draft", "live"}
    low, high, longest = posts.selectExpr("min(score)", "max(score)", "max(length(title))").first()
    assert (low, high) == (1, 5) and longest <= 40
    assert posts.join(users, posts.user_id == users.id).where("author <> name").count() == 0


def test_equal_seeds_give_equal_rows(spark):
    a = generate.generate(spark, GRAPH, PLAN, 5)["posts"].collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = generate.generate(spark, GRAPH, PLAN, 5)["posts"].collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(a) == sorted(b)
    assert sorted(generate.generate(spark, GRAPH, PLAN, 6)["posts"].collect()) != sorted(a)


def test_cycle_is_filled_in_a_second_pass(spark):
    d = Table("departments", (ID, Column("name", T.StringType()), Column("head_id", T.LongType())))
    e = Table("employees", (ID, Column("name", T.StringType()), Column("department_id", T.LongType())))
    g = SchemaGraph((d, e), (ForeignKey("departments", "head_id", "employees", "id", nullable=True), ForeignKey("employees", "department_id", "departments", "id")))
    out = generate.generate(spark, g, scenario.parse({"tables": {"departments": {"count": 5}, "employees": {"count": 30}}}))
    assert out["departments"].where("head_id is null").count() == 0
    assert orphans(out["departments"], "head_id", out["employees"], "id").first().orphans == 0


def test_required_parent_must_exist(spark):
    empty = scenario.parse({"tables": {"users": {"count": 0}, "posts": {"count": 3}}})
    with pytest.raises(MissingParentError):
        generate.generate(spark, GRAPH, empty)


def test_simulation_follows_parents(spark):
    s = scenario.parse({"seed": 1, "lifecycle": {"start": "2024-01-01", "end": "2024-07-01", "bucket": "month"}, "tables": {
        "users": {"growth": {"model": "s_curve", "initial": 10, "capacity": 200, "rate": 0.4}, "churn": {"rate": 0.1, "grace_period": 2}},
        "orders": {"growth": {"follows": "users", "ratio": 2.0}, "seasonality": {"monthly": [1.0, 0.7, 0.85, 1.0, 1.1, 0.8]}},
        "items": {"growth": {"follows": "orders", "per_parent": "1..3"}}}})
    assert simulate.order(s) == ["users", "orders", "items"]
    rows = simulate.simulate(spark, s).collect()
    by = {t: sorted((r for r in rows if r.table == t), key=lambda r: r.b) for t in ("users", "orders", "items")}
    assert [r.new for r in by["users"]] == [10, 4, 6, 8, 12, 14]  # fixed values
    season = [1.0, 0.7, 0.85, 1.0, 1.1, 0.8]
    assert all(abs(o.new - 2 * u.active * f) <= 1 for o, u, f in zip(by["orders"], by["users"], season, strict=True))
    assert all(o.active <= i.new <= 3 * o.active for o, i in zip(by["orders"], by["items"], strict=True))


def test_large_pools_are_numbered_alike(spark, monkeypatch):
    from millrace.operators import lifecycle, relations

    numbers = spark.range(100, 900).withColumnRenamed("id", "k")
    small = sorted(map(tuple, relations.indexed_keys(numbers, "k")[0].collect()))
    words = numbers.selectExpr("concat('w', k) as k")
    pairs = spark.range(1, 301).selectExpr("cast(id % 3 as int) as b", "id")
    whole = sorted(map(tuple, lifecycle._numbered(pairs).collect()))
    small_words = sorted(map(tuple, relations.indexed_keys(words, "k")[0].collect()))
    monkeypatch.setattr(relations, "BROADCAST_KEYS", 90)
    monkeypatch.setattr(lifecycle, "RUN", 7)
    assert sorted(map(tuple, relations.indexed_keys(numbers, "k")[0].collect())) == small
    assert sorted(map(tuple, relations.indexed_keys(words, "k")[0].collect())) == small_words
    assert sorted(map(tuple, lifecycle._numbered(pairs).collect())) == whole
    monkeypatch.setattr(lifecycle, "CHUNK", 3)
    counts = spark.createDataFrame([(0, 7), (1, 0), (2, 4)], "b int, new long").selectExpr("*", "date'2024-01-01' as b_start", "date'2024-02-01' as b_end")
    assert sorted((r.created_b, r.id) for r in lifecycle.entities(counts, "x", 1).collect()) == [(0, i) for i in range(1, 8)] + [(2, i) for i in range(8, 12)]


def test_a_sentence_is_made_once_and_ids_are_dealt(spark):
    """Its text was worked out three times a sentence, by as many tasks as the file of ids had parts."""
    from millrace import queries
    from millrace.functions import generators

    df = spark.range(1).select(generators.paragraph(F.col("id"), 1, "g").alias("value"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("g.length") == 1
    assert queries.QUERIES["gen_paragraph"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 16


def test_entities_are_dealt_over_tasks_and_not_broadcast(spark):
    from datetime import date

    from millrace.operators import audit, lifecycle

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    months = lifecycle.buckets(spark, date(2024, 1, 1), date(2024, 4, 1))
    users = spark.range(1, 301).selectExpr("id", "cast(id % 3 as int) as created_b", "timestamp_ntz'2024-01-01 00:00:00' as created_at")
    pairs, counts = users.selectExpr("created_b as b", "id"), spark.createDataFrame([(0, 40), (1, 0), (2, 60)], "b int, new long")
    born = lifecycle.entities(counts.join(months, "b"), "orders", 1)
    assert born.rdd.getNumPartitions() >= lifecycle.TASKS and born.count() == 100
    orders = lifecycle.children(counts, pairs, users, months, "orders", 1, "after", 0, 10)
    rows = orders.collect()
    assert len(rows) == 100 and all(r.parent_id % 3 == r.created_b for r in rows)
    assert plan(orders).partition("Initial Plan")[0].count("SortMergeJoin") >= 2
    late, lost = audit.before_parent(orders, "parent_id", "created_at", users.withColumnRenamed("created_at", "born"), "id", "born"), audit.orphans(orders, "parent_id", users, "id")
    assert (late.first().violations, lost.first().orphans) == (0, 0)
    assert "SortMergeJoin" in plan(lost).partition("Initial Plan")[0] and plan(late).partition("Initial Plan")[0].count("SortMergeJoin") >= 3


def test_unique_values_of_every_type(spark):
    kinds = [T.IntegerType(), T.LongType(), T.DateType(), T.TimestampNTZType(), T.DoubleType(), T.DecimalType(12, 2), T.StringType()]
    columns = tuple(Column(f"c{i}", k) for i, k in enumerate(kinds))
    t = Table("t", (ID, *columns, Column("code", T.StringType(), max_length=4)), tuple(Constraint("unique", (c.name,)) for c in columns))
    df = generate.generate(spark, SchemaGraph((t,)), scenario.parse({"tables": {"t": {"count": 3000}}}))["t"].cache()
    assert all(df.select(c.name).distinct().count() == 3000 for c in columns)
    small = Table("s", (ID, Column("d", T.DecimalType(3, 1))), (Constraint("unique", ("d",)),))
    with pytest.raises(generate.UniqueExhaustedError):
        generate.generate(spark, SchemaGraph((small,)), scenario.parse({"tables": {"s": {"count": 2000}}}))


def test_composite_keys_and_times_after_parents(spark):
    tags = Table("tags", (ID, Column("created_at", T.TimestampNTZType())))
    links = Table("links", (Column("user_id", T.LongType()), Column("tag_id", T.LongType()), Column("at", T.TimestampNTZType())), (Constraint("unique", ("user_id", "tag_id")),))
    g = SchemaGraph((USERS, tags, links), (ForeignKey("links", "user_id", "users", "id"), ForeignKey("links", "tag_id", "tags", "id"), ForeignKey("users", "manager_id", "users", "id", nullable=True)))
    out = generate.generate(spark, g, scenario.parse({"tables": {"users": {"count": 20}, "tags": {"count": 5}, "links": {"count": 300, "overrides": {"at": {"after": "tags.created_at"}}}}}))
    rows = out["links"].join(out["tags"].withColumnRenamed("created_at", "born"), out["links"].tag_id == out["tags"].id).collect()
    assert len({(r.user_id, r.tag_id) for r in rows}) == len(rows) == 100 and all(r["at"] > r.born for r in rows)


def test_profile_is_applied_in_full(spark, tmp_path):
    from millrace.operators.compliance import profile_checks, summary
    from millrace.plans import profiler

    source = spark.range(4000).selectExpr("id", "case when id % 5 > 0 then 'k' || id % 3 end as kind", "case when id % 10 > 0 then id % 4 = 0 end as flag", "case when id % 4 > 0 then timestamp_ntz'2020-03-01 00:00:00' + make_dt_interval(0, id % 500) end as at", "case when id % 3 > 0 then cast(id as double) end as x")
    source.write.parquet(str(tmp_path / "things.parquet"))
    columns = tuple(Column(f.name, f.dataType, identity=f.name == "id") for f in source.schema)
    g = SchemaGraph((Table("things", columns),))
    doc = profiler.collect(spark, str(tmp_path), g)
    assert doc["tables"]["things"]["columns"]["kind"]["type"] == "categorical" and abs(doc["tables"]["things"]["columns"]["at"]["null_rate"] - 25) < 1e-9
    made = generate.generate(spark, g, scenario.from_profile(doc), 9)["things"]
    checks = profile_checks(doc, {"things": made}).cache()
    assert checks.count() == 6 and summary(checks).first().failed == 0
    low, high = made.selectExpr("min(at)", "max(at)").first()
    assert str(low) >= "2020-03-01" and str(high) <= "2020-03-21 20:00:00"
    bad = profile_checks(doc, {"things": made.selectExpr("id", "kind", "flag", "cast(null as timestamp_ntz) as at", "x")})
    assert [(r["check"], r.subject) for r in bad.where("not passed").collect()] == [("null_rate", "at")]


SHOP = SchemaGraph(
    (
        Table("users", (ID, Column("email", T.StringType()), Column("plan", T.StringType()), Column("is_active", T.BooleanType()), Column("created_at", T.TimestampNTZType()), Column("churned_at", T.TimestampNTZType())), (Constraint("unique", ("email",)),)),
        Table("orders", (ID, Column("user_id", T.LongType()), Column("status", T.StringType()), Column("created_at", T.TimestampNTZType()))),
        Table("order_items", (ID, Column("order_id", T.LongType()), Column("created_at", T.TimestampNTZType()))),
        Table("shops", (ID, Column("name", T.StringType()))),
    ),
    (ForeignKey("orders", "user_id", "users", "id"), ForeignKey("order_items", "order_id", "orders", "id")),
)


@pytest.mark.parametrize("cascade", [True, False])
def test_tables_grow_over_buckets(spark, cascade):
    from millrace.operators.audit import before_parent
    from millrace.plans.grow import grow

    s = scenario.parse({"lifecycle": {"start": "2024-01-01", "end": "2024-07-01", "bucket": "month"}, "tables": {
        "shops": {"count": 3},
        "users": {"growth": {"model": "linear", "initial": 40, "rate": 25}, "churn": {"rate": "30%", "grace_period": 1, "cascade": cascade},
                  "overrides": {"plan": {"timeline": {"2024-01-01": {"basic": 3, "gold": 7}, "2024-06-01": {"basic": 5, "gold": 3, "trial": 2}}}}},
        "orders": {"growth": {"follows": "users", "ratio": 1.4}, "temporal": {"created_at": {"after": "users.created_at", "offset": "2d..45d"}}, "seasonality": {"quarterly": [1.1, 0.9, 1.0, 1.0]}},
        "order_items": {"growth": {"follows": "orders", "per_parent": "1..2"}, "temporal": {"created_at": {"equals": "orders.created_at"}}},
    }})
    out = {k: v.cache() for k, v in grow(spark, SHOP, s, 5).items()}
    users, orders, items = out["users"], out["orders"], out["order_items"]
    assert out["shops"].count() == 3 and duplicate_count(users, "email").first().duplicate_rows == 0
    assert orphans(orders, "user_id", users, "id").first().orphans == orphans(items, "order_id", orders, "id").first().orphans == 0
    assert before_parent(orders, "user_id", "created_at", users.withColumnRenamed("created_at", "born"), "id", "born").first().violations == 0
    assert items.join(orders.withColumnRenamed("id", "oid").withColumnRenamed("created_at", "at"), items.order_id == F.col("oid")).where("created_at <> at").count() == 0
    churned = users.where("not is_active")
    assert 0 < churned.count() < users.count() and churned.where("churned_at is null or churned_at < created_at").count() == 0
    assert users.where("is_active and churned_at is not null").count() == 0
    late = orders.join(users.select(F.col("id").alias("uid"), F.date_trunc("month", "churned_at").alias("gone")), F.col("user_id") == F.col("uid")).where(F.date_trunc("month", "created_at") >= F.col("gone")).count()
    assert late == 0 if cascade else late > 0
    assert {r.plan for r in users.where("created_at < timestamp_ntz'2024-02-01'").select("plan").distinct().collect()} == {"basic", "gold"}
    assert [r.n for r in users.groupBy(F.date_trunc("month", "created_at").alias("m")).agg(F.count("*").alias("n")).orderBy("m").collect()][0] == 40
    again = grow(spark, SHOP, s, 5)
    assert sorted(again["orders"].collect()) == sorted(orders.collect())


def test_rows_without_an_active_parent_leave_no_gap(spark):
    from millrace.plans.grow import grow

    t = lambda n, *fks: Table(n, (ID, *(Column(f, T.LongType()) for f in fks), Column("created_at", T.TimestampNTZType())))
    g = SchemaGraph((t("a"), t("b"), t("c", "a_id", "b_id"), t("d", "c_id")), (ForeignKey("c", "a_id", "a", "id"), ForeignKey("c", "b_id", "b", "id"), ForeignKey("d", "c_id", "c", "id")))
    s = scenario.parse({"lifecycle": {"start": "2024-01-01", "end": "2024-05-01", "bucket": "month"}, "tables": {
        "a": {"growth": {"model": "linear", "initial": 5, "rate": 3}}, "b": {"growth": {"model": "custom", "values": [0, 0, 4, 2]}},
        "c": {"growth": {"follows": "a", "ratio": 2}, "churn": {"rate": 0.2, "cascade": False}}, "d": {"growth": {"follows": "c", "ratio": 1}}}})
    out = {k: v.cache() for k, v in grow(spark, g, s, 3).items()}
    n = out["c"].count()
    assert n > 0 and sorted(r.id for r in out["c"].select("id").collect()) == list(range(1, n + 1))
    assert out["c"].where("created_at < timestamp_ntz'2024-03-01'").count() == 0
    assert all(orphans(out[c], f, out[p], "id").first().orphans == 0 for c, f, p in (("c", "a_id", "a"), ("c", "b_id", "b"), ("d", "c_id", "c")))
