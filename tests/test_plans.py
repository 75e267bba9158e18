"""Schema graphs, scenarios, checks, classifier: driver-side algebra."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import types as T

from conftest import SF
from millrace.functions import classify
from millrace.operators import audit, lifecycle
from millrace.plans import profiler, scenario
from millrace.plans.schema import Column, CycleError, ForeignKey, SchemaGraph, Table, UnknownTableError, cycles, resolve, topological_order
from millrace.sources import catalog, offline, sinks


def graph(names, *keys):
    return SchemaGraph(tuple(Table(n, ()) for n in names), tuple(ForeignKey(c, f"{p}_id", p, "id", nullable=null) for c, p, null in keys))


def test_parents_come_first_and_ties_go_by_name():
    g = graph(["c", "b", "a", "d"], ("d", "a", False), ("a", "b", False), ("b", "b", True), ("d", "a", False))
    assert topological_order(g) == ("b", "a", "c", "d")


def test_cycle_is_broken_at_its_nullable_key():
    g = graph(["employees", "departments"], ("employees", "departments", False), ("departments", "employees", True))
    assert cycles(g) == [("departments", "employees")]
    plan = resolve(g)
    assert plan.order == ("departments", "employees")
    assert [(k.table, k.parent) for k in plan.deferred] == [("departments", "employees")]
    with pytest.raises(CycleError):
        resolve(graph(["a", "b"], ("a", "b", False), ("b", "a", False)))
    with pytest.raises(UnknownTableError):
        topological_order(graph(["a"], ("a", "z", False)))


def test_key_that_others_point_to():
    from millrace.plans.generate import key_column

    col = lambda n, **k: Column(n, T.LongType(), **k)
    assert key_column(Table("t", (col("no", identity=True), col("id", identity=True)))) == "id"
    assert key_column(Table("t", (col("id"), col("no", identity=True)))) == "no"
    assert key_column(Table("t", (col("row_uuid"), col("id")))) == "id"
    assert key_column(Table("t", (col("x"), col("row_uuid")))) == "row_uuid" and key_column(Table("t", (col("x"),))) is None


def test_simulation_order():
    from millrace.plans import simulate

    g = lambda f=None: {"growth": {"follows": f} if f else {"model": "linear", "initial": 1, "rate": 1}}
    s = scenario.parse({"tables": {"z": g(), "b": g("z"), "a": g("b"), "lost": g("nowhere"), "c1": g("c2"), "c2": g("c1"), "still": {"count": 3}}})
    assert simulate.order(s) == ["z", "b", "a", "c1", "c2", "lost"]


def test_counts_and_scalars():
    assert scenario.parse_count("per_parent(users, 0..10)") == scenario.PerParent("users", 0, 10)
    assert scenario.parse_count("30% of users").rows({"users": 101}) == 30
    assert scenario.PerParent("u", 1, 2).rows({"u": 5}) == 8
    assert scenario.PerParent("u", 1, 2).rows({}, 7) == 7
    for bad in ("per_parent(u, 3..1)", "many"):
        with pytest.raises(scenario.ScenarioError):
            scenario.parse_count(bad)
    assert scenario.parse_percent("5%") == scenario.parse_percent(5) == 5.0
    assert scenario.parse_scalar("1970-01-11") == 10.0
    assert scenario.parse_duration("1d..60d") == (86_400, 60 * 86_400)
    assert scenario.effective_seed(None, scenario.Scenario({}, 7), 1) == 7


def test_templates_resolve_to_counts():
    s = scenario.template("ecommerce")
    n = s.row_counts(("users", "categories", "products", "orders", "order_items", "reviews"))
    assert n == {"users": 50, "categories": 15, "products": 200, "orders": 250, "order_items": 750, "reviews": 500}
    assert s.with_counts({"users": 3}).tables["users"].count == scenario.Fixed(3)
    assert s.with_counts({"orders": 3}).tables["orders"].overrides
    assert set(scenario.TEMPLATES) == {"ecommerce", "saas", "blog", "social", "lifecycle"}


def test_check_texts(spark):
    assert audit.parse_check("CHECK ((price > (0)::numeric))")[0] == "price"
    assert audit.parse_check("CHECK (rating >= 1 AND rating <= 5)")[0] == "rating"
    assert audit.parse_check("CHECK (a < b)") is None


def test_buckets_step_month_by_month():
    ends = [b[2] for b in lifecycle.bucket_bounds(date(2024, 1, 31), date(2024, 5, 1), "month")]
    assert ends[:3] == [date(2024, 2, 29), date(2024, 3, 29), date(2024, 4, 29)]
    assert len(lifecycle.bucket_bounds(date(2024, 1, 1), date(2024, 1, 15), "week")) == 2


def test_generator_by_name_then_type():
    assert classify.by_name("country_code", 2) == "country_code"
    assert classify.by_name("hotel") is None and classify.by_name("home_tel") == "phone"
    assert classify.detect(Column("x", T.LongType(), identity=True)) is None
    assert classify.detect(Column("flag", T.BooleanType()))[0] == "bool"
    assert classify.detect(Column("n", T.DecimalType(9, 2)))[0] == "money"
    assert classify.detect(Column("tags", T.ArrayType(T.StringType())))[0] == "null"


def test_profile_document_and_scenario(spark, tmp_path):
    options = profiler.Options(include_tables=("region", "nation", "customer", "orders"), exclude_columns=("customer.c_acctbal",))
    g = catalog.introspect(spark, SF, catalog.DRIVER_KEYS)
    trail = profiler.Audit()
    doc = profiler.collect(spark, SF, g, options, trail)
    assert doc["tables"]["orders"]["columns"]["o_orderstatus"]["type"] == "categorical"
    assert doc["tables"]["customer"]["columns"]["c_acctbal"]["type"] == "skipped_excluded"
    assert doc["tables"]["customer"]["columns"]["c_name"]["type"] == "string"
    assert "Customer#" not in str(doc) and any(x.startswith("SKIP excluded") for x in trail.lines)
    assert doc["tables"]["orders"]["parent_ratios"]["customer.o_custkey"]["avg"] > 0
    for name in (f"{tmp_path}/p.json", f"{tmp_path}/p.yaml", f"file://{tmp_path}/q.json", f"file://{tmp_path}/q.yaml"):
        sinks.save_profile(doc, name)
        assert sinks.load_profile(name)["source_hash"] == doc["source_hash"]
    sinks.write_text('{"version": "2.0"}', f"file://{tmp_path}/other.json")
    with pytest.raises(ValueError):
        sinks.load_profile(f"{tmp_path}/other.json")
    s = scenario.from_profile(doc, 0.1)
    assert s.tables["region"].count == scenario.Fixed(1)
    assert s.tables["orders"].count.parent == "customer"
    with pytest.raises(scenario.ScenarioError):
        scenario.from_profile(doc, 0)
    assert ("numeric", "orders", "o_totalprice") in profiler.planned(g)


def test_growth_goldens(spark):
    from millrace import queries as Q

    rows = {r.b: r.new for r in Q.QUERIES["new_by_bucket"](spark, SF).collect()}
    assert [rows[b] for b in range(6)] == [10, 4, 6, 8, 12, 14]  # fixed values


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a'b", None), (2, None, 1.5)], "id long, s string, x double")
    text = "\n".join(r.sql for r in sinks.insert_statements(df.coalesce(1), 't"x', 1).collect())
    assert 'INSERT INTO "t""x" ("id", "s", "x") VALUES' in text and "(1, 'a''b', NULL)" in text and "(2, NULL, 1.5)" in text
    sinks.write_parquet(df, str(tmp_path / "t.parquet"))
    with pytest.raises(ValueError):
        sinks.write_parquet(df, str(tmp_path / "t.parquet"), df.drop("x"))
    with pytest.raises(PermissionError):
        sinks.reset(spark, str(tmp_path), ("t",))
    with pytest.raises(PermissionError):
        sinks.reset(spark, "/data/prod", ("t",), confirm=True)
    assert sinks.reset(spark, str(tmp_path), ("t",), confirm=True) == ["t"]
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 0
    doc = sinks.export_collection({"a": df, "none": df.where("false")}).first().document
    back = sinks.import_collection(spark, doc)
    assert [r["id"] for r in back["a"]] == [1, 2] and back["none"] == []
    assert "region" in catalog.render(catalog.introspect(spark, SF), "json")


def test_stream_density(spark, tmp_path):
    from millrace.streaming.density import hourly_counts

    schema = spark.read.parquet(f"{SF}/events.parquet").select("ts").schema
    src = tmp_path / "in"
    spark.read.parquet(f"{SF}/events.parquet").select("ts").write.parquet(str(src))
    stream = hourly_counts(spark.readStream.schema(schema).parquet(str(src)))
    run = stream.writeStream.format("memory").queryName("density").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("density").agg({"cnt": "sum"}).first()[0] == spark.read.parquet(str(src)).count()


def test_simulate_prints_every_row(spark, monkeypatch, capsys):
    from millrace import cli

    monkeypatch.setattr(cli.simulate, "simulate", lambda *_: spark.range(1500).selectExpr("'t' as table", "id as b"))
    assert cli.main(["simulate", "-"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "table\tb" and lines[1:] == [f"t\t{i}" for i in range(1500)]


def test_declared_parts_of_a_schema(spark):
    from millrace.plans.schema import Constraint

    g = catalog.introspect(spark, SF, catalog.DRIVER_KEYS, {"region": (Constraint("unique", ("r_name",)), Constraint("check", (), "r_regionkey >= 0 AND r_regionkey <= 9"))}, {"orders.o_orderstatus": ("F", "O", "P")}, ("part.p_size",))
    named = {t.name: {c.name: c for c in t.columns} for t in g.tables}
    assert named["part"]["p_size"].generated and not named["part"]["p_name"].generated
    assert named["orders"]["o_orderstatus"].labels == ("F", "O", "P") and g.enums == {"orders.o_orderstatus": ("F", "O", "P")}
    text = catalog.render(g, "yaml")
    assert "r_regionkey >= 0" in text and "unique" in text
    assert profiler.treatment("part", named["part"]["p_size"], profiler.Options()) == "generated"
    assert profiler.category(named["orders"]["o_orderstatus"]) == "categorical"


def test_offline_results_give_the_live_document(spark):
    options = profiler.Options(include_tables=("region", "nation", "customer", "orders"), exclude_columns=("customer.c_acctbal",))
    g = catalog.introspect(spark, SF, catalog.DRIVER_KEYS)
    live = profiler.collect(spark, SF, g, options)
    frames = {t.name: spark.read.parquet(f"{SF}/{t.name}.parquet") for t in g.tables}
    text = offline.export_profile(frames, g, options).first().document
    assert "Customer#" not in text and offline.import_profile(text) == live
    with pytest.raises(ValueError):
        offline.import_profile(text.replace('"version": "1.0"', '"version": "9"'))
    with pytest.raises(Exception, match="more than 3 rows"):
        sinks.export_collection({"x": spark.range(4)}, 3).collect()


def test_sql_files_are_transactions(spark, tmp_path):
    sinks.write_sql(spark.range(5).coalesce(1), "t", str(tmp_path / "sql"), 2)
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/sql/part-*", wholetext=True).collect())
    assert "BEGIN" not in text and text.count("INSERT INTO") == 3
    sinks.write_sql(spark.range(9).repartition(3), "t", str(tmp_path / "more"))
    load = sinks.read_text(f"{tmp_path}/more/{sinks.LOADER}")
    assert load.startswith("BEGIN;\nSET session_replication_role = 'replica';") and load.count("COMMIT;") == 1 and load.count("\\ir part-") == 3
    sinks.write_json(spark.range(3), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_jdbc_sink(spark):
    url, driver = "jdbc:derby:memory:millrace;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    sinks.write_jdbc(spark.range(2500).selectExpr("id", "concat('n', id) as name"), url, "people", driver=driver)
    back = spark.read.format("jdbc").options(url=url, dbtable="people", driver=driver).load()
    assert sorted((r.id, r.name) for r in back.select("id", "name").collect()) == [(i, f"n{i}") for i in range(2500)]


def test_command_line(spark, tmp_path, capsys):
    from millrace import cli

    out = str(tmp_path / "p.json")
    assert cli.main(["introspect", SF, "--include", "region", "nation"]) == 0 and "n_regionkey" in capsys.readouterr().out
    assert cli.main(["profile", SF, "--include", "region", "nation", "--output", out]) == 0
    assert cli.main(["profile", SF, "--include", "region", "nation", "--export", "--output", f"{out}.raw"]) == 0
    assert cli.main(["profile", SF, "--import-results", f"{out}.raw", "--output", f"{out}.json"]) == 0
    assert sinks.load_profile(out) == sinks.load_profile(f"{out}.json")
    assert cli.main(["comply", SF, "--profile", out]) == 0
    assert cli.main(["generate", SF, "--include", "region", "nation", "--profile", out, "--seed", "3", "--output", str(tmp_path / "made")]) == 0
    assert spark.read.parquet(str(tmp_path / "made/nation.parquet")).count() == 25
    assert cli.main(["generate", SF, "--include", "region", "--entities", "region=7", "--dry-run"]) == 0
    capsys.readouterr()
    assert cli.main(["validate", "-", "--scenario", "lifecycle"]) == 0 and "with a lifecycle" in capsys.readouterr().out
    assert cli.main(["completions"]) == 0 and "introspect" in capsys.readouterr().out
    assert cli.main(["profile", SF, "--include", "region", "--dry-run"]) == 0 and "row_count region" in capsys.readouterr().out
