"""Generation of whole tables over calendar buckets: growth, churn, parents, times, overrides.

Only tables depend on each other, parents first; buckets are rows, and no loop runs over them.
What later tables need of one (ids, keys, times, churn) is written once and read back.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.prf import bulk, draw, unit
from millrace.operators import lifecycle as L
from millrace.operators import relations
from millrace.plans import generate, simulate
from millrace.plans.scenario import Churn, Scenario, TablePlan, parse_churn, parse_temporal
from millrace.plans.schema import ForeignKey, SchemaGraph, Table, resolve
from millrace.sources.scratch import materialize

#: The column that churn is stamped on; a row's own time is in ``created_at``.
CHURN_TIME_COLUMN = "churned_at"


@dataclass
class _World:
    spark: SparkSession
    scenario: Scenario
    seed: int
    buckets: DataFrame
    spans: list[tuple[int, date, date]]
    entities: dict[str, DataFrame]
    frames: dict[str, DataFrame]


def grow(spark: SparkSession, graph: SchemaGraph, scenario: Scenario, seed: int | None = None) -> dict[str, DataFrame]:
    """``grown`` with bulk draws."""
    with bulk():
        return grown(spark, graph, scenario, seed)


def grown(spark: SparkSession, graph: SchemaGraph, scenario: Scenario, seed: int | None = None) -> dict[str, DataFrame]:
    """Every table with growth, and those with a fixed count, by name.

    New rows of a bucket get a parent active in it (or, without cascade, any born by then), a time
    in the bucket or relative to the parent's, and start un-churned; churn sets its column and
    stamps ``churned_at``. Timelines hold at a bucket's first day. Ids run over all buckets.
    """
    seed = seed if seed is not None else scenario.seed if scenario.seed is not None else 42
    start, end, unit_name = simulate.bounds(scenario)
    spans = L.bucket_bounds(start, end, unit_name)
    fixed = tuple(n for n, t in scenario.tables.items() if not t.growth and t.count)
    static = generate.generated(spark, graph.filtered(include=fixed), scenario, seed) if fixed else {}
    world = _World(spark, scenario, seed, L.buckets(spark, start, end, unit_name), spans, {}, dict(static))
    tables, plan = {t.name: t for t in graph.tables}, resolve(graph)
    for name in simulate.order(scenario):
        if name in tables:
            _grow_table(world, tables[name], [k for k in graph.keys if k.table == name and k not in plan.deferred], {k.column for k in plan.deferred if k.table == name})
    for k in plan.deferred:
        if k.table in world.frames and k.parent in world.frames:
            world.frames[k.table] = relations.deferred_update(world.frames[k.table], generate.key_column(tables[k.table]), world.frames[k.parent], k.parent_column, k.column, seed)
    return world.frames


def _grow_table(w: _World, table: Table, keys: list[ForeignKey], late: set[str]) -> None:
    name, plan = table.name, w.scenario.tables[table.name]
    churn = parse_churn(plan.churn)
    rows = L.entities(simulate.new_by_bucket(name, plan, w.buckets, w.entities, len(w.spans) - 1, w.seed), name, w.seed)
    for k in keys:
        rows = _with_parent(w, rows, k)
    if any(k.parent in w.entities and k.parent != plan.growth.get("follows") for k in keys):
        rows = L.renumbered(materialize(rows, name))  # rows of buckets without an active parent have gone
    for column, spec in plan.temporal.items():
        rows = _with_time(w, rows, name, column, spec, keys)
    rows = materialize(L.churned(rows, w.buckets, name, w.seed, churn.rate, churn.grace), name)
    w.entities[name] = rows
    w.frames[name] = _columns(w, rows, table, plan, churn, late)


def _with_parent(w: _World, rows: DataFrame, k: ForeignKey) -> DataFrame:
    key = f"{k.table}.{k.column}.parent"
    if k.parent == k.table:
        return relations.assign_earlier_self(rows, "id", k.column, w.seed)
    if k.parent in w.entities:
        parents = w.entities[k.parent]
        if parse_churn(w.scenario.tables[k.parent].churn).cascade:
            return L.with_active_parent(rows, L.active_pairs(parents, len(w.spans) - 1), k.column, key, w.seed)
        return L.with_born_parent(rows, L.active_counts(parents, w.buckets), k.column, key, w.seed)
    if k.parent in w.frames:
        return relations.assign_parent(rows, F.concat_ws(":", F.lit(key), F.col("id").cast("string")), w.frames[k.parent], k.parent_column, k.column, w.seed, k.nullable)
    if not k.nullable:
        raise relations.MissingParentError(f"{k.table}.{k.column}")
    return rows.withColumn(k.column, F.lit(None).cast("long"))


def _with_time(w: _World, rows: DataFrame, name: str, column: str, spec: dict[str, Any], keys: list[ForeignKey]) -> DataFrame:
    relation, parent, source, (low, high) = parse_temporal(spec)
    k = next((k for k in keys if k.parent == parent), None)
    if k is None or parent not in w.entities:
        return rows
    own = w.entities[parent]
    times = own if source in own.columns else w.frames[parent]
    times = times.select(F.col("id"), F.col(source).alias("at"))
    return L.with_time_by_parent(rows, times, k.column, column, w.buckets, f"{name}.{column}.offset", w.seed, relation, low, high)


def _timeline(w: _World, rows: DataFrame, key: str, frames: dict[str, dict[str, float]], kind: str) -> Any:
    """A key of the timeline's weights at the row's bucket, which are one small array for each bucket."""
    plain = [(date.fromisoformat(at), k, float(x)) for at, weights in frames.items() for k, x in weights.items()]
    dates = w.spark.createDataFrame([(s,) for _, s, _ in w.spans], "d date")
    weights = L.interpolated(w.spark.createDataFrame(plain, "at date, key string, weight double"), dates).collect()  # buckets x keys
    by_day: dict[date, dict[str, float]] = {}
    for r in weights:
        by_day.setdefault(r.d, {})[r.key] = max(0.0, r.weight)
    picks = []
    for _, s, _ in w.spans:
        upto, own = 0.0, []
        for k, x in sorted(by_day[s].items()):
            upto += x
            own += [F.struct(F.lit(upto).alias("upto"), F.lit(k).alias("key"))] if x > 0 else []
        picks.append(F.array(*own) if own else F.array(F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("string").alias("key"))))
    here = F.element_at(F.array(*picks), F.col("created_b") + 1)
    at = unit(draw(w.seed, key, F.col("id"))) * F.element_at(here, -1)["upto"]
    return F.coalesce(F.get(F.filter(here, lambda p: at < p["upto"]), F.lit(0)), F.element_at(here, -1))["key"].cast(kind)


def _columns(w: _World, rows: DataFrame, table: Table, plan: TablePlan, churn: Churn, late: set[str]) -> DataFrame:
    n, gone = rows.count(), F.col("churn_b").isNotNull()
    made = set(rows.columns) - {"created_b", "churn_b", CHURN_TIME_COLUMN}
    df, out = rows.withColumn("_row", F.col("id") - 1), []
    for c in table.columns:
        own = plan.overrides.get(c.name)
        if c.generated:
            continue
        if c.identity or c.name == generate.key_column(table):
            value = F.col("id")
        elif c.name in late:
            value = F.lit(None)
        elif plan.churn and c.name == churn.column and isinstance(churn.value, bool):
            value = F.when(gone, F.lit(churn.value)).otherwise(F.lit(not churn.value))
        elif plan.churn and c.name == CHURN_TIME_COLUMN:
            value = F.col(CHURN_TIME_COLUMN)
        elif c.name in made:
            value = F.col(c.name)
        elif own is not None and own.kind == "timeline":
            value = _timeline(w, rows, f"{table.name}.{c.name}", own.value, c.type.simpleString())
        else:
            value = generate.column_value(c, table, n, w.scenario, w.seed)
            if plan.churn and c.name == churn.column:
                value = F.when(gone, F.lit(churn.value).cast(c.type)).otherwise(value)
        out.append(value.cast(c.type).alias(c.name))
    return df.select(*out)
