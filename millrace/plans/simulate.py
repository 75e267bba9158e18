"""Dry run of a lifecycle scenario: new, churned and active entities of every table and bucket."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import lifecycle as L
from millrace.plans.scenario import Scenario, TablePlan, parse_churn


def order(scenario: Scenario) -> list[str]:
    """Followed tables first, by name; those that follow an unknown or circular one come last."""
    out: list[str] = []
    left = sorted(n for n, t in scenario.tables.items() if t.growth)
    while left:
        ready = [n for n in left if scenario.tables[n].growth.get("follows") in (None, *out)]
        if not ready:
            return out + left
        out += ready
        left = [n for n in left if n not in ready]
    return out


def _target(g: dict) -> tuple[Column, bool]:
    """(count by bucket, whether it is cumulative)."""
    b, model = F.col("b"), g.get("model", "linear")
    if model == "custom":
        return L.custom(b, g["values"]), False
    if model == "linear":
        return L.linear(b, g["initial"], g["rate"]), True
    if model == "exponential":
        return L.exponential(b, g["initial"], g["rate"]), True
    if model == "s_curve":
        return L.s_curve(b, g["initial"], g["capacity"], g["rate"]), True
    return L.logistic(b, g["initial"], g["capacity"], g["rate"], g["midpoint"]), True


def _ends(x: str | list) -> tuple[int, int]:
    low, high = x.split("..") if isinstance(x, str) else x
    return int(low), int(high)


def new_by_bucket(name: str, plan: TablePlan, buckets: DataFrame, done: dict[str, DataFrame], last: int, seed: int) -> DataFrame:
    g, s = plan.growth, plan.seasonality
    factor = L.season(F.col("b_start"), s.get("monthly", ()), s.get("quarterly", ()), s.get("weekly", ()))
    if "follows" not in g:
        target, cumulative = _target(g)
        return L.new_counts(buckets, target, cumulative, factor)
    parents = done.get(g["follows"])
    if parents is None:
        return buckets.withColumn("new", F.lit(0).cast("long"))
    if "per_parent" in g:
        own = L.follow_per_parent(L.active_pairs(parents, last), name, seed, *_ends(g["per_parent"]))
    else:
        own = L.follow_ratio(L.active_counts(parents, buckets), name, seed, float(g.get("ratio", 0)), float(g.get("variance", 0)))
    return L.new_counts(buckets.join(own.withColumnRenamed("new", "_own"), "b", "left"), F.coalesce("_own", F.lit(0)), False, factor).drop("_own")


def bounds(scenario: Scenario) -> tuple[date, date, str]:
    """Start, end (not included) and bucket of a scenario's lifecycle."""
    life = scenario.lifecycle or {}
    day = lambda x: x if isinstance(x, date) else date.fromisoformat(str(x))
    return day(life["start"]), day(life["end"]), life.get("bucket", "month")


def entities(spark: SparkSession, scenario: Scenario, seed: int | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The entities of every growing table, with their churn, and the buckets."""
    seed = seed if seed is not None else scenario.seed if scenario.seed is not None else 42
    buckets = L.buckets(spark, *bounds(scenario))
    last = buckets.count() - 1
    done: dict[str, DataFrame] = {}
    for name in order(scenario):
        plan = scenario.tables[name]
        rows = L.entities(new_by_bucket(name, plan, buckets, done, last, seed), name, seed)
        churn = parse_churn(plan.churn)
        done[name] = L.churned(rows, buckets, name, seed, churn.rate, churn.grace)
    return done, buckets


def simulate(spark: SparkSession, scenario: Scenario, seed: int | None = None) -> DataFrame:
    """(table, b, label, new, churned, active, total) of every growing table."""
    done, buckets = entities(spark, scenario, seed)
    unit = (scenario.lifecycle or {}).get("bucket", "month")
    out = None
    for name, rows in done.items():
        one = L.active_counts(rows, buckets).join(F.broadcast(buckets), "b")
        one = one.select(F.lit(name).alias("table"), "b", L.label(F.col("b_start"), unit).alias("label"), F.col("born").alias("new"), "churned", "active", "total")
        out = one if out is None else out.unionByName(one)
    return out
