"""The profile of a whole directory as one document, with guards and an audit trail."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.classify import SENSITIVE_PATTERNS, is_sensitive, qualified
from millrace.operators import profile as P
from millrace.operators.discovery import labels
from millrace.plans.schema import Column, SchemaGraph, Table

VERSION = "1.0"
NUMERIC = ("short", "integer", "long", "byte", "float", "double", "decimal")
TIMES = ("date", "timestamp", "timestamp_ntz")


@dataclass(frozen=True)
class Options:
    threshold: int = 50
    exclude_columns: tuple[str, ...] = ()
    include_columns: tuple[str, ...] = ()
    sensitive_patterns: tuple[str, ...] = SENSITIVE_PATTERNS
    include_tables: tuple[str, ...] = ()
    exclude_tables: tuple[str, ...] = ()
    joint: Mapping[str, Sequence[str]] = field(default_factory=dict)  # table: numeric columns profiled together


@dataclass
class Audit:
    """What was asked and what was skipped; never a value."""

    lines: list[str] = field(default_factory=list)

    def query(self, kind: str, table: str, column: str = "*") -> None:
        self.lines.append(f"QUERY {kind} {table}.{column}")

    def skip(self, why: str, table: str, column: str) -> None:
        self.lines.append(f"SKIP {why} {table}.{column}")


def category(column: Column) -> str:
    kind = column.type.typeName()
    if column.labels:
        return "categorical"
    if kind in NUMERIC:
        return "numeric"
    if kind in TIMES:
        return "timestamp"
    return {"boolean": "boolean", "string": "string", "varchar": "string", "char": "string"}.get(kind, "skip")


def treatment(table: str, column: Column, options: Options) -> str:
    """serial, generated, excluded, sensitive, skip or a category, in this order."""
    if column.identity:
        return "serial"
    if column.generated:
        return "generated"
    if qualified(table, column.name, options.exclude_columns):
        return "excluded"
    if is_sensitive(column.name, options.sensitive_patterns) and not qualified(table, column.name, options.include_columns):
        return "sensitive"
    return category(column)


def source_hash(graph: SchemaGraph) -> str:
    """sha256 of ``table:column,column;`` over tables in name order, columns in name order."""
    text = "".join(f"{t.name}:{','.join(sorted(c.name for c in t.columns))};" for t in sorted(graph.tables, key=lambda t: t.name))
    return hashlib.sha256(text.encode()).hexdigest()


def _zero(x: Any) -> Any:
    return 0.0 if x is None else x


_RATIO = {"avg": "avg_ratio", "min": "min_ratio", "max": "max_ratio", "median": "median_ratio", "stddev": "stddev_ratio", "p25": "p25_ratio", "p75": "p75_ratio", "p95": "p95_ratio", "p99": "p99_ratio"}


def column_document(kind: str, own: Mapping[str, Any], shares: Mapping[str, float] | None = None, months: Mapping[str, int] | None = None, hours: Mapping[str, float] | None = None) -> dict:
    """One column's part of the document from its statistics."""
    rate = {"null_rate": _zero(own.get("null_rate"))}
    if kind == "numeric":
        named = {"min": "min_val", "max": "max_val", "mean": "mean_val", "median": "p50", "stddev": "stddev_val"}
        return {"type": "numeric", **{k: _zero(own.get(v)) for k, v in named.items()}, **rate, "percentiles": {p: _zero(own.get(p)) for p in ("p25", "p50", "p75", "p95", "p99")}}
    if kind == "boolean":
        return {"type": "boolean", "true_rate": _zero(own.get("true_rate")), **rate}
    if kind == "timestamp":
        return {"type": "timestamp", "range": [own.get("min_ts"), own.get("max_ts")], **rate, "weekday_ratio": own.get("weekday_ratio"), "hourly_density": dict(sorted((hours or {}).items(), key=lambda x: int(x[0]))), "monthly_density": dict(sorted((months or {}).items()))}
    if shares is not None:
        return {"type": "categorical", "distribution": dict(sorted(shares.items())), **rate}
    return {"type": "string", "cardinality": own["cardinality"], **rate, "avg_length": own.get("avg_length"), "min_length": own.get("min_length"), "max_length": own.get("max_length")}


def ratio_document(own: Mapping[str, Any], zero_rate: float | None) -> dict:
    return {**{k: _zero(own.get(v)) for k, v in _RATIO.items()}, "zero_rate": zero_rate}


def skipped_document(how: str) -> dict | None:
    """What a column that is not profiled leaves; unknown types leave nothing."""
    if how == "sensitive":
        return {"type": "skipped_sensitive", "reason": "name"}
    return {"excluded": {"type": "skipped_excluded"}, "serial": {"type": "serial"}, "generated": {"type": "serial"}}.get(how)


def most_values(column: Column, options: Options) -> int:
    """How many distinct values a column's distribution may show: the threshold, or all declared labels."""
    return max(options.threshold, len(column.labels))


def _aggregates(df: DataFrame, how: str, c: str) -> list[Any]:
    if how == "numeric":
        return P.numeric_aggregates(c)
    if how == "boolean":
        return P.boolean_aggregates(c)
    if how == "timestamp":
        return P.timestamp_aggregates(c)
    return P.length_aggregates(c) if df.schema[c].dataType.typeName() in ("string", "varchar", "char") else [P.null_rate(c).alias("null_rate")]


def _shares(df: DataFrame, wanted: list[tuple[str, str]]) -> dict[tuple[str, str], dict[str, int]]:
    """Counts of (kind, column) by value, all by one grouping. Their numbers were checked before."""
    if not wanted:
        return {}
    value = {"month": lambda c: F.date_format(F.date_trunc("month", F.col(c)), "yyyy-MM"), "hour": lambda c: F.hour(F.col(c)).cast("string")}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), value[k](c).alias("value")) for k, c in wanted]))
    counts = df.select(rows.alias("x")).select("x.*").where("value is not null").groupBy("kind", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    out: dict[tuple[str, str], dict[str, int]] = {w: {} for w in wanted}
    for r in counts.collect():
        out[r["kind"], r["column"]][r["value"]] = r["n"]
    return out


def _guarded(df: DataFrame, texts: list[str], threshold: int) -> dict[str, dict[str, int]]:
    """Counts by value of the columns with at most so many values; of others no value leaves its task's bounded set."""
    if not texts:
        return {}
    out: dict[str, dict[str, int]] = {}
    for r in labels(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in texts]), threshold).collect():
        out.setdefault(r["column"], {})[r["value"]] = r["n"]
    return out


def _percents(counts: dict[str, int]) -> dict[str, float]:
    total = sum(counts.values())
    return {k: n * 100.0 / total for k, n in counts.items()}


def collect(spark: SparkSession, directory: str, graph: SchemaGraph, options: Options | None = None, audit: Audit | None = None) -> dict:
    """The profile document: tables, columns and ratios to parents. Only aggregates reach the driver.

    A table is read a fixed number of times, whatever its number of columns: for one wide aggregate, four times for
    percentiles, for the labels of all texts within the guard, for the distinct counts of the other
    texts, and for months and hours.
    """
    options, audit = options or Options(), audit or Audit()
    graph = graph.filtered(options.include_tables, options.exclude_tables)
    read = {t.name: spark.read.parquet(f"{directory}/{t.name}.parquet") for t in graph.tables}
    tables: dict[str, dict] = {}
    for t in graph.tables:
        tables[t.name] = _table_document(read[t.name], t, options, audit)
    for k in graph.keys:
        audit.query("parent_ratio", k.table, k.column)
        r = P.parent_ratio(read[k.table], k.column).first()
        zero = P.childless(read[k.parent], k.parent_column, read[k.table], k.column).first()
        # Keyed by parent and column, so that two keys to one parent do not collide.
        tables[k.table]["parent_ratios"][f"{k.parent}.{k.column}"] = ratio_document(r.asDict(), zero["zero_rate"])
    return {"version": VERSION, "source_hash": source_hash(graph), "tables": dict(sorted(tables.items()))}


def _table_document(df: DataFrame, t: Table, options: Options, audit: Audit) -> dict:
    how = {c.name: treatment(t.name, c, options) for c in t.columns}
    read = {c: h for c, h in how.items() if h in ("numeric", "boolean", "timestamp", "string", "categorical")}
    audit.query("row_count", t.name)
    for c, h in read.items():
        audit.query(h, t.name, c)
    one = df.agg(F.count(F.lit(1)).alias("*"), *[F.struct(*_aggregates(df, h, c)).alias(c) for c, h in read.items()]).first()
    own = {c: one[c].asDict() for c in read}
    numeric = [c for c, h in read.items() if h == "numeric"]
    if numeric:
        for r in P.percentiles(df, numeric).collect():
            own[r["column"]].update(r.asDict())
    texts = [c for c, h in read.items() if h in ("string", "categorical")]
    most = {c.name: most_values(c, options) for c in t.columns}
    found = _guarded(df, texts, max((most[c] for c in texts), default=0))
    many = [c for c in texts if c not in found]
    own_sizes = {r["column"]: r["cardinality"] for r in P.cardinalities(df, many).collect()} if many else {}
    for c in texts:
        own[c]["cardinality"] = len(found[c]) if c in found else own_sizes.get(c, 0)
    shown = [c for c in texts if own[c]["cardinality"] <= most[c]]
    for c in shown:
        audit.query("distribution", t.name, c)
    counts = _shares(df, [(k, c) for c, h in read.items() if h == "timestamp" for k in ("month", "hour")])
    counts |= {("value", c): found.get(c, {}) for c in shown}
    columns: dict[str, dict] = {}
    for c, h in how.items():
        if c in read:
            shares = _percents(counts["value", c]) if c in shown else None
            columns[c] = column_document(h, own[c], shares, counts.get(("month", c)), _percents(counts.get(("hour", c), {})))
        else:
            audit.skip(h, t.name, c)
            if left := skipped_document(h):
                columns[c] = left
    document = {"row_count": one["*"], "columns": dict(sorted(columns.items())), "parent_ratios": {}}
    together = [c for c in options.joint.get(t.name, ()) if read.get(c) == "numeric"]
    if len(together) > 1:
        audit.query("joint", t.name, ",".join(together))
        document["joint"] = P.joint_shape(df, together)
    return document


def planned(graph: SchemaGraph, options: Options | None = None) -> list[tuple[str, str, str]]:
    """(kind, table, column) of the queries a collection would make, without making them."""
    options = options or Options()
    out: list[tuple[str, str, str]] = []
    for t in graph.filtered(options.include_tables, options.exclude_tables).tables:
        out.append(("row_count", t.name, "*"))
        for c in t.columns:
            kinds: Sequence[str] = {"numeric": ("numeric",), "boolean": ("boolean",), "timestamp": ("timestamp", "monthly", "hourly"), "string": ("cardinality", "string"), "categorical": ("cardinality", "distribution")}.get(treatment(t.name, c, options), ())
            out += [(k, t.name, c.name) for k in kinds]
    return out + [(k, f.table, f.column) for f in graph.keys for k in ("parent_ratio", "parent_zero")]
