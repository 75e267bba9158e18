"""A profile without access: one query makes a JSON text of all results, another place makes the document of it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import profile as P
from millrace.plans import profiler
from millrace.plans.profiler import Options
from millrace.plans.schema import SchemaGraph
from millrace.sources.sinks import rows_as_json

#: Months and hours of a column; more rows in one result fail the query.
MAX_ROWS = 10_000


def _result(df: DataFrame, kind: str, table: str, column: str | None = None, parent: str | None = None) -> DataFrame:
    return rows_as_json(df, MAX_ROWS).select(F.struct(F.lit(kind).alias("kind"), F.lit(table).alias("table"), F.lit(column).alias("column"), F.lit(parent).alias("parent"), "rows").alias("x"))


def export_profile(frames: Mapping[str, DataFrame], graph: SchemaGraph, options: Options | None = None) -> DataFrame:
    """(document): one JSON text of every result that a profile of ``frames`` needs; no value of a column over the guard.

    A distribution is guarded within its own plan, by the column's number of distinct values.
    """
    options = options or Options()
    graph = graph.filtered(options.include_tables, options.exclude_tables)
    parts, skipped = [], []
    for t in graph.tables:
        df = frames[t.name]
        parts.append(_result(P.row_count(df), "row_count", t.name))
        for c in t.columns:
            how = profiler.treatment(t.name, c, options)
            if how == "numeric":
                parts.append(_result(P.numeric_stats(df, c.name), "numeric", t.name, c.name))
            elif how == "boolean":
                parts.append(_result(P.boolean_stats(df, c.name), "boolean", t.name, c.name))
            elif how == "timestamp":
                parts += [_result(f(df, c.name), k, t.name, c.name) for k, f in (("timestamp", P.timestamp_stats), ("monthly", P.monthly_density), ("hourly", P.hourly_density))]
            elif how in ("string", "categorical"):
                most = profiler.most_values(c, options)
                guarded = P.guarded_categorical(df, c.name, most)
                stats = P.string_stats(df, c.name).withColumn("most", F.lit(most))
                parts += [_result(stats, "string", t.name, c.name), _result(guarded, "distribution", t.name, c.name)]
            elif profiler.skipped_document(how):
                skipped.append({"table": t.name, "column": c.name, "why": how})
    for k in graph.keys:
        parts.append(_result(P.parent_ratio(frames[k.table], k.column), "parent_ratio", k.table, k.column, k.parent))
        parts.append(_result(P.childless(frames[k.parent], k.parent_column, frames[k.table], k.column), "parent_zero", k.table, k.column, k.parent))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    head = json.dumps({"version": profiler.VERSION, "source_hash": profiler.source_hash(graph), "skipped": skipped})[:-1]
    results = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.concat(F.lit('{"of":'), F.to_json(F.struct(x["kind"].alias("kind"), x["table"].alias("table"), x["column"].alias("column"), x["parent"].alias("parent"))), F.lit(',"rows":'), x["rows"], F.lit("}")))
    return every.agg(F.concat(F.lit(head + ', "results":['), F.array_join(results, ","), F.lit("]}")).alias("document"))


def import_profile(document: str) -> dict[str, Any]:
    """The profile document of an exported text, as ``profiler.collect`` makes it; columns over the guard stay without values."""
    plain = json.loads(document)
    if plain.get("version") != profiler.VERSION:
        raise ValueError(f"unknown version {plain.get('version')!r}")
    by: dict[str, dict[str | None, dict[str, list[dict]]]] = {}
    for r in plain["results"]:
        of = r["of"]
        by.setdefault(of["table"], {}).setdefault(of.get("column"), {})[of["kind"] + (":" + of["parent"] if of.get("parent") else "")] = r["rows"]
    tables: dict[str, dict] = {}
    for name, columns in by.items():
        out: dict[str, dict] = {}
        ratios: dict[str, dict] = {}
        for column, kinds in columns.items():
            for kind, rows in kinds.items():
                if kind.startswith("parent_ratio:"):
                    parent = kind.partition(":")[2]
                    zero = kinds.get(f"parent_zero:{parent}") or [{}]
                    ratios[f"{parent}.{column}"] = profiler.ratio_document(rows[0], zero[0].get("zero_rate"))
            if column is None or not set(kinds) & {"numeric", "boolean", "timestamp", "string"}:
                continue
            kind = next(k for k in ("numeric", "boolean", "timestamp", "string") if k in kinds)
            own = kinds[kind][0]
            shares = {r["value"]: r["pct"] for r in kinds.get("distribution", [])} if kind == "string" and own["cardinality"] <= own["most"] else None
            months = {r["month"]: r["cnt"] for r in kinds.get("monthly", [])}
            hours = {str(r["hour"]): r["pct"] for r in kinds.get("hourly", [])}
            out[column] = profiler.column_document(kind, own, shares, months, hours)
        rows = columns.get(None, {}).get("row_count") or [{}]
        tables[name] = {"row_count": rows[0].get("row_count", 0), "columns": out, "parent_ratios": ratios}
    for s in plain["skipped"]:
        tables[s["table"]]["columns"][s["column"]] = profiler.skipped_document(s["why"])
    for t in tables.values():
        t["columns"] = dict(sorted(t["columns"].items()))
    return {"version": plain["version"], "source_hash": plain["source_hash"], "tables": dict(sorted(tables.items()))}
