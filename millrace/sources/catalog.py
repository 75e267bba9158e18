"""Introspection of a directory of Parquet tables, and rendering of schema graphs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.plans.schema import Column, Constraint, ForeignKey, SchemaGraph, Table

#: Keys of the driver's tables, which Parquet cannot carry.
DRIVER_KEYS = tuple(
    ForeignKey(*k)
    for k in (
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("events", "user_id", "customer", "c_custkey"),
        ("labels", "doc_id", "documents", "doc_id"),
    )
)


#: Constraints and enum labels of the driver's tables, which Parquet cannot carry either.
DRIVER_CONSTRAINTS = {
    "region": (Constraint("primary_key", ("r_regionkey",)), Constraint("unique", ("r_name",))),
    "nation": (Constraint("primary_key", ("n_nationkey",)),),
    "customer": (Constraint("primary_key", ("c_custkey",)),),
    "part": (Constraint("primary_key", ("p_partkey",)), Constraint("check", ("p_size",), "p_size > 0"), Constraint("check", ("p_size",), "p_size >= 10 AND p_size <= 40")),
    "orders": (Constraint("primary_key", ("o_orderkey",)), Constraint("check", ("o_totalprice",), "o_totalprice > 0")),
    "lineitem": (Constraint("unique", ("l_orderkey", "l_linenumber")),),
}
DRIVER_ENUMS = {"orders.o_orderstatus": ("F", "O", "P"), "lineitem.l_returnflag": ("A", "N")}


def table_names(spark: SparkSession, directory: str) -> list[str]:
    """Tables (``name.parquet`` files or folders) in name order, listed by Hadoop so that any store works."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def introspect(spark: SparkSession, directory: str, keys: Iterable[ForeignKey] = (), constraints: Mapping[str, tuple[Constraint, ...]] | None = None, enums: Mapping[str, tuple[str, ...]] | None = None, generated: Iterable[str] = ()) -> SchemaGraph:
    """The graph of a directory; keys, constraints, enums (table.column: labels) and generated columns are declared."""
    constraints, enums, generated = constraints or {}, enums or {}, set(generated)
    tables = []
    for name in table_names(spark, directory):
        fields = spark.read.parquet(f"{directory}/{name}.parquet").schema.fields
        columns = tuple(Column(f.name, f.dataType, f.nullable, generated=f"{name}.{f.name}" in generated, max_length=f.metadata.get("max_length"), labels=tuple(enums.get(f"{name}.{f.name}", ()))) for f in fields)
        tables.append(Table(name, columns, tuple(constraints.get(name, ()))))
    have = {(t.name, c.name) for t in tables for c in t.columns}
    return SchemaGraph(tuple(tables), tuple(k for k in keys if (k.table, k.column) in have and (k.parent, k.parent_column) in have), dict(sorted(enums.items())))


def discovered(spark: SparkSession, directory: str) -> SchemaGraph:
    """The graph of a directory whose keys, unique sets and short label lists are found in its data."""
    from millrace.operators import discovery

    tables = {t: spark.read.parquet(f"{directory}/{t}.parquet") for t in table_names(spark, directory)}
    constraints = {t: discovery.key_constraints(discovery.unique_sets(df)) for t, df in tables.items()}
    texts = discovery.labels_frame(tables).where("value is not null").collect()  # at most a guard's number for each column
    enums: dict[str, list[str]] = {}
    for r in texts:
        if isinstance(tables[r.table].schema[r.column].dataType, StringType):
            enums.setdefault(f"{r.table}.{r.column}", []).append(r.value)
    return introspect(spark, directory, discovery.foreign_keys(tables), constraints, {k: tuple(sorted(v)) for k, v in enums.items()})


def declared(path: str) -> tuple[ForeignKey, ...]:
    """Keys of a JSON file: a list of [table, column, parent, parent column]."""
    with open(path, encoding="utf-8") as f:
        return tuple(ForeignKey(*map(str, k)) for k in json.load(f))


def columns_frame(spark: SparkSession, graph: SchemaGraph) -> DataFrame:
    """(table, position, column, type, nullable) of a graph as a DataFrame."""
    rows = [(t.name, i, c.name, c.type.simpleString(), c.nullable) for t in graph.tables for i, c in enumerate(t.columns)]
    return spark.createDataFrame(rows, "`table` string, position int, column string, type string, nullable boolean")


def tables_frame(spark: SparkSession, graph: SchemaGraph) -> DataFrame:
    return spark.createDataFrame([(t.name, len(t.columns)) for t in graph.tables], "`table` string, n_columns long")


def keys_frame(spark: SparkSession, graph: SchemaGraph) -> DataFrame:
    return spark.createDataFrame([(k.table, k.column, k.parent, k.parent_column) for k in graph.keys], "`table` string, column string, parent string, parent_column string")


def constraints_frame(spark: SparkSession, directory: str, graph: SchemaGraph) -> DataFrame:
    """(table, kind, columns, rule, violations): every declared constraint and enum with the rows that break it.

    A key's violations are the rows beyond the first of each value; an enum's the rows with another label.
    """
    from millrace.operators import audit

    parts = []

    def add(table: str, kind: str, columns: Iterable[str], rule: str, found: DataFrame) -> None:
        parts.append(found.select(F.lit(table).alias("table"), F.lit(kind).alias("kind"), F.lit(",".join(columns)).alias("columns"), F.lit(rule).alias("rule"), F.col(found.columns[0]).cast("long").alias("violations")))

    for t in graph.tables:
        df = spark.read.parquet(f"{directory}/{t.name}.parquet")
        for c in t.constraints:
            if c.kind != "check":
                add(t.name, c.kind, c.columns, "", audit.duplicate_count(df, *c.columns))
            elif parsed := audit.parse_check(c.text):
                add(t.name, c.kind, c.columns, c.text, audit.violations(df, bad=parsed[1]))
        for name, labels in graph.enums.items():
            if name.split(".")[0] == t.name:
                column = name.split(".")[1]
                add(t.name, "enum", (column,), ",".join(labels), audit.violations(df, bad=~F.col(column).isin(list(labels))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def treatments_frame(spark: SparkSession, graph: SchemaGraph, treatment: Callable[[str, Column], str]) -> DataFrame:
    """(table, column, treatment): how a profile would read every column."""
    rows = [(t.name, c.name, treatment(t.name, c)) for t in graph.tables for c in t.columns]
    return spark.createDataFrame(rows, "`table` string, column string, treatment string")


def render(graph: SchemaGraph, form: str = "table") -> str:
    """A graph as text: ``table``, ``json`` or ``yaml``."""
    plain = {
        "tables": [{"name": t.name, "columns": [{"name": c.name, "type": c.type.simpleString(), "nullable": c.nullable} for c in t.columns], "constraints": [{"kind": x.kind, "columns": list(x.columns), "text": x.text} for x in t.constraints]} for t in graph.tables],
        "foreign_keys": [{"table": k.table, "column": k.column, "parent": k.parent, "parent_column": k.parent_column} for k in graph.keys],
    }
    if form == "json":
        return json.dumps(plain, indent=2)
    if form == "yaml":
        import yaml

        return yaml.safe_dump(plain, sort_keys=False)
    lines = []
    for t in graph.tables:
        lines += [t.name, *(f"  {c.name:<24} {c.type.simpleString():<16} {'null' if c.nullable else 'not null'}" for c in t.columns)]
    return "\n".join([*lines, *(f"{k.table}.{k.column} -> {k.parent}.{k.parent_column}" for k in graph.keys)])


def discover_keys(spark: SparkSession, directory: str, graph: SchemaGraph) -> DataFrame:
    """Extension: declared keys with their orphans counted, all in one frame."""
    from millrace.operators.audit import orphans

    out = None
    for k in graph.keys:
        child, parent = (spark.read.parquet(f"{directory}/{t}.parquet") for t in (k.table, k.parent))
        row = orphans(child, k.column, parent, k.parent_column).select(F.lit(f"{k.table}.{k.column}").alias("key"), F.lit(f"{k.parent}.{k.parent_column}").alias("parent"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out
