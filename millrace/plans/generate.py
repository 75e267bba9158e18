"""Generation of whole databases: a schema graph and a scenario become one DataFrame per table."""

from __future__ import annotations

from collections.abc import Collection
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions import generators as G
from millrace.functions.classify import detect
from millrace.functions.prf import bulk, draw, unit
from millrace.operators import relations
from millrace.plans.scenario import Override, Scenario
from millrace.plans.schema import Column, ForeignKey, SchemaGraph, Table, resolve

_ROW = "_row"


class UniqueExhaustedError(ValueError):
    """A unique column cannot hold so many distinct values."""


def _overridden(o: Override, column: Column, seed: int, key: str) -> Any:
    kind, i = column.type.simpleString(), F.col(_ROW)
    if o.kind == "distribution":
        return G.weighted(i, seed, key, o.value, kind)
    if o.kind == "timeline":  # outside a simulation the last keyframe holds
        return G.weighted(i, seed, key, o.value[max(o.value)], kind)
    if o.kind == "quantiles":
        return G.shaped(unit(draw(seed, key, i)), o.value, kind)
    if o.kind == "density":
        return G.dated(i, seed, key, *o.value)
    if o.kind == "joint":  # (ranks of the table's joint columns, this one's place, its quantiles)
        counts, place, knots = o.value
        return G.shaped(G.joint_ranks(i, seed, key.partition(".")[0] + ".joint", counts)[place], knots, kind)
    if o.kind == "range":
        return G.ranged(i, seed, key, *o.value, kind)
    if o.kind == "generator":
        return G.GENERATORS[o.value](i, seed, key)
    return F.expr(o.value) if o.kind == "formula" else None


def _unique_columns(table: Table) -> set[str]:
    return {c.columns[0] for c in table.constraints if c.kind in ("unique", "primary_key") and len(c.columns) == 1}


def column_value(column: Column, table: Table, n: int, scenario: Scenario, seed: int) -> Any:
    """The expression of one column without a foreign key: override, else by name and type."""
    key, i = f"{table.name}.{column.name}", F.col(_ROW)
    plan = scenario.tables.get(table.name)
    own = _overridden(plan.overrides[column.name], column, seed, key) if plan and column.name in plan.overrides else None
    unique, kind, drawn = column.name in _unique_columns(table), column.type.typeName(), own is None
    if own is None and unique and kind in _COUNTED:
        return _counted(column, i, n, seed, key)
    if own is None:
        name, options = detect(column)
        own = G.GENERATORS[name](i, seed, key, **options)
        unique = unique and name not in ("uuid", "token")  # 122 and more random bits do not repeat
    if unique and isinstance(column.type, StringType):
        own = G.unique_text(own, i)
        if column.max_length is not None:
            tail = len(str(n))
            if column.max_length <= tail:
                raise UniqueExhaustedError(key)
            own = F.when(F.length(own) <= column.max_length, own).otherwise(F.right(own, F.lit(column.max_length)))
    elif column.max_length is not None and isinstance(column.type, StringType):
        own = F.left(own, F.lit(column.max_length))
    elif unique and not (drawn and kind == "string"):
        raise UniqueExhaustedError(key)
    null_rate = plan.null_rates.get(column.name, 0.0) if plan else 0.0
    if null_rate and column.nullable and not unique:
        own = G.with_nulls(own, i, seed, key, null_rate)
    return own.cast(column.type)


#: Types whose unique values are counted out by row id.
_COUNTED = ("short", "integer", "long", "date", "timestamp", "timestamp_ntz", "float", "double", "decimal")


def _counted(column: Column, i: Any, n: int, seed: int, key: str) -> Any:
    """Distinct by construction: ids, days or seconds counted back, the fraction after the id, or steps of a decimal."""
    kind = column.type.typeName()
    most = {"short": 2**15 - 1, "integer": 2**31 - 1, "date": 700_000, "float": 2**15}.get(kind, 2**40)
    if kind == "decimal":
        most = 10**column.type.precision - 1
    if n > most:
        raise UniqueExhaustedError(key)
    if kind in ("short", "integer", "long"):
        return (i + 1).cast(column.type)
    if kind == "date":
        return F.date_sub(F.lit(G.EPOCH[:10]).cast("date"), i.cast("int"))
    if kind in ("timestamp", "timestamp_ntz"):
        return (F.timestamp_seconds(F.unix_timestamp(F.lit(G.EPOCH).cast("timestamp")) - i)).cast(column.type)
    if kind == "decimal":
        return ((i + 1).cast("decimal(38,0)") / F.lit(10**column.type.scale).cast("decimal(38,0)")).cast(column.type)
    return (i + G.real(i, seed, key, 0, 0.5)).cast(column.type)


def key_column(table: Table) -> str | None:
    """What other tables point to: ``id`` if it is an identity, another identity, a generated ``id``, else the first uuid."""
    named = {c.name: c for c in table.columns}
    if "id" in named and named["id"].identity:
        return "id"
    for pick in (lambda c: c.identity, lambda c: c.name == "id", lambda c: "uuid" in c.name):
        for c in table.columns:
            if pick(c):
                return c.name
    return None


def _with_parents(df: DataFrame, table: Table, keys: list[ForeignKey], done: dict[str, DataFrame], seed: int) -> DataFrame:
    for k in keys:
        if k.parent == table.name:
            df = relations.assign_earlier_self(df, "_one", k.column, seed)
        else:
            df = relations.assign_parent(df, F.concat_ws(":", F.lit(f"{table.name}.{k.column}"), F.col(_ROW).cast("string")), done[k.parent], k.parent_column, k.column, seed, k.nullable)
    return df


def _with_unique_parents(df: DataFrame, table: Table, n: int, scenario: Scenario, keys: list[ForeignKey], done: dict[str, DataFrame], seed: int) -> tuple[DataFrame, set[str]]:
    """``df`` with the columns of the table's first composite unique key that parents can make distinct; their names."""
    plan = scenario.tables.get(table.name)
    for c in table.constraints:
        if c.kind not in ("unique", "primary_key") or len(c.columns) < 2:
            continue
        own = [k for k in keys if k.column in c.columns and k.parent != table.name]
        free = [x.name for x in table.columns if x.name in c.columns and x.name not in {k.column for k in keys} and not x.identity and x.type.typeName() in ("integer", "long") and not (plan and x.name in plan.overrides)]
        if not own:
            continue
        parents = [(done[k.parent], k.parent_column, k.column) for k in own]
        label = f"{table.name}.{','.join(c.columns)}"
        counted = free[0] if free else None
        return relations.assign_unique_parents(df, _ROW, n, parents, label, seed, counted, short=True), {k.column for k in own} | ({counted} if counted else set())
    return df, set()


def generate(spark: SparkSession, graph: SchemaGraph, scenario: Scenario, seed: int | None = None, default_rows: int = 10, keyless: Collection[str] = ()) -> dict[str, DataFrame]:
    """``generated`` with bulk draws."""
    with bulk():
        return generated(spark, graph, scenario, seed, default_rows, keyless)


def generated(spark: SparkSession, graph: SchemaGraph, scenario: Scenario, seed: int | None = None, default_rows: int = 10, keyless: Collection[str] = ()) -> dict[str, DataFrame]:
    """Every table of the graph by name, parents first; equal seeds give equal rows.

    A column is, in this order: left out if generated by the database, a serial if identity,
    null until the second pass if its key is on a broken cycle, a parent's key, an override,
    or inferred from its name and type. Single unique columns are distinct by construction, and so
    is a table's first unique key of several columns that has foreign keys, by combinations of parents that
    don't repeat (with a whole number counted up beside them, or else as many rows as there are combinations). Of rows that repeat another
    unique key of several columns one stays, so such a table may be shorter.

    Tables named ``keyless`` come without the columns of their foreign keys, for uses that don't read them: an unread
    column costs nothing, but the join that brings a key does. Their rows are otherwise the same; a table whose keys decide its
    other columns or its rows has to keep them.
    """
    seed = seed if seed is not None else scenario.seed if scenario.seed is not None else 42
    plan = resolve(graph)
    counts = scenario.row_counts(plan.order, default_rows)
    tables = {t.name: t for t in graph.tables}
    done: dict[str, DataFrame] = {}
    for name in plan.order:
        table = tables[name]
        keys = [k for k in graph.keys if k.table == name and k not in plan.deferred]
        late = {k.column for k in plan.deferred if k.table == name}
        dropped = {k.column for k in keys} if name in keyless and _free_of_keys(table, scenario) else set()
        keys = [k for k in keys if k.column not in dropped]
        linked = {k.column for k in keys}
        df = spark.range(counts[name]).withColumnRenamed("id", _ROW).withColumn("_one", F.col(_ROW) + 1)
        df, held = _with_unique_parents(df, table, counts[name], scenario, keys, done, seed)
        df = _with_parents(df, table, [k for k in keys if k.column not in held], done, seed)
        linked |= held
        for c in table.columns:
            if c.generated or c.name in linked or c.name in dropped:
                continue
            if c.identity:
                value = (F.col(_ROW) + 1).cast(c.type)
            elif c.name in late:
                value = F.lit(None).cast(c.type)
            else:
                value = column_value(c, table, counts[name], scenario, seed)
            df = df.withColumn(c.name, value)
        df = _from_parents(df, table, scenario, keys, done, seed)
        for c in table.constraints:
            if c.kind in ("unique", "primary_key") and len(c.columns) > 1 and not held & set(c.columns):
                df = df.dropDuplicates(list(c.columns))
        done[name] = df.select(*[F.col(c.name).cast(c.type).alias(c.name) for c in table.columns if not c.generated and c.name not in dropped])
    for k in plan.deferred:
        row_id = key_column(tables[k.table])
        done[k.table] = relations.deferred_update(done[k.table], row_id, done[k.parent], k.parent_column, k.column, seed)
    return done


def _free_of_keys(table: Table, scenario: Scenario) -> bool:
    """Whether nothing but its own columns hangs on a table's foreign keys."""
    plan = scenario.tables.get(table.name)
    derived = any(o.kind in ("from_parent", "after", "formula") for o in plan.overrides.values()) if plan else False
    return not derived and not any(c.kind in ("unique", "primary_key") for c in table.constraints)


#: A time ``after`` the parent's is later by up to so many seconds.
_AFTER = 30 * 86_400


def _from_parents(df: DataFrame, table: Table, scenario: Scenario, keys: list[ForeignKey], done: dict[str, DataFrame], seed: int) -> DataFrame:
    """Overrides ``from_parent: parent.column`` copy a value along the key, ``after: parent.column`` gives a later time."""
    plan = scenario.tables.get(table.name)
    for column, o in (plan.overrides if plan else {}).items():
        if o.kind in ("from_parent", "after"):
            parent, _, source = str(o.value).partition(".")
            k = next(k for k in keys if k.parent == parent)
            side = done[parent].select(F.col(k.parent_column).alias("_pk"), F.col(source).alias("_value"))
            value = F.col("_value")
            if o.kind == "after":
                later = (draw(seed, f"{table.name}.{column}.after", F.col(_ROW)) % _AFTER + 1).cast("int")
                value = F.timestamp_add("SECOND", later, value.cast("timestamp_ntz"))
            df = df.join(side, F.col(k.column) == F.col("_pk"), "left").withColumn(column, value).drop("_pk", "_value")
    return df


def write(frames: dict[str, DataFrame], directory: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{directory}/{name}.parquet")
