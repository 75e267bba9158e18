"""Keys, unique column sets and labels found in the data of tables that declare none.

All three scan whole tables and shuffle digests, counts or a bounded number of labels: never
rows, and never the values of a column in one place.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.schema import Constraint, ForeignKey

#: Least share of a child's distinct values that its parent must hold.
MIN_COVERAGE = 0.95
#: Columns noted in one 64-bit integer.
WORD = 62
#: A set of columns is first refuted on one in so many of its values, and only then counted whole.
SLICES = 64
#: Before that it is refuted on so many rows, which is exact too: two of them that agree are enough.
HEAD = 20_000
WIDEST = 3
THRESHOLD = 50


def _digest(df: DataFrame, c: str) -> Column | None:
    """A column's value as bytes that are equal just if values and kinds are; None for types that make no keys."""
    x, kind = F.col(f"`{c}`"), df.schema[c].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))
    if isinstance(kind, T.StringType):
        return F.unhex(F.md5(x))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unhex(F.concat(F.lit("74"), F.lpad(F.hex(F.unix_micros(x.cast("timestamp"))), 16, "0")))
    return None


def keyable(df: DataFrame) -> list[str]:
    """Columns of whole numbers, texts, dates and times."""
    return [c for c in df.columns if _digest(df, c) is not None]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _counts(tables: Mapping[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """(id, n_rows): non-null rows of each column, by one scan of each table."""
    parts = []
    for t, df in tables.items():
        own = [(i, c) for i, (x, c) in enumerate(columns) if x == t]
        if own:
            one = df.agg(F.array(*[F.struct(F.lit(i).alias("id"), F.count(F.col(f"`{c}`")).alias("n_rows")) for i, c in own]).alias("all"))
            parts.append(one.select(F.explode("all").alias("x")).select("x.*"))
    return _union(parts)


# ---- foreign keys


def _stem(column: str) -> str:
    """The name without a prefix of one or two letters: c_custkey is custkey."""
    head, _, tail = column.partition("_")
    return tail if tail and len(head) <= 2 else column


def named_alike(column: str, parent: str, parent_column: str) -> bool:
    """Whether names speak for a key: equal stems, or the parent's name, in the plural or singular, before its column."""
    return _stem(column) == _stem(parent_column) or column in (f"{parent}_{parent_column}", f"{parent.removesuffix('s')}_{parent_column}")


def inclusions(tables: Mapping[str, DataFrame], min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(table, column, parent, parent_column, coverage, n_values, n_parent_values, named): inclusion dependencies.

    No value stands twice in the parent's column, and it holds that share of the child's distinct values.
    Distinct values are shuffled once, as digests with one bit for each column that has the value, combined
    before the shuffle. What is left is how many values each set of columns has in common, from which the
    coverage of every pair follows. Whole numbers, texts and times are compared among themselves. Nulls are no
    values; a column without values is in no row; tables without any fitting column give none.
    """
    columns = [(t, c) for t, df in tables.items() for c in keyable(df)]
    spark = next(iter(tables.values())).sparkSession
    out = "`table` string, column string, parent string, parent_column string, coverage double, n_values long, n_parent_values long, named boolean"
    if not columns:
        return spark.createDataFrame([], out)
    words = [f"w{k}" for k in range((len(columns) - 1) // WORD + 1)]

    def noted(df: DataFrame, i: int, c: str) -> Column:
        bits = [F.lit(1 << i % WORD if k == i // WORD else 0).cast("long").alias(w) for k, w in enumerate(words)]
        return F.struct(_digest(df, c).alias("value"), *bits)

    parts = []
    for t, df in tables.items():
        own = [(i, c) for i, (x, c) in enumerate(columns) if x == t]
        if own:
            parts.append(df.select(F.explode(F.array(*[noted(df, i, c) for i, c in own])).alias("x")).select("x.*").where("value is not null"))
    by_value = _union(parts).groupBy("value").agg(*[F.bit_or(w).alias(w) for w in words])
    sets = by_value.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    member = F.array_compact(F.array(*[F.when(F.getbit(words[i // WORD], F.lit(i % WORD)) == 1, i) for i in range(len(columns))]))
    sets = sets.select("n", member.alias("ids"))
    pairs = sets.select("n", "ids", F.explode("ids").alias("child")).select("n", "child", F.explode("ids").alias("id"))
    shared = pairs.groupBy("child", "id").agg(F.sum("n").alias("shared"))  # a pair of columns each
    own = shared.where("child = id").select("id", F.col("shared").alias("n_parent_values"))
    unique = own.join(_counts(tables, columns), "id").where("n_parent_values = n_rows").select("id", "n_parent_values")
    child = own.select(F.col("id").alias("child"), F.col("n_parent_values").alias("n_values"))
    found = shared.where("child <> id").join(unique, "id").join(child, "child").withColumn("coverage", F.round(F.col("shared") / F.col("n_values"), 6)).where(F.col("shared") >= min_coverage * F.col("n_values"))
    names = [(i, t, c) for i, (t, c) in enumerate(columns)]
    alike = [(i, j, named_alike(c, p, k)) for i, (t, c) in enumerate(columns) for j, (p, k) in enumerate(columns) if i != j]
    found = found.join(spark.createDataFrame(names, "child int, `table` string, column string"), "child")
    found = found.join(spark.createDataFrame(names, "id int, parent string, parent_column string"), "id")
    found = found.join(spark.createDataFrame(alike, "child int, id int, named boolean") if alike else spark.createDataFrame([], "child int, id int, named boolean"), ["child", "id"])
    return found.select("table", "column", "parent", "parent_column", "coverage", "n_values", "n_parent_values", "named")


def foreign_keys(tables: Mapping[str, DataFrame]) -> list[ForeignKey]:
    """Keys that data and names both speak for: whole coverage, and for each child the parent with the fewest values.

    Of two columns of one table none is the other's parent unless names say so; one row for each column of the schema at most.
    """
    rows = inclusions(tables, 1.0).where("named").collect()  # pairs of columns, by the schema's width
    best: dict[tuple[str, str], tuple] = {}
    for r in rows:
        if r.table == r.parent and r.column == r.parent_column:
            continue
        mutual = any((x.table, x.column, x.parent, x.parent_column) == (r.parent, r.parent_column, r.table, r.column) for x in rows)
        if mutual and (r.table, r.column) < (r.parent, r.parent_column):
            continue  # of two columns with the same values the one that comes first is the parent
        at = (r.n_parent_values, r.parent, r.parent_column)
        best[r.table, r.column] = min(best.get((r.table, r.column), at), at)
    return [ForeignKey(t, c, p, k) for (t, c), (_, p, k) in sorted(best.items())]


# ---- unique column sets


def _grouped(df: DataFrame, sets: list[tuple[str, ...]], slices: int) -> DataFrame:
    """(set, n): how often each combination of values of each set of columns occurs, in one slice of the combinations.

    Combinations are 128-bit digests; a slice has all rows of its combinations, and only those are digested. Columns
    are digested once a row, not once a set. Combinations with a null have no row.
    """
    columns = sorted({c for s in sets for c in s})
    own = df.select(*[_digest(df, c).alias(f"d{k}") for k, c in enumerate(columns)])

    def of(i: int, s: tuple[str, ...]) -> Column:
        parts = [F.col(f"d{columns.index(c)}") for c in s]  # of a set, parts have fixed lengths
        one = F.struct(F.lit(i).alias("set"), F.unhex(F.md5(F.concat(*parts))).alias("value"))
        return F.when(F.pmod(F.xxhash64(*parts), F.lit(slices)) == 0, one) if slices > 1 else one

    rows = own.select(F.explode(F.array(*[of(i, s) for i, s in enumerate(sets)])).alias("x")).where("x is not null").select("x.*").where("value is not null")
    return rows.groupBy("set", "value").agg(F.count(F.lit(1)).alias("n"))


def _refuted(df: DataFrame, sets: list[tuple[str, ...]], slices: int) -> list[tuple[str, ...]]:
    """The sets that a duplicate among these rows, or in one slice of their values, does not refute."""
    if not sets:
        return []
    out = {r["set"] for r in _grouped(df, sets, slices).where("n > 1").select("set").distinct().collect()}
    return [s for i, s in enumerate(sets) if i not in out]


def unique_sets(df: DataFrame, widest: int = WIDEST, slices: int = SLICES) -> list[tuple[tuple[str, ...], bool]]:
    """Minimal sets of up to ``widest`` columns whose values identify a row, with whether they hold no null.

    Level by level: a set is asked only if none of its parts is unique. Any two rows that agree refute it, so
    those of HEAD rows are looked for first, then those in one slice of its values; what survives both is counted
    over all rows. A row with a null in the set repeats none, as in SQL. An empty table has none.
    What comes to the driver is a row for each set.
    """
    columns = keyable(df)
    if not columns:
        return []
    filled = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    rows = filled["_rows"]
    complete = {c: filled[f"_{i}"] == rows for i, c in enumerate(columns)}
    found: list[tuple[str, ...]] = []
    if not rows:
        return []
    for width in range(1, widest + 1):
        asked = [s for s in itertools.combinations(columns, width) if not any(set(f) <= set(s) for f in found)]
        if rows > HEAD:
            asked = _refuted(df, _refuted(df.limit(HEAD), asked, 1), slices)
        if asked:
            counted = {r["set"]: r["most"] for r in _grouped(df, asked, 1).groupBy("set").agg(F.max("n").alias("most")).collect()}
            found += [s for i, s in enumerate(asked) if counted.get(i) == 1]
    return [(s, all(complete[c] for c in s)) for s in found]


def unique_sets_frame(tables: Mapping[str, DataFrame], widest: int = WIDEST) -> DataFrame:
    """(table, columns, width, complete) of every table's minimal unique sets; columns comma-joined in the table's order."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, ",".join(s), len(s), whole) for t, df in tables.items() for s, whole in unique_sets(df, widest)]
    return spark.createDataFrame(rows, "`table` string, columns string, width int, complete boolean")


def key_constraints(found: list[tuple[tuple[str, ...], bool]]) -> tuple[Constraint, ...]:
    """The first narrowest set without nulls as primary key, all others as unique."""
    order = sorted(found, key=lambda x: len(x[0]))
    first = next((s for s, whole in order if whole), None)
    return tuple(Constraint("primary_key" if s == first else "unique", s) for s, _ in order)


# ---- labels


def _labelled(df: DataFrame) -> list[str]:
    kinds = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def saturating_counts(df: DataFrame, columns: list[str], threshold: int = THRESHOLD) -> DataFrame:
    """(column, value, n): partial counts of each column's values by task; of a column that shows more values
    than the threshold in one task, a single row without a count from there.

    A task holds at most threshold + 1 values of a column and stops reading one that is over it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict] = {c: {} for c in columns}
        over: set[str] = set()
        for batch in batches:
            for c in columns:
                if c in over:
                    continue
                own = seen[c]
                for part in pc.value_counts(batch.column(c)).to_pylist() if batch.num_rows else ():
                    if part["values"] is not None:
                        own[part["values"]] = own.get(part["values"], 0) + part["counts"]
                        if len(own) > threshold:
                            over.add(c)
                            own.clear()
                            break
        shown = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        rows = [(c, shown(v), n) for c in columns for v, n in seen[c].items()] + [(c, None, None) for c in over]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["column", "value", "n"])

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, "column string, value string, n long")


def labels(df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(column, value, n, pct): the values of every text, boolean and whole-number column that has at most ``threshold``.

    All columns share one scan, and a task shuffles at most that many values of each. Nulls don't count;
    a column without values has no row.
    """
    columns = _labelled(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, pct double")
    counts = saturating_counts(df, columns, threshold).groupBy("column", "value").agg(F.sum("n").alias("n"))
    guard = counts.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("total"), F.count_if(F.col("value").isNull()).alias("over"))
    few = guard.where((F.col("over") == 0) & (F.col("values") <= threshold)).select("column", "total")
    return counts.join(F.broadcast(few), "column").select("column", "value", "n", (F.col("n").cast("double") * 100.0 / F.col("total")).alias("pct"))  # a row for each column


def labels_frame(tables: Mapping[str, DataFrame], threshold: int = THRESHOLD) -> DataFrame:
    """``labels`` of every table, with its name before."""
    return _union([labels(df, threshold).select(F.lit(t).alias("table"), "column", "value", "n", "pct") for t, df in tables.items()])
