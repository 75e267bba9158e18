"""Foreign keys of generated rows: random parents, deferred updates, lookups, indexed keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.prf import draw, is_bulk
from millrace.sources.scratch import materialize

#: Parent keys of at most so many rows (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 500_000


class MissingParentError(ValueError):
    """A required foreign key points to an empty table."""


def indexed_keys(parent: DataFrame, pk: str) -> tuple[DataFrame, int]:
    """(idx, key): the parent's keys numbered from 0 in their order, and their number.

    More keys than are broadcast are dealt by key range, written, and numbered in their range;
    only the sizes of the ranges meet in one place. The numbers are the same either way.
    """
    keys = parent.where(F.col(pk).isNotNull()).select(F.col(pk).alias("key"))
    n = keys.count()
    if n <= BROADCAST_KEYS:
        return keys.select((F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("idx"), "key"), n
    dealt = materialize(keys.repartitionByRange("key").withColumn("_part", F.spark_partition_id()), "keys")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("key"))
    return dealt.withColumn("_at", inside).join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_at") - 1).alias("idx"), "key"), n


def assign_parent(child: DataFrame, row_id: Column, parent: DataFrame, pk: str, name: str, seed: int, nullable: bool = True) -> DataFrame:
    """Give each child a parent key drawn uniformly, with replacement, as column ``name``.

    Without parents the key is null, or the call fails if it must not be.
    """
    keys, n = indexed_keys(parent, pk)
    if not n:
        if not nullable:
            raise MissingParentError(name)
        return child.withColumn(name, F.lit(None).cast(parent.schema[pk].dataType))
    drawn = child.withColumn("_idx", draw(seed, f"{name}.fk", row_id) % n)
    side = F.broadcast(keys) if n <= BROADCAST_KEYS else keys
    return drawn.join(side, drawn["_idx"] == side["idx"]).withColumn(name, F.col("key")).drop("_idx", "idx", "key")


#: Rounds in which each coordinate of a combination is shifted by a draw of the others.
ROUNDS = 4


class TooFewCombinationsError(ValueError):
    """More distinct combinations are asked for than the parents have."""


def unique_combinations(rows: DataFrame, row_no: str, sizes: list[int], names: list[str], key: str, seed: int) -> DataFrame:
    """``rows`` with one index for each size (0..size-1) as the named columns; no two row numbers share all of them.

    The number is written in mixed radix, and then each coordinate in turn is shifted, modulo its size, by a
    draw of all others. A shift by what stays as it is can be taken back, so it is a permutation of all combinations,
    and numbers below the product of the sizes give different ones without a second try. Of two coordinates
    each one's shift hangs on a single value of the other, so shifts are drawn once a value and looked up.
    """
    tabled = len(names) == 2 and max(sizes) <= BROADCAST_KEYS and not is_bulk()
    step = 1
    for name, n in zip(names, sizes, strict=True):
        rows = rows.withColumn(name, F.expr(f"(`{row_no}` div {step}) % {n}"))
        step *= n
    for r in range(ROUNDS):
        for k, (name, n) in enumerate(zip(names, sizes, strict=True)):
            if tabled:
                other = names[1 - k]
                shift = (draw(seed, f"{key}.{r}.{k}", F.col("id")) % n).alias("_shift")
                shifts = rows.sparkSession.range(sizes[1 - k]).select(F.col("id").alias(other), shift)
                rows = rows.join(F.broadcast(shifts), other).withColumn(name, (F.col(name) + F.col("_shift")) % n).drop("_shift")
                continue
            others = F.concat_ws(":", *[F.col(x).cast("string") for x in names if x != name]) if len(names) > 1 else F.lit("")
            rows = rows.withColumn(name, (F.col(name) + draw(seed, f"{key}.{r}.{k}", others)) % n)
    return rows


def assign_unique_parents(child: DataFrame, row_no: str, n_rows: int, parents: list[tuple[DataFrame, str, str]], key: str, seed: int, counted: str | None = None, short: bool = False) -> DataFrame:
    """Give the rows numbered 0..n_rows-1 keys of several parents (frame, its key, column) so that no combination repeats.

    With ``counted`` that column gets whole numbers from 1 to as many as it takes; without it the call fails if
    the parents have fewer combinations than there are rows (with ``short`` it gives each combination once, as no
    more rows can be distinct). No row is drawn twice, and nothing is shuffled but for the joins with the keys.
    """
    indexed = [indexed_keys(frame, pk) for frame, pk, _ in parents]
    sizes, names = [n for _, n in indexed], [f"_c{k}" for k in range(len(indexed))]
    product = 1
    for n in sizes:
        product *= n
    if not product and n_rows:
        raise MissingParentError(key)
    if counted:
        sizes, names = [*sizes, max(1, -(-n_rows // max(product, 1)))], [*names, "_counted"]
    elif n_rows > product and short:
        child = child.where(F.col(row_no) < product)
    elif n_rows > product:
        raise TooFewCombinationsError(f"{key}: {n_rows} rows, {product} combinations")
    out = unique_combinations(child, row_no, [max(1, n) for n in sizes], names, key, seed)
    for (keys, n), (_, _, column), name in zip(indexed, parents, names[: len(parents)], strict=True):
        side = keys.select(F.col("idx").alias(name), F.col("key").alias(column))
        out = out.join(F.broadcast(side) if n <= BROADCAST_KEYS else side, name).drop(name)
    return out.withColumn(counted, F.col("_counted") + 1).drop("_counted") if counted else out


#: Shifts and keys of at most so many parents a side are held as arrays by each worker (16 to 24 bytes each, twice); of more, each row draws its own.
TABLED_KEYS = 1 << 23
#: Pairs are worked out so many at a time, and a task makes some so many.
PAIRS_AT_ONCE, PAIRS_A_TASK = 1 << 16, 1 << 26


def unique_pairs(spark: SparkSession, n_rows: int, parents: list[tuple[DataFrame, str, str]], key: str, seed: int, row_no: str = "row_no") -> DataFrame:
    """Rows numbered 0..n_rows-1 with keys of two parents (frame, its key, column) so that no pair repeats.

    They are the rows that ``assign_unique_parents`` gives to such numbers. A coordinate's shift hangs on a single
    value of the other, so the shifts are drawn once a value and broadcast with the keys, and a task works out its
    rows from nothing but their numbers, by arrays: no row is shuffled, joined or sent to a worker.
    """
    counts = [frame.where(F.col(pk).isNotNull()).count() for frame, pk, _ in parents]
    whole = all(frame.schema[pk].dataType.typeName() in ("byte", "short", "integer", "long") for frame, pk, _ in parents)
    if not whole or max(counts) > TABLED_KEYS or not n_rows or n_rows > counts[0] * counts[1]:
        rows = spark.range(n_rows).withColumnRenamed("id", row_no)
        return assign_unique_parents(rows, row_no, n_rows, parents, key, seed).select(row_no, *[column for _, _, column in parents])
    tables = spark.sparkContext.broadcast(([_shifts(spark, counts, k, key, seed) for k in range(2)], [_ordered(frame, pk) for frame, pk, _ in parents]))
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_rows // PAIRS_A_TASK))
    kinds = [frame.schema[pk].dataType for frame, pk, _ in parents]
    columns = ", ".join(f"`{column}` {kind.simpleString()}" for (_, _, column), kind in zip(parents, kinds, strict=True))
    starts = spark.range(0, n_rows, PAIRS_AT_ONCE, tasks)
    return starts.mapInArrow(_pairs(tables, n_rows, counts), f"`{row_no}` long, {columns}")


def _shifts(spark: SparkSession, sizes: list[int], k: int, key: str, seed: int) -> np.ndarray:
    """The shifts of coordinate k in each round, by the other's value."""
    drawn = spark.range(sizes[1 - k]).select("id", *[(draw(seed, f"{key}.{r}.{k}", F.col("id")) % sizes[k]).cast("int").alias(f"r{r}") for r in range(ROUNDS)]).toArrow()
    out = np.empty((ROUNDS, sizes[1 - k]), np.min_scalar_type(sizes[k] - 1))
    for r in range(ROUNDS):
        out[r, drawn["id"].to_numpy()] = drawn[f"r{r}"].to_numpy()
    return out


def _ordered(frame: DataFrame, pk: str) -> np.ndarray:
    """The keys in their order."""
    return np.sort(frame.where(F.col(pk).isNotNull()).select(pk).toArrow()[pk].to_numpy())


def _shifted(at: np.ndarray, by: np.ndarray, size: np.uint32) -> np.ndarray:
    """(at + by) % size of numbers below it; a difference below zero wraps and is the greater one."""
    moved = at + by
    return np.minimum(moved, moved - size)


def _pairs(tables: Broadcast, n_rows: int, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of_first, of_second), (first_keys, second_keys) = [[np.array(x) for x in own] for own in tables.value]  # copies lie in large pages
        n, m = map(np.uint32, sizes)
        for batch in batches:
            for start in batch.column(0).to_pylist():
                number = np.arange(start, min(start + PAIRS_AT_ONCE, n_rows))
                second = number // sizes[0]
                first, second = (number - second * sizes[0]).astype(np.uint32), second.astype(np.uint32)
                for r in range(ROUNDS):
                    first = _shifted(first, np.take(of_first[r], second), n)
                    second = _shifted(second, np.take(of_second[r], first), m)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.take(first_keys, first)), pa.array(np.take(second_keys, second))], names=["row_no", "first", "second"])

    return run


def assign_earlier_self(df: DataFrame, row_id: str, name: str, seed: int) -> DataFrame:
    """A self-reference: one of the smaller ids (from 1), null for the first row."""
    i = F.col(row_id)
    return df.withColumn(name, F.when(i > 1, draw(seed, f"{name}.self", i) % F.greatest(i - 1, F.lit(1)) + 1))


def deferred_update(table: DataFrame, row_id: str, other: DataFrame, other_pk: str, name: str, seed: int) -> DataFrame:
    """Fill a cycle's broken edge once both tables exist."""
    return assign_parent(table.drop(name), F.col(row_id), other, other_pk, name, seed).select(*table.columns)


def lookup_parent(ids: DataFrame, table: DataFrame, pk: str, fk: str) -> DataFrame:
    """(id, parent) of rows whose key is set."""
    return ids.select(F.col(ids.columns[0]).alias("id")).join(table.select(F.col(pk).alias("id"), F.col(fk).alias("parent")), "id").where("parent is not null")


def update_from(table: DataFrame, pk: str, changes: DataFrame, column: str) -> DataFrame:
    """UPDATE ... FROM: ``changes`` (id, value) overwrite ``column`` where their id matches.

    Of several changes of one id the greatest value counts, so no row is repeated; a null value changes nothing.
    """
    new = changes.groupBy(F.col("id").alias("_id")).agg(F.max("value").alias("_value"))
    return table.join(new, table[pk] == new["_id"], "left").withColumn(column, F.coalesce("_value", column)).drop("_id", "_value")
