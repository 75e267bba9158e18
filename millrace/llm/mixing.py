"""Mix sources to target weights by pivotal dependent rounding.

Each source's target is a share of all words by weight, held at ``cap`` times its own size,
the excess shared again. target / size is the fractional number of copies of each of its
documents. The whole part is taken as it is. The fractions are rounded in pairs: words move
at random from one document of a pair to the other until one fraction is 0 or 1; the other
goes on to the next pair. Moves keep the sum of fraction x size, so a source's words come out
at its target but for its last document.

Only keys and sizes are rounded. A source's documents are dealt to buckets by their key, as
many as their number asks for; each bucket rounds its own and leaves a few short documents
open, and a tree of small groups rounds those. So the decision follows from the rows alone,
however they are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, with_row_numbers

WEIGHTS = (5, 2, 1)
CAP = 3.0
#: Documents of a bucket, buckets of a group in the tree, and short documents that each leaves open.
BUCKET_ROWS, FAN_IN, LEFT = 4096, 64, 8
#: Sources with at most this many rows are broadcast (about 10 MB); more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Targets from (source, source_size): source, source_size, weight, target.

    Sources are ordered by code point, null last, and take the weights in turn. The level
    (target per weight) rises until no source is above its cap; each round is one aggregate,
    and no list of sources reaches the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    numbered, _ = with_row_numbers(sizes, order, "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = materialize(numbered.select("source", "source_size", weight.cast("double").alias("weight")), "sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    limit = F.lit(cap) * F.col("source_size")
    level, held = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= limit
        n, spent, weights_left = weighed.agg(
            F.coalesce(F.count_if(above), F.lit(0)),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == held or not weights_left:
            break
        held, level = n, (total - spent) / weights_left
    return weighed.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def _unit(seed: int, *parts: int) -> float:
    """A uniform number from the parts alone."""
    return (xxhash.xxh64_intdigest(repr(parts).encode(), seed=seed) >> 11) / 2.0**53


def _move(u: float, a: int, p: float, b: int, q: float) -> tuple[float, float]:
    """New fractions of two open documents of sizes a and b: words move until one of them is 0 or 1.

    Each way is as likely as the other way's amount is large, so neither fraction changes on average.
    """
    to_one, to_other = min(b * q, a * (1 - p)), min(a * p, b * (1 - q))
    if u * (to_one + to_other) < to_other:
        return (1.0 if to_one == a * (1 - p) else p + to_one / a), (0.0 if to_one == b * q else q - to_one / b)
    return (0.0 if to_other == a * p else p - to_other / a), (1.0 if to_other == b * (1 - q) else q + to_other / b)


def _rounded(sizes: list[int], parts: list[float], keys: list[int], seed: int, last: bool) -> list[float]:
    """Round documents from the longest to the shortest, so that what stays open is short.

    The LEFT shortest and the one that is open after the others stay; if ``last``, all are
    rounded, the final fraction to the nearer number.
    """
    out, waiting = list(parts), None
    for i in range(len(out) - 1, -1 if last else LEFT - 1, -1):
        if waiting is None:
            waiting = i
            continue
        j = waiting
        out[j], out[i] = _move(_unit(seed, keys[j], keys[i]), sizes[j], out[j], sizes[i], out[i])
        waiting = next((x for x in (j, i) if 0.0 < out[x] < 1.0), None)
    if last and waiting is not None:
        out[waiting] = float(out[waiting] >= 0.5)
    return out


def _combiner(seed: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def combine(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("_size", "_key", "_other", "_nth")])
        new = _rounded(*(part.column(c).to_pylist() for c in ("_size", "_part", "_key")), seed, last)
        return part.set_column(part.schema.get_field_index("_part"), "_part", pa.array(new, pa.float64()))

    return combine


def _keys() -> list[Column]:
    """128 bits that tell documents apart by doc_id, text and source."""
    parts = [x for c in ("doc_id", "text", "source") for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*parts).alias("_key"), F.xxhash64(F.lit(7), *parts).alias("_other")]


def _extra(units: DataFrame, seed: int) -> DataFrame:
    """(_key, _other, _extra): how many rows of each open unit get one copy more."""
    rows = units.where("_part > 0 and _part < 1")
    buckets = rows.groupBy("source").agg(F.ceil(F.sum("_rows") / BUCKET_ROWS).cast("long").alias("_buckets"))
    buckets = materialize(buckets, "buckets")
    n = buckets.agg(F.max("_buckets")).first()[0] or 1
    side = F.broadcast(buckets) if buckets.count() <= BROADCAST_SOURCES else buckets
    side = side.withColumnRenamed("source", "_of")
    rows = rows.join(side, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    rows = rows.withColumn("_at", F.pmod(F.xxhash64("_other", "_nth"), F.col("_buckets")))
    still = rows.select("source", "_key", "_other", "_nth", "_size", "_part", "_at")
    kind, settled, depth = still.schema, [], 0
    while True:
        done = n <= 1
        level = materialize(still.groupBy("source", "_at").applyInArrow(_combiner(seed + depth, done), kind), "mix")
        settled.append(level if done else level.where("_part = 0 or _part = 1"))
        if done:
            break
        still = level.where("_part > 0 and _part < 1").withColumn("_at", F.expr(f"_at div {FAN_IN}"))
        n, depth = -(-n // FAN_IN), depth + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.groupBy("_key", "_other").agg(F.sum("_part").cast("long").alias("_extra"))


def _numbered_repeats(docs: DataFrame, units: DataFrame) -> DataFrame:
    """``docs`` with _nth, the number of a row among the rows of its key (from 1).

    Only keys of more than one row of which some get a copy more are numbered: in the order of
    the rows' places in a written table, by ranges, so that no key is one task.
    """
    some = materialize(units.where("_extra > 0 and _extra < _rows").select("_key", "_other"), "repeats")
    if some.isEmpty():
        return docs.withColumn("_nth", F.lit(1).cast("long"))
    side = F.broadcast(some) if some.count() <= BROADCAST_SOURCES else some
    repeats = materialize(docs.join(side, ["_key", "_other"], "left_semi").withColumn("_place", F.monotonically_increasing_id()), "repeated")
    numbered, _ = with_row_numbers(repeats, [F.col("_key"), F.col("_other"), F.col("_place")], "_no")
    numbered = materialize(numbered, "numbered")
    first = materialize(numbered.groupBy("_key", "_other").agg(F.min("_no").alias("_first")), "firsts")
    numbered = numbered.join(first, ["_key", "_other"]).withColumn("_nth", F.col("_no") - F.col("_first") + 1)
    rest = docs.join(side, ["_key", "_other"], "left_anti").withColumn("_nth", F.lit(1).cast("long"))
    return rest.unionByName(numbered.select(*rest.columns))


def copies(docs: DataFrame, carried: list[str], weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = 23) -> DataFrame:
    """Decide the copies of every document of a mix whose words number as many as the input's.

    Returns the columns ``carried`` of every row under the names c_<name>, and _size,
    source_size, target and copies. Null texts
    and texts without words have size 0; they count for nothing and get the whole part of
    their source's copies. Null is a source of its own, ordered last. Repeated rows are
    rounded one by one. Extra columns are ignored, an empty table gives an empty result, and
    a source without words has target 0. The decision depends on the rows and the seed alone,
    not on their partitions; of wholly equal rows any may be the one with a copy more. No
    document exceeds ceil(cap) copies.
    """
    units = docs.select("source", *_keys(), word_count(F.col("text")).alias("_size")).groupBy("_key", "_other")
    units = materialize(units.agg(F.first("source").alias("source"), F.first("_size").alias("_size"), F.count(F.lit(1)).alias("_rows")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("_size") * F.col("_rows")).alias("source_size"))
    aimed = targets(sizes, weights, cap).select(F.col("source").alias("_of"), "source_size", "target")
    side = F.broadcast(aimed) if aimed.count() <= BROADCAST_SOURCES else aimed
    joined = units.join(side, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + 1e-12).cast("long")
    part = F.when(F.col("_size") > 0, F.greatest(F.lit(0.0), ratio - whole)).otherwise(F.lit(0.0))
    decided = materialize(joined.withColumn("_whole", whole).withColumn("_part", part), "decided")
    decided = decided.join(_extra(decided, seed), ["_key", "_other"], "left").withColumn("_extra", F.coalesce("_extra", F.lit(0)))
    decided = materialize(decided.select("_key", "_other", "_size", "_rows", "source_size", "target", "_whole", "_extra"), "copies")
    rows = docs.select(*[F.col(c).alias(f"c_{c}") for c in carried], *_keys())
    rows = _numbered_repeats(rows, decided).join(decided, ["_key", "_other"])
    more = F.when((F.col("_extra") == F.col("_rows")) | (F.col("_nth") <= F.col("_extra")), 1).otherwise(0)
    return rows.select(*[f"c_{c}" for c in carried], "_size", "source_size", "target", (F.col("_whole") + more).alias("copies"))


def mixed(docs: DataFrame, seed: int = 23) -> DataFrame:
    """The mix itself: each document as often as its copies, with the columns of ``docs``."""
    decided = copies(docs, docs.columns, seed=seed).where("copies > 0")
    repeated = decided.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"c_{c}").alias(c) for c in docs.columns])


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies of every document."""
    decided = copies(docs, ["doc_id"])
    target, taken = F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("_size")).alias("taken")
    return decided.select(F.col("c_doc_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", target, taken, "copies")
