"""Shards by a Feistel permutation of row numbers, walked along its cycles into range.

Rows are numbered 0..n-1 in the order of doc_id. A Feistel network over Z_a x Z_b with
a*b >= n permutes 0..a*b-1; a number that leaves 0..n-1 is permuted again until it comes
back. The permuted number p gives shard = p mod shards and slot = p div shards, so counts
differ by one at most, slots have no gaps, and any row's place follows from its number and
n alone (``locate``). Only built-in functions run on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import with_row_numbers

ROUNDS = 6
#: Steps along a cycle in one expression. At most one number in sqrt(n) leaves the range, so hardly a row needs more.
WALK = 64
_P = 2_147_483_629  # a prime under 2**31: products of residues fit into 64 bits


def _domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, -(-n // a) if n else 1


def _round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three residues for each round, by a fixed linear recurrence on the seed."""
    keys, x = [], (seed * 2_862_933_555_777_941_757 + 3_037_000_493) % 2**64
    for _ in range(ROUNDS):
        own = []
        for _ in range(3):
            x = (x * 6_364_136_223_846_793_005 + 1_442_695_040_888_963_407) % 2**64
            own.append((x >> 33) % (_P - 1) + 1)
        keys.append(tuple(own))
    return keys


def _mix(x: int, key: tuple[int, int, int]) -> int:
    y = (x % _P * key[0] + key[1]) % _P
    return (y * y + key[2]) % _P * key[0] % _P


def _once(number: int, a: int, b: int, seed: int) -> int:
    """One step of the permutation of 0..a*b-1."""
    left, right, m_left, m_right = number // b, number % b, a, b
    for key in _round_keys(seed):
        left, right = right, (left + _mix(right, key)) % m_left
        m_left, m_right = m_right, m_left
    return left * b + right if m_left == a else right * b + left


def locate(row_no: int, n: int, shards: int = 8, seed: int = 17) -> tuple[int, int]:
    """Shard and slot of one row number, without Spark."""
    a, b = _domain(n)
    while True:
        row_no = _once(row_no, a, b, seed)
        if row_no < n:
            return row_no % shards, row_no // shards


def permuted(row_no: Column, n: int, seed: int = 17, walk: int = WALK) -> Column:
    """Up to WALK + 1 steps of the permutation as one Column expression; a number of n or more is still on its way."""
    a, b = _domain(n)
    keys = F.array(*[F.struct(F.lit(k[0]).cast("long").alias("x"), F.lit(k[1]).cast("long").alias("y"), F.lit(k[2]).cast("long").alias("z"), F.lit(a if i % 2 == 0 else b).cast("long").alias("m")) for i, k in enumerate(_round_keys(seed))])

    def mixed(right: Column, key: Column) -> Column:
        y = (right % F.lit(_P) * key["x"] + key["y"]) % F.lit(_P)
        square = F.aggregate(F.array(y), F.lit(0).cast("long"), lambda _, v: (v * v + key["z"]) % F.lit(_P))
        return square * key["x"] % F.lit(_P)

    def one_round(state: Column, key: Column) -> Column:
        return F.struct(state["r"].alias("l"), ((state["l"] + mixed(state["r"], key)) % key["m"]).alias("r"))

    def once(x: Column) -> Column:
        right = x % F.lit(b)
        start = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), right.alias("r"))
        return F.aggregate(keys, start, one_round, lambda s: s["l"] * F.lit(b) + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), once(row_no), lambda x, _: F.when(x < F.lit(n), x).otherwise(once(x)))


def _further_walks(n: int, seed: int, walk: int) -> int:
    """How many more expressions of ``walk`` steps the longest way back into 0..n-1 takes.

    A way from inside goes through numbers outside only; they lie in the last row of the
    domain, at most sqrt(n) + 1, so following each on the driver is short for any n that Spark can hold.
    """
    a, b = _domain(n)
    ways: dict[int, int] = {}
    for start in range(n, a * b):
        at, steps = _once(start, a, b, seed), 1
        while at >= n and at not in ways and at != start:  # a cycle that stays outside is entered by no row
            at, steps = _once(at, a, b, seed), steps + 1
        ways[start] = 0 if at == start else steps + ways.get(at, 0)
    longest = max(ways.values(), default=0)
    return max(0, -(-(longest - walk) // walk))


def shard(docs: DataFrame, shards: int = 8, seed: int = 17, walk: int = WALK) -> DataFrame:
    """Deal all documents to shards; counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, row_no, shard, slot. A null text
    has size 1 and the crc32 of no bytes. A null doc_id sorts first. Rows with equal doc_id
    are ordered by their texts' crc32, size and xxhash64; wholly equal rows take each other's
    places freely, so every rerun gives the same result rows. Extra columns are ignored. An
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_tie"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc(), F.col("_tie").asc()]
    numbered, n = with_row_numbers(slim, order)
    placed = numbered.withColumn("_place", permuted(F.col("row_no"), n, seed, walk))
    for _ in range(_further_walks(n, seed, walk)):
        placed = placed.withColumn("_place", F.when(F.col("_place") < n, F.col("_place")).otherwise(permuted(F.col("_place"), n, seed, walk)))
    return placed.select(
        "doc_id", "size", "text_crc32", "row_no",
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").cast("long").alias("slot"),
    )


def shard_report(docs: DataFrame) -> DataFrame:
    """The placement under the law "rows" (counts at most one apart), with no shard grown."""
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
