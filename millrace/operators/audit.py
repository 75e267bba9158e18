"""Constraint audits: how many rows break a rule.

Children meet parents by merge joins: compressed, a large table of keys looks small enough to be broadcast, and isn't.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """One row with the number of rows for which each rule's condition holds."""
    return df.agg(*[F.count_if(condition).alias(name) for name, condition in rules.items()])


def is_null(c: str) -> Column:
    return F.col(c).isNull()


def not_positive(c: str) -> Column:
    return ~(F.col(c) > 0)


def out_of_range(c: str, low: float, high: float) -> Column:
    return ~F.col(c).between(low, high)


def too_long(c: str, limit: int) -> Column:
    return F.char_length(F.col(c)) > limit


_CAST = r"(?:\s*::\s*[a-z ]+(?:\(\d+(?:,\s*\d+)?\))?)?"
_NUMBER = rf"\(?'?(-?\d+(?:\.\d+)?)'?\)?{_CAST}"
_NAME = rf'\(*\s*"?([A-Za-z_][A-Za-z0-9_]*)"?\s*\)*{_CAST}'


def parse_check(text: str) -> tuple[str, Column] | None:
    """(column, violated condition) of a CHECK of the forms ``c > 0`` and ``c >= a AND c <= b``; else None."""
    body = re.sub(r"^\s*check\s*", "", text.strip(), flags=re.I)
    while body.startswith("(") and body.endswith(")") and _closes(body):
        body = body[1:-1].strip()
    if (m := re.fullmatch(rf"{_NAME}\s*>\s*{_NUMBER}", body, re.I)) and float(m[2]) == 0:
        return m[1], not_positive(m[1])
    m = re.fullmatch(rf"\(?{_NAME}\s*>=\s*{_NUMBER}\)?\s*and\s*\(?{_NAME}\s*<=\s*{_NUMBER}\)?", body, re.I)
    if m and m[1] == m[3]:
        return m[1], out_of_range(m[1], float(m[2]), float(m[4]))
    return None


def _closes(body: str) -> bool:
    depth = 0
    for i, ch in enumerate(body):
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if not depth:
            return i == len(body) - 1
    return False


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of each key."""
    return duplicates(df, *keys).agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("long").alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_keys"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose key is set but has no parent."""
    keys = parent.select(F.col(pk).alias("_pk")).hint("merge")
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def before_parent(child: DataFrame, fk: str, child_ts: str, parent: DataFrame, pk: str, parent_ts: str) -> DataFrame:
    """Child rows older than their parent."""
    keys = parent.select(F.col(pk).alias("_pk"), F.col(parent_ts).alias("_ts")).hint("merge")
    late = child.join(keys, (F.col(fk) == F.col("_pk")) & (F.col(child_ts) < F.col("_ts")))
    return late.agg(F.count(F.lit(1)).alias("violations"))
