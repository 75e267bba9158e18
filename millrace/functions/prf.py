"""Randomness without state: every cell is a hash of seed, key, row id and attempt.

The draw does not depend on partitions or row order, and DuckDB can repeat it. ``draw`` gives
52-bit integers from md5. Within ``bulk()`` they come from xxhash64, some six times cheaper;
databases are generated that way, as nothing outside repeats them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 52
_bulk: ContextVar[bool] = ContextVar("bulk", default=False)


@contextmanager
def bulk() -> Iterator[None]:
    """Expressions built inside draw from xxhash64."""
    token = _bulk.set(True)
    try:
        yield
    finally:
        _bulk.reset(token)


def is_bulk() -> bool:
    return _bulk.get()


def _fast(seed: int, key: str, row_id: Column, attempt: Column | int) -> Column:
    """64 bits; seed and key are folded into one number when the expression is built."""
    folded = int.from_bytes(hashlib.blake2b(f"{seed}|{key}".encode(), digest_size=8).digest(), "little", signed=True)
    return F.xxhash64(F.lit(folded), row_id, *([attempt] if isinstance(attempt, Column) else [F.lit(attempt)] if attempt else []))


def _hash(seed: int, key: str, row_id: Column, attempt: Column | int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(key), row_id.cast("string"), (attempt if isinstance(attempt, Column) else F.lit(attempt)).cast("string")))


def hex_digits(seed: int, key: str, row_id: Column, attempt: Column | int = 0) -> Column:
    """32 hexadecimal digits."""
    if _bulk.get():
        halves = [F.lpad(F.lower(F.hex(_fast(seed, f"{key}.{half}", row_id, attempt))), 16, "0") for half in "lr"]
        return F.concat(*halves)
    return _hash(seed, key, row_id, attempt)


def draw(seed: int, key: str, row_id: Column, attempt: Column | int = 0) -> Column:
    """A uniform integer in 0..SPAN-1."""
    if _bulk.get():
        return F.shiftrightunsigned(_fast(seed, key, row_id, attempt), 12)
    return F.conv(F.substring(_hash(seed, key, row_id, attempt), 1, 13), 16, 10).cast("long")


def unit(h: Column) -> Column:
    """A draw as a double in [0, 1)."""
    return h / F.lit(float(SPAN))


def duck_hex(seed: int, key: str, row_id: str, attempt: str = "0") -> str:
    return f"md5(concat_ws('|', '{seed}', '{key}', cast({row_id} as varchar), cast({attempt} as varchar)))"


def duck_draw(seed: int, key: str, row_id: str, attempt: str = "0") -> str:
    """``draw`` in DuckDB SQL."""
    return f"cast(concat('0x', substring({duck_hex(seed, key, row_id, attempt)}, 1, 13)) as bigint)"


def duck_unit(h: str) -> str:
    return f"(({h}) / {float(SPAN)!r}::double)"
