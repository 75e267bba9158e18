"""Fill-in-middle documents by ropes.

A text becomes a balanced tree whose leaves hold some two thousand characters and cache how
many units and code points they have. It is split at two unit ranks, the three subtrees are
put together again around sentinels, and the original comes back by splitting the result at
its sentinels. Splitting and joining touch one path of the tree, whatever the text's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a leaf; one unit may be longer.
LEAF = 2048
#: Percent of the documents that are cut, and percent of those that put the suffix first.
CUT_PERCENT, SPM_PERCENT = 90, 20


@dataclass(frozen=True)
class Rope:
    """A leaf (with text) or two subtrees; heights of subtrees differ by one at most."""

    units: int
    chars: int
    height: int = 0
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None


def _over(left: Rope, right: Rope) -> Rope:
    return Rope(left.units + right.units, left.chars + right.chars, max(left.height, right.height) + 1, "", left, right)


def _balanced(left: Rope, right: Rope) -> Rope:
    """One tree over two whose heights differ by two at most."""
    if left.height > right.height + 1:
        a, b = left.left, left.right
        return _over(a, _over(b, right)) if a.height >= b.height else _over(_over(a, b.left), _over(b.right, right))
    if right.height > left.height + 1:
        a, b = right.left, right.right
        return _over(_over(left, a), b) if b.height >= a.height else _over(_over(left, a.left), _over(a.right, b))
    return _over(left, right)


def join(left: Rope | None, right: Rope | None) -> Rope | None:
    """The texts of both in a row; goes down the taller tree as far as the heights differ."""
    if left is None or right is None:
        return left or right
    if left.height > right.height + 1:
        return _balanced(left.left, join(left.right, right))
    if right.height > left.height + 1:
        return _balanced(join(left, right.left), right.right)
    return _over(left, right)


class Ropes:
    """Ropes of one kind of unit: code points, or the matches of an expression.

    Matches are found from left to right; empty ones are none. What lies between two matches goes
    with the later one, what follows the last belongs to no unit and stays at the end.
    """

    def __init__(self, unit: str | None = None, leaf: int = LEAF):
        self.unit, self.leaf = re.compile(unit) if unit else None, leaf

    def _ends(self, text: str) -> list[int]:
        return [m.end() for m in self.unit.finditer(text) if m.end() > m.start()]

    def _leaf(self, text: str, units: int) -> Rope | None:
        return Rope(units, len(text), 0, text) if text else None

    def build(self, text: str) -> Rope | None:
        """A tree of least height; None for an empty text."""
        if self.unit is None:
            leaves = [Rope(len(t), len(t), 0, t) for t in (text[i : i + self.leaf] for i in range(0, len(text), self.leaf))]
        else:
            leaves, start, units, ends = [], 0, 0, self._ends(text)
            for n, end in enumerate(ends, 1):
                if end - start >= self.leaf or n == len(ends):
                    leaves.append(Rope(n - units, end - start, 0, text[start:end]))
                    start, units = end, n
            leaves += [Rope(0, len(text) - start, 0, text[start:])] if start < len(text) else []
        while len(leaves) > 1:
            pairs = [_over(leaves[i], leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
            if len(leaves) % 2:
                pairs[-1] = _balanced(pairs[-1], leaves[-1])  # its height differs by one or two
            leaves = pairs
        return leaves[0] if leaves else None

    def split(self, rope: Rope | None, rank: int, chars: bool = False) -> tuple[Rope | None, Rope | None]:
        """What ends with the unit (or code point) of that rank, counted from 1, and what follows."""
        if rope is None or rank <= 0:
            return None, rope
        if rope.left is not None:
            first = rope.left.chars if chars else rope.left.units
            if rank <= first:
                a, b = self.split(rope.left, rank, chars)
                return a, join(b, rope.right)
            a, b = self.split(rope.right, rank - first, chars)
            return join(rope.left, a), b
        if self.unit is None or chars:
            at = rank
        else:
            ends = self._ends(rope.text)
            at = ends[rank - 1] if rank <= len(ends) else rope.chars
        if at >= rope.chars:
            return rope, None
        a, b = rope.text[:at], rope.text[at:]
        count = len if self.unit is None else lambda t: len(self._ends(t))
        return self._leaf(a, count(a)), self._leaf(b, count(b))

    def text(self, rope: Rope | None) -> str:
        parts, open_ = [], [rope] if rope else []
        while open_:
            r = open_.pop()
            if r.left is None:
                parts.append(r.text)
            else:
                open_ += [r.right, r.left]
        return "".join(parts)

    # ---- the transformation

    def rearranged(self, text: str, form: str, low: int, high: int) -> tuple[str, int, int]:
        """The output, and the code points of prefix and middle; low <= high are unit ranks."""
        prefix, rest = self.split(self.build(text), low)
        middle, suffix = self.split(rest, high - low)
        p, s, m = (Rope(0, 3, 0, x) for x in (PREFIX, SUFFIX, MIDDLE))
        order = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
        whole = None
        for part in order:
            whole = join(whole, part)
        return self.text(whole), prefix.chars if prefix else 0, middle.chars if middle else 0

    def original(self, output: str | None, form: str | None) -> str | None:
        """The text from which ``rearranged`` made an output; of a plain one the output itself."""
        if output is None or form not in ("psm", "spm"):
            return output
        second = output.index(SUFFIX if form == "psm" else PREFIX)
        third = output.index(MIDDLE)
        rest, middle = self.split(self.build(output), third + len(MIDDLE), chars=True)
        rest, _ = self.split(rest, third, chars=True)
        one, two = self.split(rest, second, chars=True)
        (_, one), (_, two) = (self.split(x, 3, chars=True) for x in (one, two))
        prefix, suffix = (one, two) if form == "psm" else (two, one)
        return self.text(join(join(prefix, middle), suffix))


def draws(doc_id: object, seed: int = 1) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def plan(text: str, n: int, h: tuple[int, int, int, int]) -> tuple[str, int, int]:
    """(form, low, high) of a text of n units; a text without units or with a sentinel's spelling stays plain."""
    if not n or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= CUT_PERCENT:
        return "plain", 0, 0
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return ("spm" if h[3] % 100 < SPM_PERCENT else "psm"), a, b


def _per_row(df: DataFrame, columns: list[str], make: Callable[..., tuple], names: str) -> DataFrame:
    """``make`` of the columns (the last is a text) beside those, some 4 MB of text at a time."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    fields = [x.split() for x in names.split(", ")]
    arrow = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, len(columns) - 1, 4_000_000):
                rows = list(zip(*[make(*[v.as_py() for v in row]) for row in zip(*batch.columns, strict=True)], strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(r, arrow[k]) for r, (_, k) in zip(rows, fields, strict=True))], names=[*columns, *(f for f, _ in fields)])

    return df.select(*columns).mapInArrow(run, f"{kinds}, {names}")


def transformed(docs: DataFrame, unit: str | None = None, seed: int = 1) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars, output of every document.

    A null or empty text has no units, stays plain and gives an empty output; so does a text that spells
    a sentinel (output: the text itself). Null ids draw as an empty one, repeated rows each give their
    row, other columns are left out, an empty table gives an empty result.
    """
    ropes = Ropes(unit)

    def row(doc_id: object, text: str | None) -> tuple:
        text = text or ""
        n = len(text) if ropes.unit is None else len(ropes._ends(text))
        form, low, high = plan(text, n, draws(doc_id, seed))
        if form == "plain":
            return n, form, None, None, text
        output, prefix, middle = ropes.rearranged(text, form, low, high)
        return n, form, prefix, middle, output

    return _per_row(docs, ["doc_id", "text"], row, "n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, form, output and the exact text it was made from."""
    ropes = Ropes()
    return _per_row(outputs, [*keep, "form", "output"], lambda *row: (ropes.original(row[-1], row[-2]),), "restored string")


def fill_in_middle_report(docs: DataFrame) -> DataFrame:
    """Digests of every document's output and of the text rebuilt from it; rows as in ``transformed``."""
    made = transformed(docs).drop("text")
    back = restored(made, ("doc_id", "n", "prefix_chars", "middle_chars"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
