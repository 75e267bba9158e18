"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become lower-case words. A run of MIN_MATCH words (of all its
words, if an item has fewer) that both share is a seed; only pairs with a seed are compared.
Greedy tiling then covers the pair with its longest common runs, longest first and none
overlapping, found by running Karp-Rabin hashes over falling run lengths. A document leaks an
item if tiles cover enough of the item, whatever their order in the document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, slices

MIN_MATCH = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: A benchmark of at most so many bytes of text is broadcast; a larger one is joined by its seeds.
BROADCAST_BYTES = 32 << 20
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Primes under 2**31 and a radix for each: products of residues fit into 64 bits.
_MODULI = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` ids."""
    ids = ids.astype(np.uint64)
    out = np.full(max(0, len(ids) - size + 1), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _BASE + ids[k : len(out) + k]
            out ^= out >> np.uint64(29)
    return out


class _Runs:
    """Karp-Rabin hashes of all runs of any one length, by sums of ids times powers of a radix."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.ids, self.longest = ids, longest
        self.marked = ids < 0
        self.sums, self.powers = [], []
        for modulus, radix in _MODULI:
            powers = np.ones(longest, np.int64)
            done = 1
            while done < longest:  # powers below ``done`` times radix ** done
                powers[done : 2 * done] = powers[: min(done, longest - done)] * pow(radix, done, modulus) % modulus
                done *= 2
            self.powers.append(powers)
            self.sums.append(np.concatenate([[0], np.cumsum((ids + 2) % modulus * powers[: len(ids)] % modulus)]))

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of ``size`` ids none of which is marked, and their hashes."""
        held = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.nonzero(held[size:] == held[:-size])[0] if size <= len(self.ids) else np.zeros(0, np.int64)
        out = np.zeros(len(at), np.int64)
        for (modulus, _), sums, powers in zip(_MODULI, self.sums, self.powers, strict=True):
            # Raised to one power for all starts, so that equal runs are equal wherever they lie.
            out = (out << 31) | (sums[at + size] - sums[at]) % modulus * powers[self.longest - 1 - at] % modulus
        return at, out


def _mark(pattern: _Runs, text: _Runs, size: int) -> list[tuple[int, int, int]]:
    """Tiles of ``size``, from the front of the pattern, then of the text. There is no longer common run."""
    (starts, hashes), (places, values) = pattern.free(size), text.free(size)
    order = np.argsort(values, kind="stable")
    places, values = places[order], values[order]
    low, high = np.searchsorted(values, hashes, "left").tolist(), np.searchsorted(values, hashes, "right").tolist()
    out, after = [], {}
    for p, a, b in zip(starts.tolist(), low, high, strict=True):
        if a == b or pattern.marked[p : p + size].any():
            continue
        at = after.get(a, a)
        while at < b and text.marked[places[at] : places[at] + size].any():  # what is marked stays marked
            at += 1
        after[a] = at
        if at < b and (pattern.ids[p : p + size] == text.ids[places[at] : places[at] + size]).all():
            t = int(places[at])
            pattern.marked[p : p + size] = text.marked[t : t + size] = True
            out.append((p, t, size))
    return out


def tiles(pattern: list[int], text: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling of ``pattern`` by ``text``: (pattern start, text start, length), longest first.

    Both hold non-negative ids; a negative one matches nothing. The longest common run of what
    is free is found by bisection over lengths, as every part of a common run is one too. Sizes
    that occur add up to no more than the pattern, so there are few, and each step takes time
    in proportion to both lengths, however often words repeat.
    """
    high = min(len(pattern), len(text))
    if high < min_match:
        return []
    longest = max(len(pattern), len(text))
    one, other = (_Runs(np.asarray(x, np.int64), longest) for x in (pattern, text))

    def common(size: int) -> bool:
        own = one.free(size)[1]
        return len(own) > 0 and bool(np.isin(other.free(size)[1], own).any())

    found: list[tuple[int, int, int]] = []
    while high >= min_match and common(min_match):
        low, top = min_match, high
        while low < top:
            middle = (low + top + 1) // 2
            low, top = (middle, top) if common(middle) else (low, middle - 1)
        found += _mark(one, other, low)
        high = low - 1
    return found


class Items:
    """Benchmark items with an index of their seeds. ``kinds``: by length of a seed, items, seeds and their owners."""

    def __init__(self, rows: list[tuple[object, str]], min_match: int, coverage: float):
        self.coverage = coverage
        self.vocabulary: dict[str, int] = {}
        self.names, self.ids = [], []
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for name, text in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], np.int64)
            if len(ids):
                size = min(min_match, len(ids))
                seeds, times = np.unique(_windows(ids, size), return_counts=True)
                parts[size].append((seeds, np.full(len(seeds), len(self.names)), times))
                self.names.append(name)
                self.ids.append(ids)
        self.sizes = np.array([len(i) for i in self.ids], np.int64)
        self.kinds = {}
        for size, own in parts.items():
            seeds, owners, times = map(np.concatenate, zip(*own, strict=True))
            order = np.argsort(seeds, kind="stable")
            self.kinds[size] = seeds[order], owners[order], times[order]

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, object, float, int, int]]:
        """(index of text, item, coverage, number of tiles, length of the longest)."""
        if not self.names:
            return
        get = self.vocabulary.get
        ids = [np.array([get(w, -1) for w in words(t)], np.int64) for t in texts]
        # All texts in one array, a gap between them; a window with an unknown word can be no seed.
        flat = np.concatenate([x for i in ids for x in (i, [-1])]) if ids else np.zeros(0, np.int64)
        starts = np.cumsum([0, *[len(i) + 1 for i in ids]])
        known = np.concatenate([[0], np.cumsum(flat >= 0)])
        for size in self.kinds:
            for doc, owner, at in self._candidates(flat, known, starts, size):
                text = self._under(flat, at, size)
                found = tiles(self.ids[owner], text, size)
                share = sum(k for _, _, k in found) / len(self.ids[owner])
                if share >= self.coverage:
                    yield doc, self.names[owner], share, len(found), max(k for _, _, k in found)

    def _candidates(self, flat: np.ndarray, known: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(index of text, item, starts of their common seeds in ``flat``) of pairs that may reach the coverage.

        Tiles consist of seeds, so they cover no more of an item than ``size`` words for each
        place of a common seed in it.
        """
        seeds, owners, times = self.kinds[size]
        full = np.nonzero(known[size:] - known[:-size] == size)[0] if len(flat) >= size else np.zeros(0, np.int64)
        hashes = np.full(len(full), size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                hashes = hashes * _BASE + flat[full + k].astype(np.uint64)
                hashes ^= hashes >> np.uint64(29)
        low, high = np.searchsorted(seeds, hashes, "left"), np.searchsorted(seeds, hashes, "right")
        many = high - low
        if not many.any():
            return
        of = np.repeat(np.arange(len(full)), many)
        entry = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
        pair = (np.searchsorted(starts, full[of], "right") - 1) * len(self.names) + owners[entry]
        order = np.lexsort((hashes[of], pair))
        of, entry, pair = of[order], entry[order], pair[order]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (entry[1:] != entry[:-1])])
        edges = np.append(np.nonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))[0], len(pair))
        most = np.add.reduceat(np.where(new, times[entry], 0), edges[:-1]) * size
        for a, b, cover in zip(edges[:-1].tolist(), edges[1:].tolist(), most.tolist(), strict=True):
            doc, owner = divmod(int(pair[a]), len(self.names))
            if cover >= self.coverage * self.sizes[owner]:
                yield doc, owner, np.sort(full[of[a:b]])

    @staticmethod
    def _under(flat: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """The words under the seeds that start at ``at``, with a gap between runs."""
        words_at = np.unique((at[:, None] + np.arange(size)).ravel())
        gaps = np.nonzero(np.diff(words_at) > 1)[0] + 1
        return np.insert(flat[words_at], gaps, -1)


_SCHEMA = pa.schema([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest_tile", pa.int32())])
_COLUMNS = "item_id long, coverage double, n_tiles int, longest_tile int"


def _direct(docs: DataFrame, items: DataFrame, coverage: float, min_match: int) -> DataFrame:
    rows = [(r[0], r[1]) for r in items.select(F.col("item_id").cast("long"), "text").collect()]
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(sent.value, min_match, coverage)
        for batch in batches:
            for part in slices(batch, 1):
                found = list(index.leaks(part.column(1).to_pylist()))
                if found:
                    columns = list(zip(*found, strict=True))
                    arrays = [pa.array(c, f.type) for c, f in zip(columns[1:], _SCHEMA, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0])), *arrays], names=["doc_id", *_SCHEMA.names])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {_COLUMNS}")


def _doc_seeds(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(_doc, seed): the distinct seeds of every document, of all lengths that items have."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                hashes = np.array([xxhash.xxh64_intdigest(w) for w in words(text)], np.uint64)
                own = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_windows(hashes, n) for n in sizes]])).view(np.int64)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(own), pa.int64()), pa.array(own)], names=["_doc", "seed"])

    return docs.select("_doc", "text").mapInArrow(seeds, "_doc long, seed long")


def _item_seeds(items: DataFrame, coverage: float, min_match: int) -> DataFrame:
    """(_item, seed): of every item the seeds by which documents are looked for.

    Tiles cover ``coverage`` of an item's words only if so many of its places hold a common
    seed: those words over a seed's length. One fewer may stay unlooked for without losing a
    document, and those are the ones that most items hold, so common passages meet few items.
    """

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                hashes = np.array([xxhash.xxh64_intdigest(w) for w in words(text)], np.uint64)
                size = min(min_match, len(hashes))
                if size:
                    own, times = np.unique(_windows(hashes, size), return_counts=True)
                    need = max(1, int(np.ceil(coverage * len(hashes) / size - 1e-9)))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(own), pa.int64()), pa.array(own.view(np.int64)), pa.array(times), pa.array([need] * len(own), pa.int64())], names=["_item", "seed", "times", "need"])

    own = materialize(items.select("_item", F.col("item_text").alias("text")).mapInArrow(seeds, "_item long, seed long, times long, need long"), "seeds")
    held = own.groupBy("seed").agg(F.count(F.lit(1)).alias("held"))
    upto = Window.partitionBy("_item").orderBy(F.desc("held"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    return own.join(held, "seed").withColumn("upto", F.sum("times").over(upto)).where("upto >= need").select("_item", "seed").distinct()


def _seed_sizes(items: DataFrame, min_match: int) -> list[int]:
    """The lengths of seeds of all items: at most ``min_match`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([min(min_match, len(words(t))) for t in batch.column(0).to_pylist()], pa.int32())], names=["n"])

    return sorted(r[0] for r in items.select("text").mapInArrow(count, "n int").where("n > 0").distinct().collect())


def _by_seeds(docs: DataFrame, items: DataFrame, coverage: float, min_match: int) -> DataFrame:
    """For a benchmark too large to broadcast: join by seeds, then tile each pair that may reach the coverage.

    All joins are plain shuffle joins, whose hot keys adaptive execution splits.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("_doc"), "doc_id", "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"), F.xxhash64("item_id", "text").alias("_item"))
    left = _doc_seeds(keyed.where("text is not null"), _seed_sizes(items.select(F.col("item_text").alias("text")), min_match))
    right = materialize(_item_seeds(items, coverage, min_match), "looked_for")
    pairs = materialize(left.join(right, "seed").select("_doc", "_item").distinct(), "pairs")

    def tile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, item, item_text in zip(frame["doc_id"], frame["text"], frame["item_id"], frame["item_text"], strict=True):
                out += [(doc, *x[1:]) for x in Items([(item, item_text)], min_match, coverage).leaks([text])]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", *_SCHEMA.names])

    return pairs.join(items, "_item").join(keyed, "_doc").select("doc_id", "text", "item_id", "item_text").mapInPandas(tile, f"doc_id {kind}, {_COLUMNS}")


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every pair of a document and a benchmark item it leaks.

    Returns doc_id, item_id, coverage, n_tiles, longest_tile. Whole texts are compared. Null
    and empty texts and items have no seed and never match; an item of fewer than ``min_match``
    words matches as a whole.
    Repeated document rows give repeated pairs; repeated item rows too. Equal tile lengths
    are taken from the front of the item, then of the text. Extra columns are ignored; an
    empty table on either side gives an empty result.
    """
    if _fits(items, broadcast_bytes):
        return _direct(docs, items, coverage, min_match)
    return _by_seeds(docs, items, coverage, min_match)


def _fits(items: DataFrame, broadcast_bytes: int) -> bool:
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    return size[0] + 16 * size[1] <= broadcast_bytes


def clean(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that leak no item, with their columns unchanged; texts are not shuffled if the items fit."""
    if not _fits(items, broadcast_bytes):
        keyed = docs.withColumn("_leak_key", F.xxhash64("doc_id", "text"))
        flagged = _by_seeds(keyed.select(F.col("_leak_key").alias("doc_id"), "text"), items, coverage, min_match)
        flagged = flagged.select(F.col("doc_id").alias("_leaking")).distinct()
        return keyed.join(flagged, keyed["_leak_key"] == flagged["_leaking"], "left_anti").drop("_leak_key")
    sent = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.select(F.col("item_id").cast("long"), "text").collect()])

    text_at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(sent.value, min_match, coverage)
        for batch in batches:
            for part in slices(batch, text_at):
                bad = {x[0] for x in index.leaks(part.column("text").to_pylist())}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)])) if bad else part

    return docs.mapInArrow(keep, docs.schema)
