"""Phrase collocations by level-wise passes, exact, per language.

Level 1 counts words. Level k reads the texts again and counts those phrases of k words whose
first and last k-1 words are both frequent. What the tasks get of a level is not its phrases
but one bitmap of their hashes, at most 32 MB whatever the corpus: a phrase that passes
by chance is counted, is too rare, and goes, because no phrase is more frequent than its parts.
Phrases are counted inside a task by the numbers that the task gives to words, so no hash decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, slices

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
SCALE, COVERED = 2_000_000, 80
#: Bits of a level's bitmap for each of its phrases, and the most there are.
BITS_PER_PHRASE, MOST_BITS = 64, 1 << 28
#: Bytes of text that a task counts at once, and those that it holds of all languages until then.
CHUNK, MOST_HELD = 1_500_000, 6_000_000
#: Rows that a task hands over at once.
ROWS = 65_536
#: Salts of a language when its best phrases are chosen.
SALTS = 64

_END = 0xFF  # no UTF-8 text has this byte
_BYTES = bytes(_END if b in b".,;:!?\n\x0b\x0c\r" else 32 if b in b" \t" else b for b in range(256))
_MARK = bytes([_END])
_M1 = np.uint64(0x9E3779B97F4A7C15)


def _pieces(text: str) -> list[bytes]:
    """The lower-cased bytes of a text with spaces and piece ends only, cut at piece ends into CHUNK bytes or one piece."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_BYTES)  # bytes.lower() knows A-Z only
    return [data] if len(data) <= CHUNK else _cut(data)


class _Held:
    """Texts of each language until there are CHUNK bytes of it, or MOST_HELD of all."""

    def __init__(self) -> None:
        self.parts: dict[str, list[bytes]] = {}
        self.sizes: dict[str, int] = {}

    def add(self, lang: str, text: str) -> Iterator[tuple[str, bytes]]:
        for part in _pieces(text):
            self.parts.setdefault(lang, []).append(part)
            self.sizes[lang] = self.sizes.get(lang, 0) + len(part) + 1
            if self.sizes[lang] >= CHUNK:
                yield lang, self._taken(lang)
            elif sum(self.sizes.values()) >= MOST_HELD:
                yield from self.rest()

    def _taken(self, lang: str) -> bytes:
        del self.sizes[lang]
        return _MARK.join(self.parts.pop(lang))

    def rest(self) -> Iterator[tuple[str, bytes]]:
        for lang in list(self.parts):
            yield lang, self._taken(lang)


def _cut(data: bytes) -> list[bytes]:
    out, start = [], 0
    while start < len(data):
        end = data.find(_MARK, start + CHUNK)
        end = len(data) if end < 0 else end
        out.append(data[start:end])
        start = end + 1
    return out


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _next_hash(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of what stands before its last word, and that word's."""
    h = (h ^ word) * _M1
    return h ^ h >> np.uint64(29)


class _Chunk:
    """The words of one chunk: ``ids`` in order, -1 at piece ends; ``words`` by id."""

    def __init__(self, data: bytes, lang: str):
        signs = np.frombuffer(data, np.uint8)
        solid, mark = signs != 32, signs == _END
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | mark[:-1] | mark[1:]  # a mark is a word of its own
        offsets = np.append(np.cumsum(solid)[begins] - 1, np.count_nonzero(solid)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(signs[solid])]).dictionary_encode()
        self.ids, self.words, self.lang = coded.indices.to_numpy().astype(np.int64), coded.dictionary, lang
        at = pc.index(self.words, pa.scalar(_MARK, pa.binary())).as_py()
        if at >= 0:
            self.words = pa.concat_arrays([self.words.slice(0, at), self.words.slice(at + 1)])
            self.ids = np.where(self.ids == at, -1, self.ids - (self.ids > at))
        self._hashes: np.ndarray | None = None

    def inside(self, k: int) -> np.ndarray:
        """For each place: whether the k words from there are in one piece."""
        n = max(len(self.ids) - k + 1, 0)
        out = np.ones(n, bool)
        for j in range(k):
            out &= self.ids[j : j + n] >= 0
        return out

    def phrase_hashes(self, k: int) -> np.ndarray:
        """For each place the hash of the k words from there; of no use at piece ends."""
        if self._hashes is None:
            self._hashes = np.append(_word_hashes(self.words.to_pylist(), _seed(self.lang)), np.uint64(0))  # -1 finds the last
        n = max(len(self.ids) - k + 1, 0)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = _next_hash(h, self._hashes[self.ids[j : j + n]])
        return h

    def counted(self, starts: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases of k words at these places, and their counts."""
        size = max(len(self.words), 1)
        if k == 1:  # every word occurs
            return self.words.cast(pa.string()), np.bincount(self.ids[starts], minlength=len(self.words))
        key, range_ = self.ids[starts], size
        for j in range(1, k):
            if range_ * size >= 1 << 62:  # keys as numbers of the phrases so far
                _, key = np.unique(key, return_inverse=True)
                range_ = len(starts)
            key = key * np.int64(size) + self.ids[starts + j]
            range_ *= size
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        at = starts[order[new]]
        parts = [self.words.take(pa.array(self.ids[at + j])) for j in range(k)]
        return pc.binary_join_element_wise(*parts, b" ").cast(pa.string()), np.diff(np.append(new, len(key)))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64(bits - 1)).astype(np.int64)


def _emitted(docs: DataFrame, k: int, bitmap=None) -> DataFrame:
    """(lang, phrase, n) of phrases of k words by chunk; of level 1 also a row with phrase '' that counts all words."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        held = _Held()
        for whole in batches:
            for batch in slices(whole, 1):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from held.add("und" if lang is None else lang, text or "")
        yield from held.rest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bitmap.value, np.uint8) if bitmap is not None else None
        for lang, data in chunks(batches):
            chunk = _Chunk(data, lang)
            fits = chunk.inside(k)
            if known is not None and len(fits):
                at = _slots(chunk.phrase_hashes(k - 1), len(known) * 8)
                frequent = (known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                fits &= frequent[:-1] & frequent[1:]
            starts = np.flatnonzero(fits)
            if len(starts):
                phrases, counts = chunk.counted(starts, k)
                for at in range(0, len(phrases), ROWS):
                    some = phrases.slice(at, ROWS)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(some)), some, pa.array(counts[at : at + ROWS].astype(np.int64))], names=["lang", "phrase", "n"])
                if k == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([len(starts)], pa.int64())], names=["lang", "phrase", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, n long")


def _bitmap(level: DataFrame, k: int, phrases: int):
    """A broadcast bitmap of the hashes of a level's phrases of k words; its 64-bit words are 4 million at most."""
    bits = 1 << 12
    while bits < min(phrases * BITS_PER_PHRASE, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = batch.column(0).to_pylist(), [p.split(b" ") for p in batch.column(1).cast(pa.binary()).to_pylist()]
            seeds = {lang: _seed(lang) for lang in set(langs)}
            h = np.zeros(len(found), np.uint64)
            for j in range(k):
                h = _next_hash(h, np.fromiter((xxhash.xxh64_intdigest(w[j], seeds[lang]) for w, lang in zip(found, langs, strict=True)), np.uint64, len(found)))
            slot = _slots(h, bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    words = level.select("lang", "phrase").mapInArrow(run, "word long, bit long")
    filled = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, "<i8")
    out[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    return level.sparkSession.sparkContext.broadcast(out.tobytes())


def levels(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, k, n): every phrase of up to ``longest`` words that occurs ``min_count`` times; k = 0, phrase '': all words."""
    out, bitmap = None, None
    for k in range(1, longest + 1):
        found = _emitted(docs, k, bitmap).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        kept = materialize(found.where((F.col("n") >= min_count) | (F.col("phrase") == "")), f"level{k}")
        one = kept.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(k).alias("k"), "n")
        out = one if out is None else out.unionByName(one)
        phrases = kept.where("phrase <> ''")
        size = phrases.count()
        if bitmap is not None:
            bitmap.unpersist()
        if not size or k == longest:
            break
        bitmap = _bitmap(phrases, k, size)
    return out


def _words(c: str = "phrase") -> Column:
    return F.split(F.col(c), " ", -1)


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(table: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of every phrase of two words and more, by its lowest cut.

    Both parts of every cut are in the table, being at least as frequent. Products are decimals.
    """
    own = table.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    cuts = own.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    w = _words()
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", _part(w, F.lit(1), F.col("cut")).alias("first"), _part(w, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    counts = table.where("k >= 1").select("lang", F.col("phrase").alias("part"), "n")
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("part").alias(side), F.col("n").alias(name)), ["lang", side])
    cuts = cuts.withColumn("score", F.expr(f"cast(a as decimal(19,0)) * {SCALE} div (cast(l as decimal(19,0)) + r)"))
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Without the phrases that lie in a longer one occurring ``covered`` percent as often or more."""
    w = _words()
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    within = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("outer"))
    most = within.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    at_most = F.col("outer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * covered
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("outer").isNull() | at_most).drop("outer")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score, count and spelling.

    A null language is 'und', a null text empty; repeated rows count each time; other columns are not
    read; without phrases that are frequent enough the result is empty.
    """
    table = levels(docs, longest, min_count)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = uncovered(scored(table)).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)  # at most SALTS * top rows
    totals = table.where("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
