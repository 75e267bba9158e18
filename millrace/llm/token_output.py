"""Token-id output by an adaptive context-mixing range coder.

Ids are cut into blocks that know nothing of each other: each starts with an empty model and
carries a checksum. An id is coded in one step, in one distribution mixed of three orders:

- order 0: adaptive frequencies of the ids that orders 1 and 2 missed, with an escape for new ones,
- order 1: the id expected after the one before it,
- order 2: the id expected after the two before it (hashed table).

The weights are learned: for each pair of lengths of success of orders 1 and 2, and whether
they agree, how often each prediction came true. The range coder narrows to the id's
interval in the mixed distribution. All quantities are integers, so decoding repeats encoding
exactly.

A block is cut into lanes, which are coded side by side: one step handles the next id of every
lane with array operations. All lanes use and teach one model, which learns after every span
of steps, at first after each. The model is the same code in both directions.

A frame holds whole consecutive documents: header, document lengths, blocks. Frames are the
rows of a Parquet table, which Spark commits once and any store can hold.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, slices
from millrace.llm.tokens import encoder, vocabulary_path

MAGIC = b"MRC3"
END_ID = 0
#: A frame is closed at the first document end at or after so many ids.
FRAME_IDS = 1 << 20
#: Most ids of a block; bounds memory (some 40 bytes an id).
BLOCK_IDS = 1 << 21
#: Bytes of text that are encoded at once.
TEXT_BYTES = 1_200_000
#: Ids of a lane, if the block has no more than _LANES of them, and the most steps of a span.
_LANE_IDS, _LANES, _SPAN = 256, 4096, 16
#: Ids are below _IDS; the escape is one more symbol of order 0.
_IDS = _ESCAPE = 1 << 16
#: Bits of order 0, of the weights and of the mix; the least weight of order 0.
_LOW_BITS, _WEIGHT_BITS = 16, 12
_TOTAL_BITS = _LOW_BITS + _WEIGHT_BITS
_FLOOR = 64
#: Ids that order 0 holds at most; counts are halved until so few are left.
_HELD = 1 << 15
_SLOTS, _LEVELS = 1 << 17, 16
#: Ranges of the coder are below 2**_RANGE_BITS, which a double holds exactly, and 2**_LEAST_BITS at least.
_RANGE_BITS, _LEAST_BITS = 48, 32
_LEAST = 1 << _LEAST_BITS
#: The length of success after a miss and after a hit, in the place that it has in an entry.
_NEXT = np.concatenate([np.maximum(np.arange(_LEVELS) >> 1, 1), np.minimum(np.arange(_LEVELS) + 1, _LEVELS - 1)]).astype(np.int32) << 16


class _Model:
    """What the orders say of the next id of many lanes."""

    def __init__(self) -> None:
        # The id expected in a context, and above it how often of late it came (0: context not met).
        self.heard = (np.zeros(_IDS, np.uint32), np.zeros(_SLOTS, np.uint32))
        self.seen = np.zeros(_IDS + 1, np.int64)
        self.seen[_ESCAPE] = 1
        self.came = np.zeros((2 * _LEVELS * _LEVELS, 4), np.int64)
        self.settle()

    def settle(self) -> None:
        """The distribution of order 0 and the weights, from all that was counted."""
        known = np.flatnonzero(self.seen)
        while len(known) > _HELD:
            self.seen[:_IDS] >>= 1
            known = np.flatnonzero(self.seen)
        counts = self.seen[known]
        widths = counts * ((1 << _LOW_BITS) - len(known)) // counts.sum() + 1
        widths[-1] += (1 << _LOW_BITS) - widths.sum()  # the escape gets what rounding leaves
        each = np.zeros(_IDS + 1, np.int64)
        each[known] = widths
        self.starts = (np.cumsum(each) - each).astype(np.int32)
        self.widths = each.astype(np.int32)
        self.holder = np.repeat(known.astype(np.int32), widths)
        missed, first, second, both = self.came.T
        second = 4 * (second + both) + 1
        first = 4 * first + 1
        whole = first + second + 4 * missed + 2
        self.w2 = (second * ((1 << _WEIGHT_BITS) - _FLOOR) // whole).astype(np.int32)
        self.w1 = (first * ((1 << _WEIGHT_BITS) - _FLOOR) // whole).astype(np.int32)
        self.w0 = (1 << _WEIGHT_BITS) - self.w1 - self.w2
        self.share = -(-(1 << 40) // self.w0.astype(np.int64))  # u * share >> 40 is u // w0 for u below 2**28

    def ask(self, last: np.ndarray, second: np.ndarray) -> None:
        """What the orders say after the ids ``second``, ``last`` (int32)."""
        self.at = (last, ((second * 40_503 + last * 30_011) >> 3) & (_SLOTS - 1))
        e1, e2 = (t.take(a, mode="clip").view(np.int32) for t, a in zip(self.heard, self.at, strict=True))
        self.said = (e1 & 0xFFFF, e2 & 0xFFFF)
        self.run = (e1 >> 16, e2 >> 16)
        self.kind = (self.run[1] << 5) + (self.run[0] << 1) + (self.said[0] == self.said[1])
        self.part = self.w0.take(self.kind, mode="clip")
        self.mass = (self.w1.take(self.kind, mode="clip") << _LOW_BITS, self.w2.take(self.kind, mode="clip") << _LOW_BITS)

    def intervals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and width of ``ids`` in the mix, and which of them are escapes."""
        low = self.starts.take(ids, mode="clip") * self.part
        width = self.widths.take(ids, mode="clip") * self.part
        for said, mass in zip(self.said, self.mass, strict=True):
            low += (ids > said) * mass
            width += (ids == said) * mass
        new = np.flatnonzero(width == 0)
        if len(new):
            low[new] = self.starts[_ESCAPE] * self.part[new] + self.mass[0][new] + self.mass[1][new]
            width[new] = self.widths[_ESCAPE] * self.part[new]
        return low, width, new

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold ``value``, with start and width; _ESCAPE for escapes."""
        (p1, p2), (m1, m2), part = self.said, self.mass, self.part
        low1 = self.starts.take(p1, mode="clip") * part
        low1 += (p1 > p2) * m2
        low2 = self.starts.take(p2, mode="clip") * part
        low2 += (p2 > p1) * m1
        width1 = self.widths.take(p1, mode="clip") * part
        width1 += m1
        width2 = self.widths.take(p2, mode="clip") * part
        width2 += m2
        same = p1 == p2
        both = same * m1
        width2 += both
        past1, past2 = value - low1, value - low2
        # As unsigned numbers those before a start are large.
        in2 = past2.view(np.uint32) < width2.view(np.uint32)
        in1 = past1.view(np.uint32) < width1.view(np.uint32)
        in1 &= ~same
        shift = (past1 >= 0) * m1
        shift += (past2 >= 0) * m2
        rest = (value - shift) * self.share.take(self.kind, mode="clip")
        rest >>= 40
        ids = self.holder.take(rest, mode="clip")
        low = self.starts.take(ids, mode="clip") * part
        low += shift
        width = self.widths.take(ids, mode="clip") * part
        for own, p, start, size in ((in1, p1, low1, width1), (in2, p2, low2, width2)):
            # Sums are some eight times as fast here as np.where and np.copyto.
            ids += own * (p - ids)
            low += own * (start - low)
            width += own * (size - width)
        return ids, low, width

    def asked(self) -> tuple[np.ndarray, ...]:
        """What was asked, for learn."""
        return (*self.at, *self.said, *self.run, self.kind)

    def learn(self, pieces: list[tuple[np.ndarray, tuple[np.ndarray, ...]]]) -> None:
        """Take in the ids of a span of steps, each piece with what was asked for it."""
        which, missed = [], []
        for ids, (at1, at2, said1, said2, run1, run2, kind) in pieces:
            hit1, hit2 = ids == said1, ids == said2
            for table, at, said, run, hit in zip(self.heard, (at1, at2), (said1, said2), (run1, run2), (hit1, hit2), strict=True):
                entry = (hit | (run > 1)) * (said - ids)
                entry += ids
                entry += _NEXT.take((hit << 4) + run, mode="clip")
                table[at.astype(np.int64)] = entry.view(np.uint32)
            which.append((kind << 2) + hit1 + 2 * hit2)
            hit1 |= hit2
            missed.append(ids.compress(~hit1))
        self.came += np.bincount(np.concatenate(which), minlength=self.came.size).reshape(self.came.shape)
        counts = np.bincount(np.concatenate(missed), minlength=_IDS)
        self.seen[_ESCAPE] += counts[self.widths[:_IDS] == 0].sum()
        self.seen[:_IDS] += counts
        self.settle()


def _spans(steps: int) -> Iterator[tuple[int, int]]:
    """First and last step (exclusive) of the spans after which the model learns."""
    start = 0
    while start < steps:
        end = min(start + min(max(start, 1), _SPAN), steps)
        yield start, end
        start = end


def _lanes(n: int) -> tuple[int, int, int]:
    """Number of lanes of ``n`` ids, steps that all lanes take, and lanes that take one more."""
    lanes = min(max(n // _LANE_IDS, 1), _LANES)
    return lanes, n // lanes, n % lanes


class _Encoder:
    """Range coders side by side. Carries stay in the words and are settled at the end."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, 1 << _RANGE_BITS, np.int64)
        self.room = 3 * steps + 4  # an id takes at most 22 bits and, if it is an escape, 16 more
        self.words = np.zeros(lanes * self.room, np.int32)
        self.used = np.arange(lanes) * self.room

    def put(self, low: np.ndarray, width: np.ndarray) -> None:
        n = len(low)
        unit = self.range[:n] >> _TOTAL_BITS
        self.range[:n] = unit * width
        self.low[:n] += unit * low
        self._emit(np.flatnonzero(self.range[:n] < _LEAST))

    def put_plain(self, lanes: np.ndarray, ids: np.ndarray) -> None:
        unit = self.range[lanes] >> 16
        self.range[lanes] = unit
        self.low[lanes] += unit * ids
        self._emit(lanes[unit < _LEAST])

    def _emit(self, lanes: np.ndarray) -> None:
        while len(lanes):
            low, size = self.low[lanes], self.range[lanes] << 16
            self.words[self.used[lanes]] = low >> _LEAST_BITS
            self.used[lanes] += 1
            self.low[lanes] = (low & (_LEAST - 1)) << 16
            self.range[lanes] = size
            lanes = lanes[size < _LEAST]

    def finish(self) -> bytes:
        """Numbers of words of the lanes, and the words."""
        self.words[self.used] = (self.low + _LEAST - 1) >> _LEAST_BITS  # zeros may follow
        counts = self.used + 1 - np.arange(len(self.used)) * self.room
        over = np.flatnonzero(self.words > 0xFFFF)
        while len(over):
            self.words[over] -= 1 << 16
            self.words[over - 1] += 1
            over = over - 1
            over = over[self.words[over] > 0xFFFF]
        words = self.words.reshape(len(counts), self.room)
        return counts.astype("<u2").tobytes() + words[np.arange(self.room) < counts[:, None]].astype("<u2").tobytes()


class _Decoder:
    def __init__(self, coded: bytes, lanes: int):
        counts = np.frombuffer(coded, "<u2", min(lanes, len(coded) // 2)).astype(np.int64)
        if len(counts) < lanes or 2 * (lanes + int(counts.sum())) != len(coded):
            raise ValueError("length of a block does not match")
        self.words = np.append(np.frombuffer(coded, "<u2", offset=2 * lanes).astype(np.int64), 0)
        self.used = np.cumsum(counts) - counts
        self.stop = self.used + counts
        self.range = np.full(lanes, 1 << _RANGE_BITS, np.int64)
        self.code, every = np.zeros(lanes, np.int64), np.arange(lanes)
        for _ in range(_RANGE_BITS // 16):
            self.code = (self.code << 16) | self._next(every)

    def _next(self, lanes: np.ndarray) -> np.ndarray:
        at = self.used[lanes]
        self.used[lanes] += 1
        return self.words[np.where(at < self.stop[lanes], at, len(self.words) - 1)]

    def look(self, n: int) -> np.ndarray:
        self.unit = self.range[:n] >> _TOTAL_BITS
        value = (self.code[:n] / self.unit).astype(np.int32)  # exact: both are below 2**48, and the quotient below 2**29
        return np.minimum(value, (1 << _TOTAL_BITS) - 1, out=value)

    def take(self, low: np.ndarray, width: np.ndarray) -> None:
        n = len(low)
        self.code[:n] -= self.unit * low
        self.range[:n] = self.unit * width
        np.minimum(self.code[:n], self.range[:n] - 1, out=self.code[:n])  # damaged blocks stay in bounds
        self._fill(np.flatnonzero(self.range[:n] < _LEAST))

    def take_plain(self, lanes: np.ndarray) -> np.ndarray:
        unit = self.range[lanes] >> 16
        ids = np.minimum(self.code[lanes] // unit, _IDS - 1)
        self.code[lanes] = np.minimum(self.code[lanes] - unit * ids, unit - 1)
        self.range[lanes] = unit
        self._fill(lanes[unit < _LEAST])
        return ids

    def _fill(self, lanes: np.ndarray) -> None:
        while len(lanes):
            size = self.range[lanes] << 16
            self.code[lanes] = (self.code[lanes] << 16) | self._next(lanes)
            self.range[lanes] = size
            lanes = lanes[size < _LEAST]


def encode_block(ids: np.ndarray) -> bytes:
    """A block's coded bytes. Ids are below 65536; there is one at least."""
    lanes, even, more = _lanes(len(ids))
    wide = (even + 1) * more
    table = np.zeros((even + 3, lanes), np.int32)  # two rows of zeros stand before the first ids
    table[2:, :more] = ids[:wide].reshape(more, even + 1).T
    table[2:-1, more:] = ids[wide:].reshape(lanes - more, even).T
    model, coder = _Model(), _Encoder(lanes, even + 1)
    for start, end, n in _shape(even, more, lanes):
        second, last, ids = (table[start + k : end + k, :n].ravel() for k in range(3))
        model.ask(last, second)
        low, width, new = model.intervals(ids)
        cuts = np.searchsorted(new, np.arange(end - start + 1) * n)
        for k in range(end - start):
            coder.put(low[k * n : (k + 1) * n], width[k * n : (k + 1) * n])
            own = new[cuts[k] : cuts[k + 1]]
            if len(own):
                coder.put_plain(own - k * n, ids[own])
        model.learn([(ids, model.asked())])
    return coder.finish()


def _shape(even: int, more: int, lanes: int) -> list[tuple[int, int, int]]:
    """The spans, with the number of lanes that have an id in them."""
    return [(a, b, lanes) for a, b in _spans(even)] + ([(even, even + 1, more)] if more else [])


def decode_block(coded: bytes, count: int) -> np.ndarray:
    """The block's ids, from its bytes and their number."""
    lanes, even, more = _lanes(count)
    table = np.zeros((even + 1, lanes), np.int32)
    last = second = np.zeros(lanes, np.int32)
    model, coder = _Model(), _Decoder(coded, lanes)
    for start, end, n in _shape(even, more, lanes):
        pieces = []
        for k in range(start, end):
            model.ask(last[:n], second[:n])
            ids, low, width = model.find(coder.look(n))
            coder.take(low, width)
            new = np.flatnonzero(ids == _ESCAPE)
            if len(new):
                ids[new] = coder.take_plain(new)
            table[k, :n] = ids
            last, second = ids, last
            pieces.append((ids, model.asked()))
        model.learn(pieces)
    out = np.empty(count, np.uint16)
    wide = (even + 1) * more
    out[:wide] = table[:, :more].T.ravel()
    out[wide:] = table[:even, more:].T.ravel()
    return out


# ---- frames: magic, number of documents, number of blocks; lengths of documents (u32); of each
# ---- block number of ids, bytes and crc32 of its ids as u32; the blocks. All little-endian.


def _frame(docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
    lengths = [len(d) for d in docs]
    cuts = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
    coded = [encode_block(c) for c in cuts]
    head = [MAGIC, struct.pack("<II", len(lengths), len(cuts)), np.array(lengths, "<u4").tobytes()]
    head += [struct.pack("<III", len(c), len(b), zlib.crc32(c.astype("<u4").tobytes())) for c, b in zip(cuts, coded, strict=True)]
    return b"".join([*head, *coded])


def pack_frames(groups: list[list[np.ndarray]]) -> list[bytes]:
    """One frame for each list of documents' ids."""
    return [_frame(g) for g in groups]


def unpack_frames(frames: list[bytes]) -> list[list[np.ndarray]]:
    """Each frame's documents' ids. A damaged block raises ValueError."""
    return [_documents(data) for data in frames]


def _documents(data: bytes) -> list[np.ndarray]:
    if data[:4] != MAGIC:
        raise ValueError("not a frame of token ids")
    n_docs, n_blocks = struct.unpack_from("<II", data, 4)
    sizes = np.frombuffer(data, "<u4", n_docs, 12).astype(np.int64)
    at = 12 + 4 * n_docs
    heads = [struct.unpack_from("<III", data, at + 12 * k) for k in range(n_blocks)]
    at += 12 * n_blocks
    blocks = [np.zeros(0, np.uint16)]
    for count, size, crc in heads:
        if count > BLOCK_IDS:
            raise ValueError("more ids than a block can hold")
        ids = decode_block(data[at : at + size], count)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block does not match")
        blocks.append(ids)
        at += size
    return np.split(np.concatenate(blocks), np.cumsum(sizes)[:-1]) if n_docs else []


def narrow(ids: np.ndarray) -> np.ndarray:
    """The ids in the 16 bits that a block codes."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError(f"id {int(ids.max())} is beyond 65535, the largest that a block can hold")
    return ids.astype(np.uint16)


def write_frames(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents' ids in ascending order of doc_id; returns the table of frames as read back.

    Columns: part and frame (their order is that of the documents), doc_ids, payload. Each
    text is encoded whole, with id 0 after it. Null texts are empty, null doc_ids come first,
    rows of equal doc_id are ordered by their texts' hash. Extra columns are ignored; an empty
    table gives no frames.
    """
    path = path or vocabulary_path()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    order = [F.asc_nulls_first("doc_id"), F.col("_tie"), F.col("_spread")]  # equal rows may lie in several parts
    ordered = ordered.withColumn("_tie", tie).withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encode = encoder(path).encode_arrays
        docs: list[np.ndarray] = []
        names: list[int | None] = []
        open_ids = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, docs, names, open_ids
            arrays = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array(pack_frames([docs]), pa.binary())]
            number, docs, names, open_ids = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays(arrays, names=["part", "frame", "doc_ids", "payload"])

        for batch in batches:
            for piece in slices(batch, 1, TEXT_BYTES):
                ids, lengths = encode(piece.column(1))
                ends = np.cumsum(lengths)
                own = np.split(np.insert(narrow(ids), ends, END_ID), ends[:-1] + np.arange(1, len(ends)))
                for name, doc in zip(piece.column(0).to_pylist(), own, strict=True):
                    docs.append(doc)
                    names.append(name)
                    open_ids += len(doc)
                    if open_ids >= FRAME_IDS:
                        yield flush()
        if docs:
            yield flush()

    return materialize(ordered.mapInArrow(pack, "part int, frame int, doc_ids array<long>, payload binary"), "frames")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[np.ndarray]]]:
    """Of each frame the columns doc_id, part, frame and place, and the documents' ids (32 bits)."""
    for batch in batches:
        for part, frame, names, payload in zip(*batch.columns, strict=True):
            docs = unpack_frames([payload.as_py()])[0]
            n = len(docs)
            yield [names.values, pa.repeat(part, n), pa.repeat(frame, n), pa.array(range(n), pa.int32())], [d.astype("<u4") for d in docs]


def read_frames(frames: DataFrame) -> DataFrame:
    """doc_id, part, frame, place (of the document in its frame), ids (little-endian u32 bytes)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, docs in _read(batches):
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d.tobytes() for d in docs], pa.binary())], names=["doc_id", "part", "frame", "place", "ids"])

    return frames.select("part", "frame", "doc_ids", "payload").mapInArrow(unpack, "doc_id long, part int, frame int, place int, ids binary")


def measured_frames(frames: DataFrame) -> DataFrame:
    """doc_id, part, frame, place, and of the ids read back their number and their crc32."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, docs in _read(batches):
            figures = [pa.array([len(d) for d in docs], pa.int64()), pa.array([zlib.crc32(d) for d in docs], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *figures], names=["doc_id", "part", "frame", "place", "n_tokens", "ids_crc32"])

    return frames.select("part", "frame", "doc_ids", "payload").mapInArrow(measure, "doc_id long, part int, frame int, place int, n_tokens long, ids_crc32 long")


def output_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files read back.

    start counts the ids of all documents before. Offsets come from sums by part, then by
    frame in its part, then by place in its frame; no step sees all documents at once.
    """
    slim = materialize(measured_frames(write_frames(docs, path)), "ids")
    frames = slim.groupBy("part", "frame").agg(F.sum("n_tokens").alias("n"))
    parts = frames.groupBy("part").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), zero)
    parts = parts.select("part", before(Window.orderBy("part")).alias("p0"))
    frames = frames.select("part", "frame", before(Window.partitionBy("part").orderBy("frame")).alias("f0"))
    inside = Window.partitionBy("part", "frame").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("d0", F.coalesce(F.sum("n_tokens").over(inside), zero)).join(frames, ["part", "frame"]).join(F.broadcast(parts), "part")
    return placed.select("doc_id", (F.col("p0") + F.col("f0") + F.col("d0")).alias("start"), "n_tokens", "ids_crc32")
