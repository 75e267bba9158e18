"""Approximate nearest neighbours by collision-counting hashing (inner product).

Largest inner products become least distances: with M the greatest norm, a candidate v is
(v/M, sqrt(1 - |v|^2/M^2)) and a query q is (q/|q|, 0). Each of PROJECTIONS random lines gives
a sorted array of the candidates' projections. A query looks at the window around its own
projection on every line; a wider search radius widens all windows (virtual rehashing), so
one set of arrays serves every radius. Candidates in enough windows are verified by their
inner product on the original vectors. The search ends at the radius within which it has
found as many neighbours as asked.

Candidates are dealt to shards of a bounded number of rows. A shard's index is built once and
all queries stream past it; where there are few shards or many queries, each has copies (lanes)
that share the queries. The shards' lists are merged by query.

Collisions are counted 64 candidates a word: a window is the difference of two rows of bits, and
the windows of all lines are added by binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize

K = 20
PROJECTIONS = 448
#: Half a window over the radius: a candidate at the radius is in a window with probability 0.838.
HALF_WINDOW = 1.4
#: So many rows of a shard ask it once. The distances of their k-th neighbours, at these shares of
#: the rows, are the radii; beyond the greatest each is so much wider than the one before, up to 2.
SAMPLE, SHARES, WIDER = 48, (0.1, 0.5, 0.75, 0.9, 1.0), 1.08
#: A candidate must be in so many windows as this share of the sample's true neighbours are.
SAMPLE_RECALL = 0.915
#: Window ends are rounded outwards to so many quantiles of a line (of so many rows); at each the candidates
#: before it are one bit each, so that a window is two rows of bits. So many candidates are counted at once.
EDGES, EDGE_ROWS, BLOCK = 31, 8192, 16_384
SHARD_ROWS, LANES = 60_000, 6
#: Where queries are many, groups of a shard and a lane are up to so many, of so many queries at least.
GROUPS, GROUP_QUERIES = 48, 1024


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of numbers whose digits are rows of bits, the lowest first."""
    out, carry = [a[0] ^ b[0]], a[0] & b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        either = x ^ y
        out.append(either ^ carry)
        carry = (x & y) | (either & carry)
    return [*out, carry]


def _count_bits(rows: np.ndarray) -> list[np.ndarray]:
    """How many of the rows have each bit, as rows of binary digits from the lowest; rows are 7 times a power of two."""
    ones, twos = rows.reshape(7, -1, rows.shape[1]), []
    low = ones[0]
    for k in (1, 3, 5):
        either = low ^ ones[k]
        twos.append((low & ones[k]) | (either & ones[k + 1]))
        low = either ^ ones[k + 1]
    either = twos[0] ^ twos[1]
    digits = [low, either ^ twos[2], (twos[0] & twos[1]) | (either & twos[2])]
    while len(digits[0]) > 1:
        half = len(digits[0]) // 2
        digits = _add([d[:half] for d in digits], [d[half:] for d in digits])
    return [d[0] for d in digits]


class Index:
    """Projections of one shard, for searches of ``k`` neighbours."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top_norm: float, k: int = K, seed: int = 11):
        self.ids, self.vectors, self.top_norm, self.k = ids, vectors, top_norm, k
        self.verified = 0  # candidates verified over all searches
        rng = np.random.default_rng(seed)
        lines = rng.standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        self.lines, n = lines[:-1], len(ids)
        some = self._projected(np.sort(rng.choice(n, min(n, EDGE_ROWS), replace=False)), lines)
        inner = np.quantile(some, np.arange(1, EDGES + 1) / (EDGES + 1), axis=1, method="lower").T
        self.edges = np.concatenate([np.full((PROJECTIONS, 1), -np.inf, np.float32), inner, np.full((PROJECTIONS, 1), np.inf, np.float32)], 1)
        self.blocks = []  # of each block, line and edge the candidates before it
        for start in range(0, n, BLOCK):
            projected = self._projected(slice(start, start + BLOCK), lines)
            before = np.zeros((*self.edges.shape, -(-projected.shape[1] // 64) * 8), np.uint8)
            for own, at, edges in zip(before, projected, self.edges, strict=True):
                bits = np.packbits(at < edges[:, None], axis=1, bitorder="little")
                own[:, : bits.shape[1]] = bits
            self.blocks.append(before.view(np.uint64))
        self.radii, self.collisions = (2.0,), 0
        if n > k:
            self._fit(rng)

    def _projected(self, rows: np.ndarray | slice, lines: np.ndarray) -> np.ndarray:
        unit = self.vectors[rows] / self.top_norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit**2).sum(1)))
        return (lines.T @ np.concatenate([unit, rest[:, None]], 1).T).astype(np.float32)

    def _fit(self, rng: np.random.Generator) -> None:
        """Radii and the number of collisions, from the exact neighbours of a bounded sample of rows."""
        asked = rng.choice(len(self.ids), min(SAMPLE, len(self.ids)), replace=False)
        queries, exact = self.vectors[asked], self.vectors[asked] @ self.vectors.T
        exact[np.arange(len(asked)), asked] = -np.inf
        nearest = np.argpartition(-exact, self.k - 1, axis=1)[:, : self.k]
        scores = np.take_along_axis(exact, nearest, 1).min(1) / (np.sqrt((queries**2).sum(1)) * self.top_norm)
        far = np.sqrt(np.maximum(0.0, 2 - 2 * scores)).clip(0.05, 2.0)
        radii: list[float] = []
        for radius in sorted(set(np.quantile(far, SHARES, method="higher").round(3).tolist()), reverse=True):
            if not radii or radius * WIDER <= radii[0]:  # a radius that is hardly less than the next is not worth a pass
                radii.insert(0, radius)
        while radii[-1] < 2.0:
            radii.append(min(2.0, radii[-1] * WIDER))
        self.radii = tuple(radii)
        low, high = self.windows(queries)
        hits = []
        for at, (level, own) in enumerate(zip(np.searchsorted(radii, far.round(3)).tolist(), nearest, strict=True)):
            counts = [sum(self._spread(d).astype(np.int64) << k for k, d in enumerate(self._hits(block, low[at, level], high[at, level]))) for block in self.blocks]
            hits.append(np.concatenate(counts)[own])
        self.collisions = int(np.quantile(np.concatenate(hits), 1 - SAMPLE_RECALL, method="lower"))

    @staticmethod
    def _spread(bits: np.ndarray) -> np.ndarray:
        return np.unpackbits(bits.view(np.uint8), bitorder="little")

    @staticmethod
    def _hits(block: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """In how many windows each candidate of a block is, by binary digits."""
        rows, at = block.reshape(-1, block.shape[2]), np.arange(PROJECTIONS) * block.shape[1]
        inside = rows.take(at + high, 0)
        inside ^= rows.take(at + low, 0)
        return _count_bits(inside)

    def _passing(self, block: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places in the block of the candidates that are in enough windows."""
        enough = np.full(block.shape[2], np.uint64(0xFFFFFFFFFFFFFFFF))
        for k, digit in enumerate(self._hits(block, low, high)):
            enough = digit & enough if self.collisions >> k & 1 else digit | enough
        return np.flatnonzero(self._spread(enough))

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By query, radius and line: the edges at or below the window's beginning and beyond its end."""
        at = ((queries / np.sqrt((queries**2).sum(1))[:, None]) @ self.lines).T[:, :, None]
        steps = HALF_WINDOW * np.array(self.radii)
        low, high = (at - steps).astype(np.float32), (at + steps).astype(np.float32)
        low = np.array([np.searchsorted(e, x, "right") for e, x in zip(self.edges, low, strict=True)]) - 1
        high = np.array([np.searchsorted(e, x, "right") for e, x in zip(self.edges, high, strict=True)])
        return low.transpose(1, 2, 0), high.transpose(1, 2, 0)

    def search_all(self, query_ids: list[int], queries: np.ndarray, at_once: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each query's id, and ids and inner products of the nearest found, best first, ties to the smaller id."""
        for start in range(0, len(query_ids), at_once):
            yield from self._search_some(query_ids[start : start + at_once], queries[start : start + at_once])

    def _search_some(self, query_ids: list[int], queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n, k = len(self.ids), self.k
        norms = np.sqrt((queries**2).sum(1))
        low, high = self.windows(queries)
        verified = self.ids == np.array(query_ids)[:, None]  # a query's own row is no candidate
        best = [(np.zeros(0, self.ids.dtype), np.zeros(0))] * len(query_ids)
        left = list(range(len(query_ids)))
        for level, radius in enumerate((*self.radii, np.inf)):
            passed: list[list[np.ndarray]] = [[] for _ in query_ids]
            for block, start in zip(self.blocks, range(0, n, BLOCK), strict=True):
                for q in left:
                    if np.isinf(radius):  # fewer than k within the last radius: all there are
                        passed[q].append(np.arange(start, min(start + BLOCK, n)))
                    else:
                        passed[q].append(self._passing(block, low[q, level], high[q, level]) + start)
            open_still = []
            for q in left:
                new = np.concatenate(passed[q])
                new = new[new < n]  # the last word of bits goes on
                new = new[~verified[q, new]]
                ids, scores = best[q]
                if len(new):
                    verified[q, new] = True
                    self.verified += len(new)
                    ids, scores = np.concatenate([ids, self.ids[new]]), np.concatenate([scores, self.vectors[new] @ queries[q]])
                    if len(ids) > 4 * k:  # ties with the k-th stay in
                        top = scores >= np.partition(scores, -k)[-k]
                        ids, scores = ids[top], scores[top]
                    order = np.lexsort((ids, -scores))[:k]
                    best[q] = ids, scores = ids[order], scores[order]
                if len(ids) < k or 2 - 2 * scores[-1] / (norms[q] * self.top_norm) > radius**2:
                    open_still.append(q)
            left = open_still
            if not left:
                break
        yield from ((name, *found) for name, found in zip(query_ids, best, strict=True))


def _usable(vectors: DataFrame, name: str) -> DataFrame:
    """vec_id, vector and its length, of rows that take part."""
    v = F.col(name).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(candidates: DataFrame, queries: DataFrame, k: int = K, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest candidates found.

    Score is the inner product in double precision on the original vectors; ties go to the
    smaller vec_id. A query's own vec_id is never its neighbour. Rows with a null id or a
    vector that is null, empty, zero or holds null or non-finite components take no part;
    queries meet candidates of their own number of components only. Of query rows with one id
    the least vector asks. A candidate row that
    comes twice is found twice. Fewer than ``k`` candidates are all returned. Extra columns
    are ignored; empty tables give an empty result.
    """
    found = materialize(_usable(candidates, vector), "vectors")
    asked = _usable(queries, vector).groupBy(F.col("vec_id").alias("id")).agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    size = found.agg(F.count(F.lit(1)), F.coalesce(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), F.lit(1.0))).first()
    shards = -(-size[0] // SHARD_ROWS) or 1
    lanes = max(-(-LANES // shards), min(-(-GROUPS // shards), -(-asked.count() // GROUP_QUERIES)))
    top_norm = float(size[1]) * (1 + 1e-12)
    own, all_of = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = found.select(F.col("vec_id").alias("id"), "v", "dim").withColumn("shard", own(["id"], shards)).withColumn("lane", all_of(lanes)).withColumn("asks", F.lit(0))
    right = asked.select("id", "v", "dim").withColumn("lane", own(["id", F.lit(3)], lanes)).withColumn("shard", all_of(shards)).withColumn("asks", F.lit(1))
    keys = ["dim", "shard", "lane"]  # by a stated number of parts, which are not put together; few hold two groups
    met = left.unionByName(right).repartition(4 * shards * lanes, *keys).sortWithinPartitions(*keys, "asks", "id").select(*keys, "asks", "id", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, candidates before queries; at most one shard is held."""
        group, parts, index = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)], 1)
            ids, out = batch.column(4).to_numpy(zero_copy_only=False), []
            cuts = [0, *(np.nonzero((marks[1:] != marks[:-1]).any(axis=1))[0] + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                *now, asks = marks[a].tolist()
                if now != group:
                    group, parts, index = now, [], None
                vectors = batch.column(5).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if not asks:
                    parts.append((ids[a:b], vectors))
                elif parts:
                    if index is None:
                        index = Index(*map(np.concatenate, zip(*parts, strict=True)), top_norm, k)
                    out += index.search_all(ids[a:b].tolist(), vectors)
            if out:
                names = np.repeat([q for q, _, _ in out], [len(x) for _, x, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate([x for _, x, _ in out]), pa.int64()), pa.array(np.concatenate([x for _, _, x in out]), pa.float64())], names=["query_id", "vec_id", "score"])

    lists = met.mapInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours_report(embeddings: DataFrame) -> DataFrame:
    """The nearest rows of every row whose vec_id is divisible by 20."""
    return nearest(embeddings, embeddings.where("vec_id % 20 = 0"))
