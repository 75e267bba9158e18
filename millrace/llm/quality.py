"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn and fits a shallow tree to the current
residuals of one feature's bins; the trees of a feature add up to one lookup table. The
pairs whose joint bins explain most of what is left get two-dimensional tables the same
way. A text is scored by adding one table entry for each feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled rows a model is fitted on (drawn by hash of doc_id).
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "lines_per_word", "upper_share", "digit_share", "space_share", "stop_share",
    "bar_share", "sign_share", "exclaim_share", "quote_share", "other_punct_share", "high_share", "control_share",
    "distinct_share", "repeat_share", "distinct_line_share", "top_word_share",
)
_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _BAR, _SIGN, _EXCLAIM, _QUOTE, _OTHER, _HIGH, _CONTROL = range(12)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[:32] = _CONTROL
    kinds[128:] = _HIGH
    for kind, members in ((_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_LOWER, "abcdefghijklmnopqrstuvwxyz"), (_DIGIT, "0123456789"), (_SPACE, " \t\n\r"), (_STOP, ".,;:"), (_BAR, "|"), (_SIGN, "#$%&*@^~"), (_EXCLAIM, "!?"), (_QUOTE, "'\"()")):
        kinds[[ord(c) for c in members]] = kind
    return kinds


_KINDS = _byte_kinds()


def features(text: str | None) -> list[float]:
    """The features of one whole text; a null or empty text has all of them 0."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not data.size:
        return [0.0] * len(FEATURES)
    words, lines = text.split(), text.split("\n")
    n, w = data.size, max(1, len(words))
    k = np.bincount(_KINDS[data], minlength=12) / n
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    repeats = sum(map(eq, words, words[1:]))
    top = max(counts.values(), default=0)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), n / w, len(lines) / w, k[_UPPER], k[_DIGIT], k[_SPACE], k[_STOP],
        k[_BAR], k[_SIGN], k[_EXCLAIM], k[_QUOTE], k[_OTHER], k[_HIGH], k[_CONTROL],
        len(counts) / w, repeats / w, len(set(lines)) / len(lines), top / w,
    ]


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for f in {f for p in self.pairs for f in p}}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between quantiles, and one just above the smallest value, where shares pile up."""
    cuts = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    return np.unique(np.append(cuts, np.nextafter(column.min(), np.inf)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """Newton values of the best tree of so many leaves over ordered bins, split greedily."""
    g, h = np.concatenate([[0.0], np.cumsum(grad)]), np.concatenate([[0.0], np.cumsum(hess)])
    worth = lambda i, j: (g[j] - g[i]) ** 2 / (h[j] - h[i] + ridge)
    parts = [(0, len(grad))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for i, j in parts:
            if j - i > 1:
                m = np.arange(i + 1, j)
                gain = worth(i, m) + worth(m, j) - worth(i, j)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (i, j), int(m[at]))
        if best[1] is None:
            break
        i, j = best[1]
        parts.remove((i, j))
        parts += [(i, best[2]), (best[2], j)]
    out = np.zeros(len(grad))
    for i, j in parts:
        out[i:j] = (g[j] - g[i]) / (h[j] - h[i] + ridge)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of the first bins, then of the second bins on each side: gain and values."""
    best: tuple[float, np.ndarray | None] = (0.0, None)
    rows_g, rows_h = np.cumsum(grad, 0), np.cumsum(hess, 0)
    for cut in range(1, len(grad)):
        gain, out = 0.0, np.zeros_like(grad)
        for at, g, h in ((slice(0, cut), rows_g[cut - 1], rows_h[cut - 1]), (slice(cut, None), rows_g[-1] - rows_g[cut - 1], rows_h[-1] - rows_h[cut - 1])):
            values = _tree(g, h, 2, ridge)
            gain += float((values * g).sum())
            out[at] = values
        if gain > best[0]:
            best = (gain, out)
    return best if best[1] is not None else (0.0, np.zeros_like(grad))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, pair_rounds: int = 20, n_pairs: int = 6, rate: float = 0.15) -> Model:
    """Fit the lookup tables. Without rows the model is the constant 1/2; with one label only, near that label."""
    width = len(FEATURES) if not len(x) else x.shape[1]
    if not len(x):
        return Model(0.0, [np.array([])] * width, [np.zeros(1)] * width, [], [np.array([])] * width, [])
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges, coarse = [_edges(x[:, f], 32) for f in range(width)], [_edges(x[:, f], 8) for f in range(width)]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            grad, hess = slopes()
            size = len(tables[f])
            step = rate * _tree(np.bincount(bins[f], grad, size), np.bincount(bins[f], hess, size), 3)
            tables[f] += step
            total += step[bins[f]]
    wide = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        flat = wide[a] * shape[1] + wide[b]
        grad, hess = slopes()
        return np.bincount(flat, grad, shape[0] * shape[1]).reshape(shape), np.bincount(flat, hess, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(range(width), 2), key=lambda p: -_pair_tree(*grid(*p))[0])[:n_pairs]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in ranked]
    for _ in range(pair_rounds):
        for (a, b), table in zip(ranked, pair_tables, strict=True):
            step = rate * _pair_tree(*grid(a, b))[1]
            table += step
            total += step[wide[a], wide[b]]
    return Model(base, edges, tables, ranked, coarse, pair_tables)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, quality) of the labelled rows of at most ``limit`` doc_ids outside the held-out fifth.

    Null labels do not count; a document labelled more than once takes its lowest label.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality")


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> Model:
    """Features of the drawn rows are made on the executors; the driver gets ``limit`` rows of numbers at most.

    Of rows that repeat a doc_id the one with the least features counts.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(pa.float64())), batch.column("quality").cast(pa.int32())], names=["doc_id", "x", "y"])

    rows = training_rows(docs, labels, limit).mapInArrow(measured, "doc_id long, x array<double>, y int")
    got = rows.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).select("x", "y").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    got = got.assign(key=got["x"].map(tuple)).sort_values(["key", "y"])  # the order of rows must not matter
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """Columns ``carried`` of every document, and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kB, whatever the data

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.as_py()) for t in batch.column("_text")])
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sent.value.score(x))], names=[*carried, "score"])

    taken = docs.select(F.col("text").alias("_text"), *carried)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[1:]]
    return taken.mapInArrow(scored, ", ".join([*kinds, "score double"]))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, repeated ones included.

    Empty and null texts are scored by their zero features; a null doc_id is never held out.
    An empty table gives an empty result; without labels every score is 1/2. Only the text
    enters a score. Extra columns are ignored.
    """
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents the classifier does not reject, with their columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.as_py()) for t in batch.column(at)])
                yield batch.filter(pa.array(sent.value.score(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
