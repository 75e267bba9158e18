"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check.

A text is the set of its five-word shingles, each weighing what it occurs (``weighted_signatures``
takes any weights). Darts fall on an element's (weight x rank) plane as a Poisson process,
class of weights by class and slab of ranks by slab, drawn by hashing the element and the region alone, so equal
elements get equal darts in every document; a document has those below its own weight. Each dart has a coordinate; the dart of least rank in a coordinate is the
signature's value there. A document throws just enough ranks to fill all coordinates, so a
long text costs little more than reading it. Two signatures agree in a coordinate with the
probability of the texts' weighted Jaccard similarity.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, slices

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 256
BANDS, ROWS = 36, 6
#: Pairs whose signatures agree in a smaller share of the coordinates get no exact check. It is
#: ten standard errors below 0.8: a pair of that similarity is under it once in 10**17 cases.
HOPELESS = 0.55
#: Members of a bucket, and bytes of their texts, that one task compares with as many others.
BLOCK, BLOCK_BYTES = 500, 1 << 20
#: Keys of at most so many texts (some 50 bytes each) are broadcast to pick rows.
BROADCAST_KEYS = 500_000
#: Signatures that a task keeps to sign further copies of a text without reading it again.
KEPT_SIGNATURES = 20_000
#: A character that Python's split() keeps in a word; Java's own classes know fewer kinds of white space.
_IN_WORD = r"[^\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_U = np.uint64
#: Classes of weights: one by one up to 8, then doubling.
_WEIGHTS = [*[(float(i), float(i + 1)) for i in range(8)], *[(2.0**i, 2.0 ** (i + 1)) for i in range(3, 40)]]
_SLABS = [*[(float(i), float(i + 1)) for i in range(8)], *[(2.0**i, 2.0 ** (i + 1)) for i in range(3, 40)]]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@functools.lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in a strip of this area."""
    top = int(mean + 12 * mean**0.5 + 12)
    logs = np.arange(1, top + 1)
    return np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(mean / logs))]) - mean))


class _Words(dict):
    """Hashes of words, bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def _shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every shingle occurrence, ordered by text.

    Words are what white space separates, in lower case. A text of fewer words than a shingle
    is one shingle; a text without words has none.
    """
    get = _words.__getitem__
    rows = [(t or "").lower().split() for t in texts]
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.fromiter(map(get, chain.from_iterable(rows)), np.uint64, int(sizes.sum()))
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows)), counts)
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    last = np.minimum(first + SHINGLE, np.repeat(starts + sizes, counts))
    value = np.zeros(len(owner), _U)
    padded = np.concatenate([flat, np.zeros(SHINGLE, _U)])
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            value = _mix(value + _U(0x9E3779B97F4A7C15)) + np.where(first + k < last, padded[first + k], _U(0))
        value = _mix(value)
    return owner, value


def elements(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, element hash), ordered by text: the n-th occurrence of a shingle in a text is element (shingle, n)."""
    owner, value = _shingles(texts)
    with np.errstate(over="ignore"):
        order = np.lexsort((value, owner))
        o, v = owner[order], value[order]
        new = np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])]) if len(o) else np.zeros(0, bool)
        at = np.nonzero(new)[0]
        nth = np.arange(len(o)) - np.repeat(at, np.diff(np.append(at, len(o))))
        v = np.where(nth > 0, _mix(v + nth.astype(_U) * _U(0x9E3779B97F4A7C15)), v)
    return o, v


def _classes(owner: np.ndarray, value: np.ndarray, weight: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(width, text, region, weight in it) of every class of weights that elements reach; None where all fill theirs.

    The class from n to n + 1 of an element is hashed as its n-th repetition is by ``elements``.
    """
    for n, (low, high) in enumerate(_WEIGHTS):
        live = weight > low
        if not live.any():
            return
        own = np.minimum(weight[live] - low, high - low)
        with np.errstate(over="ignore"):
            region = _mix(value[live] + _U(n * 0x9E3779B97F4A7C15 % 2**64)) if n else value[live]
        yield high - low, owner[live], region, None if (own == high - low).all() else own


def _throw(owner: np.ndarray, region: np.ndarray, width: float, own: np.ndarray | None, reach: np.ndarray, out: np.ndarray, k: int) -> None:
    """Throw the darts of one class of weights below ``reach`` (by text) and keep the earliest of each coordinate in ``out``."""
    for slab, (low, high) in enumerate(_SLABS):
        live = reach[owner] > low
        if not live.any():
            return
        o, v, part = owner[live], region[live], None if own is None else own[live]
        with np.errstate(over="ignore"):
            seed = _mix(v + _U((slab + 1) * 0x632BE59BD9B4E019 % 2**64))
        n = np.searchsorted(_poisson((high - low) * width), (seed >> _U(11)).astype(np.float64) * 2.0**-53, side="right")
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(np.arange(len(o)), n)
        nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        with np.errstate(over="ignore"):
            dart = _mix(seed[at] + (nth + 1).astype(_U) * _U(0xA0761D6478BD642F))
        rank = low + (dart >> _U(24)).astype(np.float64) * 2.0**-40 * (high - low)
        keep = rank < reach[o[at]]
        if part is not None:  # darts above the element's weight belong to heavier ones only
            with np.errstate(over="ignore"):
                height = (_mix(dart ^ _U(0x3C79AC492BA7B653)) >> _U(11)).astype(np.float64) * 2.0**-53 * width
            keep &= height < part[at]
        dart, rank, o = dart[keep], rank[keep], o[at[keep]]
        with np.errstate(over="ignore"):
            more = _mix(dart ^ _U(0x8EBC6AF09C88C6E3))
        packed = (rank.view(_U) & ~_U(0xFFFF)) | (more >> _U(48))
        np.minimum.at(out, o * k + (more & _U(0xFFFFFFFF)).astype(np.int64) % k, packed)


def weighted_signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """16-bit signature values of n sets of weighted elements: (set, hash, weight over 0), each element once a set.

    Two rows agree in a coordinate with the probability of the sets' weighted Jaccard similarity, the sum of the lesser
    over that of the greater weights. Weights may be counts, inverse document frequencies or any other up to 2**39.
    Sets without elements get zeros.
    """
    sums = np.bincount(owner, weights=weight, minlength=n)
    empty = np.iinfo(np.uint64).max
    out = np.full(n * k, empty, _U)
    reach = np.divide(k * (np.log(k) + 2), sums, out=np.zeros(n), where=sums > 0)
    while len(owner):
        for width, o, region, own in _classes(owner, value, weight):
            _throw(o, region, width, own, reach, out, k)
        short = (out.reshape(-1, k) == empty).any(axis=1) & (sums > 0)
        if not short.any():
            break
        reach = np.where(short, reach * 1.5, 0.0)
        still = short[owner]
        owner, value, weight = owner[still], value[still], weight[still]
    out[out == empty] = 0
    return (out & _U(0xFFFF)).astype(np.uint16).reshape(-1, k)


def weighted_jaccard(one: dict[int, float], other: dict[int, float]) -> float:
    """Sum of the lesser over the sum of the greater weights of all elements; 0 without any."""
    keys = one.keys() | other.keys()
    most = sum(max(one.get(x, 0.0), other.get(x, 0.0)) for x in keys)
    return sum(min(one.get(x, 0.0), other.get(x, 0.0)) for x in keys) / most if most else 0.0


def _signatures(texts: list[str | None], k: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and numbers of elements."""
    owner, shingle = _shingles(texts)
    if not len(owner):
        return np.zeros((len(texts), k), np.uint16), np.zeros(len(texts), np.int64)
    order = np.lexsort((shingle, owner))
    o, v = owner[order], shingle[order]
    at = np.nonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])]))[0]
    return weighted_signatures(o[at], v[at], np.diff(np.append(at, len(o))).astype(np.float64), len(texts), k), np.bincount(owner, minlength=len(texts))


def signatures(texts: list[str | None], k: int = COORDINATES) -> np.ndarray:
    """16-bit signature values, one row for each text. Texts without words get zeros."""
    return _signatures(texts, k)[0]


def _overlap(one: np.ndarray, other: np.ndarray) -> float:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (len(one) + len(other) - both) if len(one) + len(other) else 0.0


def jaccard(one: str | None, other: str | None) -> float:
    """Exact weighted Jaccard similarity of two texts' shingles."""
    owner, value = elements([one, other])
    return _overlap(value[owner == 0], value[owner == 1])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("text_hash"), text.rlike(_IN_WORD).alias("has_words"))


def _signed(docs: DataFrame) -> DataFrame:
    """One row for each distinct text with words.

    node (a number for the text), text_hash, first_id (its least doc_id), copies (its rows),
    signature, weight (its number of elements) and size (its bytes). Copies that meet in a task
    are signed once.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple[bytes, int]] = {}
        for batch in batches:
            for part in slices(batch, 2):
                hashes = part.column(1).to_pylist()
                new = [i for i, h in enumerate(hashes) if h not in kept]
                first = {hashes[i]: i for i in reversed(new)}
                texts = part.column(2).take(pa.array(first.values(), pa.int32())).to_pylist()
                made, weights = _signatures(texts)
                own = {h: (row.tobytes(), int(w)) for h, row, w in zip(first, made, weights, strict=True)}
                known = [own.get(h) or kept[h] for h in hashes]
                if len(kept) > KEPT_SIGNATURES:
                    kept.clear()
                kept.update(own)
                signs, weights = (list(x) for x in zip(*known, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(signs, pa.binary()), pa.array(weights, pa.int64()), part.column(3)], names=["doc_id", "text_hash", "signature", "weight", "size"])
        _words.clear()  # the worker goes on to other stages

    keyed = _keyed(docs).where("has_words").select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", "text", F.octet_length("text").cast("long").alias("size"))
    signed = materialize(keyed.mapInArrow(sign, "doc_id long, text_hash binary, signature binary, weight long, size long"), "signatures")
    firsts = [F.first(c).alias(c) for c in ("signature", "weight", "size")]
    nodes = signed.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), *firsts)
    return materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _agreement(one: pd.Series, other: pd.Series) -> pd.Series:
    if not len(one):
        return pd.Series([], dtype="float64")
    a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(len(one), -1) for x in (one, other))
    return pd.Series((a == b).mean(axis=1))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose texts are similar by the exact measure."""
    agree = F.pandas_udf(_agreement, "double")
    side = nodes.select("node", "signature", "weight")
    judged = pairs.join(side.withColumnsRenamed({"node": "a", "signature": "sa", "weight": "wa"}), "a").join(side.withColumnsRenamed({"node": "b", "signature": "sb", "weight": "wb"}), "b")
    judged = judged.where(F.least("wa", "wb") >= F.lit(SIMILARITY) * F.greatest("wa", "wb"))
    judged = materialize(judged.select("a", "b", agree("sa", "sb").alias("share")).where(F.col("share") >= HOPELESS).select("a", "b"), "judged")
    texts = _texts(docs, nodes, judged.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, _U)
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if a != last:
                    last, own = a, elements([x.as_py()])[1]
                keep.append(_overlap(own, elements([y.as_py()])[1]) >= SIMILARITY)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        _words.clear()

    read = judged.join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a")
    return materialize(read.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "links")


def _cross_links(table: pa.Table) -> pa.Table:
    """Links between classes within one block of a bucket, or across two of its blocks.

    Each member of side p is compared with all of side q at once: the places of its elements
    in the others give its exact overlap with each. Classes that a link has joined are one from
    then on, so links number less than members.
    """
    ids, classes, on_p, on_q = (np.array(table.column(c).to_pylist()) for c in ("b", "class", "on_p", "on_q"))
    _, classes = np.unique(classes, return_inverse=True)
    todo, n, out = np.nonzero(on_p)[0].tolist(), len(ids), []
    texts, made = table.column("text"), []
    for at in range(0, n, 64):  # words of few texts at once are held as such
        owner, value = elements(texts.slice(at, 64).to_pylist())
        made.append((owner + at, value))
    owner, value = map(np.concatenate, zip(*made, strict=True))
    weight = np.bincount(owner, minlength=n)
    first = np.cumsum(weight) - weight
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    run = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    start = np.append(np.nonzero(np.concatenate([[True], value[1:] != value[:-1]]))[0], len(value)) if len(value) else np.zeros(1, np.int64)
    of = np.empty(len(value), np.int64)  # by element of a text, the run of texts that hold it
    of[order] = run
    for i in todo:
        runs = of[first[i] : first[i] + weight[i]]
        sizes = start[runs + 1] - start[runs]
        at = np.arange(int(sizes.sum())) + np.repeat(start[runs] - (np.cumsum(sizes) - sizes), sizes)
        both = np.bincount(owner[at], minlength=n)
        near = (both / (weight + weight[i] - both) >= SIMILARITY) & (classes != classes[i]) & on_q
        for j in np.nonzero(near)[0].tolist():
            if classes[i] != classes[j]:
                out.append((int(ids[i]), int(ids[j])))
                classes[classes == classes[j]] = classes[i]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _texts(docs: DataFrame, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, text) of the nodes in ``needed``."""
    keys = materialize(nodes.join(needed, "node", "left_semi").select("node", "text_hash"), "needed")
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    found = _keyed(docs).where("has_words").select("text_hash", "text").join(side, "text_hash")
    return materialize(found.groupBy("node").agg(F.first("text").alias("text")), "texts")


def _sides(placed: DataFrame) -> DataFrame:
    """(bucket, p, q, b, class, on_p, on_q): what is to be compared of buckets (bucket, b, size, class) of several classes.

    A bucket's largest class and its other members are dealt to blocks. Every block p of the
    others meets itself, the blocks q of the others after it, and all blocks (q below 0) of the
    largest class, whose members are alike and do not meet each other.
    """
    counts = placed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    by = counts.groupBy("bucket").agg(F.max(F.struct("n", "bytes", "class")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    by = by.select("bucket", F.col("top.class").alias("largest"), blocks(F.col("top.n"), F.col("top.bytes")).alias("large"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("others"))
    dealt = placed.join(materialize(by, "mixed"), "bucket")
    own = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    pair = lambda p, q, on_p, on_q: F.struct(p.alias("p"), q.alias("q"), F.lit(on_p).alias("on_p"), F.lit(on_q).alias("on_q"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = own("others")
    among = F.transform(upto("others"), lambda x: F.when(x < block, pair(x, block, False, True)).when(x > block, pair(block, x, True, False)).otherwise(pair(block, block, True, True)))
    beyond = F.transform(upto("large"), lambda x: pair(block, -1 - x, True, False))
    largest = F.transform(upto("others"), lambda x: pair(x, -1 - own("large"), False, True))
    met = F.when(F.col("class") == F.col("largest"), largest).otherwise(F.concat(among, beyond))
    return materialize(dealt.select("bucket", "b", "class", F.explode(met).alias("x")).select("bucket", "b", "class", "x.*"), "rest")


def linked(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of every node that is similar to another: its class's least node.

    Nodes that share a band are a bucket. First, every member is compared with the bucket's
    hub, its least node: as many pairs as members. Links join nodes to classes, and a bucket
    of one class is done. Then the members of every bucket left are compared across classes,
    in blocks that hold their texts, and only links come out. So each pair of
    different classes that shares a band is judged, and no bucket is too large. What a bucket
    is joined with is written first, so that adaptive execution can split a large bucket.
    """
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.call_function("substring", F.col("signature"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    rows = nodes.select(F.col("node").alias("b"), "size", F.explode(band).alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("b").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = materialize(hubs.select("bucket", "first"), "hubs")
    members = materialize(rows.join(hubs, "bucket"), "members")
    near = _verified(members.where("b <> first").select(F.col("first").alias("a"), "b").distinct(), nodes, docs)
    roots = components(near)
    placed = members.join(roots, members["b"] == roots["node"], "left").select("bucket", "b", "size", F.coalesce("root", "b").alias("class"))
    rest = _sides(materialize(placed, "placed"))
    texts = _texts(docs, nodes, rest.select(F.col("b").alias("node")).distinct())
    across = rest.join(texts.withColumnRenamed("node", "b"), "b").groupBy("bucket", "p", "q").applyInArrow(_cross_links, "a long, b long")
    return components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(across))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge but the roots: its component's least node.

    Large and small stars in turn: every node's greater neighbours move to its least one, then
    the lesser ones do. Edges never grow in number, and a few rounds suffice for any shape.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        lower = edges.select(F.col("a").alias("_low")).join(edges.select(F.col("b").alias("_low")), "_low", "left_semi")
        n, targets = edges.agg(F.count(F.lit(1)), F.count_distinct("b")).first()
        if n == targets and lower.isEmpty():  # every node hangs on one root
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # so that a hub's edges can be split
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = materialize(moved.where("a <> b").distinct(), "edges")


def _placed(docs: DataFrame) -> DataFrame:
    """text_hash, first_id, copies and class (a node number) of every distinct text with words."""
    nodes = _signed(docs)
    roots = linked(nodes, docs)
    member = nodes.select("node", "text_hash", "first_id", "copies").join(roots, "node", "left")
    return materialize(member.select("text_hash", "first_id", "copies", F.coalesce("root", "node").alias("class")), "classes")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size (in rows) of every document.

    A class holds the documents that links of similarity SIMILARITY or more connect; class_id
    is its least doc_id. Equal texts are always one class. Null and empty texts and texts of
    white space are classes of their own (class_id = doc_id, class_size = 1), as they have no
    shingles. What is linked are texts: repeated rows come back as often as they came in, and
    two texts under one doc_id have a class each; a document without id takes part and has
    its class's least id, null if there is none. Extra columns are ignored; an empty table
    gives an empty result.
    """
    placed = _placed(docs)
    sizes = materialize(placed.groupBy("class").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size")), "sizes")
    named = materialize(placed.join(sizes, "class").select(F.col("text_hash").alias("_hash"), "class_id", "class_size"), "named")
    slim = _keyed(docs).select("doc_id", "text_hash", "has_words")
    found = slim.join(named, F.col("has_words") & (slim["text_hash"] == named["_hash"]), "left")
    alone = ~F.col("has_words")
    return found.select("doc_id", F.when(alone, F.col("doc_id").cast("long")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, the one of least doc_id, with its columns unchanged.

    Documents without words stay. A row is told by its doc_id and text, so that two texts of
    one doc_id are two documents; of rows that repeat both one stays.
    """
    least = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "text_hash")).alias("x")
    kept = _placed(docs).groupBy("class").agg(least)
    kept = materialize(kept.select(F.col("x.first_id").alias("_kept_id"), F.col("x.text_hash").alias("_kept_hash")), "kept")
    side = F.broadcast(kept) if kept.count() <= BROADCAST_KEYS else kept
    text = F.coalesce(F.col("text"), F.lit(""))
    wordy = text.rlike(_IN_WORD)
    keyed = docs.where(wordy).withColumn("_near_hash", F.unhex(F.md5(text)))
    same = (F.col("_near_hash") == F.col("_kept_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id"))
    firsts = keyed.join(side, same, "left_semi")
    again = keyed.groupBy("doc_id", "_near_hash").count().where("count > 1").select(F.col("_near_hash").alias("_again")).distinct()
    again = materialize(again, "again")
    if not again.isEmpty():
        repeats = F.col("_near_hash") == F.col("_again")
        firsts = firsts.join(again, repeats, "left_anti").unionByName(firsts.join(again, repeats, "left_semi").dropDuplicates(["_near_hash"]))
    return firsts.select(*docs.columns).unionByName(docs.where(~wordy))
