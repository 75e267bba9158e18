from __future__ import annotations

import re
import zlib
from collections import Counter

from conftest import SF
from pyspark.sql import functions as F

from millrace.llm import mixing, sharding, token_counts, token_output
from millrace.llm.tokens import vocabulary_path


def test_permutation_is_one_to_one_and_balanced():
    for n in (1, 2, 3, 5, 7, 50, 64, 65, 1000):
        places = [sharding.locate(i, n) for i in range(n)]
        assert sorted(slot * 8 + shard for shard, slot in places) == list(range(n))


def _check_shards(rows, texts):
    n = len(rows)
    for r in rows:
        data = (r.text or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        assert (r.shard, r.slot) == sharding.locate(r.row_no, n)
    assert sorted(r.row_no for r in rows) == list(range(n))
    sizes = Counter(r.shard for r in rows)
    assert not n or max(sizes.values()) - min([sizes[s] for s in range(8)]) <= 1
    assert sorted(t or "" for t in texts) == sorted(r.text or "" for r in rows)


def test_sharding_matches_the_scalar_form(spark, odd_docs, no_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = docs.select("doc_id", "text").distinct()
        out = sharding.shard(docs)
        rows = out.collect()
        n = len(rows)
        assert n == docs.count()
        for r in rows:
            assert (r.shard, r.slot) == sharding.locate(r.row_no, n)
        by_id = {r.doc_id: r.text for r in texts.where("doc_id is not null").collect()}
        for r in rows:
            if r.doc_id is not None:
                data = (by_id[r.doc_id] or "").encode()
                assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert sorted(r.row_no for r in rows) == list(range(n))
        ordered = [r.doc_id for r in sorted(rows, key=lambda r: r.row_no) if r.doc_id is not None]
        assert ordered == sorted(ordered)
    assert sharding.shard_report(no_docs).count() == 0
    assert sharding.shard_report(odd_docs).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_long_walks_are_followed_to_their_end(spark):
    # With few steps in an expression, further expressions take over.
    for n in (2, 3, 5, 11, 50, 200):
        assert sharding._further_walks(n, 17, 1) >= sharding._further_walks(n, 17, 64) == 0
    docs = spark.range(137).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = sharding.shard(docs, walk=1).collect()
    assert [(r.shard, r.slot) for r in rows] == [sharding.locate(r.row_no, 137) for r in rows]
    steps = [sharding._further_walks(n, 17, 1) for n in range(2, 300)]
    assert max(steps) > 0


def test_equal_rows_are_numbered_over_several_ranges(spark):
    from millrace.llm.common import with_row_numbers

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    rows = spark.range(4000, numPartitions=4).selectExpr("cast(null as long) as doc_id", "'same' as text")
    numbered, n = with_row_numbers(rows, [F.col("doc_id"), F.col("text")])
    got = numbered.withColumn("at", F.spark_partition_id()).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r.row_no for r in got) == list(range(4000)) and n == 4000 and numbered.columns == ["doc_id", "text", "row_no"]
    assert len(Counter(r["at"] for r in got)) > 1


def test_sharding_reruns_agree(spark, odd_docs):
    runs = [sorted(sharding.shard(odd_docs.repartition(k)).collect(), key=lambda r: r.row_no) for k in (1, 5)]
    assert [tuple(r)[:3] + tuple(r)[4:] for r in runs[0]] == [tuple(r)[:3] + tuple(r)[4:] for r in runs[1]]


def _targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [k for k in names if k not in capped]
        rest = total - sum(3 * sizes[k] for k in capped)
        level = rest / sum(weight[k] for k in free) if free else 0
        over = {k for k in free if weight[k] * level >= 3 * sizes[k]}
        if not over:
            return {k: 3 * sizes[k] if k in capped else weight[k] * level for k in names}
        capped |= over


def test_mix_hits_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = docs.select("doc_id", "text", "source").collect()
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in plain}
    of = {r.doc_id: r.source for r in plain}
    per = Counter()
    for i, s in of.items():
        per[s] += sizes[i]
    want = _targets(per)
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == len(plain)
    taken = Counter()
    for r in rows:
        assert r["size"] == sizes[r.doc_id] and r.source_size == per[of[r.doc_id]]
        assert abs(r.target - want[of[r.doc_id]]) < 1e-6 * want[of[r.doc_id]] + 1e-9
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[of[r.doc_id]] += r.taken
    for s, t in want.items():
        largest = max(sizes[i] for i in of if of[i] == s)
        assert abs(taken[s] - t) <= largest, s
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_report(docs).collect()))


def test_pair_moves_keep_words():
    for k in range(20):
        p, q = mixing._move(k / 20, 70, 0.4, 30, 0.7)
        assert abs(70 * p + 30 * q - 49) < 1e-9
        assert p in (0.0, 1.0) or q in (0.0, 1.0)
        assert -1e-12 <= min(p, q) and max(p, q) <= 1 + 1e-12


def test_mix_is_the_same_however_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0")).unionByName(docs.where("doc_id = 14"))
    of = lambda d: sorted(map(tuple, mixing.mix_report(d).collect()))
    assert of(docs.coalesce(1)) == of(docs.repartition(7)) == of(docs.repartition(3, "source"))


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = mixing.mix_report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix_report(no_docs).count() == 0
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r.copies for r in rows)


def test_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    rows = mixing.mix_report(docs).collect()
    taken, target = Counter(), {}
    src = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        taken[src[r.doc_id]] += r.taken
        target[src[r.doc_id]] = (r.target, max(target.get(src[r.doc_id], (0, 0))[1], r["size"]))
    assert len(rows) == docs.count()
    assert all(abs(taken[s] - t) <= big for s, (t, big) in target.items())


def test_length_histogram(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path())
    odd_docs = odd_docs.unionByName(odd_docs.limit(1).selectExpr("*").withColumn("text", F.lit("x<|endoftext|>y  z\n\nq")))
    texts = [r.text for r in odd_docs.select("text").collect()]
    lengths = sorted(len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert sorted(r.n_tokens - 1 for r in token_output.output_report(odd_docs).collect()) == lengths
    hist = token_counts.length_histogram(token_counts.lengths(odd_docs))
    rows = {r.limit_tokens: r for r in hist.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for limit, r in rows.items():
        assert r.n_docs == lengths.count(limit)
        assert r.docs_within == sum(x <= limit for x in lengths) and r.docs_over == sum(x > limit for x in lengths)
        assert r.tokens_within == sum(x for x in lengths if x <= limit) and r.total_tokens == sum(lengths)
        assert r.truncated_total == sum(min(x, limit) for x in lengths)
    for limit in (0, 3, 100, 5000, 10**6):
        a = token_counts.answer(hist, limit).first()
        assert (a.truncated_total, a.docs_over) == (sum(min(x, limit) for x in lengths), sum(x > limit for x in lengths))
    assert token_counts.quantile(hist, 0.5) == lengths[(len(lengths) - 1) // 2]
    assert token_counts.length_histogram(token_counts.lengths(no_docs)).count() == 0


def test_large_ids_beside_nulls_stay_exact(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "a b c", "s"), (None, "d e", "s"), (big + 2, "f", "t")], "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.mix_report(docs).collect()} == {big, None, big + 2}


def test_counts_equal_encoded_lengths():
    from millrace.llm.tokens import CachedEncoder, vocabulary_path

    own = CachedEncoder(vocabulary_path(), entries=5)
    texts = ["", "one two", "don't  stop", "\n\nNext", "é" * 60, "x" * 200 + " y", " \u03bcg", "one two one", "<|endoftext|> z"]
    for _ in range(3):
        assert own.count_many(texts) == [len(x) // 4 for x in own.encode_many(texts)] == [len(own.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
