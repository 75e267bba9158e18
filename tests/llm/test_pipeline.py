from __future__ import annotations

import sys
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
from conftest import SF
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from plain import brute_classes, brute_leaks, plain_score

from millrace.llm import decontaminate, mixing, quality, queries
from millrace.llm.tokens import vocabulary_path


def test_stages_apply_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "leaks", "mix", "token_files"]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    model = quality.train(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    good = [(r.doc_id, r.text) for r in rows if plain_score(model, quality.features(r.text)) >= quality.THRESHOLD]
    firsts = set(brute_classes(good).values())
    left = [(i, t) for i, t in good if i in firsts]
    short = [(i, t) for i, t in left if len(t) < 8000]
    leaking = {i for i, *_ in brute_leaks(short, [(r.item_id, r.text) for r in items.collect()])}
    leaking |= {r.doc_id for r in decontaminate.leaks(docs.where("length(text) >= 8000"), items).collect()}
    clean = [i for i, _ in left if i not in leaking]
    copies = {r.doc_id: r.copies for r in mixing.mix_report(docs.where(docs.doc_id.isin(clean))).collect() if r.copies}
    encode = Tokenizer.from_file(vocabulary_path()).encode
    crc = {i: zlib.crc32(np.array([*encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in left}
    out = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in out) == Counter(copies)
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out) and all(r.ids_crc32 == crc[r.doc_id] for r in out)
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]


def test_every_operator_has_its_query():
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
