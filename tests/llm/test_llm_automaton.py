from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_backoff import Plain, corpus, tokens

from millrace.llm import automaton as A
from millrace.llm import backoff

DOCS = [*corpus(random.Random(6)), (100, None), (101, ""), (102, "\x00x\x00 unseen the of the of the"), (None, "the cat"), (7, "the of cat " * 3000), (103, "one")]


@pytest.mark.parametrize(("block_tokens", "bucket_keys", "piece"), [(1 << 22, 3 << 19, 8 << 20), (300, 200, 500), (1, 7, 1)])
def test_walk_equals_the_plain_model(spark, monkeypatch, block_tokens, bucket_keys, piece):
    """Whatever the blocks and buckets, the scores are those of a model walked token by token."""
    for name, value in (("BLOCK_TOKENS", block_tokens), ("BUCKET_KEYS", bucket_keys), ("_PIECE", piece)):
        monkeypatch.setattr(A, name, value)
    frame = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in A.learn_and_score(frame, F.col("doc_id") % 5 != 1).collect()), key=repr)
    plain = Plain([t for i, t in DOCS if i is not None and i % 5 != 1], 0)
    want = sorted(((i, len(tokens(t)), sum(plain.c[w] > 0 for w in tokens(t)), plain.n, sum(math.log10(plain.base(w)) for w in tokens(t)), plain.score(t)) for i, t in DOCS), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_same_scores_as_the_stored_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    model, table = backoff.learn(docs.where(training))
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    one = {r.doc_id: r for r in backoff.score(docs, model, table).select(*columns).collect()}
    for r in A.learn_and_score(docs, training).collect():
        e = one[r.doc_id]
        assert tuple(r)[:4] == tuple(e)[:4] and tuple(r)[4:] == pytest.approx(tuple(e)[4:], rel=1e-9)


def test_numbers_survive_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 9, 1000):
        keys = np.sort(rng.integers(0, 2**64 - 1, n, np.uint64, endpoint=True))
        assert np.array_equal(A.unpack_sorted(A.pack_sorted(keys), n), keys)
        small = rng.integers(0, 300, n).astype(np.uint32)
        assert np.array_equal(A.unpack(A.pack(small), n, np.uint32), small) and len(A.pack(small)) < 2 * n + 40
        found = list(A.spans(keys, 7))
        assert [b for b, _ in found] == sorted({b for b, _ in found}) and sum(p.stop - p.start for _, p in found) == n


def test_odd_rows(odd, none):
    got = A.learn_and_score(odd, F.col("lang") == "en").collect()
    assert len(got) == odd.count() and all(r.score < 0 and r.n_tokens > 0 for r in got)
    assert A.learn_and_score(none, F.lit(True)).count() == 0
    nothing = A.learn_and_score(odd.select("doc_id", "text", F.lit(1).alias("block"), F.lit(2).alias("keys")), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in nothing} == {(0, 0, 0.0)}
