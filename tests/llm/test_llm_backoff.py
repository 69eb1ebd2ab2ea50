from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import backoff as B

LOW = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), "<END>"]


class Plain:
    """The model by its formulas, walked one token at a time."""

    def __init__(self, texts, share):
        seqs = [tokens(t) for t in texts]
        self.c = Counter(w for s in seqs for w in s)
        self.n = sum(self.c.values())
        self.z = self.n + 0.5 * (len(self.c) + 1)
        least = max(2, share * self.n)
        self.strong = {w for w, k in self.c.items() if k >= least}
        self.two = {k: v for k, v in Counter(p for s in seqs for p in zip(s, s[1:], strict=False)).items() if v >= least}
        self.three = {k: v for k, v in Counter(p for s in seqs for p in zip(s, s[1:], s[2:], strict=False)).items() if v >= least}
        self.left2, self.left3 = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
        for (a, _), v in self.two.items():
            self.left2[a] -= (v - 0.75) / self.c[a]
        for (a, b, _), v in self.three.items():
            self.left3[a, b] -= (v - 0.75) / self.two[a, b]

    def base(self, w):
        return (self.c[w] + 0.5) / self.z

    def p(self, history, w):
        if len(history) == 2:
            if history not in self.two:
                return self.p(history[1:], w)
            return max(self.three.get((*history, w), 0.75) - 0.75, 0) / self.two[history] + self.left3[history] * self.p(history[1:], w)
        if not history or history[0] not in self.strong:
            return self.base(w)
        return max(self.two.get((*history, w), 0.75) - 0.75, 0) / self.c[history[0]] + self.left2[history[0]] * self.base(w)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t))


def corpus(rng):
    word = lambda: rng.choice(["the", "of", "Cat", "dog", "|", "né", "a.b", f"r{rng.randint(0, 300)}"])
    return [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(80)]


@pytest.mark.parametrize(("token_share", "ngram_share"), [(2.0**-20, 2.0**-17), (0.02, 0.02), (0.001, 0.01)])
def test_against_plain_model(spark, token_share, ngram_share):
    docs = [*corpus(random.Random(6)), (100, None), (101, ""), (102, "\x00x\x00 unseen the of the of the"), (None, "the cat")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    training = [t for i, t in docs if i is not None and i % 5 != 1]
    model, counts = B.learn(frame.where("doc_id % 5 <> 1"), token_share, ngram_share)
    plain = Plain(training, ngram_share)
    assert len(model.pairs) == len(plain.two) and len(model.triples) == len(plain.three)
    want = sorted(((i, len(tokens(t)), sum(plain.c[w] > 0 for w in tokens(t)), plain.n, sum(math.log10(plain.base(w)) for w in tokens(t)), plain.score(t)) for i, t in docs), key=repr)
    got = sorted((tuple(r) for r in B.score(frame, model, counts).collect()), key=repr)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)
    for history in [(), ("the",), ("the", "of"), ("of", "<END>"), ("zz",)]:
        assert sum(plain.p(history, w) for w in [*plain.c, "never seen"]) == pytest.approx(1)


@pytest.mark.parametrize(("token_share", "cache_share"), [(2.0**-20, 2.0**-17), (0.02, 0.01), (0.5, 0.5)])
def test_all_ngrams_are_kept_whatever_travels(spark, token_share, cache_share):
    docs = [*corpus(random.Random(7)), (100, None), (102, "unseen the of the of the")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model, table = B.learn(frame.where("doc_id % 5 <> 1"), token_share, cache_share=cache_share)
    plain = Plain([t for i, t in docs if i % 5 != 1], 0)
    sizes = {r["size"]: r["count"] for r in table.groupBy("size").count().collect()}
    assert sizes == {1: len(plain.c), 2: len(plain.two), 3: len(plain.three)}
    got = {r.doc_id: r for r in B.score(frame, model, table).collect()}
    for i, text in docs:
        t = tokens(text)
        assert got[i].n_known == sum(plain.c[w] > 0 for w in t)
        assert got[i].base_score == pytest.approx(sum(math.log10(plain.base(w)) for w in t), rel=1e-9)
        assert got[i].score == pytest.approx(plain.score(text), rel=1e-9)


def test_ngrams_grow_with_the_corpus(spark):
    """Pairs of a share below 2^-17 that occur three times each: more than any order could hold before."""
    rows = [(i, f"a{i % 150_000} b{i % 150_000}") for i in range(450_000)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    model, table = B.learn(docs)
    assert table.where("size = 2").count() == 300_000  # each pair, and each second token before the end
    seen, turned = (B.score(spark.createDataFrame([(1, t)], "doc_id long, text string"), model, table).first() for t in ("a7 b7", "a7 b8"))
    assert seen.base_score == pytest.approx(turned.base_score) and seen.score > turned.score + 2


def test_odd_rows(odd, none):
    model, counts = B.learn(odd)
    got = B.score(odd, model, counts).collect()
    assert len(got) == odd.count() and all(r.score < 0 for r in got)
    assert B.score(none, model, counts).count() == 0
    nothing = B.learn(none)
    assert {r.n_known for r in B.score(odd.select("doc_id", "text", F.lit(1).alias("times")), *nothing).collect()} == {0}
