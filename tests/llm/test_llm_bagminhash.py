from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain_words import alnum

from millrace.llm import bagminhash as B
from millrace.llm import words as W


def bag(text):
    w = alnum(text)
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def jaccard(a, b):
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_signatures_estimate_weighted_jaccard():
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base), " ".join(base[:90] + ["z"] + base[90:]), " ".join(base + base[:60]), " ".join(base * 3), "a b"]
    words = W.split(next(W.blocks(pa.array(texts))))
    sig = B.signatures(*B.bags(words), len(texts), 6000)
    for i in range(len(texts)):
        for j in range(i):
            true = jaccard(texts[i], texts[j])
            assert (sig[i] == sig[j]).mean() == pytest.approx(true, abs=0.03)


def test_signatures_do_not_depend_on_the_block():
    rng = random.Random(3)
    texts = [" ".join(f"v{rng.randint(0, 5000)}" for _ in range(n)) for n in (4, 19, 34, 54, 104, 304)]
    texts += [" ".join(t.split()[:40] * 3) for t in texts[3:]]
    others = [" ".join(f"o{rng.randint(0, 9000)}" for _ in range(200)) for _ in range(80)]

    def bands(block):
        words = W.split(next(W.blocks(pa.array(block))))
        return B.band_hashes(B.signatures(*B.bags(words), len(block), B.BANDS * B.ROWS), B.BANDS, B.ROWS)

    inside = bands(others[:40] + texts + others[40:])[40 : 40 + len(texts)]
    for i, text in enumerate(texts):
        assert bands([text])[0].tolist() == inside[i].tolist()


def test_overlaps_count_shared_elements():
    rng = np.random.default_rng(1)
    sets = [rng.choice(60, rng.integers(0, 40), replace=False).astype(np.int64) for _ in range(30)]
    got = B.overlaps(sets[:12], sets[12:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[12:]] for a in sets[:12]]
    assert B.overlaps([], []).shape == (0, 0)


def families(rng):
    docs = []
    for _ in range(6):
        base = [f"v{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 8, 60, 150]))]
        docs.append(" ".join(base))
        for _ in range(rng.choice([1, 4, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
            docs.append(" ".join(copy * rng.choice([1, 1, 1, 2])))
    return docs


def brute(docs):
    ids, parent = list(docs), {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if alnum(docs[a]) and jaccard(docs[a], docs[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("small", [12, 1])
def test_against_brute_force(spark, monkeypatch, small):
    """With small buckets only, and with blocks for all but pairs."""
    monkeypatch.setattr(B, "SMALL", small)
    monkeypatch.setattr(B, "BLOCK_ELEMENTS", 2000)
    rng = random.Random(8)
    texts = families(rng)
    rng.shuffle(texts)
    docs = {i * 3 + 1: t for i, t in enumerate(texts)} | {900: "", 901: "?", 902: texts[0].upper() + "!"}
    got = {r.doc_id: (r.class_id, r.kept) for r in B.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    want = brute(docs)
    assert {i: c for i, (c, _) in got.items()} == want
    assert {i for i, (_, k) in got.items() if k} == {i for i, c in want.items() if i == c}


def test_odd_rows(odd, none):
    got = B.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r.kept for r in got if r.doc_id != 1)
    assert [r.kept for r in got if r.doc_id == 1].count(True) == 3  # one text twice, another once
    assert B.near_duplicates(none).count() == 0
