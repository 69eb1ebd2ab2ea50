from __future__ import annotations

import random

import numpy as np
import pytest
from plain_words import alnum

from millrace.llm import passages as P


def plain_best(at, there):
    """Best chain score by trying all predecessors."""
    order = sorted(range(len(at)), key=lambda i: (at[i], there[i]))
    score = {}
    for j in order:
        # The predecessor of the largest score less gap cost, as a prefix maximum sees it.
        before = [(score[i] + P.GAP_COST * (at[i] + there[i]), order.index(i), i) for i in score if at[i] < at[j] and there[i] < there[j]]
        score[j] = P.SEED
        if before:
            value, _, i = max(before)
            gain = value - P.GAP_COST * (at[j] + there[j])
            if gain > 0:
                score[j] = gain + min(P.SEED, at[j] - at[i], there[j] - there[i])
    return max(score.values())


def chain_score(chain, at, there):
    total = P.SEED
    for i, j in zip(chain, chain[1:], strict=False):
        total += min(P.SEED, at[j] - at[i], there[j] - there[i]) - P.GAP_COST * (at[j] - at[i] + there[j] - there[i])
    return total


def test_chains_are_collinear_and_best():
    rng = random.Random(9)
    for _ in range(60):
        pairs = list({(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(rng.randint(1, 30))})
        at, there = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
        got = P.chains(at, there)
        assert sorted(i for c in got for i in c) == list(range(len(pairs)))
        assert all(at[i] < at[j] and there[i] < there[j] for c in got for i, j in zip(c, c[1:], strict=False))
        assert abs(chain_score(got[0], at, there) - plain_best(at.tolist(), there.tolist())) < 1e-9


def test_chains_of_rising_anchors_are_best():
    rng = random.Random(10)
    for _ in range(60):
        n = rng.randint(1, 40)
        at, there = (np.cumsum([rng.choice([1, 2, 5, 30, 200]) for _ in range(n)]) for _ in range(2))
        shuffled = np.array(rng.sample(range(n), n))
        at, there = at[shuffled], there[shuffled]
        got = P.chains(at, there)
        assert sorted(i for c in got for i in c) == list(range(n))
        assert abs(chain_score(got[0], at, there) - plain_best(at.tolist(), there.tolist())) < 1e-9
    assert P.chains(np.empty(0, np.int64), np.empty(0, np.int64)) == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_alignment_has_fewest_edits():
    rng = np.random.default_rng(4)
    pairs = [(np.array([1, 2]), np.array([], np.int64)), (np.array([], np.int64), np.array([1]))]
    for _ in range(120):
        a = rng.integers(0, 30, rng.integers(1, 40))
        b = [x for x in a for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 2]))]
        pairs.append((a, np.array([rng.integers(0, 30) if rng.random() < 0.1 else x for x in b] or [1])))
    for (a, b), (left, right) in zip(pairs, P.align_all(pairs, band=50), strict=True):
        assert (a[left] == b[right]).all() and (np.diff(left) > 0).all() and (np.diff(right) > 0).all()
        ends_a, ends_b = np.concatenate(([-1], left, [len(a)])), np.concatenate(([-1], right, [len(b)]))
        assert np.maximum(np.diff(ends_a), np.diff(ends_b)).sum() - (len(left) + 1) == edits(a, b)


def test_planted_passages(spark):
    rng = random.Random(10)
    words = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    exact, fuzzy, short = words(70), words(120), words(40)
    changed = [f"e{i}" if i % 17 == 8 else w for i, w in enumerate(fuzzy) if i % 31 != 5]
    docs = {1: words(100) + exact + words(50), 2: exact + words(200), 3: words(30) + exact, 4: words(90) + fuzzy, 5: changed + words(80), 6: words(60) + short, 7: short + words(90), 8: words(300), 9: words(10)}
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(10, None), (11, ""), (12, ", ".join(docs[9])), (13, " ".join(docs[8]).upper()), (None, " ".join(exact))]
    got = {r.doc_id: r for r in P.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 8, 13, None}
    assert [tuple(s) for s in got[1].spans] == [(100, 170)] and [tuple(s) for s in got[2].spans] == [(0, 70)] and [tuple(s) for s in got[3].spans] == [(30, 100)]
    assert got[8].n_repeated == got[13].n_repeated == 300 and got[8].n_removable + got[13].n_removable == 300
    assert abs(got[4].n_repeated - 120) <= 12 and abs(got[5].n_repeated - len(changed)) <= 12
    assert sum(r.n_removable == 0 for i, r in got.items() if i in (1, 2, 3, None)) == 1
    assert len(alnum(rows[0][1])) == 220


def test_all_passages_of_a_piece(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randint(0, 90000)}" for _ in range(n)]
    parts = [words(65) for _ in range(20)]
    with_gaps = lambda sizes: [w for p, n in zip(parts, sizes, strict=True) for w in p + words(n)]
    docs = [(1, " ".join(with_gaps([25] * 20))), (2, " ".join(with_gaps([25] * 20))), (3, " ".join(words(30) + with_gaps([20, 27] * 10)))]
    got = {r.doc_id: r for r in P.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: len(got[i].spans) for i in got} == {1: 20, 2: 20, 3: 20}
    assert [tuple(s) for s in got[1].spans] == [tuple(s) for s in got[2].spans] == [(90 * i, 90 * i + 65) for i in range(20)]
    assert all(r.n_repeated == 1300 for r in got.values())


def test_insertions_far_from_the_diagonal(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randint(0, 90000)}" for _ in range(n)]
    base = words(2000)
    inserted = base[:100] + words(30) + base[100:]
    drifting = [w for i, x in enumerate(base) for w in ([x] + words(3) if i % 60 == 30 else [x])]
    for changed in (inserted, drifting):
        docs = [(1, " ".join(base)), (2, " ".join(changed))]
        got = {r.doc_id: r for r in P.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got[1].n_repeated == 2000 and got[2].n_repeated >= 2000


def split_passages(parts, holders, pairs=20):
    """Pairs of documents with a passage of 60 words, each part of which stands in other documents as well."""
    rng = random.Random(100 * parts + holders)
    words = lambda n: [f"w{rng.randint(0, 900000)}" for _ in range(n)]
    rows, size = [], 60 // parts
    for _ in range(pairs):
        passage = words(60)
        rows += [words(80) + passage + words(80) for _ in range(2)]
        for p in range(parts):
            rows += [words(70) + passage[p * size : (p + 1) * size] + words(70) for _ in range(holders)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    both = {i for i, w in enumerate(rows) if len(w) == 220}
    return [(i, " ".join(rows[i])) for i in order], both


@pytest.mark.parametrize(("parts", "holders"), [(2, 1), (2, 3), (2, 10), (2, 30), (3, 3), (3, 30)])
def test_parts_in_other_documents(spark, parts, holders):
    rows, both = split_passages(parts, holders)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in P.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) <= both and len(got) >= 0.95 * len(both)
    assert all(spans == [(80, 140)] for spans in got.values())


def plain_repeats(texts, least):
    """Places of each text that are within ``least`` or more words which another text holds, too."""
    runs = {}
    for i, w in texts.items():
        for at in range(len(w) - least + 1):
            runs.setdefault(tuple(w[at : at + least]), set()).add((i, at))
    out = {}
    for held in runs.values():
        if len({i for i, _ in held}) > 1:
            for i, at in held:
                out.setdefault(i, set()).update(range(at, at + least))
    return out


def test_against_all_runs_of_words(spark):
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randint(0, 900000)}" for _ in range(n)]
    pool = [words(90) for _ in range(12)]
    texts = {}
    for i in range(150):
        texts[i] = words(70)
        for _ in range(rng.randint(0, 5)):
            source, size = rng.choice(pool), rng.choice([15, 25, 35, 60, 75, 90])
            at = rng.randint(0, len(source) - size)
            texts[i] = texts[i] + source[at : at + size] + words(70)
    want = plain_repeats(texts, P.LEAST_WORDS)
    got = {r.doc_id: {x for s in r.spans for x in range(s.start, s.stop)} for r in P.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()}
    assert set(got) <= set(want) and all(got[i] <= want[i] for i in got)
    assert sum(map(len, got.values())) >= 0.98 * sum(map(len, want.values()))


def test_twice_in_one_document(spark):
    rng = random.Random(14)
    words = lambda n: [f"w{rng.randint(0, 900000)}" for _ in range(n)]
    passage = words(60)
    twice = words(20) + passage + words(80) + passage + words(20)
    rows = [(i, " ".join(w)) for i, w in enumerate([twice, words(30) + passage, twice[:160] + words(9) + twice[160:], words(200)])]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in P.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {0, 1, 2} and got[1] == [(30, 90)]
    assert all(sum(b - a for a, b in got[i]) >= 120 for i in (0, 2))


def test_chains_are_aligned_between_their_anchors():
    rng = np.random.default_rng(5)
    for _ in range(40):
        x = rng.integers(0, 10**6, 200)
        y = np.concatenate([[w] * int(rng.choice([0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2])) for w in x]).astype(np.int64)
        both = [(i, j) for i in range(len(x) - P.SEED + 1) for j in range(len(y) - P.SEED + 1) if (x[i : i + P.SEED] == y[j : j + P.SEED]).all()]
        at, there = np.array(both or np.empty((0, 2)), np.int64).T
        (left, right), = P.align_chains([(x, y, at, there)])
        assert (x[left] == y[right]).all() and (np.diff(left) > 0).all() and (np.diff(right) > 0).all()
        ends_a, ends_b = np.concatenate(([-1], left, [len(x)])), np.concatenate(([-1], right, [len(y)]))
        assert np.maximum(np.diff(ends_a), np.diff(ends_b)).sum() - (len(left) + 1) <= edits(x.tolist(), y.tolist())


def test_odd_rows(odd, none):
    got = P.repeated(odd).collect()
    assert all(r.n_repeated >= 50 for r in got)
    assert P.repeated(none).count() == 0
