from __future__ import annotations

import pyarrow as pa
from plain_words import alnum
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import words as W


def block_of(texts):
    return next(W.blocks(pa.array(texts, pa.string()), 1 << 30))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    words = W.split(block_of(texts))
    expected = [alnum(t) for t in texts]
    assert words.counts.tolist() == [len(e) for e in expected]
    assert [words.word(i) for i in range(len(words.doc))] == [w for e in expected for w in e]
    by_word = {}
    for w, h in zip((w for e in expected for w in e), words.hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_blocks_hold_all_texts_in_order():
    texts = ["a" * 30, None, "", "b" * 5, "c" * 100, "d"]
    got = [bytes(b.data[x:y]).decode() for b in W.blocks(pa.array(texts), 32) for x, y in zip(b.offsets, b.offsets[1:], strict=False)]
    assert got == [t or "" for t in texts]
    assert [(b.first, b.last) for b in W.blocks(pa.array([], pa.string()))] == []


def test_a_slice_of_a_column():
    got = [bytes(b.data).decode() for b in W.blocks(pa.array(["x", "yy", "zzz"]).slice(1, 2))]
    assert got == ["yyzzz"]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.lists(st.sampled_from("abc"), min_size=1, max_size=40), st.lists(st.sampled_from("abc"), max_size=40))
def test_shared_runs_share_a_kept_gram(k, w, one, two):
    n = k + w - 1
    words = W.split(block_of([" ".join(one), " ".join(two)]))
    at, h = W.winnow(words, k, w)
    kept = [set(h[words.doc[at] == d].tolist()) for d in (0, 1)]
    runs = [{tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (one, two)]
    if runs[0] & runs[1]:
        assert kept[0] & kept[1]
    assert all(words.first[words.doc[a]] <= a and a + k <= words.first[words.doc[a] + 1] for a in at)
