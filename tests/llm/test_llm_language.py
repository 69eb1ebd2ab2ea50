from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import language as L
from millrace.llm import queries


def test_held_out_accuracy_and_unknown(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = L.learn(docs.where(fold != 2), fit_rows=60)
    got = L.identify(docs.where(fold == 2), model, ("doc_id", "lang", "text")).toPandas()
    letters = got["text"].map(lambda t: any(unicodedata.category(c)[0] == "L" for c in t or ""))
    assert ((got["lang_pred"] == "und") == ~letters).all()
    known = got[letters & got["lang"].notna()]
    assert len(known) > 150 and (known["lang"] == known["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_counts_are_of_the_text_alone():
    texts = ["Abc, déf!", None, "", "12 34", "ÀB", "日本"]
    together = [x for _, x, _ in L.vectors(pa.array(texts), at_once=2)]
    alone = [next(L.vectors(pa.array([t], pa.string())))[1] for t in texts]
    assert np.array_equal(np.concatenate(together), np.concatenate(alone))
    assert [bool(h[0]) for t in texts for _, _, h in L.vectors(pa.array([t], pa.string()))] == [True, False, False, False, True, True]
    lower = next(L.vectors(pa.array(["abc  déf"])))[1]
    assert np.array_equal(lower[0], next(L.vectors(pa.array(["ABC 9 DÉF"])))[1][0])


def test_odd_rows(odd, none):
    got = L.identify(odd, L.learn(odd)).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred == "und") == (r.score == 0) for r in got if r.lang_pred == "und")
    assert L.identify(none, L.learn(odd)).count() == 0
    assert {r.lang_pred for r in L.identify(odd, L.learn(none)).collect()} == {"und"}


MASK = (1 << 64) - 1


def plain_mixed(h: int) -> int:
    h ^= h >> 31
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 29
    h = h * 0x94D049BB133111EB & MASK
    return h ^ (h >> 32)


def plain_counts(text: str) -> dict[int, int]:
    """Places of the n-grams of a text, one character at a time."""
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    letters = re.sub(" +", " ", letters)
    codes, out = [plain_mixed(ord(c) + 1) for c in letters], {}
    for size in (1, 2, 3):
        for i in range(len(codes) - size + 1):
            h = 2 * size + 1
            for code in codes[i : i + size]:
                h = (h * 0x9E3779B97F4A7C15 + code) & MASK
            place = plain_mixed(h) >> (64 - 13)
            out[place] = out.get(place, 0) + 1
    return out


def test_nearest_centroid_against_plain_python(spark):
    """Document frequencies, weights, cosines, the nearest centroid and its rejection, all by their formulas."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.learn(docs, fit_rows=40)
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    known = [plain_counts(t) for t, lang in texts.values() if t is not None and lang is not None]
    seen: dict[int, int] = {}
    for counted in known:
        for place in counted:
            seen[place] = seen.get(place, 0) + 1
    idf = {p: math.log((len(known) + 1) / (seen.get(p, 0) + 1)) + 1 for p in range(L.PLACES)}
    assert np.allclose(model.idf, [idf[p] for p in range(L.PLACES)], rtol=1e-5)
    centres = model.centres.astype(float)
    for r in L.identify(docs, model).collect():
        text = texts[r.doc_id][0]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        weights = {p: math.log1p(c) * idf[p] for p, c in plain_counts(text).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * centre[p] for p, w in weights.items()) / norm for centre in centres]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(r.score - min(1.0, max(0.0, cosines[best]))) < 1e-4
        rivals = [c for c, lang in zip(cosines, model.languages) if lang != model.languages[best]]
        if cosines[best] - max(rivals) > 1e-4:
            assert r.lang_pred == model.languages[best]
        if abs(r.score - model.floors[best]) > 1e-4 and cosines[best] - sorted(cosines)[-2] > 1e-4:
            assert r.rejected == (r.score < model.floors[best])


def test_a_null_id_is_in_no_fold(spark, odd, tmp_path):
    """Rows without an id are predicted; whether they are held out is not known, so it is null, and they are not learnt from."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_language(spark, str(tmp_path)).collect()
    assert len(got) == odd.count() and all((r.held_out is None) == (r.doc_id is None) for r in got)
