"""Language identification by nearest centroid: TF-IDF vectors of character n-grams and cosine.

Letters are lower-cased, all else is one space. The n-grams of one to three characters are hashed to a
fixed number of places. Document frequencies cover all training rows; several centroids per language are
clustered (spherical k-means) from a bounded sample of each. A text goes to the language of its nearest
centroid. It is marked as rejected if it is further from it than nearly all training texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W

PLACE_BITS = 13
PLACES = 1 << PLACE_BITS
SIZES = (1, 2, 3)
UNKNOWN = "und"
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: the lower-cased letter, or a space."""
    if not _tables:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables.append(table)
    return _tables[0]


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (texts x PLACES) and whether each text has a letter."""
    n = len(offsets) - 1
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    code = _letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)].astype(np.uint64)
    doc = np.repeat(np.arange(n), np.diff(begins))
    space = code == 32
    drop = np.zeros(len(code), bool)
    drop[1:] = space[1:] & space[:-1] & (doc[1:] == doc[:-1])
    code, doc, space = code[~drop], doc[~drop], space[~drop]
    has_letter = np.bincount(doc[~space], minlength=n) > 0
    total = np.zeros(n * PLACES)
    for size in SIZES:
        h = W.kgrams(W.mixed(code + np.uint64(1)), size, seed=size)
        same = doc[: len(h)] == doc[size - 1 :] if len(h) else np.empty(0, bool)
        place = (h[same] >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        total += np.bincount(doc[: len(h)][same] * PLACES + place, minlength=n * PLACES)
    return total.reshape(n, PLACES).astype(np.float32), has_letter


def vectors(column: pa.Array, at_once: int = 128) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, counts, has letter) of at most ``at_once`` texts at a time."""
    for block in W.blocks(column):
        for i in range(0, block.last - block.first, at_once):
            part = block.offsets[i : i + at_once + 1]
            x, has = counts(block.data[part[0] : part[-1]], part - part[0])
            yield block.first + i, x, has


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    idf: np.ndarray
    centres: np.ndarray
    languages: list[str]
    floors: np.ndarray


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each place occurs, and the number of texts. One vector per task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            for _, x, _ in vectors(batch.column(0)):
                total += (x > 0).sum(axis=0)
                n += len(x)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(total[seen], n))], names=["place", "n"])

    rows = texts.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(PLACES)
    head = rows["place"] == -1
    df[rows.loc[~head, "place"]] = rows.loc[~head, "n"]
    return df, int(rows.loc[head, "n"].sum())


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starting rows."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        chosen.append(int(near.argmin()))
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def learn(training: DataFrame, fit_rows: int = 800, clusters: int = 4, reject_share: float = 0.002) -> Centroids:
    """Fit on rows (doc_id, text, lang); rows with a null text or lang do not count.

    Document frequencies are of all rows; centroids come from about ``fit_rows`` rows of each language, drawn
    by a hash of doc_id. Languages, their counts and centroids reach the driver: what grows with the number of
    languages, not of rows. A text is rejected below the cosine that ``reject_share`` of the sample lie under.
    """
    training = training.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}
    if not sizes:
        return Centroids(np.ones(PLACES), np.zeros((0, PLACES)), [], np.zeros(0))
    df, n = document_frequencies(training)
    idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
    share = F.create_map(*[x for lang, c in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, fit_rows / c)))])[F.col("lang")]
    sample = training.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("text")
        parts = [x[has] for _, x, has in vectors(pa.array(rows["text"], pa.string()))]
        x = weighted(np.concatenate(parts), idf) if parts else np.empty((0, PLACES))
        if not len(x):
            return pd.DataFrame({"lang": [], "centre": [], "floor": []}, dtype=object)
        centres = cluster(x, clusters)
        near = (x @ centres.T).max(axis=1)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centre": [c.astype(np.float32) for c in centres], "floor": float(np.quantile(near, reject_share))})

    got = sample.groupBy("lang").applyInPandas(fit, "lang string, centre array<float>, floor double").toPandas()
    if not len(got):
        return Centroids(idf, np.zeros((0, PLACES)), [], np.zeros(0))
    got["first"] = [float(np.sum(c[:64])) for c in got["centre"]]
    got = got.sort_values(["lang", "first"])
    return Centroids(idf, np.array(got["centre"].tolist(), np.float32), got["lang"].tolist(), got["floor"].to_numpy())


def identify(docs: DataFrame, model: Centroids, keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected of each row's whole text.

    A text that is null or has no letter is ``und`` with score 0 and rejected; so are all texts if nothing was
    learnt. Every row has a result, repeated rows one each; an empty table gives none.
    """
    fields = docs.select(*keep).schema.fields
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x, has in vectors(batch.column(batch.num_columns - 1)):
                langs, score, rejected = [UNKNOWN] * len(x), np.zeros(len(x)), np.ones(len(x), bool)
                if model.languages and has.any():
                    cosine = weighted(x[has], model.idf) @ model.centres.T
                    best = cosine.argmax(axis=1)
                    at = np.flatnonzero(has)
                    for i, b in zip(at, best, strict=True):
                        langs[i] = model.languages[b]
                    score[at] = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                    rejected[at] = score[at] < model.floors[best]
                kept = [batch.column(i).slice(first, len(x)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=[*names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
