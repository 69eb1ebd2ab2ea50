"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of every text are taken in one pass in numpy over blocks of texts. The trees are grown on
a bounded sample of labelled rows (``fit_rows``) by histograms of binned features, and flattened into
arrays (feature, threshold, children, value); scoring walks all rows of a batch through a tree at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import words as W
from millrace.llm.tables import text_hash
from millrace.session import durable

NAMES = (
    "log_bytes log_words mean_word sd_word long_words distinct_words upper lower digit space newline other_ascii non_ascii "
    "capital_words end_marks commas pipes symbols repeats letters_per_word one_letter words_per_line top_word adjacent_equal "
    "brackets at_signs"
).split()


def _count(data: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.float32)
    table[list(chars)] = 1
    return table[data]


def statistics(block: W.Block) -> np.ndarray:
    """A row of NAMES for each text of the block."""
    data, n = block.data, block.last - block.first
    length = np.diff(block.offsets).astype(np.float64)
    words = W.split(block, W.SPACED)
    count = words.counts.astype(np.float64)

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return total[block.offsets[1:]] - total[block.offsets[:-1]]

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc, values, minlength=n)

    size = (words.ends - words.starts).astype(np.float64)
    some, here = np.maximum(count, 1), np.maximum(length, 1)
    mean = per_word(size) / some
    square = np.maximum(per_word(size * size) / some - mean * mean, 0)
    order = np.lexsort((words.hashes, words.doc))
    h, d = words.hashes[order], words.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[new], runs)
    equal = np.zeros(len(words.hashes))
    equal[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    first = data[words.starts] if len(words.starts) else data[:0]
    last = data[words.ends - 1] if len(words.ends) else data[:0]
    letters = np.isin(data, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)) | (data >= 0x80)
    same = np.zeros(len(data), np.float32)
    same[1:] = (data[1:] == data[:-1]) & (data[1:] > 32)
    lines = per_text(_count(data, b"\n"))
    columns = (
        np.log1p(length), np.log1p(count), mean, np.sqrt(square), per_word(size > 12) / some,
        np.bincount(d[new], minlength=n) / some,
        per_text(_count(data, bytes(range(65, 91)))) / here, per_text(_count(data, bytes(range(97, 123)))) / here,
        per_text(_count(data, b"0123456789")) / here, per_text(_count(data, b" \t")) / here, lines / here,
        per_text(_count(data, bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))) / here,
        per_text((data >= 0x80).astype(np.float32)) / here,
        per_word((first >= 65) & (first <= 90)) / some, per_word(np.isin(last, np.frombuffer(b".!?", np.uint8))) / some,
        per_text(_count(data, b",;:")) / here, per_text(_count(data, b"|")) / here, per_text(_count(data, b"#$%&*+=^~<>\\")) / here,
        per_text(same) / here, per_text(letters.astype(np.float32)) / some, per_word(size == 1) / some, count / (lines + 1),
        top / some, per_word(equal) / some, per_text(_count(data, b"()[]{}")) / here, per_text(_count(data, b"@")) / here,
    )
    return np.stack(columns, axis=1).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the statistics (array<float>) of each row's whole text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(2)):
                x = statistics(block)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), x.shape[1]).cast(pa.list_(pa.float32()))
                k = block.last - block.first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, k), batch.column(1).slice(block.first, k), flat], names=["doc_id", "text_hash", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, stats array<float>")


@dataclass
class Trees:
    """All trees in flat arrays: node i goes left if x[feature] <= threshold; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                go = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(go, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Grow trees on the logistic loss. Rows are few and bounded; all splits come from (node, bin) histograms."""
    n, m = x.shape
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1) if n else np.empty((0, m), np.int64)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def leaf(v: float) -> int:
        i = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(leaf(0.0))
        open_nodes = [(roots[-1], np.arange(n))]
        for level in range(depth + 1):
            grown = []
            for node, rows in open_nodes:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -rate * gs / (hs + ridge)
                best = (1e-6, -1, -1)
                if level < depth and len(rows) >= 2 * least:
                    for j in range(m):
                        if len(cuts[j]) == 0:
                            continue
                        b = binned[rows, j]
                        gl = np.cumsum(np.bincount(b, g[rows], bins))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], bins))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=bins))[:-1]
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        gain[(nl < least) | (len(rows) - nl < least)] = -1
                        gain[len(cuts[j]) :] = -1
                        at = int(gain.argmax())
                        if gain[at] > best[0]:
                            best = (gain[at], j, at)
                if best[1] < 0:
                    margin[rows] += value[node]
                    continue
                _, j, at = best
                goes = binned[rows, j] <= at
                a, b = leaf(0.0), leaf(0.0)
                feature[node], threshold[node], left[node], right[node] = j, cuts[j][at], a, b
                grown += [(a, rows[goes]), (b, rows[~goes])]
            open_nodes = grown
    return Trees(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64), depth, base)


def learn(stats: DataFrame, labels: DataFrame, fit_rows: int = 20_000, **options: float) -> Trees:
    """Fit on at most about ``fit_rows`` labelled rows, drawn by a hash of doc_id; the sample alone reaches the driver.

    ``labels`` has doc_id and quality (0 or 1; other values and nulls are ignored). Several labels of a document
    all count. Without any label of one kind the score is that of the labels' share (one half if there are none).
    """
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality")
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(fit_rows / total * (1 << 30)))
    rows = stats.join(known, "doc_id").select("doc_id", "text_hash", "stats", "quality").toPandas()
    rows = rows.sort_values(["doc_id", "text_hash", "quality"])
    x = np.stack(rows["stats"].to_numpy()).astype(np.float32) if len(rows) else np.empty((0, len(NAMES)), np.float32)
    return fit(x.astype(np.float64), rows["quality"].to_numpy(np.float64), **options)


def score(stats: DataFrame, model: Trees) -> DataFrame:
    """``stats`` with a column score, 0 to 1: how likely label 1 is."""

    @F.pandas_udf(T.DoubleType())
    def probability(batch: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack(batch.to_numpy()).astype(np.float64)) if len(batch) else np.empty(0))

    return stats.withColumn("score", probability("stats"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = 20_000) -> DataFrame:
    """doc_id, text_hash, score and predicted (score >= threshold) of each row of ``docs``.

    Every row has a result: null and empty texts have the statistics of an empty text, repeated rows have
    one each. An empty ``docs`` gives no rows. Other columns are ignored.
    """
    stats = durable(features(docs), "quality-stats")
    scored = score(stats, learn(stats, labels, fit_rows))
    return scored.select("doc_id", "text_hash", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
