from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import quality as Q
from millrace.llm import words as W


def walk(model, row):
    total = model.base
    for node in model.roots:
        while model.left[node] != node:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        total += model.value[node]
    return total


def test_flat_trees_walk_like_trees_and_learn():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = Q.fit(x, y)
    assert np.allclose(model.margin(x), [walk(model, r) for r in x])
    assert ((model.predict(x) > 0.5) == y).mean() > 0.97


def test_no_labels_or_one_kind():
    assert Q.fit(np.empty((0, 3)), np.empty(0)).predict(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert Q.fit(np.zeros((40, 3)), np.ones(40)).predict(np.zeros((1, 3)))[0] > 0.9


def test_statistics_do_not_depend_on_neighbours():
    texts = ["Some words here. And more!", None, "", "|| a | a | a\n\nB##", "x" * 5000]
    together = Q.statistics(next(W.blocks(pa.array(texts), 1 << 30)))
    alone = np.concatenate([Q.statistics(next(W.blocks(pa.array([t], pa.string())))) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    got = Q.classify(docs, labels.where(fold != 2)).join(labels.where(fold == 2), "doc_id")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.95


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (3, None, 0), (6, 7, 0)], "doc_id long, quality int, score int")
    got = Q.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert Q.classify(none, labels).count() == 0
    assert {r.score for r in Q.classify(odd, labels.limit(0)).collect()} == {0.5}
