from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import neighbours as N


def vectors(rng, groups=(1, 1, 2, 5, 40, 120), singles=300, dim=16):
    rows = []
    for g in groups:
        base = rng.normal(size=dim)
        rows += [base + rng.normal(size=dim) * np.linalg.norm(base) * 0.05 for _ in range(g)]
    rows += list(rng.normal(size=(singles, dim)))
    rows += [rows[3] * 2.0, rows[3], rows[3]]
    return [np.float32(r) for r in rows]


def brute(x, ids, cosine=0.95):
    x = np.stack(x).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= cosine
    parent = {i: i for i in ids}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(ids[i]), find(ids[j])
        parent[max(a, b)] = min(a, b)
    return {v: (int(near[i].sum()) - 1, find(v)) for i, v in enumerate(ids)}


@pytest.mark.parametrize("shard", [1500, 60])
def test_against_brute_force(spark, shard):
    """With one shard, and with small shards of which the dense one is cut into blocks."""
    x = vectors(np.random.default_rng(3))
    ids = [5 * i + 2 for i in range(len(x))]
    table = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, node int")
    got = N.near_duplicates(table, shard=shard)
    rows = {r.vec_id: r for r in got.collect()}
    want = brute(x, ids)
    links = sum(n for n, _ in want.values())
    assert sum(min(r.n_links, want[i][0]) for i, r in rows.items()) >= 0.98 * links
    assert all(r.n_links <= want[i][0] for i, r in rows.items())
    assert {i: r.component_id for i, r in rows.items()} == {i: c for i, (_, c) in want.items()}
    assert all(r.kept == (i == r.component_id) for i, r in rows.items())
    assert N.audit(table, got) >= 0.98


def test_pruning_keeps_what_no_chosen_one_covers():
    x = np.array([[1.0, 0], [0.99, 0.14], [0.985, 0.17], [0, 1.0]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    kept = N.robust_prune(x, np.tile(np.arange(4), (4, 1)), degree=3, slack=1.2)
    assert kept[0].tolist() == [1, 3]  # 2 is nearer to 1 than to 0; 3 is not, by the slack
    assert kept[3].tolist()[0] == 2 and 1 not in kept[3]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (None, None), (11, [-0.0, 1.0]), (12, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1))
    got = [(r.vec_id, r.n_links, r.component_id) for r in N.near_duplicates(table).collect()]
    assert sorted(got, key=repr) == sorted(
        [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 10)] + [(7, 4, 7), (8, 4, 7), (8, 4, 7), (9, 4, 7), (None, 4, 7), (None, 0, None), (11, 1, 11), (12, 1, 11)], key=repr
    )
    assert N.near_duplicates(table.limit(0)).count() == 0
