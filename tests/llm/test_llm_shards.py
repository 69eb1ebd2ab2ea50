from __future__ import annotations

import hashlib
import math
import zlib

from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm import shards as S


def plain_place(key, tree: S.Tree) -> int:
    """Descends the same tree one key at a time."""
    at = ""
    nodes = tree.children()
    for _ in range(3):
        draws = []
        for label, weight in nodes[at].items():
            x = int(hashlib.md5(f"{'' if key is None else key}|{label}".encode()).hexdigest()[:13], 16)
            draws.append((-math.log((x + 0.5) / 16**13) / weight, label))
        at = min(draws)[1]
    return int(at.split("/")[3])


def test_equals_plain_descent(spark, odd, none, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_hash_tree(spark, str(tmp_path)).collect()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    sizes = sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in got) == sizes
    assert all(r.law == "key" and r.shard == plain_place(r.doc_id, queries.SHARDS) and r.grown_shard == plain_place(r.doc_id, queries.GROWN_SHARDS) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    none.write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert queries.op12_hash_tree(spark, str(tmp_path / "empty")).collect() == []


def placed(spark, n: int, **trees: S.Tree) -> list:
    return spark.range(n).select("id", *(S.place(F.col("id"), t)["shard"].alias(name) for name, t in trees.items())).collect()


def test_growth_moves_keys_only_into_what_is_new(spark):
    old = S.Tree.uniform(2, 3, 4)
    new = old.grown([S.Shard("r1", "k2", 24)])
    more = new.grown([S.Shard("r1", "k2", 25), S.Shard("r9", "k0", 26, 2.0)])
    heavier = more.grown([S.Shard("r0", "k0", 0, 1.0)])
    rows = placed(spark, 20_000, old=old, new=new, more=more, heavier=heavier)
    assert all(r.new == 24 for r in rows if r.new != r.old) and all(r.more in (25, 26) for r in rows if r.more != r.new)
    assert all(r.heavier == 0 for r in rows if r.heavier != r.more)
    shares = {s: sum(r.more == s for r in rows) / len(rows) for s in range(27)}
    for s, share in shares.items():
        want = (2 if s == 26 else 1) / 28
        assert abs(share - want) < 5 * math.sqrt(want / len(rows)), (s, share)
    assert abs(sum(r.new != r.old for r in rows) / len(rows) - 1 / 25) < 0.008


def test_weights_and_removal(spark):
    tree = S.Tree((S.Shard("a", "x", 0, 3.0), S.Shard("a", "y", 1, 1.0), S.Shard("b", "x", 2, 0.5), S.Shard("b", "x", 3, 1.5)))
    rows = placed(spark, 20_000, full=tree, less=tree.without(3))
    for s, want in enumerate((0.5, 1 / 6, 1 / 12, 0.25)):
        assert abs(sum(r.full == s for r in rows) / len(rows) - want) < 0.02
    assert not any(r.less == 3 for r in rows)
    # Only region b became lighter: nothing moves within a, and nothing moves from a to b.
    assert all(r.full in (2, 3) for r in rows if r.less != r.full)


def test_write_and_movement(spark, tmp_path, odd):
    tree = S.Tree.uniform(1, 2, 2)
    S.write(odd, tree, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and set(odd.columns) < set(back.columns)
    assert back.where(S.place(F.col("doc_id"), tree)["shard"] != F.col("shard_number")).count() == 0
    report = S.moved(S.assign(odd, tree, tree.grown([S.Shard("r0", "k0", 4)]))).collect()
    assert sum(r.n_rows for r in report) == odd.count() and all(r.grown_shard in (r.shard, 4) for r in report)
