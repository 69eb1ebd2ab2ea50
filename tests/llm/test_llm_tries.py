from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm import tries as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def turn_key(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain_nodes(paths: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    sums: dict[tuple, tuple[int, int]] = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(node, [])]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(paths[c]) == len(node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids.get(node, [])), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def plain(rows: list[tuple]) -> list[tuple]:
    by: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, turn_key(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return plain_nodes(paths)


def got(spark, tmp_path, rows) -> list[tuple]:
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries.op13_trie(spark, str(tmp_path))
    assert out.columns == COLUMNS and [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[:2], r))


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_trie(spark, tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(T, "CHUNK", 7)
    monkeypatch.setattr(T, "BLOCK", 3)
    rows = []
    for c in rng.sample(range(450), 60):
        for turn in range(rng.choice([1, 2, 5, 9, 9, 12]) if c != 101 else 200):
            rows.append((c, turn, rng.choice("ua"), rng.choice(["x", "yy", "é😀"]) if turn < 4 else "z" * (turn % 3)))
    rows += [(7001, t, "u", "x") for t in range(170)] + [(7002, t, "u", "x") for t in range(170)] + [(7002, 170, "u", "y")]
    assert got(spark, tmp_path, rows) == plain(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(0, 1, "u", "b"), (0, None, "u", "a"), (0, 1, "u", "a"), (0, 1, "u", "a"), (1, 0, None, None), (1, 1, "", ""), (2, 0, "u", None), (None, 0, "u", "lost")]
    rows += [(300 + i, 0, "u", "only turn") for i in range(12)] + [(99, 0, "ab", "c"), (98, 0, "a", "bc"), (5000, 0, "x", "y" * 300_000), (5000, 0, "x", "y" * 300_000)]
    assert got(spark, tmp_path, rows) == plain(rows)
    assert got(spark, tmp_path / "empty", []) == []


def test_clashing_names(spark, tmp_path):
    rows = [(c, t, "u", "abc"[:t]) for c in range(5) for t in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("?") for n in ("a", "b", "depth", "chunk", "place", "points", "up")})
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(map(tuple, queries.op13_trie(spark, str(tmp_path)).collect()), key=lambda r: (r[:2], r)) == plain(rows)
