from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle as M
from millrace.llm import queries


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text) -> str:
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def levels_up(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        out.append((run[: at % 3], run[at % 3 + 1 :]))
        at //= 3
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    """Rows (doc_id, source, lang, n_chars, text) to the columns of op11."""
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[1], []).append((-1 if r[0] is None else r[0], plain_leaf(*r), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: levels_up([x[1] for x in sorted(trees[s], key=lambda x: x[:2])]) for s in order}
    top = levels_up([grown[s][-1][0] for s in order])
    out = []
    for number, s in enumerate(order):
        for at, (_, leaf, r) in enumerate(sorted(trees[s], key=lambda x: x[:2])):
            path = siblings(grown[s], at) + siblings(top, number)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            folded = plain_leaf(*r[:4], r[4].replace("\n", "")) if bad else leaf
            for left, right in path:
                folded = h(*left, folded, *right)
            proof = h(*(x for left, right in path for x in left + right))
            out.append((r[0], leaf, grown[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [(1,), (3, 1, 2), (243, 244, 1), (2, 730, 9, 10, 28, 4, 3)])
def test_equals_plain_trees(spark, tmp_path, sizes):
    names = [None, "", "b", "B", "é", "z", "日"]
    rows = [(i * 10 + n, names[n], "en", i, f"line {i}\nline {n}" if i % 3 else "one line") for n, size in enumerate(sizes) for i in range(size)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_odd_rows(spark, odd, none, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in queries.op11_merkle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    none.write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert queries.op11_merkle(spark, str(tmp_path / "empty")).collect() == []


def test_store_answers_by_digest(spark):
    rows = spark.range(800).select("id", (F.col("id") % 2).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    manifest = M.build(rows, F.col("key"), ["id"])
    records = {r["digest"]: r["children"] for pages in (*manifest.pages, *manifest.forest) for p in pages.collect() for r in p["records"]}
    assert all(h(*children) == top and 1 <= len(children) <= 3 for top, children in records.items())
    seen, todo = set(), [manifest.root]
    while todo:
        at = todo.pop()
        todo += records.get(at, [])
        seen |= set() if at in records else {at}
    assert seen == {r["leaf"] for r in rows.collect()}
    assert max(len(p["records"]) for pages in manifest.pages for p in pages.collect()) <= 121
    proofs = M.prove(manifest, ["id"])
    assert proofs.where(M.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0 and proofs.count() == 800
    assert proofs.where(M.fold(F.sha2(F.lit("x"), 256), F.col("path")) == F.col("root")).count() == 0
    manifest.forget()
