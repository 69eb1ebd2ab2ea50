"""Versions of a table: whole ones for readers, conflicts for writers, bins for small files."""

from __future__ import annotations

import math
import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.sources import lake
from millrace.sources.snapshots import ConflictError, SnapshotTable, bins_of


def _rows(spark, spec: list[tuple[int, int, int]]):
    """(year, month, rows) to rows with values 0, 1, …"""
    rows = [(y, m, i, f"text {i}") for y, m, n in spec for i in range(n)]
    return spark.createDataFrame(rows, "year int, month int, v long, t string")


def _months(df) -> dict:
    return {(r.year, r.month): (r.n, r.s) for r in df.groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "table"))


def test_a_reader_keeps_its_version(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(_rows(spark, [(2020, 1, 4), (2020, 2, 3)])) == 1
    early = table.read()
    assert early.columns == ["year", "month", "v", "t"] and early.schema["year"].dataType.simpleString() == "int"
    assert table.overwrite_partitions(_rows(spark, [(2020, 2, 9), (2021, 1, 1)])) == 2
    assert table.replace(_rows(spark, [(2022, 5, 2)])) == 3
    assert _months(early) == {(2020, 1): (4, 6), (2020, 2): (3, 3)} == _months(table.read(1))
    assert _months(table.read(2)) == {(2020, 1): (4, 6), (2020, 2): (9, 36), (2021, 1): (1, 0)}
    assert _months(table.read()) == {(2022, 5): (2, 1)}


def test_a_reader_during_a_rebuild_sees_the_old_version(spark, table):
    """The new rows are written in full, and a reader looks, before the version is committed."""
    table.replace(_rows(spark, [(2020, 1, 4)]))
    seen = []

    class Watched(SnapshotTable):
        def _commit(self, base, entries, schema):
            seen.append(_months(table.read()))
            return super()._commit(base, entries, schema)

    Watched(table.spark, table.root).replace(_rows(spark, [(2020, 1, 7)]))
    assert seen == [{(2020, 1): (4, 6)}] and _months(table.read()) == {(2020, 1): (7, 21)}


def test_two_writers_conflict(spark, table):
    table.replace(_rows(spark, [(2020, 1, 4), (2020, 2, 1)]))
    base = table.version()
    table.overwrite_partitions(_rows(spark, [(2020, 1, 5)]), base=base)
    with pytest.raises(ConflictError, match="version 2"):
        table.overwrite_partitions(_rows(spark, [(2020, 2, 6)]), base=base)
    assert _months(table.read()) == {(2020, 1): (5, 10), (2020, 2): (1, 0)} and table.versions() == [1, 2]
    assert not [f for f in os.listdir(f"{table.root}/versions") if f.endswith(".crc") is False and f.startswith(".") and "crc" not in f]


def test_a_failed_write_commits_nothing(spark, table):
    table.replace(_rows(spark, [(2020, 1, 4)]))
    bad = _rows(spark, [(2020, 1, 2)]).withColumn("month", F.when(F.col("v") == 0, F.col("month")))
    with pytest.raises(Exception, match="partition column month is NULL"):
        table.replace(bad)
    assert table.versions() == [1] and _months(table.read()) == {(2020, 1): (4, 6)}


def test_no_rows_and_conditions_on_partitions(spark, table):
    table.replace(_rows(spark, []).limit(0))
    assert table.read().count() == 0
    table.replace(_rows(spark, [(2020, m, m) for m in range(1, 5)]))
    some = table.read(where=F.col("month") >= 3)
    assert _months(some) == {(2020, 3): (3, 3), (2020, 4): (4, 6)} and len(some.inputFiles()) == 2


def _scattered(spark, table, files: int = 7):
    rows = _rows(spark, [(2020, 1, 700), (2020, 2, 70), (2021, 1, 1)])
    table.replace(rows.repartition(files), gather=False)
    return _months(rows)


def test_compaction_merges_by_bins_without_a_shuffle(spark, table, monkeypatch):
    want = _scattered(spark, table)
    before = {r["month"] + r["year"] * 100: r["n"] for r in table.files().groupBy("year", "month").agg(F.count("*").alias("n")).collect()}
    assert before[202001] == 7
    plans = []
    rewrite = SnapshotTable._rewrite
    monkeypatch.setattr(SnapshotTable, "_rewrite", lambda self, *a: plans.append(rewrite(self, *a)) or plans[-1])
    monkeypatch.setattr("millrace.sources.snapshots.BINS_PER_JOB", 1)
    assert table.compact() == 2
    assert len(plans) == 2 and all("Exchange" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert _months(table.read()) == want == _months(table.read(1))
    assert {r.n for r in table.files().groupBy("year", "month").agg(F.count("*").alias("n")).collect()} == {1}
    alone = {r.file for r in table.files(1).where("year = 2021").collect()}
    assert alone == {r.file for r in table.files(2).where("year = 2021").collect()}  # not rewritten
    assert table.compact() is None and table.versions() == [1, 2]


def test_every_bin_is_a_task_that_writes_one_file(spark, table):
    """Bins of one job do not end up in one task, whose file would hold them all."""
    text = F.concat(*(F.sha2(F.concat("id", F.lit(i)).cast("string"), 256) for i in range(4)))
    rows = spark.range(24_000).select((F.col("id") % 2 + 2020).cast("int").alias("year"), F.lit(1).alias("month"), "id", text.alias("t"))
    table.replace(rows.repartition(8), gather=False)
    sizes = [r.bytes for r in table.files().collect()]
    assert len(sizes) == 16 and max(sizes) < lake.MIB / 2
    table.compact(target_mib=1)
    after = table.files().groupBy("year").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.max("bytes").alias("top")).collect()
    assert len(after) == 2 and all(1 < r.n <= math.ceil(r.b / lake.MIB) + 1 and r.top <= 2.1 * lake.MIB for r in after)
    assert table.read().agg(F.sum("id")).first()[0] == 12_000 * 23_999 and table.read().select("t").distinct().count() == 24_000


def test_compaction_of_some_partitions(spark, table):
    want = _scattered(spark, table)
    table.compact(where=F.col("month") == 2)
    counts = {(r.year, r.month): r.n for r in table.files().groupBy("year", "month").agg(F.count("*").alias("n")).collect()}
    assert counts[2020, 2] == 1 and counts[2020, 1] == 7 and _months(table.read()) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 150), max_size=60), st.integers(1, 100))
def test_bins_hold_the_bound(sizes, target):
    bins = bins_of(sizes, [str(i) for i in range(len(sizes))], target)
    filled: dict[int, int] = {}
    for b, s in zip(bins, sizes):
        assert (b == -1) == (s > target)
        if b >= 0:
            filled[b] = filled.get(b, 0) + s
    assert len(filled) + bins.count(-1) <= math.ceil(sum(sizes) / target) + 1
    assert all(v <= 2 * target for v in filled.values())


def test_partition_values_of_all_kinds(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "a b"), ("key",))
    rows = [(k, i) for k in ("a b", "50%", "x+y", "é", None, "s/t") for i in range(2)]
    keyed = spark.createDataFrame(rows, "key string, v int")
    with pytest.raises(Exception, match="key is NULL"):
        table.replace(keyed)
    table.replace(keyed.where("key is not null").repartition(4), gather=False)
    table.compact()
    assert sorted((r.key, r.v) for r in table.read().collect()) == sorted(r for r in rows if r[0])


def test_expired_versions_go_with_their_files(spark, table):
    table.replace(_rows(spark, [(2020, 1, 4), (2020, 2, 1)]))
    table.overwrite_partitions(_rows(spark, [(2020, 2, 2)]))
    table.replace(_rows(spark, [(2020, 3, 3)]))
    assert table.expire(keep=2) == [1] and table.versions() == [2, 3]
    assert _months(table.read(2)) == {(2020, 1): (4, 6), (2020, 2): (2, 1)}  # a file of version 1 is still in use
    assert table.expire() == [2] and len([d for d in os.listdir(f"{table.root}/data") if "=" in d]) == 1
    assert _months(table.read()) == {(2020, 3): (3, 3)}
    with pytest.raises(ValueError):
        table.expire(0)


def test_persist_checked(spark, tmp_path):
    done = lake.persist_checked(_rows(spark, [(2020, 1, 40), (2020, 2, 10)]), str(tmp_path / "p"))
    assert (done.ok, done.n_files, done.n_rows) == (True, 2, 50) and done.size_mib > 0
    none = lake.persist_checked(_rows(spark, [(2020, 1, 1)]).where("v > 5"), str(tmp_path / "none"))
    assert (none.ok, none.n_rows) == (True, 0)
