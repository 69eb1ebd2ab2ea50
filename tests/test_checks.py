"""Every registered query against its SQL, on the smallest test data."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from checks import storage
from checks.compare import connect, differences

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    result = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in result.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    expected = duck.sql(sql)
    assert differences(result.columns, rows, expected.columns, expected.fetchall()) == []


@pytest.mark.parametrize("name, files", [("incremental_publish", 24), ("incremental_ingest", 12)])
def test_larger_tables_arrive_in_more_files(spark, duck, monkeypatch, name, files):
    """A file, and the task that writes it, holds no more rows for a larger table."""
    paths, scratch = [], storage.scratch_path
    monkeypatch.setattr(storage, "PIECE_ROWS", int(duck.sql("SELECT ceil(count(*) / 12) FROM lineitem").fetchall()[0][0]))
    monkeypatch.setattr(storage, "scratch_path", lambda spark, label: paths.append((label, scratch(spark, label))) or paths[-1][1])
    result = entry.queries()[name](spark, SF)
    expected = duck.sql(entry.oracle_sql()[name])
    assert differences(result.columns, [tuple(r) for r in result.collect()], expected.columns, expected.fetchall()) == []
    assert len(spark.read.parquet(dict(paths)["landing"]).inputFiles()) == files


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "sum_total_amount" in df.columns
