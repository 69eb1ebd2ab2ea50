from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace import functions as X
from millrace.operators import runstats


def test_buckets_of_three_two_and_one(spark):
    rows = [(i, 100 + i if i < 8 else 5, f"op{i}", str(float(i * i)) if i != 4 else "n/a") for i in range(8)]
    rows.append((8, 500, "late", "1"))
    df = spark.createDataFrame(rows, "seq int, test_number int, operation string, secs string")
    out = runstats.run_summary(
        df, ["seq"], numeric=["secs"], keep=["operation"], where=F.col("test_number") < 500
    ).orderBy("bucket").collect()
    assert [(r.bucket, r.operation, r.rows_in_group) for r in out] == [(1, "op0", 3), (2, "op3", 3), (3, "op6", 2)]
    first, second, third = out
    assert first.secs_average == pytest.approx(5 / 3) and (first.secs_min, first.secs_max) == (0.0, 4.0)
    assert second.secs_average == 17.0  # 9 and 25; the text that is no number is left out
    assert third.secs_standard_deviation == pytest.approx(((49 - 36) ** 2 / 2) ** 0.5)


def test_single_run_has_no_spread(spark):
    df = spark.createDataFrame([(1, 2.5, "[1.0, 2]")], "seq int, secs double, cores string")
    row = runstats.run_summary(df, ["seq"], numeric=["secs"], lists=["cores"]).collect()[0]
    assert (row.secs_standard_deviation, row.cores_average, row.cores_standard_deviation) == (0.0, [1.0, 2.0], [0.0, 0.0])


def test_no_values_at_all(spark):
    df = spark.createDataFrame([(1, None, None)], "seq int, secs double, cores string")
    row = runstats.run_summary(df, ["seq"], numeric=["secs"], lists=["cores"]).collect()[0]
    assert (row.secs_average, row.secs_standard_deviation, row.cores_average) == (None, None, None)


def test_lists_are_aggregated_by_place(spark):
    rows = [(1, "a", "[1, 10]"), (2, "a", "[3, 30]"), (3, "a", None), (4, "b", "[7]")]
    df = spark.createDataFrame(rows, "seq int, k string, cores string")
    out = {r.k: r for r in runstats.array_stats(df, ["k"], "cores").collect()}
    assert out["a"].cores_average == [2.0, 20.0] and out["a"].cores_max == [3.0, 30.0]
    assert out["a"].cores_standard_deviation == pytest.approx([2**0.5, 200**0.5])
    assert out["b"].cores_min == [7.0]


@pytest.mark.parametrize("other", ["[1]", "[]", "[1, 2, 3]"])
def test_lists_of_different_length_are_an_error(spark, other):
    df = spark.createDataFrame([("a", "[1, 2]"), ("a", other)], "k string, cores string")
    with pytest.raises(Exception, match="differ in length"):
        runstats.array_stats(df, ["k"], "cores").collect()


def test_pivot_speedup_and_scaleout(spark):
    rows = [
        ("s1", "memory", 10.0), ("s1", "one node", 20.0), ("s1", "two nodes", 12.0), ("s1", "two nodes", 8.0),
        ("s2", "chunks", 30.0), ("s2", "one node", 15.0), ("s2", "two nodes", 0.0),
    ]
    df = spark.createDataFrame(rows, "slice string, system string, secs double")
    wide = runstats.pivot_mean(df, ["slice"], "system", ["memory", "chunks", "one node", "two nodes"], "secs")
    speed = runstats.relative_speedup(wide, ["slice"], ["memory", "chunks"], ["one node", "two nodes"])
    assert {tuple(r) for r in speed.collect()} == {
        ("s1", "one node", 0.5), ("s1", "two nodes", 1.0), ("s2", "one node", 2.0), ("s2", "two nodes", None),
    }
    out = {tuple(r) for r in runstats.scaleout(wide, ["slice"], "one node", "two nodes", 2).collect()}
    assert out == {("s1", 2.0, 1.0), ("s2", None, None)}


def test_throughput_guards_zero(spark):
    df = spark.createDataFrame([(10, 2.0), (10, 0.0)], "n int, s double")
    assert [r[0] for r in df.select(runstats.throughput(F.col("n"), F.col("s"))).collect()] == [5.0, 0.0]


def test_labels(spark):
    df = spark.createDataFrame([("data/raw/1st-slice//", 402.4, 3_600_000), ("2nd", 9.6, 50_000_000)], "p string, m double, n long")
    name = X.last_segment(F.col("p"))
    rows = df.select(
        X.sized_label(name, F.col("m")).alias("a"),
        X.compact_millions(F.col("n")).alias("b"),
        X.code_label(name, {"2nd": "second"}).alias("c"),
        X.ordinal_in(name, ["2nd", "3rd"]).alias("d"),
    ).collect()
    assert [tuple(r) for r in rows] == [("1st-slice (402 MiB)", "3.6M", "1st-slice", 3), ("2nd (10 MiB)", "50.0M", "second", 1)]
