from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import profile


def test_missing_profile_counts_orders_and_rounds(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, 1, None)], "x int, y int, z string")
    rows = [tuple(r) for r in profile.profile_missing(df).collect()]
    assert rows == [("y", 2, 66.67), ("z", 2, 66.67), ("x", 0, 0.0)]


def test_missing_profile_of_no_rows(spark):
    df = spark.createDataFrame([], "x int")
    assert [tuple(r) for r in profile.profile_missing(df).collect()] == [("x", 0, None)]


def test_partial_profiles_merge_to_the_whole(spark):
    df = spark.range(100).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("x"), (F.col("id") % 4).alias("piece"))
    parts = profile.partial_missing(df, ["x"], ["piece"])
    assert parts.count() == 4
    assert profile.merge_missing(parts, ["x"]).collect() == profile.profile_missing(df, ["x"]).collect()


def test_profile_by_group_columns(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 1.0), (2, None)], "g int, x double")
    rows = {r.g: r for r in profile.profile_by_group(df, ["g"], ["x"], "exact").collect()}
    assert (rows[1].x_count, rows[1].x_mean, rows[1].x_min, rows[1].x_max) == (2, 3.0, 2.0, 4.0)
    assert rows[None].x_median == 1.0
    assert (rows[2].x_count, rows[2].x_median) == (0, None)


def test_distinct_values_include_null(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a")], "x int, y string")
    got = {(r.column_name, r.value, r.n_rows) for r in profile.distinct_values(df, ["x", "y"]).collect()}
    assert got == {("x", "1", 2), ("x", "2", 1), ("y", "a", 2), ("y", None, 1)}


def test_conditional_counts_ignore_null(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    rows = profile.conditional_counts(df, {"neg": F.col("x") < 0, "it's": F.col("x") > 0}).collect()
    assert {(r.condition, r.n_rows) for r in rows} == {("neg", 1), ("it's", 1)}
