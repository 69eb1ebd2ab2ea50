from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.operators import ordering, profile


def test_positions_over_the_whole_table(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = {r.v: r.position for r in ordering.positions(df, ["v"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_positions_within_keys_one_of_them_hot(spark):
    rnd = random.Random(2)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 5}", rnd.random(), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, x double, i int").repartition(6)
    expected = {}
    for key in {r[0] for r in rows}:
        for place, row in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))):
            expected[row[2]] = place
    got = ordering.positions(df, [F.desc("x"), "i"], ["k"]).collect()
    assert {r.i: r.position for r in got} == expected
    assert len(got) == len(rows)


def test_a_hot_key_is_sorted_by_several_tasks(spark):
    df = spark.range(20_000).withColumn("k", F.lit(1))
    with_blocks = ordering._sorted_blocks(df, ["k", "id"])
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        with_blocks = ordering._sorted_blocks(df, ["k", "id"])
        assert with_blocks.select("_block").distinct().count() > 1
        numbered = ordering.positions(df, ["id"], ["k"])
        assert numbered.where("position <> id").count() == 0
    finally:
        spark.conf.unset(conf)


def test_tied_rows_are_numbered_once_and_the_same_way(spark):
    df = spark.range(2000).select("id", F.lit(1).alias("same"))
    one = {r.id: r.position for r in ordering.positions(df, ["same"]).collect()}
    two = {r.id: r.position for r in ordering.positions(df.repartition(7), ["same"]).collect()}
    assert one == two and sorted(one.values()) == list(range(2000))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    groups=st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5), st.just(float("nan")))),
        min_size=1,
        max_size=40,
    ),
    p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]),
)
def test_quantiles_agree_with_numpy(spark, groups, p):
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in groups], "g string, x double")
    got = {r.g: r.value for r in ordering.exact_quantiles(df, ["x"], [p], ["g"]).collect()}
    expected = {}
    for key in {g for g, _ in groups}:
        values = [float(v) for g, v in groups if g == key and v is not None and v == v]
        if values:
            expected[key] = pytest.approx(float(np.quantile(values, p)))
    assert got == expected


def test_medians_of_even_and_single_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 9.0)], "g string, x double")
    exact = {r.g: r for r in profile.profile_by_group(df, ["g"], ["x"], "exact").collect()}
    assert (exact["a"].x_median, exact["b"].x_median, exact["b"].x_stddev) == (2.5, 9.0, None)
    approx = {r.g: r for r in profile.profile_by_group(df, ["g"], ["x"], "approx").collect()}
    assert approx["a"].x_median == 2.0
    assert profile.profile_by_group(df, ["g"], ["x"], "exact").columns == list(approx["a"].asDict())
    with pytest.raises(ValueError):
        profile.profile_by_group(df, ["g"], ["x"], "guess")


def test_sample_is_fixed_by_the_key(spark):
    df = spark.range(1000)
    first = {r.id for r in ordering.fixed_sample(df, 50).collect()}
    again = {r.id for r in ordering.fixed_sample(df.repartition(9), 50).collect()}
    assert len(first) == 50 and first == again
    assert {r.id for r in ordering.fixed_sample(df, 50, seed=7).collect()} != first
    assert ordering.fixed_sample(df, 5000).count() == 1000
    assert ordering.fixed_sample(df.limit(0), 5).count() == 0


@pytest.mark.parametrize("n", [1, 7, 50, 999, 1000])
def test_sample_is_the_lowest_draws(spark, n):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("lot"))
    got = [(r.lot, r.id) for r in ordering.fixed_sample(df, n, key=["id"], draw=F.col("lot")).collect()]
    assert got == sorted((i * 37 % 101, i) for i in range(1000))[:n]


def test_few_rows_compete_for_a_sample(spark):
    df = spark.range(100_000)
    plan = ordering.fixed_sample(df, 50)._jdf.queryExecution()
    assert "TakeOrderedAndProject" in plan.executedPlan().toString()
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(42), "id"), 1)
    ids = {r.id for r in ordering.fixed_sample(df, 50).collect()}
    assert ids == {r.id for r in df.orderBy(lot).limit(50).collect()}


def test_describe_matches_a_literal(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "x double")
    row = profile.describe(df, ["x"], exact=True).collect()[0]
    assert (row.n, row.mean, row.min, row.q25, row.median, row.q75, row.max) == (4, 2.5, 1.0, 1.75, 2.5, 3.25, 4.0)
    rough = profile.describe(df, ["x"]).collect()[0]
    assert (rough.q25, rough.median, rough.q75) == (1.0, 2.0, 3.0)
