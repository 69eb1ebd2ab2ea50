from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import regression


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(3)
    x = rng.normal([50, -3, 1998], [10, 2, 1.5], size=(600, 3))
    y = 2.5 + x @ [0.3, -1.2, 0.05] + rng.normal(0, 0.5, 600)
    rows = [(int(i), *map(float, r), 7.0, float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, fixed double, y double").repartition(5)


def test_moments_give_the_same_model_as_mllib(samples):
    features = ["a", "b", "c", "fixed"]
    split = regression.split_by_key(samples, ["id"])
    model, predicted = regression.fit_predict(split, features, "y")
    shift = [45.0, 0.0, 1990.0, 0.0, 100.0]
    train = split.where("not is_test").withColumn("piece", F.col("id") % 4)
    table = regression.merge_moments(regression.moments(train, features, "y", shift, ["piece"]))
    own = regression.solve_moments(table, features, "y", shift)
    both = own.predict(predicted, "own").select("prediction", "own").collect()
    assert len(both) > 50
    assert [r.own for r in both] == pytest.approx([r.prediction for r in both], abs=1e-6)
    assert own.coefficients[3] == 0.0


def test_exact_line_is_found(spark):
    df = spark.range(50).select((F.col("id") * 1.0).alias("x"), (F.col("id") * 3.0 - 4.0).alias("y"))
    model = regression.solve_moments(regression.moments(df, ["x"], "y"), ["x"], "y")
    assert (model.coefficients[0], model.intercept) == pytest.approx((3.0, -4.0))
    scores = regression.regression_metrics(model.predict(df), "y", "prediction").collect()[0]
    assert (scores.n_rows, scores.mae, scores.r2) == (50, pytest.approx(0, abs=1e-9), pytest.approx(1.0))


def test_moment_table_is_every_pair(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "a double, b double, y double")
    got = {(r.left_name, r.right_name): r.value for r in regression.moments(df, ["a", "b"], "y").collect()}
    assert got == {
        ("1", "1"): 2, ("1", "a"): 5, ("1", "b"): 7, ("1", "y"): 9, ("a", "a"): 17, ("a", "b"): 22,
        ("b", "b"): 29, ("a", "y"): 27, ("b", "y"): 36, ("y", "y"): 45,
    }


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "x double, y double")
    with pytest.raises(ValueError):
        regression.solve_moments(regression.moments(df, ["x"], "y"), ["x"], "y")


def test_split_depends_on_the_key_alone(samples):
    one = {r.id for r in regression.split_by_key(samples, ["id"]).where("is_test").collect()}
    two = {r.id for r in regression.split_by_key(samples.repartition(11), ["id"]).where("is_test").collect()}
    assert one == two and 80 < len(one) < 160
    assert {r.id for r in regression.split_by_key(samples, ["id"], seed=1).where("is_test").collect()} != one


def test_metrics_against_numpy(spark):
    y, f = np.array([1.0, 2.0, 4.0]), np.array([1.5, 2.0, 3.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, f)] + [(None, 1.0)], "y double, f double")
    row = regression.regression_metrics(df, "y", "f").collect()[0]
    assert row.n_rows == 3
    assert row.mae == pytest.approx(np.abs(y - f).mean())
    assert row.rmse == pytest.approx(np.sqrt(((y - f) ** 2).mean()))
    assert row.r2 == pytest.approx(1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_calendar_features(spark):
    at = dt.datetime(2024, 6, 2, 23, 59)  # a Sunday
    df = spark.createDataFrame(
        [(at, at + dt.timedelta(minutes=30), 5.0), (at, at, 5.0)], "s timestamp, e timestamp, d double"
    )
    first, still = regression.calendar_features(df, "s", "e", "d", ("in", "out")).collect()
    assert (first.in_hour, first.in_day, first.in_weekday, first.out_hour, first.out_weekday) == (23, 2, 1, 0, 2)
    assert (first.trip_duration_sec, first.trip_speed) == (1800, 10.0)
    assert (still.trip_duration_sec, still.trip_speed) == (0, None)


def test_the_side_of_a_trip_filters_the_scan(spark, tmp_path):
    from checks.trips import trips
    from millrace.plans import taxi

    path = str(tmp_path / "lake")
    taxi.clean_kept(trips(spark, "/root/testdata/sf0.001")).write.parquet(path)
    split = taxi.split_model_rows(spark.read.parquet(path))
    features = taxi.feature_names(split)
    assert len(features) == 15 and "is_test" not in features
    n, test = split.count(), split.where("is_test").count()
    assert n == taxi.model_rows(spark.read.parquet(path)).count() and 0.1 < test / n < 0.3
    model, predicted = regression.fit_predict(split, features, taxi.ML_TARGET)
    scores = regression.regression_metrics(predicted, taxi.ML_TARGET, "prediction").collect()[0]
    assert scores.n_rows == test and scores.rmse < 5
