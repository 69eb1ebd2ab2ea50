"""Triangular factors: one fit from pieces, and more digits than products of the variables leave."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import regression
from millrace.streaming import incremental


def _frame(spark, x: np.ndarray, y: np.ndarray, pieces: int = 4):
    rows = [(*map(float, r), float(t), None if i % pieces == 0 else f"p{i % pieces}") for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", y double, piece string").repartition(5)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    x = rng.normal([50, -3, 1998], [10, 2, 1.5], size=(900, 3))
    y = 2.5 + x @ [0.3, -1.2, 0.05] + rng.normal(0, 0.5, 900)
    return x, y, _frame(spark, x, y)


NAMES = ["x0", "x1", "x2"]


def test_factor_is_that_of_the_centred_rows(sample):
    x, y, df = sample
    row = regression.factors(df, NAMES, "y").first()
    both = np.column_stack([x, y])
    r = np.array(row.factor).reshape(4, 4)
    assert row.n == 900 and np.add(row.origin, row.offset) == pytest.approx(both.mean(axis=0))
    assert np.allclose(r, np.triu(r))
    assert np.allclose(r.T @ r, (both - both.mean(axis=0)).T @ (both - both.mean(axis=0)))


def test_pieces_merge_to_the_one_fit(sample):
    x, y, df = sample
    design = np.column_stack([np.ones(900), x])
    exact = np.linalg.lstsq(design, y, rcond=None)[0]
    pieces = regression.factors(df, NAMES, "y", ["piece"])
    assert sorted((r.piece or "", r.n) for r in pieces.collect()) == [("", 225), ("p1", 225), ("p2", 225), ("p3", 225)]
    for table in (regression.factors(df, NAMES, "y"), regression.merge_factors(pieces)):
        model = regression.solve_factor(table, NAMES, "y")
        assert (model.intercept, *model.coefficients) == pytest.approx(tuple(exact), rel=1e-9)
    with pytest.raises(ValueError, match="merge them first"):
        regression.solve_factor(pieces, NAMES, "y")


def test_condition_is_not_squared(spark):
    """Two features that differ in the seventh digit: R still tells them apart, R'R does not."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=2000)
    b = a + 1e-7 * rng.normal(size=2000)
    x = np.column_stack([a, b, 1.7e9 + rng.random(2000)])
    y = 3 * a - 2 * b + 2 * (x[:, 2] - 1.7e9)
    model = regression.solve_factor(regression.factors(_frame(spark, x, y), NAMES, "y"), NAMES, "y")
    assert model.coefficients == pytest.approx((3, -2, 2), abs=1e-4)


def test_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 7.0, 2.0), (2.0, 7.0, 4.0), (4.0, 7.0, 8.0), (None, 7.0, 1.0), (3.0, 7.0, float("nan"))], "a double, fixed double, y double")
    model = regression.solve_factor(regression.factors(df, ["a", "fixed"], "y"), ["a", "fixed"], "y")
    assert model.coefficients == pytest.approx((2.0, 0.0)) and model.intercept == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ValueError, match="no rows"):
        regression.solve_factor(regression.factors(df.limit(0), ["a"], "y"), ["a"], "y")
    alone = regression.solve_factor(regression.factors(df.limit(1), ["a"], "y"), ["a"], "y")
    assert (alone.coefficients, alone.intercept) == ((0.0,), 2.0)


def test_factors_of_batches(spark, sample, tmp_path):
    _, _, df = sample
    landing, root, progress = (str(tmp_path / d) for d in ("in", "factors", "progress"))
    df.write.parquet(landing)

    def learn():
        stream = incremental.file_stream(spark, landing, df.schema, max_files=2, format="parquet")
        return incremental.learn_available(stream, root, progress, lambda rows: rows, NAMES, "y", keep="factors")

    whole = regression.solve_factor(regression.factors(df, NAMES, "y"), NAMES, "y")
    assert regression.solve_factor(learn(), NAMES, "y").coefficients == pytest.approx(whole.coefficients, rel=1e-9)
    df.where("x0 > 50").write.mode("append").parquet(landing)
    more = regression.solve_factor(regression.factors(df.unionByName(df.where("x0 > 50")), NAMES, "y"), NAMES, "y")
    assert regression.solve_factor(learn(), NAMES, "y").coefficients == pytest.approx(more.coefficients, rel=1e-9)
    assert spark.read.parquet(root).select(F.sum("n")).first()[0] == 900 + df.where("x0 > 50").count()
    with pytest.raises(ValueError, match="keep is"):
        incremental.learn_available(df, root, progress, lambda rows: rows, NAMES, "y", keep="sums")
