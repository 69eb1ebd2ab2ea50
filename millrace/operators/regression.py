"""Linear regression: preparation, MLlib, one-pass metrics, and mergeable moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import elapsed, speed_per_hour
from millrace.session import durable


def calendar_features(df: DataFrame, start: str, end: str, distance: str, prefixes: tuple[str, str]) -> DataFrame:
    """Replace two timestamps by hour, day, weekday (1 = Sunday), duration and speed."""
    added: dict[str, Column] = {}
    for moment, prefix in zip((start, end), prefixes):
        added[f"{prefix}_hour"] = F.hour(moment).cast("byte")
        added[f"{prefix}_day"] = F.dayofmonth(moment).cast("byte")
        added[f"{prefix}_weekday"] = F.dayofweek(moment).cast("byte")
    added["trip_duration_sec"] = elapsed(start, end).cast("bigint")
    added["trip_speed"] = speed_per_hour(distance, start, end)
    return df.withColumns(added).drop(start, end)


def split_by_key(df: DataFrame, key: Sequence[str] | Column, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``. A row's side depends on its key only, not on partitioning or retries.

    ``key`` is a list of columns to hash, or an integer column whose value modulo 1000 decides.
    Hashes split to one part in 2^30; with a column of one's own the share must be whole thousandths.
    """
    if not 0 < test_share < 1:
        raise ValueError("test_share must lie between 0 and 1")
    own = isinstance(key, Column)
    draw, steps = (key, 1000) if own else (F.xxhash64(F.lit(seed), *key), 1 << 30)
    cut = round(test_share * steps)
    if cut in (0, steps) or (own and abs(cut - test_share * steps) > 1e-6):
        raise ValueError(f"a share of {test_share} is too fine for {steps} steps")
    return df.withColumn("is_test", F.pmod(draw, F.lit(steps)) < F.lit(cut))


def ols_estimator(features: Sequence[str], label: str) -> Pipeline:
    """Assemble, standardise (statistics of the training rows only) and fit least squares."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="features_raw", handleInvalid="error"),
            StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True),
            LinearRegression(featuresCol="features", labelCol=label, predictionCol="prediction"),
        ]
    )


def fit_predict(df: DataFrame, features: Sequence[str], label: str) -> tuple[PipelineModel, DataFrame]:
    """Fit on the rows with ``is_test = false`` and predict the others.

    The rows are stored first: scaler and solver pass over them again, and what leads to them need not run for each.
    """
    columns = [*features, label]
    df = durable(df, "model-rows")
    train = df.where(~F.col("is_test")).select(*columns)
    model = ols_estimator(features, label).fit(train)
    return model, model.transform(df.where(F.col("is_test")))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MAE, RMSE and R2 in one aggregate."""
    error = F.col(label) - F.col(prediction)
    squares = F.sum(error * error)
    spread = F.var_pop(label) * F.count(label)
    return df.where(error.isNotNull()).agg(
        F.count("*").alias("n_rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(squares, spread)).alias("r2"),
    )


# --- triangular factors ------------------------------------------------------------------


#: Factors that one task merges, in the first of two rounds as a share of all.
FAN_IN = 256
_FACTOR = "n bigint, origin array<double>, offset array<double>, factor array<double>"
_Part = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def _stacked(parts: Sequence[_Part]) -> _Part:
    """(n, origin, offset, R) of several disjoint sets of rows from theirs.

    The spread of all rows is that of each set and that of the sets' means, so its factor is that of the factors stacked
    on the weighted distances of the means. A mean is a row's own values (the origin) and a small offset: rounded to one
    number, means far from zero would be too coarse to subtract from each other.
    """
    if len(parts) == 1:
        return parts[0]
    n, origin = sum(p[0] for p in parts), parts[0][1]
    weights = np.array([p[0] for p in parts], float)
    offsets = np.array([(p[1] - origin) + p[2] for p in parts])
    middle = weights @ offsets / n
    rows = np.vstack([*(p[3] for p in parts), np.sqrt(weights)[:, None] * (offsets - middle)])
    return n, origin, middle, _triangle(rows)


def _triangle(rows: np.ndarray) -> np.ndarray:
    missing = max(0, rows.shape[1] - len(rows))
    return np.linalg.qr(np.pad(rows, ((0, missing), (0, 0))), mode="r")


def factors(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, n, origin, offset, factor): means, as origin + offset, and the triangular factor R of the centred rows.

    They are of the features and, last, the label.

    A tall-skinny QR: every task reduces its rows, an Arrow batch at a time, to one triangle a group, and triangles are
    merged in two rounds. R'R is the spread of the rows, but it is never formed, so the condition of the problem is not
    squared. Disjoint pieces merge with ``merge_factors``. Rows with a NULL or NaN in any variable are left out; a group
    without rows has no factor. Grouping columns must hold plain values (numbers, texts, dates).
    """
    names = [*features, label]
    k = len(names)
    ready = df.select(*by, *(F.col(n).cast("double").alias(f"_v{i}") for i, n in enumerate(names))).dropna(subset=[f"_v{i}" for i in range(k)])
    schema = T.StructType([*(ready.schema[b] for b in by), *T.StructType.fromDDL(_FACTOR)])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Part] = {}
        kinds: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            keys = [pa.array([g[i] for g in held], kind) for i, kind in enumerate(kinds)]
            values = list(held.values())
            lists = [pa.array([v[i].ravel() for v in values], pa.list_(pa.float64())) for i in (1, 2, 3)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([v[0] for v in values], pa.int64()), *lists], names=[*by, "n", "origin", "offset", "factor"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(i).type for i in range(len(by))]
            x = np.column_stack([batch.column(len(by) + i).to_numpy(zero_copy_only=False) for i in range(k)])
            groups: dict[tuple, np.ndarray | slice] = {(): slice(None)}
            if by:
                places: dict[tuple, list[int]] = {}
                for at, group in enumerate(zip(*(batch.column(i).to_pylist() for i in range(len(by))))):
                    places.setdefault(group, []).append(at)
                groups = {g: np.array(p) for g, p in places.items()}
            for group, rows in groups.items():
                origin = x[rows][0]
                part = x[rows] - origin
                offset = part.mean(axis=0)
                new = (len(part), origin, offset, _triangle(part - offset))
                held[group] = _stacked([held[group], new]) if group in held else new
            if len(held) > 4096:
                yield out()
                held = {}
        if held:
            yield out()

    return merge_factors(ready.mapInArrow(reduced, schema), by)


def merge_factors(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The factors of disjoint pieces as one (per group). Two rounds, so that no task merges those of all pieces."""
    schema = T.StructType([*(parts.schema[b] for b in by), *T.StructType.fromDDL(_FACTOR)])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        k = len(group["origin"].iloc[0])
        each = zip(group["n"], group["origin"], group["offset"], group["factor"])
        n, origin, offset, r = _stacked([(int(n), np.asarray(a), np.asarray(b), np.asarray(f).reshape(k, k)) for n, a, b, f in each])
        return pd.DataFrame({**{b: [group[b].iloc[0]] for b in by}, "n": [n], "origin": [origin], "offset": [offset], "factor": [r.ravel()]})

    share = F.pmod(F.xxhash64("offset", "factor"), F.lit(FAN_IN)).alias("_share")
    first = parts.select(*by, "n", "origin", "offset", "factor").groupBy(*by, share).applyInPandas(merge, schema)
    return first.groupBy(*by or [F.lit(0).alias("_all")]).applyInPandas(merge, schema)


def solve_factor(table: DataFrame, features: Sequence[str], label: str) -> LinearModel:
    """Least squares from the one factor of a table; its size depends on the number of features.

    Constant features get weight zero. Among features that depend on each other the smallest weights are taken.
    """
    rows = table.take(2)
    if len(rows) != 1 or not rows[0].n:
        raise ValueError("no rows to learn from" if not rows else "one factor is needed: merge them first")
    k = len(features)
    r, means = np.asarray(rows[0].factor).reshape(k + 1, k + 1), np.add(rows[0].origin, rows[0].offset)
    scale = np.linalg.norm(r[:, :k], axis=0)
    usable = scale > 1e-12 * np.sqrt(rows[0].n) * np.maximum(np.abs(means[:k]), 1e-300)
    weights = np.zeros(k)
    if usable.any():
        weights[usable] = np.linalg.lstsq(r[:k, :k][:, usable] / scale[usable], r[:k, k], rcond=1e-12)[0] / scale[usable]
    return LinearModel(tuple(features), tuple(float(w) for w in weights), float(means[k] - weights @ means[:k]))


# --- moments ---------------------------------------------------------------------------


def moments(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    shift: Sequence[float] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by…, left_name, right_name, value): sums of products of all pairs of variables.

    The constant 1 is a variable too, so counts, sums and products are all here, and
    moments of disjoint pieces merge by addition. ``shift`` is subtracted from each
    variable first (any point near the means keeps the sums small); pieces to be
    merged must share it. The table has (k+2)(k+3)/2 rows for k features.

    MLlib's polynomial expansion of degree two is exactly the list of sums and
    products wanted, and its summarizer adds vectors up with partial aggregation.
    """
    names = [*features, label]
    offsets = list(shift or [0.0] * len(names))
    shifted = (F.col(n).cast("double") - F.lit(float(o)) for n, o in zip(names, offsets, strict=True))
    centred = df.select(*by, *(column.alias(f"_v{i}") for i, column in enumerate(shifted)))
    vectors = VectorAssembler(inputCols=[f"_v{i}" for i in range(len(names))], outputCol="_x").transform(centred)
    terms = PolynomialExpansion(degree=2, inputCol="_x", outputCol="_terms").transform(vectors)
    # Grouping by a constant yields no row for no input, which the summarizer cannot sum.
    totals = terms.groupBy(*by or [F.lit(0).alias("_all")]).agg(Summarizer.metrics("count", "sum").summary(F.col("_terms")).alias("_s"))
    # The expansion lists, for each variable, the variable and then its products with
    # those up to and including itself.
    order = [pair for j, name in enumerate(names) for pair in (("1", name), *((n, name) for n in names[: j + 1]))]
    pairs = [("1", "1"), *order]
    values = F.concat(F.array(F.col("_s.count").cast("double")), vector_to_array("_s.sum"))
    return totals.select(*by, F.posexplode(values).alias("_place", "value")).select(
        *by,
        *(
            F.element_at(F.array(*(F.lit(p[side]) for p in pairs)), F.col("_place") + 1).alias(name)
            for side, name in enumerate(("left_name", "right_name"))
        ),
        "value",
    )


def merge_moments(partials: DataFrame) -> DataFrame:
    """Add up the moments of disjoint pieces."""
    return partials.groupBy("left_name", "right_name").agg(F.sum("value").alias("value"))


def centred_moments(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, left_name, right_name, n, left_mean, right_mean, comoment) of all pairs of variables.

    They are read off the triangular factor of the centred rows (see ``factors``), so variables far from zero (years,
    seconds since 1970) keep their digits. Rows with a NULL in any variable are left out, as least squares needs.
    """
    names = [*features, label]
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    whole = factors(df, features, label, by)

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                r = np.asarray(row["factor"]).reshape(k, k)
                products, means = r.T @ r, np.add(row["origin"], row["offset"])
                yield pd.DataFrame(
                    {
                        **{b: [row[b]] * len(pairs) for b in by}, "left_name": [names[i] for i, _ in pairs], "right_name": [names[j] for _, j in pairs],
                        "n": row["n"], "left_mean": [means[i] for i, _ in pairs], "right_mean": [means[j] for _, j in pairs],
                        "comoment": [products[i, j] for i, j in pairs],
                    }
                )

    keys = [whole.schema[b] for b in by]
    schema = T.StructType([*keys, *T.StructType.fromDDL("left_name string, right_name string, n bigint, left_mean double, right_mean double, comoment double")])
    return whole.mapInPandas(spread, schema)


def merge_centred(partials: DataFrame) -> DataFrame:
    """The centred moments of disjoint pieces together: their own, and those of their means."""
    pair = ["left_name", "right_name"]
    near = partials.groupBy(*pair).agg(F.min("left_mean").alias("_l"), F.min("right_mean").alias("_r"))
    shifted = partials.join(near, pair).withColumns({"_dl": F.col("left_mean") - F.col("_l"), "_dr": F.col("right_mean") - F.col("_r")})
    n = F.sum("n")
    left, right = F.sum(F.col("n") * F.col("_dl")) / n, F.sum(F.col("n") * F.col("_dr")) / n
    between = F.sum(F.col("n") * F.col("_dl") * F.col("_dr")) - n * left * right
    return shifted.groupBy(*pair).agg(n.alias("n"), (F.first("_l") + left).alias("left_mean"), (F.first("_r") + right).alias("right_mean"), (F.sum("comoment") + between).alias("comoment"))


def solve_centred(table: DataFrame, features: Sequence[str], label: str) -> LinearModel:
    """Least squares from a table of centred moments; its size depends on the number of features."""
    names = [*features, label]
    place = {n: i for i, n in enumerate(names)}
    spread, means, n = np.zeros((len(names), len(names))), np.zeros(len(names)), 0
    for row in table.collect():
        i, j = place[row.left_name], place[row.right_name]
        spread[i, j] = spread[j, i] = row.comoment
        means[i], means[j], n = row.left_mean, row.right_mean, row.n
    if n == 0:
        raise ValueError("no rows to learn from")
    scale = np.sqrt(np.clip(np.diag(spread)[:-1], 0, None))
    usable = scale > 1e-12 * np.sqrt(n) * np.maximum(np.abs(means[:-1]), 1e-300)
    return _solved(features, spread, means, scale, usable)


def _solved(features: Sequence[str], spread: np.ndarray, means: np.ndarray, scale: np.ndarray, usable: np.ndarray) -> LinearModel:
    k = len(features)
    weights = np.zeros(k)
    if usable.any():
        s = scale[usable]
        correlation = spread[:k, :k][np.ix_(usable, usable)] / np.outer(s, s)
        weights[usable] = np.linalg.lstsq(correlation, spread[:k, k][usable] / s, rcond=1e-12)[0] / s
    return LinearModel(tuple(features), tuple(float(w) for w in weights), float(means[k] - weights @ means[:k]))


@dataclass(frozen=True)
class LinearModel:
    """Coefficients on the original scale of the features."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        score = F.lit(self.intercept)
        for feature, weight in zip(self.features, self.coefficients):
            score = score + F.col(feature) * F.lit(weight)
        return df.withColumn(name, score)


def solve_moments(
    table: DataFrame, features: Sequence[str], label: str, shift: Sequence[float] | None = None
) -> LinearModel:
    """Least squares from a moment table.

    Only the table, whose size depends on the number of features, reaches the driver.
    Constant features get weight zero, as in standardised least squares.
    """
    names = ["1", *features, label]
    place = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for row in table.collect():
        i, j = place[row.left_name], place[row.right_name]
        m[i, j] = m[j, i] = row.value
    n = m[0, 0]
    if n == 0:
        raise ValueError("no rows to learn from")
    means = m[0, 1:] / n
    spread = m[1:, 1:] - n * np.outer(means, means)
    k = len(features)
    scale = np.sqrt(np.clip(np.diag(spread)[:k], 0, None))
    raw = np.clip(np.diag(m)[1 : k + 1], 1e-300, None)
    # What is left after subtracting must not be rounding: below this the sums have too few digits to tell.
    lost = (np.diag(spread)[:k] != 0) & (np.abs(np.diag(spread)[:k]) < 1e-10 * raw)
    if lost.any():
        names_lost = [f for f, bad in zip(features, lost, strict=True) if bad]
        raise ValueError(f"the sums of {names_lost} have lost their digits: give a shift near the means, or use centred_moments")
    offsets = np.array(shift if shift is not None else [0.0] * (k + 1))
    return _solved(features, spread, means + offsets, scale, scale > 0)
