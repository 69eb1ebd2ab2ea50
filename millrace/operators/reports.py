"""Grouped reports over a lake table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.session import durable, session_conf


def grouped_report(
    df: DataFrame,
    keys: Sequence[str | Column],
    measures: Mapping[str, Column],
    where: Column | None = None,
    having: Column | None = None,
    order_by: Sequence[str | Column] = (),
    limit: int | None = None,
) -> DataFrame:
    """Filter, group, aggregate, filter groups, order, cut.

    Ordering plus a limit becomes a top-k that merges each task's own best rows; give
    ``order_by`` a unique tail, or ties at the cut are arbitrary.
    """
    rows = df if where is None else df.where(where)
    groups = rows.groupBy(*keys).agg(*(column.alias(name) for name, column in measures.items()))
    if having is not None:
        groups = groups.where(having)
    if order_by:
        groups = groups.orderBy(*order_by)
    return groups if limit is None else groups.limit(limit)


def month_range(df: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Rows of the months from ``first`` to ``last``; only their directories are read."""
    month = F.col("year") * 12 + F.col("month")
    return df.where(month.between(first[0] * 12 + first[1], last[0] * 12 + last[1]))


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows; on Parquet this reads footers, no column data."""
    return df.agg(F.count("*").alias("n_rows"))


def query_path(spark: SparkSession, sql: str, path: str) -> DataFrame:
    """Run SQL that names its table ``{lake}`` over the Parquet files at ``path``."""
    return spark.sql(sql, lake=spark.read.parquet(path))


#: Settings under which Spark takes counts and bounds from Parquet footers instead of reading columns.
FROM_FOOTERS = {"spark__sql__sources__useV1SourceList": "", "spark__sql__parquet__aggregatePushdown": "true"}
_BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType)


def footer_query(spark: SparkSession, path: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The aggregate behind ``footer_stats``, to be planned and run under ``FROM_FOOTERS``."""
    table = spark.read.parquet(path)
    measures = [F.count("*").alias("n_rows")]
    for c in columns:
        measures.append(F.count(c).alias(f"{c}_count"))
        if isinstance(table.schema[c].dataType, _BOUNDED):
            measures += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return table.groupBy(*by).agg(*measures)


def footer_stats(spark: SparkSession, path: str, columns: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Rows, and per column NULLs, least and greatest value, of a Parquet table, per partition value of ``by`` or in all.

    (by…, n_rows, <c>_missing, <c>_min, <c>_max), read from footers alone: the cost grows with the number of files, not
    with rows. Text and time columns have no bounds in a footer that hold exactly, so they get counts only. ``by`` may
    name partition columns only. Bounds of doubles leave out NaN, which a lake under a contract has not.
    """
    with session_conf(spark, **FROM_FOOTERS):
        found = durable(footer_query(spark, path, columns, by), "footers")
    out = []
    for c in columns:
        out.append((F.col("n_rows") - F.col(f"{c}_count")).alias(f"{c}_missing"))
        out += [F.col(f"{c}_{side}") for side in ("min", "max") if f"{c}_{side}" in found.columns]
    return found.select(*by, "n_rows", *out)
