"""Statistics over repeated runs, and comparison of configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import literal, long_form, quoted
from millrace.operators.ordering import positions


def _spread(value: Column, name: str) -> list[Column]:
    """Average, sample standard deviation (0 for a single value), minimum and maximum."""
    deviation = F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value))
    return [
        F.avg(value).alias(f"{name}_average"),
        deviation.alias(f"{name}_standard_deviation"),
        F.min(value).alias(f"{name}_min"),
        F.max(value).alias(f"{name}_max"),
    ]


def parse_list(df: DataFrame, column: str) -> Column:
    """A list column as ``array<double>``; text such as ``"[1.0, 2]"`` is parsed as JSON.

    NULL and blank text is no list. Other text that is not a list of numbers raises an error.
    """
    if isinstance(df.schema[column].dataType, T.StringType):
        text = F.when(F.trim(column) != "", F.trim(column))
        parsed = F.from_json(text, T.ArrayType(T.StringType()))
        numbers = F.transform(parsed, lambda x: x.try_cast("double"))
        unread = text.isNotNull() & (parsed.isNull() | F.exists(F.arrays_zip(parsed.alias("s"), numbers.alias("n")), lambda z: z["s"].isNotNull() & z["n"].isNull()))
        failure = F.raise_error(F.concat(F.lit(f"not a list of numbers in {column}: "), F.substring(column, 1, 100)))
        return F.when(unread, failure.cast("array<double>")).otherwise(numbers)
    return F.col(column).cast("array<double>")


def array_stats(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Element-wise statistics of equally long lists, per group.

    Elements are spread over (group, place), so a large group is aggregated by every
    task in part and is never gathered. The arrays that come out are as long as one
    input list. Lists of different lengths within a group raise an error.
    """
    # The length is taken before the list is spread out, so that an element's row carries
    # a number and not the whole list. The outer variant keeps an empty list visible to
    # the length check.
    lists = df.select(*by, parse_list(df, column).alias("_list")).where(F.col("_list").isNotNull())
    measured = lists.withColumn("_len", F.size("_list"))
    elements = measured.select(*by, "_len", F.posexplode_outer("_list").alias("_pos", "_x"))
    cells = elements.groupBy(*by, "_pos").agg(
        *_spread(F.col("_x"), "_x"), F.min("_len").alias("_shortest"), F.max("_len").alias("_longest")
    )
    names = ["average", "standard_deviation", "min", "max"]
    row = F.struct("_pos", *(F.col(f"_x_{n}").alias(n) for n in names))
    gathered = cells.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), row))).alias("_cells"),
        F.min("_shortest").alias("_shortest"),
        F.max("_longest").alias("_longest"),
    )
    checked = F.when(F.col("_shortest") == F.col("_longest"), F.col("_cells")).otherwise(
        F.raise_error(F.lit(f"lists in {column} differ in length"))
    )
    return gathered.withColumn("_cells", checked).select(
        *by, *(F.col("_cells")[n].alias(f"{column}_{n}") for n in names)
    )


def run_summary(
    df: DataFrame,
    order_by: Sequence[Column | str],
    numeric: Sequence[str],
    keep: Sequence[str] = (),
    lists: Sequence[str] = (),
    within: Sequence[str] = (),
    size: int = 3,
    where: Column | None = None,
) -> DataFrame:
    """Summarise every ``size`` consecutive rows of an ordered table of runs.

    ``keep`` columns take the value of a bucket's first row. Numeric text is cast and
    what is no number is ignored. Buckets are numbered from 1, over the whole table or
    per ``within`` key.
    """
    runs = df if where is None else df.where(where)
    # Only the columns that take part are sorted and stored; the hash of all stands for the others in ties.
    hashable = [s.name for s in runs.schema if not isinstance(s.dataType, (T.MapType, T.VariantType))]
    ordered = [c.alias(f"_by{i}") if isinstance(c, Column) else F.col(c).alias(f"_by{i}") for i, c in enumerate(order_by)]
    wanted = list(dict.fromkeys([*within, *keep, *numeric, *lists]))
    plain = all(isinstance(c, str) for c in order_by)
    if plain:
        runs = runs.select(*wanted, *ordered, F.xxhash64(*hashable).alias("_tie"))
        order_by = [*(f"_by{i}" for i in range(len(order_by))), "_tie"]
    placed = positions(runs, order_by, within, "_place")
    bucketed = placed.withColumn("bucket", F.expr(f"_place div {int(size)} + 1"))
    key = [*within, "bucket"]
    summary = bucketed.groupBy(*key).agg(
        *(F.min_by(k, "_place").alias(k) for k in keep if k not in key),
        *(s for n in numeric for s in _spread(F.col(n).try_cast("double"), n)),
        F.count("*").alias("rows_in_group"),
    )
    for column in lists:
        stats = array_stats(bucketed, key, column)
        match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
        summary = (
            summary.alias("a")
            .join(stats.alias("b"), match, "left")
            .select("a.*", *(F.col(f"b.{c}") for c in stats.columns if c not in key))
        )
    return summary


def pivot_mean(df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], metric: str) -> DataFrame:
    """Mean of a metric: one row per index, one column per configuration.

    The configurations are given, so Spark needs no extra job to find them.
    """
    return df.groupBy(*index).pivot(column, list(values)).agg(F.avg(metric))


def relative_speedup(
    pivoted: DataFrame, index: Sequence[str], baselines: Sequence[str], configurations: Sequence[str]
) -> DataFrame:
    """Baseline time over each configuration's time, in long form.

    The baseline is the first of several columns that has a value.
    """
    base = ", ".join(quoted(b) for b in baselines)
    return pivoted.select(
        *index,
        long_form(
            configuration=[literal(c) for c in configurations],
            relative_speedup=[f"try_divide(coalesce({base}), {quoted(c)})" for c in configurations],
        ),
    )


def scaleout(pivoted: DataFrame, index: Sequence[str], one: str, many: str, nodes: int) -> DataFrame:
    """Speedup from one node to several, and how much of the added hardware it used."""
    speedup = F.try_divide(F.col(quoted(one)), F.col(quoted(many)))
    return pivoted.select(
        *index, speedup.alias("scaleout_speedup"), (speedup / F.lit(float(nodes))).alias("scaleout_efficiency")
    )


def throughput(rows: Column, seconds: Column) -> Column:
    """Rows per second; zero when no time was measured."""
    return F.when(seconds > 0, rows / seconds).otherwise(F.lit(0.0))
