"""Row positions, exact quantiles and fixed-size samples over tables of any size.

A window ordered over a whole table, or over one large group, runs in a single task.
Here the table is sorted by ranges instead, so a group that holds a third of the rows
spreads over many tasks, and only one small row per (group, task) is needed to turn
places within a task into places within the group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.functions import literal, long_form, quoted
from millrace.session import durable

# monotonically_increasing_id puts the task number above 33 bits of row number.
_ROW_BITS = 33


def _sorted_blocks(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-sort and number the rows of every task, then make the result durable.

    The numbers are only meaningful together with the very rows they were given to, so
    the sorted table is stored: a recomputed task could cut the ranges elsewhere.
    """
    numbered = df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    return durable(numbered.withColumn("_block", F.shiftright("_slot", _ROW_BITS)))


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    """NULL-safe equality on several columns of two aliased tables."""
    return reduce(and_, (F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names))


def positions(
    df: DataFrame,
    order_by: Sequence[Column | str],
    within: Sequence[str] = (),
    name: str = "position",
) -> DataFrame:
    """Zero-based position of each row in a total order, over the table or per key.

    Rows that tie in ``order_by`` are ordered by a hash of all their columns. So the
    result does not depend on partitioning, and many tied rows do not end in one task.
    """
    hashable = [s.name for s in df.schema if not isinstance(s.dataType, (T.MapType, T.VariantType))]
    rows = _sorted_blocks(df, [*within, *order_by, F.xxhash64(*hashable)])
    keys = [*within, "_block"]
    blocks = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_slot").alias("_first"))
    # One row per key and task; a key meets at most as many tasks as the sort has.
    before = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("b._before") + F.col("r._slot") - F.col("b._first")
    return (
        rows.alias("r")
        .join(offsets.alias("b"), _same("r", "b", keys))
        .select(*(F.col(f"r.{c}") for c in df.columns), place.alias(name))
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Interpolated quantiles: (by…, column_name, probability, value), no sketch involved.

    Equal values are counted first, so what is sorted is a histogram rather than the
    table. NULL and NaN are left out. A group without values yields no row.
    """
    pairs = df.select(
        *by,
        long_form(
            column_name=[literal(c) for c in columns],
            value=[f"CAST({quoted(c)} AS DOUBLE)" for c in columns],
        ),
    ).where(F.col("value").isNotNull() & ~F.isnan("value"))
    group = [*by, "column_name"]
    counts = pairs.groupBy(*group, "value").agg(F.count("*").alias("_n"))
    rows = _sorted_blocks(counts, [*group, "value"])

    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*group, "_block").agg(F.sum("_n").alias("_size")).withColumns(
        {
            "_before": F.coalesce(F.sum("_size").over(earlier), F.lit(0)),
            "_total": F.sum("_size").over(whole),
        }
    )
    # Interpolation needs the values at two neighbouring ranks per probability.
    targets = F.array(
        *(
            F.struct(
                F.lit(float(p)).alias("probability"),
                F.lit(side).alias("side"),
                rounding((F.col("_total") - 1) * F.lit(float(p))).cast("bigint").alias("rank"),
            )
            for p in probabilities
            for side, rounding in (("low", F.floor), ("high", F.ceil))
        )
    )
    inside = F.filter(
        targets, lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("_size"))
    )
    needed = blocks.withColumn("_targets", inside).where(F.size("_targets") > 0)

    keys = [*group, "_block"]
    in_block = Window.partitionBy(*(f"r.{k}" for k in keys)).orderBy("r.value")
    upto = F.col("b._before") + F.sum("r._n").over(in_block)
    found = (
        rows.alias("r")
        .join(needed.alias("b"), _same("r", "b", keys))
        .select(*(F.col(f"r.{c}") for c in [*group, "value", "_n"]), "b._total", "b._targets", upto.alias("_upto"))
        .withColumn(
            "_hit",
            F.explode(
                F.filter(
                    "_targets",
                    lambda t: (t["rank"] < F.col("_upto")) & (t["rank"] >= F.col("_upto") - F.col("_n")),
                )
            ),
        )
    )
    side = {s: F.max(F.when(F.col("_hit.side") == s, F.col("value"))) for s in ("low", "high")}
    ends = found.groupBy(*group, F.col("_hit.probability").alias("probability")).agg(
        side["low"].alias("_low"), side["high"].alias("_high"), F.first("_total").alias("_total")
    )
    spot = (F.col("_total") - 1) * F.col("probability")
    share = spot - F.floor(spot)
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * share
    return ends.select(*group, "probability", value.alias("value"))


def exact_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with a ``<column>_median`` for every column."""
    medians = exact_quantiles(df, columns, [0.5], by)
    return medians.groupBy(*by).agg(
        *(F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(f"{c}_median") for c in columns)
    )


def fixed_sample(
    df: DataFrame,
    n: int,
    key: Sequence[str] | None = None,
    seed: int = 42,
    draw: Column | None = None,
) -> DataFrame:
    """The ``n`` rows with the lowest draw, or every row if there are fewer.

    The draw is a hash of the key (or a given whole number; rows whose draw is NULL come last,
    negative ones first), so the same rows come out however the table is partitioned, unlike
    with a Bernoulli sample. Counting the draws is a job of its own that runs at once, and ``df`` is
    evaluated twice: pass stored rows.

    A plain top-k would send ``n`` rows from every task to the driver, too many when
    there are many tasks. So the rows are first counted by the magnitude of their draw,
    and only those of the lowest magnitudes that hold ``n`` rows, about ``2n`` of them
    for a hash, take part.
    """
    names = list(key or df.columns)
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 1) if draw is None else draw
    # -1 for negative draws, 64 for none, so at most 66 rows are counted.
    magnitude = F.when(lot.isNull(), 64).when(lot < 0, -1).otherwise(F.floor(F.log2(lot + F.lit(1.0)))).cast("int")
    sizes = sorted(tuple(r) for r in df.groupBy(magnitude.alias("m")).agg(F.count("*").alias("n")).collect())
    seen, enough = 0, None
    for level, size in sizes:
        seen += size
        if seen >= n:
            enough = level
            break
    chosen = df if enough is None else df.where(magnitude <= F.lit(enough))
    return chosen.orderBy(lot.asc_nulls_last(), *names).limit(n)


DRAW = "_draw"


def lowest_draws(df: DataFrame, n: int, key: Sequence[str] | None = None, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """The rows of ``fixed_sample`` with their draw in ``_draw``: the state of a sample that pieces can be added to.

    One pass and no job beforehand: every task sends its own ``n`` lowest. That suits a batch of a stream, of few tasks;
    ``fixed_sample`` suits a table of many.
    """
    names = list(key or df.columns)
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 1) if draw is None else draw
    return df.withColumn(DRAW, lot).orderBy(F.asc_nulls_last(DRAW), *names).limit(n)


def merge_lowest(parts: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """The sample of everything from the samples of disjoint pieces, the same as ``fixed_sample`` over all rows."""
    return parts.orderBy(F.asc_nulls_last(DRAW), *key).limit(n).drop(DRAW)
