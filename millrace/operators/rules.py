"""Row rules. Each is a *keep* condition; all of a dataset's rules run in one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import (
    all_missing,
    any_present,
    elapsed,
    is_missing,
    speed_per_hour,
    sum_present,
)

REASON = "reject_reason"
KEPT = "kept"
# Names of rules, which become the names of the rejects' folders.
NO_VALUE = "rows_all_columns_missing"
NO_CRITICAL = "rows_missing_critical_columns"


@dataclass(frozen=True)
class Rule:
    """A named condition for keeping a row. NULL counts as a failure."""

    name: str
    keep: Column

    def passes(self) -> Column:
        return F.coalesce(self.keep, F.lit(False))


def has_any_value(columns: Sequence[str], name: str = NO_VALUE) -> Rule:
    """Rejects a row only when every listed column is NULL."""
    return Rule(name, ~all_missing(columns))


def has_critical_value(columns: Sequence[str], name: str = NO_CRITICAL) -> Rule:
    """Rejects a row only when all critical columns are NULL; an empty list rejects nothing."""
    return Rule(name, ~all_missing(columns) if columns else F.lit(True))


def starts_before_end(start: str, end: str, name: str = "invalid_timestamps") -> Rule:
    return Rule(name, F.col(start) < F.col(end))


def belongs_to_month(moment: str, year: str, month: str, name: str = "month_leaked_rows") -> Rule:
    """The timestamp falls in the month the row was delivered for."""
    return Rule(name, (F.year(moment) == F.col(year)) & (F.month(moment) == F.col(month)))


def not_negative(column: str, name: str | None = None) -> Rule:
    """Zero, positive or NULL."""
    value = F.col(column)
    return Rule(name or f"negative_{column}", value.isNull() | (value >= 0))


def within_speed(
    distance: str,
    start: str,
    end: str,
    limit: float = 120.0,
    inclusive: bool = False,
    name: str = "unrealistic_trip_speed",
) -> Rule:
    """Speed below the limit, or not computable."""
    speed = speed_per_hour(distance, start, end)
    below = speed <= F.lit(limit) if inclusive else speed < F.lit(limit)
    return Rule(name, F.coalesce(below, F.lit(True)))


def speed_metrics(df: DataFrame, distance: str, start: str, end: str) -> DataFrame:
    """Add the two figures a reviewer needs to judge a speed rejection."""
    return df.withColumns(
        {
            "trip_duration_min": elapsed(start, end, 60.0),
            "avg_speed_mph": F.floor(speed_per_hour(distance, start, end)),
        }
    )


def tag(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the name of the first rule a row fails, NULL if it passes them all.

    No row is dropped and nothing is counted here, so any number of rules costs one
    pass, and the kept and rejected rows always add up to the input.
    """
    return df.withColumn(REASON, F.coalesce(*(F.when(~r.passes(), F.lit(r.name)) for r in rules)))


def keep_only(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that pass every rule, where the reasons of the others are not wanted.

    Same rows as ``kept(tag(...))``, but as a plain conjunction, from which Spark pushes
    what it can into the scan and stops at the first failing condition.
    """
    return df.where(reduce(and_, (r.keep for r in rules)))


def kept(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(REASON).isNull()).drop(REASON)


def rejected(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(REASON).isNotNull())


def apply_rule(df: DataFrame, rule: Rule) -> DataFrame:
    """Keep the rows that pass a single rule."""
    return keep_only(df, [rule])


def reject_summary(tagged: DataFrame) -> DataFrame:
    """Rows per outcome. Partial counts leave each task, so a dominant outcome is no hot spot."""
    return tagged.groupBy(F.coalesce(REASON, F.lit(KEPT)).alias("outcome")).agg(F.count("*").alias("n_rows"))


def suspicious_amounts(
    total: str,
    parts: Sequence[str],
    tip: str,
    payment: str,
    card_code: int = 1,
    tolerance: float = 2.0,
) -> Column:
    """TRUE for rows whose money columns contradict each other or are incomplete.

    That is: the total is off by more than the tolerance, no part is present, the
    total is NULL, or a card payment has no tip. Never NULL: an unknown payment
    type does not make a row suspicious.
    """
    off = ~is_missing(total) & (F.abs(F.col(total) - sum_present(parts)) > F.lit(tolerance))
    cash_gap = (F.col(payment) == card_code) & is_missing(tip)
    return F.coalesce(off, F.lit(False)) | ~any_present(parts) | F.col(total).isNull() | F.coalesce(cash_gap, F.lit(False))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with neither NULL nor NaN in the listed columns."""
    return df.na.drop(subset=list(columns))


def within_bounds(df: DataFrame, bounds: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Rows with ``low <= column < high`` for every (column, low, high)."""
    for column, low, high in bounds:
        df = df.where((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))
    return df
