"""Missing values, elapsed time, speed and unpivoting as column expressions.

Expressions over many columns are written as one SQL text: built column by column they
would cost several calls into the JVM per column before any work starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string literal as SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_missing(name: str) -> Column:
    """NULL or NaN, for floating-point columns."""
    return F.expr(f"nanvl({quoted(name)}, NULL) IS NULL")


def all_missing(names: Sequence[str]) -> Column:
    """TRUE when every listed column is NULL."""
    return F.expr(" AND ".join(f"{quoted(n)} IS NULL" for n in names))


def any_present(names: Sequence[str]) -> Column:
    """TRUE when at least one listed column holds a number (neither NULL nor NaN)."""
    return F.expr(" OR ".join(f"nanvl({quoted(n)}, NULL) IS NOT NULL" for n in names))


def sum_present(names: Sequence[str]) -> Column:
    """Row-wise sum in which NULL and NaN count as zero."""
    return F.expr(" + ".join(f"coalesce(nanvl({quoted(n)}, 0D), 0D)" for n in names))


def elapsed(start: str, end: str, seconds_per_unit: float = 1.0) -> Column:
    """Whole seconds from ``start`` to ``end``, as a double in the given unit.

    The divisor is a double literal on purpose: a decimal literal would turn the
    result into a decimal with six digits and move values across speed limits.
    """
    first, last = (F.unix_seconds(F.col(c).cast("timestamp")) for c in (start, end))
    return (last - first) / F.lit(float(seconds_per_unit))


def speed_per_hour(distance: str, start: str, end: str) -> Column:
    """Distance per hour; NULL when no time has passed."""
    hours = elapsed(start, end, 3600.0)
    return F.when(hours > 0, F.col(distance) / hours)


def long_form(**series: Sequence[str]) -> Column:
    """Turn equally long lists of SQL expressions into rows, one column per list.

    Used to unpivot one wide aggregate row without a union per column.
    """
    names = list(series)
    structs = [
        "named_struct(" + ", ".join(f"{literal(n)}, {e}" for n, e in zip(names, row)) + ")"
        for row in zip(*series.values(), strict=True)
    ]
    return F.expr(f"inline(array({', '.join(structs)}))")
