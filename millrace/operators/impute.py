"""Filling gaps, with a marker column for every value that was filled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import any_present, literal, long_form, quoted, sum_present

MARK = "imputed_"


def impute_constants(df: DataFrame, values: Mapping[str, object], where: Column | None = None) -> DataFrame:
    """Replace NULL by a constant of the column's own type and mark the rows (1 or 0).

    ``where`` limits the change to some rows, so rejected rows keep what they came with.
    """
    types = {s.name: s.dataType for s in df.schema}
    changes: dict[str, Column] = {}
    for name, value in values.items():
        if name not in types:
            continue
        gap = F.col(name).isNull() if where is None else F.col(name).isNull() & where
        changes[f"{MARK}{name}"] = gap.cast("int")
        changes[name] = F.when(gap, F.lit(value).cast(types[name])).otherwise(F.col(name))
    return df.withColumns(changes)


def impute_total(df: DataFrame, total: str, parts: Sequence[str], where: Column | None = None) -> DataFrame:
    """Fill a NULL total with the sum of its parts if any part is present.

    Two markers come out: ``imputed_<total>`` for NULL totals seen and
    ``filled_<total>`` for those that could be filled.
    """
    gap = F.col(total).isNull() if where is None else F.col(total).isNull() & where
    fill = gap & any_present(parts)
    return df.withColumns(
        {
            f"{MARK}{total}": gap.cast("int"),
            f"filled_{total}": fill.cast("int"),
            total: F.when(fill, sum_present(parts)).otherwise(F.col(total)),
        }
    )


def markers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith((MARK, "filled_"))]


def imputation_counts(df: DataFrame) -> DataFrame:
    """(marker, n_rows) for every marker column, from one aggregate."""
    names = markers(df)
    sums = df.agg(*(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names))
    return sums.select(long_form(marker=[literal(n) for n in names], n_rows=[quoted(n) for n in names]))


def drop_markers(df: DataFrame) -> DataFrame:
    return df.drop(*markers(df))
