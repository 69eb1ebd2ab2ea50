"""Text labels for reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F


def last_segment(path: Column) -> Column:
    """Last part of a path, ignoring trailing slashes."""
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.element_at(F.split(trimmed, "/"), -1)


def sized_label(name: Column, mebibytes: Column) -> Column:
    """``name (123 MiB)``."""
    return F.format_string("%s (%.0f MiB)", name, mebibytes)


def compact_millions(number: Column) -> Column:
    """``3600000`` as ``3.6M``."""
    return F.format_string("%.1fM", number / F.lit(1e6))


def code_label(code: Column, names: Mapping[object, str]) -> Column:
    """Look a code up in a short fixed list; an unknown code becomes its own text."""
    pairs = F.create_map(*(F.lit(x) for x in chain.from_iterable(names.items())))
    return F.coalesce(F.try_element_at(pairs, code), code.cast("string"))


def ordinal_in(value: Column, order: Sequence[str]) -> Column:
    """One-based place of a value in a fixed order; values outside it come last."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), value)
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1)).cast("bigint")
