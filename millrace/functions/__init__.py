"""Column expressions shared by the operators. All are built-in, code-generated functions."""

from millrace.functions.columns import (
    all_missing,
    any_present,
    elapsed,
    is_missing,
    literal,
    long_form,
    quoted,
    speed_per_hour,
    sum_present,
)
from millrace.functions.labels import (
    code_label,
    compact_millions,
    last_segment,
    ordinal_in,
    sized_label,
)

__all__ = [
    "all_missing",
    "any_present",
    "code_label",
    "compact_millions",
    "elapsed",
    "is_missing",
    "last_segment",
    "literal",
    "long_form",
    "ordinal_in",
    "quoted",
    "sized_label",
    "speed_per_hour",
    "sum_present",
]
