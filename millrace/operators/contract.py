"""Schema contracts: rename, align, cast without failing, and report what did not fit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import literal, long_form, quoted

#: A column of bits, one per field of a contract: the cells of a row that reading or casting has lost.
LOST = "_lost"

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class Field:
    """One column of a contract.

    ``source`` is the column's name in the raw input. ``codes`` restricts a text
    column to a few upper-case codes; anything else becomes NULL.
    """

    name: str
    type: T.DataType
    source: str | None = None
    codes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Mismatch:
    column: str
    expected: str
    actual: str


@dataclass(frozen=True)
class Contract:
    """An ordered list of columns that every table of a dataset must follow."""

    fields: tuple[Field, ...]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type) for f in self.fields])

    @property
    def source_names(self) -> list[str]:
        return [f.source for f in self.fields if f.source]

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def reading_schema(self, header: list[str]) -> T.StructType:
        """Types for a text reader, wide enough to lose nothing the contract would keep.

        Numbers and times are parsed by the reader (a cell it cannot parse is NULL), so
        later conditions test typed columns instead of repeating casts from text. Whole
        numbers are read as doubles, because "1.0" is a common way to write them; long
        ones stay text, as a double would round them.
        """
        by_source = {f.source: f.type for f in self.fields if f.source}

        def wide(kind: T.DataType | None) -> T.DataType:
            if isinstance(kind, _REAL) or (isinstance(kind, _WHOLE) and not isinstance(kind, T.LongType)):
                return T.DoubleType()
            return kind if isinstance(kind, T.TimestampType) else T.StringType()

        return T.StructType([T.StructField(n, wide(by_source.get(n))) for n in header])

    # --- the steps, each usable alone -------------------------------------------------

    def rename(self, df: DataFrame) -> DataFrame:
        """Raw names to contract names; names that are absent are ignored."""
        return df.withColumnsRenamed({f.source: f.name for f in self.fields if f.source})

    def differences(self, df: DataFrame) -> tuple[list[str], list[str]]:
        """(missing, unexpected) column names, each sorted."""
        have = set(df.columns) - {LOST}
        return sorted(set(self.names) - have), sorted(have - set(self.names))

    def align(self, df: DataFrame) -> DataFrame:
        """Exactly the contract's columns in its order; missing ones are typed NULLs. A column of lost cells stays."""
        have = set(df.columns)
        return df.select(
            *(F.col(f.name) if f.name in have else F.lit(None).cast(f.type).alias(f.name) for f in self.fields),
            *([F.col(LOST)] if LOST in have else []),
        )

    def enforce(self, df: DataFrame) -> DataFrame:
        """Cast every column; a value that does not fit becomes NULL, and so does NaN."""
        have = {s.name: s.dataType for s in df.schema}
        return df.select(
            *(
                (coerce(F.col(n), have[n], self.field(n)) if n in set(self.names) else F.col(n)).alias(n)
                for n in df.columns
            )
        )

    def mismatches(self, schema: T.StructType) -> list[Mismatch]:
        """Columns whose type differs from the contract. Looks at the schema only."""
        have = {s.name: s.dataType for s in schema}
        return [
            Mismatch(f.name, f.type.simpleString(), have[f.name].simpleString())
            for f in self.fields
            if f.name in have and have[f.name] != f.type
        ]

    def mark_lost(self, raw: DataFrame, rescued: str | None = None) -> DataFrame:
        """``raw``, under source names, with the bits of the cells that its typed columns and the contract lose.

        A cell is lost if its text holds something that the contract's type cannot. ``rescued`` is the scan's column of
        cells that the reader could not parse (see ``csv_scan``). The bits, one whole number a row, pass through
        ``apply``; ``lost_counts`` adds them up, so counting needs no second parse.
        """
        have = {s.name: s.dataType for s in raw.schema}
        # A typed scan may have a column's very type; then only NaN is left for the contract to lose.
        bits = {
            f.source: (have[f.source], f, 1 << i)
            for i, f in enumerate(self.fields)
            if f.source in have and not isinstance(f.type, T.StringType) and (have[f.source] != f.type or isinstance(f.type, _REAL))
        }
        cast = [F.when(loses(F.col(quoted(n)), kind, field), F.lit(bit)).otherwise(F.lit(0)) for n, (kind, field, bit) in bits.items()]
        mask = reduce(lambda a, b: a.bitwiseOR(b), cast, F.lit(0).cast("bigint"))
        if rescued is not None:
            unread = {f.source: 1 << i for i, f in enumerate(self.fields) if f.source in have and not isinstance(f.type, T.StringType)}
            known = F.create_map(*(F.lit(x) for pair in unread.items() for x in pair)) if unread else F.create_map().cast("map<string,bigint>")
            held = F.aggregate(F.map_keys(rescued), F.lit(0).cast("bigint"), lambda a, k: a.bitwiseOR(F.coalesce(F.try_element_at(known, k).cast("bigint"), F.lit(0).cast("bigint"))))
            mask = mask.bitwiseOR(F.when(F.col(rescued).isNotNull(), held).otherwise(F.lit(0).cast("bigint")))
        return raw.withColumn(LOST, mask)

    def lost_counts(self, mask: str = LOST) -> dict[str, Column]:
        """An aggregate for every field that a text can fail to hold: how many of its cells were lost."""
        fields = {f.name: 1 << i for i, f in enumerate(self.fields) if f.source and not isinstance(f.type, T.StringType)}
        return {name: F.count_if(F.col(mask).bitwiseAND(F.lit(bit)) != 0) for name, bit in fields.items()}

    def apply(self, df: DataFrame, **derived: Column) -> DataFrame:
        """Rename, add derived columns, align and enforce, all as plain projections."""
        renamed = self.rename(df)
        return self.enforce(self.align(renamed.withColumns(derived) if derived else renamed))


def coerce(value: Column, have: T.DataType, want: Field) -> Column:
    """``value`` as the contract's type, NULL where it does not fit."""
    if isinstance(want.type, T.StringType):
        text = value.cast("string")
        if not want.codes:
            return text
        return normalise_code(text, want.codes)
    if isinstance(want.type, _WHOLE):
        if isinstance(have, _WHOLE):
            return value.try_cast(want.type)
        # Text such as "1.0" is a whole number written by a tool that had missing
        # values in the column; casting it straight to an integer would lose it.
        # Long values go through a decimal, as a double would round them.
        wide = T.DecimalType(38, 6) if isinstance(want.type, T.LongType) else T.DoubleType()
        return value.try_cast(wide).try_cast(want.type)
    if isinstance(want.type, _REAL):
        number = value.try_cast(want.type)
        return F.when(~F.isnan(number), number)
    return value.try_cast(want.type)


def loses(value: Column, have: T.DataType, want: Field) -> Column:
    """Whether ``coerce`` makes NULL of a value that is there; never NULL itself.

    For doubles, as a typed scan reads numbers, this is a comparison of bounds and not the cast once more.
    """
    if isinstance(have, T.DoubleType) and isinstance(want.type, (T.ByteType, T.ShortType, T.IntegerType)):
        top = float(1 << {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}[type(want.type)])
        return F.coalesce((value >= F.lit(top)) | (value <= F.lit(-top - 1)), F.lit(False))
    if isinstance(have, T.DoubleType) and isinstance(want.type, T.DoubleType):
        return F.coalesce(F.isnan(value), F.lit(False))
    return value.isNotNull() & coerce(value, have, want).isNull()


def normalise_code(text: Column, codes: tuple[str, ...]) -> Column:
    """Trimmed upper-case text if it is one of ``codes``, else NULL."""
    tidy = F.upper(F.trim(text))
    return F.when(tidy.isin(*codes), tidy)


def type_report(df: DataFrame, contract: Contract) -> DataFrame:
    """Per mismatched column: expected and actual type, and how many values a cast loses.

    One aggregate over the table gives all the counts; one row per column comes out.
    """
    found = contract.mismatches(df.schema)
    if not found:
        empty = "column_name string, expected_type string, actual_type string, lost_values bigint"
        return df.sparkSession.createDataFrame([], empty)
    have = {s.name: s.dataType for s in df.schema}
    losses = [
        F.count_if(
            F.col(m.column).isNotNull()
            & coerce(F.col(m.column), have[m.column], contract.field(m.column)).isNull()
        ).alias(m.column)
        for m in found
    ]
    return df.agg(*losses).select(
        long_form(
            column_name=[literal(m.column) for m in found],
            expected_type=[literal(m.expected) for m in found],
            actual_type=[literal(m.actual) for m in found],
            lost_values=[quoted(m.column) for m in found],
        )
    )
