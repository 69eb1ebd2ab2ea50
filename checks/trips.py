"""Trip tables computed from the test data's ``lineitem``, one trip per line.

``trips`` has the contract's types; ``raw_trips`` is the same as it would arrive in CSV
files: source column names, text cells, some of them unusable, one column too many and
one missing. ``checks/sql.py`` says the same in SQL for the other engine.

Amounts are multiples of 0.5, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.plans import taxi
from millrace.session import scratch_path, use_utc

KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    order, part, supp, line = (F.col(k) for k in KEYS)
    # All source columns blank, and all critical columns blank, for some parts.
    gone = part % 499 == 7
    thin = gone | (part % 503 == 9)
    day = F.col("l_shipdate").cast("timestamp")

    def minutes(n: Column) -> Column:
        return F.timestamp_add("MINUTE", n.cast("int"), day)

    fare = F.floor(F.col("l_extendedprice") / 1000).cast("double")
    flag = (
        F.when(supp % 4 == 0, " y").when(supp % 4 == 1, "N").when(supp % 4 == 2, "X")
    )
    none = F.lit(None).cast("double")
    columns = {
        "vendor_id": _unless(gone, supp % 3 + 1).cast("byte"),
        "pickup_datetime": _unless(thin, minutes(order % 1440)),
        "dropoff_datetime": _unless(thin, minutes(order % 1440 + part % 90 - 5)),
        "passenger_count": _unless(gone | (part % 17 == 0), line - 2).cast("short"),
        "trip_distance": _unless(thin | (part % 19 == 0), F.col("l_quantity") - 3),
        "rate_code_id": _unless(gone, part % 6 + 1).cast("byte"),
        "store_and_forward_flag": _unless(gone, flag),
        "pickup_location_id": _unless(thin, part % 20).cast("short"),
        "dropoff_location_id": _unless(thin, supp % 10).cast("short"),
        "payment_type_id": _unless(gone | (order % 23 == 0), order % 5).cast("byte"),
        "fare_amount": _unless(thin | (part % 29 == 0), fare),
        "extra_charge": _unless(gone | (part % 97 == 0), F.lit(0.5)),
        "metered_rate_tax": none,
        "tip_amount": _unless(gone | (order % 11 == 0), line.cast("double")),
        "tolls_amount": none,
        "improvement_surcharge": none,
        "total_amount": _unless(
            gone | (part % 31 == 0),
            fare + 0.5 + 2.5 + line + F.when(part % 13 == 0, 5.0).otherwise(0.0),
        ),
        "congestion_surcharge": _unless(gone | (supp % 9 == 0), F.lit(2.5)),
        "airport_fee": none,
        "cbd_congestion_fee": none,
        "year": F.year(day),
        "month": F.month(day) + F.when(order % 37 == 0, 1).otherwise(0),
        "currency": F.lit(taxi.CURRENCY),
        "trip_distance_unit": F.lit(taxi.DISTANCE_UNIT),
        "suspicious": F.lit(False),
    }
    return lines.select(*KEYS, *(column.alias(name) for name, column in columns.items()))


_stored: dict[tuple[str, str, str], str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application, so that plans start from a scan.

    Left as a view, its long expressions would be copied into every condition.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        rows().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def trips(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    rows = _table(use_utc(spark), sf_dir, "trips", lambda: _lines(spark, sf_dir))
    return rows.select(*extra, *taxi.CONTRACT.names)


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns under source names, plus the ``file_name`` a row would come from."""
    return _table(use_utc(spark), sf_dir, "raw_trips", lambda: raw_lines(spark, sf_dir))


def raw_lines(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """``raw_trips`` (of the trips ``where``, a condition on KEYS) as a view: for rows that are written at once as they are."""
    rows = trips(spark, sf_dir, KEYS)
    if where is not None:
        rows = rows.where(where)
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    text = {
        f.source: F.col(f.name).cast("string")
        for f in taxi.CONTRACT.fields
        if f.source and f.name != "cbd_congestion_fee"
    }
    text["VendorID"] = F.when(supp % 53 == 0, "999").otherwise(text["VendorID"])
    text["passenger_count"] = F.when(part % 41 == 0, "x").otherwise(
        F.col("passenger_count").cast("double").cast("string")
    )
    text["tpep_pickup_datetime"] = F.when(order % 101 == 0, "not a time").otherwise(
        F.date_format("pickup_datetime", "yyyy-MM-dd HH:mm:ss")
    )
    text["tpep_dropoff_datetime"] = F.date_format("dropoff_datetime", "yyyy-MM-dd HH:mm:ss")
    text["mta_tax"] = F.when(part % 43 == 0, "NaN")
    text["ehail_fee"] = F.when(part % 2 == 0, "1.0")
    name = F.format_string("yellow_tripdata_%04d-%02d.csv", "year", "month")
    return rows.select(
        *(column.alias(n) for n, column in text.items()),
        F.when(order % 103 == 0, F.lit("notes.csv")).otherwise(name).alias("file_name"),
    )


def flat(df: DataFrame, double: str = "") -> DataFrame:
    """Result types that look the same from both engines, also after a trip through pandas.

    Integers become bigint. Those that may be NULL (small codes, times as epoch seconds
    and the columns named in ``double``) become doubles.
    """
    kinds = {"tinyint": "double", "smallint": "double", "int": "bigint"}

    def column(name: str, kind: str) -> Column:
        if kind.startswith("timestamp"):
            return F.unix_timestamp(name).cast("double").alias(name)
        if name in double.split():
            return F.col(name).cast("double").alias(name)
        return F.col(name).cast(kinds[kind]).alias(name) if kind in kinds else F.col(name)

    return df.select(*(column(s.name, s.dataType.simpleString()) for s in df.schema))


def rounded(df: DataFrame, digits: int = 6, only: tuple[str, ...] | None = None) -> DataFrame:
    """Doubles rounded, for results whose last bits depend on the order of addition."""
    return df.select(
        *(
            F.round(s.name, digits).alias(s.name)
            if s.dataType.simpleString() == "double" and (only is None or s.name in only)
            else F.col(s.name)
            for s in df.schema
        )
    )
