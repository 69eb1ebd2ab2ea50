"""Preset for monthly taxi-trip files: contract, rules, imputation and the three reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import elapsed
from millrace.operators import impute, regression, reports, rules
from millrace.operators.contract import Contract, Field
from millrace.sources.csv import year_month_from

_byte, _short, _int = T.ByteType(), T.ShortType(), T.IntegerType()
_double, _text, _time = T.DoubleType(), T.StringType(), T.TimestampType()

# The dataset's column names, in the order of the table, with the names
# used in the raw files.
CONTRACT = Contract(
    (
        Field("vendor_id", _byte, "VendorID"),
        Field("pickup_datetime", _time, "tpep_pickup_datetime"),
        Field("dropoff_datetime", _time, "tpep_dropoff_datetime"),
        Field("passenger_count", _short, "passenger_count"),
        Field("trip_distance", _double, "trip_distance"),
        Field("rate_code_id", _byte, "RatecodeID"),
        Field("store_and_forward_flag", _text, "store_and_fwd_flag", ("Y", "N")),
        Field("pickup_location_id", _short, "PULocationID"),
        Field("dropoff_location_id", _short, "DOLocationID"),
        Field("payment_type_id", _byte, "payment_type"),
        Field("fare_amount", _double, "fare_amount"),
        Field("extra_charge", _double, "extra"),
        Field("metered_rate_tax", _double, "mta_tax"),
        Field("tip_amount", _double, "tip_amount"),
        Field("tolls_amount", _double, "tolls_amount"),
        Field("improvement_surcharge", _double, "improvement_surcharge"),
        Field("total_amount", _double, "total_amount"),
        Field("congestion_surcharge", _double, "congestion_surcharge"),
        Field("airport_fee", _double, "Airport_fee"),
        Field("cbd_congestion_fee", _double, "cbd_congestion_fee"),
        Field("year", _int),
        Field("month", _int),
        Field("currency", _text),
        Field("trip_distance_unit", _text),
        Field("suspicious", T.BooleanType()),
    )
)

# The file name pattern, constants, column groups, limits and fill-ins
# that define this dataset's rules.
FILE_PATTERN = r"yellow_tripdata_(\d{4})-(\d{2})\.csv$"
CURRENCY = "USD"
DISTANCE_UNIT = "Miles"
AMOUNTS = (
    "fare_amount",
    "extra_charge",
    "metered_rate_tax",
    "tip_amount",
    "tolls_amount",
    "improvement_surcharge",
    "congestion_surcharge",
    "airport_fee",
    "cbd_congestion_fee",
)
CRITICAL = (
    "pickup_datetime",
    "dropoff_datetime",
    "trip_distance",
    "pickup_location_id",
    "dropoff_location_id",
    "fare_amount",
)
FILL = {"tip_amount": 0.0, "passenger_count": 1, "store_and_forward_flag": "UNKNOWN"}
PROFILED = ("trip_distance", "fare_amount", "tip_amount", "total_amount")
MAX_SPEED_MPH = 120.0
TOLERANCE = 2.0
ML_BOUNDS = (("fare_amount", 0.0, 500.0), ("tip_amount", 0.0, 200.0))
ML_COLUMNS = (
    "pickup_datetime",
    "dropoff_datetime",
    "trip_distance",
    "pickup_location_id",
    "dropoff_location_id",
    "payment_type_id",
    "fare_amount",
    "tip_amount",
    "year",
    "month",
)
ML_TARGET = "tip_amount"

# Columns that come from the files. The others are constants and can never be NULL.
SOURCE_COLUMNS = tuple(f.name for f in CONTRACT.fields if f.source)


def conform(raw: DataFrame, year_month: dict[str, Column] | None = None) -> DataFrame:
    """Raw trip rows as contract rows; year and month come from the file name."""
    parts = year_month or year_month_from(F.col("file_name"), FILE_PATTERN)
    return CONTRACT.apply(
        raw,
        **parts,
        currency=F.lit(CURRENCY),
        trip_distance_unit=F.lit(DISTANCE_UNIT),
        suspicious=F.lit(False),
    )


def trip_rules() -> list[rules.Rule]:
    """The dataset's rules in the order in which they claim a row."""
    return [
        rules.has_any_value(SOURCE_COLUMNS),
        rules.has_critical_value(CRITICAL),
        rules.starts_before_end("pickup_datetime", "dropoff_datetime"),
        rules.belongs_to_month("pickup_datetime", "year", "month"),
        rules.not_negative("trip_distance"),
        rules.not_negative("passenger_count", "unrealistic_passenger_count"),
        rules.within_speed("trip_distance", "pickup_datetime", "dropoff_datetime", MAX_SPEED_MPH),
    ]


def suspicious() -> Column:
    return rules.suspicious_amounts(
        "total_amount", AMOUNTS, "tip_amount", "payment_type_id", tolerance=TOLERANCE
    )


def flag_suspicious(df: DataFrame, where: Column | None = None) -> DataFrame:
    flag = suspicious() if where is None else F.when(where, suspicious()).otherwise(F.col("suspicious"))
    return df.withColumn("suspicious", flag)


def clean(trips: DataFrame, mark: bool = False) -> DataFrame:
    """Tag every row with its reject reason; flag and impute the rows that are kept.

    One projection chain over one scan. Rejected rows keep the values they came with.
    ``mark=True`` leaves the imputation markers in.
    """
    tagged = rules.tag(trips, trip_rules())
    return flag_and_impute(tagged, mark, F.col(rules.REASON).isNull())


def clean_kept(trips: DataFrame, mark: bool = False) -> DataFrame:
    """Only the rows that ``clean`` keeps, without the reason column.

    The rules become a filter, part of which reaches the scan; the flag and the
    fill-ins are computed only for what is left. The two rules about missing columns
    are left out of the filter: a row with a pickup before its dropoff satisfies both,
    and testing twenty columns per row again would more than double the filter.
    """
    deciding = [r for r in trip_rules() if r.name not in (rules.NO_VALUE, rules.NO_CRITICAL)]
    return flag_and_impute(rules.keep_only(trips, deciding), mark)


def flag_and_impute(rows: DataFrame, mark: bool = False, where: Column | None = None) -> DataFrame:
    """The money flag, then the fill-ins: the flag must see which values were missing."""
    done = flag_suspicious(rows, where)
    done = impute.impute_constants(done, FILL, where)
    done = impute.impute_total(done, "total_amount", AMOUNTS, where)
    return done if mark else impute.drop_markers(done)


def with_speed_metrics(rejects: DataFrame) -> DataFrame:
    return rules.speed_metrics(rejects, "trip_distance", "pickup_datetime", "dropoff_datetime")


# --- reports -----------------------------------------------------------------------------


def monthly_payments(trips: DataFrame) -> DataFrame:
    """Trips, average distance, fare and tip, and revenue per month and payment type."""
    return reports.grouped_report(
        trips,
        ["year", "month", "payment_type_id", "trip_distance_unit", "currency"],
        {
            "trip_count": F.count("*"),
            "avg_trip_distance": F.avg("trip_distance"),
            "avg_fare_amount": F.avg("fare_amount"),
            "avg_tip_amount": F.avg("tip_amount"),
            "sum_total_amount": F.sum("total_amount"),
        },
        where=~F.col("suspicious"),
        order_by=["year", "month", "payment_type_id"],
    )


def top_routes(trips: DataFrame, min_trips: int = 100, limit: int = 100) -> DataFrame:
    """The routes with the most revenue among those with more than ``min_trips`` trips."""
    route = ["pickup_location_id", "dropoff_location_id", "trip_distance_unit", "currency"]
    return reports.grouped_report(
        trips,
        route,
        {
            "trip_count": F.count("*"),
            "avg_trip_distance": F.avg("trip_distance"),
            "avg_total_amount": F.avg("total_amount"),
            "sum_total_amount": F.sum("total_amount"),
        },
        having=F.col("trip_count") > min_trips,
        order_by=[F.desc_nulls_last("sum_total_amount"), F.desc("trip_count"), *route],
        limit=limit,
    )


def hourly_speed(trips: DataFrame) -> DataFrame:
    """Demand, prices and average speed by hour of pickup."""
    return reports.grouped_report(
        trips.withColumn("pickup_hour", F.hour("pickup_datetime")),
        ["pickup_hour", "trip_distance_unit", "currency"],
        {
            "trip_count": F.count("*"),
            "avg_trip_distance": F.avg("trip_distance"),
            "avg_fare_amount": F.avg("fare_amount"),
            "avg_total_amount": F.avg("total_amount"),
            "avg_speed_mph": F.avg(signed_speed()),
        },
        where=F.col("trip_distance") > 0,
        order_by=["pickup_hour", "trip_distance_unit", "currency"],
    )


def signed_speed() -> Column:
    """Speed of a trip; NULL only when pickup and dropoff coincide."""
    hours = elapsed("pickup_datetime", "dropoff_datetime", 3600.0)
    return F.try_divide(F.col("trip_distance"), hours)


# --- tip model ---------------------------------------------------------------------------


def model_rows(trips: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Features and target of the tip model: bounded, complete, timestamps unfolded.

    ``also`` names further columns to carry along.
    """
    rows = regression.calendar_features(
        trips.select(*ML_COLUMNS, *also), "pickup_datetime", "dropoff_datetime", "trip_distance", ("pickup", "dropoff")
    )
    rows = rules.within_bounds(rows, ML_BOUNDS)
    return rules.complete_cases(rows, rows.columns)


def split_model_rows(trips: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Model rows with ``is_test``, drawn by a hash of the trip's stored columns.

    Hashing those rather than the features lets the choice of a side filter the scan.
    """
    drawn = regression.split_by_key(trips.select(*ML_COLUMNS), ML_COLUMNS, test_share, seed)
    return model_rows(drawn, ["is_test"])


def feature_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (ML_TARGET, "is_test")]
