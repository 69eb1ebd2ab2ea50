"""Checks of schema contracts, row rules and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.registry import check
from checks.sql import CLEAN, CONFORMED, RAW, TAGGED, TRIPS, query
from checks.trips import KEYS, flat, raw_trips, trips
from millrace.functions import literal, long_form
from millrace.operators import contract, impute, profile, rules
from millrace.plans import taxi

_KEYS = "o AS l_orderkey, p AS l_partkey, s AS l_suppkey, CAST(n AS BIGINT) AS l_linenumber"
_ALL = ", ".join(taxi.CONTRACT.names)
_SMALL = (
    "vendor_id pickup_datetime dropoff_datetime passenger_count rate_code_id pickup_location_id "
    "dropoff_location_id payment_type_id"
)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir, KEYS)


def _keyed_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxi.clean_kept(_keyed(spark, sf_dir))


def _passing(spark: SparkSession, sf_dir: str, rule: rules.Rule, *columns: str) -> DataFrame:
    return flat(rules.apply_rule(_keyed(spark, sf_dir), rule).select(*KEYS, *columns))


@check(
    "rename_columns",
    query(
        RAW,
        """
        SELECT VendorID AS vendor_id, payment_type AS payment_type_id,
               store_and_fwd_flag AS store_and_forward_flag, ehail_fee, count(*) AS n_rows,
               count(fare_amount) AS n_fares, count(mta_tax) AS n_taxes
        FROM raw GROUP BY ALL""",
    ),
)
def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = taxi.CONTRACT.rename(raw_trips(spark, sf_dir))
    return renamed.groupBy("vendor_id", "payment_type_id", "store_and_forward_flag", "ehail_fee").agg(
        F.count("*").alias("n_rows"),
        F.count("fare_amount").alias("n_fares"),
        F.count("metered_rate_tax").alias("n_taxes"),
    )


_ALIGNED = {f.name: f.source if f.source and f.name != "cbd_congestion_fee" else None for f in taxi.CONTRACT.fields}


@check(
    "align_schema",
    query(
        RAW,
        " UNION ALL ".join(
            f"SELECT CAST({i} AS BIGINT) AS place, '{name}' AS column_name, "
            f"count({source or 'NULL'}) AS n_values FROM raw"
            for i, (name, source) in enumerate(_ALIGNED.items())
        ),
    ),
)
def align_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = taxi.CONTRACT.align(taxi.CONTRACT.rename(raw_trips(spark, sf_dir)))
    counts = aligned.agg(*(F.count(c).alias(c) for c in aligned.columns))
    return counts.select(
        long_form(
            place=[f"{i}L" for i in range(len(counts.columns))],
            column_name=[literal(c) for c in counts.columns],
            n_values=list(counts.columns),
        )
    )


_LOST = {
    "vendor_id": "count(*) FILTER (VendorID = '999')",
    "pickup_datetime": "count(*) FILTER (tpep_pickup_datetime = 'not a time')",
    "passenger_count": "count(*) FILTER (passenger_count = 'x')",
    "metered_rate_tax": "count(*) FILTER (mta_tax = 'NaN')",
}
_TEXT_IN = [f for f in taxi.CONTRACT.fields if _ALIGNED[f.name] and f.type.simpleString() != "string"]


@check(
    "type_mismatch_report",
    query(
        RAW,
        " UNION ALL ".join(
            f"SELECT '{f.name}' AS column_name, '{f.type.simpleString()}' AS expected_type, "
            f"'string' AS actual_type, {_LOST.get(f.name, 'count(NULL)')} AS lost_values FROM raw"
            for f in _TEXT_IN
        ),
    ),
)
def type_mismatch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = taxi.CONTRACT.align(taxi.CONTRACT.rename(raw_trips(spark, sf_dir)))
    return contract.type_report(aligned, taxi.CONTRACT)


@check(
    "enforce_types",
    query(
        CONFORMED,
        """
        SELECT vendor_id, passenger_count, rate_code_id, count(*) AS n_rows, count(pickup_datetime) AS n_pickups,
               CAST(sum(pickup_datetime) AS BIGINT) AS sum_pickup, sum(total_amount) AS sum_total,
               count(metered_rate_tax) AS n_taxes
        FROM conformed GROUP BY vendor_id, passenger_count, rate_code_id""",
        "vendor_id passenger_count rate_code_id sum_pickup",
    ),
)
def enforce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = taxi.CONTRACT.align(taxi.CONTRACT.rename(raw_trips(spark, sf_dir)))
    typed = taxi.CONTRACT.enforce(aligned)
    return flat(
        typed.groupBy("vendor_id", "passenger_count", "rate_code_id").agg(
            F.count("*").alias("n_rows"),
            F.count("pickup_datetime").alias("n_pickups"),
            F.sum(F.unix_timestamp("pickup_datetime")).alias("sum_pickup"),
            F.sum("total_amount").alias("sum_total"),
            F.count("metered_rate_tax").alias("n_taxes"),
        ),
        "sum_pickup",
    )


@check(
    "normalise_flag",
    query(
        TRIPS,
        """
        SELECT store_and_forward_flag AS raw_flag,
               CASE upper(trim(store_and_forward_flag)) WHEN 'Y' THEN 'Y' WHEN 'N' THEN 'N' END AS flag,
               count(*) AS n_rows
        FROM trips GROUP BY 1, 2""",
    ),
)
def normalise_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("store_and_forward_flag")
    return (
        trips(spark, sf_dir)
        .groupBy(flag.alias("raw_flag"), contract.normalise_code(flag, ("Y", "N")).alias("flag"))
        .agg(F.count("*").alias("n_rows"))
    )


@check("apply_contract", query(CONFORMED, f"SELECT {_ALL} FROM conformed", f"{_SMALL} year month"))
def apply_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(taxi.conform(raw_trips(spark, sf_dir)), "year month")


@check(
    "drop_all_null_rows",
    query(TAGGED, f"SELECT {_KEYS}, total_amount FROM tagged WHERE NOT gone_row"),
)
def drop_all_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir, rules.has_any_value(taxi.SOURCE_COLUMNS), "total_amount")


@check(
    "drop_missing_critical",
    query(
        TRIPS,
        f"""
        SELECT {_KEYS}, fare_amount FROM trips
        WHERE pickup_datetime IS NOT NULL OR dropoff_datetime IS NOT NULL OR trip_distance IS NOT NULL
           OR pickup_location_id IS NOT NULL OR dropoff_location_id IS NOT NULL OR fare_amount IS NOT NULL""",
    ),
)
def drop_missing_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir, rules.has_critical_value(taxi.CRITICAL), "fare_amount")


@check(
    "valid_interval",
    query(
        TRIPS,
        f"""
        SELECT {_KEYS}, CAST(epoch(pickup_datetime) AS BIGINT) AS pickup_datetime,
               CAST(epoch(dropoff_datetime) AS BIGINT) AS dropoff_datetime
        FROM trips WHERE pickup_datetime < dropoff_datetime""",
        "pickup_datetime dropoff_datetime",
    ),
)
def valid_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = rules.starts_before_end("pickup_datetime", "dropoff_datetime")
    return _passing(spark, sf_dir, rule, "pickup_datetime", "dropoff_datetime")


@check(
    "partition_leak",
    query(
        TRIPS,
        f"""
        SELECT {_KEYS}, year, month FROM trips
        WHERE year(pickup_datetime) = year AND month(pickup_datetime) = month""",
    ),
)
def partition_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir, rules.belongs_to_month("pickup_datetime", "year", "month"), "year", "month")


@check(
    "non_negative",
    query(
        TRIPS,
        f"""
        SELECT {_KEYS}, trip_distance, passenger_count FROM trips
        WHERE coalesce(trip_distance, 0) >= 0 AND coalesce(passenger_count, 0) >= 0""",
        "passenger_count",
    ),
)
def non_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_rule(_keyed(spark, sf_dir), rules.not_negative("trip_distance"))
    rows = rules.apply_rule(rows, rules.not_negative("passenger_count"))
    return flat(rows.select(*KEYS, "trip_distance", "passenger_count"))


@check(
    "speed_limit",
    query(
        TRIPS + """,
        timed AS (
          SELECT *, (epoch(dropoff_datetime) - epoch(pickup_datetime)) / CAST(60 AS DOUBLE) AS trip_duration_min
          FROM trips)""",
        f"""
        SELECT {_KEYS}, trip_duration_min,
               CAST(CASE WHEN trip_duration_min > 0 THEN floor(trip_distance / (trip_duration_min / 60)) END AS BIGINT)
                 AS avg_speed_mph
        FROM timed
        WHERE NOT coalesce(trip_duration_min > 0 AND trip_distance / (trip_duration_min / 60) >= 120, false)""",
        "avg_speed_mph",
    ),
)
def speed_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = rules.within_speed("trip_distance", "pickup_datetime", "dropoff_datetime", 120.0)
    passing = taxi.with_speed_metrics(rules.apply_rule(_keyed(spark, sf_dir), rule))
    return flat(passing.select(*KEYS, "trip_duration_min", "avg_speed_mph"), "avg_speed_mph")


@check(
    "clean_rows",
    query(
        CLEAN,
        f"""
        SELECT {_KEYS}, * EXCLUDE (o, p, s, n, gone_row, parts_sum, any_part, secs, reject_reason, odd,
                                   no_tip, no_passengers, no_flag, no_total)
               REPLACE (CAST(epoch(pickup_datetime) AS BIGINT) AS pickup_datetime,
                        CAST(epoch(dropoff_datetime) AS BIGINT) AS dropoff_datetime)
        FROM clean""",
        _SMALL,
    ),
)
def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_keyed_clean(spark, sf_dir))


@check("flag_suspicious", query(TAGGED, f"SELECT {_KEYS}, odd AS suspicious FROM tagged"))
def flag_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(taxi.flag_suspicious(_keyed(spark, sf_dir)).select(*KEYS, "suspicious"))


@check(
    "impute_constants",
    query(
        TRIPS,
        f"""
        SELECT {_KEYS}, coalesce(tip_amount, 0) AS tip_amount, coalesce(passenger_count, 1) AS passenger_count,
               coalesce(store_and_forward_flag, 'UNKNOWN') AS store_and_forward_flag,
               CAST(tip_amount IS NULL AS BIGINT) AS imputed_tip_amount,
               CAST(passenger_count IS NULL AS BIGINT) AS imputed_passenger_count,
               CAST(store_and_forward_flag IS NULL AS BIGINT) AS imputed_store_and_forward_flag
        FROM trips""",
        "passenger_count",
    ),
)
def impute_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = impute.impute_constants(_keyed(spark, sf_dir), taxi.FILL)
    return flat(filled.select(*KEYS, *taxi.FILL, *impute.markers(filled)))


@check(
    "impute_total",
    query(
        TAGGED,
        f"""
        SELECT {_KEYS}, CASE WHEN any_part THEN coalesce(total_amount, parts_sum) ELSE total_amount END AS total_amount,
               CAST(total_amount IS NULL AS BIGINT) AS imputed_total_amount,
               CAST(total_amount IS NULL AND any_part AS BIGINT) AS filled_total_amount
        FROM tagged""",
    ),
)
def impute_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = impute.impute_total(_keyed(spark, sf_dir), "total_amount", taxi.AMOUNTS)
    return flat(filled.select(*KEYS, "total_amount", *impute.markers(filled)))


@check(
    "imputation_counts",
    query(
        CLEAN,
        """
        SELECT 'imputed_tip_amount' AS marker, count(*) FILTER (no_tip) AS n_rows FROM clean UNION ALL
        SELECT 'imputed_passenger_count', count(*) FILTER (no_passengers) FROM clean UNION ALL
        SELECT 'imputed_store_and_forward_flag', count(*) FILTER (no_flag) FROM clean UNION ALL
        SELECT 'imputed_total_amount', count(*) FILTER (no_total) FROM clean UNION ALL
        SELECT 'filled_total_amount', count(*) FILTER (no_total) FROM clean""",
    ),
)
def imputation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.imputation_counts(taxi.clean_kept(trips(spark, sf_dir), mark=True))


@check(
    "reject_summary",
    query(TAGGED, "SELECT coalesce(reject_reason, 'kept') AS outcome, count(*) AS n_rows FROM tagged GROUP BY 1"),
)
def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.reject_summary(rules.tag(trips(spark, sf_dir), taxi.trip_rules()))


@check(
    "complete_cases",
    query(
        CONFORMED,
        """
        SELECT vendor_id, passenger_count, count(*) AS n_rows, sum(total_amount) AS sum_total
        FROM conformed
        WHERE vendor_id IS NOT NULL AND passenger_count IS NOT NULL AND pickup_datetime IS NOT NULL
          AND trip_distance IS NOT NULL AND total_amount IS NOT NULL
        GROUP BY vendor_id, passenger_count""",
        "vendor_id passenger_count",
    ),
)
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = ["vendor_id", "passenger_count", "pickup_datetime", "trip_distance", "total_amount"]
    complete = rules.complete_cases(taxi.conform(raw_trips(spark, sf_dir)), needed)
    return flat(
        complete.groupBy("vendor_id", "passenger_count").agg(
            F.count("*").alias("n_rows"), F.sum("total_amount").alias("sum_total")
        )
    )


@check(
    "outlier_bounds",
    query(
        TRIPS,
        f"""
        SELECT {_KEYS}, fare_amount, tip_amount FROM trips
        WHERE fare_amount >= 10 AND fare_amount < 80 AND tip_amount >= 0 AND tip_amount < 6""",
    ),
)
def outlier_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = [("fare_amount", 10.0, 80.0), ("tip_amount", 0.0, 6.0)]
    return flat(rules.within_bounds(_keyed(spark, sf_dir), bounds).select(*KEYS, "fare_amount", "tip_amount"))


_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_count, "
    f"round(count(*) FILTER ({c} IS NULL) / count(*) * 100, 2) AS missing_percent FROM clean"
    for c in taxi.CONTRACT.names
)


@check("profile_missing", query(CLEAN, _MISSING))
def profile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_missing(taxi.clean_kept(trips(spark, sf_dir)), taxi.CONTRACT.names)


@check("profile_missing_one_pass", query(CLEAN, _MISSING))
def profile_missing_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same profile out of the pass that also gives the statistics per vendor."""
    rows = taxi.clean_kept(trips(spark, sf_dir))
    return profile.missing_of(profile.profile_once(rows, ["vendor_id"], taxi.PROFILED, taxi.CONTRACT.names))


@check("profile_missing_merge", query(CLEAN, _MISSING))
def profile_missing_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taxi.clean_kept(trips(spark, sf_dir))
    pieces = profile.partial_missing(
        rows, taxi.CONTRACT.names, [F.col("year").alias("piece_year"), F.col("month").alias("piece_month")]
    )
    return profile.merge_missing(pieces, taxi.CONTRACT.names)
