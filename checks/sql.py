"""The trip tables of ``checks/trips.py`` as SQL for DuckDB, as common table expressions."""

from __future__ import annotations

TRIPS = """
lines AS (
  SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n,
         l_quantity AS qty, floor(l_extendedprice / 1000) AS price, l_shipdate AS d,
         l_partkey % 499 = 7 AS gone,
         l_partkey % 499 = 7 OR l_partkey % 503 = 9 AS thin
  FROM lineitem),
trips AS (
  SELECT o, p, s, n,
         CASE WHEN NOT gone THEN s % 3 + 1 END AS vendor_id,
         CASE WHEN NOT thin THEN d + to_minutes(CAST(o % 1440 AS BIGINT)) END AS pickup_datetime,
         CASE WHEN NOT thin THEN d + to_minutes(CAST(o % 1440 + p % 90 - 5 AS BIGINT)) END AS dropoff_datetime,
         CASE WHEN NOT (gone OR p % 17 = 0) THEN CAST(n - 2 AS BIGINT) END AS passenger_count,
         CASE WHEN NOT (thin OR p % 19 = 0) THEN qty - 3 END AS trip_distance,
         CASE WHEN NOT gone THEN p % 6 + 1 END AS rate_code_id,
         CASE WHEN NOT gone THEN CASE s % 4 WHEN 0 THEN ' y' WHEN 1 THEN 'N' WHEN 2 THEN 'X' END END
           AS store_and_forward_flag,
         CASE WHEN NOT thin THEN p % 20 END AS pickup_location_id,
         CASE WHEN NOT thin THEN s % 10 END AS dropoff_location_id,
         CASE WHEN NOT (gone OR o % 23 = 0) THEN o % 5 END AS payment_type_id,
         CASE WHEN NOT (thin OR p % 29 = 0) THEN price END AS fare_amount,
         CASE WHEN NOT (gone OR p % 97 = 0) THEN CAST(0.5 AS DOUBLE) END AS extra_charge,
         CAST(NULL AS DOUBLE) AS metered_rate_tax,
         CASE WHEN NOT (gone OR o % 11 = 0) THEN CAST(n AS DOUBLE) END AS tip_amount,
         CAST(NULL AS DOUBLE) AS tolls_amount,
         CAST(NULL AS DOUBLE) AS improvement_surcharge,
         CASE WHEN NOT (gone OR p % 31 = 0)
              THEN price + 3 + n + CASE WHEN p % 13 = 0 THEN 5 ELSE 0 END END AS total_amount,
         CASE WHEN NOT (gone OR s % 9 = 0) THEN CAST(2.5 AS DOUBLE) END AS congestion_surcharge,
         CAST(NULL AS DOUBLE) AS airport_fee,
         CAST(NULL AS DOUBLE) AS cbd_congestion_fee,
         CAST(year(d) AS BIGINT) AS year,
         CAST(month(d) + CASE WHEN o % 37 = 0 THEN 1 ELSE 0 END AS BIGINT) AS month,
         'USD' AS currency, 'Miles' AS trip_distance_unit, false AS suspicious
  FROM lines)"""

# One row per trip with the first rule it breaks, the money check, and both sums of parts.
TAGGED = TRIPS + """,
measured AS (
  SELECT *,
         coalesce(fare_amount, 0) + coalesce(extra_charge, 0) + coalesce(tip_amount, 0)
           + coalesce(congestion_surcharge, 0) AS parts_sum,
         coalesce(fare_amount, extra_charge, tip_amount, congestion_surcharge) IS NOT NULL AS any_part,
         epoch(dropoff_datetime) - epoch(pickup_datetime) AS secs
  FROM trips),
tagged AS (
  SELECT *,
         CASE
           WHEN gone_row THEN 'rows_all_columns_missing'
           WHEN pickup_datetime IS NULL AND dropoff_datetime IS NULL AND trip_distance IS NULL
                AND pickup_location_id IS NULL AND dropoff_location_id IS NULL AND fare_amount IS NULL
             THEN 'rows_missing_critical_columns'
           WHEN pickup_datetime IS NULL OR dropoff_datetime IS NULL OR pickup_datetime >= dropoff_datetime
             THEN 'invalid_timestamps'
           WHEN year IS NULL OR month IS NULL OR year(pickup_datetime) <> year OR month(pickup_datetime) <> month
             THEN 'month_leaked_rows'
           WHEN trip_distance < 0 THEN 'negative_trip_distance'
           WHEN passenger_count < 0 THEN 'unrealistic_passenger_count'
           WHEN trip_distance / (secs / CAST(3600 AS DOUBLE)) >= 120 THEN 'unrealistic_trip_speed'
         END AS reject_reason,
         coalesce(abs(total_amount - parts_sum) > 2, true) OR NOT any_part
           OR coalesce(payment_type_id = 1 AND tip_amount IS NULL, false) AS odd
  FROM (SELECT *, coalesce(CAST(vendor_id AS VARCHAR), CAST(pickup_datetime AS VARCHAR),
                  CAST(dropoff_datetime AS VARCHAR), CAST(passenger_count AS VARCHAR),
                  CAST(trip_distance AS VARCHAR), CAST(rate_code_id AS VARCHAR), store_and_forward_flag,
                  CAST(pickup_location_id AS VARCHAR), CAST(dropoff_location_id AS VARCHAR),
                  CAST(payment_type_id AS VARCHAR), CAST(fare_amount AS VARCHAR),
                  CAST(extra_charge AS VARCHAR), CAST(tip_amount AS VARCHAR), CAST(total_amount AS VARCHAR),
                  CAST(congestion_surcharge AS VARCHAR)) IS NULL AS gone_row
        FROM measured))"""

# The kept rows after flagging and imputation. A filled tip adds nothing to the sum of
# parts but makes one part present, so every missing total is filled.
CLEAN = TAGGED + """,
clean AS (
  SELECT * REPLACE (
           coalesce(tip_amount, 0) AS tip_amount,
           coalesce(passenger_count, 1) AS passenger_count,
           coalesce(store_and_forward_flag, 'UNKNOWN') AS store_and_forward_flag,
           coalesce(total_amount, parts_sum) AS total_amount,
           odd AS suspicious),
         tip_amount IS NULL AS no_tip, passenger_count IS NULL AS no_passengers,
         store_and_forward_flag IS NULL AS no_flag, total_amount IS NULL AS no_total
  FROM tagged WHERE reject_reason IS NULL)"""

MODEL_ROWS = CLEAN + """,
model_rows AS (
  SELECT o, p, s, n, trip_distance, pickup_location_id, dropoff_location_id, payment_type_id,
         fare_amount, tip_amount, year, month,
         hour(pickup_datetime) AS pickup_hour, day(pickup_datetime) AS pickup_day,
         dayofweek(pickup_datetime) + 1 AS pickup_weekday,
         hour(dropoff_datetime) AS dropoff_hour, day(dropoff_datetime) AS dropoff_day,
         dayofweek(dropoff_datetime) + 1 AS dropoff_weekday,
         CAST(secs AS BIGINT) AS trip_duration_sec,
         CASE WHEN secs > 0 THEN trip_distance / (secs / CAST(3600 AS DOUBLE)) END AS trip_speed
  FROM clean
  WHERE fare_amount >= 0 AND fare_amount < 500 AND tip_amount >= 0 AND tip_amount < 200
    AND trip_distance IS NOT NULL AND pickup_location_id IS NOT NULL AND dropoff_location_id IS NOT NULL
    AND payment_type_id IS NOT NULL)"""

FEATURES = (
    "trip_distance pickup_location_id dropoff_location_id payment_type_id fare_amount year month "
    "pickup_hour pickup_day pickup_weekday dropoff_hour dropoff_day dropoff_weekday "
    "trip_duration_sec trip_speed"
).split()

RAW = TRIPS + """,
raw AS (
  SELECT CASE WHEN s % 53 = 0 THEN '999' ELSE CAST(vendor_id AS VARCHAR) END AS VendorID,
         CASE WHEN o % 101 = 0 THEN 'not a time' ELSE strftime(pickup_datetime, '%Y-%m-%d %H:%M:%S') END
           AS tpep_pickup_datetime,
         strftime(dropoff_datetime, '%Y-%m-%d %H:%M:%S') AS tpep_dropoff_datetime,
         CASE WHEN p % 41 = 0 THEN 'x' ELSE CAST(CAST(passenger_count AS DOUBLE) AS VARCHAR) END AS passenger_count,
         CAST(trip_distance AS VARCHAR) AS trip_distance,
         CAST(rate_code_id AS VARCHAR) AS RatecodeID,
         store_and_forward_flag AS store_and_fwd_flag,
         CAST(pickup_location_id AS VARCHAR) AS PULocationID,
         CAST(dropoff_location_id AS VARCHAR) AS DOLocationID,
         CAST(payment_type_id AS VARCHAR) AS payment_type,
         CAST(fare_amount AS VARCHAR) AS fare_amount,
         CAST(extra_charge AS VARCHAR) AS extra,
         CASE WHEN p % 43 = 0 THEN 'NaN' END AS mta_tax,
         CAST(tip_amount AS VARCHAR) AS tip_amount,
         CAST(NULL AS VARCHAR) AS tolls_amount,
         CAST(NULL AS VARCHAR) AS improvement_surcharge,
         CAST(total_amount AS VARCHAR) AS total_amount,
         CAST(congestion_surcharge AS VARCHAR) AS congestion_surcharge,
         CAST(NULL AS VARCHAR) AS Airport_fee,
         CASE WHEN p % 2 = 0 THEN '1.0' END AS ehail_fee,
         CASE WHEN o % 103 = 0 THEN 'notes.csv'
              ELSE 'yellow_tripdata_' || lpad(CAST(year AS VARCHAR), 4, '0') || '-'
                   || lpad(CAST(month AS VARCHAR), 2, '0') || '.csv' END AS file_name
  FROM trips)"""

# The raw rows after the contract: what does not fit is NULL.
CONFORMED = RAW + """,
conformed AS (
  SELECT CASE WHEN VendorID <> '999' THEN CAST(VendorID AS BIGINT) END AS vendor_id,
         CAST(epoch(TRY_CAST(tpep_pickup_datetime AS TIMESTAMP)) AS BIGINT) AS pickup_datetime,
         CAST(epoch(TRY_CAST(tpep_dropoff_datetime AS TIMESTAMP)) AS BIGINT) AS dropoff_datetime,
         CAST(TRY_CAST(passenger_count AS DOUBLE) AS BIGINT) AS passenger_count,
         CAST(trip_distance AS DOUBLE) AS trip_distance,
         CAST(RatecodeID AS BIGINT) AS rate_code_id,
         CASE WHEN upper(trim(store_and_fwd_flag)) IN ('Y', 'N') THEN upper(trim(store_and_fwd_flag)) END
           AS store_and_forward_flag,
         CAST(PULocationID AS BIGINT) AS pickup_location_id,
         CAST(DOLocationID AS BIGINT) AS dropoff_location_id,
         CAST(payment_type AS BIGINT) AS payment_type_id,
         CAST(fare_amount AS DOUBLE) AS fare_amount,
         CAST(extra AS DOUBLE) AS extra_charge,
         CAST(NULL AS DOUBLE) AS metered_rate_tax,
         CAST(tip_amount AS DOUBLE) AS tip_amount,
         CAST(tolls_amount AS DOUBLE) AS tolls_amount,
         CAST(improvement_surcharge AS DOUBLE) AS improvement_surcharge,
         CAST(total_amount AS DOUBLE) AS total_amount,
         CAST(congestion_surcharge AS DOUBLE) AS congestion_surcharge,
         CAST(Airport_fee AS DOUBLE) AS airport_fee,
         CAST(NULL AS DOUBLE) AS cbd_congestion_fee,
         CAST(nullif(regexp_extract(file_name, 'yellow_tripdata_(\\d{4})-(\\d{2})\\.csv$', 1), '') AS BIGINT) AS year,
         CAST(nullif(regexp_extract(file_name, 'yellow_tripdata_(\\d{4})-(\\d{2})\\.csv$', 2), '') AS BIGINT) AS month,
         'USD' AS currency, 'Miles' AS trip_distance_unit, false AS suspicious
  FROM raw)"""


def query(ctes: str, select: str, double: str = "") -> str:
    """A whole query; the columns named in ``double`` are returned as doubles."""
    if double:
        casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in double.split())
        select = f"SELECT * REPLACE ({casts}) FROM ({select.strip()})"
    return f"WITH {ctes.strip()}\n{select.strip()}"
