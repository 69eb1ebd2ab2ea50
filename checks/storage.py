"""Checks of sources and sinks. Files go to fresh paths under the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.registry import check
from checks.sql import CLEAN, CONFORMED, RAW, TAGGED, TRIPS, query
from checks.trips import KEYS, flat, raw_lines, raw_trips, table, trips
from millrace.operators import ordering, profile, reports
from millrace.plans import taxi
from millrace.plans.lakebuild import build_lake, store_outcomes
from millrace.session import scratch_path
from millrace.sources import csv, lake
from millrace.sources.snapshots import SnapshotTable
from millrace.streaming import incremental


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxi.clean_kept(trips(spark, sf_dir))


#: Trips in one of the files that a check scatters its rows over: tasks that write them stay of one size.
PIECE_ROWS = 1_000_000


def _pieces(spark: SparkSession, sf_dir: str, least: int) -> int:
    """How many files to scatter the trips over: ``least``, of larger tables more. Counted from footers."""
    return max(least, -(-trips(spark, sf_dir).count() // PIECE_ROWS))


def _clean_lake(spark: SparkSession, sf_dir: str, label: str) -> str:
    path = scratch_path(spark, label)
    lake.write_partitioned(_clean(spark, sf_dir), path)
    return path


def _two_layouts(spark: SparkSession, sf_dir: str, path: str, names: dict[str, str]) -> None:
    """The raw trips, columns renamed by ``names`` (others left out), as CSV files of two column orders in one folder.

    A trip is made into text only for the layout it goes to, and its text is not stored anywhere else.
    """
    odd = F.pmod(F.xxhash64(*KEYS), F.lit(2)) == 1
    for where, columns in ((odd, list(names)), (~odd, list(names)[::-1])):
        part = raw_lines(spark, sf_dir, where).select(*(F.col(c).alias(names[c]) for c in columns))
        part.write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)


def _raw_names(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    return {c: c for c in raw_lines(spark, sf_dir).columns if c != "file_name"}


@check(
    "csv_scan",
    query(
        RAW,
        """
        SELECT store_and_fwd_flag, payment_type, count(*) AS n_rows, count(mta_tax) AS n_taxes,
               count(tpep_pickup_datetime) AS n_pickups, sum(CAST(total_amount AS DOUBLE)) AS sum_total
        FROM raw GROUP BY store_and_fwd_flag, payment_type""",
    ),
)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    _two_layouts(spark, sf_dir, path, _raw_names(spark, sf_dir))
    return (
        csv.csv_scan(spark, path, mixed=True)
        .groupBy("store_and_fwd_flag", "payment_type")
        .agg(
            F.count("*").alias("n_rows"),
            F.count("mta_tax").alias("n_taxes"),
            F.count("tpep_pickup_datetime").alias("n_pickups"),
            F.sum(F.col("total_amount").try_cast("double")).alias("sum_total"),
        )
    )


@check(
    "csv_lost_cells",
    """
    SELECT * FROM (
      SELECT 'vendor_id' AS column_name, count(*) FILTER (l_suppkey % 53 = 0) AS lost_values FROM lineitem UNION ALL
      SELECT 'passenger_count', count(*) FILTER (l_partkey % 41 = 0) FROM lineitem UNION ALL
      SELECT 'pickup_datetime', count(*) FILTER (l_orderkey % 101 = 0) FROM lineitem UNION ALL
      SELECT 'metered_rate_tax', count(*) FILTER (l_partkey % 43 = 0) FROM lineitem)
    WHERE lost_values > 0""",
)
def csv_lost_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lost")
    _two_layouts(spark, sf_dir, path, _raw_names(spark, sf_dir))
    lost = csv.lost_cells(spark, path, taxi.CONTRACT)
    return lost.where("lost_values > 0").select("column_name", "lost_values")


@check(
    "file_stats",
    query(
        CLEAN,
        """
        SELECT year, month, true AS few_files, count(*) AS n_rows, true AS has_size
        FROM clean GROUP BY year, month""",
    ),
)
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(_clean_lake(spark, sf_dir, "stats"))
    stats = lake.file_stats(stored, lake.MONTHLY)
    few = F.col("n_files") <= F.ceil(F.col("size_mib") / lake.TARGET_MIB) + 1
    return flat(stats.select("year", "month", few.alias("few_files"), "n_rows", (F.col("size_mib") > 0).alias("has_size")))


@check(
    "filename_columns",
    query(
        RAW,
        """
        SELECT CAST(nullif(regexp_extract(file_name, '(\\d{4})-(\\d{2})', 1), '') AS BIGINT) AS year,
               CAST(nullif(regexp_extract(file_name, '(\\d{4})-(\\d{2})', 2), '') AS BIGINT) AS month,
               count(*) AS n_rows
        FROM raw GROUP BY 1, 2""",
        "year month",
    ),
)
def filename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = csv.year_month_from(F.col("file_name"))
    rows = raw_trips(spark, sf_dir).select("file_name").withColumns(parts)
    return flat(rows.groupBy("year", "month").agg(F.count("*").alias("n_rows")), "year month")


_BY_PAYMENT = """
    SELECT payment_type_id, count(*) AS n_rows, sum(total_amount) AS sum_total, min(trip_distance) AS min_distance
    FROM {table} WHERE fare_amount > 20 GROUP BY payment_type_id"""


@check("parquet_scan", query(CLEAN, _BY_PAYMENT.format(table="clean"), "payment_type_id"))
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _clean_lake(spark, sf_dir, "scan")
    return flat(reports.query_path(spark, _BY_PAYMENT.format(table="{lake}"), path))


@check(
    "persist_partitioned",
    query(
        CLEAN,
        """
        SELECT year, month, count(*) AS n_rows, sum(total_amount) AS sum_total,
               CAST(min(epoch(pickup_datetime)) AS BIGINT) AS first_pickup
        FROM clean GROUP BY year, month""",
    ),
)
def persist_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(_clean_lake(spark, sf_dir, "persist"))
    return flat(
        stored.groupBy("year", "month").agg(
            F.count("*").alias("n_rows"),
            F.sum("total_amount").alias("sum_total"),
            F.min(F.unix_timestamp("pickup_datetime")).alias("first_pickup"),
        )
    )


@check(
    "partition_key_guard",
    query(
        CONFORMED,
        """
        SELECT count(*) AS n_rows, count(*) FILTER (year IS NOT NULL AND month IS NOT NULL) AS n_valid,
               count(*) FILTER (year IS NULL OR month IS NULL) AS n_violations
        FROM conformed""",
    ),
)
def partition_key_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.partition_violations(taxi.conform(raw_trips(spark, sf_dir)))


@check(
    "verify_readback",
    query(
        CLEAN,
        """
        SELECT year, month, count(*) AS expected_rows, count(*) AS actual_rows, true AS ok
        FROM clean GROUP BY year, month""",
    ),
)
def verify_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(_clean_lake(spark, sf_dir, "verify"))
    return flat(lake.verify_readback(_clean(spark, sf_dir), stored))


@check(
    "compact_partitions",
    query(
        CLEAN,
        """
        SELECT year, month, true AS few_files, count(*) AS n_rows_in, count(*) AS n_rows_out, true AS ok
        FROM clean GROUP BY year, month""",
    ),
)
def compact_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scattered, compacted = scratch_path(spark, "scattered"), scratch_path(spark, "compacted")
    lake.write_partitioned(_clean(spark, sf_dir).repartition(_pieces(spark, sf_dir, 4)), scattered, gather=False)
    report = lake.compact_partitions(spark, scattered, compacted)
    few = F.col("n_files_out") <= F.ceil(F.col("size_mib_out") / lake.TARGET_MIB) + 1
    return flat(report.select("year", "month", few.alias("few_files"), "n_rows_in", "n_rows_out", "ok"))


@check(
    "quarantine_write",
    query(
        TAGGED,
        "SELECT reject_reason, count(*) AS n_rows FROM tagged WHERE reject_reason IS NOT NULL GROUP BY reject_reason",
    ),
)
def quarantine_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = taxi.with_speed_metrics(taxi.clean(trips(spark, sf_dir)))
    return lake.write_quarantine(tagged, scratch_path(spark, "quarantine"))


@check(
    "store_outcomes",
    query(
        TAGGED,
        """
        SELECT coalesce(reject_reason, 'kept') AS outcome, year, month, count(*) AS n_rows,
               CAST(sum(passenger_count) AS BIGINT) AS sum_passengers
        FROM (SELECT * REPLACE (CASE WHEN reject_reason IS NULL THEN coalesce(passenger_count, 1)
                                     ELSE passenger_count END AS passenger_count) FROM tagged)
        GROUP BY 1, 2, 3""",
        "sum_passengers",
    ),
)
def lake_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = store_outcomes(taxi.clean(trips(spark, sf_dir)), scratch_path(spark, "build"), gather=True)
    rows = built.all_rows()
    return flat(
        rows.groupBy("outcome", "year", "month").agg(
            F.count("*").alias("n_rows"), F.sum("passenger_count").alias("sum_passengers")
        ),
        "sum_passengers",
    )


@check(
    "suspicious_sample",
    query(
        CLEAN,
        """
        SELECT o AS l_orderkey, p AS l_partkey, s AS l_suppkey, CAST(n AS BIGINT) AS l_linenumber, total_amount
        FROM clean WHERE suspicious
        ORDER BY (o * 31 + p * 17 + s * 7 + n) % 1009, o, p, s, n LIMIT 50""",
    ),
)
def suspicious_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taxi.clean_kept(trips(spark, sf_dir, KEYS)).where("suspicious")
    draw = (
        F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_suppkey") * 7 + F.col("l_linenumber")
    ) % 1009
    picked = ordering.fixed_sample(rows.select(*KEYS, "total_amount"), 50, key=KEYS, draw=draw)
    return flat(picked)


@check(
    "lake_retype",
    query(
        CLEAN,
        """
        SELECT year, month, 'timestamp' AS pickup_type, 'tinyint' AS vendor_type, count(*) AS n_rows,
               CAST(sum(vendor_id) AS BIGINT) AS sum_vendor,
               CAST(min(epoch(pickup_datetime)) AS BIGINT) AS first_pickup
        FROM clean GROUP BY year, month""",
    ),
)
def lake_retype(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose, typed = scratch_path(spark, "loose"), scratch_path(spark, "typed")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("pickup_datetime", "dropoff_datetime")}
    wide = {c: F.col(c).cast("bigint") for c in ("vendor_id", "rate_code_id", "passenger_count")}
    lake.write_partitioned(_clean(spark, sf_dir).withColumns({**times, **wide}), loose)
    lake.retype(spark, loose, typed, taxi.CONTRACT)
    stored = spark.read.parquet(typed)
    return flat(
        stored.groupBy(
            "year", "month", F.typeof("pickup_datetime").alias("pickup_type"), F.typeof("vendor_id").alias("vendor_type")
        ).agg(
            F.count("*").alias("n_rows"),
            F.sum("vendor_id").alias("sum_vendor"),
            F.min(F.unix_timestamp("pickup_datetime")).alias("first_pickup"),
        )
    )


_REPORT = """
    SELECT '{fmt}' AS format, column_name, missing_count, missing_percent FROM (
      SELECT 'tip_amount' AS column_name, count(*) FILTER (tip_amount IS NULL) AS missing_count,
             round(count(*) FILTER (tip_amount IS NULL) / count(*) * 100, 2) AS missing_percent FROM trips UNION ALL
      SELECT 'total_amount', count(*) FILTER (total_amount IS NULL),
             round(count(*) FILTER (total_amount IS NULL) / count(*) * 100, 2) FROM trips UNION ALL
      SELECT 'month', count(*) FILTER (month IS NULL),
             round(count(*) FILTER (month IS NULL) / count(*) * 100, 2) FROM trips)"""


@check("report_write", query(TRIPS, _REPORT.format(fmt="csv") + " UNION ALL " + _REPORT.format(fmt="json")))
def report_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    report = profile.profile_missing(trips(spark, sf_dir), ["tip_amount", "total_amount", "month"])
    lake.write_report(report, path)
    saved = {
        "csv": spark.read.schema(report.schema).option("header", True).csv(f"{path}/csv"),
        "json": spark.read.schema(report.schema).json(f"{path}/json"),
    }
    a, b = (df.select(F.lit(fmt).alias("format"), "*") for fmt, df in saved.items())
    return a.unionByName(b)


@check(
    "incremental_ingest",
    query(
        TAGGED,
        """
        SELECT coalesce(reject_reason, 'kept') AS outcome, count(*) AS n_rows, sum(fare_amount) AS sum_fare,
               count(*) FILTER (CASE WHEN reject_reason IS NULL THEN odd ELSE false END) AS n_suspicious
        FROM tagged GROUP BY 1""",
    ),
)
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing, root, checkpoint = (scratch_path(spark, label) for label in ("landing", "batches", "progress"))
    rows, files = trips(spark, sf_dir), _pieces(spark, sf_dir, 6)
    rows.repartition(files).write.parquet(landing)
    stream = incremental.file_stream(spark, landing, rows.schema, max_files=-(-files // 3), format="parquet")
    incremental.ingest_available(stream, root, checkpoint, conform=lambda batch: batch.drop("file_name"))
    return (
        incremental.stored_rows(spark, root)
        .groupBy("outcome")
        .agg(
            F.count("*").alias("n_rows"),
            F.sum("fare_amount").alias("sum_fare"),
            F.count_if("suspicious").alias("n_suspicious"),
        )
    )


@check(
    "incremental_publish",
    query(CLEAN, "SELECT year, month, count(*) AS n_rows, sum(fare_amount) AS sum_fare FROM clean GROUP BY year, month"),
)
def incremental_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals of files, several batches each, published as they come."""
    landing, root, checkpoint, target = (scratch_path(spark, label) for label in ("landing", "batches", "progress", "published"))
    rows, files = trips(spark, sf_dir), _pieces(spark, sf_dir, 4)
    first = F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == 0
    for part in (rows.where(first), rows.where(~first)):
        part.repartition(files).write.mode("append").parquet(landing)
        stream = incremental.file_stream(spark, landing, rows.schema, max_files=-(-files // 2), format="parquet")
        incremental.ingest_available(stream, root, checkpoint, conform=lambda batch: batch.drop("file_name"))
        incremental.publish_new(spark, root, target)
    return flat(spark.read.parquet(target).groupBy("year", "month").agg(F.count("*").alias("n_rows"), F.sum("fare_amount").alias("sum_fare")))


@check("row_count", "SELECT count(*) AS n_rows FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.row_count(table(spark, sf_dir, "lineitem"))


# --- what a build counts by itself ---------------------------------------------------------

_COUNTS = "kind string, name string, n_rows long"


@check(
    "build_lost_cells",
    query(
        RAW,
        """
        SELECT name, n_rows FROM (
          SELECT 'vendor_id' AS name, count(*) FILTER (VendorID = '999') AS n_rows FROM raw UNION ALL
          SELECT 'passenger_count', count(*) FILTER (passenger_count = 'x') FROM raw UNION ALL
          SELECT 'pickup_datetime', count(*) FILTER (tpep_pickup_datetime = 'not a time') FROM raw UNION ALL
          SELECT 'metered_rate_tax', count(*) FILTER (mta_tax = 'NaN') FROM raw UNION ALL
          SELECT 'rows', count(*) FROM raw)
        WHERE n_rows > 0""",
    ),
)
def build_lost_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells lost and rows written, as counted by the one job that parses the files and stores the rows."""
    path = scratch_path(spark, "lost")
    _two_layouts(spark, sf_dir, path, _raw_names(spark, sf_dir) | {"file_name": "origin"})

    def conform(rows: DataFrame) -> DataFrame:
        return taxi.conform(rows.drop("file_name").withColumnRenamed("origin", "file_name"))

    counts = build_lake(spark, path, scratch_path(spark, "build"), conform).counts
    found = [(name, n) for name, n in counts.lost.items() if n] + [("rows", sum(counts.outcomes.values()))]
    return spark.createDataFrame(found, "name string, n_rows long")


@check(
    "build_counts",
    query(
        TAGGED,
        """
        SELECT * FROM (
          SELECT 'outcome' AS kind, coalesce(reject_reason, 'kept') AS name, count(*) AS n_rows FROM tagged GROUP BY 2 UNION ALL
          SELECT 'imputed', 'imputed_tip_amount', count(*) FILTER (tip_amount IS NULL) FROM tagged WHERE reject_reason IS NULL UNION ALL
          SELECT 'imputed', 'imputed_passenger_count', count(*) FILTER (passenger_count IS NULL) FROM tagged WHERE reject_reason IS NULL UNION ALL
          SELECT 'imputed', 'imputed_store_and_forward_flag', count(*) FILTER (store_and_forward_flag IS NULL) FROM tagged WHERE reject_reason IS NULL UNION ALL
          SELECT 'imputed', 'imputed_total_amount', count(*) FILTER (total_amount IS NULL) FROM tagged WHERE reject_reason IS NULL UNION ALL
          SELECT 'imputed', 'filled_total_amount', count(*) FILTER (total_amount IS NULL) FROM tagged WHERE reject_reason IS NULL)
        WHERE n_rows > 0""",
    ),
)
def build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects per rule, imputations and rows kept, from the job that writes the lake."""
    built = store_outcomes(taxi.clean(trips(spark, sf_dir), mark=True), scratch_path(spark, "build"))
    return spark.createDataFrame([r for r in built.counts.rows() if r[2]], _COUNTS)


@check("persist_checked", query(CLEAN, "SELECT true AS ok, true AS has_files, true AS has_size, count(*) AS n_rows FROM clean"))
def persist_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lake.persist_checked(_clean(spark, sf_dir), scratch_path(spark, "persisted"))
    return spark.createDataFrame([(done.ok, done.n_files > 0, done.size_mib > 0, done.n_rows)], "ok boolean, has_files boolean, has_size boolean, n_rows long")


# --- versions, layout, footers -------------------------------------------------------------


@check(
    "snapshot_overwrite",
    query(
        CLEAN,
        """
        SELECT 'before' AS seen, year, month, count(*) AS n_rows, sum(fare_amount) AS sum_fare FROM clean GROUP BY year, month UNION ALL
        SELECT 'after', year, month, count(*), sum(fare_amount) + CASE WHEN month = 3 THEN count(fare_amount) ELSE 0 END
        FROM clean WHERE month <> 3 OR payment_type_id = 1 GROUP BY year, month""",
    ),
)
def snapshot_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that opened the table before some months were replaced, and one that did afterwards."""
    table = SnapshotTable(spark, scratch_path(spark, "table"))
    table.replace(_clean(spark, sf_dir))
    before = table.read()
    march = before.where("month = 3 AND payment_type_id = 1").withColumn("fare_amount", F.col("fare_amount") + 1)
    table.overwrite_partitions(march)
    both = [rows.select(F.lit(name).alias("seen"), "year", "month", "fare_amount") for name, rows in (("before", before), ("after", table.read()))]
    grouped = both[0].unionByName(both[1]).groupBy("seen", "year", "month")
    return flat(grouped.agg(F.count("*").alias("n_rows"), F.sum("fare_amount").alias("sum_fare")))


@check(
    "snapshot_compaction",
    query(
        CLEAN,
        """
        SELECT year, month, true AS few_files, true AS fewer_files, count(*) AS n_rows, sum(total_amount) AS sum_total
        FROM clean GROUP BY year, month""",
    ),
)
def snapshot_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small files per month, merged along a plan of bins; each task rewrites one bin."""
    table = SnapshotTable(spark, scratch_path(spark, "table"))
    table.replace(_clean(spark, sf_dir).repartition(_pieces(spark, sf_dir, 6)), gather=False)
    table.compact(target_mib=1)
    sizes = [table.files(v).groupBy("year", "month").agg(F.count("*").alias(f"files_{v}"), F.sum("bytes").alias(f"bytes_{v}")) for v in (1, 2)]
    few = (F.col("files_2") <= F.ceil(F.col("bytes_1") / lake.MIB) + 1).alias("few_files")
    fewer = ((F.col("files_2") < F.col("files_1")) | (F.col("files_1") == 1)).alias("fewer_files")
    rows = table.read().groupBy("year", "month").agg(F.count("*").alias("n_rows"), F.sum("total_amount").alias("sum_total"))
    return flat(rows.join(sizes[0], ["year", "month"]).join(sizes[1], ["year", "month"]).select("year", "month", few, fewer, "n_rows", "sum_total"))


@check(
    "footer_stats",
    query(
        CLEAN,
        """
        SELECT year, month, count(*) AS n_rows, count(*) FILTER (trip_distance IS NULL) AS trip_distance_missing,
               min(trip_distance) AS trip_distance_min, max(trip_distance) AS trip_distance_max,
               count(*) FILTER (vendor_id IS NULL) AS vendor_id_missing, min(vendor_id) AS vendor_id_min, max(vendor_id) AS vendor_id_max,
               0 AS pickup_datetime_missing
        FROM clean GROUP BY year, month""",
        "vendor_id_min vendor_id_max",
    ).replace("0 AS pickup", "CAST(0 AS BIGINT) AS pickup"),
)
def footer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _clean_lake(spark, sf_dir, "footers")
    return flat(reports.footer_stats(spark, path, ["trip_distance", "vendor_id", "pickup_datetime"], lake.MONTHLY))


@check(
    "clustered_scan",
    query(
        CLEAN,
        """
        SELECT dropoff_location_id, count(*) AS n_rows, sum(total_amount) AS sum_total
        FROM clean WHERE pickup_location_id = 7 AND dropoff_location_id < 5 GROUP BY dropoff_location_id""",
        "dropoff_location_id",
    ),
)
def clustered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes read from a lake that lies along a Z-order curve of both locations."""
    path = scratch_path(spark, "clustered")
    routes = ["pickup_location_id", "dropoff_location_id"]
    lake.write_clustered(_clean(spark, sf_dir), path, routes, bloom=routes)
    found = spark.read.parquet(path).where("pickup_location_id = 7 AND dropoff_location_id < 5")
    return flat(found.groupBy("dropoff_location_id").agg(F.count("*").alias("n_rows"), F.sum("total_amount").alias("sum_total")))


# --- states of batches ---------------------------------------------------------------------


def _batches(spark: SparkSession, sf_dir: str, rows: DataFrame, states: dict) -> str:
    """``rows`` as files of several batches, each stored with its states; rules have been applied before."""
    landing, root, checkpoint = (scratch_path(spark, label) for label in ("landing", "batches", "progress"))
    files = _pieces(spark, sf_dir, 6)
    rows.repartition(files).write.parquet(landing)
    stream = incremental.file_stream(spark, landing, rows.schema, max_files=-(-files // 3), format="parquet")
    untagged = F.lit(None).cast("string")
    incremental.ingest_available(stream, root, checkpoint, lambda b: b.drop("file_name"), lambda b: b.withColumn("reject_reason", untagged), states=states)
    return root


_SAMPLE_DRAW = "(l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber) % 1009"


@check(
    "batch_sample",
    query(
        CLEAN,
        """
        SELECT o AS l_orderkey, p AS l_partkey, s AS l_suppkey, CAST(n AS BIGINT) AS l_linenumber, total_amount
        FROM clean WHERE suspicious
        ORDER BY (o * 31 + p * 17 + s * 7 + n) % 1009, o, p, s, n LIMIT 50""",
    ),
)
def batch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of all batches from the lowest draws kept with each."""
    rows = taxi.clean_kept(trips(spark, sf_dir, KEYS)).select(*KEYS, "total_amount", "suspicious", "year", "month")

    def lowest(batch: DataFrame) -> DataFrame:
        return ordering.lowest_draws(batch.where("suspicious").select(*KEYS, "total_amount"), 50, KEYS, draw=F.expr(_SAMPLE_DRAW))

    kept = incremental.batch_states(spark, _batches(spark, sf_dir, rows, {"sample": lowest}), "sample")
    return flat(ordering.merge_lowest(kept.drop(incremental.BATCH), 50, KEYS))


_COUNTED = ("l_orderkey", "l_partkey", "vendor_id", "store_and_forward_flag", "passenger_count")


@check(
    "batch_distinct",
    query(
        CLEAN,
        """
        SELECT 'l_orderkey' AS column_name, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, count(DISTINCT o) AS n_distinct, true AS close FROM clean UNION ALL
        SELECT 'l_partkey', count(*), 0, count(DISTINCT p), true FROM clean UNION ALL
        SELECT 'vendor_id', count(*), count(*) FILTER (vendor_id IS NULL), count(DISTINCT vendor_id), true FROM clean UNION ALL
        SELECT 'store_and_forward_flag', count(*), 0, count(DISTINCT store_and_forward_flag), true FROM clean UNION ALL
        SELECT 'passenger_count', count(*), 0, count(DISTINCT passenger_count), true FROM clean""",
    ),
)
def batch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of all batches from their sketches, each within four standard errors of the true number."""
    rows = taxi.clean_kept(trips(spark, sf_dir, KEYS)).select(*_COUNTED, "year", "month")
    root = _batches(spark, sf_dir, rows, {"distinct": lambda batch: profile.distinct_sketches(batch, _COUNTED)})
    about = profile.merge_distinct(incremental.batch_states(spark, root, "distinct"))
    exact = profile.distinct_values(incremental.stored_trips(spark, root), _COUNTED).where("value IS NOT NULL")
    true_counts = exact.groupBy("column_name").agg(F.count("*").alias("true_distinct"))
    close = F.abs(F.col("n_distinct") - F.col("true_distinct")) <= F.greatest(F.lit(1.0), 4 * 0.016 * F.col("true_distinct"))
    return about.join(true_counts, "column_name").select("column_name", "n_rows", "n_null", F.col("true_distinct").alias("n_distinct"), close.alias("close"))
