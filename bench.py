"""Time the headline jobs and print one JSON line.

Input and lake are prepared before the clock starts. Every job is run once to warm the
JVM and then ``BENCH_RUNS`` times; the median counts. Reports are written to the noop
sink, which computes every column: counting a report would let Spark drop its sums.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.trips import raw_trips, table, trips  # noqa: E402
from millrace.operators import ordering, profile, regression, reports, rules, runstats  # noqa: E402
from millrace.plans import lakebuild, taxi  # noqa: E402
from millrace.session import DEFAULTS, scratch_path  # noqa: E402
from millrace.sources import csv, lake  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
#: Jobs that go through all raw rows; the others read the clean lake, but for two with tables of their own.
FROM_RAW = {"ingest_count", "ingest_all_cells", "clean_profile", "build_with_rejects", "build_with_lost_cells", "persist", "reject_summary"}
LAKE: dict[str, str] = {}


def session() -> SparkSession:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def jobs(spark: SparkSession) -> dict[str, Callable[[], object]]:
    raw_path, lake_path, loose_path = (scratch_path(spark, n) for n in ("bench-csv", "bench-lake", "bench-loose"))
    raw = raw_trips(spark, SF_DIR).withColumnRenamed("file_name", "origin").repartitionByRange(int(CPUS), "origin")
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(raw_path)
    LAKE["path"] = lake_path
    clean = taxi.clean_kept(trips(spark, SF_DIR))
    lake.write_partitioned(clean, lake_path)
    lake.write_partitioned(clean.repartition(int(CPUS)), loose_path, gather=False)

    def conform(rows: DataFrame) -> DataFrame:
        return taxi.conform(rows.drop("file_name").withColumnRenamed("origin", "file_name"))

    def scan() -> DataFrame:
        return csv.csv_scan(spark, raw_path, taxi.CONTRACT)

    def stored() -> DataFrame:
        return spark.read.parquet(lake_path)

    def clean_and_profile() -> None:
        rows = taxi.clean_kept(conform(scan()))
        once = profile.profile_once(rows, ["vendor_id"], taxi.PROFILED, taxi.CONTRACT.names)
        path = scratch_path(spark, "bench-profile")
        once.write.parquet(path)
        sink(profile.missing_of(spark.read.parquet(path)))
        sink(profile.groups_of(spark.read.parquet(path)))

    def build() -> None:
        built = lakebuild.store_outcomes(taxi.clean(conform(scan())), scratch_path(spark, "bench-build"))
        sink(built.summary())

    def mllib() -> None:
        split = taxi.split_model_rows(stored())
        features = taxi.feature_names(split)
        _, predicted = regression.fit_predict(split, features, taxi.ML_TARGET)
        sink(regression.regression_metrics(predicted, taxi.ML_TARGET, "prediction"))

    def from_moments() -> None:
        split = taxi.split_model_rows(stored())
        features = taxi.feature_names(split)
        learned = regression.centred_moments(split.where(~F.col("is_test")), features, taxi.ML_TARGET)
        model = regression.solve_centred(learned, features, taxi.ML_TARGET)
        predicted = model.predict(split.where("is_test"))
        sink(regression.regression_metrics(predicted, taxi.ML_TARGET, "prediction"))

    def from_factors() -> None:
        split = taxi.split_model_rows(stored())
        features = taxi.feature_names(split)
        model = regression.solve_factor(regression.factors(split.where(~F.col("is_test")), features, taxi.ML_TARGET), features, taxi.ML_TARGET)
        sink(regression.regression_metrics(model.predict(split.where("is_test")), taxi.ML_TARGET, "prediction"))

    def counted_build() -> None:
        raw = taxi.CONTRACT.mark_lost(csv.csv_scan(spark, raw_path, taxi.CONTRACT, rescue=True), csv.RESCUED)
        lakebuild.store_outcomes(taxi.clean(conform(raw), mark=True), scratch_path(spark, "bench-counted"))

    return {
        "ingest_count": lambda: reports.row_count(scan()).collect(),
        "ingest_all_cells": lambda: sink(scan()),
        "clean_profile": clean_and_profile,
        "build_with_rejects": build,
        "persist": lambda: lake.write_partitioned(
            conform(scan()).transform(taxi.clean_kept), scratch_path(spark, "bench-out")
        ),
        "compact": lambda: lake.compact_partitions(
            spark, loose_path, scratch_path(spark, "bench-compact")
        ).collect(),
        "q1_monthly_payment": lambda: sink(taxi.monthly_payments(stored())),
        "q2_top_routes": lambda: sink(taxi.top_routes(stored())),
        "q3_hourly_speed": lambda: sink(taxi.hourly_speed(stored())),
        "row_count": lambda: reports.row_count(stored()).collect(),
        "profile_missing": lambda: sink(profile.profile_missing(stored())),
        "profile_by_group": lambda: sink(profile.profile_by_group(stored(), ["vendor_id"], taxi.PROFILED)),
        "profile_by_group_exact": lambda: sink(
            profile.profile_by_group(stored(), ["vendor_id"], taxi.PROFILED, "exact")
        ),
        "reject_summary": lambda: sink(rules.reject_summary(rules.tag(trips(spark, SF_DIR), taxi.trip_rules()))),
        "suspicious_sample": lambda: sink(ordering.fixed_sample(stored().where("suspicious"), 50)),
        "run_summary": lambda: sink(
            runstats.run_summary(
                table(spark, SF_DIR, "orders"), ["o_orderdate", "o_orderkey"], ["o_totalprice"], ["o_orderstatus"]
            )
        ),
        "array_stats": lambda: sink(runstats.array_stats(table(spark, SF_DIR, "embeddings"), ["label"], "embedding")),
        "regression_mllib": mllib,
        "regression_moments": from_moments,
        "regression_factors": from_factors,
        "build_with_lost_cells": counted_build,
        "footer_stats": lambda: sink(reports.footer_stats(spark, lake_path, list(taxi.PROFILED), lake.MONTHLY)),
    }


def main() -> None:
    spark = session()
    prepared = jobs(spark)
    only = sys.argv[1:]
    seconds = {}
    for name, job in prepared.items():
        if only and name not in only:
            continue
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name}: {times}", file=sys.stderr, flush=True)
    raw = trips(spark, SF_DIR).count()
    kept = spark.read.parquet(LAKE["path"]).count()
    other = {"run_summary": "orders", "array_stats": "embeddings"}
    rows = {n: raw if n in FROM_RAW else table(spark, SF_DIR, other[n]).count() if n in other else kept for n in seconds}
    print(
        json.dumps(
            {
                "metric": "headline jobs, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "rows": rows,
                "rows_per_sec": {n: round(rows[n] / s) for n, s in seconds.items() if s > 0},
                "cpus": int(CPUS),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
