"""Overwrites that fail, headers that differ, numbers far from zero, and other edges."""

from __future__ import annotations

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from millrace.operators import ordering, profile, regression, runstats
from millrace.operators.contract import Contract, Field
from millrace.plans import lakebuild
from millrace.session import durable, forget, replacing
from millrace.sources import csv, lake
from millrace.streaming import incremental


def _old(spark, path):
    lake.write_partitioned(spark.createDataFrame([(1, 2024, 1)], "v int, year int, month int"), path, replace="static")


def _read(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("gather", [True, False])
@pytest.mark.parametrize("late", [True, False])
def test_a_failed_rebuild_leaves_the_old_lake(spark, tmp_path, gather, late):
    path = str(tmp_path / "lake")
    _old(spark, path)
    rows = spark.range(400).select(F.col("id").cast("int").alias("v"), F.lit(2024).alias("year"), F.when(F.col("id") < 399, 2).alias("month"))
    if late:  # fails while files are being written
        rows = rows.fillna(2).withColumn("v", F.when(F.col("v") < 399, F.col("v")).otherwise(F.raise_error(F.lit("late")).cast("int")))
    with pytest.raises(Exception, match="late|is NULL"):
        lake.write_partitioned(rows, path, gather=gather, replace="static")
    assert _read(spark, path) == [(1, 2024, 1)]
    built = str(tmp_path / "built")
    good = spark.createDataFrame([(1, 2024, 1, None)], "v int, year int, month int, reject_reason string")
    lakebuild.store_outcomes(good, built, gather)
    with pytest.raises(Exception, match="late|is NULL"):
        lakebuild.store_outcomes(rows.withColumn("reject_reason", F.lit(None).cast("string")), built, gather)
    assert lakebuild.LakeBuild(spark, built).trips().count() == 1
    assert [p for p in os.listdir(tmp_path) if p.startswith("_")] == []


def test_replacing_needs_something_written(spark, tmp_path):
    with pytest.raises(FileNotFoundError), replacing(spark, str(tmp_path / "x")):
        pass


def test_rejects_of_a_former_run_go(spark, tmp_path):
    path, schema = str(tmp_path / "q"), "v int, reject_reason string"
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        lake.write_quarantine(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], schema), path)
        got = lake.write_quarantine(spark.createDataFrame([(4, "b")], schema), path).collect()
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    assert [tuple(r) for r in got] == [("b", 1)] and not (tmp_path / "q" / "reject_reason=a").exists()


CONTRACT = Contract((Field("v", T.ByteType(), "V"), Field("year", T.IntegerType()), Field("month", T.IntegerType())))


def test_retype_keeps_other_columns_and_counts_losses(spark, tmp_path):
    source = str(tmp_path / "fiscal_year=1999" / "lake")
    rows = spark.createDataFrame([(1.0, "x", 2024, 1), (300.0, "y", 2024, 2)], "v double, extra string, year int, month int")
    lake.write_partitioned(rows, source)
    lost = lake.retype(spark, source, str(tmp_path / "typed"), CONTRACT).collect()
    got = spark.read.parquet(str(tmp_path / "typed"))
    assert sorted((r.v is None, r.extra, r.year, r.month) for r in got.collect()) == [(False, "x", 2024, 1), (True, "y", 2024, 2)]
    assert got.schema["v"].dataType == T.ByteType()
    assert {r.column_name: r.lost_values for r in lost}["v"] == 1


def test_only_scattered_partitions_are_compacted(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    rows = spark.range(60).select(F.col("id"), F.lit(2024).alias("year"), (F.col("id") % 2 + 1).cast("int").alias("month"))
    rows.where("month = 1").repartition(5).write.partitionBy("year", "month").parquet(source)
    rows.where("month = 2").coalesce(1).write.mode("append").partitionBy("year", "month").parquet(source)
    where = lake.scattered(spark.read.parquet(source))
    report = lake.compact_partitions(spark, source, target, where=where).collect()
    assert [(r.month, r.n_files_in > 1, r.n_files_out, r.ok) for r in report] == [(1, True, 1, True)]
    assert spark.read.parquet(source).where(lake.scattered(spark.read.parquet(target))).count() == 0


def test_a_report_is_worked_out_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: (runs.add(1), v)[1], "double")
    report = spark.createDataFrame([(1, 0.123456), (2, 2.0)], "k int, v double").withColumn("v", seen("v"))
    for _ in range(2):
        lake.write_report(report, str(tmp_path / "r"), decimals=2)
    assert runs.value == 4
    assert sorted(r.v for r in spark.read.json(str(tmp_path / "r" / "json")).collect()) == [0.12, 2.0]
    assert len([f for f in os.listdir(tmp_path / "r" / "csv") if f.startswith("part-")]) == 1


def test_files_of_different_headers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("V,year\n1,2024\nx,2024\n")
    (folder / "b.csv").write_text("year,extra,V\n2024,7,3\n2024,8,999\n")
    (folder / "c.csv").write_text("")
    got = csv.csv_scan(spark, str(folder), mixed=True).collect()
    assert sorted((r.V, r.year, r.extra, r.file_name) for r in got) == [("1", "2024", None, "a.csv"), ("3", "2024", "7", "b.csv"), ("999", "2024", "8", "b.csv"), ("x", "2024", None, "a.csv")]
    lost = {r.column_name: r.lost_values for r in csv.lost_cells(spark, str(folder), CONTRACT).collect()}
    assert lost["v"] == 2 and lost["year"] == 0


def test_a_stream_of_files_of_different_headers(spark, tmp_path):
    landing, root, progress, target = (str(tmp_path / d) for d in ("in", "root", "progress", "lake"))
    os.makedirs(landing)

    def ingest():
        return incremental.ingest_available(
            incremental.path_stream(spark, landing, 2), root, progress,
            conform=lambda rows: CONTRACT.apply(rows, month=F.col("M").cast("int")), clean=lambda rows: rows.withColumn("reject_reason", F.lit(None).cast("string")),
            scan=lambda s, files: csv.csv_scan(s, files, mixed=True),
        )

    def put(name, text):
        (tmp_path / name).write_text(text)
        shutil.move(str(tmp_path / name), f"{landing}/{name}")

    put("a.csv", "V,year,M\n1,2024,1\n")
    put("b.csv", "M,V,more,year\n2,5,z,2024\n")
    assert ingest() == range(1)
    assert incremental.publish_new(spark, root, target) == 0
    for i, month in enumerate((3, 1, 2)):  # three files, two batches
        put(f"n{i}.csv", f"V,year,M\n{10 + i},2024,{month}\n")
    assert ingest() == range(1, 3)
    assert incremental.publish_new(spark, root, target) == 2
    want = [(1, 2024, 1), (5, 2024, 2), (10, 2024, 3), (11, 2024, 1), (12, 2024, 2)]
    assert _read(spark, target) == want
    assert incremental.publish_new(spark, root, target) == 2 and ingest() == range(0)
    plan = incremental.stored_rows(spark, root).where("at_year = 2024 and at_month = 3")._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_centred_moments_far_from_zero(spark):
    rng = np.random.default_rng(1)
    x, year = 1.7e9 + rng.random(3000), rng.integers(2009, 2025, 3000)
    y = 2.0 * (x - 1.7e9) + 0.5 * year + rng.normal(size=3000) * 0.001
    rows = [(float(a), int(b), float(c), i % 4) for i, (a, b, c) in enumerate(zip(x, year, y))] + [(None, 2020, 1.0, 0)]
    df = spark.createDataFrame(rows, "x double, year int, y double, piece int")
    whole = regression.solve_centred(regression.centred_moments(df, ["x", "year"], "y"), ["x", "year"], "y")
    pieces = regression.centred_moments(df, ["x", "year"], "y", ["piece"])
    merged = regression.solve_centred(regression.merge_centred(pieces), ["x", "year"], "y")
    assert whole.coefficients == pytest.approx((2.0, 0.5), abs=1e-3) and merged.coefficients == pytest.approx(whole.coefficients, rel=1e-6)
    with pytest.raises(ValueError, match="lost their digits"):
        regression.solve_moments(regression.moments(df.dropna(), ["x"], "y"), ["x"], "y")
    with pytest.raises(ValueError, match="no rows"):
        regression.solve_centred(regression.centred_moments(df.limit(0), ["x"], "y"), ["x"], "y")


def test_lists_that_cannot_be_read(spark):
    good = spark.createDataFrame([(1, "[1, 2]"), (1, " [3.0, 4] "), (1, ""), (1, None)], "g int, x string")
    assert runstats.array_stats(good, ["g"], "x").first().x_average == [2.0, 3.0]
    for text in ("garbage", "[3,nan]", "[3,\"a\"]", "{}"):
        with pytest.raises(Exception, match="not a list of numbers"):
            runstats.array_stats(good.union(spark.createDataFrame([(1, text)], good.schema)), ["g"], "x").collect()


def test_samples_with_odd_draws(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate([None, -5, 7, None, 0, 900])], "i int, d long")
    assert [r.i for r in ordering.fixed_sample(df, 4, ["i"], draw=F.col("d")).collect()] == [1, 4, 2, 5]
    assert ordering.fixed_sample(df, 10, ["i"], draw=F.col("d")).count() == 6


def test_shares(spark):
    ids = spark.range(100_000)
    n = regression.split_by_key(ids, ["id"], 0.0004).where("is_test").count()
    assert 10 < n < 90
    for share in (0, 1, -0.1, 1e-12):
        with pytest.raises(ValueError, match="share"):
            regression.split_by_key(ids, ["id"], share)


def test_nothing_to_group_by_and_nothing_kept(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "v double")
    exact = profile.profile_by_group(df, [], ["v"], "exact").first()
    assert (exact.v_count, exact.v_median, exact.v_mean) == (3, 2.0, 3.0)
    assert tuple(lake.partition_violations(df, []).first()) == (3, 3, 0)
    for call in (lake.verify_readback, lambda a, b, by: lake.compaction_report(spark, "", "", by)):
        with pytest.raises(ValueError, match="partition columns"):
            call(df, df, [])
    rejected = spark.createDataFrame([(1, 2024, 1, "bad")], "v int, year int, month int, reject_reason string")
    built = lakebuild.store_outcomes(rejected, str(tmp_path / "none"))
    assert built.trips().columns == ["v", "year", "month"] and built.trips().count() == 0


def test_the_sample_as_a_sink(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("int").alias("v"), (F.col("id") % 2 == 0).alias("suspicious"), F.lit(2024).alias("year"), F.lit(1).alias("month"), F.lit(None).cast("string").alias("reject_reason"))
    built = lakebuild.store_outcomes(rows, str(tmp_path / "lake"))
    assert tuple(built.sample_suspicious(str(tmp_path / "sample")).first()) == (100, 50)
    assert spark.read.option("header", True).csv(str(tmp_path / "sample")).where("suspicious = 'true'").count() == 50


def test_stored_tables_can_be_dropped(spark, tmp_path):
    kept = durable(spark.range(5), "t")
    forget(kept)
    with pytest.raises(Exception, match="FILE|exist"):
        kept.collect()
    spark.range(3).write.parquet(str(tmp_path / "own"))
    with pytest.raises(ValueError, match="shared folder"):
        forget(spark.read.parquet(str(tmp_path / "own")))


def test_summaries_store_only_what_they_need(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ordering, "durable", lambda df, *a: seen.append(df.columns) or durable(df, *a))
    df = spark.createDataFrame([(i, float(i), "x" * 9) for i in range(6)], "i int, v double, wide string")
    got = runstats.run_summary(df, ["i"], ["v"], size=3).orderBy("bucket").collect()
    assert [r.v_average for r in got] == [1.0, 4.0] and seen and all("wide" not in c for c in seen)
