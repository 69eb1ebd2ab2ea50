from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from millrace.operators.contract import Contract, Field
from millrace.operators import reports
from millrace.plans import lakebuild
from millrace.sources import csv, lake
from pyspark.sql import types as T


def _rows(spark, n=300, months=5):
    return spark.range(n).select(
        "id", F.lit(2024).alias("year"), (F.col("id") % months + 1).cast("int").alias("month")
    )


def _files(path):
    return glob.glob(f"{path}/**/*.parquet", recursive=True)


def test_writing_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "lake")
    for _ in range(2):
        lake.write_partitioned(_rows(spark), path)
    assert spark.read.parquet(path).count() == 300
    assert len(_files(path)) == 5


def test_dynamic_replaces_only_the_partitions_written(spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.write_partitioned(_rows(spark), path)
    lake.write_partitioned(_rows(spark, 10, 1), path)
    counts = {r.month: r["count"] for r in spark.read.parquet(path).groupBy("month").count().collect()}
    assert counts == {1: 10, 2: 60, 3: 60, 4: 60, 5: 60}
    lake.write_partitioned(_rows(spark, 10, 1), path, replace="static")
    assert spark.read.parquet(path).count() == 10


def test_a_null_partition_key_stops_the_write(spark, tmp_path):
    path = str(tmp_path / "lake")
    bad = _rows(spark).withColumn("month", F.when(F.col("id") != 7, F.col("month")))
    assert lake.partition_violations(bad).collect()[0].asDict() == {"n_rows": 300, "n_valid": 299, "n_violations": 1}
    for gather in (True, False):
        with pytest.raises(Exception, match="partition column month is NULL"):
            lake.write_partitioned(bad, path, gather=gather)
    assert _files(path) == []


def test_a_failed_write_leaves_the_old_partitions(spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.write_partitioned(_rows(spark), path)
    bad = _rows(spark, 500).withColumn("month", F.when(F.col("id") != 7, F.col("month")))
    with pytest.raises(Exception, match="partition column month is NULL"):
        lake.write_partitioned(bad, path)
    assert spark.read.parquet(path).count() == 300


def test_a_large_partition_is_split_over_files(spark, tmp_path):
    rows = spark.range(400_000, numPartitions=8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
        F.lit(2024).alias("year"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40 + 2).cast("int").alias("month"),
    )
    path = str(tmp_path / "lake")
    lake.write_partitioned(rows, path, target_mib=1)
    assert len(glob.glob(f"{path}/year=2024/month=1/*.parquet")) > 2
    assert spark.read.parquet(path).count() == 400_000
    # The setting is only borrowed.
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) != "1048576b"


@pytest.fixture
def open_files(spark, monkeypatch):
    """How many files tasks may keep open, as set for each write; with none open their rows are sorted first."""
    seen, frame = [], type(spark.range(1))
    write = frame.write.fget
    name = "spark.sql.maxConcurrentOutputFileWriters"
    monkeypatch.setattr(frame, "write", property(lambda self: seen.append(int(spark.conf.get(name, "0"))) or write(self)))
    return seen


def test_gathered_writes_sort_no_rows(spark, tmp_path, open_files):
    """A sort holds a task's rows unpacked, several times what was shuffled; tasks not gathered may hold anything and do sort."""
    lake.write_partitioned(_rows(spark), str(tmp_path / "lake"))
    lake.persist_checked(_rows(spark), str(tmp_path / "checked"))
    assert open_files == [lake.OPEN_FILES] * 2
    lake.write_partitioned(_rows(spark), str(tmp_path / "loose"), gather=False)
    assert open_files[2:] == [0] and len(_files(str(tmp_path / "lake"))) == 5


def test_quarantine_sorts_no_rows(spark, tmp_path, open_files):
    rows = _rows(spark).withColumn("reject_reason", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b"))
    found = lake.write_quarantine(rows, str(tmp_path / "rejects")).collect()
    assert sorted(map(tuple, found)) == [("a", 100), ("b", 100)] and open_files[:1] == [lake.OPEN_FILES]


def test_builds_sort_no_rows(spark, tmp_path, open_files):
    rows = _rows(spark).withColumn("reject_reason", F.when(F.col("id") % 3 == 0, "month_leaked_rows"))
    built = lakebuild.store_outcomes(rows, str(tmp_path / "build"))
    assert built.counts.outcomes["kept"] == 200 and open_files[:1] == [lake.OPEN_FILES]
    lakebuild.store_outcomes(rows, str(tmp_path / "loose"), gather=False)
    assert open_files[1] == 0


def _most_folders(path, kind):
    """The most directories that one task has written to."""
    found = {}
    for f in glob.glob(f"{path}/**/*.{kind}", recursive=True):
        folder, name = f.rsplit("/", 1)
        found.setdefault(name.split("-")[1], set()).add(folder)
    return max(map(len, found.values()))


def _many_folders(spark):
    text = F.sha2(F.col("id").cast("string"), 256).alias("text")
    return spark.range(400_000, numPartitions=4).select(text, (F.col("id") % 800).cast("int").alias("place"))


def test_a_build_opens_few_files_in_a_task(spark, tmp_path):
    """However few the cores and shuffle partitions: a file beyond OPEN_FILES would bring the sort back."""
    rows = _many_folders(spark).withColumns(
        {"year": F.expr("2000 + place div 20"), "month": F.expr("place % 20"), "reject_reason": F.lit(None).cast("string")}
    )
    built = lakebuild.store_outcomes(rows, str(tmp_path / "build"))
    assert built.counts.outcomes["kept"] == 400_000 and len(_files(built.root)) == 800
    assert _most_folders(built.root, "parquet") <= lake.OPEN_FILES // 2


def test_quarantine_opens_few_files_in_a_task(spark, tmp_path):
    rows = _many_folders(spark).withColumn("reject_reason", F.format_string("rule %d", "place"))
    found = lake.write_quarantine(rows, str(tmp_path / "rejects")).collect()
    assert len(found) == 800 and {r.n_rows for r in found} == {500}
    assert _most_folders(str(tmp_path / "rejects"), "csv") <= lake.OPEN_FILES // 2


def test_compaction_merges_files_and_reports(spark, tmp_path):
    scattered, compact = str(tmp_path / "a"), str(tmp_path / "b")
    lake.write_partitioned(_rows(spark).repartition(6), scattered, gather=False)
    for _ in range(2):
        report = lake.compact_partitions(spark, scattered, compact, row_group_mib=8).collect()
        assert len(_files(compact)) == 5
    assert len(report) == 5 and all(r.ok for r in report)
    assert {(r.n_files_in, r.n_files_out, r.n_rows_out) for r in report} == {(6, 1, 60)}
    assert all(r.size_mib_out > 0 for r in report)
    with pytest.raises(ValueError):
        lake.compact_partitions(spark, scattered, scattered + "/")


def test_verification_finds_what_is_missing(spark, tmp_path):
    rows = _rows(spark)
    partial = rows.where("month < 5 and id <> 0").unionByName(_rows(spark, 3, 1).withColumn("month", F.lit(9)))
    report = {r.month: (r.expected_rows, r.actual_rows, r.ok) for r in lake.verify_readback(rows, partial).collect()}
    assert report == {
        1: (60, 59, False), 2: (60, 60, True), 3: (60, 60, True), 4: (60, 60, True), 5: (60, 0, False), 9: (0, 3, False),
    }


def test_file_stats(spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.write_partitioned(_rows(spark), path)
    total = lake.file_stats(spark.read.parquet(path)).collect()[0]
    assert (total.n_files, total.n_rows) == (5, 300) and total.size_mib > 0
    assert lake.file_stats(spark.read.parquet(path), ["month"]).count() == 5


def test_rows_per_file_of_csv(spark, tmp_path):
    (tmp_path / "a-2024-01.csv").write_text("x\n1\n2\n")
    (tmp_path / "b-2024-02.csv").write_text("x\n3\n")
    rows = lake.rows_per_file(spark.read.option("header", True).csv(str(tmp_path))).collect()
    assert {(r.file_path.rsplit("/", 1)[1], r.n_rows) for r in rows} == {("a-2024-01.csv", 2), ("b-2024-02.csv", 1)}


def test_a_month_range_reads_only_its_directories(spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.write_partitioned(_rows(spark), path)
    some = reports.month_range(spark.read.parquet(path), (2024, 2), (2024, 3))
    assert {r.month for r in some.collect()} == {2, 3}
    assert {f.split("month=")[1][0] for f in some.inputFiles()} >= {"2", "3"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert lake.file_stats(some).collect()[0].n_files == 2


def test_sql_over_a_path(spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.write_partitioned(_rows(spark), path)
    assert reports.query_path(spark, "SELECT max(id) AS top FROM {lake} WHERE month = 2", path).collect()[0].top == 296


def test_quarantine_has_a_folder_per_rule(spark, tmp_path):
    tagged = _rows(spark).withColumn(
        "reject_reason", F.when(F.col("id") < 10, "low").when(F.col("id") > 290, "high")
    )
    path = str(tmp_path / "rejects")
    for _ in range(2):
        counts = {r.reject_reason: r.n_rows for r in lake.write_quarantine(tagged, path).collect()}
    assert counts == {"low": 10, "high": 9}
    assert spark.read.option("header", True).csv(f"{path}/reject_reason=low").columns == ["id", "year", "month"]


def test_retype_takes_keys_from_directories(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    spark.sql(
        "SELECT TIMESTAMP_NTZ '2024-03-01 01:00:00' AS at, 5L AS code, 2024 AS year, 3 AS month"
        " UNION ALL SELECT NULL, 900L, 2024, 12"
    ).write.partitionBy("year", "month").parquet(old)
    contract = Contract(
        (
            Field("at", T.TimestampType()), Field("code", T.ByteType()),
            Field("year", T.IntegerType()), Field("month", T.IntegerType()),
        )
    )
    lake.retype(spark, old, new, contract)
    out = spark.read.parquet(new)
    assert [f.dataType for f in out.schema] == [f.type for f in contract.fields]
    assert {(r.code, r.year, r.month) for r in out.collect()} == {(5, 2024, 3), (None, 2024, 12)}


def test_reports_are_saved_as_csv_and_json(spark, tmp_path):
    path = str(tmp_path / "report")
    lake.write_report(spark.createDataFrame([("a", 1)], "name string, n int"), path)
    assert spark.read.option("header", True).csv(f"{path}/csv").collect()[0].name == "a"
    assert spark.read.json(f"{path}/json").collect()[0].n == 1


def test_csv_header_is_checked_and_layouts_unite(spark, tmp_path):
    old, new, mixed = (tmp_path / d for d in ("old", "new", "mixed"))
    for folder in (old, new, mixed):
        folder.mkdir()
    (old / "yellow_tripdata_2023-12.csv").write_text("a,b\n1,2\n3,\n")
    (new / "yellow_tripdata_2024-01.csv").write_text("b,a,c\n20,10,30\n")
    (mixed / "x-2024-02.csv").write_text("a,b\n1,2\n")
    (mixed / "y-2024-03.csv").write_text("b,a\n2,1\n")
    rows = csv.csv_scan(spark, [str(old), str(new)])
    keyed = rows.withColumns(csv.year_month_from(F.col("file_name"), r"(\d{4})-(\d{2})\.csv$"))
    got = {(r.a, r.b, r.c, r.year, r.month) for r in keyed.collect()}
    assert got == {("1", "2", None, 2023, 12), ("3", None, None, 2023, 12), ("10", "20", "30", 2024, 1)}
    with pytest.raises(Exception, match="header does not conform"):
        csv.csv_scan(spark, str(mixed)).collect()


def test_csv_header_is_checked_for_narrow_reads_too(spark, tmp_path):
    (tmp_path / "x-2024-02.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y-2024-03.csv").write_text("b,a\n2,1\n")
    with pytest.raises(Exception, match="header does not conform"):
        csv.csv_scan(spark, str(tmp_path)).select("a").collect()


def test_ragged_csv_lines_keep_the_rest(spark, tmp_path):
    (tmp_path / "t-2024-01.csv").write_text("a,b\n1\n1,2,3\n,\n")
    rows = csv.csv_scan(spark, str(tmp_path)).select("a", "b").collect()
    assert [tuple(r) for r in rows] == [("1", None), ("1", "2"), (None, None)]
