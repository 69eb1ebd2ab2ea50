"""From CSV files to a lake, in one run and incrementally, on files made from the test data."""

from __future__ import annotations

import glob
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.trips import raw_trips
from millrace.operators import profile, regression, rules
from millrace.plans import lakebuild, taxi
from millrace.sources import csv, lake
from millrace.streaming import incremental

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def month_files(spark, tmp_path_factory):
    """Six monthly CSV files under their real names."""
    base = tmp_path_factory.mktemp("csv")
    rows = raw_trips(spark, SF).where(F.col("file_name").between("yellow_tripdata_1997-01", "yellow_tripdata_1997-06z"))
    staged, landing = str(base / "staged"), str(base / "landing")
    rows.repartition("file_name").write.partitionBy("file_name").option("header", True).csv(staged)
    os.makedirs(landing)
    for folder in glob.glob(f"{staged}/file_name=*"):
        (part,) = glob.glob(f"{folder}/*.csv")
        shutil.copy(part, f"{landing}/{folder.split('=')[1]}")
    assert len(os.listdir(landing)) == 6
    return landing


def _expected(spark, landing):
    raw = spark.read.option("header", True).csv(landing).withColumn("file_name", F.col("_metadata.file_name"))
    return taxi.clean(taxi.conform(raw))


def _digest(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def test_lake_build(spark, month_files, tmp_path):
    root = str(tmp_path / "build")
    for _ in range(2):
        built = lakebuild.build_lake(spark, month_files, root)
    tagged = _expected(spark, month_files)
    assert _digest(built.trips()) == _digest(rules.kept(tagged))
    assert {tuple(r) for r in built.summary().collect()} == {tuple(r) for r in rules.reject_summary(tagged).collect()}
    assert len(glob.glob(f"{built.path}/year=*/month=*/*.parquet")) == 6
    assert "Exchange" not in tagged._jdf.queryExecution().executedPlan().toString()
    once = built.profiled()
    assert profile.missing_of(once).collect() == built.missing().collect()
    assert _digest(profile.groups_of(once)) == _digest(built.by_vendor())
    plain = lakebuild.build_lake(spark, month_files, str(tmp_path / "plain"), gather=False)
    assert _digest(plain.all_rows()) == _digest(built.all_rows())
    counts = {r.reject_reason: r.n_rows for r in built.quarantine(str(tmp_path / "rejects")).collect()}
    assert sum(counts.values()) == rules.rejected(tagged).count()
    assert set(os.listdir(tmp_path / "rejects")) >= {f"reject_reason={r}" for r in counts}


def test_profile_of_a_build_takes_few_jobs(spark, month_files, tmp_path):
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("build", "build")
    built = lakebuild.build_lake(spark, month_files, str(tmp_path / "build"))
    built.missing().collect()
    built.by_vendor().collect()
    jobs = tracker.getJobIdsForGroup("build")
    sc.setLocalProperty("spark.jobGroup.id", None)
    # Header, write, two schema look-ups, and for each profile its adaptive stages.
    assert len(jobs) <= 10


def test_a_kept_row_needs_its_month(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 2024, 1, None), (2, None, None, "bad")], "id int, year int, month int, reject_reason string"
    )
    built = lakebuild.store_outcomes(rows, str(tmp_path / "a"))
    assert {tuple(r) for r in built.summary().collect()} == {("kept", 1), ("bad", 1)}
    with pytest.raises(Exception, match="partition column year is NULL"):
        lakebuild.store_outcomes(rows.withColumn("reject_reason", F.lit(None).cast("string")), str(tmp_path / "b"))


def test_incremental_equals_one_run(spark, month_files, tmp_path):
    landing, root, progress = (str(tmp_path / d) for d in ("landing", "root", "progress"))
    os.makedirs(landing)
    files = sorted(os.listdir(month_files))
    schema = taxi.CONTRACT.reading_schema(csv.header_of(spark, month_files))

    def ingest():
        return incremental.ingest_available(
            incremental.file_stream(spark, landing, schema, max_files=2), root, progress
        )

    for name in files[:4]:
        shutil.copy(f"{month_files}/{name}", landing)
    assert ingest() == range(2)
    half = incremental.stored_rows(spark, root).count()
    target = str(tmp_path / "lake")
    incremental.publish(spark, root, target)
    early = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{target}/*/*/*.parquet")}
    assert ingest() == range(0)  # nothing new
    incremental.publish(spark, root, target, since=range(0))
    assert incremental.stored_rows(spark, root).count() == half
    for name in files[4:]:
        shutil.copy(f"{month_files}/{name}", landing)
    new = ingest()
    tagged = _expected(spark, month_files)
    assert _digest(incremental.stored_trips(spark, root)) == _digest(rules.kept(tagged))
    assert incremental.stored_rows(spark, root).count() == tagged.count()
    whole = profile.profile_missing(rules.kept(tagged), taxi.CONTRACT.names).collect()
    assert incremental.merged_profile(spark, root).collect() == whole

    incremental.publish(spark, root, target, since=new)
    assert _digest(spark.read.parquet(target)) == _digest(rules.kept(tagged))
    # The months of the first batches were left alone.
    assert {f: os.stat(f).st_mtime_ns for f in early} == early
    for _ in range(2):
        incremental.publish(spark, root, target)
    assert _digest(spark.read.parquet(target)) == _digest(rules.kept(tagged))
    assert all(r.n_files == 1 for r in lake.file_stats(spark.read.parquet(target), lake.MONTHLY).collect())


def test_batches_are_stored_without_sorting(spark, month_files, tmp_path, monkeypatch):
    """As in a build: a sort would hold a task's rows unpacked. A batch has a session of its own."""
    frame, name, seen = type(spark.range(1)), "spark.sql.maxConcurrentOutputFileWriters", []
    write = frame.write.fget
    monkeypatch.setattr(frame, "write", property(lambda self: seen.append((int(self.sparkSession.conf.get(name, "0")), "at_month" in self.columns)) or write(self)))
    schema = taxi.CONTRACT.reading_schema(csv.header_of(spark, month_files))
    root, progress = str(tmp_path / "root"), str(tmp_path / "progress")
    assert incremental.ingest_available(incremental.file_stream(spark, month_files, schema, max_files=3), root, progress) == range(2)
    assert [n for n, is_rows in seen if is_rows] == [lake.OPEN_FILES] * 2
    files = glob.glob(f"{root}/rows/batch=*/*/*/*/*.parquet")
    assert files and len(files) == len({f.rpartition("/")[0] for f in files})
    assert _digest(incremental.stored_trips(spark, root)) == _digest(rules.kept(_expected(spark, month_files)))


def test_learning_incrementally_equals_learning_at_once(spark, month_files, tmp_path):
    trips = rules.kept(_expected(spark, month_files))
    lake_path, root, progress = (str(tmp_path / d) for d in ("lake", "moments", "progress"))
    trips.repartition(5).write.parquet(lake_path)
    features = taxi.feature_names(taxi.model_rows(trips))
    assert len(features) == 15
    stream = incremental.file_stream(spark, lake_path, trips.schema, max_files=2, format="parquet")
    table = incremental.learn_available(stream, root, progress, taxi.model_rows, features, taxi.ML_TARGET)
    own = regression.solve_centred(table, features, taxi.ML_TARGET)
    rows = taxi.model_rows(trips).withColumn("is_test", F.lit(False))
    estimator = regression.ols_estimator(features, taxi.ML_TARGET)
    both = own.predict(estimator.fit(rows).transform(rows), "own")
    got = both.select("prediction", "own", taxi.ML_TARGET, *features).toPandas()
    assert len(got) > 50
    # All rows at once, with the pseudo-inverse: the year is constant here.
    design = np.column_stack([np.ones(len(got)), got[features].astype(float)])
    exact = design @ np.linalg.lstsq(design, got[taxi.ML_TARGET], rcond=None)[0]
    assert got.own.tolist() == pytest.approx(exact.tolist(), abs=1e-7)
    # With a constant feature MLlib leaves the direct solution for an iterative one.
    assert got.own.tolist() == pytest.approx(got.prediction.tolist(), abs=1e-4)


def test_layouts_hold_all_rows_and_store_no_text_table(spark, tmp_path):
    """The CSV files are written from the typed trips; their text is not stored a second time before."""
    from checks import storage, trips

    sf, path = f"{SF}/.", str(tmp_path / "csv")  # a path of its own, whose tables nobody has stored
    storage._two_layouts(spark, sf, path, storage._raw_names(spark, sf) | {"file_name": "origin"})
    assert [name for _, folder, name in trips._stored if folder == sf] == ["trips"]
    headers = {tuple(r.header) for r in csv.header_lines(spark, path)}
    assert len(headers) == 2 and len({tuple(sorted(h)) for h in headers}) == 1
    raw = raw_trips(spark, sf).withColumnRenamed("file_name", "origin")
    back = csv.csv_scan(spark, path, mixed=True).select(*raw.columns)
    assert back.count() == raw.count() and back.exceptAll(raw).isEmpty()
