"""Cells lost and rows counted in the scan that builds; headers read by tasks; layout; footers; states of batches."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F, types as T

from millrace.operators import ordering, profile, reports, rules
from millrace.operators.contract import LOST, Contract, Field, coerce, loses
from millrace.plans import lakebuild, taxi
from millrace.sources import csv, lake

CONTRACT = Contract(
    (
        Field("b", T.ByteType(), "B"), Field("s", T.ShortType(), "S"), Field("i", T.IntegerType(), "I"), Field("l", T.LongType(), "L"), Field("f", T.FloatType(), "F"),
        Field("d", T.DoubleType(), "D"), Field("at", T.TimestampType(), "At"), Field("code", T.StringType(), "Code", ("Y",)), Field("absent", T.DoubleType(), "Absent"),
    )
)
CELLS = ["", "1", "1.0", "127", "127.9", "128", "-128.5", "-129", "32768", "2147483647.5", "2147483648", "9223372036854775808", "1e400", "NaN", "x", " 7", "Infinity", "2020-01-02 03:04:05", "y"]


def _files(folder, seed: int = 0) -> None:
    folder.mkdir()
    rng = random.Random(seed)
    for n, header in enumerate((["B", "S", "I", "L", "F", "D", "At", "Code"], ["Code", "D", "odd`one", "B", "At", "L", "I", "S", "F"])):
        lines = [",".join(header), *(",".join(rng.choice(CELLS) for _ in header) for _ in range(150))]
        (folder / f"part {n} 100%.csv").write_text("\n".join(lines) + "\n")


def test_lost_cells_in_the_typed_scan_are_those_of_the_text(spark, tmp_path):
    _files(tmp_path / "in")
    path = str(tmp_path / "in")
    want = {r.column_name: r.lost_values for r in csv.lost_cells(spark, path, CONTRACT).collect()}
    raw = csv.csv_scan(spark, path, CONTRACT, mixed=True, rescue=True)
    counts = CONTRACT.lost_counts()
    marked = CONTRACT.apply(CONTRACT.mark_lost(raw, csv.RESCUED))
    assert marked.columns == [*CONTRACT.names, LOST]
    got = marked.agg(*(c.alias(n) for n, c in counts.items())).first().asDict()
    assert got.pop("absent") == 0 and got == {n: v for n, v in want.items() if n in got}
    assert min(got.values()) > 0 and "code" not in got
    # The values are those of a scan without rescue.
    plain = CONTRACT.apply(csv.csv_scan(spark, path, CONTRACT, mixed=True))
    text = [F.col(c).cast("string") for c in CONTRACT.names]  # a year of five digits is no date for Python
    assert sorted(map(str, plain.select(text).collect())) == sorted(map(str, marked.select(text).collect()))


def test_rescued_cells_keep_their_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('D,Code,I\n1.5,Y,3\nabc,"q, x",4\n,Y,\n2,N,"1,5"\n')
    rows = csv.csv_scan(spark, str(tmp_path / "a.csv"), CONTRACT, rescue=True).collect()
    assert [(r.D, r.Code, r.I, r.rescued) for r in rows] == [
        (1.5, "Y", 3.0, None), (None, "q, x", 4.0, {"D": "abc"}), (None, "Y", None, None), (2.0, "N", None, {"I": "1,5"})
    ]


@pytest.mark.parametrize("kind", [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()])
def test_a_comparison_loses_what_the_cast_loses(spark, kind):
    edges = [float(e * 2**b + o) for b in (7, 15, 31, 63) for e in (1, -1) for o in (-1.5, -1, -0.5, 0, 0.5, 1)] + [0.0, float("nan"), float("inf"), -float("inf"), None]
    df = spark.createDataFrame([(e,) for e in edges], "x double")
    want = Field("x", kind)
    cast = F.col("x").isNotNull() & coerce(F.col("x"), T.DoubleType(), want).isNull()
    assert df.where(~loses(F.col("x"), T.DoubleType(), want).eqNullSafe(cast)).collect() == []


def test_a_build_counts_what_it_stores(spark, tmp_path):
    header = ",".join(f.source for f in taxi.CONTRACT.fields if f.source)
    good = "1,2020-01-05 10:00:00,2020-01-05 10:30:00,{p},5,1,N,7,8,1,20,0.5,0,2,0,0,{total},2.5,0,0"
    lines = [good.format(p=1, total=25), good.format(p="many", total=25), good.format(p=999999, total=""), good.format(p=-1, total=25), ",".join([""] * 20)]
    (tmp_path / "yellow_tripdata_2020-01.csv").write_text("\n".join([header, *lines]) + "\n")
    built = lakebuild.build_lake(spark, str(tmp_path / "*.csv"), str(tmp_path / "lake"))
    assert {k: v for k, v in built.counts.outcomes.items() if v} == {"kept": 3, "unrealistic_passenger_count": 1, "rows_all_columns_missing": 1}
    assert {k: v for k, v in built.counts.lost.items() if v} == {"passenger_count": 2}
    assert built.counts.imputed["imputed_passenger_count"] == 2 and built.counts.imputed["filled_total_amount"] == 1
    assert {r.outcome: r.n_rows for r in built.summary().collect()} == {k: v for k, v in built.counts.outcomes.items() if v}
    assert set(built.trips().columns) == set(taxi.CONTRACT.names)


def test_a_build_counts_in_one_job_and_nothing_of_nothing(spark, tmp_path):
    tagged = rules.tag(taxi.conform(spark.createDataFrame([], "file_name string")), taxi.trip_rules())
    none = lakebuild.store_outcomes(tagged, str(tmp_path / "none"))
    assert sum(none.counts.outcomes.values()) == 0
    odd = spark.createDataFrame([(1, 2020, 1, "mine"), (2, 2020, 1, None)], "v int, year int, month int, reject_reason string")
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    built = lakebuild.store_outcomes(odd, str(tmp_path / "odd"), gather=False)
    assert len(before.getJobIdsForGroup("build")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert built.counts.outcomes["kept"] == 1 and built.counts.outcomes[lakebuild.OTHER] == 1


def test_headers_are_read_by_tasks(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a b%20.csv").write_text("﻿V,\"w, x\"\r\n" + "1,2\r\n" * 50_000)
    (folder / "c.csv").write_text("V,\"w, x\"\n1,2\n")
    with gzip.open(folder / "d.csv.gz", "wt") as f:
        f.write("W\n5\n")
    (folder / "empty.csv").write_text("")
    found = {r.path.rsplit("/", 1)[1]: r.header for r in csv.header_lines(spark, str(folder))}
    assert found == {"a b%20.csv": ["V", "w, x"], "c.csv": ["V", "w, x"], "d.csv.gz": ["W"]}
    assert csv.csv_scan(spark, str(folder), mixed=True).count() == 50_002


def test_headers_of_split_files_need_no_python(spark, tmp_path, monkeypatch):
    """Only the piece a file begins with has its header, and no line goes through a Python worker."""
    (tmp_path / "a.csv").write_text("V,W\n" + "1,2\n" * 5_000)
    (tmp_path / "b.csv").write_text("W\n" + "5\n" * 5_000)
    monkeypatch.setattr("millrace.sources.csv._SPLIT", 1_000)
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", None)
    found = sorted((r.path.rsplit("/", 1)[1], r.header) for r in csv.header_lines(spark, str(tmp_path)))
    assert found == [("a.csv", ["V", "W"]), ("b.csv", ["W"])]


# --- layout --------------------------------------------------------------------------------


def _scanned(df) -> int:
    """Rows that the scan of an executed query gave out, and the query's result."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan.executedPlan() if "Adaptive" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
    return sum(found)


def test_clustered_layout_skips_row_groups(spark, tmp_path):
    n = 60_000
    rows = spark.range(n).select(F.lit(2020).alias("year"), F.lit(1).alias("month"), *(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(250)).cast("short").alias(c) for c in ("a", "b")), F.rand(1).alias("v"))
    path, loose = str(tmp_path / "z"), str(tmp_path / "loose")
    lake.write_clustered(rows, path, ["a", "b"], bloom=["a"], row_group_mib=0.02)
    lake.write_partitioned(rows, loose)
    for condition in ("a = 17", "b between 100 and 103", "a > 240 and b < 10"):
        some, all_rows = (spark.read.parquet(p).where(condition).select("v") for p in (path, loose))
        assert some.count() == all_rows.count() > 0
        assert _scanned(some) < 0.4 * n, condition
    assert spark.read.parquet(path).count() == n and set(spark.read.parquet(path).columns) == {"year", "month", "a", "b", "v"}


def test_z_order_keys_take_turns(spark):
    df = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)] + [(None, 0)], "x int, y int")
    got = {(r.x, r.y): r._z for r in lake.z_order(df, ["x", "y"], bits=2).collect()}
    assert len({got[x, y] for x in range(4) for y in range(4)}) >= 9 and got[0, 0] <= got[3, 0] <= got[3, 3]
    assert got[None, 0] >= got[3, 0]
    with pytest.raises(ValueError):
        lake.z_order(df, ["x"], bits=63)


def test_footers_answer_counts_and_bounds(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 3).cast("int").alias("month"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("x"), F.col("id").cast("string").alias("t"))
    path = str(tmp_path / "t")
    lake.write_partitioned(rows, path, ["month"])
    with lake.session_conf(spark, **reports.FROM_FOOTERS):
        plan = reports.footer_query(spark, path, ["x"], ["month"])._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [COUNT(*), COUNT(x), MIN(x), MAX(x)]" in plan and "PushedGroupBy: [month]" in plan
    one = reports.footer_stats(spark, path, ["x", "t"]).first()
    assert (one.n_rows, one.x_missing, one.x_min, one.x_max, one.t_missing) == (1000, 143, 1.0, 999.0, 0) and "t_min" not in one.asDict()
    by = {r.month: (r.n_rows, r.x_max) for r in reports.footer_stats(spark, path, ["x"], ["month"]).collect()}
    assert by == {0: (334, 999.0), 1: (333, 997.0), 2: (333, 998.0)}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


# --- states --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [3, 50, 500])
def test_samples_of_pieces_merge_to_the_sample(spark, n):
    rows = spark.range(200).select("id", (F.col("id") % 5).alias("piece"))
    want = sorted(r.id for r in ordering.fixed_sample(rows.select("id"), n).collect())
    parts = [ordering.lowest_draws(rows.where(f"piece = {p}").select("id"), n) for p in range(5)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    assert sorted(r.id for r in ordering.merge_lowest(merged, n, ["id"]).collect()) == want


def test_partial_profiles_merge_far_from_zero(spark):
    rows = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.col("id") % 8).alias("piece"), F.when(F.col("id") % 3 < 2, F.lit(1.7e9) + F.rand(3)).alias("x"))
    whole = profile.profile_of(profile.merge_profiles(profile.partial_profile(rows, ["piece", "g"], ["x"]), ["g"], ["x"]), ["g"], ["x"])
    want = {r.g: r for r in profile.profile_by_group(rows, ["g"], ["x"], "exact").collect()}
    for r in whole.collect():
        e = want[r.g]
        assert (r.x_count, r.x_min, r.x_max) == (e.x_count, e.x_min, e.x_max)
        if r.x_count:
            assert r.x_mean == pytest.approx(e.x_mean) and r.x_stddev == pytest.approx(e.x_stddev, rel=1e-6)
            assert abs(r.x_median - e.x_median) < 0.02
        else:
            assert (r.x_mean, r.x_median, r.x_stddev) == (None, None, None)


def test_distinct_sketches_merge(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 90).alias("few"), F.lit(None).cast("int").alias("none"), (F.col("id") % 4).alias("piece"))
    parts = [profile.distinct_sketches(rows.where(f"piece = {p}"), ["id", "few", "none"]) for p in range(4)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = {r.column_name: (r.n_rows, r.n_null, r.n_distinct) for r in profile.merge_distinct(merged).collect()}
    assert got["few"] == (20_000, 0, 90) and got["none"] == (20_000, 20_000, 0)
    assert abs(got["id"][2] - 20_000) < 4 * 0.016 * 20_000
