from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F, types as T

from millrace.operators import contract
from millrace.operators.contract import Contract, Field, Mismatch
from millrace.plans import taxi

SMALL = Contract(
    (
        Field("code", T.ByteType(), "Code"),
        Field("amount", T.DoubleType(), "Amount"),
        Field("at", T.TimestampType(), "At"),
        Field("flag", T.StringType(), "Flag", ("Y", "N")),
        Field("big", T.LongType()),
    )
)


def test_rename_ignores_absent_names(spark):
    df = spark.createDataFrame([("1", "x")], "Code string, other string")
    assert SMALL.rename(df).columns == ["code", "other"]


def test_align_adds_typed_nulls_drops_and_orders(spark):
    df = spark.createDataFrame([("x", 1.5, "7")], "extra string, amount double, code string")
    aligned = SMALL.align(df)
    assert aligned.columns == SMALL.names
    assert aligned.schema["at"].dataType == T.TimestampType()
    assert aligned.collect()[0].asDict() == {"code": "7", "amount": 1.5, "at": None, "flag": None, "big": None}
    assert SMALL.differences(df) == (["at", "big", "flag"], ["extra"])


def test_enforce_makes_null_of_what_does_not_fit(spark):
    rows = [
        ("12", "1.5", "2024-02-29 10:00:00", " y"),
        ("1.0", "NaN", "2024-02-30 10:00:00", "N "),
        ("999", "x", "soon", "maybe"),
        ("x", "", "", ""),
        ("", None, None, None),
        (None, "-0.5", "2024-02-29", "n"),
    ]
    df = spark.createDataFrame(rows, "code string, amount string, at string, flag string")
    out = SMALL.enforce(df).collect()
    assert [r.code for r in out] == [12, 1, None, None, None, None]
    assert [r.amount for r in out] == [1.5, None, None, None, None, -0.5]
    assert out[0]["at"] == dt.datetime(2024, 2, 29, 10)
    assert [r["at"] is None for r in out] == [False, True, True, True, True, False]
    assert [r.flag for r in out] == ["Y", "N", None, None, None, "N"]


def test_enforce_from_numbers(spark):
    df = spark.createDataFrame([(300, float("nan"), 2**53 + 1), (5, 2.0, None)], "code int, amount double, big long")
    out = SMALL.enforce(df)
    assert [tuple(r) for r in out.collect()] == [(None, None, 2**53 + 1), (5, 2.0, None)]
    assert out.schema["code"].dataType == T.ByteType()


def test_long_text_keeps_every_digit(spark):
    df = spark.createDataFrame([("9007199254740993",), ("9007199254740993.0",)], "big string")
    assert [r.big for r in SMALL.enforce(df).collect()] == [9007199254740993] * 2


def test_wall_clock_timestamps_become_instants(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS at")
    out = SMALL.enforce(df)
    assert out.schema["at"].dataType == T.TimestampType()
    assert out.select(F.unix_seconds("at").alias("s")).collect()[0].s == 1704067200


def test_type_report_names_types_and_counts_losses(spark):
    df = spark.createDataFrame([("1", 2.0), ("x", 3.0), (None, 4.0), ("300", 1.0)], "code string, amount double")
    assert SMALL.mismatches(df.schema) == [Mismatch("code", "tinyint", "string")]
    assert [tuple(r) for r in contract.type_report(df, SMALL).collect()] == [("code", "tinyint", "string", 2)]
    fitting = SMALL.enforce(df)
    assert SMALL.mismatches(fitting.schema) == []
    assert contract.type_report(fitting, SMALL).count() == 0


def test_taxi_contract_from_raw_names(spark):
    raw = spark.createDataFrame(
        [("1", "2024-01-05 10:00:00", "Y", "yellow_tripdata_2024-01.csv"), ("2", None, "?", "other.csv")],
        "VendorID string, tpep_pickup_datetime string, store_and_fwd_flag string, file_name string",
    )
    out = taxi.conform(raw)
    assert out.schema == taxi.CONTRACT.schema or out.columns == taxi.CONTRACT.names
    first, second = out.collect()
    assert (first.vendor_id, first.year, first.month, first.currency, first.suspicious) == (1, 2024, 1, "USD", False)
    assert (second.year, second.month, second.store_and_forward_flag) == (None, None, None)
    assert [f.dataType for f in out.schema] == [f.type for f in taxi.CONTRACT.fields]


def test_reading_with_types_equals_reading_text(spark, tmp_path):
    from millrace.sources import csv

    (tmp_path / "a-2024-01.csv").write_text(
        "Code,Amount,At,Flag,note\n12,1.5,2024-02-29 10:00:00, y,p\n1.0,NaN,2024-02-30 10:00:00,N,q\n"
        "999,x,soon,maybe,r\nx,,,,\n 7 ,1e3,2024-02-29,n,s\n-1,Infinity,2024-02-29T10:00:00,Y,t\n"
    )
    typed = csv.csv_scan(spark, str(tmp_path), SMALL)
    assert [f.dataType.simpleString() for f in typed.schema][:5] == ["double", "double", "timestamp", "string", "string"]
    text = csv.csv_scan(spark, str(tmp_path))
    assert SMALL.apply(typed).collect() == SMALL.apply(text).collect()
    assert [r.code for r in SMALL.apply(typed).collect()] == [12, 1, None, None, 7, -1]
