from __future__ import annotations

import datetime as dt

import pytest

from millrace.operators import impute, rules
from millrace.plans import taxi
from millrace.session import session_conf

T0 = dt.datetime(2024, 1, 31, 12)


def _trip(**changes):
    trip = dict(
        vendor_id=1, pickup_datetime=T0, dropoff_datetime=T0 + dt.timedelta(minutes=30), passenger_count=1,
        trip_distance=5.0, rate_code_id=1, store_and_forward_flag="N", pickup_location_id=10,
        dropoff_location_id=20, payment_type_id=1, fare_amount=10.0, extra_charge=1.0, metered_rate_tax=0.5,
        tip_amount=2.0, tolls_amount=0.0, improvement_surcharge=1.0, total_amount=14.5,
        congestion_surcharge=None, airport_fee=None, cbd_congestion_fee=None, year=2024, month=1,
        currency="USD", trip_distance_unit="Miles", suspicious=False,
    )
    return {**trip, **changes}


def _trips(spark, *changes):
    return spark.createDataFrame([tuple(_trip(**c).values()) for c in changes], taxi.CONTRACT.schema)


_NOTHING = {c: None for c in taxi.SOURCE_COLUMNS}
_NO_CRITICAL = {c: None for c in taxi.CRITICAL}


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None),
        (_NOTHING, "rows_all_columns_missing"),
        (_NO_CRITICAL, "rows_missing_critical_columns"),
        ({**_NO_CRITICAL, "fare_amount": 1.0}, "invalid_timestamps"),
        ({"dropoff_datetime": T0}, "invalid_timestamps"),
        ({"dropoff_datetime": T0 - dt.timedelta(seconds=1)}, "invalid_timestamps"),
        ({"pickup_datetime": None}, "invalid_timestamps"),
        ({"month": 2}, "month_leaked_rows"),
        ({"year": None}, "month_leaked_rows"),
        ({"trip_distance": -0.1, "passenger_count": -1}, "negative_trip_distance"),
        ({"trip_distance": None}, None),
        ({"passenger_count": -1}, "unrealistic_passenger_count"),
        ({"passenger_count": None}, None),
        ({"trip_distance": 60.0}, "unrealistic_trip_speed"),
        ({"trip_distance": 59.999}, None),
    ],
)
def test_first_failing_rule(spark, change, reason):
    df = _trips(spark, change)
    assert rules.tag(df, taxi.trip_rules()).collect()[0][rules.REASON] == reason
    assert rules.keep_only(df, taxi.trip_rules()).count() == (reason is None)


def test_speed_limit_can_include_the_limit(spark):
    df = _trips(spark, {"trip_distance": 60.0}, {"trip_distance": 60.1}, {"dropoff_datetime": T0})
    args = ("trip_distance", "pickup_datetime", "dropoff_datetime", 120.0)
    assert rules.apply_rule(df, rules.within_speed(*args)).count() == 1
    assert rules.apply_rule(df, rules.within_speed(*args, inclusive=True)).count() == 2


def test_no_critical_columns_rejects_nothing(spark):
    df = _trips(spark, _NOTHING)
    assert rules.apply_rule(df, rules.has_critical_value([])).count() == 1


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, False),
        ({"total_amount": 16.5}, False),  # off by exactly the tolerance
        ({"total_amount": 17.0}, True),
        ({"total_amount": None}, True),
        ({c: None for c in taxi.AMOUNTS}, True),
        ({"tip_amount": None, "total_amount": 12.5}, True),
        ({"tip_amount": None, "total_amount": 12.5, "payment_type_id": 2}, False),
        ({"tip_amount": None, "total_amount": 12.5, "payment_type_id": None}, False),
        ({"airport_fee": float("nan")}, False),
        ({"tip_amount": float("nan"), "total_amount": 12.5}, True),
    ],
)
def test_suspicious_flag(spark, change, expected):
    assert taxi.flag_suspicious(_trips(spark, change)).collect()[0].suspicious is expected


def test_kept_and_rejected_make_up_the_input(spark):
    df = _trips(spark, {}, {"month": 2}, {"trip_distance": -1.0}, {}, _NOTHING)
    tagged = taxi.clean(df)
    counts = {r.outcome: r.n_rows for r in rules.reject_summary(tagged).collect()}
    assert counts == {"kept": 2, "month_leaked_rows": 1, "negative_trip_distance": 1, "rows_all_columns_missing": 1}
    assert rules.kept(tagged).count() + rules.rejected(tagged).count() == df.count()


def test_rejected_rows_keep_their_values(spark):
    df = _trips(spark, {"month": 2, "tip_amount": None, "total_amount": None})
    row = taxi.clean(df).collect()[0]
    assert (row.tip_amount, row.total_amount, row.suspicious) == (None, None, False)


def test_clean_kept_is_clean_then_kept(spark):
    df = _trips(
        spark, {}, {"month": 2}, {"tip_amount": None}, {"total_amount": None}, {"passenger_count": None},
        {"store_and_forward_flag": None, "trip_distance": None},
    )
    a, b = rules.kept(taxi.clean(df)), taxi.clean_kept(df)
    assert a.columns == b.columns == taxi.CONTRACT.names
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert b.count() == 5


def test_imputation_keeps_types_and_counts(spark):
    df = _trips(spark, {"tip_amount": None}, {"passenger_count": None, "total_amount": None}, {})
    done = taxi.clean_kept(df, mark=True)
    assert done.schema["passenger_count"].dataType == taxi.CONTRACT.field("passenger_count").type
    counts = {r.marker: r.n_rows for r in impute.imputation_counts(done).collect()}
    assert counts == {
        "imputed_tip_amount": 1,
        "imputed_passenger_count": 1,
        "imputed_store_and_forward_flag": 0,
        "imputed_total_amount": 1,
        "filled_total_amount": 1,
    }
    assert sorted(r.total_amount for r in done.collect()) == [14.5, 14.5, 14.5]


def test_total_without_parts_is_counted_but_not_filled(spark):
    df = _trips(spark, {**{c: None for c in taxi.AMOUNTS}, "total_amount": None})
    row = impute.impute_total(df, "total_amount", taxi.AMOUNTS).collect()[0]
    assert (row.total_amount, row.imputed_total_amount, row.filled_total_amount) == (None, 1, 0)


def test_imputation_counts_of_nothing_are_zero(spark):
    done = taxi.clean_kept(_trips(spark, {"month": 2}), mark=True)
    assert {r.n_rows for r in impute.imputation_counts(done).collect()} == {0}


def test_complete_cases_and_bounds(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 1), (None, 1), (2.0, None), (500.0, 2)], "x double, n int")
    assert rules.complete_cases(df, ["x", "n"]).count() == 2
    assert [r.x for r in rules.within_bounds(df, [("x", 1.0, 500.0)]).collect()] == [1.0, 2.0]


def test_rules_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    _trips(spark, {}, {"trip_distance": -1.0}).write.parquet(path)

    def plan(df):
        with session_conf(spark, spark__sql__maxMetadataStringLength="10000"):
            return df._jdf.queryExecution().executedPlan().toString()

    clean = plan(taxi.clean_kept(spark.read.parquet(path)))
    pushed = clean.split("PushedFilters")[1]
    assert "IsNotNull(pickup_datetime)" in pushed and "GreaterThanOrEqual(trip_distance,0.0)" in pushed
    report = plan(taxi.top_routes(taxi.clean_kept(spark.read.parquet(path))))
    assert "TakeOrderedAndProject" in report
    assert "store_and_forward_flag" not in report.split("ReadSchema")[1]
