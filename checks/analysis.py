"""Checks of profiles, reports, run statistics and regression."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.registry import ORACLES, check
from checks.sql import CLEAN, FEATURES, MODEL_ROWS, TRIPS, query
from checks.trips import KEYS, flat, rounded, table, trips
from millrace import functions as X
from millrace.operators import profile, regression, runstats
from millrace.plans import taxi
from millrace.session import durable, scratch_path


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxi.clean_kept(trips(spark, sf_dir))


def _profile_sql(median: str) -> str:
    return query(
        CLEAN,
        "SELECT vendor_id, "
        + ", ".join(
            f"count({c}) AS {c}_count, round(avg({c}), 6) AS {c}_mean, {median.format(c=c)} AS {c}_median, "
            f"round(stddev_samp({c}), 6) AS {c}_stddev, min({c}) AS {c}_min, max({c}) AS {c}_max"
            for c in taxi.PROFILED
        )
        + " FROM clean GROUP BY vendor_id",
        "vendor_id",
    )


@check("profile_by_group", _profile_sql("median({c})"))
def profile_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(rounded(profile.profile_by_group(_clean(spark, sf_dir), ["vendor_id"], taxi.PROFILED, "exact")))


# With an accuracy above the number of rows the sketch returns the lower median itself.
@check("profile_by_group_approx", _profile_sql("quantile_disc({c}, 0.5)"))
def profile_by_group_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.profile_by_group(
        _clean(spark, sf_dir), ["vendor_id"], taxi.PROFILED, "approx", accuracy=1_000_000
    )
    return flat(rounded(stats))


@check(
    "profile_median_rank",
    query(
        CLEAN,
        "SELECT vendor_id, " + ", ".join(f"count({c}) > 0 AS {c}_ok" for c in taxi.PROFILED) + " FROM clean GROUP BY vendor_id",
        "vendor_id",
    ),
)
def profile_median_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default accuracy: as many values lie below and above the approximate median as it promises."""
    rows = _clean(spark, sf_dir)
    stats = profile.profile_by_group(rows, ["vendor_id"], taxi.PROFILED).withColumnRenamed("vendor_id", "_vendor")
    both = rows.join(stats, rows["vendor_id"].eqNullSafe(stats["_vendor"]))
    slack = 0.5 + 1 / 10_000

    def close(c: str) -> Column:
        n, m = F.count(c), F.col(f"{c}_median")
        return ((F.count_if(F.col(c) < m) <= slack * n + 1) & (F.count_if(F.col(c) > m) <= slack * n + 1) & (n > 0)).alias(f"{c}_ok")

    return flat(both.groupBy("vendor_id").agg(*(close(c) for c in taxi.PROFILED)))


def _sketch_sql() -> str:
    stats = ", ".join(
        f"count({c}) AS {c}_count, round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_stddev, min({c}) AS {c}_min, max({c}) AS {c}_max, count({c}) > 0 AS {c}_ok"
        for c in taxi.PROFILED
    )
    return query(CLEAN, f"SELECT vendor_id, {stats} FROM clean GROUP BY vendor_id", "vendor_id")


@check("profile_sketches", _sketch_sql())
def profile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile by vendor of all months from partial ones stored by month; medians within 1 % of rank, tested on the rows."""
    rows = _clean(spark, sf_dir)
    path = scratch_path(spark, "partial-profiles")
    profile.partial_profile(rows, ["year", "month", "vendor_id"], taxi.PROFILED).write.parquet(path)
    whole = profile.merge_profiles(spark.read.parquet(path), ["vendor_id"], taxi.PROFILED)
    stats = profile.profile_of(whole, ["vendor_id"], taxi.PROFILED).withColumnRenamed("vendor_id", "_vendor")
    both = rows.join(stats, rows["vendor_id"].eqNullSafe(stats["_vendor"]))

    def close(c: str) -> Column:
        n, m = F.count(c), F.col(f"{c}_median")
        return ((F.count_if(F.col(c) < m) <= 0.51 * n + 1) & (F.count_if(F.col(c) > m) <= 0.51 * n + 1) & (n > 0)).alias(f"{c}_ok")

    told = both.groupBy("vendor_id").agg(*(close(c) for c in taxi.PROFILED)).withColumnRenamed("vendor_id", "_v")
    joined = stats.join(told, stats["_vendor"].eqNullSafe(told["_v"])).withColumnRenamed("_vendor", "vendor_id")
    return flat(rounded(joined.drop("_v", *(f"{c}_median" for c in taxi.PROFILED))))


@check(
    "q1_monthly_payment",
    query(
        CLEAN,
        """
        SELECT year, month, payment_type_id, trip_distance_unit, currency, count(*) AS trip_count,
               avg(trip_distance) AS avg_trip_distance, avg(fare_amount) AS avg_fare_amount,
               avg(tip_amount) AS avg_tip_amount, sum(total_amount) AS sum_total_amount
        FROM clean WHERE NOT suspicious
        GROUP BY year, month, payment_type_id, trip_distance_unit, currency""",
        "payment_type_id",
    ),
)
def q1_monthly_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(taxi.monthly_payments(_clean(spark, sf_dir)))


@check(
    "q2_top_routes",
    query(
        CLEAN,
        """
        SELECT pickup_location_id, dropoff_location_id, trip_distance_unit, currency, count(*) AS trip_count,
               avg(trip_distance) AS avg_trip_distance, avg(total_amount) AS avg_total_amount,
               sum(total_amount) AS sum_total_amount
        FROM clean GROUP BY pickup_location_id, dropoff_location_id, trip_distance_unit, currency
        HAVING count(*) > 100
        ORDER BY sum_total_amount DESC, trip_count DESC, pickup_location_id, dropoff_location_id LIMIT 100""",
        "pickup_location_id dropoff_location_id",
    ),
)
def q2_top_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(taxi.top_routes(_clean(spark, sf_dir)))


@check(
    "q3_hourly_speed",
    query(
        CLEAN,
        """
        SELECT CAST(hour(pickup_datetime) AS BIGINT) AS pickup_hour, trip_distance_unit, currency,
               count(*) AS trip_count, avg(trip_distance) AS avg_trip_distance,
               avg(fare_amount) AS avg_fare_amount, avg(total_amount) AS avg_total_amount,
               round(avg(trip_distance / nullif(secs / CAST(3600 AS DOUBLE), 0)), 6) AS avg_speed_mph
        FROM clean WHERE trip_distance > 0 GROUP BY 1, 2, 3""",
    ),
)
def q3_hourly_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(rounded(taxi.hourly_speed(_clean(spark, sf_dir)), only=("avg_speed_mph",)))


# --- ad hoc exploration -------------------------------------------------------------------

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@check(
    "describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS stddev, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, "
        f"round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max "
        "FROM lineitem"
        for c in _NUMBERS
    ),
)
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.describe(table(spark, sf_dir, "lineitem"), _NUMBERS, exact=True), 4)


_CODES = ["vendor_id", "passenger_count", "rate_code_id", "store_and_forward_flag", "payment_type_id", "month"]


@check(
    "distinct_values",
    query(
        TRIPS,
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n_rows FROM trips GROUP BY {c}"
            for c in _CODES
        ),
    ),
)
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_values(trips(spark, sf_dir), _CODES)


@check(
    "conditional_counts",
    query(
        TRIPS,
        """
        SELECT 'negative_distance' AS condition, count(*) FILTER (trip_distance < 0) AS n_rows FROM trips UNION ALL
        SELECT 'long_distance', count(*) FILTER (trip_distance > 45) FROM trips UNION ALL
        SELECT 'small_fare', count(*) FILTER (fare_amount < 10) FROM trips UNION ALL
        SELECT 'no_tip', count(*) FILTER (tip_amount IS NULL) FROM trips""",
    ),
)
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.conditional_counts(
        trips(spark, sf_dir),
        {
            "negative_distance": F.col("trip_distance") < 0,
            "long_distance": F.col("trip_distance") > 45,
            "small_fare": F.col("fare_amount") < 10,
            "no_tip": F.col("tip_amount").isNull(),
        },
    )


# --- runs ---------------------------------------------------------------------------------

_RUN_STATS = """
       round(avg({x}), 4) AS {x}_average, round(coalesce(stddev_samp({x}), 0), 4) AS {x}_standard_deviation,
       min({x}) AS {x}_min, max({x}) AS {x}_max, count(*) AS rows_in_group"""


@check(
    "run_summary",
    f"""
    WITH runs AS (
      SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1) AS place
      FROM orders WHERE o_totalprice < 400000)
    SELECT o_orderpriority, place // 3 + 1 AS bucket, arg_min(o_orderstatus, place) AS o_orderstatus,
           arg_min(o_custkey, place) AS o_custkey, {_RUN_STATS.format(x="o_totalprice")}
    FROM runs GROUP BY o_orderpriority, place // 3""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = runstats.run_summary(
        table(spark, sf_dir, "orders"),
        ["o_orderdate", "o_orderkey"],
        numeric=["o_totalprice"],
        keep=["o_orderstatus", "o_custkey"],
        within=["o_orderpriority"],
        where=F.col("o_totalprice") < 400000,
    )
    return rounded(summary, 4)


@check(
    "run_summary_whole_table",
    f"""
    WITH runs AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events)
    SELECT place // 3 + 1 AS bucket, arg_min(event_type, place) AS event_type,
           {_RUN_STATS.format(x="value")}
    FROM runs GROUP BY place // 3""",
)
def run_summary_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return rounded(
        runstats.run_summary(events, ["ts", "event_id"], numeric=["value"], keep=["event_type"]), 4
    )


@check(
    "array_stats",
    """
    SELECT CAST(label AS BIGINT) AS label, place, round(avg(x), 6) AS average, round(coalesce(stddev_samp(x), 0), 6) AS standard_deviation,
           round(min(x), 6) AS min, round(max(x), 6) AS max
    FROM (SELECT label, unnest(range(len(embedding))) AS place, CAST(unnest(embedding) AS DOUBLE) AS x
          FROM embeddings)
    GROUP BY label, place""",
)
def array_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = runstats.array_stats(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    names = ["average", "standard_deviation", "min", "max"]
    rows = stats.select("label", F.posexplode(F.arrays_zip(*(F.col(f"embedding_{n}").alias(n) for n in names))))
    return rounded(
        flat(rows.select("label", F.col("pos").alias("place"), *(F.col(f"col.{n}").alias(n) for n in names)))
    )


_PIVOT = """
    WITH pivoted AS (
      SELECT o_orderpriority,
             avg(o_totalprice) FILTER (o_orderstatus = 'F') AS F,
             avg(o_totalprice) FILTER (o_orderstatus = 'O') AS O,
             avg(o_totalprice) FILTER (o_orderstatus = 'P') AS P
      FROM orders GROUP BY o_orderpriority)"""


def _pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return runstats.pivot_mean(orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "o_totalprice")


@check(
    "pivot_config",
    f"{_PIVOT} SELECT o_orderpriority, round(F, 4) AS F, round(O, 4) AS O, round(P, 4) AS P FROM pivoted",
)
def pivot_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pivoted(spark, sf_dir), 4)


@check(
    "relative_speedup",
    f"""{_PIVOT}
    SELECT o_orderpriority, 'O' AS configuration, round(coalesce(F, O) / O, 6) AS relative_speedup FROM pivoted
    UNION ALL
    SELECT o_orderpriority, 'P', round(coalesce(F, O) / P, 6) FROM pivoted""",
)
def relative_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        runstats.relative_speedup(_pivoted(spark, sf_dir), ["o_orderpriority"], ["F", "O"], ["O", "P"])
    )


@check(
    "scaleout_efficiency",
    f"""{_PIVOT}
    SELECT o_orderpriority, round(F / P, 6) AS scaleout_speedup, round(F / P / 2, 6) AS scaleout_efficiency
    FROM pivoted""",
)
def scaleout_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runstats.scaleout(_pivoted(spark, sf_dir), ["o_orderpriority"], "F", "P", nodes=2))


@check(
    "throughput",
    """
    SELECT event_type, count(*) AS n_rows,
           round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) ELSE 0 END, 6) AS rows_per_second
    FROM events GROUP BY event_type""",
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_type = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.sum("value").alias("seconds")
    )
    rate = runstats.throughput(F.col("n_rows"), F.col("seconds"))
    return rounded(per_type.select("event_type", "n_rows", rate.alias("rows_per_second")))


@check(
    "report_labels",
    """
    WITH parts AS (
      SELECT page_id, length(html) AS size, split_part(split_part(url, '?', 1), '#', 1) AS path,
             nullif(regexp_extract(url, '/(en|fr|de|es)/', 1), '') AS lang
      FROM pages)
    SELECT page_id, split_part(rtrim(path, '/'), '/', -1) AS segment,
           split_part(rtrim(path, '/'), '/', -1) || ' (' || CAST(size AS VARCHAR) || ' MiB)' AS sized,
           printf('%.1fM', size / CAST(10 AS DOUBLE)) AS millions,
           CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS lang_label,
           CAST(CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS BIGINT)
             AS lang_place
    FROM parts""",
)
def report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    segment = X.last_segment(F.regexp_replace("url", "[?#].*$", ""))
    size = F.length("html").cast("double")
    found = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    lang = F.when(found != "", found)
    return pages.select(
        "page_id",
        segment.alias("segment"),
        X.sized_label(segment, size).alias("sized"),
        X.compact_millions(size * 1e5).alias("millions"),
        X.code_label(lang, {"en": "English", "fr": "French"}).alias("lang_label"),
        X.ordinal_in(lang, ["fr", "en", "de"]).alias("lang_place"),
    )


# --- regression ---------------------------------------------------------------------------


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tip model with a draw in 0..999 that both engines can compute."""
    rows = taxi.clean_kept(trips(spark, sf_dir, KEYS))
    draw = (
        F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_suppkey") * 3 + F.col("l_linenumber")
    ) % 1000
    return taxi.model_rows(rows.withColumn("draw", draw), [*KEYS, "draw"])


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir).drop(*KEYS)
    return regression.split_by_key(rows, F.col("draw")).drop("draw")


_MODEL_SPLIT = MODEL_ROWS + """,
split AS (SELECT *, (o * 7 + p * 13 + s * 3 + n) % 1000 < 200 AS is_test FROM model_rows)"""


@check(
    "ml_features",
    query(
        MODEL_ROWS,
        f"""
        SELECT o AS l_orderkey, p AS l_partkey, s AS l_suppkey, CAST(n AS BIGINT) AS l_linenumber, tip_amount,
               {", ".join("round(trip_speed, 6) AS trip_speed" if f == "trip_speed" else f for f in FEATURES)}
        FROM model_rows""",
        "pickup_location_id dropoff_location_id payment_type_id pickup_hour pickup_day pickup_weekday "
        "dropoff_hour dropoff_day dropoff_weekday",
    ),
)
def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(rounded(_model_rows(spark, sf_dir).drop("draw"), only=("trip_speed",)))


@check(
    "ml_prepare",
    query(
        _MODEL_SPLIT
        + ", scale AS (SELECT "
        + ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS d_{f}" for f in FEATURES)
        + " FROM split WHERE NOT is_test)",
        "SELECT is_test, count(*) AS n_rows, avg(tip_amount) AS avg_tip, "
        + ", ".join(f"round(avg(({f} - m_{f}) / d_{f}), 6) + 0.0 AS {f}" for f in FEATURES)
        + " FROM split, scale GROUP BY is_test",
    ),
)
def ml_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir)
    assemble, scale, _ = regression.ols_estimator(FEATURES, taxi.ML_TARGET).getStages()
    assembled = assemble.transform(rows)
    scaled = scale.fit(assembled.where(~F.col("is_test"))).transform(assembled)
    values = scaled.select("is_test", taxi.ML_TARGET, vector_to_array("features").alias("x"))
    return values.groupBy("is_test").agg(
        F.count("*").alias("n_rows"),
        F.avg(taxi.ML_TARGET).alias("avg_tip"),
        *((F.round(F.avg(F.col("x")[i]), 6) + 0.0).alias(f) for i, f in enumerate(FEATURES)),
    )


_TERMS = {"1": "1.0", **{f: f"CAST({f} AS DOUBLE)" for f in FEATURES}}


@check(
    "ml_linear_regression",
    query(
        _MODEL_SPLIT,
        " UNION ALL ".join(
            f"SELECT '{name}' AS term, count(*) AS n_rows, round(avg(tip_amount * {x}), 3) AS mean_product "
            "FROM split WHERE NOT is_test"
            for name, x in _TERMS.items()
        ),
    ),
)
def ml_linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares is the fit whose products with every feature are those of the target.

    So the predictions of the training rows, multiplied by each feature, must have the
    means that SQL finds for the target itself (the normal equations).
    """
    split = _split(spark, sf_dir)
    model, _ = regression.fit_predict(split, FEATURES, taxi.ML_TARGET)
    fitted = model.transform(split.where(~F.col("is_test")))
    means = [F.expr(f"avg(prediction * {x})").alias(f"m{i}") for i, x in enumerate(_TERMS.values())]
    row = fitted.agg(F.count("*").alias("n"), *means)
    terms = X.long_form(
        term=[X.literal(t) for t in _TERMS],
        n_rows=["n"] * len(_TERMS),
        mean_product=[f"round(m{i}, 3)" for i in range(len(_TERMS))],
    )
    return row.select(terms)


@check(
    "ml_test_scores",
    query(
        _MODEL_SPLIT
        + """,
        spread AS (
          SELECT avg(trip_distance) AS m1, avg(fare_amount) AS m2, avg(tip_amount) AS my,
                 var_pop(trip_distance) AS v1, var_pop(fare_amount) AS v2, covar_pop(trip_distance, fare_amount) AS c12,
                 covar_pop(trip_distance, tip_amount) AS c1, covar_pop(fare_amount, tip_amount) AS c2
          FROM split WHERE NOT is_test),
        slopes AS (
          SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2
          FROM spread),
        scored AS (
          SELECT tip_amount AS y, my + b1 * (trip_distance - m1) + b2 * (fare_amount - m2) AS f
          FROM split, slopes WHERE is_test)""",
        """
        SELECT count(*) AS n_rows, round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse,
               round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2
        FROM scored""",
    ),
)
def ml_test_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on the held-out rows with two features, where the normal equations have a closed form."""
    _, predicted = regression.fit_predict(_split(spark, sf_dir), ["trip_distance", "fare_amount"], taxi.ML_TARGET)
    return rounded(regression.regression_metrics(predicted, taxi.ML_TARGET, "prediction"))


@check(
    "ml_one_feature",
    query(
        _MODEL_SPLIT
        + """,
        line AS (
          SELECT regr_slope(total, fare_amount) AS slope, regr_intercept(total, fare_amount) AS base
          FROM (SELECT *, fare_amount + 2 * tip_amount AS total FROM split) WHERE NOT is_test),
        scored AS (
          SELECT fare_amount + 2 * tip_amount AS y, base + slope * fare_amount AS f
          FROM split, line WHERE is_test)""",
        """
        SELECT count(*) AS n_rows, round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse,
               round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2
        FROM scored""",
    ),
)
def ml_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same estimator on one feature, where SQL has the closed form."""
    rows = _split(spark, sf_dir).withColumn("y", F.col("fare_amount") + 2 * F.col("tip_amount"))
    _, predicted = regression.fit_predict(rows.select("fare_amount", "y", "is_test"), ["fare_amount"], "y")
    return rounded(regression.regression_metrics(predicted, "y", "prediction"))


@check(
    "regression_metrics",
    """
    WITH scored AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS f FROM lineitem)
    SELECT count(*) AS n_rows, round(avg(abs(y - f)), 4) AS mae, round(sqrt(avg((y - f) * (y - f))), 4) AS rmse,
           round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 4) AS r2
    FROM scored""",
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("f")
    )
    return rounded(regression.regression_metrics(scored, "y", "f"), 4)


_NAMES = ["1", *FEATURES, "tip_amount"]
_SHIFT = [25.0, 10.0, 5.0, 2.0, 50.0, 1998.0, 6.0, 12.0, 15.0, 4.0, 12.0, 15.0, 4.0, 2400.0, 50.0, 4.0]
_TERM = {n: f"(CAST({n} AS DOUBLE) - {s})" for n, s in zip([*FEATURES, "tip_amount"], _SHIFT)} | {"1": "1.0"}


@check(
    "ml_incremental",
    query(
        MODEL_ROWS,
        " UNION ALL ".join(
            f"SELECT '{a}' AS left_name, '{b}' AS right_name, "
            f"round(sum(CAST({_TERM[a]} * {_TERM[b]} AS DOUBLE)), 2) + 0.0 AS value FROM model_rows"
            for i, a in enumerate(_NAMES)
            for b in _NAMES[i:]
        ),
    ),
)
def ml_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of yearly pieces, merged."""
    rows = _model_rows(spark, sf_dir).withColumn("piece", F.col("year"))
    pieces = regression.moments(rows, FEATURES, taxi.ML_TARGET, _SHIFT, by=["piece"])
    merged = regression.merge_moments(pieces)
    return merged.withColumn("value", F.round("value", 2) + 0.0)


@check(
    "ml_qr_spread",
    query(
        MODEL_ROWS,
        " UNION ALL ".join(
            f"SELECT '{a}' AS left_name, '{b}' AS right_name, count(*) AS n, round(avg({a}), 6) AS left_mean, round(avg({b}), 6) AS right_mean, "
            f"round(covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 4) + 0.0 AS covariance FROM model_rows"
            for i, a in enumerate(_NAMES[1:])
            for b in _NAMES[1:][i:]
        ),
    ),
)
def ml_qr_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangular factors of yearly pieces, stored, merged and multiplied out: the covariances of all rows."""
    rows = _model_rows(spark, sf_dir).withColumn("piece", F.col("year"))
    stored = durable(regression.factors(rows, FEATURES, taxi.ML_TARGET, by=["piece"]), "factors")
    names = _NAMES[1:]
    k = len(names)
    whole = regression.merge_factors(stored)
    triangle = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice("factor", i * k + 1, F.lit(k)))
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b")) for i in range(k) for j in range(i, k)))
    cells = whole.select("n", F.zip_with("origin", "offset", lambda a, b: a + b).alias("means"), triangle.alias("r"), F.explode(pairs).alias("p"))
    product = F.aggregate("r", F.lit(0.0), lambda total, row: total + F.get(row, F.col("p.i")) * F.get(row, F.col("p.j")))
    return cells.select(
        F.col("p.a").alias("left_name"), F.col("p.b").alias("right_name"), "n", F.round(F.get("means", F.col("p.i")), 6).alias("left_mean"),
        F.round(F.get("means", F.col("p.j")), 6).alias("right_mean"), (F.round(product / F.col("n"), 4) + 0.0).alias("covariance"),
    )


@check("ml_qr_scores", ORACLES["ml_test_scores"])
def ml_qr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of ``ml_test_scores`` for a model solved from the factors of monthly pieces."""
    split = durable(_split(spark, sf_dir), "split")
    names = ["trip_distance", "fare_amount"]
    train = split.where(~F.col("is_test")).withColumn("piece", F.col("month"))
    model = regression.solve_factor(regression.merge_factors(regression.factors(train, names, taxi.ML_TARGET, ["piece"])), names, taxi.ML_TARGET)
    predicted = model.predict(split.where(F.col("is_test")))
    return rounded(regression.regression_metrics(predicted, taxi.ML_TARGET, "prediction"))
