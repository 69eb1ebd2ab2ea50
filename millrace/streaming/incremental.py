"""Incremental file ingestion: new files are cleaned and stored batch by batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from millrace.operators import profile, regression, rules
from millrace.plans import taxi
from millrace.plans.lakebuild import OUTCOME
from millrace.session import folder_names, replacing
from millrace.sources import lake

BATCH = "batch"
#: Directories of the staging area: a kept row's month. Rejects, whose month may be what is wrong, have none.
PLACED = {"at_year": "year", "at_month": "month"}


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int, format: str = "csv"
) -> DataFrame:
    """New files in a folder as a stream, with each row's file name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if format == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(format).load(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def path_stream(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    """The paths of new files in a folder as a stream, for files that a batch reads by itself."""
    return spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("maxFilesPerTrigger", max_files).load(path).select("path")


def ingest_available(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    conform: Callable[[DataFrame], DataFrame] = taxi.conform,
    clean: Callable[[DataFrame], DataFrame] = taxi.clean,
    scan: Callable[[SparkSession, list[str]], DataFrame] | None = None,
    states: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> range:
    """Process every file not seen before, then stop. Returns the numbers of the batches it stored.

    With ``scan``, ``stream`` holds paths (see ``path_stream``) and a batch's files, as many as the
    stream's limit at most, are read by it: so ``csv_scan`` takes files of different headers.

    This is a staging area, laid out by batch, outcome and month, gathered so that a batch adds few files to
    a month; ``publish`` then reads the months it needs and no others. Each batch owns the
    directory ``batch=<id>`` and overwrites it, so a batch that is replayed after a
    failure leaves its rows once. Kept and rejected rows go out in one job. A batch's
    NULL counts are computed from what it stored and kept beside it, to be merged into
    a profile of everything without reading the rows again. ``states`` names further tables of that kind, each made
    of the batch's kept rows: sketches of quantiles or of distinct values, a sample (see ``batch_states``).
    Its tasks write without sorting, as those of a build do; they are split at the session's advisory size.
    """

    stored_ids: list[int] = []

    def store(rows: DataFrame, batch_id: int) -> None:
        if scan is not None:
            files = [r.path for r in rows.select("path").collect()]
            if not files:
                return
            rows = scan(rows.sparkSession, files)
        tagged = clean(conform(rows))
        month = {at: F.when(F.col(rules.REASON).isNull(), F.col(c)) for at, c in PLACED.items()}
        outcome = F.coalesce(rules.REASON, F.lit(rules.KEPT))
        named = tagged.withColumns({**month, OUTCOME: outcome}).drop(rules.REASON)
        place = f"{root}/rows/{BATCH}={batch_id}"
        keys = [OUTCOME, *PLACED]
        with lake.file_size(rows.sparkSession, None), replacing(rows.sparkSession, place) as fresh:
            lake.spread_by(named, keys).write.partitionBy(*keys).parquet(fresh)
        # An explicit schema: a batch without kept rows has no such directory.
        stored = rows.sparkSession.read.schema(named.schema).parquet(place).where(F.col(OUTCOME) == rules.KEPT)
        partial = profile.partial_missing(stored, [c for c in named.columns if c not in (OUTCOME, *PLACED)])
        partial.write.mode("overwrite").parquet(f"{root}/profile/{BATCH}={batch_id}")
        for name, made_of in (states or {}).items():
            made_of(stored.drop(OUTCOME, *PLACED)).write.mode("overwrite").parquet(f"{root}/states/{name}/{BATCH}={batch_id}")
        stored_ids.append(batch_id)

    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    return range(min(stored_ids), max(stored_ids) + 1) if stored_ids else range(0)


def stored_rows(spark: SparkSession, root: str) -> DataFrame:
    """All rows of all batches, with ``batch``, ``outcome`` and, of kept rows, the month they lie under."""
    return spark.read.parquet(f"{root}/rows")


def stored_trips(spark: SparkSession, root: str) -> DataFrame:
    return _kept(spark, root).drop(OUTCOME, BATCH, *PLACED)


def _kept(spark: SparkSession, root: str) -> DataFrame:
    return stored_rows(spark, root).where(F.col(OUTCOME) == rules.KEPT)


def merged_profile(spark: SparkSession, root: str) -> DataFrame:
    """Missing-value profile of all batches from their stored counts."""
    partials = spark.read.parquet(f"{root}/profile")
    return profile.merge_missing(partials, [c for c in partials.columns if c not in (profile.ROWS, BATCH)])


def batch_states(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A state of all batches, with their numbers, to be merged by what made it: the rows are not read again."""
    return spark.read.parquet(f"{root}/states/{name}")


def publish(
    spark: SparkSession, root: str, target: str, since: int | range | None = None, target_mib: int = lake.TARGET_MIB
) -> None:
    """Bring the batches' kept rows into one compact lake, in one job.

    With ``since``, a batch number or what ``ingest_available`` returned, only the months met by
    batches from there on are rewritten, each from all its rows in all batches; other months stay as
    they are. Months are partitions of the staging area: the ones that were met, a few values, become
    partition filters of the scan. ``publish_new`` remembers by itself what it has published.
    """
    if since is None:
        lake.write_partitioned(stored_trips(spark, root), target, target_mib=target_mib, replace="static")
        return
    if isinstance(since, range):
        if not since:
            return
        since = since.start
    rows = _kept(spark, root)
    months = [tuple(r) for r in rows.where(F.col(BATCH) >= since).select(*PLACED).distinct().collect()]
    if months:
        touched = reduce(or_, ((F.col("at_year") == y) & (F.col("at_month") == m) for y, m in months))
        lake.write_partitioned(rows.where(touched).drop(OUTCOME, BATCH, *PLACED), target, target_mib=target_mib)


def publish_new(spark: SparkSession, root: str, target: str, target_mib: int = lake.TARGET_MIB) -> int:
    """Publish the batches that earlier calls for ``target`` have not, and return the last batch published.

    The mark is written after the lake: a call that failed is made good by the next one.
    """
    mark = f"{root}/published/{hashlib.sha256(target.rstrip('/').encode()).hexdigest()[:16]}"
    done = spark.read.schema("last long").parquet(mark).agg(F.max("last")).first()[0] if folder_names(spark, mark) else None
    # A batch is its directory: listing them answers this without a job over the rows.
    last = max((int(name.partition("=")[2]) for name in folder_names(spark, f"{root}/rows") if name.startswith(f"{BATCH}=")), default=None)
    if last is None or last == done:
        return -1 if done is None else done
    publish(spark, root, target, None if done is None else done + 1, target_mib)
    with replacing(spark, mark) as fresh:
        spark.range(1).select(F.lit(last).cast("long").alias("last")).write.parquet(fresh)
    return last


def learn_available(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame],
    features: list[str],
    label: str,
    shift: list[float] | None = None,
    keep: str = "moments",
) -> DataFrame:
    """What every new batch's training rows amount to; returns that of all batches so far.

    ``keep="factors"`` keeps one triangular factor a batch, for ``solve_factor``. Otherwise they are moments: centred ones
    for ``solve_centred`` or, with a ``shift``, plain ones for ``solve_moments``.

    Unlike stochastic gradient descent on pieces, the model solved from them is the
    same as if all rows had been seen at once.
    """

    if keep not in ("moments", "factors"):
        raise ValueError("keep is 'moments' or 'factors'")

    def store(rows: DataFrame, batch_id: int) -> None:
        ready = prepare(rows)
        if keep == "factors":
            part = regression.factors(ready, features, label)
        elif shift is None:
            part = regression.centred_moments(ready, features, label)
        else:
            part = regression.moments(ready, features, label, shift)
        part.write.mode("overwrite").parquet(f"{root}/{BATCH}={batch_id}")

    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    parts = stream.sparkSession.read.parquet(root)
    if keep == "factors":
        return regression.merge_factors(parts)
    return regression.merge_centred(parts) if shift is None else regression.merge_moments(parts)
