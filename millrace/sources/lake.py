"""Partitioned Parquet lakes: write, check, compact, retype, and set rejects aside."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import AbstractContextManager
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from millrace.functions import quoted
from millrace.operators.contract import Contract, coerce, type_report
from millrace.operators.rules import REASON
from millrace.session import durable, replacing, session_conf

MONTHLY = ("year", "month")
MIB = 1024 * 1024
TARGET_MIB = 512
#: Files that a task of a gathered write keeps open at once. Up to then it writes its rows as they come and sorts none.
OPEN_FILES = 128
#: A gathered write is dealt into this many pieces or more, so that a task has few directories, whatever the number of cores.
PIECES = 200


def partition_violations(df: DataFrame, by: Sequence[str] = MONTHLY) -> DataFrame:
    """One row: all rows, rows with complete partition keys, and rows without."""
    complete = reduce(and_, (F.col(b).isNotNull() for b in by), F.lit(True))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(complete).alias("n_valid"),
        F.count_if(~complete).alias("n_violations"),
    )


def guarded(df: DataFrame, by: Sequence[str] = MONTHLY, where: Column | None = None) -> DataFrame:
    """The same rows, but a NULL partition key (of the rows ``where``) fails the job.

    The check is part of the projection that feeds the writer: it needs no pass of its
    own, and a failed write job commits nothing.
    """
    checks = {}
    for b in by:
        failure = F.raise_error(F.lit(f"partition column {b} is NULL")).cast(df.schema[b].dataType)
        present = F.coalesce(F.col(b), failure)
        checks[b] = present if where is None else F.when(where, present).otherwise(F.col(b))
    return df.withColumns(checks)


def spread_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bring each partition value together, but split the large ones over several tasks.

    This is the rebalance hint: with adaptive execution Spark looks at the shuffled
    sizes and divides any partition above the advisory size, so a month that holds a
    third of the table is written by as many tasks as its size calls for. A session set to
    fewer than ``PIECES`` shuffle partitions would bring many directories into each of them.
    """
    settings = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    pieces = max(PIECES, *(int(df.sparkSession.conf.get(name, "1")) for name in settings))
    return df.hint("rebalance", pieces, *(F.col(b) for b in by))


def file_size(spark: SparkSession, target_mib: int | None, open_files: int = OPEN_FILES) -> AbstractContextManager[None]:
    """Settings under which ``spread_by`` splits partitions at a file size; None: at the session's advisory size.

    Merging small partitions saves no files here, as every directory gets its own, so they
    are merged only up to 1 MB or one of ``PIECES`` of the whole. The rows of a task come from
    few directories, so it keeps a file open for each: sorted rows take several times the room
    of the shuffled ones. Beyond ``open_files`` directories the rest is sorted; 0 sorts all.
    The memory of that sort is in no task's figures, only in those of its executor.
    """
    size = {} if target_mib is None else {"spark__sql__adaptive__advisoryPartitionSizeInBytes": f"{target_mib * MIB}b"}
    return session_conf(
        spark,
        **size,
        spark__sql__maxConcurrentOutputFileWriters=str(open_files),
        spark__sql__adaptive__coalescePartitions__parallelismFirst="true",
        spark__sql__adaptive__coalescePartitions__minPartitionNum=str(PIECES),
    )


def write_partitioned(
    df: DataFrame,
    path: str,
    by: Sequence[str] = MONTHLY,
    gather: bool = True,
    target_mib: int = TARGET_MIB,
    replace: str = "dynamic",
    options: Mapping[str, object] | None = None,
) -> None:
    """Write Parquet partitioned by ``by``. Running it again leaves the same lake.

    ``gather=True`` shuffles so that a partition gets few files of about ``target_mib``.
    Use ``gather=False`` where the input is laid out by partition already, as monthly
    files are: the write then needs no shuffle.

    ``replace="dynamic"`` replaces the partitions present in ``df`` and leaves others;
    ``"static"`` replaces the whole path, after the new lake has been written beside it:
    a job that fails leaves the old lake as it was.
    """
    if replace == "static":
        with replacing(df.sparkSession, path) as fresh:
            write_partitioned(df, fresh, by, gather, target_mib, "fresh", options)
        return
    rows = guarded(df, by)
    spread = spread_by(rows, by) if gather and by else rows
    # Tasks that were not gathered may be of any size and hold any partition: their rows are sorted, which can spill.
    with file_size(df.sparkSession, target_mib, OPEN_FILES if gather else 0):
        (
            spread.write.mode("overwrite" if replace == "dynamic" else "errorifexists")
            .option("partitionOverwriteMode", "dynamic")
            .options(**(options or {}))
            .partitionBy(*by)
            .parquet(path)
        )


@dataclass(frozen=True)
class Persisted:
    """What a checked write came to: whether the rows read back are those written, files, MiB and rows."""

    ok: bool
    n_files: int
    size_mib: float
    n_rows: int


def persist_checked(df: DataFrame, path: str, by: Sequence[str] = MONTHLY, gather: bool = True, target_mib: int = TARGET_MIB) -> Persisted:
    """``write_partitioned`` in place of what was at ``path``, and a comparison of the rows counted while writing with the files.

    The write counts its own rows, in the stage that writes; the files are asked by their footers.
    """
    seen = Observation()
    spread = spread_by(guarded(df, by), by) if gather and by else guarded(df, by)
    counted = spread.observe(seen, F.count("*").alias("n"))
    with file_size(df.sparkSession, target_mib, OPEN_FILES if gather else 0), replacing(df.sparkSession, path) as fresh:
        counted.write.partitionBy(*by).parquet(fresh)
    found = file_stats(df.sparkSession.read.schema(df.schema).parquet(path)).first()
    written = int(seen.get.get("n") or 0)
    return Persisted(found.n_rows == written, found.n_files, found.size_mib, written)


def z_order(df: DataFrame, columns: Sequence[str], bits: int = 8, name: str = "_z") -> DataFrame:
    """Add a Z-order key: the bits of each column's rank among 2^``bits`` quantiles, taken in turns.

    Rows near in all columns are mostly near in the key, so a range of keys is a small box. The quantiles come from one
    pass of sketches, 2^``bits`` numbers a column; equal values always share a rank, and NULL ranks above all.
    """
    if not columns or bits * len(columns) > 62:
        raise ValueError("a key of one to 62 bits is needed")
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*(F.percentile_approx(F.col(quoted(c)).cast("double"), steps, 10_000).alias(f"c{i}") for i, c in enumerate(columns))).first()
    key = F.lit(0).cast("bigint")
    ranked = df
    for i, c in enumerate(columns):
        bounds = sorted(set(cuts[i] or []))
        ranked = ranked.withColumn(f"_r{i}", F.coalesce(F.col(quoted(c)).cast("double"), F.lit(float("nan"))))
        ranked = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol=f"_r{i}", outputCol=f"_q{i}", handleInvalid="keep").transform(ranked)
        rank = F.least(F.col(f"_q{i}").cast("bigint"), F.lit((1 << bits) - 1))
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1)), b * len(columns) + i))
    return ranked.withColumn(name, key).drop(*(f"_{p}{i}" for p in "rq" for i in range(len(columns))))


def write_clustered(
    df: DataFrame, path: str, columns: Sequence[str], by: Sequence[str] = MONTHLY, bloom: Sequence[str] = (), target_mib: int = TARGET_MIB, row_group_mib: float | None = None
) -> None:
    """Write Parquet by ``by``, within it ordered along a Z-order curve of ``columns``, in place of what was at ``path``.

    Files hold ranges of the curve, and so do their row groups, whose bounds let a filter on any of the columns skip most
    of them. ``bloom`` names columns to get Bloom filters, for tests of equality. The sort goes by ranges, so a partition
    that holds a third of the rows is spread over many tasks.
    """
    keyed = z_order(guarded(df, by), columns)
    options: dict[str, object] = {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom}
    if row_group_mib is not None:
        options["parquet.block.size"] = int(row_group_mib * MIB)
    with file_size(df.sparkSession, target_mib, 0), replacing(df.sparkSession, path) as fresh:
        ranges = keyed.repartitionByRange(*by, "_z").sortWithinPartitions(*by, "_z").drop("_z")
        ranges.write.options(**options).partitionBy(*by).parquet(fresh)


def rows_per_file(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, file_path, size_mib, n_rows) for every file of a file-based table that has rows.

    Uses the reader's own file metadata. On Parquet no column data is read.
    """
    file = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("_bytes")]
    counts = df.groupBy(*by, *file).agg(F.count("*").alias("n_rows"))
    return counts.select(*by, "file_path", (F.col("_bytes") / F.lit(float(MIB))).alias("size_mib"), "n_rows")


def file_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Files, rows and MiB of a file-based table, per partition or in total."""
    return (
        rows_per_file(df, by)
        .groupBy(*by)
        .agg(
            F.count("*").alias("n_files"),
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum("size_mib"), F.lit(0.0)).alias("size_mib"),
        )
    )


def verify_readback(expected: DataFrame, actual: DataFrame, by: Sequence[str] = MONTHLY) -> DataFrame:
    """Rows per partition on both sides, and whether they agree. All partitions are listed."""
    if not by:
        raise ValueError("name the partition columns to compare by")
    e = expected.groupBy(*by).agg(F.count("*").alias("n"))
    a = actual.groupBy(*by).agg(F.count("*").alias("n"))
    match = reduce(and_, (F.col(f"e.{b}").eqNullSafe(F.col(f"a.{b}")) for b in by))
    wanted, got = (F.coalesce(F.col(f"{side}.n"), F.lit(0)) for side in "ea")
    return (
        e.alias("e")
        .join(a.alias("a"), match, "full")
        .select(
            *(F.coalesce(f"e.{b}", f"a.{b}").alias(b) for b in by),
            wanted.alias("expected_rows"),
            got.alias("actual_rows"),
            (wanted == got).alias("ok"),
        )
    )


def compact_partitions(
    spark: SparkSession,
    source: str,
    target: str,
    by: Sequence[str] = MONTHLY,
    target_mib: int = TARGET_MIB,
    row_group_mib: int | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Rewrite a lake with as few files per partition as ``target_mib`` allows.

    All partitions go through one job. A partition below the target becomes one file.
    ``where``, a condition on partition columns such as that of ``scattered``, limits reading,
    shuffling and writing to the partitions that need it; other partitions of ``target`` stay.
    Returns files and MiB before and after, and whether the rows agree, per partition.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("compact into a new path, then switch readers to it")
    options = {} if row_group_mib is None else {"parquet.block.size": row_group_mib * MIB}
    rows = spark.read.parquet(source)
    if where is None:
        write_partitioned(rows, target, by, target_mib=target_mib, replace="static", options=options)
    else:
        write_partitioned(rows.where(where), target, by, target_mib=target_mib, options=options)
    return compaction_report(spark, source, target, by, where)


def scattered(table: DataFrame, by: Sequence[str] = MONTHLY, target_mib: int = TARGET_MIB) -> Column:
    """The condition for partitions with more files than their size calls for; false if there are none.

    File metadata only; the partitions found, not rows, reach the driver.
    """
    stats = file_stats(table, by).where(F.col("n_files") > F.ceil(F.col("size_mib") / target_mib))
    found = [reduce(and_, (F.col(b).eqNullSafe(F.lit(row[b])) for b in by)) for row in stats.select(*by).collect()]
    return reduce(or_, found, F.lit(False))


def compaction_report(
    spark: SparkSession, source: str, target: str, by: Sequence[str] = MONTHLY, where: Column | None = None
) -> DataFrame:
    """Compare two layouts of the same lake by their file metadata."""
    if not by:
        raise ValueError("name the partition columns to compare by")
    tables = (spark.read.parquet(path) for path in (source, target))
    before, after = (file_stats(t if where is None else t.where(where), by).alias(a) for t, a in zip(tables, "st"))
    match = reduce(and_, (F.col(f"s.{b}").eqNullSafe(F.col(f"t.{b}")) for b in by))
    pairs = {
        f"{measure}_{way}": F.coalesce(F.col(f"{side}.{measure}"), F.lit(0))
        for measure in ("n_files", "n_rows", "size_mib")
        for side, way in (("s", "in"), ("t", "out"))
    }
    return (
        before.join(after, match, "full")
        .select(
            *(F.coalesce(f"s.{b}", f"t.{b}").alias(b) for b in by),
            *(column.alias(name) for name, column in pairs.items()),
        )
        .withColumn("ok", F.col("n_rows_in") == F.col("n_rows_out"))
    )


def write_quarantine(
    tagged: DataFrame, path: str, reason: str = REASON, target_mib: int = TARGET_MIB
) -> DataFrame:
    """Write all rejected rows as CSV, one folder per rule, in one job.

    Only the rejects are shuffled, so that the few of each task do not become files of
    their own. A former run is replaced as a whole, whatever the session's
    overwrite mode. Returns (reason, n_rows), counted from what was written.
    """
    with file_size(tagged.sparkSession, target_mib), replacing(tagged.sparkSession, path) as fresh:
        (
            spread_by(tagged.where(F.col(reason).isNotNull()), [reason])
            .write.option("header", True)
            .partitionBy(reason)
            .csv(fresh)
        )
    return quarantine_counts(tagged, path, reason)


def quarantine_counts(tagged: DataFrame, path: str, reason: str = REASON) -> DataFrame:
    """Rows per rule in a quarantine folder."""
    spark = tagged.sparkSession
    schema = tagged.schema
    written = spark.read.schema(schema).option("header", True).csv(path)
    return written.groupBy(reason).agg(F.count("*").alias("n_rows"))


def directory_values(by: Sequence[str]) -> dict[str, Column]:
    """Whole-number partition values from each file's path: those of the folders nearest to the file."""
    return {b: F.regexp_extract("_metadata.file_path", rf"^.*/{b}=(\d+)/", 1).try_cast("int") for b in by}


def retype(
    spark: SparkSession, source: str, target: str, contract: Contract, by: Sequence[str] = MONTHLY
) -> DataFrame:
    """Rewrite a lake with the contract's types; partition values come from directories.

    Rows stay in the partitions they are in, so nothing is shuffled. Columns that the contract does
    not know keep their type. Returns, as ``type_report``, what each changed column lost by it.
    """
    raw = spark.read.option("recursiveFileLookup", True).parquet(source).withColumns(directory_values(by))
    have = {s.name: s.dataType for s in raw.schema}
    known = {f.name: f for f in contract.fields}
    first = [f.name for f in contract.fields if f.name in have]
    columns = [coerce(F.col(n), have[n], known[n]).alias(n) for n in first]
    rest = [F.col(quoted(n)) for n in raw.columns if n not in known]
    write_partitioned(raw.select(*columns, *rest), target, by, gather=False, replace="static")
    return type_report(raw, contract)


def write_report(report: DataFrame, path: str, decimals: int | None = None) -> None:
    """Save a small result table as CSV and as JSON lines, one file each.

    The report is worked out once, by all tasks, and stored before its rows are brought into one file.
    ``decimals`` rounds doubles in both. What was at ``path`` is replaced when both are complete.
    """
    if decimals is not None:
        report = report.withColumns({s.name: F.round(F.col(quoted(s.name)), decimals) for s in report.schema if s.dataType.typeName() == "double"})
    one = durable(report, "report").repartition(1)
    with replacing(report.sparkSession, path) as fresh:
        one.write.option("header", True).csv(f"{fresh}/csv")
        one.write.json(f"{fresh}/json")
