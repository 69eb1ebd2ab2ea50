"""Session defaults and the shared folder that intermediate tables live in."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    # Report hours and epoch arithmetic must not depend on where the driver runs.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Lets AQE merge small shuffle partitions up to the advisory size instead of
    # keeping one per core, while large ones are still split.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: For clusters: sorts start with this many pieces, which AQE merges where they are small. It cannot split
#: a range of a sort, so the 200 of Spark's default would give each task 500 GB of a 100 TB table.
CLUSTER = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000"}


def spark_session(app: str = "millrace", **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` wins (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    settings = {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        for key, value in CLUSTER.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Fix the session time zone on a session somebody else created."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local folder would lose data with the machine, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if configured.startswith("file:") and not sc.master.startswith("local"):
            # A mounted share may be one; only the user can know.
            warnings.warn(f"spark.checkpoint.dir is {configured}: it must be a mount that all executors share", stacklevel=2)
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "durable") -> DataFrame:
    """The same rows, written to the shared folder and read back.

    A lost executor can then no longer change them. Unlike a checkpoint of rows, the
    Parquet table is compressed, lets later steps read only the columns they need, and
    tells the optimizer its size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def file_system(spark: SparkSession, path: str):
    """A path as Hadoop knows it, and the file system that it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly under ``path``; none if there is no such folder."""
    place, fs = file_system(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(place)) if fs.exists(place) else []


@contextmanager
def replacing(spark: SparkSession, path: str) -> Iterator[str]:
    """A fresh path to write to, next to ``path``, which it replaces once the block has succeeded.

    What was at ``path`` stays readable until the new data are complete; if anything fails it stays for
    good and what was written is removed. The switch is two renames: between them the old data are in
    a sibling folder whose name begins with an underscore, which readers of the parent folder skip.
    """
    target, fs = file_system(spark, path.rstrip("/"))
    name = f"{target.getName()}-{uuid.uuid4().hex}"
    parent = target.getParent().toString()
    fresh, old = (file_system(spark, f"{parent}/_{kind}-{name}")[0] for kind in ("new", "old"))
    try:
        yield fresh.toString()
        if not fs.exists(fresh):
            raise FileNotFoundError(f"nothing was written to replace {path}")
    except BaseException:
        fs.delete(fresh, True)
        raise
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} could not be moved aside; the new data are in {fresh.toString()}")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"the new data could not be moved to {path}; they are in {fresh.toString()}")
    if had:
        fs.delete(old, True)


def forget(df: DataFrame) -> None:
    """Delete the files that a ``durable`` table is read from, when nothing reads it any more."""
    spark = df.sparkSession
    base = shared_dir(spark)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        plain, root = (p.replace("file://", "").replace("//", "/") for p in (folder, base))
        if not plain.startswith(root.rstrip("/") + "/"):
            raise ValueError(f"{folder} is not in the shared folder")
        place, fs = file_system(spark, folder)
        fs.delete(place, True)


@contextmanager
def session_conf(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Set runtime settings for the length of one action (dots written as ``__``)."""
    names = {k: k.replace("__", ".") for k in conf}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, v in conf.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
