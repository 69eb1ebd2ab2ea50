"""Tables as immutable files and a list of them per version, so that readers always see one whole version.

Data files are never changed or moved once written. A version is a Parquet table of file names, and one small pointer
file names that table; writing the pointer is what makes a version exist. A reader takes the newest pointer and reads
the files it leads to, whatever is written meanwhile. Pointers are numbered and never replaced: of two writers that
started from one version, the second finds its number taken and fails. Unlike a directory that is replaced by renames,
there is no moment without a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.operators.ordering import positions
from millrace.session import durable, file_system, folder_names, session_conf
from millrace.sources import lake

#: The partition column that tells the files of one write from those of others; readers do not see it.
WRITE = "write_id"
#: Scans that one compaction job unites; each holds the bins of one partition.
BINS_PER_JOB = 128


class ConflictError(RuntimeError):
    """Another writer has committed a version since this one began."""


@dataclass(frozen=True)
class Version:
    number: int
    manifest: str
    schema: T.StructType


@dataclass(frozen=True)
class SnapshotTable:
    """A table at ``root``, partitioned by ``by``."""

    spark: SparkSession
    root: str
    by: tuple[str, ...] = lake.MONTHLY

    # --- reading ---------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(name) for name in folder_names(self.spark, f"{self.root}/versions") if name.isdigit()]

    def version(self, number: int | None = None) -> Version | None:
        """The version of that number, or the newest; None of an empty table."""
        if number is None:
            number = max(self.versions(), default=None)
            if number is None:
                return None
        line = self.spark.read.text(f"{self.root}/versions/{number:012d}").first()[0]
        told = json.loads(line)
        return Version(number, told["manifest"], T.StructType.fromJson(told["schema"]))

    def files(self, number: int | None = None) -> DataFrame:
        """(by…, file, bytes, n_rows) of a version's files."""
        at = self.version(number)
        if at is None:
            raise FileNotFoundError(f"there is no table at {self.root}")
        return self.spark.read.schema(self._manifest_schema(at.schema)).parquet(f"{self.root}/manifests/{at.manifest}")

    def read(self, number: int | None = None, where: Column | None = None) -> DataFrame:
        """The rows of a version, by default the newest now. ``where``, a condition on ``by``, leaves out other files.

        What comes back stays the same whatever is committed later, as long as ``expire`` keeps the version.
        """
        at = self.version(number)
        if at is None:
            raise FileNotFoundError(f"there is no table at {self.root}")
        listed = self.files(at.number)
        names = [r.file for r in (listed if where is None else listed.where(where)).select("file").collect()]
        return self._scan(names, at.schema).select(*at.schema.names) if names else self.spark.createDataFrame([], at.schema)

    def _scan(self, names: Sequence[str], schema: T.StructType) -> DataFrame:
        """The files' rows, partition columns last."""
        full = T.StructType([*schema, T.StructField(WRITE, T.StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*(f"{self.root}/data/{n}" for n in names))

    def _manifest_schema(self, schema: T.StructType) -> T.StructType:
        return T.StructType([*(schema[b] for b in self.by), *T.StructType.fromDDL("file string, bytes bigint, n_rows bigint")])

    # --- writing ---------------------------------------------------------------------------

    def _put(self, rows: DataFrame, gather: bool, target_mib: int, spread: bool = True) -> DataFrame:
        """Write rows as files of their own; returns their part of a manifest."""
        write_id = uuid.uuid4().hex
        place = f"{self.root}/data/{WRITE}={write_id}"
        if spread:
            lake.write_partitioned(rows, place, self.by, gather, target_mib, replace="fresh")
        else:
            rows.write.partitionBy(*self.by).parquet(place)
        return self._listed(place, write_id, rows.schema)

    def _listed(self, place: str, write_id: str, schema: T.StructType) -> DataFrame:
        """Rows per file, from footers."""
        stored = self.spark.read.schema(schema).parquet(place)
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        counts = stored.groupBy(*self.by, path.alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n_rows"))
        inside = F.concat(F.lit(f"{WRITE}={write_id}/"), F.substring_index("path", f"/{WRITE}={write_id}/", -1))
        return counts.select(*self.by, inside.alias("file"), "bytes", "n_rows")

    def _commit(self, base: Version | None, entries: DataFrame, schema: T.StructType) -> int:
        """Make ``entries`` the version after ``base``; fails if there is one already."""
        manifest = uuid.uuid4().hex
        fixed = entries.select(*(F.col(s.name).cast(s.dataType) for s in self._manifest_schema(schema)))
        fixed.write.parquet(f"{self.root}/manifests/{manifest}")
        number = 1 if base is None else base.number + 1
        jvm = self.spark._jvm
        target, fs = file_system(self.spark, f"{self.root}/versions/{number:012d}")
        fs.mkdirs(target.getParent())
        draft, _ = file_system(self.spark, f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"manifest": manifest, "schema": json.loads(schema.json())}).encode() + b"\n"))
        out.close()
        # A rename that does not replace: it fails where the number is taken.
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            files.rename(draft, target, options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise ConflictError(f"version {number} of {self.root} was committed by another writer") from e
            raise
        return number

    def replace(self, rows: DataFrame, gather: bool = True, target_mib: int = lake.TARGET_MIB, base: Version | None = None) -> int:
        """A version that holds these rows and no others; returns its number."""
        base = base or self.version()
        return self._commit(base, self._put(rows, gather, target_mib), rows.schema)

    def overwrite_partitions(self, rows: DataFrame, gather: bool = True, target_mib: int = lake.TARGET_MIB, base: Version | None = None) -> int:
        """A version in which the partitions present in ``rows`` hold these rows, others what they held.

        ``base`` is the version to start from (default: the newest now). If it is not the newest when all is written, the
        call fails and changes nothing.
        """
        base = base or self.version()
        new = durable(self._put(rows, gather, target_mib), "entries")
        if base is None:
            return self._commit(None, new, rows.schema)
        touched = new.select(*self.by).distinct().alias("t")
        old = self.files(base.number).alias("o")
        same = reduce(and_, (F.col(f"o.{b}").eqNullSafe(F.col(f"t.{b}")) for b in self.by), F.lit(True))
        return self._commit(base, old.join(touched, same, "left_anti").unionByName(new), rows.schema)

    # --- upkeep ----------------------------------------------------------------------------

    def plan_bins(self, target_mib: int = lake.TARGET_MIB, where: Column | None = None) -> DataFrame:
        """(by…, bin, room, file, bytes): files to be merged into one, from their sizes; files that stay alone are not listed.

        ``room`` is what a bin of the partition holds at most.
        """
        files = self.files()
        listed = (files if where is None else files.where(where)).select(*self.by, "file", "bytes")
        kinds = T.StructType([*(listed.schema[b] for b in self.by), *T.StructType.fromDDL("bin bigint, room bigint, file string, bytes bigint")])
        target, by = target_mib * lake.MIB, list(self.by)

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            bins, room = packed(group["bytes"].tolist(), group["file"].tolist(), target)
            placed = group.assign(bin=bins, room=room)
            several = placed["bin"].map(placed["bin"].value_counts()) > 1
            return placed[several & (placed["bin"] >= 0)][[*by, "bin", "room", "file", "bytes"]]

        return listed.groupBy(*by).applyInPandas(pack, kinds)

    def compact(self, target_mib: int = lake.TARGET_MIB, where: Column | None = None) -> int | None:
        """Merge small files of a partition into few, without a shuffle; returns the new version, None if nothing is to do.

        The files of a partition are packed by their sizes (see ``packed``). Every bin is one task that reads its files and
        writes one; files that fill a bin alone are not touched. Afterwards a partition has at most ceil(size / target) + 1
        files. A plan holds a scan per partition, however many bins that has. Rows are compared before the version is
        committed.
        """
        base = self.version()
        if base is None:
            return None
        plan = durable(self.plan_bins(target_mib, where), "bins")
        scans = positions(plan.select("room", *self.by).distinct(), ["room", *self.by], name="scan").alias("s")
        same = reduce(and_, (F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in self.by))
        numbered = durable(plan.alias("p").join(scans, same).select("p.file", "s.room", "s.scan"), "numbered-bins")
        rooms = numbered.groupBy("room").agg(F.min("scan").alias("first"), F.max("scan").alias("last")).orderBy("room").collect()
        if not rooms:
            return None
        parts = []
        for at in rooms:
            # The reader packs the files of a scan as ``packed`` did: by size, the next bin when one is full.
            with session_conf(
                self.spark, spark__sql__files__maxPartitionBytes=str(at.room), spark__sql__files__openCostInBytes="0",
                spark__sql__files__minPartitionNum="1", spark__sql__maxConcurrentOutputFileWriters="1",
            ):
                for start in range(at.first, at.last + 1, BINS_PER_JOB):
                    some = numbered.where(F.col("scan").between(start, min(start + BINS_PER_JOB - 1, at.last)))
                    parts.append(self._put(self._rewrite(some, base.schema), False, target_mib, spread=False))
        new = durable(reduce(DataFrame.unionByName, parts), "entries")
        listed = self.files(base.number)
        gone = listed.join(numbered.select("file"), "file", "left_semi")
        rows = [d.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0] for d in (gone, new)]
        if rows[0] != rows[1]:
            raise RuntimeError(f"compaction read {rows[0]} rows and wrote {rows[1]}")
        return self._commit(base, listed.join(numbered.select("file"), "file", "left_anti").unionByName(new), base.schema)

    def _rewrite(self, scans: DataFrame, schema: T.StructType) -> DataFrame:
        """The rows of each partition's small files, a scan per partition; its tasks are the bins."""
        files: dict[int, list[str]] = {}
        for r in scans.select("scan", "file").orderBy("scan", "file").collect():
            files.setdefault(r.scan, []).append(r.file)
        level = [self._scan(names, schema) for names in files.values()]
        while len(level) > 1:  # in pairs: every union is analysed anew, so a chain would cost its square
            level = [a.unionAll(*b) for a, *b in (level[i : i + 2] for i in range(0, len(level), 2)) if b] + level[len(level) & ~1 :]
        return level[0].select(*schema.names)

    def expire(self, keep: int = 1) -> list[int]:
        """Forget all but the newest ``keep`` versions, and delete the writes that no version left refers to.

        Not for a time when others write: files of a version not committed yet are referred to by none. Returns the
        numbers of the versions that went.
        """
        if keep < 1:
            raise ValueError("at least one version must stay")
        numbers = sorted(self.versions())
        gone, left = numbers[:-keep], numbers[-keep:]
        used: set[str] = set()
        manifests = {self.version(n).manifest for n in left}
        for n in left:
            names = self.files(n).select(F.substring_index("file", "/", 1).alias("w")).distinct()
            used |= {r.w for r in names.collect()}
        for folder, kept in (("versions", {f"{n:012d}" for n in left}), ("manifests", manifests), ("data", used)):
            for name in folder_names(self.spark, f"{self.root}/{folder}"):
                if name not in kept:
                    place, fs = file_system(self.spark, f"{self.root}/{folder}/{name}")
                    fs.delete(place, True)
        return gone


def packed(sizes: Sequence[int], names: Sequence[str], target: int) -> tuple[list[int], int]:
    """The bin of each file, and the room of the bins; -1 for files above the target, which stay as they are.

    By falling size, a file that does not fit opens the next bin: so Spark's reader packs files into tasks. Bins hold
    ``target`` bytes. Should that take more than ceil(size / target) + 1 files, they may be up to twice as full: then any two
    bins in a row hold more than two targets, so the bound is met.
    """
    total = sum(sizes)
    large = sum(s > target for s in sizes)
    bound = -(-total // target) + 1
    order = sorted((i for i, s in enumerate(sizes) if s <= target), key=lambda i: (-sizes[i], names[i]))
    placed: dict[int, int] = {}
    for percent in (100, 110, 125, 150, 200):
        room, n, filled = target * percent // 100, 0, 0
        for i in order:
            if not n or filled + sizes[i] > room:
                n, filled = n + 1, 0
            filled += sizes[i]
            placed[i] = n - 1
        if n + large <= bound:
            break
    return [placed.get(i, -1) for i in range(len(sizes))], room


def bins_of(sizes: Sequence[int], names: Sequence[str], target: int) -> list[int]:
    """The bins alone, see ``packed``."""
    return packed(sizes, names, target)[0]
