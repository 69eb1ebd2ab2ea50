"""From raw CSV to a clean lake, its rejects and its profile."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from millrace.operators import impute, ordering, profile, rules
from millrace.operators.contract import LOST, Contract
from millrace.plans import taxi
from millrace.sources import lake
from millrace.session import durable, replacing
from millrace.sources.csv import RESCUED, csv_scan

OUTCOME = "outcome"
#: Rows rejected for reasons that a build was not told of.
OTHER = "other"


@dataclass(frozen=True)
class BuildCounts:
    """What a build counted while it wrote: rows by outcome, values filled in by marker, cells lost by column."""

    outcomes: dict[str, int]
    imputed: dict[str, int]
    lost: dict[str, int]

    def rows(self) -> list[tuple[str, str, int]]:
        """(kind, name, count) of everything, for a report."""
        return [(kind, name, n) for kind, table in (("outcome", self.outcomes), ("imputed", self.imputed), ("lost", self.lost)) for name, n in table.items()]


@dataclass(frozen=True)
class LakeBuild:
    """Where a build put its rows. Everything is read back lazily from storage."""

    spark: SparkSession
    root: str
    schema: T.StructType | None = None
    counts: BuildCounts | None = None

    @property
    def path(self) -> str:
        """The clean lake: a Parquet table partitioned by year and month."""
        return f"{self.root}/{OUTCOME}={rules.KEPT}"

    def trips(self) -> DataFrame:
        """The kept rows; none, with the right columns, if the build kept none."""
        return self.all_rows().where(F.col(OUTCOME) == rules.KEPT).drop(OUTCOME)

    def all_rows(self) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(self.root)

    def sample_suspicious(self, path: str, n: int = 50) -> DataFrame:
        """Write ``n`` suspicious rows as CSV; returns one row: how many there are in all, and how many were written.

        The rows are read from storage, so the cleaning does not run again. A stored sample is replaced.
        """
        suspicious = self.trips().where("suspicious")
        chosen = durable(ordering.fixed_sample(suspicious, n), "sample")
        with replacing(self.spark, path) as fresh:
            chosen.repartition(1).write.option("header", True).csv(fresh)
        total = F.count("*")
        return suspicious.agg(total.alias("n_suspicious"), F.least(total, F.lit(n)).alias("n_written"))

    def rejects(self) -> DataFrame:
        """Rejected rows with their reason; the clean rows' directories are not read."""
        return self.all_rows().where(F.col(OUTCOME) != rules.KEPT).withColumnRenamed(OUTCOME, rules.REASON)

    def summary(self) -> DataFrame:
        """Rows per outcome, from file footers."""
        return self.all_rows().groupBy(OUTCOME).agg(F.count("*").alias("n_rows"))

    def profiled(self) -> DataFrame:
        """Both profiles in one pass, a row per vendor: see ``profile.profile_once``."""
        return profile.profile_once(self.trips(), ["vendor_id"], taxi.PROFILED, taxi.CONTRACT.names)

    def missing(self) -> DataFrame:
        return profile.profile_missing(self.trips(), taxi.CONTRACT.names)

    def by_vendor(self, median: str = "approx") -> DataFrame:
        return profile.profile_by_group(self.trips(), ["vendor_id"], taxi.PROFILED, median)

    def quarantine(self, path: str) -> DataFrame:
        """Export the rejects as CSV, one folder per rule, with speed figures for review."""
        return lake.write_quarantine(taxi.with_speed_metrics(self.rejects()), path)


def store_outcomes(
    tagged: DataFrame, root: str, gather: bool = True, target_mib: int = lake.TARGET_MIB, reasons: Sequence[str] | None = None, contract: Contract = taxi.CONTRACT
) -> LakeBuild:
    """Write kept and rejected rows in a single job, in directories by outcome.

    Raw input is parsed once, and nothing is cached: what follows reads columns back
    from Parquet. Rejects may lack a year or month; a kept row without them fails the
    job. A new build replaces an old one at the same root, once it is complete.

    By default one shuffle gives every directory files of about the target size, the
    few rejects of many tasks included, so no compaction has to follow. ``gather=False``
    saves the shuffle where input arrives by month, at the price of one file per task,
    outcome and month.

    The job also counts what it writes (``counts`` of the result): rows per outcome (those of reasons other than
    ``reasons`` together), and, where ``tagged`` has them, imputation markers and lost cells, which are not stored. The
    counting stands behind the shuffle, in the stage that writes: each of its tasks counts once, also when it or an
    earlier stage has to be repeated.
    """
    names = list(reasons) if reasons is not None else [r.name for r in taxi.trip_rules()]
    marks = impute.markers(tagged)
    rows = tagged.withColumn(OUTCOME, F.coalesce(rules.REASON, F.lit(rules.KEPT))).drop(rules.REASON)
    rows = lake.guarded(rows, where=F.col(OUTCOME) == rules.KEPT)
    keys = [OUTCOME, *lake.MONTHLY]
    if gather:
        rows = lake.spread_by(rows, keys)
    lost = contract.lost_counts() if LOST in rows.columns else {}
    measures = {
        **{f"outcome {n}": F.count_if(F.col(OUTCOME) == n) for n in (rules.KEPT, *names)}, f"outcome {OTHER}": F.count_if(~F.col(OUTCOME).isin(rules.KEPT, *names)),
        **{f"imputed {m}": F.sum(m) for m in marks}, **{f"lost {n}": count for n, count in lost.items()},
    }
    seen = Observation()
    rows = rows.observe(seen, *(column.alias(name) for name, column in measures.items())).drop(*marks, LOST)
    spark = tagged.sparkSession
    with lake.file_size(spark, target_mib, lake.OPEN_FILES if gather else 0), replacing(spark, root) as fresh:
        rows.write.partitionBy(*keys).parquet(fresh)
    found = seen.get
    told = {kind: {n.partition(" ")[2]: int(found.get(n) or 0) for n in measures if n.startswith(f"{kind} ")} for kind in ("outcome", "imputed", "lost")}
    if not told["outcome"][OTHER]:
        del told["outcome"][OTHER]
    return LakeBuild(spark, root, rows.schema, BuildCounts(told["outcome"], told["imputed"], told["lost"]))


def build_lake(
    spark: SparkSession,
    paths: str | Sequence[str],
    root: str,
    conform: Callable[[DataFrame], DataFrame] = taxi.conform,
    gather: bool = True,
) -> LakeBuild:
    """Scan CSV files, of one header or several, conform, clean and store them in one job.

    ``counts`` of the result has rows per outcome, values filled in, and the cells that were lost because they did not fit
    their type: the reader hands the raw text of such cells on, so they are counted in the same scan. ``conform`` keeps
    them if it goes through ``Contract.apply``.
    """
    raw = taxi.CONTRACT.mark_lost(csv_scan(spark, paths, taxi.CONTRACT, mixed=True, rescue=True), RESCUED)
    return store_outcomes(taxi.clean(conform(raw), mark=True), root, gather)
