"""CSV input read against a contract, without schema inference."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from millrace.functions import quoted
from millrace.operators.contract import Contract, type_report
from millrace.session import session_conf


def text_schema(names: Sequence[str]) -> T.StructType:
    """Every column as text, to look at raw cells."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names in the header line of the first file at ``path``."""
    return spark.read.option("header", True).csv(path).columns


#: Bytes of a file that a task looks through for its first line.
_SPLIT = 128 << 20


def header_lines(spark: SparkSession, paths: str | Sequence[str]) -> list[Row]:
    """(path, header) of the files of one or more paths: their first lines, cut into names. Empty files are left out.

    One job reads them, a task for each file or, of large ones, each 128 MiB; the driver opens none. It gets a path and a
    line per file, as the scans that follow need them. All lines but the first are dropped where they are read, which no
    Python worker sees. A compressed file is read as Spark's text source reads it.
    """
    # A task has one piece of a file, so its first line is that of the file if the piece begins there.
    with session_conf(spark, spark__sql__files__maxPartitionBytes=str(_SPLIT), spark__sql__files__openCostInBytes=str(_SPLIT)):
        lines = spark.read.text([paths] if isinstance(paths, str) else list(paths)).select(
            "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"),
        )
        found = lines.where("nth = 0 AND start = 0 AND value <> ''").select("path", "value").collect()
    return [Row(path=unquote(r.path), header=next(csv.reader([r.value.lstrip("\ufeff")]))) for r in found]


def headers_by_file(spark: SparkSession, paths: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files of one or more paths by their header line. Empty files are left out."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in header_lines(spark, paths):
        groups.setdefault(tuple(header), []).append(path)
    return groups


RESCUED = "rescued"
_LINE = "_unread_line"


def _with_rescued(scan: DataFrame, schema: T.StructType) -> DataFrame:
    """The scan with ``rescued``: raw text by column of the cells that are NULL because the reader could not parse them.

    The reader hands back the line of such a row only, and only these lines are taken apart a second time.
    """
    typed = [s.name for s in schema if not isinstance(s.dataType, T.StringType) and s.name != _LINE]
    names = [s.name for s in schema if s.name != _LINE]
    if not typed:
        return scan.withColumn(RESCUED, F.lit(None).cast("map<string,string>")).drop(_LINE)
    # Names by place: a header may hold any text, also twice.
    raw = F.from_csv(F.col(_LINE), ", ".join(f"c{i} string" for i in range(len(names))))

    def lost(cells: Column) -> Column:
        pairs = [F.struct(F.lit(n).alias("key"), F.when(F.col(quoted(n)).isNull(), cells[f"c{names.index(n)}"]).alias("value")) for n in typed]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))

    found = F.when(F.col(_LINE).isNotNull(), F.transform(F.array(raw), lost)[0])
    return scan.withColumn(RESCUED, F.when(F.size(F.map_keys(found)) > 0, found)).drop(_LINE)


def csv_scan(
    spark: SparkSession, paths: str | Sequence[str], contract: Contract | None = None, mixed: bool = False, rescue: bool = False
) -> DataFrame:
    """Read CSV files with a header: as text, or with the types a contract asks for.

    Spark assigns cells by position, so a file is only ever read with its own header; a file
    that has another is an error, not shifted columns. Each path has one header, or, with
    ``mixed``, files are grouped by their header lines (a column added in some year, another
    order). Each layout is one scan, and the results are united by name. ``_metadata`` stays
    available on a single layout only, hence ``file_name``.

    ``rescue`` adds a column ``rescued``, a map from column to raw text of the cells that are there but
    could not be parsed; NULL for most rows. ``Contract.mark_lost`` reads it.
    """
    typing = contract.reading_schema if contract else text_schema
    if mixed:
        groups = list(headers_by_file(spark, paths).items())
        if not groups:
            raise ValueError(f"no CSV file with a header in {paths}")
    else:
        groups = [(header_of(spark, p), p) for p in ([paths] if isinstance(paths, str) else paths)]

    def scan(header: Sequence[str], files: str | list[str]) -> DataFrame:
        schema = typing(list(header))
        reader = spark.read.option("header", True).option("enforceSchema", False)
        if rescue:
            schema = schema.add(_LINE, T.StringType())
            reader = reader.option("columnNameOfCorruptRecord", _LINE)
        rows = reader.schema(schema).csv(files).select("*", F.col("_metadata.file_name").alias("file_name"))
        return _with_rescued(rows, schema) if rescue else rows

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (scan(header, files) for header, files in groups))


def lost_cells(spark: SparkSession, paths: str | Sequence[str], contract: Contract) -> DataFrame:
    """What a typed read of the files loses: (column_name, expected_type, actual_type, lost_values).

    One pass over the text of the files counts, per column of another type than text, the cells that
    hold something the contract's type cannot. It is a pass of its own, for files that are looked at before they
    are read; ``build_lake`` counts the same in the scan that builds the lake.
    """
    return type_report(contract.rename(csv_scan(spark, paths, mixed=True)), contract)


def year_month_from(name: Column, pattern: str = r"(\d{4})-(\d{2})") -> dict[str, Column]:
    """Year and month in a file name, NULL where the pattern does not match."""
    return {
        part: F.regexp_extract(name, pattern, group).try_cast("int")
        for part, group in (("year", 1), ("month", 2))
    }
