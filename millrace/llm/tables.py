"""Helpers that the queries share."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % modulus


BITMAP_BITS = 24


def key_bitmap(keys: DataFrame, column: str = "key", bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of 2^``bits`` bits, whatever the number of keys, of the leading bits of 64-bit keys."""
    bit = F.shiftrightunsigned(column, 64 - bits)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - bits}) & 63 as int))")
    rows = keys.select(F.shiftright(bit, 6).alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits")).toPandas()
    packed = np.zeros(1 << (bits - 6), np.uint64)
    packed[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return packed


def in_bitmap(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the bitmap; all that are, and by chance a few more."""
    bits = len(packed).bit_length() + 5
    at = (keys.astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _marked(docs: DataFrame, named: DataFrame) -> DataFrame:
    """``docs`` with __marked: whether a bitmap lets the row be one of ``named`` (doc_id, text_hash)."""
    packed = key_bitmap(named.select(F.xxhash64("doc_id", "text_hash").alias("key")))

    @F.pandas_udf("boolean")
    def may_be(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(packed, keys.to_numpy()))

    return docs.withColumn("__marked", may_be(F.xxhash64("doc_id", text_hash(F.col("text")))))


def drop_where(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text_hash) are in ``bad``, which should be stored.

    Null ids count as equal to each other. Rows that a bitmap of the bad keys rules out pass as they are, so
    their texts are neither joined nor shuffled at any size; only the rows it marks go through the exact join.
    """
    marked = _marked(docs, bad)
    good = marked.where(~F.col("__marked")).drop("__marked")
    rest = marked.where(F.col("__marked")).drop("__marked")
    names = bad.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    match = rest["doc_id"].eqNullSafe(names["__id"]) & (text_hash(rest["text"]) == names["__hash"])
    return good.unionByName(rest.join(names, match, "left_anti"))


def one_where(docs: DataFrame, repeated: DataFrame, where: Column) -> DataFrame:
    """``docs`` with one row of each (doc_id, text_hash) of ``repeated``, among the rows that hold ``where``.

    Null ids count as equal to each other. Rows that a bitmap of the keys rules out pass as they are; a row that
    it lets through by chance is the only one of its key and stays.
    """
    marked = _marked(docs, repeated).withColumn("__marked", F.col("__marked") & F.coalesce(where, F.lit(False)))
    good = marked.where(~F.col("__marked")).drop("__marked")
    rest = marked.where(F.col("__marked")).drop("__marked").withColumn("__hash", text_hash(F.col("text")))
    return good.unionByName(rest.dropDuplicates(["doc_id", "__hash"]).drop("__hash"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster needs it installed)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, env.get("PYTHONPATH", "")) if p)
