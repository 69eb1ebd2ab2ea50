"""Benchmark decontamination by winnowing.

Both sides are lower-cased (A-Z) and cut into words. Of every window of w k-grams the smallest hash is
kept, with w + k - 1 = 13 words, so any 13 words that a document shares with a benchmark item hold a kept
k-gram of both. Items shorter than 13 words are one window of their own length L and get a (k, w) of their
own with w + k - 1 = L; the lengths that occur (13 at most) are found beforehand.

A kept k-gram travels with the words around it that a window through it can reach. After the join by hash
the hit is extended word by word to both sides, which also settles hash collisions. The documents' k-grams
are first held against a bitmap of the benchmark's hashes, of a fixed 2^23 bits whatever the benchmark's
size: it lets all true hits pass, and the rest is decided by the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.tables import text_hash

WINDOW = 13
BITMAP_BITS = 23
FINGERPRINT = "row long, fp long, size int, at int, lefts string, rights string"


def shape(length: int) -> tuple[int, int]:
    """(k, w) with k + w - 1 = length: k-grams of over half a window keep chance hits rare."""
    k = (length + 3) // 2 if length > 2 else length
    return k, length - k + 1


def contexts(words: W.Words, doc: int, at: int, length: int, k: int) -> tuple[str, str]:
    """Words before ``at``, nearest first, and words from ``at`` on, as far as a window can reach."""
    lo, hi = words.first[doc], words.first[doc + 1]
    left = words.words(max(lo, at - (length - k)), at)[::-1]
    return " ".join(left), " ".join(words.words(at, min(hi, at + length)))


def _fingerprints(lengths: list[int], bitmap: np.ndarray | None, exact_size: bool):
    """Arrow batches (row, text) -> fingerprints, after one row (size 0) with each text's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for block in W.blocks(batch.column(1)):
                words = W.split(block)
                own = rows[block.first : block.last]
                parts = [(own, W.signed(W.mixed(own.astype(np.uint64))), np.zeros(len(own), np.int32), words.counts.astype(np.int32), [""] * len(own), [""] * len(own))]
                for length in lengths:
                    k, w = shape(length)
                    at, h = W.winnow(words, k, w, seed=length)
                    doc = words.doc[at]
                    if exact_size:  # an item has windows of its own size only
                        fit = np.minimum(words.counts[doc], WINDOW) == length
                        at, h, doc = at[fit], h[fit], doc[fit]
                    if bitmap is not None:
                        hit = bitmap[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
                        at, h, doc = at[hit], h[hit], doc[hit]
                    around = [contexts(words, d, a, length, k) for d, a in zip(doc, at, strict=True)]
                    parts.append((own[doc], W.signed(h), np.full(len(at), length, np.int32), (at - words.first[doc]).astype(np.int32), [a for a, _ in around], [b for _, b in around]))
                for p in parts:
                    if len(p[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(p[0], pa.int64()), pa.array(p[1], pa.int64()), pa.array(p[2], pa.int32()), pa.array(p[3], pa.int32()), pa.array(p[4], pa.string()), pa.array(p[5], pa.string())], names=["row", "fp", "size", "at", "lefts", "rights"])

    return run


def _numbered(df: DataFrame) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"), "*")


def benchmark_fingerprints(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """One row per distinct fingerprint and surroundings with the item_ids that have it; the window lengths."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    n_words = F.size(F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != ""))
    lengths = sorted(r[0] for r in items.select(F.least(n_words, F.lit(WINDOW)).alias("n")).where("n > 0").distinct().collect())
    # The id travels as the row's number; a null id marks hits but names no item.
    found = items.select(F.col("item_id").cast("long").alias("row"), "text")
    named = found.where("row is not null").mapInArrow(_fingerprints(lengths, None, True), FINGERPRINT).where("size > 0")
    unnamed = found.where("row is null").select(F.lit(0).cast("long").alias("row"), "text").mapInArrow(_fingerprints(lengths, None, True), FINGERPRINT).where("size > 0").withColumn("row", F.lit(None).cast("long"))
    grouped = named.unionByName(unnamed).groupBy("fp", "size", "lefts", "rights").agg(F.collect_set("row").alias("items"))
    return grouped, lengths


def _bitmap(fingerprints: DataFrame) -> np.ndarray:
    """The benchmark's hashes by their first 23 bits: at most 2^17 words of 64 bits reach the driver."""
    bit = F.shiftrightunsigned("fp", 64 - BITMAP_BITS)
    word = F.shiftright(bit, 6)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - BITMAP_BITS}) & 63 as int))")
    rows = fingerprints.select(word.alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits")).collect()
    packed = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for r in rows:
        packed[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)


def _same(a: Column, b: Column) -> Column:
    """How many leading words two texts of words share."""
    left, right = F.split(a, " "), F.split(b, " ")
    equal = F.zip_with(left, right, lambda x, y: x.eqNullSafe(y) & (x != ""))
    stop = F.array_position(equal, F.lit(False))
    return F.when(stop > 0, stop - 1).otherwise(F.size(equal)).cast("int")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its columns doc_id and text_hash, n_words, n_hit, items and spans.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. ``spans`` are
    the pairs (start, stop) of words found, which may overlap. A null or empty text has no words and no hits.
    Repeated rows give one result each. A null doc_id stays null; an item of null item_id marks hits but is
    not among ``items``. With an empty benchmark nothing is hit.
    """
    fingerprints, lengths = benchmark_fingerprints(benchmark)
    bitmap = _bitmap(fingerprints) if lengths else None
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_hash(F.col("text")).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            sub = pa.RecordBatch.from_arrays([pa.array(np.arange(len(number))), batch.column(3)], names=["row", "text"])
            for out in _fingerprints(lengths, bitmap, False)([sub]):
                at = out.column(0)
                own = np.asarray(number[at.to_numpy()])
                fp = out.column(1).to_numpy().copy()
                head = out.column(2).to_numpy() == 0
                fp[head] = W.signed(W.mixed(own[head].astype(np.uint64)))  # spreads the rows that seek nothing
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), batch.column(1).take(at), batch.column(2).take(at), pa.array(fp), *out.columns[2:]],
                    names=["row", "doc_id", "text_hash", "fp", "size", "at", "lefts", "rights"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"row long, doc_id {id_type}, text_hash long, fp long, size int, at int, lefts string, rights string")
    bench = fingerprints.select(F.col("fp").alias("b_fp"), F.col("size").alias("b_size"), F.col("lefts").alias("b_lefts"), F.col("rights").alias("b_rights"), "items")
    joined = found.join(bench, (found["fp"] == bench["b_fp"]) & (found["size"] == bench["b_size"]), "left")
    k = F.when(F.col("size") > 2, F.floor((F.col("size") + 3) / 2)).otherwise(F.col("size"))
    left, right = _same(F.col("lefts"), F.col("b_lefts")), _same(F.col("rights"), F.col("b_rights"))
    span = joined.select(
        "row", "doc_id", "text_hash", "size", "at", "items", "b_fp", left.alias("l"), right.alias("r"), k.alias("k")
    ).select(
        "row", "doc_id", "text_hash", F.when(F.col("size") == 0, F.col("at")).alias("words"),
        F.when(F.col("b_fp").isNotNull() & (F.col("r") >= F.col("k")) & (F.col("l") + F.col("r") >= F.col("size")), F.struct((F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r")).alias("stop"))).alias("span"),
        "items",
    )
    per_row = span.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("text_hash").alias("text_hash"),
        F.max("words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("span").isNotNull(), F.col("items"))))).alias("items"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0), x["stop"] - F.greatest(acc["end"], x["start"])).cast("long")
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["end"], x["stop"]).alias("end"))

    n_hit = F.aggregate("spans", zero, add, lambda acc: acc["n"])
    return per_row.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), "items", "spans")


def is_contaminated() -> Column:
    """The rule: some words are hit, and they are a twentieth of the text or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
