"""From raw documents to token ids: quality, near-duplicates, benchmark contamination, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; ``run`` stores each result in the
shared folder and hands it to the next, as a cluster that may lose executors needs. Filtering stages decide
on small tables of (doc_id, text_hash) and drop the few rows found; all columns of the documents pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bagminhash, decontaminate, pieces, quality, surrogates
from millrace.llm import words as W
from millrace.llm.queries import PIECE_MODEL, SURROGATE_KEY
from millrace.llm.tables import drop_where, importable, one_where, read, remainder
from millrace.session import durable

#: Rows in a batch that goes to a Python worker. Those of Spark's default (10,000) held tens of MB of texts on both sides.
BATCH_ROWS = 1_000


def _workers(spark: SparkSession) -> None:
    """Let Python workers import this package, and get texts in small batches: they outlive a stage with what they held.

    The session keeps the setting, as the rows of a stage are computed by whoever stores them.
    """
    importable(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good, learnt from three quarters of the labels.

    Null and empty texts get a score like any other, so they may go. Rows of one id and text go or stay together,
    whole repeats included. An empty table stays empty. All columns pass through, whatever they are called.
    """
    _workers(spark)
    labels = read(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    scored = quality.classify(docs, labels)
    return drop_where(docs, durable(scored.where("predicted = 0").select("doc_id", "text_hash"), "poor"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and one row of those repeated as a whole.

    Rows without an id and without words are not known to be copies of each other: all stay.
    """
    _workers(spark)
    classes = durable(bagminhash.near_duplicates(docs), "near-duplicates")
    one = drop_where(docs, classes.where(~F.col("kept")).select("doc_id", "text_hash"))
    heads = classes.where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    again = durable(heads.where("rows > 1").select("doc_id", "text_hash"), "repeated-rows")
    return one if again.isEmpty() else one_where(one, again, F.col("doc_id").isNotNull() | F.col("text").rlike("[0-9A-Za-z]|[^\\x00-\\x7F]"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts have no words, so they stay; whole texts are tested, however long. Rows of one id and text go
    or stay together. An empty table or benchmark leaves all as it is. All columns pass through.
    """
    _workers(spark)
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    return drop_where(docs, durable(found.where(decontaminate.is_contaminated()).select("doc_id", "text_hash"), "contaminated"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the new text.

    Every row stays, repeats too; null texts stay null, empty ones empty, and equal texts become equal texts. Of other
    columns none is touched but n_chars, if there is one.
    """
    safe = surrogates.pseudonymise(docs, SURROGATE_KEY).drop("n_entities")
    return safe.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else safe


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, a row each, repeats too. Null and empty texts have no pieces; other columns go."""
    _workers(spark)
    return pieces.encode(docs, PIECE_MODEL, block_bytes=W.BLOCK_BYTES).select("doc_id", "ids", "n_tokens", "n_byte_tokens", "round_trip", "parity")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("personal_data", without_personal_data),
    ("pieces", token_ids),
]

#: Trees, signatures and token ids are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Rows without an id, with null, empty or very long texts, ties and whole repeats are
    treated as the stages say; no documents give no rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
