"""The registered queries of the pipeline operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import automaton, bagminhash, decontaminate, language, merkle, neighbours, passages, pieces, quality, shards, surrogates, tries, warc
from millrace.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL
from millrace.llm.tables import importable, read, remainder

#: A vocabulary file of a public SentencePiece model.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Of the registered queries; an application passes its own secret.
SURROGATE_KEY = "millrace checks"
#: 24 shards in two regions of three racks, and the same with a 25th in the first rack.
SHARDS = shards.Tree.uniform(2, 3, 4)
GROWN_SHARDS = SHARDS.grown([shards.Shard("r0", "k0", 24)])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(read(spark, sf_dir, "documents"), PIECE_MODEL)
    return coded.select("doc_id", "n_tokens", "n_byte_tokens", pieces.ids_digest().alias("ids_sha256"), "round_trip", "parity")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.learn(docs.where(remainder("doc_id", 4) != 2))
    return language.identify(docs, model, ("doc_id", (remainder("doc_id", 4) == 2).alias("held_out")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    scored = quality.classify(read(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = automaton.learn_and_score(read(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)
    return scored.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(read(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "text", "n_entities")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_repeated", "n_removable", F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"])).alias("spans"), "partner")


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def leaf_of(text: Column) -> Column:
        return merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)

    text = F.col("text")
    changed = F.when(remainder("doc_id", 2) == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", leaf_of(text).alias("leaf"), leaf_of(changed).alias("claimed"))
    proofs = merkle.prove(merkle.build(rows, F.col("source"), ["doc_id"]), ["doc_id", "claimed"])
    folded = merkle.fold(F.col("claimed"), F.col("path"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(read(spark, sf_dir, "documents"), SHARDS, GROWN_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tries.ordered(read(spark, sf_dir, "conversations"))
    return tries.trie(tries.grafted(turns, F.col("conv_id") - F.col("conv_id") % 100, remainder("conv_id", 6), most=5))


Query = Callable[[SparkSession, str], DataFrame]


def _ready(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {f.__name__: _ready(f) for f in (op1_decontaminate, op2_sentencepiece, op3_language, op4_quality, op5_warc, op6_neighbours, op7_backoff, op8_surrogates, op9_passages, op10_bagminhash, op11_merkle, op12_hash_tree, op13_trie)}

#: DuckDB tests windows as joined texts of words, so no hash is shared with the operator.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
  b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
  n AS (SELECT DISTINCT least(len(ws), 13) AS size FROM b WHERE len(ws) > 0),
  bp AS (SELECT item_id, ws, least(len(ws), 13) AS size, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0),
  win AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM bp),
  dp AS (SELECT r, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM d, n WHERE len(ws) >= size),
  hit AS (SELECT dp.r, dp.i, dp.size, win.item_id FROM dp JOIN win ON dp.size = win.size AND array_to_string(dp.ws[dp.i:dp.i + dp.size - 1], ' ') = win.w),
  words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
  items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
            FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
  f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

ORACLES: dict[str, str] = {
    name: sql.strip()
    for name, sql in {"op1_decontaminate": OP1_SQL, "op5_warc": OP5_SQL, "op11_merkle": OP11_SQL, "op12_hash_tree": OP12_SQL, "op13_trie": OP13_SQL}.items()
}
