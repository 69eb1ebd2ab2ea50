from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from test_llm_bagminhash import brute as duplicates
from test_llm_decontaminate import brute as contaminated

import corpus_pipeline
from millrace.llm import bagminhash, quality, surrogates
from millrace.llm import words as W
from millrace.session import durable

PATH = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, PATH))
        results[name] = docs.toPandas().set_index("doc_id")
        assert name == "pieces" or docs.columns == columns
    start = spark.read.parquet(f"{PATH}/documents.parquet")
    labels = spark.read.parquet(f"{PATH}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    good = {r.doc_id for r in quality.classify(start, labels).collect() if r.predicted}
    assert set(results["quality"].index) == good
    texts = results["quality"]["text"].to_dict()
    want = duplicates(texts)
    assert set(results["near_duplicates"].index) == {i for i, c in want.items() if i == c}
    bench = [tuple(r) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").select("item_id", "text").collect()]
    kept = results["near_duplicates"]["text"].to_dict()
    clean = {i for i, n, hit, _ in contaminated(list(kept.items()), bench) if not (hit and 20 * hit >= n)}
    assert set(results["decontamination"].index) == clean == set(results["personal_data"].index) == set(results["pieces"].index)
    left = docs.sparkSession.createDataFrame(results["personal_data"].reset_index()[["doc_id", "text"]])
    before = docs.sparkSession.createDataFrame(results["decontamination"].reset_index()[["doc_id", "text"]])
    found = lambda d: {x for r in d.select(surrogates.entities(F.col("text")).alias("e")).collect() for x in r.e}
    assert not found(left) & found(before)
    assert (results["pieces"]["n_tokens"] > 0).any() and results["pieces"]["round_trip"].all()
    assert corpus_pipeline.run(spark, PATH).count() == len(results["pieces"])


def test_nothing_to_do(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, PATH))
        assert docs.count() == 0


def test_rows_repeated_as_a_whole_leave_one(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (1, text), (2, "a b c d e f g"), (None, "no id at all here"), (None, "no id at all here"), (None, "NO id at all here!"), (3, ""), (3, ""), (None, "?"), (None, "?"), (None, None), (4, "other words")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n long")
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, PATH).collect()), key=repr)
    nameless = next(t for i, t in left if i is None and t and "id" in t)
    assert left == sorted([(1, text), (2, "a b c d e f g"), (3, ""), (4, "other words"), (None, nameless), (None, "?"), (None, "?"), (None, None)], key=repr)


def test_stages_take_odd_rows(spark, odd):
    """Nulls, empty and long texts, ties, whole repeats, columns with names that operators use inside."""
    rows = {r.asDict()["row"] for r in odd.collect()}
    left = {name: stage(spark, odd, PATH).collect() for name, stage in corpus_pipeline.STAGES}
    for name, got in left.items():
        if name != "pieces":
            assert got[0].asDict().keys() == set(odd.columns) and {r["row"] for r in got} <= rows
    assert len(left["near_duplicates"]) == odd.count() - 1  # the row that is there twice
    assert all(len(left[name]) == odd.count() for name in ("decontamination", "personal_data", "pieces"))
    assert len(left["quality"]) <= odd.count()
    texts = lambda got: sorted(((r.doc_id, r.text) for r in got), key=repr)
    assert texts(left["personal_data"]) == texts(odd.collect())
    assert all(r.n_tokens == 0 for r in left["pieces"] if r.doc_id in (2, 3))


def test_python_workers_hold_little_text_at_once(spark, monkeypatch):
    """Batches of few rows, and blocks of one size in the stages whose workers took most memory."""
    seen, sizes, frame = [], [], type(spark.range(1))
    mapped, blocks = frame.mapInArrow, W.blocks
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: seen.append(f) or mapped(self, f, schema))
    monkeypatch.setattr(W, "blocks", lambda *a: (sizes.append(len(b.data)) or b for b in blocks(*a)))
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    corpus_pipeline.token_ids(spark, docs, "")
    bagminhash.sketched(docs)
    texts = pa.array(["some words of a text " * 20_000] * 8)
    zeros = pa.array([0] * 8)
    list(seen[0](iter([pa.RecordBatch.from_arrays([zeros, texts, pa.array([False] * 8)], names=["doc_id", "text", "audited"])])))
    list(seen[1](iter([pa.RecordBatch.from_arrays([zeros, zeros, texts], names=["doc_id", "text_hash", "text"])])))
    assert sum(sizes) == 2 * 8 * 420_000 and max(sizes) <= W.BLOCK_BYTES
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= corpus_pipeline.BATCH_ROWS
