from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import tables as T
from millrace.session import durable


def test_bitmaps_hold_all_keys(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("key"))
    packed = T.key_bitmap(keys)
    own = np.array([r.key for r in keys.collect()])
    assert T.in_bitmap(packed, own).all() and T.in_bitmap(packed, own + (1 << 50)).mean() < 0.05
    assert not T.in_bitmap(T.key_bitmap(keys.limit(0)), own).any()


def test_dropping_is_exact(odd, none, monkeypatch):
    listed = odd.select("doc_id", T.text_hash(F.col("text")).alias("text_hash"))
    bad = durable(listed.where("doc_id in (1, 3) or doc_id is null"))
    for bits in (24, 6):  # with 64 bits nearly all rows are marked by chance
        monkeypatch.setattr(T, "BITMAP_BITS", bits)
        got = T.drop_where(odd, bad)
        assert got.columns == odd.columns
        assert sorted(r.doc_id for r in got.collect()) == [2, 4, 5, 6, 7]
        assert T.drop_where(odd, bad.limit(0)).count() == odd.count() and T.drop_where(none, bad).count() == 0
