"""MinHash near-duplicates on multisets: BagMinHash signatures, bands, verified weighted Jaccard.

A text is the multiset of its runs of five words (lower-cased, as in ``words.ALNUM``). BagMinHash assigns
to every element a Poisson process over (time, weight level, signature component); a signature keeps, for
each component, the first point of any element that falls below that element's weight. Two
texts agree in a component with the probability of their weighted Jaccard similarity. The weight axis is
cut into dyadic intervals [0,1) [1,2) [2,4) [4,8) ...; points of an interval that the weight reaches only
in part are thinned by their level, so texts with different weights of an element share the points below
the smaller one. A process runs only until it passes the largest time of its text's signature.

Texts with equal words are one class from the start, so thousands of copies cost one signature's bands.
Buckets of equal bands are compared star-wise, a leader with every member; buckets that still hold several
components have all pairs across them compared, in bounded blocks where they are large, without writing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.components import components
from millrace.llm.tables import text_hash
from millrace.session import durable

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
_STEP = np.uint64(0xD1B54A32D192ED03)
_SECOND = np.uint64(0x8CB92BA72F3D8DD7)


def bags(words: W.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, element, weight) of each distinct run of ``size`` words, sorted by text and element.

    A text of fewer words, but not none, has one element: all its words.
    """
    h = W.kgrams(words.hashes, size)
    at = np.arange(len(h))
    inside = at + size <= words.first[words.doc[: len(h)] + 1]
    doc, element = words.doc[: len(h)][inside], h[inside]
    few = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(few):
        whole = [W.kgrams(words.hashes[words.first[d] : words.first[d + 1]], int(words.counts[d]), seed=int(words.counts[d]))[0] for d in few]
        doc, element = np.concatenate((doc, few)), np.concatenate((element, np.array(whole, np.uint64)))
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
    start = np.flatnonzero(new)
    return doc[start], element[start], np.diff(np.append(start, len(doc)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures of integer weights: n x m hashes of the first points (0 for texts without elements).

    A point is known by its element, level and number, so it is the same wherever its text stands. Its time is
    the running sum of its process, one point after the other, however many points are drawn at once.
    """
    sig = np.full((n, m), np.inf)
    first = np.zeros((n, m), np.uint64)
    levels = np.array([0, *[1 << i for i in range(40)]])
    parts = []
    for j in range(len(levels) - 1):
        have = np.flatnonzero(weight > levels[j])
        if not len(have):
            break
        parts.append((have, np.full(len(have), j)))
    if not parts:
        return first
    who = np.concatenate([p[0] for p in parts])
    level = np.concatenate([p[1] for p in parts])
    owner, reach, start = doc[who], weight[who], levels[level]
    width = levels[level + 1] - start
    seed = W.mixed(element[who] + level.astype(np.uint64) * _SECOND)
    passed, step = np.zeros(len(who)), 0
    flat, marks = sig.ravel(), first.ravel()
    while len(owner):
        k = int(np.clip(8192 // len(owner), 1, 64))  # few processes left: several points of each at once
        turn = np.arange(step + 1, step + k + 1, dtype=np.uint64) * _STEP
        bits = W.mixed(seed[:, None] + turn)
        sums = np.add.accumulate(np.concatenate((passed[:, None], -np.log(_uniform(bits))), axis=1), axis=1)[:, 1:]
        times = sums / (m * width)[:, None]
        second = W.mixed(bits ^ _SECOND)
        component = ((second >> np.uint64(40)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        fits = np.ones(times.shape, bool)
        part = np.flatnonzero(reach < start + width)
        if len(part):
            third = _uniform(W.mixed(second[part] ^ _STEP))
            fits[part] = start[part, None] + np.floor(third * width[part, None]) < reach[part, None]
        where, when, point = (owner[:, None] * m + component)[fits], times[fits], bits[fits]
        before = flat[where]
        np.minimum.at(flat, where, when)
        won = (when == flat[where]) & (when < before)
        marks[where[won]] = point[won]
        passed, step = sums[:, -1], step + k
        open_ = times[:, -1] < sig.max(axis=1)[owner]
        owner, reach, start, width, seed, passed = (x[open_] for x in (owner, reach, start, width, seed, passed))
    return first


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for r in range(rows):
        h = W.mixed(h * W.MULTIPLIER + bits[:, :, r])
    return h


def content_keys(words: W.Words) -> list[bytes | None]:
    """16 bytes for the words of each text in order; None for a text without words."""
    up, down = W.powers(len(words.hashes) + 1)
    halves = []
    for salt in (_STEP, _SECOND):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mixed(words.hashes ^ salt) * up[: len(words.hashes)], dtype=np.uint64)))
        value = (total[words.first[1:]] - total[words.first[:-1]]) * down[words.first[:-1]]
        halves.append(W.mixed(value + words.counts.astype(np.uint64)))
    raw = np.stack(halves, axis=1).astype("<u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if c else None for i, c in enumerate(words.counts)]


def expanded(doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: an element of weight w becomes w different ones."""
    copies = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.repeat(doc, weight), W.mixed(np.repeat(element, weight) + copies.astype(np.uint64) * _STEP)


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, content (null without words), n (size of the multiset) and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(2)):
                words = W.split(block)
                k = block.last - block.first
                doc, element, weight = bags(words)
                h = band_hashes(signatures(doc, element, weight, k, bands * rows), bands, rows)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(W.signed(h.ravel())), bands).cast(pa.list_(pa.int64()))
                size = np.bincount(doc, weight, minlength=k).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, k), batch.column(1).slice(block.first, k), pa.array(content_keys(words), pa.binary()), pa.array(size), lists],
                    names=["doc_id", "text_hash", "content", "n", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, content binary, n long, bands array<long>")


NEEDED_BITS = 24


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(content, elements) of the rows whose key is in ``needed`` (content, key), each text's multiset as a set.

    The text is read again instead of being stored or shuffled. A bitmap of a fixed 2^24 bits of the needed
    keys travels to the tasks; the few rows that it lets through by chance find no partner in the joins.
    """
    bit = F.shiftrightunsigned("key", 64 - NEEDED_BITS)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - NEEDED_BITS}) & 63 as int))")
    words_ = needed.select(F.shiftright(bit, 6).alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits")).toPandas()
    packed = np.zeros(1 << (NEEDED_BITS - 6), np.uint64)
    packed[words_["word"].to_numpy()] = words_["bits"].to_numpy().astype(np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - NEEDED_BITS)).astype(np.int64)
            chosen = np.flatnonzero(packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            if not len(chosen):
                continue
            for block in W.blocks(batch.column(1).take(pa.array(chosen))):
                words = W.split(block)
                doc, element = expanded(*bags(words))
                stop = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=block.last - block.first))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(content_keys(words), pa.binary()), pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(W.signed(element)))], names=["content", "elements"]
                )

    key = F.xxhash64("doc_id", text_hash(F.col("text")))
    found = docs.select(key.alias("key"), "text").mapInArrow(run, "content binary, elements array<long>").where("content is not null")
    return found.join(needed.select("content"), "content", "left_semi").dropDuplicates(["content"])


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    left, right = (sets.select(F.col("content").alias(k), F.col("elements").alias(e)) for k, e in (("a", "x"), ("b", "y")))
    both = pairs.join(left, "a").join(right, "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return common.where(F.col("common") >= similarity * (F.col("total") - F.col("common"))).select("a", "b")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the left sets shares with each of the right ones.

    Elements of few sets are counted pair by pair, frequent ones by products of 0/1 matrices.
    """
    n, m = len(left), len(right)
    owner = np.concatenate([np.full(len(x), i) for i, x in enumerate([*left, *right])] or [np.empty(0, np.int64)]).astype(np.int64)
    _, code, count = np.unique(np.concatenate([*left, *right] or [np.empty(0, np.int64)]), return_inverse=True, return_counts=True)
    order = np.lexsort((owner, code))
    code, owner = code[order], owner[order]
    out = np.zeros((n, m), np.int64)
    start = np.cumsum(count) - count
    for c in range(2, 9):
        at = start[count == c]
        group = owner[at[:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i + 1, c):
                a, b = group[:, i], group[:, j]
                ok = (a < n) & (b >= n)
                out += np.bincount(a[ok] * m + b[ok] - n, minlength=n * m).reshape(n, m)
    many = np.flatnonzero(count > 8)
    for i in range(0, len(many), 2048):
        part = many[i : i + 2048]
        dense = np.zeros((n + m, len(part)), np.float32)
        size = count[part]
        at = np.repeat(start[part], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        dense[owner[at], np.repeat(np.arange(len(part)), size)] = 1
        out += (dense[:n] @ dense[n:].T).astype(np.int64)
    return out


BLOCK_ELEMENTS = 250_000
SMALL = 12


def _across(members: DataFrame, similarity: float) -> DataFrame:
    """Links between components inside large buckets: rows (bucket, content, comp, n, elements).

    A bucket is cut into blocks of about BLOCK_ELEMENTS elements by a hash; every two blocks meet in one task,
    which compares all their sets and returns one link for each two components it joins, not all pairs.
    """
    blocks = members.groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("blocks"))
    own = members.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("content", "bucket"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "content", "comp", "elements")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["own", "content"], ignore_index=True)
        left = rows[rows["own"] == rows["i"]]
        right = rows[rows["own"] == rows["j"]]
        empty = pd.DataFrame({"a": [], "b": []})
        if not len(left) or not len(right):
            return empty
        common = overlaps(left["elements"].tolist(), right["elements"].tolist())
        total = left["elements"].map(len).to_numpy()[:, None] + right["elements"].map(len).to_numpy()[None, :]
        comp = pd.factorize(pd.concat([left["comp"], right["comp"]]))[0]
        a, b = np.nonzero((common >= similarity * (total - common)) & (comp[: len(left), None] != comp[None, len(left) :]))
        if not len(a):
            return empty
        two = np.sort(np.stack((comp[a], comp[len(left) + b]), axis=1), axis=1)
        first = np.unique(two, axis=0, return_index=True)[1]
        return pd.DataFrame({"a": left["content"].to_numpy()[a[first]], "b": right["content"].to_numpy()[b[first]]})

    return met.groupBy("bucket", "i", "j").applyInPandas(compare, "a binary, b binary")


def links(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) between contents: enough of them to tell the components, not all pairs.

    ``classes`` is stored and has content, key (of a row that holds it), n and bands. In a bucket the member that
    shares most buckets with others (near the middle of its group) leads and is compared with all. What is left in
    several components after that is compared pair by pair: small buckets by a join, larger ones in blocks.
    """
    rows = classes.select(F.explode("bands").alias("bucket"), "content", "n")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    live = durable(rows.join(sizes, "bucket"), "buckets")
    degree = live.groupBy("content").agg(F.sum("size").alias("degree"))
    leads = live.join(degree, "content").groupBy("bucket").agg(F.max(F.struct("degree", "content"))["content"].alias("lead"), F.max_by("n", F.struct("degree", "content")).alias("n_lead"))
    live = durable(live.join(leads, "bucket"), "led")
    needed = classes.join(live.select("content").distinct(), "content", "left_semi").select("content", "key")
    sets = durable(_sets(docs, needed), "sets")

    def fits(a: str, b: str) -> Column:
        return F.least(a, b) >= similarity * F.greatest(a, b)

    stars = live.where((F.col("content") != F.col("lead")) & fits("n", "n_lead")).select(F.col("lead").alias("a"), F.col("content").alias("b")).distinct()
    found = durable(_similar(stars, sets, similarity), "star-links")
    label = components(found).select(F.col("node").alias("content"), "root")
    rest = live.where("size > 2").join(label, "content", "left").withColumn("comp", F.coalesce("root", "content"))
    split = rest.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
    rest = durable(rest.join(split, "bucket").where(F.col("content") != F.col("lead")).select("bucket", "content", "n", "comp", "size"), "rest")
    few = rest.where(F.col("size") <= SMALL)
    one, two = (few.select("bucket", F.col("content").alias(k), F.col("n").alias(f"n_{k}"), F.col("comp").alias(f"comp_{k}")) for k in "ab")
    pairs = one.join(two, "bucket").where((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & fits("n_a", "n_b")).select("a", "b").distinct()
    more = durable(_similar(pairs, sets, similarity), "pair-links")
    large = rest.where(F.col("size") > SMALL).select("bucket", "content", "comp", "n").join(sets, "content")
    most = durable(_across(large, similarity), "block-links")
    return found.unionByName(more).unionByName(most)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, class_id and kept of each row of ``docs``.

    Rows are in one class if a chain of texts leads from one to the other in which neighbours have a weighted
    Jaccard similarity of five-word runs of ``similarity`` or more. class_id is the smallest doc_id of the
    class; ``kept`` marks the row it belongs to (of one doc_id with several texts: that with the smaller text
    hash; rows repeated as a whole are marked together). Bands and rows find a pair of similarity 0.8 with a
    probability of 0.99997 and more similar ones more surely. Texts without words (null, empty) are classes of
    their own. Null doc_ids come last; a class of nothing else has a null class_id. Other columns are ignored.
    """
    base = durable(sketched(docs, bands, rows), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    classes = durable(
        base.where("content is not null").groupBy("content").agg(F.min(order).alias("head"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("key", F.xxhash64("head.doc_id", "head.text_hash")),
        "classes",
    )
    label = components(links(docs, classes, similarity)).select(F.col("node").alias("content"), "root")
    several = classes.select("content", "head", "copies").join(label, "content", "left").where("copies > 1 or root is not null")
    several = several.select("content", "head", F.coalesce("root", "content").alias("root"))
    heads = several.groupBy("root").agg(F.min("head").alias("top"))
    tops = durable(several.join(heads, "root").select("content", "top"), "tops")
    joined = base.select("doc_id", "text_hash", "content").join(tops, "content", "left")
    own = F.col("top").isNull()
    same = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_hash") == F.col("top.text_hash"))
    return joined.select("doc_id", "text_hash", F.when(own, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"), (own | same).alias("kept"))
