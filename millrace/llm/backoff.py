"""Language-model scoring by a weighted backoff automaton.

Every token has its exact training count, smoothed by adding 0.5. Over it stands an automaton of smoothed
n-grams up to order 3: a state is a history, an arc reads a token with an interpolated probability (absolute
discounting), and a failure arc leads, at the weight of what the arcs left over, to the state of the history
without its first token. The root reads any token.

All n-grams that occur twice or more are kept, at any size of the corpus (``ngram_share`` prunes if asked).
A text's score is a sum over its tokens, pairs and triples: each kept one has a gain, by which its arc is better
than failing, and a failure weight, which counts wherever a further token follows. These stand in a stored
table by key. The frequent ones also travel to the tasks as arrays (at most 1 / share of each order); all others
of a text are counted, joined with the table and summed. A bitmap of fixed size leaves out most n-grams that the
table cannot have; what it lets through finds nothing in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.tables import in_bitmap, key_bitmap
from millrace.session import durable

DISCOUNT = 0.75
END = int(np.array([0x1D2E3F4A5B6C7D8E], np.int64)[0])
ORDER = 3
GRAM_BITS = 25


def tokens(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each token, each text's end included."""
    words = W.split(block, W.SPACED)
    n = block.last - block.first
    stop = words.first[1:] + np.arange(n)
    doc = np.repeat(np.arange(n), words.counts + 1)
    hashes = np.empty(len(doc), np.int64)
    inner = np.ones(len(doc), bool)
    inner[stop] = False
    hashes[inner] = W.signed(words.hashes)
    hashes[stop] = END
    return doc, hashes


def place(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value, or -1."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


def joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of the n-gram whose first tokens have the key ``prefix`` and whose last ones ``suffix``."""
    return W.signed(W.mixed(W.mixed(prefix.view(np.uint64)) * W.MULTIPLIER + suffix.view(np.uint64)))


def orders(doc: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the text number and key of each n-gram; those of one text follow each other."""
    out = [(doc, hashes)]
    while len(out) < ORDER:
        d, key = out[-1]
        same = np.flatnonzero(d[1:] == d[:-1])
        out.append((d[same], joined(key[same], key[same + 1])))
    return out


def followed(doc: np.ndarray) -> np.ndarray:
    """Which n-grams have a further token after them in their text."""
    out = np.zeros(len(doc), bool)
    out[:-1] = doc[1:] == doc[:-1]
    return out


@dataclass
class Automaton:
    """The frequent part of the model, which travels to the tasks; keys are sorted.

    ``gains`` and ``fails`` are the log10 gain and failure weight of tokens, pairs and triples (a token's gain is over
    a token never seen). Tokens of ``token_least`` and n-grams of ``gram_least`` occurrences or more are here.
    """

    total: int
    distinct: int
    token_least: float
    gram_least: float
    keys: list[np.ndarray]
    gains: list[np.ndarray]
    fails: list[np.ndarray]

    @property
    def unseen(self) -> float:
        """log10 probability that the root gives a token never seen."""
        return float(np.log10(0.5 / (self.total + 0.5 * (self.distinct + 1))))

    @property
    def pairs(self) -> np.ndarray:
        return self.keys[1]

    @property
    def triples(self) -> np.ndarray:
        return self.keys[2]

    def is_here(self):
        return F.when(F.col("size") == 1, F.col("n") >= self.token_least).otherwise(F.col("n") >= self.gram_least)


def _counted(texts: DataFrame, keys) -> DataFrame:
    """(key, n) summed over all texts; ``keys`` gives the keys of a block. A task sends each key once per few MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(0), 2 * W.BLOCK_BYTES):
                key, n = np.unique(keys(block), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _grams(texts: DataFrame, size: int, lower: DataFrame, least: float) -> DataFrame:
    """(key, prefix, suffix, n) of the n-grams of ``size`` tokens that occur ``least`` times or more; stored.

    Both parts of such an n-gram are in ``lower`` (key); a bitmap leaves out most others before they are counted.
    """
    shared = texts.sparkSession.sparkContext.broadcast(key_bitmap(lower, bits=GRAM_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(0), 2 * W.BLOCK_BYTES):
                doc, part = orders(*tokens(block))[size - 2]
                may = in_bitmap(shared.value, part)
                at = np.flatnonzero((doc[1:] == doc[:-1]) & may[1:] & may[:-1])
                key, first, n = np.unique(joined(part[at], part[at + 1]), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, part[at[first]], part[at[first] + 1], n)], names=["key", "prefix", "suffix", "n"])

    counted = texts.select("text").mapInArrow(run, "key long, prefix long, suffix long, n long").groupBy("key", "prefix", "suffix").agg(F.sum("n").alias("n"))
    return durable(counted.where(F.col("n") >= least), f"grams-{size}")


def _left(grams: DataFrame) -> DataFrame:
    """(prefix, taken): what the arcs of each history take of its occurrences."""
    return grams.groupBy("prefix").agg(F.sum(F.col("n") - DISCOUNT).alias("taken"))


def learn(training: DataFrame, token_share: float = 2.0**-20, ngram_share: float = 0.0, cache_share: float = 2.0**-17) -> tuple[Automaton, DataFrame]:
    """The automaton's frequent part, and the stored table (key, size, n, gain, fail) of all of it. Null texts are empty ones.

    ``ngram_share`` prunes n-grams below that share of all tokens (0: those that occur once). The other shares say
    what travels to the tasks; they do not change results.
    """
    if token_share < 2.0**-20 or cache_share < 2.0**-20:
        raise ValueError("shares of 2^-20 or more are needed of what travels to the tasks")
    counts = durable(_counted(training, lambda block: tokens(block)[1]), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(2.0, ngram_share * total)
    auto = Automaton(int(total), int(distinct), token_share * total, max(least, cache_share * total), [], [], [])
    pairs = _grams(training, 2, counts.where(F.col("n") >= least), least)
    triples = _grams(training, 3, pairs, least)
    base = F.log10((F.col("n") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    left = 1 - F.coalesce("taken", F.lit(0.0)) / F.col("n")
    one = durable(counts.join(_left(pairs).withColumnRenamed("prefix", "key"), "key", "left").select("key", "n", base.alias("log"), left.alias("left")), "tokens")

    def arcs(grams: DataFrame, lower: DataFrame, upper: DataFrame | None) -> DataFrame:
        """key, n, log (of the arc's probability), left and gain of each n-gram."""
        first = lower.select(F.col("key").alias("prefix"), F.col("n").alias("times"), F.col("left").alias("rest"))
        last = lower.select(F.col("key").alias("suffix"), F.col("log").alias("lower"))
        both = grams.join(first, "prefix").join(last, "suffix")
        both = both.withColumn("log", F.log10((F.col("n") - DISCOUNT) / F.col("times") + F.col("rest") * F.pow(F.lit(10.0), "lower")))
        both = both.withColumn("gain", F.col("log") - F.log10("rest") - F.col("lower"))
        if upper is not None:
            both = both.join(_left(upper).withColumnRenamed("prefix", "key"), "key", "left")
        return both.select("key", "n", "log", (F.lit(1.0) if upper is None else left).alias("left"), "gain")

    two = durable(arcs(pairs, one, triples), "pairs")
    three = arcs(triples, two, None)
    sized = [t.select("key", F.lit(i).alias("size"), "n", g.alias("gain"), F.log10("left").alias("fail")) for i, t, g in ((1, one, F.col("log") - auto.unseen), (2, two, F.col("gain")), (3, three, F.col("gain")))]
    table = durable(sized[0].unionByName(sized[1]).unionByName(sized[2]), "model")
    head = table.where(auto.is_here()).toPandas().sort_values("key")
    for i in range(1, ORDER + 1):
        part = head[head["size"] == i]
        for have, name, kind in ((auto.keys, "key", np.int64), (auto.gains, "gain", np.float64), (auto.fails, "fail", np.float64)):
            have.append(part[name].to_numpy(kind))
    return auto, table


def score(docs: DataFrame, model: Automaton, table: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``; see ``learn``.

    base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, the end included; score is the log10
    probability of the text. A null text is an empty one (its end alone). Repeated rows have a result each. With
    nothing learnt every token is unknown, at probability 1 of the one unseen token. Other columns are ignored.
    """
    tail = table.where(~model.is_here())
    shared = docs.sparkSession.sparkContext.broadcast((model, key_bitmap(tail, bits=GRAM_BITS)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    columns = ["row", "doc_id", "key", "times", "after", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, packed = shared.value
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for block in W.blocks(batch.column(2)):
                k = block.last - block.first
                own = numbers[block.first : block.last]
                many, known = np.zeros(k, np.int64), np.zeros(k, np.int64)
                base, total = np.zeros(k), np.zeros(k)
                asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for i, (doc, h) in enumerate(orders(*tokens(block))):
                    at, more = place(auto.keys[i], h), followed(doc)
                    here = np.flatnonzero(at >= 0)
                    gain = np.bincount(doc[here], auto.gains[i][at[here]], minlength=k)
                    on = here[more[here]]
                    total += gain + np.bincount(doc[on], auto.fails[i][at[on]], minlength=k)
                    if i == 0:
                        many = np.bincount(doc, minlength=k)
                        known = np.bincount(doc[here], minlength=k)
                        base = gain + many * auto.unseen
                        total += many * auto.unseen
                    ask = np.flatnonzero((at < 0) & in_bitmap(packed, h))
                    asked.append((doc[ask], h[ask], more[ask]))
                zeros = pa.array(np.zeros(k, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), batch.column(1).slice(block.first, k), pa.array(W.signed(W.mixed(own.astype(np.uint64)))), zeros, zeros, *(pa.array(x) for x in (many, known, base, total))], names=columns
                )
                doc, key, more = (np.concatenate(x) for x in zip(*asked, strict=True))
                if not len(doc):
                    continue
                order = np.lexsort((key, doc))
                d, key, more = doc[order], key[order], more[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (key[1:] != key[:-1])
                at = np.flatnonzero(new)
                times, after = np.diff(np.append(at, len(d))), np.add.reduceat(more.astype(np.int64), at)
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[d[at]]), pa.nulls(len(at), batch.column(1).type), pa.array(key[at]), pa.array(times.astype(np.int32)), pa.array(after.astype(np.int32)), none, none, pa.nulls(len(at), pa.float64()), pa.nulls(len(at), pa.float64())],
                    names=columns,
                )

    parts = rows.mapInArrow(run, f"row long, doc_id {kind}, key long, times int, after int, n_tokens long, n_known long, base double, score double")
    found = parts.join(tail.select("key", "size", "gain", "fail"), "key", "left")
    token = F.col("size").eqNullSafe(1)
    gain = F.col("times") * F.coalesce("gain", F.lit(0.0))
    fail = F.col("after") * F.coalesce("fail", F.lit(0.0))
    summed = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.lit(0)) + F.when(token, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + F.when(token, gain).otherwise(0.0)).alias("base_score"),
        F.sum(F.coalesce("score", F.lit(0.0)) + gain + fail).alias("score"),
    )
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
