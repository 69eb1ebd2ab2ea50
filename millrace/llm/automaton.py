"""Scoring a corpus by the weighted backoff automaton learnt from part of it, block by block.

Texts are cut into blocks of some million tokens, which are stored once, as token codes. A block asks for each of its
distinct n-grams once: sorted 64-bit keys, as compressed differences, go to the bucket of their range, which adds up the
training counts of all blocks and answers each of them. In the same way the blocks learn what the arcs of each history
take in all. Then every block has the part of the automaton that its texts can reach: a state for each history seen twice
or more (a token, a pair), arcs with interpolated probabilities (absolute discounting), and failure arcs at the weight
that arcs left over, to the history without its first token; the root reads any token. The texts of a block are walked
from left to right, all at the same time: each carries its state, follows an arc or fails until it can, and adds up
logarithms.

Nothing is pruned but n-grams of fewer than ``LEAST`` training occurrences, at any size. Keys are hashes, so buckets are
even whatever tokens are frequent; a bucket holds about ``BUCKET_KEYS`` keys, a block ``BLOCK_TOKENS`` tokens or one text.
Shuffles are removed as soon as a stored table has replaced them, so the disk holds one exchange at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.backoff import DISCOUNT, tokens
from millrace.session import durable, session_conf

LEAST = 2
BLOCK_TOKENS = 1 << 21
BUCKET_KEYS = 3 << 19
#: Bytes of text whose words are cut at a time.
_PIECE = W.BLOCK_BYTES


# --- compressed columns of numbers ----------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(blob, n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(blob, n, np.uint64), dtype=np.uint64)


def spans(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of the buckets that sorted keys fall into."""
    if len(keys):
        bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(bucket[a]), slice(a, b)


# --- a block --------------------------------------------------------------------------------


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct whole numbers from 0 on, sorted, and each one's number among them.

    Key and place are sorted as one number where both fit: that takes neither an index nor a second copy.
    """
    n = len(keys)
    bits = n.bit_length()
    if not n or int(keys.max()).bit_length() + bits > 63:
        known, number = np.unique(keys, return_inverse=True)
        return known, number.astype(np.int32)
    both = (keys << bits) | np.arange(n)
    both.sort()
    at = both & ((1 << bits) - 1)
    both >>= bits
    new = np.ones(n, bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    number = np.empty(n, np.int32)
    number[at] = np.cumsum(new, dtype=np.int32) - 1
    return both[new], number


def _tagged(h: np.ndarray, order: int) -> np.ndarray:
    """The key of an n-gram; its two lowest bits are the order."""
    return h & ~np.uint64(3) | np.uint64(order)


class Block:
    """Texts as codes of tokens, and their distinct n-grams; n-gram numbers go tokens, pairs, triples.

    ``code``, ``pair`` and ``triple`` number, at each position, the token there and the pair and triple ending there (-1
    where the text is too short). ``keys`` are those of all n-grams and ``order`` sorts them.
    """

    def __init__(self, lengths: np.ndarray, hashes: np.ndarray, code: np.ndarray):
        self.lengths, self.code = lengths, code.astype(np.int32)
        v, n = max(1, len(hashes)), len(code)
        starts = np.zeros(n + 1, bool)
        starts[np.cumsum(lengths)] = starts[:1] = True
        at = np.flatnonzero(~starts[:-1])
        pairs, number = _distinct(self.code[at - 1] * np.int64(v) + self.code[at])
        self.pair = np.full(n, -1, np.int32)
        self.pair[at] = number
        self.first, second = (pairs // v).astype(np.int32), (pairs % v).astype(np.int32)
        at = np.flatnonzero((self.pair[1:] >= 0) & (self.pair[:-1] >= 0)) + 1
        triples, number = _distinct(self.pair[at - 1] * np.int64(v) + self.code[at])
        self.triple = np.full(n, -1, np.int32)
        self.triple[at] = number
        self.context, third = (triples // v).astype(np.int32), (triples % v).astype(np.int32)
        self.second, self.tail = second, np.zeros(len(triples), np.int32)
        self.tail[number] = self.pair[at]
        self.sizes = (len(hashes), len(pairs), len(triples))
        two = W.mixed(W.mixed(hashes[self.first]) * W.MULTIPLIER + hashes[second])
        three = W.mixed(W.mixed(two[self.context]) * W.MULTIPLIER + hashes[third])
        self.keys = np.concatenate([_tagged(h, i + 1) for i, h in enumerate((hashes, two, three))])
        self.order = np.argsort(self.keys).astype(np.int32)
        # Workers live on: what Arrow holds of former blocks would add up beside the next.
        pa.default_memory_pool().release_unused()

    def parts(self, values: np.ndarray) -> list[np.ndarray]:
        """Values of all n-grams as those of tokens, pairs and triples."""
        return np.split(values, np.cumsum(self.sizes)[:-1])

    def counts(self, training: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in the texts marked."""
        here = np.repeat(training, self.lengths)
        return np.concatenate([np.bincount(x[here & (x >= 0)], minlength=k).astype(np.uint32) for x, k in zip((self.code, self.pair, self.triple), self.sizes)])

    def answered(self, values: np.ndarray) -> np.ndarray:
        """Values given in the order of sorted keys, by n-gram."""
        out = np.empty(len(self.keys), values.dtype)
        out[self.order] = values
        return out

    def contexts(self, n: np.ndarray, least: int) -> np.ndarray:
        """Numbers of the histories that are states, in the order of their keys."""
        return self.order[(self.order < self.sizes[0] + self.sizes[1]) & (n[self.order] >= least)]


_BLOCK = "block long, n_tokens long, n_training long, ids array<{kind}>, training array<boolean>, lengths array<int>, n_hashes int, hashes binary, codes binary"


def _blocks(docs: DataFrame, training: Column) -> DataFrame:
    """All texts in blocks, a row each: ids, lengths in tokens, distinct token hashes by frequency, and codes."""
    rows = docs.select("doc_id", F.coalesce(training, F.lit(False)).alias("training"), "text")
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, marks, lengths, hashes = [], [], [], []

        def out() -> pa.RecordBatch:
            nonlocal number, ids, marks, lengths, hashes
            length, mark = np.concatenate(lengths), pa.concat_arrays(marks)
            every, hashes = np.concatenate(hashes).view(np.uint64), []
            known, code = np.unique(every, return_inverse=True)
            by_count = np.argsort(-np.bincount(code), kind="stable")
            rank = np.empty(len(known), np.uint32)
            rank[by_count] = np.arange(len(known), dtype=np.uint32)
            seen = int(length[mark.to_numpy(zero_copy_only=False)].sum())
            one = pa.array([0, len(length)], pa.int32())
            columns = [
                pa.array([number]), pa.array([len(code)]), pa.array([seen]), pa.ListArray.from_arrays(one, pa.concat_arrays(ids)), pa.ListArray.from_arrays(one, mark),
                pa.array([length.astype(np.int32)]), pa.array([len(known)], pa.int32()), pa.array([pack(known[by_count])], pa.binary()), pa.array([pack(rank[code])], pa.binary()),
            ]
            number, ids, marks, lengths, hashes = number + 1, [], [], [], []
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            for piece in W.blocks(batch.column(2), _PIECE):
                k = piece.last - piece.first
                doc, h = tokens(piece)
                ids.append(batch.column(0).slice(piece.first, k))
                marks.append(batch.column(1).slice(piece.first, k))
                lengths.append(np.bincount(doc, minlength=k))
                hashes.append(h)
                if sum(map(len, hashes)) >= BLOCK_TOKENS:
                    yield out()
        if ids:
            yield out()

    return rows.mapInArrow(run, _BLOCK.format(kind=kind.simpleString()))


def _read(rows: pa.Table | pa.RecordBatch, i: int) -> tuple[Block, np.ndarray]:
    """The block of a row, and which texts are for training."""
    cell = {name: rows.column(name)[i] for name in ("lengths", "training", "n_hashes", "hashes", "codes")}
    lengths = cell["lengths"].values.to_numpy().astype(np.int64)
    hashes = unpack(cell["hashes"].as_py(), cell["n_hashes"].as_py(), np.uint64)
    return Block(lengths, hashes, unpack(cell["codes"].as_py(), int(lengths.sum()), np.uint32)), cell["training"].values.to_numpy(zero_copy_only=False)


# --- asking and answering -------------------------------------------------------------------

_ASK = "bucket long, block long, size int, keys binary, x binary, y binary"
_ANSWER = "block long, bucket long, kind int, size int, x binary, y binary, n_distinct long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _table(rows: list[tuple], names: str) -> pa.Table:
    schema = pa.schema([(n, _KINDS[t]) for n, t in (x.split() for x in names.split(", "))])
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def _united(asked: pa.Table) -> tuple[list[dict], list[slice], np.ndarray, np.ndarray]:
    """The asks of a bucket: rows by block, where each row's keys lie in all of them, distinct keys, and each one's number."""
    rows = sorted(asked.to_pylist(), key=lambda r: r["block"])
    ends = np.cumsum([0, *(r["size"] for r in rows)])
    keys, number = np.unique(np.concatenate([unpack_sorted(r["keys"], r["size"]) for r in rows]), return_inverse=True)
    return rows, [slice(a, b) for a, b in zip(ends[:-1], ends[1:])], keys, number


def _count(asked: pa.Table) -> pa.Table:
    """Training counts of a bucket's keys over all blocks; pairs and triples below ``LEAST`` as 0.

    ``y`` marks the keys that a block is the first to ask for: it alone adds them to their histories.
    """
    rows, parts, keys, number = _united(asked)
    given = np.concatenate([unpack(r["x"], r["size"], np.uint32) for r in rows])
    total = np.bincount(number, given, minlength=len(keys)).astype(np.uint64)
    token = keys & np.uint64(3) == 1
    distinct = int((token & (total > 0)).sum())
    total[~token & (total < LEAST)] = 0
    owner = np.empty(len(keys), np.int64)
    owner[number[::-1]] = np.arange(len(number))[::-1]
    mine = owner[number] == np.arange(len(number))
    out = [(r["block"], r["bucket"], 0, r["size"], pack(total[number[p]]), pack(np.packbits(mine[p])), distinct if i == 0 else 0) for i, (r, p) in enumerate(zip(rows, parts))]
    return _table(out, _ANSWER)


def _take(asked: pa.Table) -> pa.Table:
    """What the arcs of a bucket's histories take: the sum and the number of their counts over all blocks."""
    rows, parts, keys, number = _united(asked)
    sums = [np.bincount(number, np.concatenate([unpack(r[c], r["size"], np.uint64) for r in rows]), minlength=len(keys)).astype(np.uint64)[number] for c in "xy"]
    return _table([(r["block"], r["bucket"], 1, r["size"], pack(sums[0][p]), pack(sums[1][p]), 0) for r, p in zip(rows, parts)], _ANSWER)


def _given(answers: pa.Table, kind: int) -> list[dict]:
    return sorted((r for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])


def _numbers(block: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a block's n-grams, and which of them it owns."""
    rows = _given(answers, 0)
    n = np.concatenate([unpack(r["x"], r["size"], np.uint64) for r in rows])
    mine = np.concatenate([np.unpackbits(unpack(r["y"], (r["size"] + 7) // 8, np.uint8), count=r["size"]) for r in rows]).astype(bool)
    return block.answered(n.view(np.int64)), block.answered(mine)


# --- the automaton of a block ---------------------------------------------------------------


def walk(block: Block, n: np.ndarray, left: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_known, base, score) of the block's texts.

    ``n`` are counts by n-gram, ``left`` what the arcs of each token and pair leave; ``unit`` is the root's denominator.
    """
    ones, twos, threes = block.parts(n)
    left1, left2 = left[: block.sizes[0]], left[block.sizes[0] :]
    p1 = (ones + 0.5) / unit
    state1, arc2, arc3 = ones >= LEAST, twos >= LEAST, threes >= LEAST
    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = np.where(state1[block.first], left1[block.first], 1.0) * p1[block.second]
        p2 += np.where(arc2, (twos - DISCOUNT) / ones[block.first], 0.0)
        p3 = np.where(arc3, (threes - DISCOUNT) / twos[block.context] + left2[block.context] * p2[block.tail], 1.0)
    # One more at the end, for the number -1 of where no pair or triple ends.
    read2, read3, fail2 = (np.append(np.log10(x), 0.0) for x in (p2, p3, left2))
    arc2, arc3, read1, fail1 = np.append(arc2, False), np.append(arc3, False), np.log10(p1), np.log10(left1)

    start = np.concatenate(([0], np.cumsum(block.lengths)[:-1]))
    longest = np.argsort(-block.lengths, kind="stable")
    start, length = start[longest], block.lengths[longest]
    base, score, known = (np.zeros(len(length)) for _ in range(3))
    depth = np.zeros(len(length), np.int64)  # of each text's state: the root, a token, a pair
    for step in range(int(length[0]) if len(length) else 0):
        k = int(np.searchsorted(-length, -step, "left"))  # texts longer than this
        at = start[:k] + step
        token, pair, triple, state = block.code[at], block.pair[at], block.triple[at], depth[:k]
        plain = read1[token]
        gain = plain.copy()
        if step:
            # From a pair: its arc, or fail to the last token. From a token: its arc, or fail to the root.
            fall = np.where(state == 2, fail2[block.pair[at - 1]], 0.0)
            by3 = (state == 2) & arc3[triple]
            by2 = ~by3 & (state >= 1) & arc2[pair]
            before = block.code[at - 1]
            gain = np.where(by3, read3[triple], np.where(by2, read2[pair], plain + np.where(state >= 1, fail1[before], 0.0)) + np.where(by3, 0.0, fall))
            depth[:k] = np.where(arc2[pair], 2, state1[token])
        else:
            depth[:k] = state1[token]
        score[:k] += gain
        base[:k] += plain
        known[:k] += ones[token] > 0
    out = [np.empty(len(length)) for _ in range(3)]
    for values, where in zip((known, base, score), out):
        where[longest] = values
    return out[0].astype(np.int64), out[1], out[2]


def learn_and_score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    The automaton is learnt from the rows where ``training`` holds (null: does not). base_score sums
    log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, the end included; score is the log10 probability of the text. A
    null text is an empty one (its end alone). Repeated rows count, and have a result each. With nothing learnt every
    token is unknown, at probability 1 of the one unseen token. No rows give none; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def stored(df: DataFrame, label: str) -> DataFrame:
        with session_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            return durable(df, label)

    blocks = stored(_blocks(docs, training), "blocks")
    n_tokens, total = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_training"), F.lit(0))).first()
    # A token brings one and a half keys or so: itself, a pair and a triple, less those that a block has already.
    buckets = max(1, -(-3 * n_tokens // (2 * BUCKET_KEYS)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, marks = _read(batch, i)
                number = batch.column("block")[i].as_py()
                keys, n = block.keys[block.order], block.counts(marks)[block.order]
                for bucket, p in spans(keys, buckets):
                    yield from _table([(bucket, number, p.stop - p.start, pack_sorted(keys[p]), pack(n[p]), None)], _ASK).to_batches()

    counted = stored(blocks.mapInArrow(ask, _ASK).groupBy("bucket").applyInArrow(_count, _ANSWER), "counts")
    distinct = counted.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]

    def histories(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block, _ = _read(rows, 0)
        n, mine = _numbers(block, answers)
        two, three = ((x >= LEAST) & own for x, own in list(zip(block.parts(n), block.parts(mine)))[1:])
        _, n2, n3 = block.parts(n)
        sums = np.concatenate([np.bincount(block.first[two], n2[two], minlength=block.sizes[0]), np.bincount(block.context[three], n3[three], minlength=block.sizes[1])]).astype(np.uint64)
        arcs = np.concatenate([np.bincount(block.first[two], minlength=block.sizes[0]), np.bincount(block.context[three], minlength=block.sizes[1])]).astype(np.uint64)
        states = block.contexts(n, LEAST)
        keys, number = block.keys[states], rows.column("block")[0].as_py()
        return _table([(bucket, number, p.stop - p.start, pack_sorted(keys[p]), pack(sums[states[p]]), pack(arcs[states[p]])) for bucket, p in spans(keys, buckets)], _ASK)

    asked = blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(histories, _ASK)
    taken = stored(asked.groupBy("bucket").applyInArrow(_take, _ANSWER), "histories")
    unit = float(total) + 0.5 * (distinct + 1)
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block, _ = _read(rows, 0)
        n = _numbers(block, answers)[0]
        left, states, back = np.ones(block.sizes[0] + block.sizes[1]), block.contexts(n, LEAST), _given(answers, 1)
        block.keys = block.order = answers = None  # not needed any more, and of the largest arrays
        if len(states):
            sums, arcs = (np.concatenate([unpack(r[c], r["size"], np.uint64) for r in back]) for c in "xy")
            left[states] = 1 - (sums - DISCOUNT * arcs) / n[states]
        known, base, total_log = walk(block, n, left, unit)
        ids = rows.column("ids").chunk(0).flatten()
        return pa.Table.from_arrays([ids, pa.array(block.lengths), pa.array(known), pa.array(np.full(len(known), total)), pa.array(base), pa.array(total_log)], names=names)

    answers = counted.unionByName(taken)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
