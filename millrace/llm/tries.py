"""The prefix trie of conversations by vertical bitmaps.

Conversations are numbered and cut into chunks of neighbours, positions into bands; a chunk and a band are one shard,
of bounded size however long one conversation is and however many share a beginning. In a shard each (position, turn)
has a bitset of the conversations that hold it. A depth-first search intersects a parent's bitset with the postings of
the next position: the results are its children, their popcounts are members, what ends there is an end list. Nodes of
all shards carry the hash of their whole prefix, by which the shards' counts add up.

Sums over subtrees follow chains: the nodes whose smallest member is c are one run of c's path, hung on a node of a
conversation with a smaller id. Chains are added up by pointer doubling, in as many rounds as the logarithm of their
nesting, and along a chain by running sums; no step walks the trie level by level.

Turns are told apart by 128 bits of hash, and so are prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordering import positions
from millrace.session import durable

#: Conversations and positions of a shard.
CHUNK, BAND = 1024, 64
#: Rows of a group that a running total adds up in one task.
BLOCK = 4096


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn_hash, points) of ``turns`` (conv_id, turn, role, text).

    Places run from 0 by turn, null first; turns of equal number go by hash. Null roles and texts are empty ones. Rows
    without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    known = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", known.alias("turn_hash"), F.length(text).cast("long").alias("points"))
    return positions(durable(rows, "turns"), ["turn", "turn_hash"], within=["conv_id"], name="place").drop("turn")


def grafted(turns: DataFrame, base: Column, share: Column, most: int) -> DataFrame:
    """Conversations rebuilt: the first ``share`` turns of conversation ``base``, then the own turns after as many.

    ``base`` and ``share`` are expressions on conv_id, ``share`` at most ``most``. A base that is not there gives no turns.
    The result (conv_id, depth, turn_hash, points) has depths from 1, and a turn of depth 0, empty and without a hash, for
    each conversation, turnless ones too.
    """
    ids = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), share.cast("long").alias("share"))
    heads = turns.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "turn_hash", "points")
    held = heads.groupBy("base").agg(F.count("*").alias("held"))
    starts = durable(ids.join(held, "base", "left").withColumn("taken", F.least("share", F.coalesce("held", F.lit(0)))), "starts")
    first = starts.join(heads, "base").where("place < share").select("conv_id", (F.col("place") + 1).alias("depth"), "turn_hash", "points")
    own = turns.join(starts.select("conv_id", "share", "taken"), "conv_id").where("place >= share")
    own = own.select("conv_id", (F.col("place") - F.col("share") + F.col("taken") + 1).alias("depth"), "turn_hash", "points")
    top = starts.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("turn_hash"), F.lit(0).cast("long").alias("points"))
    return durable(top.unionByName(first).unionByName(own), "paths")


def running(rows: DataFrame, within: str, at: str, columns: Sequence[str], total: Callable, join: Callable, down: bool = False) -> DataFrame:
    """``rows`` with ``upto_`` columns: the total of a column over the rows of the group up to and with this one.

    ``at`` numbers the rows of a group without large gaps; ``down`` goes from the highest to the lowest. A task adds up
    blocks of ``BLOCK`` rows, and one row per block of a group is left to go on from.
    """
    way = (lambda c: F.col(c).desc()) if down else F.col
    rows = rows.withColumn("__block", F.floor(F.col(at) / BLOCK).cast("long"))
    earlier = Window.partitionBy(within).orderBy(way("__block")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(within, "__block").orderBy(way(at)).rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy(within, "__block").agg(*(total(c).alias(f"__{c}") for c in columns))
    blocks = blocks.select(within, "__block", *(F.coalesce(total(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in columns))
    sums = rows.select("*", *(total(c).over(inside).alias(f"__in_{c}") for c in columns)).join(blocks, [within, "__block"])
    return sums.select(*(c for c in rows.columns if c != "__block"), *(join(F.col(f"__{c}"), F.col(f"__in_{c}")).alias(f"upto_{c}") for c in columns))


_LOCAL = "a long, b long, up_a long, up_b long, depth long, n_convs long, conv_id long, points long, chunk long, ends string"


def _shard(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The nodes of a shard, from its vertical bitmaps."""
    low = int(rows["depth"].min()) // BAND * BAND
    convs, bit = np.unique(rows["conv_id"].to_numpy(np.int64), return_inverse=True)  # ascending, so the lowest bit is the smallest member
    depth = rows["depth"].to_numpy(np.int64)
    hashes, code = np.unique(rows[["a", "b"]].to_numpy(np.int64), axis=0, return_inverse=True)
    code = code.reshape(-1)
    turn_at = np.full((len(convs), BAND + 1), -1, np.int64)
    turn_at[bit, depth - low] = code
    points = np.zeros(len(hashes), np.int64)
    points[code] = rows["points"].to_numpy(np.int64)
    postings, held, ended = [0] * len(hashes), [0] * (BAND + 1), [0] * (BAND + 1)
    classes: dict[tuple[int, int], int] = {}
    last = rows["last"].to_numpy(np.int64)
    for i, c, d, a0, b0, end in zip(bit.tolist(), code.tolist(), (depth - low).tolist(), rows["a0"].tolist(), rows["b0"].tolist(), (last == depth).tolist()):
        one = 1 << i
        postings[c] |= one
        held[d] |= one
        if end:
            ended[d] |= one
        if d == 0:
            classes[a0, b0] = classes.get((a0, b0), 0) | one
    keys, texts = hashes.tolist(), convs.tolist()
    stack = [(members, a, b, 0) for (a, b), members in classes.items()]
    found = []
    while stack:
        members, a, b, d = stack.pop()
        rest = members & held[d]
        while rest:
            first = (rest & -rest).bit_length() - 1
            turn = int(turn_at[first, d])
            child = members & postings[turn]
            rest &= ~child
            ends, names = child & ended[d], []
            while ends:
                e = (ends & -ends).bit_length() - 1
                names.append(str(texts[e]))
                ends &= ends - 1
            key = (a ^ keys[turn][0], b ^ keys[turn][1])
            found.append((*key, a, b, low + d, child.bit_count(), texts[first], int(points[turn]), ",".join(names) or None))
            stack.append((child, *key, d + 1))
    chunk = int(rows["chunk"].iloc[0])
    for i in range(0, len(found), 10_000):
        part = found[i : i + 10_000]
        yield pd.DataFrame([(*f[:8], chunk, f[8]) for f in part], columns=[x.split()[0] for x in _LOCAL.split(", ")])


def _streamed_hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's end lists, one after the other, in the order they come; only the running hash is held."""
    at, state = None, None
    for batch in batches:
        done = []
        for a, b, ends in zip(batch["a"].tolist(), batch["b"].tolist(), batch["ends"].tolist()):
            if (a, b) == at:
                state.update(b"," + ends.encode())
            else:
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (a, b), hashlib.sha256(ends.encode())
        yield pd.DataFrame(done, columns=["a", "b", "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(*at, state.hexdigest())], columns=["a", "b", "ends_sha256"])


def _nodes(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes (a, b, up_a, up_b, depth, n_convs, conv_id, points), and end lists (a, b, chunk, ends), stored."""
    lengths = paths.groupBy("conv_id").agg(F.max("depth").alias("last"))
    convs = positions(durable(lengths, "lengths"), ["conv_id"], name="number")
    chunk = F.floor(F.col("number") / CHUNK).cast("long")
    rows = paths.join(convs.select("conv_id", "last", chunk.alias("chunk")), "conv_id")
    rows = rows.select(
        "conv_id", "depth", "points", "last", "chunk", F.floor(F.col("depth") / BAND).cast("long").alias("band"),
        F.xxhash64("depth", "turn_hash").alias("a"), F.xxhash64("turn_hash", "depth", F.lit("prefix")).alias("b"),
    )
    totals = rows.where(F.col("last") >= BAND).groupBy("conv_id", "band").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    sums = running(totals, "conv_id", "band", ["a", "b"], F.bit_xor, lambda x, y: x.bitwiseXOR(y))
    starts = sums.select("conv_id", (F.col("band") + 1).alias("band"), F.col("upto_a").alias("a0"), F.col("upto_b").alias("b0"))
    started = rows.join(starts, ["conv_id", "band"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("a0", "b0")})

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(_shard(pdf)))

    local = durable(started.groupBy("band", "chunk").applyInPandas(shard, _LOCAL), "local-nodes")
    merged = local.groupBy("a", "b").agg(
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("points").alias("points"),
    )
    return durable(merged, "nodes"), local.where("ends IS NOT NULL").select("a", "b", "chunk", "ends")


def _chain_totals(chains: DataFrame) -> DataFrame:
    """Chains (conv_id, up, leaves, saved) with the sums of all chains hung below, by pointer doubling.

    After k rounds a chain holds the sums of those less than 2^k below it and points to the one 2^k above.
    """
    chains = durable(chains, "chains")
    while chains.where("up IS NOT NULL").limit(1).count():
        given = chains.where("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = chains.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        summed = chains.join(above, "up", "left").join(given.withColumnRenamed("up", "conv_id"), "conv_id", "left")
        chains = durable(summed.select(
            "conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        ), "chains")
    return chains


def trie(paths: DataFrame) -> DataFrame:
    """A row per node of the trie of ``paths`` (conv_id, depth from 0, turn_hash, points).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member, the
    parent's, members, children, childless nodes at or below, what sharing saves there (members but one times code points
    of the last turn, summed), and the digest of the ids that end here, ascending. Equal conversations share all nodes; a
    conversation may hold any share of the rows; no conversations, no nodes.
    """
    nodes, ends = _nodes(paths)
    children = nodes.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    own = durable(
        nodes.join(children, ["a", "b"], "left").join(parents, ["up_a", "up_b"], "left").select(
            "a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"),
        ),
        "own",
    )
    tops = own.groupBy("conv_id").agg(
        F.min_by("parent_conv_id", "depth").alias("up"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("depth").alias("top")
    )
    tops = durable(tops, "tops")
    totals = _chain_totals(tops.drop("top")).select("conv_id", "leaves", "saved")
    hung = totals.join(tops.where("up IS NOT NULL").select("conv_id", "up", "top"), "conv_id").groupBy(
        F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth")
    ).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    here = own.join(hung, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"hung_{c}", F.lit(0)) for c in ("leaves", "saved")})
    summed = running(here.drop("hung_leaves", "hung_saved"), "conv_id", "depth", ["leaves", "saved"], F.sum, lambda x, y: x + y, down=True)
    lists = ends.repartition("a", "b").sortWithinPartitions("a", "b", "chunk").select("a", "b", "ends")
    hashed = lists.mapInPandas(_streamed_hash, "a long, b long, ends_sha256 string")
    return summed.join(hashed, ["a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("upto_leaves").alias("n_leaves"), F.col("upto_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
