"""Passages repeated across documents, with small changes: seeds, collinear chains, alignment.

Seeds are winnowed runs of SEED words (any SEED + WINDOW - 1 words that two texts share give a common seed).
All occurrences of a seed are joined with the one in the document of the smallest key, so a passage in a third
of all documents costs one anchor per document, not one per pair. Each pair of documents then has a list of
anchors (position, other position), no longer than the text; chaining picks ordered anchors whose total length
less a linear gap cost is largest, by a Fenwick tree of prefix maxima. Chains are cut at long gaps, widened to
both sides and aligned word by word between their anchors; what is long and similar enough is a passage.

The document of the smallest key may hold only a part of a passage that two others share. So a second round
takes the seeds that no passage covers, two at a time, NEAR to FAR words apart, and joins on both: those who
hold such a pair hold its whole stretch, and their smallest key is a partner that a part of it cannot displace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.tables import in_bitmap, key_bitmap, text_hash
from millrace.session import durable, forget, session_conf

SEED, WINDOW = 6, 8
LEAST_WORDS, IDENTITY = 50, 0.8
GAP_COST, LONGEST_GAP, MARGIN = 0.05, 40, 60
LEAST_ANCHORS = 2
#: Distances of two seeds that are looked up together: what 50 words have at both ends, and what a chain may skip.
NEAR, FAR = 30, LONGEST_GAP + SEED
#: Places that a task takes at a time, and bytes of stored anchors that one task chains: many seconds of work.
PLACES, CHAIN_BYTES = 200_000, "8m"
KEY_BITS = 24


def key():
    return F.xxhash64("doc_id", text_hash(F.col("text")))


def seeds(docs: DataFrame) -> DataFrame:
    """(key, seed, at) of each kept run of words, and one row (seed null) with the number of words per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for block in W.blocks(batch.column(1)):
                words = W.split(block)
                at, h = W.winnow(words, SEED, WINDOW)
                doc = words.doc[at]
                own = keys[block.first : block.last][doc]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(W.signed(h)), pa.array((at - words.first[doc]).astype(np.int32))], names=["key", "seed", "at"])

    return docs.select(key().alias("key"), "text").mapInArrow(run, "key long, seed long, at int")


def _gathered(linked: DataFrame) -> DataFrame:
    """(key, other, anchors) from single anchors (key, at, other, there); ``other`` becomes the smaller key."""
    turned = F.col("key") < F.col("other")
    sides = [F.when(turned, a).otherwise(F.col(b)).alias(b) for a, b in ((F.col("other"), "key"), (F.col("there"), "at"), (F.col("key"), "other"), (F.col("at"), "there"))]
    return linked.select(*sides).groupBy("key", "other").agg(F.collect_set(F.struct("at", "there")).alias("anchors"))


def anchors(found: DataFrame) -> DataFrame:
    """(key, other, anchors) of pairs of documents with seeds in common, each seed met in one partner.

    That is its place in the document of the smallest key that holds it, the first one there; further places in
    that document meet the last place in the document of the largest key.
    """
    place = F.struct("key", "at")
    ends = found.groupBy("seed").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first.key < last.key")
    joined = found.join(ends, "seed").where("key <> first.key or at <> first.at")
    partner = F.when(F.col("key") != F.col("first.key"), F.col("first")).otherwise(F.col("last"))
    return _gathered(joined.select("key", "at", partner["key"].alias("other"), partner["at"].alias("there")))


def places(pairs: DataFrame) -> DataFrame:
    """(key, places): for each document of ``pairs`` (stored) the places of shared seeds, in order, each with a number
    of its seed: a hash of where the partner has it. The lists are no longer than the texts."""
    one = pairs.select("key", "other", F.explode("anchors").alias("a")).select("key", "a.at", "other", "a.there", F.xxhash64("other", "a.there").alias("seed"))
    both = one.select("key", "at", "seed").unionByName(one.select(F.col("other").alias("key"), F.col("there").alias("at"), "seed"))
    return both.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "seed"))).alias("places"))


def paired(held: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """(pair, key, at, to, asks) of two shared seeds of a text, NEAR to FAR words apart.

    ``held`` has key, places and spans (start, stop; sorted and disjoint, or null), which are the found passages. A
    pair asks if one of its seeds is outside of them. With a bitmap of asked pairs, those that it lets through come
    as well; without, only those that ask. Where a text repeats itself, a pair asks once in NEAR words, which the margins
    of its candidate exceed, and answers once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(batch.column(1).offsets.to_numpy())
            parts = np.cumsum(counts) // PLACES
            for part in np.unique(parts):
                yield from block(batch.slice(int(np.searchsorted(parts, part)), int((parts == part).sum())))

    def block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, lists, spans = batch.columns
        number = np.arange(batch.num_rows, dtype=np.int64) << 32  # texts one behind the other
        flat, covers = lists.flatten(), spans.flatten()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        at, seed = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().view(np.uint64)
        whose = np.repeat(number, spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        place = at + number[doc]
        starts, stops = (whose + covers.field(i).to_numpy() for i in (0, 1))
        cover = np.searchsorted(starts, place, "right") - 1
        found = (cover >= 0) & (place + SEED <= np.append(stops, 0)[cover])
        lo, hi = np.searchsorted(place, place + NEAR), np.searchsorted(place, place + FAR, "right")
        a = np.repeat(np.arange(len(place)), hi - lo)
        b = np.arange(len(a)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[a]
        asks = ~(found[a] & found[b])
        pair = W.signed(W.mixed(seed[a] * W.MULTIPLIER + seed[b]))
        chosen = np.flatnonzero(asks if asked is None else asks | in_bitmap(asked, pair))
        stretch = number[doc[a[chosen]]] + np.where(asks[chosen], at[a[chosen]] // NEAR + 1, 0)
        chosen = chosen[np.sort(np.unique(W.mixed(pair[chosen].view(np.uint64) ^ W.mixed(stretch.view(np.uint64))), return_index=True)[1])]
        a, b = a[chosen], b[chosen]
        own = keys.take(pa.array(doc[a]))
        yield pa.RecordBatch.from_arrays([pa.array(pair[chosen]), own, pa.array(at[a].astype(np.int32)), pa.array(at[b].astype(np.int32)), pa.array(asks[chosen])], names=["pair", "key", "at", "to", "asks"])

    return held.select("key", "places", "spans").mapInArrow(run, "pair long, key long, at int, to int, asks boolean")


def bridges(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(key, other, anchors) of documents that share two seeds NEAR to FAR words apart which no passage of ``found`` covers
    in one of them. Both tables are stored.

    As in ``anchors`` each such pair of seeds is met in the document of the smallest key that holds it, and from
    there in that of the largest key. Only pairs of seeds that somebody asks for, by a bitmap of a fixed size, are shuffled.
    """
    sides = found.select("key", "start", "stop").unionByName(found.select(F.col("other").alias("key"), F.col("other_start").alias("start"), F.col("other_stop").alias("stop")))
    spans = sides.groupBy("key").agg(_merged(F.array_sort(F.collect_set(F.struct("start", "stop")))).alias("spans"))
    held = durable(places(pairs).join(spans, "key", "left"), "places")
    stored = durable(paired(held, key_bitmap(paired(held), "pair")), "paired")
    place = F.struct("key", "at", "to")
    ends = stored.groupBy("pair").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first.key < last.key")
    joined = stored.where("asks").join(ends, "pair")
    partner = F.when(F.col("key") != F.col("first.key"), F.col("first")).otherwise(F.col("last"))
    both = F.array(F.struct(F.col("at"), partner["at"].alias("there")), F.struct(F.col("to").alias("at"), partner["to"].alias("there")))
    single = joined.select("key", partner["key"].alias("other"), F.explode(both).alias("a")).select("key", "a.at", "other", "a.there")
    out = durable(_gathered(single), "bridges")
    forget(held), forget(stored)
    return out


class Fenwick:
    """Largest (value, index) over prefixes; of equal values the larger index."""

    def __init__(self, n: int):
        self.best, self.index = [-np.inf] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, index: int) -> None:
        best, own = self.best, self.index
        i += 1
        while i < len(best):
            if value > best[i] or (value == best[i] and index > own[i]):
                best[i], own[i] = value, index
            i += i & -i

    def before(self, i: int) -> tuple[float, int]:
        """Over places below i."""
        best, own = self.best, self.index
        value, index = -np.inf, -1
        while i:
            if best[i] > value or (best[i] == value and own[i] > index):
                value, index = best[i], own[i]
            i -= i & -i
        return value, index


def _linked(at: list[int], there: list[int], rank: list[int] | None, seed: int, gap_cost: float) -> tuple[list[float], list[int]]:
    """Score and prior anchor of each anchor; anchors come in order of (at, there).

    Without ranks both places rise all the way. The best prior anchor is then the one before: what the tree would hold
    for it is what it holds for the earlier ones and at least one more word.
    """
    n = len(at)
    score, back = [float(seed)] * n, [-1] * n
    cost = [gap_cost * (a + t) for a, t in zip(at, there, strict=True)]
    if rank is None:
        for i in range(1, n):
            gain = score[i - 1] + cost[i - 1] - cost[i]
            if gain > 0:
                score[i], back[i] = gain + min(seed, at[i] - at[i - 1], there[i] - there[i - 1]), i - 1
        return score, back
    tree = Fenwick(max(rank) + 1)
    i = 0
    while i < n:
        j = i
        while j < n and at[j] == at[i]:
            value, prior = tree.before(rank[j])
            gain = value - cost[j]
            if prior >= 0 and gain > 0:
                score[j], back[j] = gain + min(seed, at[j] - at[prior], there[j] - there[prior]), prior  # words not yet counted
            j += 1
        for x in range(i, j):  # anchors of one place must not follow each other
            tree.put(rank[x], score[x] + cost[x], x)
        i = j
    return score, back


def chains(at: np.ndarray, there: np.ndarray, seed: int = SEED, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Disjoint chains of anchors (indices), best first: both places rise along a chain.

    A link costs ``gap_cost`` per word skipped in either text, at which score + cost * (at + there) can be kept as a
    prefix maximum over ``there`` while anchors come in order of ``at``. Anchors that rise in both texts as they come,
    as those of a plain copy do, need no tree.
    """
    if not len(at):
        return []
    order = np.lexsort((there, at))
    a, t = at[order], there[order]
    rising = bool((a[1:] > a[:-1]).all() and (t[1:] > t[:-1]).all())
    rank = None if rising else np.unique(t, return_inverse=True)[1].tolist()
    sorted_score, prior = _linked(a.tolist(), t.tolist(), rank, seed, gap_cost)
    score = np.empty(len(at))
    score[order] = sorted_score
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    names, used = order.tolist(), [False] * len(at)
    out = []
    for end in place[np.argsort(-score, kind="stable")].tolist():
        chain, x = [], end
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(names[x])
            x = prior[x]
        if chain:
            out.append(chain[::-1])
    return out


def pieces_of(chain: list[int], at: np.ndarray, there: np.ndarray, longest: int = LONGEST_GAP) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """(start, stop, other start, other stop, anchors) of a chain cut where either text has a long gap."""
    begin = 0
    for i in range(1, len(chain) + 1):
        if i == len(chain) or max(at[chain[i]] - at[chain[i - 1]], there[chain[i]] - there[chain[i - 1]]) > longest + SEED:
            a, b = chain[begin], chain[i - 1]
            yield int(at[a]), int(at[b]) + SEED, int(there[a]), int(there[b]) + SEED, chain[begin:i]
            begin = i


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in arrays]))), pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))


def candidates(pairs: DataFrame) -> DataFrame:
    """(key, other, start, stop, other_start, other_stop, marks) of the pieces of all chains that margins can make long enough.

    ``marks`` are the piece's anchors, as places after start and after other_start in turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            flat = lists.flatten()
            at, there = (flat.field(i).to_numpy() for i in (0, 1))
            base = offsets[0]
            rows: list[tuple[int, ...]] = []
            marks: list[np.ndarray] = []
            for i in range(batch.num_rows):
                lo, hi = offsets[i] - base, offsets[i + 1] - base
                a, t = at[lo:hi].astype(np.int64), there[lo:hi].astype(np.int64)
                for chain in chains(a, t):
                    if len(chain) >= LEAST_ANCHORS:
                        for *p, own in pieces_of(chain, a, t):
                            if p[1] - p[0] > SEED:
                                rows.append((i, *p))
                                marks.append(np.stack((a[own] - p[0], t[own] - p[2]), axis=1).ravel().astype(np.int32))
            if rows:
                which, *spans = (np.array(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)), *(pa.array(x.astype(np.int32)) for x in spans), lists_of(marks)], names=["key", "other", "start", "stop", "other_start", "other_stop", "marks"])

    return pairs.mapInArrow(run, "key long, other long, start int, stop int, other_start int, other_stop int, marks array<int>")


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, words): word hashes (32 bits) of the documents in ``needed`` (key); the text is read again.

    A bitmap of a fixed 2^24 bits of the keys goes to the tasks; the join settles what it lets through by chance.
    """
    bit = F.shiftrightunsigned("key", 64 - KEY_BITS)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - KEY_BITS}) & 63 as int))")
    rows = needed.select(F.shiftright(bit, 6).alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits")).toPandas()
    packed = np.zeros(1 << (KEY_BITS - 6), np.uint64)
    packed[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - KEY_BITS)).astype(np.int64)
            chosen = np.flatnonzero(packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            if not len(chosen):
                continue
            part = batch.take(pa.array(chosen))
            for block in W.blocks(part.column(1)):
                words = W.split(block)
                lists = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array((words.hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(block.first, block.last - block.first), lists], names=["key", "words"])

    return docs.select(key().alias("key"), "text").mapInArrow(run, "key long, words array<int>").join(needed, "key", "left_semi").dropDuplicates(["key"])


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of word sequences the positions of equal words, in order, in a global alignment of the fewest edits.

    Rows of all pairs are filled at once, in a band around the line from one pair of ends to the other.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(pairs)
    order = sorted((i for i, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda i: -len(pairs[i][0]))
    while order:
        longest = len(pairs[order[0]][0])
        many = max(1, min(256, 4_000_000 // (longest * (2 * band + 8))))
        for i, found in zip(order[:many], _align_group([pairs[i] for i in order[:many]], band), strict=True):
            out[i] = found
        order = order[many:]
    return out


def _align_group(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``align_all`` for a few pairs, those of longer first sequences first."""
    n, m = (np.array([len(p[s]) for p in pairs]) for s in (0, 1))
    width = band + int(np.ceil(m / n).max())
    offsets = np.arange(-width, width + 1)
    a = np.full((len(pairs), n.max()), -1, np.int64)
    b = np.full((len(pairs), m.max() + 1), -2, np.int64)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)], b[i, : len(y)] = x, y
    far = int(n.max() + m.max() + 1)
    cost = np.where((offsets >= 0) & (offsets <= m[:, None]), offsets, far)
    moves = np.full((n.max() + 1, len(pairs), len(offsets)), 2, np.uint8)  # 0 match or change, 1 skip in a, 2 skip in b
    centre = np.zeros(len(pairs), np.int64)
    place = np.arange(len(offsets))
    for i in range(1, int(n.max()) + 1):
        k = int((n >= i).sum())
        before, centre = centre[:k], i * m[:k] // n[:k]
        source = place + (centre - before)[:, None]
        padded = np.concatenate((np.full((k, 1), far), cost[:k], np.full((k, width + 1), far)), axis=1)
        up = np.take_along_axis(padded, source + 1, 1) + 1
        j = centre[:, None] + offsets
        inside = (j >= 1) & (j <= m[:k, None])
        differs = a[:k, i - 1, None] != np.take_along_axis(b[:k], np.clip(j - 1, 0, b.shape[1] - 1), 1)
        diagonal = np.where(inside, np.take_along_axis(padded, source, 1) + differs, far)
        new = np.minimum(diagonal, up)
        outside = (j < 0) | (j > m[:k, None])
        new[outside] = far
        run = np.minimum.accumulate(new - place, axis=1) + place
        moves[i, :k] = np.where(run < new, 2, np.where(diagonal <= up, 0, 1))
        run[outside] = far
        cost = run
    found = []
    for p, (x, y) in enumerate(pairs):
        i, j, left, right = len(x), len(y), [], []
        own = moves[:, p]
        while i and j:
            at = j - i * len(y) // len(x) + width
            move = own[i, at] if 0 <= at < len(offsets) else (1 if at < 0 else 2)
            if move == 0:
                i, j = i - 1, j - 1
                if x[i] == y[j]:
                    left.append(i), right.append(j)
            elif move == 1:
                i -= 1
            else:
                j -= 1
        found.append((np.array(left[::-1], np.int64), np.array(right[::-1], np.int64)))
    return found


def align_between(x: np.ndarray, y: np.ndarray, at: np.ndarray, there: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Runs of equal words (place in x, place in y, length) at the anchors of a chain, and what is between them.

    Gaps are (start, stop in x; start, stop in y), at most LONGEST_GAP and a seed long in both texts, or a margin.
    Where anchors overlap, the later one counts from where the earlier one ends in both texts.
    """
    runs, gaps, i, j = [], [], 0, 0
    for a, t in zip(at.tolist(), there.tolist(), strict=True):
        late = max(i - a, j - t, 0)
        if late >= SEED:
            continue
        a, t = a + late, t + late
        if a > i or t > j:
            gaps.append((i, a, j, t))
        runs.append((a, t, SEED - late))
        i, j = a + SEED - late, t + SEED - late
    gaps.append((i, len(x), j, len(y)))
    return runs, gaps


def align_chains(slices: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (x, y, anchors in x, in y) the positions of equal words, in order: those of the anchors, and in each
    gap between them, before and after them, those of an alignment of the fewest edits."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in slices]
    owner: list[tuple[int, int, int]] = []
    hard: list[tuple[np.ndarray, np.ndarray]] = []
    for s, (x, y, at, there) in enumerate(slices):
        runs, gaps = align_between(x, y, at, there)
        found[s] += [(np.arange(a, a + n), np.arange(t, t + n)) for a, t, n in runs]
        for i, i_end, j, j_end in gaps:
            if i == i_end or j == j_end:
                continue
            p, q = x[i:i_end], y[j:j_end]
            same = np.flatnonzero(p == q) if len(p) == len(q) else None
            if same is not None and len(p) - len(same) <= 1:  # no other alignment has fewer edits
                found[s].append((i + same, j + same))
            else:
                owner.append((s, i, j)), hard.append((p, q))
    band = max((len(q) for _, q in hard), default=0)  # the whole matrix of every gap
    for (s, i, j), (left, right) in zip(owner, align_all(hard, band), strict=True):
        found[s].append((i + left, j + right))
    out = []
    for parts in found:
        left, right = (np.concatenate([p[side] for p in parts] or [np.empty(0, np.int64)]) for side in (0, 1))
        order = np.argsort(left, kind="stable")
        out.append((left[order], right[order]))
    return out


def best_run(left: np.ndarray, right: np.ndarray, identity: float) -> tuple[int, int] | None:
    """First and last of the matched positions with the largest sum: a match counts 1 - identity, a skipped word -identity."""
    if not len(left):
        return None
    skipped = np.maximum(np.diff(left), np.diff(right)) - 1
    total = np.concatenate(([0.0], np.cumsum((1 - identity) - identity * skipped)))
    lowest = np.minimum.accumulate(total)
    end = int((total - lowest).argmax())
    begin = int(np.flatnonzero(total[: end + 1] == lowest[end])[0])
    return begin, end


def _passages(left: np.ndarray, right: np.ndarray, least: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """(start, stop, other start, other stop, identity) of all disjoint best runs of matches that are long and alike enough.

    The best run is taken, then the best ones of what lies before and after it, as long as a part has matches enough.
    """
    out, parts = [], [(0, len(left))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < identity * least:
            continue
        ends = best_run(left[lo:hi], right[lo:hi], identity)
        a, b = lo + ends[0], lo + ends[1]
        sizes = int(left[b] - left[a]) + 1, int(right[b] - right[a]) + 1
        same = (b - a + 1) / max(sizes)
        if min(sizes) >= least and same >= identity:
            out.append((int(left[a]), int(left[b]) + 1, int(right[a]), int(right[b]) + 1, same))
        parts += [(lo, a), (b + 1, hi)]
    return sorted(out)


def aligned(pairs: DataFrame, least: int, identity: float) -> DataFrame:
    """The passages of candidates whose slices are at hand: x from x_from on, y from y_from on.

    The slices face each other at the chain's start. If a passage on that diagonal covers the chain (from
    core_from to core_to in x), nothing was put in or left out; all other candidates are aligned between their
    anchors (marks, from the chain's start), but for slices that have too few words in common to hold a passage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xs, xo), (ys, yo) = ((batch.column(c).flatten().to_numpy(), batch.column(c).offsets.to_numpy() - batch.column(c).offsets[0].as_py()) for c in (2, 4))
            x_from, y_from, core_from, core_to = (batch.column(c).to_numpy() for c in (3, 5, 6, 7))
            rows: list[tuple] = []

            def add(i: int, p: tuple[int, int, int, int, float], rows: list[tuple] = rows, x_from=x_from, y_from=y_from) -> None:
                rows.append((i, int(x_from[i]) + p[0], int(x_from[i]) + p[1], int(y_from[i]) + p[2], int(y_from[i]) + p[3], p[4]))

            hard: list[int] = []
            slices: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            marks, mo = batch.column(8).flatten().to_numpy(), batch.column(8).offsets.to_numpy() - batch.column(8).offsets[0].as_py()
            for i in range(batch.num_rows):
                x, y = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                same = np.flatnonzero(x[: len(y)] == y[: len(x)])
                direct = _passages(same, same, least, identity)
                if any(p[0] <= core_from[i] and p[1] >= core_to[i] for p in direct):
                    for p in direct:
                        add(i, p)
                elif min(len(x), len(y)) >= least and np.isin(x, y).sum() >= identity * least:
                    own = core_from[i] + marks[mo[i] : mo[i + 1]].reshape(-1, 2)
                    hard.append(i), slices.append((x, y, own[:, 0], own[:, 1]))
            for i, (left, right) in zip(hard, align_chains(slices), strict=True):
                for p in _passages(left, right, least, identity):
                    add(i, p)
            if rows:
                which, *spans, same = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)), *(pa.array(s, pa.int32()) for s in spans), pa.array(same)], names=["key", "other", "start", "stop", "other_start", "other_stop", "identity"])

    return pairs.mapInArrow(run, "key long, other long, start int, stop int, other_start int, other_stop int, identity double")


def passages(docs: DataFrame, least: int = LEAST_WORDS, identity: float = IDENTITY) -> DataFrame:
    """(key, other, start, stop, other_start, other_stop, identity) of passages, in words of the two texts.

    ``key`` hashes doc_id and text (rows repeated as a whole are one document); ``other`` is the smaller key. Every
    document that shares a passage has it with some other one, but not with all. Shuffles end with the table that is
    stored from them.
    """
    with session_conf(docs.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        pairs = durable(anchors(seeds(docs)), "anchors")
        found = verified(docs, pairs, least, identity)
        more = bridges(pairs, found)
        again = verified(docs, more, least, identity)
        forget(pairs), forget(more)
    return found.unionByName(again).distinct()


def verified(docs: DataFrame, pairs: DataFrame, least: int = LEAST_WORDS, identity: float = IDENTITY) -> DataFrame:
    """The passages, as of ``passages``, on chains of the anchors in ``pairs`` (stored); a stored table."""
    with session_conf(docs.sparkSession, spark__sql__files__maxPartitionBytes=CHAIN_BYTES):
        pairs = durable(candidates(pairs.where(F.size("anchors") >= LEAST_ANCHORS)), "chains")
    needed = durable(pairs.select(F.explode(F.array("key", "other")).alias("key")).distinct(), "needed")
    texts = durable(_texts(docs, needed), "texts")
    # Margins of both sides are cut to what the shorter one has, so that the ends still face each other.
    one = pairs.join(texts.withColumnRenamed("words", "w"), "key")
    before = F.least(F.lit(MARGIN), "start", "other_start")
    cut = one.select(
        "key", "other", (F.col("start") - before).alias("x_from"), (F.col("other_start") - before).alias("y_from"), "other_stop",
        F.least(F.lit(MARGIN), F.size("w") - F.col("stop")).alias("after"), F.slice("w", F.col("start") - before + 1, F.col("stop") - F.col("start") + before + MARGIN).alias("x"),
        "start", "stop", "marks",
    )
    two = cut.join(texts.select(F.col("key").alias("other"), F.col("words").alias("w")), "other")
    after = F.least("after", F.size("w") - F.col("other_stop"))
    ready = two.select(
        "key", "other", F.slice("x", F.lit(1), F.col("stop") - F.col("x_from") + after).alias("x"), "x_from",
        F.slice("w", F.col("y_from") + 1, F.col("other_stop") - F.col("y_from") + after).alias("y"), "y_from",
        (F.col("start") - F.col("x_from")).alias("core_from"), (F.col("stop") - F.col("x_from")).alias("core_to"), "marks",
    )
    out = durable(aligned(ready, least, identity).distinct(), "passages")
    forget(pairs), forget(needed), forget(texts)
    return out


def repeated(docs: DataFrame, least: int = LEAST_WORDS, identity: float = IDENTITY) -> DataFrame:
    """One row per document that shares a passage of ``least`` or more words with another: doc_id, n_repeated (words
    in such passages), n_removable (of those, in passages that another document keeps), spans (start, stop, merged)
    and partner (the smallest doc_id it shares one with).

    Null and empty texts have no passages. Rows repeated as a whole are one document; other rows of one doc_id are
    documents of their own. A null doc_id stays null. An empty table gives no rows; other columns are ignored.
    """
    found = passages(docs, least, identity)
    ids = docs.select(key().alias("key"), "doc_id")
    involved = durable(ids.join(found.select(F.explode(F.array("key", "other")).alias("key")).distinct(), "key", "left_semi").distinct(), "ids")
    mine = found.select("key", "other", "start", "stop", F.lit(True).alias("removable"))
    theirs = found.select(F.col("other").alias("key"), F.col("key").alias("other"), F.col("other_start").alias("start"), F.col("other_stop").alias("stop"), F.lit(False).alias("removable"))
    sides = mine.unionByName(theirs).join(involved.select(F.col("key").alias("other"), F.col("doc_id").alias("partner")), "other")
    span = F.struct("start", "stop")
    grouped = sides.groupBy("key").agg(F.array_sort(F.collect_set(span)).alias("all"), F.array_sort(F.collect_set(F.when(F.col("removable"), span))).alias("own"), F.min("partner").alias("partner"))
    out = grouped.select("key", _merged("all").alias("spans"), _merged("own").alias("own"), "partner")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.join(involved, "key").select("doc_id", total("spans").alias("n_repeated"), total("own").alias("n_removable"), "spans", "partner")


def _merged(name: str | Column):
    """Sorted spans with those that touch made one."""
    kind = "array<struct<start:int,stop:int>>"

    def add(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (last["stop"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(name, F.array().cast(kind), add)
