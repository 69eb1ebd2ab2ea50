"""Words of many texts at once: byte tables, 64-bit word hashes and k-gram hashes in numpy.

Texts arrive as Arrow columns and are cut into blocks of a bounded number of bytes (one text longer
than that is a block of its own), so the memory of a task follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """256 entries: the (lower-cased) byte, or 0 for a byte that separates words.

    A NUL that does not separate becomes 0xFF, which UTF-8 never has.
    """
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[ord("A") : ord("Z") + 1] += 32
    table[0] = 255
    table[list(separators)] = 0
    return table


#: Words of [^\x20\x09-\x0D]+ after lower-casing A-Z.
SPACED = byte_table(bytes([0x20, *range(9, 14)]))
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, a-z and all non-ASCII.
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


@dataclass
class Block:
    """Texts ``first`` to ``last`` of a column as one byte array; text i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield Block(first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER^i and its inverse, i < n, modulo 2^64. Long tables are not kept."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        up, down = (np.full(size, m, np.uint64) for m in (MULTIPLIER, INVERSE))
        for p in (up, down):
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        if size > 4 * BLOCK_BYTES:
            return up[:n], down[:n]
        _powers.update(up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


#: One 64-bit number for each byte value.
BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


@dataclass
class Words:
    """Words of a block in order: where each starts and ends in ``text``, its text's number, its hash."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]].tobytes().decode("utf-8")

    def words(self, i: int, j: int) -> list[str]:
        return [self.word(x) for x in range(i, j)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(data))
    total = np.cumsum(BYTE_CODES[data] * up, dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mixed((total[ends - 1] - before) * down[starts])


def split(block: Block, table: np.ndarray = ALNUM) -> Words:
    text = table[block.data]
    n_docs = block.last - block.first
    inside = text != 0
    edge = np.zeros(len(text) + 1, bool)
    edge[block.offsets] = True
    before = np.empty(len(text), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(text), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(counts)))
    return Words(text, starts, ends, doc, span_hashes(text, starts, ends), counts, first)


def kgrams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes (those over the end of a text included)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(2 * seed + 1), np.uint64)
    for i in range(k):
        out *= MULTIPLIER
        out += hashes[i : i + n]
    return mixed(out)


def winnow(words: Words, k: int, w: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams kept: the smallest (rightmost of equals) of each w in a row.

    Any run of w + k - 1 words of a text holds a kept k-gram. Texts of fewer than w k-grams keep all.
    """
    h = kgrams(words.hashes, k, seed)
    if not len(h):
        return np.empty(0, np.int64), h
    left = words.first[words.doc + 1] - np.arange(len(words.doc))  # words from here to the text's end
    left = left[: len(h)]
    whole = left >= k
    keep = np.zeros(len(h), bool)
    if len(h) >= w:
        windows = np.lib.stride_tricks.sliding_window_view(h, w)
        full = np.flatnonzero(left[: len(windows)] >= k + w - 1)
        if len(full):
            best = w - 1 - windows[full, ::-1].argmin(axis=1)
            keep[full + best] = True
    short = words.counts[words.doc[: len(h)]] < k + w - 1
    keep |= short
    at = np.flatnonzero(keep & whole)
    return at, h[at]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
