"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, merges or unigram scores and byte
fallback are rebuilt from it. A parity check runs the sentencepiece library on every text (or, if asked, on a share of them).

Where no piece holds the marker behind another character (checked when the model is loaded), a text
falls into segments (a run of spaces and what follows it) that encode independently. A block of texts
then encodes each distinct segment once, in chunks that the library's threads share, and lays the ids
out by numpy. Models or texts that do not allow it are encoded as whole texts.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire_fields(buffer: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers, or the bytes of anything longer."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = buffer[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    while at < len(buffer):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = buffer[at : at + size], at + size
        elif kind == 2:
            size, at = varint(at)
            value, at = buffer[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} in a SentencePiece model")
        yield key >> 3, value


@dataclass
class Model:
    """What encoding needs of a ModelProto."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    algorithm: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, proto: bytes) -> Model:
        model = cls()
        for number, value in wire_fields(proto):
            if number == 1:
                piece = dict(wire_fields(value))
                model.pieces.append(piece[1].decode("utf-8"))
                model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                model.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(wire_fields(value))
                model.algorithm = spec.get(3, UNIGRAM)
                model.byte_fallback = bool(spec.get(35, 0))
                if spec.get(24, 0):
                    raise ValueError("white space as a suffix is not supported")
            elif number == 3:
                spec = dict(wire_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.remove_extra, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if model.algorithm not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if USER_DEFINED in model.kinds:
            raise ValueError("user-defined pieces are not supported")
        return model

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """All ways to put a piece together from two others, best score first: what SentencePiece's BPE tries."""
        rank = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        found = []
        for piece, i in rank.items():
            for cut in range(1, len(piece)):
                if (a := rank.get(piece[:cut])) is not None and (b := rank.get(piece[cut:])) is not None:
                    found.append((-self.scores[i], a, b))
        return [(self.pieces[a], self.pieces[b]) for _, a, b in sorted(found)]

    def splits_at_marks(self) -> bool:
        """Can texts be cut before each run of spaces? And is the normaliser the identity but for the marker?"""
        plain = not self.charsmap and not self.remove_extra and self.dummy_prefix and self.escape and self.byte_fallback
        return plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(self.pieces, self.kinds, strict=True) if k == NORMAL)

    def tokenizer(self, normalise: bool = True):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        vocab = {p: i for i, p in enumerate(self.pieces)}
        if self.algorithm == BPE:
            core = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0)
        else:
            # Control, byte and unused pieces must not be matched by text; the library keeps them by id only.
            low = min(self.scores) - 1e6
            usable = [(p, s if k == NORMAL else low) for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True)]
            core = models.Unigram(usable, self.unknown, self.byte_fallback)
        tokenizer = Tokenizer(core)
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if normalise and steps:
            tokenizer.normalizer = normalizers.Sequence(steps)
        undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        tokenizer.decoder = decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []))
        return tokenizer


def set_threads(threads: int) -> None:
    """Of the tokenizers library in this process; it reads them when it first runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of each pair, end to end."""
    total = np.cumsum(sizes)
    at = np.arange(total[-1] if len(total) else 0) - np.repeat(total - sizes, sizes)
    return flat[np.repeat(starts, sizes) + at]


class Encoder:
    """Encodes lists of texts; lives in one Python worker."""

    chunk = 32_768

    def __init__(self, proto: bytes, threads: int):
        set_threads(threads)
        self.model = Model.parse(proto)
        self.whole = self.model.tokenizer()
        self.by_segment = self.model.splits_at_marks()
        if self.by_segment:
            self.bare = self.model.tokenizer(normalise=False)
            raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]
            self.lengths = np.array([len(r) for r in raw])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.is_byte = np.array([k == BYTE for k in self.model.kinds])

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        if not self.by_segment or any(MARK in t for t in texts):
            found = self.texts(texts)
            return np.concatenate([np.empty(0, np.int32), *found]), np.array([len(f) for f in found], np.int64)
        raw = [b" " + t.encode("utf-8") if t else b"" for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        space = data == 32
        starts_here = space.copy()
        starts_here[1:] &= ~space[:-1]
        starts_here[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(starts_here)
        ends = np.append(starts[1:], len(data))
        _, first, number = np.unique(W.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        ids, sizes = self._distinct(data, starts[first], ends[first])
        begin = np.cumsum(sizes) - sizes
        out = ragged(ids, begin[number], sizes[number])
        doc = np.searchsorted(offsets, starts, "right") - 1
        return out, np.bincount(doc, sizes[number], minlength=len(texts)).astype(np.int64)

    def _distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode distinct segments, many to a chunk; the ids' byte lengths tell where a segment's ids end."""
        sizes = ends - starts
        blank = data[ends - 1] == 32  # nothing but spaces: must not meet the next segment's spaces
        order = np.argsort(blank, kind="stable")
        joined = ragged(data, starts[order], sizes[order])
        stop = np.cumsum(sizes[order])
        n_plain = int((~blank).sum())
        cuts = [0]
        while cuts[-1] < n_plain:
            base = stop[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(min(n_plain, max(cuts[-1] + 1, int(np.searchsorted(stop, base + self.chunk, "right")))))
        cuts += range(n_plain + 1, len(order) + 1)
        text = [joined[(stop[a - 1] if a else 0) : stop[b - 1]].tobytes().decode("utf-8").replace(" ", MARK) for a, b in zip(cuts, cuts[1:], strict=False)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.bare.encode_batch_fast(text, add_special_tokens=False)])
        covered = np.cumsum(self.lengths[ids])
        last = np.searchsorted(covered, stop)
        if covered[-1] != stop[-1] or not np.array_equal(covered[last], stop):
            raise AssertionError("a segment's ids do not end where it ends")
        many = np.diff(np.concatenate(([-1], last)))
        begin = np.concatenate(([0], last[:-1] + 1))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return ragged(ids, begin[back], many[back]), many[back]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids. Bytes that do not form UTF-8 become U+FFFD."""
        stop = np.cumsum(counts)
        if not self.by_segment:
            return self.whole.decode_batch([ids[a:b].tolist() for a, b in zip(stop - counts, stop, strict=True)], skip_special_tokens=False)
        data = ragged(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))[stop]
        begins = np.concatenate(([0], ends[:-1]))
        return [(data[a + 1 : b] if data[a : a + 1] == b" " else data[a:b]).decode("utf-8", "replace") for a, b in zip(begins, ends, strict=True)]


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(proto: bytes, threads: int) -> Encoder:
    key = (hashlib.sha256(proto).hexdigest(), threads)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(proto, threads)
    return _encoders[key]


def encode(docs: DataFrame, model_path: str, *, keep: tuple[str, ...] = ("doc_id",), threads: int = 2, parity_every: int = 1, block_bytes: int = 2 * W.BLOCK_BYTES) -> DataFrame:
    """``keep``, ids (array<int>), n_tokens, n_byte_tokens, round_trip and parity of each row's whole text.

    ``round_trip``: decoding the ids gives the text back (of a normalising model: the normalised text may
    differ, then false). ``parity``: whether the sentencepiece library gives the same ids; asked for the rows
    whose text hash is divisible by ``parity_every`` (1, as by default: all), null elsewhere. Null and empty texts have no
    ids. Every row has one result, repeated ones too; an empty table gives no rows. The model file is read
    once by the driver (its vocabulary bounds its size) and travels with the tasks. Texts of about ``block_bytes`` are
    encoded at a time: smaller blocks take less memory of a worker and repeat more segments.
    """
    with open(model_path, "rb") as f:
        proto = f.read()
    kinds = {k: docs.schema[k].dataType for k in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, reference = _encoder(proto, threads), None
        for batch in batches:
            column = batch.column(len(keep))
            audited = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            for block in W.blocks(column, block_bytes):
                texts = [t or "" for t in column.slice(block.first, block.last - block.first).to_pylist()]
                ids, counts = encoder.block(texts)
                stop = np.cumsum(counts)
                same = [a == b for a, b in zip(encoder.decode(ids, counts), texts, strict=True)]
                parity: list[bool | None] = [None] * len(texts)
                chosen = np.flatnonzero(audited[block.first : block.last])
                if len(chosen):
                    if reference is None:
                        import sentencepiece

                        reference = sentencepiece.SentencePieceProcessor(model_proto=proto)
                    expected = reference.encode([texts[i] for i in chosen], num_threads=threads)
                    for i, e in zip(chosen, expected, strict=True):
                        parity[i] = bool(np.array_equal(ids[stop[i] - counts[i] : stop[i]], e))
                doc = np.repeat(np.arange(len(texts)), counts)
                by_bytes = np.bincount(doc, encoder.is_byte[ids], minlength=len(texts)).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stop)), pa.int32()), pa.array(ids, pa.int32()))
                kept = [batch.column(i).slice(block.first, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(counts), pa.array(by_bytes), pa.array(same), pa.array(parity, pa.bool_())], names=[*keep, "ids", "n_tokens", "n_byte_tokens", "round_trip", "parity"])

    audited = F.pmod(F.xxhash64(F.lit("parity"), F.coalesce("text", F.lit(""))), F.lit(parity_every)) == 0
    schema = ", ".join(f"`{k}` {t.simpleString()}" for k, t in kinds.items())
    return docs.select(*keep, "text", audited.alias("__audited")).mapInArrow(run, f"{schema}, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean, parity boolean")


def decode(encoded: DataFrame, model_path: str, *, keep: tuple[str, ...] = ("doc_id",), threads: int = 2) -> DataFrame:
    """``keep`` and the text of each row's ids; null or empty ids give an empty text."""
    with open(model_path, "rb") as f:
        proto = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(proto, threads)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [x or [] for x in part.column(len(keep)).to_pylist()]
                counts = np.array([len(r) for r in rows], np.int64)
                ids = np.array([i for r in rows for i in r], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(encoder.decode(ids, counts), pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keep)
    return encoded.select(*keep, "ids").mapInArrow(run, f"{schema}, text string")


def ids_digest() -> Column:
    """SHA-256 (hex) of the ids, comma-joined."""
    return F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256)
