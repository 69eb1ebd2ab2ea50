from __future__ import annotations

import struct

import pytest

from millrace.llm import pieces as P

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "a", "  a  b ", "tail   ", "\n\nx\t y", "日本語 é́ 😀", "<s> hi </s> <0x41> <unk>", "▁x▁▁y", "\x00a", "x" * 300, "one two  three   four", "Hello, World! 12345"]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model(fallback: bool, squeeze: bool) -> bytes:
    words = ["▁", "▁hello", "▁wor", "ld", "▁a", "b", "ab", "l", "o", "h", "e", "x", "▁x", "▁▁"]
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        rows += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    rows += [(w, -1.0 - 0.37 * i - 0.011 * i * i, 1) for i, w in enumerate(words)]
    pieces = [(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in rows]
    return message(*pieces, (2, message((3, 1), (4, len(rows)), (35, int(fallback)), (40, 0), (41, 1), (42, 2))), (3, message((1, b"identity"), (3, 1), (4, int(squeeze)), (5, 1))))


@pytest.fixture(scope="module")
def bpe():
    with open(MODEL, "rb") as f:
        return f.read()


def test_parity_of_whole_texts_and_segments(bpe):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_proto=bpe)
    encoder = P.Encoder(bpe, 1)
    assert encoder.by_segment
    texts = [t for t in TEXTS if "▁" not in t]
    ids, counts = encoder.block(texts)
    stop = counts.cumsum()
    assert [ids[a - n : a].tolist() for a, n in zip(stop, counts, strict=True)] == reference.encode(texts)
    assert [x.tolist() for x in encoder.texts(TEXTS)] == reference.encode(TEXTS)
    assert encoder.decode(ids, counts) == texts


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_unigram_parity(fallback, squeeze):
    import sentencepiece

    proto = unigram_model(fallback, squeeze)
    reference = sentencepiece.SentencePieceProcessor(model_proto=proto)
    encoder = P.Encoder(proto, 1)
    texts = ["hello world", "hello  x", "abab lo", "", "xéx", " a b ", "hello hello"]
    ids, counts = encoder.block(texts)
    stop = counts.cumsum()
    assert [ids[a - n : a].tolist() for a, n in zip(stop, counts, strict=True)] == reference.encode(texts)


def test_unsupported_models():
    with pytest.raises(ValueError, match="user-defined"):
        P.Model.parse(message((1, message((1, b"x"), (2, 0.0), (3, 4)))))


def test_encode_and_decode_tables(spark, odd, none):
    coded = P.encode(odd, MODEL, keep=("doc_id", "text"), parity_every=1)
    rows = coded.collect()
    assert len(rows) == odd.count()
    assert all(r.parity for r in rows)
    assert all(r.round_trip == ("▁" not in (r.text or "")) for r in rows)
    back = P.decode(coded.select("doc_id", "ids"), MODEL).collect()
    assert sorted(r.text for r in back) == sorted((r.text or "").replace("▁", " ") for r in rows)
    assert P.encode(none, MODEL).count() == 0


def test_registered_query_checks_every_row(spark):
    from millrace.llm.queries import QUERIES

    rows = QUERIES["op2_sentencepiece"](spark, "/root/testdata/sf0.001").select("parity").collect()
    assert len(rows) > 100 and all(r.parity for r in rows)
