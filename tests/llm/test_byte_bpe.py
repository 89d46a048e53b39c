"""Byte-level BPE through a sentencepiece model against the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest

from hexheat.llm import byte_bpe

ODD = [
    None, "", " ", "\n", "a'll  x\n\n y", "   é日本 \x00\x01 <|endoftext|>", "ΣΑΣ 🙂🙂 'S  ", "  lead", "tail  ", "a" * 3000,
    "▁▁ ĠĠ", "é  　x", "don't DON'T 12345678 --==",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, rows):
    out = []
    for i, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        out.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    return sorted(out, key=repr)


def test_digests_equal_the_library(make_docs, rows, library):
    rows = [*rows, *enumerate(ODD)]
    got = sorted((tuple(r) for r in byte_bpe.byte_digests(make_docs(rows)).collect()), key=repr)
    assert got == expected(library, rows)


def test_an_empty_table(make_docs):
    assert byte_bpe.byte_digests(make_docs([])).collect() == []


def test_columns_stay_and_ids_decode(make_docs):
    docs = make_docs([(1, "one two"), (2, None), (2, None)])
    coded = byte_bpe.encode_bytes(docs)
    assert coded.columns == [*docs.columns, "ids_", "decoded_"]
    back = byte_bpe.decode_bytes(coded.drop("ids", "decoded"), "ids_")
    assert sorted(bytes(r.decoded) for r in back.collect()) == [b"", b"", b"one two"]


def test_parts_of_long_texts_and_forgetting(library, texts, monkeypatch):
    r = random.Random(5)
    mixed = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x3000), 0x1F600 + r.randrange(80), 32, 10])) for _ in range(20_000))
    all_texts = [mixed, *(t or "" for t in ODD), *(t or "" for t in texts)]
    bpe = byte_bpe.vocabulary(None, None)
    for part in (1, 40, 4000):
        monkeypatch.setattr(byte_bpe, "PART", part)
        monkeypatch.setattr(byte_bpe, "KEPT", 10 * part)
        coded = bpe.encode_all(all_texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in coded] == [library.encode_ordinary(t) for t in all_texts]
        assert [bpe.decode(x) for x in coded] == [t.encode() for t in all_texts]


def test_every_token_is_its_own_piece():
    bpe = byte_bpe.vocabulary(None, None)
    pieces = [t.decode("latin-1").translate(bpe.letters) for t in bpe.tokens]
    assert [bpe.model.id_to_piece(i) for i in range(len(pieces))] == pieces
    assert bpe.model.unk_id() == len(pieces)


def test_a_file_with_gaps_is_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % (b + (b > 9)) for b in range(256)))
    with pytest.raises(ValueError, match="gaps"):
        byte_bpe.ByteBpe(str(path), r"\S+|\s+")
