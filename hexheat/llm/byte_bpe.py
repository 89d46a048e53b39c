"""Byte-level BPE encoding and decoding through a sentencepiece model that is made from the vocabulary.

A file of ranks holds all that a BPE model needs: the pair with the least rank is merged first, so its pieces, each
byte written as one printable letter and scored by its negative rank, are a sentencepiece model with identity
normalisation. Pieces stand in the order of their ranks, so that piece ids are token ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from hexheat.llm.bpe import byte_letters, default_path, in_pieces
from hexheat.llm.common import free_name

VOCABULARY = "byte_bpe_50k.tiktoken"
# Distinct pre-tokens a worker remembers; beyond it forgets them all and starts anew.
KEPT = 500_000
# A longer text is matched in parts of about this many characters.
PART = 1 << 20
# A match holds white space only before anything else, so none spans a place between a visible letter and a blank.
SEAM = regex.compile(r"(?<=\S)(?= )")


def serialised(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of tokens in the order of their ranks. The unknown piece comes last and never turns up."""
    letters = byte_letters()
    model = sentencepiece_model_pb2.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join([letters[b] for b in token]), score=-rank)
    model.pieces.add(piece="<unk>", score=0, type=model.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = model.trainer_spec.BPE
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class ByteBpe:
    """Encoder and decoder for a file of ranks that has every single byte and no gap."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in self.tokens] != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path} has gaps in its ranks or lacks a byte")
        self.pattern = regex.compile(pattern)
        self.letters = str.maketrans({chr(b): x for b, x in byte_letters().items()})
        self.model = SentencePieceProcessor(model_proto=serialised(self.tokens))
        # A match that is a token as a whole is that token, whether or not merging leads to it.
        self.whole = {t: np.uint32(i).astype("<u4").tobytes() for i, t in enumerate(self.tokens)}
        self.kept: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encodes distinct pre-tokens and keeps their ids, packed."""
        coded = [w.encode() for w in words]
        rest = []
        for w, b in zip(words, coded):
            if (own := self.whole.get(b)) is not None:
                self.kept[w] = own
            else:
                rest.append((w, b.decode("latin-1").translate(self.letters)))
        rows = self.model.encode([x for _, x in rest], num_threads=1)
        flat = np.fromiter(chain.from_iterable(rows), "<u4", sum(map(len, rows))).tobytes()
        start = 0
        for (w, _), ids in zip(rest, rows):
            self.kept[w] = flat[start:start + 4 * len(ids)]
            start += 4 * len(ids)

    def parts(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > PART and (cut := SEAM.search(text, start + PART)):
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[list[bytes]] = []
        for text in texts:
            out.append([])
            for part in self.parts(text):
                words = self.pattern.findall(part)
                if fresh := {w for w in set(words) if w not in self.kept}:
                    if len(self.kept) + len(fresh) > KEPT:
                        self.kept.clear()
                        fresh = set(words)
                    self.learn(list(fresh))
                out[-1].append(b"".join([self.kept[w] for w in words]))
        return [b"".join(x) for x in out]

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


@lru_cache(maxsize=2)
def vocabulary(path: str | None, pattern: str | None) -> ByteBpe:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return ByteBpe(path or default_path(VOCABULARY), pattern)


def encode_bytes(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` with `ids` binary, the token ids of a text as little-endian unsigned 32-bit numbers, and `decoded` binary,
    the bytes that those ids stand for (under longer names where it has such columns).

    NULL and empty texts have no ids and empty bytes. Repeated rows are encoded each, an empty table gives an empty
    one, a long text is matched part by part. `path` names a file of ranks that exists on every executor and `pattern`
    the regular expression of its matches; NULL stands for the installed public ones.
    """
    ids, decoded = free_name(docs, "ids"), free_name(docs, "decoded")
    kinds = [f"`{c}` {k}" for c, k in docs.dtypes]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for x in batches:
            done = 0
            for piece in in_pieces(x.column(text).to_pylist()):
                packed = bpe.encode_all(piece)
                part = x.slice(done, len(piece))
                done += len(piece)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(packed, pa.binary()), pa.array(map(bpe.decode, packed), pa.binary())],
                    [*part.schema.names, ids, decoded],
                )

    return docs.mapInArrow(work, ", ".join([*kinds, f"`{ids}` binary", f"`{decoded}` binary"]))


def decode_bytes(coded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """`coded` with `decoded` binary, the bytes that the packed ids in `ids` stand for. NULL ids stand for no bytes."""
    decoded = free_name(coded, "decoded")
    kinds = [f"`{c}` {k}" for c, k in coded.dtypes]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, None)
        for x in batches:
            out = pa.array((bpe.decode(p or b"") for p in x.column(ids).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*x.columns, out], [*x.schema.names, decoded])

    return coded.mapInArrow(work, ", ".join([*kinds, f"`{decoded}` binary"]))


def byte_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `docs`; NULL text counts as empty."""
    coded = encode_bytes(docs.select("doc_id", "text"), path=path)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
