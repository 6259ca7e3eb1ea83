"""Byte-level BPE through sentencepiece.

A vocabulary of byte strings with ranks is written out as a sentencepiece BPE
model: each byte becomes one character, a piece's score is its negative rank,
and normalisation is the identity. Texts are cut by the pre-token pattern, each
pre-token is encoded by that model, and ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held, map_rows, rows_of
from .pieces import PieceEncoder


def byte_chars() -> list[str]:
    """A printable, non-space character for each byte: itself where it is one, else from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose ids are the ranks; ranks must be 0 to n - 1, and id n is unknown.

    Fields are those of the public sentencepiece_model.proto.
    """
    n, chars = len(ranks), byte_chars()
    if sorted(ranks.values()) != list(range(n)):
        raise ValueError("ranks must be 0 to n - 1")
    by_rank = sorted(ranks, key=ranks.get)
    pieces = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, token in enumerate(by_rank)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find, self.ranks = regex.compile(pattern).findall, ranks
        self.chars = str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})
        back = {c: b for b, c in enumerate(byte_chars())}
        self.bytes_of = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(len(ranks))]
        self.decimal = [b"%d" % i for i in range(len(ranks))]
        self.pieces = PieceEncoder(self._encode_many, "byte_level", len(ranks) > 1 << 16)

    def encode_token(self, token: str) -> list[int]:
        """A pre-token that is itself in the vocabulary is one id, as in tiktoken."""
        raw = token.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.processor.encode(raw.decode("latin-1").translate(self.chars))

    def _encode_many(self, texts: list[str]) -> list[list[int]]:
        return [[i for token in self.find(t) for i in self.encode_token(token)] for t in texts]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for packed in self.pieces.encode(texts):
            yield array(self.pieces.code, packed).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def worker_bpe(model: bytes, pattern: str) -> ByteBpe:
    """A ByteBpe kept by each Python worker; the ranks are read out of the model's pieces."""

    def make() -> ByteBpe:
        import sentencepiece

        p, back = sentencepiece.SentencePieceProcessor(model_proto=model), {c: b for b, c in enumerate(byte_chars())}
        return ByteBpe(model, {bytes(back[c] for c in p.id_to_piece(i)): i for i in range(p.get_piece_size() - 1)}, pattern)

    return held(("byte_bpe", pattern, hashlib.sha1(model).digest()), make)


def _rows(df: DataFrame, id_col: str, text_col: str, model: bytes, pattern: str, row, fields: str) -> DataFrame:
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        bpe = worker_bpe(model, pattern)
        for some in chunks(rows_of(batches), lambda r: len(r[1] or ""), 1 << 22):
            for (doc, _), ids in zip(some, bpe.encode([t or "" for _, t in some]), strict=True):
                yield doc, *row(bpe, ids)

    return map_rows(own, run, f"id {own.schema[0].dataType.simpleString()}, {fields}").withColumnRenamed("id", id_col)


def encode(df: DataFrame, model: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded binary) for each row, repeated rows included.

    A null or empty text has no ids and decodes to no bytes; ids of rows may be
    null or tie. Other columns are ignored. An empty table gives no rows.
    """
    return _rows(df, id_col, text_col, model, pattern, lambda bpe, ids: (ids, bpe.decode(ids)), "ids array<int>, decoded binary")


def digests(df: DataFrame, model: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode(), digested where the ids arise."""

    def row(bpe, ids):
        return len(ids), hashlib.sha256(b",".join(map(bpe.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _rows(df, id_col, text_col, model, pattern, row, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
