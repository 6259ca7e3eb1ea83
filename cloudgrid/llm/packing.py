"""Packing documents into fixed-length sequences along a Hilbert curve.

Token counts are hashed with signs into a vector, the vector is scaled to length
one and projected to three dimensions; the cell there gives a Hilbert key. Rows
are range-partitioned and sorted by that key, so like documents stand together,
and each range is cut into sequences as one stream.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_rows, materialise, partitions, rows_of
from .pieces import encoded, tokenizers_encoder

DIMENSIONS, BITS, BUCKETS, SEED = 3, 16, 256, 7


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points with integer coordinates below 2**bits.

    Skilling, "Programming the Hilbert curve" (2004), on all points at once.
    """
    x = axes.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p).astype(np.uint64)
            x[0] ^= np.where(high, p, swap).astype(np.uint64)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(b)) & one
    return key.astype(np.int64)


class Projection:
    """From token ids to Hilbert keys; fixed by its seed."""

    def __init__(self, vocabulary: int):
        rng = np.random.default_rng(SEED)
        self.bucket = rng.integers(0, BUCKETS, vocabulary).astype(np.int32)
        self.sign = rng.choice([-1.0, 1.0], vocabulary).astype(np.float32)
        self.axes = rng.normal(size=(BUCKETS, DIMENSIONS))

    def vectors(self, texts: list[np.ndarray]) -> np.ndarray:
        """A row of length one, or of zeros, for the ids of each text."""
        ids, n = np.concatenate(texts), len(texts)
        row = np.repeat(np.arange(n, dtype=np.int32) * BUCKETS, [len(t) for t in texts])
        v = np.bincount(row + self.bucket[ids], self.sign[ids], n * BUCKETS).reshape(n, BUCKETS)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        cells = (1 / (1 + np.exp(-1.6 * (vectors @ self.axes))) * (1 << BITS)).astype(np.int64)
        return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def tokens(df: DataFrame, model: str, end_id: int, vocabulary: int, mode: str = "whole", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, key): each text's packed ids with end_id, and its place on the curve."""
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encoder, projection = tokenizers_encoder(model, mode), Projection(vocabulary)
        end, dtype = encoder.pack([end_id]), np.dtype("<u4" if encoder.code == "I" else "<u2")
        for some in chunks(encoded(batches, encoder), lambda r: len(r[1]) + 1000, 1 << 21):
            keys = projection.keys(projection.vectors([np.frombuffer(ids, dtype) for _, ids in some]))
            yield from ((doc, ids + end, key) for (doc, ids), key in zip(some, keys.tolist(), strict=True))

    return map_rows(own, run, f"id {own.schema[0].dataType.simpleString()}, ids binary, key bigint")


def sequences(docs: Iterator[tuple], width: int, length: int) -> Iterator[tuple]:
    """Cut a stream of (id, packed ids) into sequences: (id, start, ids, doc_tokens, sequence, offset).

    What is left at the end is cut into sequences whose lengths are powers of two, which need no padding.
    """
    held, fill, number = [], 0, 0
    for doc, ids in docs:
        n, at = len(ids) // width, 0
        while at < n:
            take = min(n - at, length - fill)
            held.append((doc, at, ids[at * width : (at + take) * width], n, number, fill))
            at, fill = at + take, fill + take
            if fill == length:
                yield from held
                held, fill, number = [], 0, number + 1
    room, at = 1 << fill.bit_length() - 1 if fill else 0, 0
    for doc, start, ids, n, _, _ in held:
        while ids:
            take = min(len(ids) // width, room - at)
            yield doc, start, ids[: take * width], n, number, at
            ids, start, at, fill = ids[take * width :], start + take, at + take, fill - take
            if at == room and fill:
                room, at, number = 1 << fill.bit_length() - 1, 0, number + 1


def pack(df: DataFrame, model: str, end_id: int, vocabulary: int, length: int = 4096, mode: str = "whole", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most length ids.

    (id_col, start, length, ids binary, doc_tokens, sequence_id, offset). Each id
    of each row lies in one piece; sequences of length ids are full, and at the
    end of each range come shorter ones whose lengths are powers of two. A null
    or empty text is the end id alone. Row ids may be null, tie or repeat: every
    row is packed by itself. Other columns are ignored. An empty table gives no
    pieces. A sequence_id is the range's number times 2**32 plus a count.
    """
    return _pack(df, model, end_id, vocabulary, length, mode, id_col, text_col, lambda ids, width: (len(ids) // width, ids), "length bigint, ids binary")


def pack_digests(df: DataFrame, model: str, end_id: int, vocabulary: int, length: int = 4096, mode: str = "whole", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack() with ids_crc32, of 32-bit little-endian ids, in place of ids."""

    def digest(ids, width):
        return len(ids) // width, zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())

    return _pack(df, model, end_id, vocabulary, length, mode, id_col, text_col, digest, "length bigint, ids_crc32 bigint")


def _pack(df, model, end_id, vocabulary, length, mode, id_col, text_col, digest, fields):
    width = 4 if vocabulary > 1 << 16 else 2
    # written once: the range bounds below are taken from a first pass over it
    made = materialise(tokens(df, model, end_id, vocabulary, mode, id_col, text_col)).withColumn("tie", F.xxhash64("ids"))
    ordered = made.repartitionByRange(partitions(df.sparkSession), "key", "tie", "id").sortWithinPartitions("key", "tie", "id").select("id", "ids")

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for doc, start, ids, n, number, offset in sequences(rows_of(batches), width, length):
            yield doc, start, *digest(ids, width), n, base + number, offset

    kind = made.schema["id"].dataType.simpleString()
    return map_rows(ordered, run, f"id {kind}, start bigint, {fields}, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)
