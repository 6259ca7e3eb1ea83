"""Token-id shards with Elias-Fano document boundaries.

A shard holds the ids of consecutive documents as one array, and where each
document ends as an Elias-Fano sequence: n ends below u take about
2 + log2(u / n) bits each. select() finds one end through samples of the upper
bits' ones; no table of 64-bit offsets is written. Row ids, which ascend too, are
kept the same way.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, materialise, open_file, partitions, shared_dir, write_file
from .pieces import encoded, tokenizers_encoder

MAGIC = b"EFTOKEN1"
#: Ids after which a shard ends: 32 MB at two bytes each.
SHARD_IDS = 16_000_000
#: Ids that are read at once.
STRETCH = 1_000_000
#: One sample of the upper bits for so many values.
SAMPLE = 256


@dataclass
class EliasFano:
    """A non-decreasing sequence of n integers from 0 on."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n and top >= n else 0
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if bits else np.zeros((n, 0), np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        pack = lambda x: np.packbits(x.ravel(), bitorder="little").tobytes()
        return cls(n, bits, pack(low), pack(high), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        start = i * self.low_bits
        word = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little")
        return word >> start % 8 & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The value at i: from the nearest sample, ones are counted byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = struct.unpack_from("<I", self.samples, i // SAMPLE * 4)[0]
        left, byte = i % SAMPLE, at // 8
        word = self.high[byte] & (0xFF << at % 8)
        while left >= (ones := word.bit_count()):
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def rank(self, value: int) -> int:
        """How many values are at most value, by bisection over select()."""
        return bisect_right(range(self.n), value, key=self.select)

    def values(self) -> np.ndarray:
        """All values at once, as a table; reading shards doesn't need it."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.int64) << k
        return out

    @property
    def n_bytes(self) -> int:
        return len(self.low) + len(self.high) + len(self.samples)


def shard_bytes(doc_ids: list, ends: np.ndarray, parts: list[bytes], width: int) -> list[bytes]:
    """A shard: magic, header length, JSON header, sections in the header's order, ids."""
    nulls = sum(i is None for i in doc_ids)
    first = doc_ids[nulls] if nulls < len(doc_ids) else 0
    docs = EliasFano.encode(np.array(doc_ids[nulls:], dtype=np.int64) - first)
    bounds = EliasFano.encode(ends)
    head = {"n_docs": len(doc_ids), "null_ids": nulls, "first_id": first, "n_ids": int(ends[-1]) if len(ends) else 0, "width": width}
    sections = []
    for name, ef in (("ends", bounds), ("doc_ids", docs)):
        head[name] = {"n": ef.n, "low_bits": ef.low_bits, "sizes": [len(ef.low), len(ef.high), len(ef.samples)]}
        sections += [ef.low, ef.high, ef.samples]
    text = json.dumps(head).encode()
    return [MAGIC, struct.pack("<I", len(text)), text, *sections, *parts]


class Shard:
    """A shard opened for reading; ids are read where they are asked for."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.head = json.loads(self.file.read(struct.unpack("<I", self.file.read(4))[0]))
        self.ends, self._docs = (EliasFano(h["n"], h["low_bits"], *(self.file.read(s) for s in h["sizes"])) for h in (self.head["ends"], self.head["doc_ids"]))
        self.at, self.dtype = self.file.tell(), np.dtype(f"<u{self.head['width']}")

    def __len__(self) -> int:
        return self.head["n_docs"]

    def doc_id(self, i: int) -> int | None:
        return self._docs.select(i - nulls) + self.head["first_id"] if i >= (nulls := self.head["null_ids"]) else None

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(self.at + start * self.dtype.itemsize)
        return np.frombuffer(self.file.read((end - start) * self.dtype.itemsize), self.dtype)

    def documents(self) -> Iterator[tuple]:
        """(doc_id, start in the shard, ids) in order; select() gives each bound, and ids are read in stretches of about a million."""
        start, since, until, block = 0, 0, 0, None
        for i in range(len(self)):
            end = self.ends.select(i)
            if end > until:
                last = self.ends.rank(start + STRETCH) - 1
                since, until = start, self.ends.select(last) if last > i else end
                block = self.ids(since, until)
            yield self.doc_id(i), start, (block[start - since : end - since] if end > start else np.zeros(0, self.dtype))
            start = end

    def close(self) -> None:
        self.file.close()


def write(df: DataFrame, model: str, end_id: int, folder: str | None = None, mode: str = "whole", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, append end_id to each, write shards in ascending order of id_col.

    Returns the manifest, already written to the shared folder: path, n_docs,
    n_ids, base (ids in all earlier shards), one row a shard. A null or empty
    text is the end id alone. Null row ids come first; equal ones are ordered by
    a hash of the text, so repeated rows are kept. Other columns are ignored. An empty table
    gives an empty manifest. A file belongs to one task attempt, so retried or
    doubled attempts leave at most files that no manifest names.
    """
    spark = df.sparkSession
    folder = folder or shared_dir(spark)
    own = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encoder = tokenizers_encoder(model, mode)
        width, end = (4 if encoder.code == "I" else 2), encoder.pack([end_id])
        task, seq = TaskContext.get(), 0
        docs, lengths, parts, held = [], [], [], 0

        def flush():
            uri = f"{folder}/part-{task.partitionId():06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
            write_file(uri, shard_bytes(docs, np.cumsum(lengths), parts, width))
            return task.partitionId(), seq, uri, len(docs), held

        for doc, ids in encoded(batches, encoder):
            docs.append(doc)
            parts += [ids, end]
            lengths.append(len(ids) // width + 1)
            held += lengths[-1]
            if held >= SHARD_IDS:
                yield flush()
                docs, lengths, parts, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield flush()

    own = own.withColumn("tie", F.xxhash64("text"))
    ordered = own.repartitionByRange(partitions(spark), "id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    made = materialise(map_rows(ordered, run, "part bigint, seq bigint, path string, n_docs bigint, n_ids bigint"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return made.select("part", "seq", "path", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document from the shards, start counted over all shards."""
    return _read(manifest, lambda ids: (ids.tolist(),), "ids array<bigint>")


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards."""
    return _read(manifest, lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())), "n_tokens bigint, ids_crc32 bigint")


def _read(manifest: DataFrame, digest, fields: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                for doc, start, ids in shard.documents():
                    yield doc, base + start, *digest(ids)
                shard.close()

    files = manifest.select("path", "base").repartition(partitions(manifest.sparkSession))
    return map_rows(files, run, f"doc_id bigint, start bigint, {fields}")


def read_one(spark: SparkSession, manifest: DataFrame, position: int) -> np.ndarray:
    """The ids of the document that holds the id at a position of the whole sequence."""
    row = manifest.where(F.col("base") <= position).orderBy(F.desc("base")).first()
    shard = Shard(row["path"])
    return shard.ids(*shard.bounds(shard.ends.rank(position - row["base"])))
