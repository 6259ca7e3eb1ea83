"""Words of batches of texts and hashed character n-grams of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import chunks, release, rows_of

#: Words whose n-grams are in memory at once.
WORDS = 20_000
_letters = re.compile(r"[^\W\d_]+").findall


def held_out(id_col: str):
    """crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def letter_words(text: str) -> list[str]:
    """Runs of letters in lower case; a run of digit-like characters alone is none."""
    found = _letters(text.lower())
    return found if "".join(found).isalpha() else [w for w in found if any(map(str.isalpha, w))]


@dataclass
class Batch:
    """Texts as numbers of distinct words: those of row i are at[bounds[i]:bounds[i + 1]]."""

    rows: list[tuple]
    words: list[str]
    at: np.ndarray
    bounds: np.ndarray


def word_batches(batches, split=letter_words, limit: int = 1 << 21) -> Iterator[Batch]:
    """Rows of Arrow batches whose last column is text, null texts as empty ones."""
    release()
    for some in chunks(rows_of(batches), lambda r: len(r[-1] or ""), limit):
        yield number(some, [split(r[-1] or "") for r in some])


def number(rows: list[tuple], found: list[list[str]]) -> Batch:
    coded = pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode()
    return Batch(rows, coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.cumsum([0, *map(len, found)]))


def ngrams(words: list[str], lengths: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character n-gram of '<word>' of the given lengths, and of the word itself."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = "".join(["<" + w + ">" for w in words])
    chars = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    room = ends[word] - np.arange(len(chars))
    prime, found, owner = np.uint64(0x9E3779B97F4A7C15), [], []

    def place(h, n):
        h = (h ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)

    h = np.zeros(len(chars), np.uint64)
    for n in range(1, min(max(lengths), len(chars)) + 1):
        h[: len(chars) - n + 1] = (h[: len(chars) - n + 1] + chars[n - 1 :]) * prime
        h ^= h >> np.uint64(29)
        if n in lengths:
            fit = np.flatnonzero(room >= n)
            found.append(place(h[fit], n))
            owner.append(word[fit])
    power = (chars + np.uint64(1)) * (prime ** (room.astype(np.uint64) % np.uint64(61) + np.uint64(1)))
    power ^= power >> np.uint64(31)
    found.append(place(np.add.reduceat(power * prime, ends - size), 0))
    owner.append(np.arange(len(words)))
    return np.concatenate(found), np.concatenate(owner)


def sample_groups(df, key: str, counts: dict, wanted: int, columns: list[str], seed: int):
    """A random part of df: of each group of key in counts (its rows), wanted rows on average at most; other groups are left out.

    Rows are chosen by a hash of columns, in one pass without a shuffle. columns
    should hold an id, so that copies of one text don't all come in together.
    """
    share = F.lit(0.0)
    for group, n in counts.items():
        share = F.when(F.col(key) == F.lit(group), F.lit(min(1.0, wanted / max(1, n)))).otherwise(share)
    roll = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.where(roll < share)
