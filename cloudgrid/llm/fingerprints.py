"""Bottom-k sketches of word shingles as document fingerprints."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, partitions, rows_of
from .shingles import shingle_hashes

#: Hashes kept: the standard error of a likeness of a half is about 0.04.
K = 128


@dataclass(frozen=True)
class BottomK:
    """The k smallest distinct hashes of a set, or all of a smaller one."""

    k: int
    hashes: np.ndarray

    @classmethod
    def of(cls, raw: bytes, k: int = K, width: int = 5) -> BottomK:
        return cls(k, shingle_hashes(raw, width)[:k])

    @classmethod
    def parse(cls, text: str) -> BottomK:
        k, _, body = text.partition(":")
        return cls(int(k), np.frombuffer(base64.b64decode(body), "<u8"))

    def __str__(self) -> str:
        return f"{self.k}:{base64.b64encode(self.hashes.astype('<u8').tobytes()).decode()}"

    def merge(self, other: BottomK) -> BottomK:
        """The sketch of the union, from sketches of parts."""
        k = min(self.k, other.k)
        return BottomK(k, np.union1d(self.hashes, other.hashes)[:k])

    def distinct(self) -> float:
        """Shingles in the set: exact below k."""
        if len(self.hashes) < self.k:
            return float(len(self.hashes))
        return (self.k - 1) / ((float(self.hashes[-1]) + 1) / 2.0**64)

    def resemblance(self, other: BottomK) -> float:
        """Estimated Jaccard likeness; exact where the union has fewer than k. Two empty sets: 1."""
        union = self.merge(other).hashes
        if not len(union):
            return 1.0
        shared = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        return float(np.searchsorted(shared, union[-1], side="right")) / len(union)

    def containment(self, other: BottomK) -> float:
        """Estimated share of this set that is in the other; an empty set is contained."""
        if not len(self.hashes):
            return 1.0
        j, union = self.resemblance(other), self.merge(other).distinct()
        return min(1.0, j * union / self.distinct())


def sketch(df: DataFrame, k: int = K, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, n_distinct) of each row; a null or empty text has an empty fingerprint."""
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for doc, text in rows_of(batches):
            made = BottomK.of((text or "").encode(), k, width)
            yield doc, str(made), made.distinct()

    return map_rows(own, run, f"id {own.schema[0].dataType.simpleString()}, fingerprint string, n_distinct double").withColumnRenamed("id", id_col)


def merge_parts(sketches: DataFrame, group_col: str, k: int = K) -> DataFrame:
    """(group_col, fingerprint) of the union of each group's sketches.

    Native: the k smallest distinct hashes of a group are kept by a ranked window
    after a first distinct, so a large group costs k rows a task. A group of empty
    fingerprints alone has no row.
    """
    turned = lambda h: F.concat(*(F.substring(h, k, 2) for k in range(15, 0, -2)))  # noqa: E731  hex with its eight bytes the other way round
    raw = sketches.select(F.col(group_col).alias("g"), F.hex(F.unbase64(F.element_at(F.split("fingerprint", ":"), 2))).alias("b"))
    starts = F.when(F.length("b") > 0, F.sequence(F.lit(1), F.length("b"), F.lit(16))).otherwise(F.array().cast("array<int>"))
    each = raw.select("g", F.explode(F.transform(starts, lambda i: turned(F.substring("b", i, F.lit(16))))).alias("h")).distinct()
    small = each.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("n") <= k)
    joined = small.groupBy("g").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    body = F.translate(F.base64(F.unhex(F.array_join(F.transform("hs", turned), ""))), "\r\n", "")
    return joined.select(F.col("g").alias(group_col), F.concat(F.lit(f"{k}:"), body).alias("fingerprint"))


def _cuts(keys: DataFrame, n: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(cuts, heavy) of rows (key, tie): fewer than n cuts (key, last tie before it), keys descending and ties ascending, and the keys that are cut within."""
    tenth = 10 * n
    found = keys.agg(F.percentile_approx("key", [i / n for i in range(n - 1, 0, -1)] or [0.5], tenth)).first()[0] or []
    times = Counter(found)
    heavy = [k for k, often in times.items() if often > 1]
    last = (1 << 63) - 1
    cuts = {(k, last) for k in times}
    if heavy:
        m = max(times.values())
        rows = keys.where(F.col("key").isin(heavy)).groupBy("key").agg(F.percentile_approx("tie", [i / m for i in range(1, m)], tenth).alias("ties"))
        cuts |= {(r["key"], r["ties"][i * m // times[r["key"]] - 1]) for r in rows.collect() for i in range(1, times[r["key"]])}
    return sorted(cuts, key=lambda c: (-c[0], c[1])), heavy


def edit_neighbours(df: DataFrame, k: int = K, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of a text edited with the start of the next document.

    The next document is that of the next smaller row id; after the last comes
    the first. The last third of the code points, rounded down, gives way to as
    many from the start of the next text, or to all of it. Equal row ids are
    ordered by a hash of the text and rows that repeat stand next to each other;
    null row ids come last. A null text is empty. One row alone is its own next.
    An empty table gives no rows. Returns id_col, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are dealt once, by ranges of the row id; each range also gets the first
    row of the range after it, so texts cross the network one time. An id (or null)
    with many rows is cut into ranges by the hash of their texts, so that only rows
    that repeat as a whole stay together.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    own = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lowest, highest = -(1 << 63), (1 << 63) - 1
    key = F.coalesce("id", F.lit(lowest))
    tie = F.when(F.col("id").isNull(), F.xxhash64("text").bitwiseAND(F.lit(highest))).otherwise(F.xxhash64("text").bitwiseOR(F.lit(lowest)))
    cuts, heavy = _cuts(own.select(key.alias("key"), tie.alias("tie")), n)
    own = own.withColumn("spread", F.when(key.isin(heavy), tie).otherwise(F.lit(0)) if heavy else F.lit(0))
    at = F.lit(0)
    if cuts:  # how many cuts come before the row, by bisection
        ids, ties = (F.array(*(F.lit(c[k]).cast("bigint") for c in cuts)) for k in (0, 1))
        steps = F.array(*(F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)))
        before = lambda i: (F.get(ids, i) > key) | ((F.get(ids, i) == key) & (F.get(ties, i) < F.col("spread")))
        at = F.aggregate(steps, F.lit(0), lambda low, step: F.when(before(low + step - 1), low + step).otherwise(low))
    own = own.withColumn("range", at)
    first = F.max(F.struct(key.alias("top"), F.bitwise_not("spread").alias("turned")))
    heads = sorted((r["range"], r["first"]["top"], ~r["first"]["turned"]) for r in own.groupBy("range").agg(first.alias("first")).collect())  # at most a row for each range
    if not heads:
        return spark.createDataFrame([], f"{id_col} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    to = spark.createDataFrame([(*head, heads[i - 1][0]) for i, head in enumerate(heads)], "head_range int, top bigint, top_spread bigint, to int")
    met = own.join(F.broadcast(to), (F.col("range") == F.col("head_range")) & (key == F.col("top")) & (F.col("spread") == F.col("top_spread")))
    ends = met.groupBy(F.col("to").alias("range")).agg(F.min(F.struct(tie.alias("tie"), "id", "text")).alias("e")).select("e.id", "e.text", "range")
    both = own.select("id", "text", "range").withColumn("extra", F.lit(False)).unionByName(ends.withColumn("extra", F.lit(True))).withColumn("tie", tie)
    dealt = both.repartitionById(n, F.col("range")).sortWithinPartitions("range", "extra", F.desc_nulls_last("id"), "tie").select("id", "text", "extra")

    def finish(doc, text, own_sketch, next_text, next_sketch):
        cut = len(text) // 3
        edited = (text[: len(text) - cut] + next_text[:cut]).encode()
        other = BottomK.of(edited, k, width)
        return doc, len(text), hashlib.sha256(edited).hexdigest(), str(own_sketch), str(other), own_sketch.resemblance(other), own_sketch.resemblance(next_sketch)

    def run(batches):
        held = None
        for doc, text, extra in rows_of(batches):
            made = BottomK.of(text.encode(), k, width)
            if held:
                yield finish(*held, text, made)
            held = None if extra else (doc, text, made)

    return map_rows(dealt, run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
