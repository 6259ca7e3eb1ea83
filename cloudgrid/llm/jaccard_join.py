"""Jaccard join of word shingle sets, by count vectors in an R-tree.

1. Rows with equal sets form a class, whose smallest id stands for it.
2. Classes that agree in a band of min-hashes meet; components of such meetings
   are the units of the join. Bands follow from the threshold: a pair right at it
   meets in none with a chance of 4e-10 at most, a likelier one still less. At the
   default of 0.75 they are 80 bands of 5.
3. The sets of a unit go into an R-tree over count vectors, which yields the pairs
   that may be linked, and each of these is verified by exact intersection. The
   components of verified pairs are the result.

A unit above BLOCK rows is split into blocks. All rows first meet one block; the
largest part that this connects needs no pairs within itself, and only the rows
outside it then meet all blocks. So no group has to fit one task, and a group of
copies of one text takes linear work however large it is. Within a task, pairs
of one already connected part are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise, partitions, release, rows_of
from .components import components
from .count_tree import GROUPS, CountTree, count_vector, enough
from .shingles import mix, shingle_hashes

BLOCK = 1024
BANDS, ROWS = 80, 5
#: Chance at most that a pair right at the threshold meets in no band.
MISS = 4e-10


@cache
def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows of each) for a threshold: of up to ROWS rows the most for which BANDS are enough, or else one row and more bands."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be 1 to 100: {percent}")
    for rows in range(ROWS, 0, -1):
        apart = 1 - (percent / 100) ** rows
        bands = math.ceil(math.log(MISS) / math.log(apart)) if apart else 1
        if bands <= BANDS:
            break
    return bands, rows


@cache
def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(17)
    return random.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), random.integers(0, 1 << 32, n, dtype=np.uint32)


def band_hashes(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash for each band of min-hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    factors, shifts = _hashers(bands * rows)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at : at + 2048, None] * factors + shifts).min(axis=0), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T.astype(np.uint64):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def signatures(df: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n, key binary, bands array<bigint>) of each row of (id, text); no words: a null key and no bands."""
    bands = bands_for(percent)

    def run(batches):
        release()
        for doc, text in rows_of(batches):
            h = shingle_hashes((text or "").encode().lower(), width)
            yield doc, len(h), *((xxhash.xxh3_128_digest(h.tobytes()), band_hashes(h, *bands).tolist()) if len(h) else (None, []))

    return map_rows(df, run, "id bigint, n int, key binary, bands array<bigint>")


FIELDS = ["k", "i", "j", "own", "id", "n", "counts", "hashes"]


def large_units(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of units of more than BLOCK rows; sets: (k, size, id, n, counts, hashes)."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = sets.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    copies = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = materialise(forests(cut.withColumns({"i": F.lit(0), "j": F.explode(copies)}).select(*FIELDS), percent))

    parts = components(first).withColumnRenamed("v", "id")
    named = sets.select("k", "id").distinct().join(parts, "id", "left").select("k", "id", F.coalesce("component", "id").alias("part"))
    counted = named.groupBy("k", "part").agg(F.count("*").alias("n"))
    main = counted.groupBy("k").agg(F.max(F.struct("n", "part")).alias("m")).select("k", F.col("m.part").alias("main"))
    rest = materialise(named.join(main, "k").where("part <> main").select("k", "id"))
    many = rest.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("queries"))
    asked = cut.join(rest, ["k", "id"], "left_semi").join(many, "k").withColumns({"i": F.pmod(F.xxhash64("id"), F.col("queries")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    all_rows = cut.join(many, "k").withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("queries") - 1)), "j": F.col("own")})
    met = asked.withColumn("own", F.lit(-1)).select(*FIELDS).unionByName(all_rows.select(*FIELDS))
    return first.unionByName(forests(met, percent))


def _runs(batches) -> Iterator[pa.Table]:
    """Tables of whole groups; rows of a group (k, i, j) are adjacent."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k, i, j = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
        new = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        same = held and tuple(held[-1].column(c)[-1].as_py() for c in (0, 1, 2)) == (k[0], i[0], j[0])
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if not len(new):
            held.append(batch)
            continue
        first, last = int(new[0]) if same else 0, int(new[-1])
        if same:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
        if last > first:
            yield pa.Table.from_batches([batch.slice(first, last - first)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def forests(grouped: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of a forest of linked sets for each group (k, i, j) of rows of FIELDS; own: only rows that differ in it are compared, if any do."""

    def run(batches):
        for t in _runs(batches):
            k, i, j, own = (t.column(c).to_numpy() for c in (0, 1, 2, 3))
            ids, n, counts, sets = t.column(4).to_numpy(), t.column(5).to_numpy().astype(np.int64), _matrix(t.column(6), GROUPS), t.column(7).to_pylist()
            starts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1])
            for s, m in zip(starts.tolist(), np.diff(np.append(starts, len(k))).tolist(), strict=True):
                rows = slice(s, s + m)
                across = own[rows] if own[rows].min() != own[rows].max() else None
                verify = lambda x, y, s=s: linked(sets[s + x], sets[s + y], percent)
                for x, y in CountTree(counts[rows], n[rows]).forest(percent, verify, across):
                    yield int(ids[s + x]), int(ids[s + y])

    dealt = grouped.repartition(partitions(grouped.sparkSession), "k", "i", "j").sortWithinPartitions("k", "i", "j")
    return map_rows(dealt, run, "a bigint, b bigint")


def linked(a: bytes, b: bytes, percent: int) -> bool:
    """Exact: sorted distinct hashes of both sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return bool(enough(int((y[at] == x).sum()), len(x), len(y), percent))


def join(df: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of each row: components of all pairs with 100 * shared >= percent * united.

    The search for candidates is probabilistic: of unequal sets, a pair right at
    percent is missed with a chance of MISS at most, whatever percent from 1 to
    100 is. Low ones need more candidates: bands have fewer rows. No pair below
    percent is linked.

    A-Z are lower-cased; a text of fewer than width words is one shingle. A null
    or empty text, or one without words, has no shingles and no links. The id is
    the document: rows of one id share its component. Rows with a null id take no
    part and have a null component. Repeated rows stay. Other columns are ignored.
    An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = materialise(signatures(docs, width, percent))
    full = made.where(F.col("key").isNotNull() & F.col("id").isNotNull())
    classes = full.groupBy("key").agg(F.min("id").alias("rep"))
    reps = full.join(classes.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("id") == F.col("rep")), "left_semi")

    met = reps.select(F.explode("bands").alias("band"), "id")
    first = met.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("band", "a")
    likely = components(met.join(first, "band").select("a", F.col("id").alias("b")))

    sizes = likely.groupBy("component").agg(F.count("*").alias("size"))
    members = likely.join(sizes, "component").select(F.col("v").alias("id"), F.col("component").alias("k"), "size")

    def whole(batches):
        for k, size, doc, text in rows_of(batches):
            h = shingle_hashes((text or "").encode().lower(), width)
            if len(h):
                yield k, size, doc, len(h), count_vector(h).tobytes(), h.tobytes()

    sets = materialise(map_rows(docs.join(members.hint("merge"), "id").select("k", "size", "id", "text"), whole, "k bigint, size bigint, id bigint, n int, counts binary, hashes binary"))
    edges = forests(sets.where(F.col("size") <= BLOCK).withColumns(dict.fromkeys(["i", "j", "own"], F.lit(0))).select(*FIELDS), percent)
    large = sets.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        edges = edges.unionByName(large_units(large, percent))
    linked_ids = components(edges)

    named = classes.join(linked_ids.withColumnRenamed("v", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("least"))
    placed = made.select("id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return placed.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"))


def keep_one(df: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of its component, and those with a null id."""
    found = join(df, percent, width, id_col, text_col)
    dropped = materialise(found.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct())
    return df.join(dropped, id_col, "left_anti")


#: The same for DuckDB.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], chr(32)) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s AS x JOIN s AS y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, u) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.u FROM r JOIN e ON e.a = r.v)
SELECT documents.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.u)::BIGINT AS component_id
FROM documents JOIN r ON r.v = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
GROUP BY documents.doc_id
"""
