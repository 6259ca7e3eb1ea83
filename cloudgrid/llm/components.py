"""Connected components of an edge table, by alternating stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): each round
links every vertex's larger neighbours to its smallest one, then every vertex and
its smaller neighbours to the smallest. Edges never grow in number by more than
the vertices, and rounds are about the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: A vertex with more edges than this, and than a share of all edges, is looked up in a broadcast table instead of a shuffled one.
BUSY, BUSY_SHARE = 1000, 1 / 500


def _with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """rows (v, u) with m of least (v, n, m). Busy vertices are at most two divided by BUSY_SHARE, however large the graph."""
    busy = F.col("n") > max(BUSY, int(n_edges * BUSY_SHARE))
    tagged = rows.join(F.broadcast(least.where(busy).select("v", F.col("m").alias("busy_m"))), "v", "left")
    return tagged.where("busy_m is null").select("v", "u").join(least.where(~busy).select("v", "m"), "v").unionByName(tagged.where("busy_m is not null").select("v", "u", F.col("busy_m").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of edges (a, b): component is its smallest reachable vertex.

    Vertices are bigints; loops, repeated and reversed edges are allowed. A round
    is written to the shared folder, and rounds end when none changes an edge. An
    empty table has no components.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    n = now.count()
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("m")).select("v", "n", F.least("v", "m").alias("m"))
        large = materialise(_with_least(both.where("u > v"), least, n).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        least = large.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("m"))
        joined = _with_least(large, least, n)
        after = materialise(joined.select("v", F.col("m").alias("u")).unionByName(joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct())
        # edges (v, u) with every u a root and one edge for each v: nothing can change
        state = after.agg(F.count("*").alias("n"), F.count_distinct("v").alias("vs")).first()
        n = state["n"]
        if n == state["vs"] and after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return after.select("v", F.col("u").alias("component")).unionByName(after.select(F.col("u").alias("v"), F.col("u").alias("component")).distinct())
        now = after
