"""Axis-aligned boxes: of numbers, or of columns where the same formulas give expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = math.inf


def _columns(values) -> bool:
    return any(isinstance(v, Column) for v in values)


def _lit(v):
    return v if isinstance(v, Column) else F.lit(float(v))


def _least(*vs):
    return F.least(*map(_lit, vs)) if _columns(vs) else min(vs)


def _greatest(*vs):
    return F.greatest(*map(_lit, vs)) if _columns(vs) else max(vs)


def _choose(test, yes, no):
    return F.when(test, yes).otherwise(no) if isinstance(test, Column) else (yes if test else no)


def _all(tests):
    return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class Box:
    """Lower and upper corners. The empty box has infinite corners the wrong way round and is neutral in merge()."""

    lower: tuple
    upper: tuple

    def __post_init__(self):
        if len(self.lower) != len(self.upper):
            raise ValueError("corners of different dimensions")

    @classmethod
    def from_point(cls, p: Sequence) -> Box:
        return cls(tuple(p), tuple(p))

    @classmethod
    def from_corners(cls, p: Sequence, q: Sequence) -> Box:
        """Corners in any order."""
        return cls(tuple(map(_least, p, q)), tuple(map(_greatest, p, q)))

    @classmethod
    def empty(cls, n: int) -> Box:
        return cls((INF,) * n, (-INF,) * n)

    @classmethod
    def unbounded(cls, n: int) -> Box:
        return cls((-INF,) * n, (INF,) * n)

    @classmethod
    def from_points(cls, points: Iterable[Sequence]) -> Box:
        points = [tuple(p) for p in points]
        return reduce(Box.add_point, points, cls.empty(len(points[0]) if points else 0))

    @classmethod
    def of_columns(cls, dims: Sequence[str], low: str = "lo_", high: str = "hi_") -> Box:
        """The box in columns lo_x, ..., hi_x, ..."""
        return cls(tuple(F.col(low + d) for d in dims), tuple(F.col(high + d) for d in dims))

    @property
    def n(self) -> int:
        return len(self.lower)

    def add_point(self, p: Sequence) -> Box:
        return Box(tuple(map(_least, self.lower, p)), tuple(map(_greatest, self.upper, p)))

    def merged(self, other: Box) -> Box:
        return Box(tuple(map(_least, self.lower, other.lower)), tuple(map(_greatest, self.upper, other.upper)))

    def contains_point(self, p: Sequence):
        """Both faces belong to the box."""
        return _all((v >= a) & (v <= b) for a, v, b in zip(self.lower, p, self.upper, strict=True))

    def contains_box(self, other: Box):
        return _all((c >= a) & (d <= b) for a, b, c, d in zip(self.lower, self.upper, other.lower, other.upper, strict=True))

    def intersects(self, other: Box):
        """Touching boxes intersect."""
        return _all((d >= a) & (c <= b) for a, b, c, d in zip(self.lower, self.upper, other.lower, other.upper, strict=True))

    def _extents(self) -> list:
        return [_greatest(b - a, 0.0) for a, b in zip(self.lower, self.upper, strict=True)]

    def area(self):
        return reduce(lambda a, b: a * b, self._extents())

    def perimeter(self):
        return reduce(lambda a, b: a + b, self._extents())

    def intersection_area(self, other: Box):
        low, high = map(_greatest, self.lower, other.lower), map(_least, self.upper, other.upper)
        return Box(tuple(low), tuple(high)).area()

    def distance_2(self, p: Sequence):
        """Squared distance from a point, 0 inside."""
        gaps = [_greatest(a - v, 0.0, v - b) for a, v, b in zip(self.lower, p, self.upper, strict=True)]
        return sum(g * g for g in gaps[1:]) + gaps[0] * gaps[0] if len(gaps) > 1 else gaps[0] * gaps[0]

    def min_max_dist_2(self, p: Sequence):
        """Squared distance within which a box with a point on each face surely has one (Roussopoulos et al., 1995)."""
        near, far = [], []
        for a, v, b in zip(self.lower, p, self.upper, strict=True):
            middle = (a + b) / 2
            close, away = v - _choose(v <= middle, a, b), v - _choose(v >= middle, a, b)
            near.append(close * close)
            far.append(away * away)
        totals = []
        for k in range(self.n):
            terms = [near[i] if i == k else far[i] for i in range(self.n)]
            totals.append(reduce(lambda x, y: x + y, terms))
        return _least(*totals) if self.n > 1 else totals[0]

    def center(self) -> tuple:
        return tuple((a + b) / 2 for a, b in zip(self.lower, self.upper, strict=True))

    def cast(self, n: int) -> Box:
        """To n dimensions: further ones are dropped, missing ones unbounded."""
        more = max(0, n - self.n)
        return Box(self.lower[:n] + (-INF,) * more, self.upper[:n] + (INF,) * more)

    def grown(self, by: float) -> Box:
        return Box(tuple(a - by for a in self.lower), tuple(b + by for b in self.upper))


def sort_boxes(df: DataFrame, axis: str) -> DataFrame:
    """Boxes in order of their lower bound on an axis."""
    return df.orderBy("lo_" + axis)


def partition_boxes(df: DataFrame, axis: str, k: int) -> DataFrame:
    """Boxes with side 0 for the k with the smallest lower bounds on an axis, 1 for the others.

    The k-th bound is found by a top-k, then only the boxes right at it are ranked.
    """
    c = "lo_" + axis
    edge = df.orderBy(c).limit(k).agg(F.max(c).alias("edge"), F.count("*").alias("n"))
    below = df.crossJoin(F.broadcast(edge)).agg(F.count_if(F.col(c) < F.col("edge")).alias("below"))
    from pyspark.sql import Window

    marked = df.crossJoin(F.broadcast(edge)).crossJoin(F.broadcast(below))
    ranked = marked.where(F.col(c) == F.col("edge")).withColumn("r", F.row_number().over(Window.partitionBy(c).orderBy(*[F.col(x) for x in df.columns])))
    at = ranked.withColumn("side", F.when(F.col("r") <= k - F.col("below"), 0).otherwise(1)).select(*df.columns, "side")
    off = marked.where((F.col(c) != F.col("edge")) | F.col("edge").isNull()).withColumn("side", F.when(F.col(c) < F.col("edge"), 0).otherwise(1))
    return off.select(*df.columns, "side").unionByName(at)


def parse_bounds(bounds: str | Sequence[float] | None, p: float | None = None, n: int = 4) -> Box:
    """The box of a query: bounds in two halves, lower then upper, and a sampling share p.

    Missing dimensions are unbounded. The last of four is the importance: [0, p)
    if p is given, else as in bounds, else [0, 1).
    """
    values = [float(v) for v in bounds.split(",")] if isinstance(bounds, str) and bounds.strip() else list(bounds or [])
    if len(values) % 2 or len(values) > 2 * n:
        raise ValueError(f"bounds need an even number of values, {2 * n} at most: {values}")
    half = len(values) // 2
    box = Box(tuple(values[:half]), tuple(values[half:])).cast(n)
    if p is not None:
        return Box((*box.lower[:-1], 0.0), (*box.upper[:-1], float(p)))
    if half < n:
        return Box((*box.lower[:-1], 0.0), (*box.upper[:-1], 1.0))
    return box
