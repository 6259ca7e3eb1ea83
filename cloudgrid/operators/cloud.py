"""Point clouds: a DataFrame with dimension roles, and the queries on it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import importance as imp
from ..functions.box import Box, parse_bounds
from ..functions.points import cast_dimensions, is_floating
from ..functions.schema import dimensions, importance_column, mark_axes, validate, with_roles
from .grid import Grid

_LIMITS = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def half_open(name: str, kind: T.DataType, low: float, high: float) -> list[Column]:
    """low <= value < high with literals of the column's own type, so that Parquet can use them; no test for an infinite bound."""
    c, found = F.col(name), []
    for bound, at_least in ((low, True), (high, False)):
        if math.isinf(bound):
            if (bound > 0) == at_least:
                return [F.lit(False)]
            continue
        if is_floating(kind):
            value = F.lit(bound).cast(kind)
        elif (bits := _LIMITS.get(kind.simpleString())) is not None:
            whole = math.ceil(bound)
            if not -(1 << bits) <= whole < 1 << bits:
                if (whole > 0) == at_least:
                    return [F.lit(False)]
                continue
            value = F.lit(whole).cast(kind)
        else:
            value = F.lit(bound)
        found.append(c >= value if at_least else c < value)
    return found


@dataclass(frozen=True)
class PointCloud:
    """df with its dimensions marked; grid: the cells that df has columns of, if any."""

    df: DataFrame
    grid: Grid | None = None

    def __post_init__(self):
        validate(self.df.schema)

    @classmethod
    def of(cls, df: DataFrame, axes: tuple[str, str, str] = ("x", "y", "z"), importance: str | None = None) -> PointCloud:
        return cls(mark_axes(df, axes, importance))

    @property
    def dims(self) -> list[str]:
        return dimensions(self.df.schema)

    @property
    def importance(self) -> str | None:
        return importance_column(self.df.schema)

    def num_points(self) -> int:
        return self.df.count()

    def bounds_frame(self, by: Sequence[str] = ()) -> DataFrame:
        """lo_x, hi_x, ... and n_points, of the whole cloud or for each group."""
        aggs = [f(F.col(d).cast("double")).alias(p + d) for d in self.dims for f, p in ((F.min, "lo_"), (F.max, "hi_"))]
        return self.df.groupBy(*by).agg(*aggs, F.count("*").alias("n_points"))

    def bounds(self) -> Box:
        row = self.bounds_frame().first()
        if not row["n_points"]:
            return Box.empty(len(self.dims))
        return Box(tuple(row["lo_" + d] for d in self.dims), tuple(row["hi_" + d] for d in self.dims))

    def predicate(self, box: Box) -> Column | None:
        """The box's half-open test, with the cells it can touch where the cloud has a grid.

        Cells of a float column are taken from the bound as that column holds it.
        """
        tests: list[Column] = []
        for d, low, high in zip(self.dims, box.lower, box.upper):
            kind = self.df.schema[d].dataType
            tests += half_open(d, kind, low, high)
            if self.grid and "c" + d in self.df.columns:
                if isinstance(kind, T.FloatType):
                    low, high = float(np.float32(low)), float(np.float32(high))
                if (cells := self.grid.cell_range(d, low, high)) is not None:
                    tests.append(F.col("c" + d).between(*cells))
        return reduce(lambda a, b: a & b, tests) if tests else None

    def filter_box(self, box: Box) -> PointCloud:
        test = self.predicate(box)
        return self if test is None else replace(self, df=self.df.where(test))

    def query(self, bounds: str | Sequence[float] | None = None, p: float | None = None, budget: int | None = None) -> DataFrame:
        """All columns of the points in a box and below importance p, in no order.

        budget: at most so many of them, those of least importance, which are a
        sample of the box.
        """
        n = len(self.dims)
        found = self.filter_box(parse_bounds(bounds, p, n) if self.importance else Box(*_plain(bounds, n))).df
        if budget is not None:
            found = found.orderBy(self.importance or F.lit(0)).limit(budget)
        return found

    def sample(self, p: float) -> DataFrame:
        return self.query(p=p)

    def contains(self, box: Box) -> Column:
        """The closed test for each point."""
        return box.contains_point([F.col(d) for d in self.dims[: box.n]])

    def points(self, kind: str = "double", n: int | None = None) -> DataFrame:
        """The dimensions alone, cast, zeros for missing ones."""
        return cast_dimensions(self.df, self.dims, kind, n or len(self.dims))

    def project(self) -> DataFrame:
        return self.df.select(*self.dims)

    def with_importance(self, keys: list[str] | None = None, seed: int | None = None) -> PointCloud:
        return replace(self, df=imp.add_importance(self.df, keys, seed))

    def with_grid(self, grid: Grid) -> PointCloud:
        return PointCloud(grid.with_cells(self.df), grid)

    def append(self, other: DataFrame) -> PointCloud:
        """The union, by column name; the roles are this cloud's."""
        return replace(self, df=with_roles(self.df.unionByName(other), self.df.schema))

    def with_columns(self, columns: dict[str, Column]) -> PointCloud:
        """Computed columns in place of old ones, whose roles they keep."""
        return replace(self, df=with_roles(self.df.withColumns(columns), self.df.schema))

    def register(self, name: str) -> None:
        self.df.createOrReplaceTempView(name)


def _plain(bounds, n: int) -> tuple[tuple, tuple]:
    box = parse_bounds(bounds, None, n)
    half = len([v for v in (bounds.split(",") if isinstance(bounds, str) else bounds or []) if str(v).strip()]) // 2
    cut = Box(box.lower[:half], box.upper[:half]).cast(n)
    return cut.lower, cut.upper
