"""A regular grid over space and importance."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.box import Box

NAMES = ("x", "y", "z", "i")


@dataclass(frozen=True)
class Grid:
    """Steps by dimension; a dimension without a positive step isn't cut."""

    x: float | None = None
    y: float | None = None
    z: float | None = None
    i: float | None = None

    @classmethod
    def parse(cls, delta: str | list[float] | None) -> Grid:
        values = [float(v) for v in delta.split(",")] if isinstance(delta, str) and delta else list(delta or [])
        if len(values) > 4:
            raise ValueError("a grid has four steps at most")
        return cls(**dict(zip(NAMES, values)))

    def steps(self) -> dict[str, float]:
        return {n: s for n in NAMES if (s := getattr(self, n)) is not None and s > 0}

    def cell_columns(self) -> list[str]:
        return ["c" + n for n in self.steps()]

    def with_cells(self, df: DataFrame) -> DataFrame:
        """Adds cx, cy, cz, ci: floor(value / step); each point is in one cell, none is lost on an edge."""
        return df.withColumns({"c" + n: cell(F.col(n), s) for n, s in self.steps().items()})

    def cell_id(self) -> Column:
        """The lower corner of the cell in cx, ... as text, nine digits after the point."""
        corners = [F.format_string("%.9f", F.col("c" + n) * F.lit(s)) for n, s in self.steps().items()]
        return F.concat_ws("-", *corners)

    def cell_range(self, name: str, low: float, high: float) -> tuple[int, int] | None:
        """First and last cell that values in [low, high) can be in; None where unbounded."""
        step = self.steps().get(name)
        if step is None or math.isinf(low) or math.isinf(high):
            return None
        return math.floor(low / step), math.floor(high / step)

    def cells(self, box: Box) -> list[tuple[int, ...]]:
        """All cells from floor(low / step) to below ceil(high / step); a dimension without a step has cell 0."""
        ranges = [range(math.floor(a / s), math.ceil(b / s)) if (s := self.steps().get(n)) else range(1) for n, a, b in zip(NAMES, box.lower, box.upper)]
        return list(itertools.product(*ranges))

    def cell_boxes(self, boxes: DataFrame) -> DataFrame:
        """The same for a DataFrame of boxes lo_x, hi_x, ...: one row for each cell, with cx, ... added."""
        for n, s in self.steps().items():
            last = F.ceil(F.col("hi_" + n) / F.lit(s)) - 1
            first = F.floor(F.col("lo_" + n) / F.lit(s))
            boxes = boxes.withColumn("c" + n, F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
        return boxes


def cell(c: Column, step: float) -> Column:
    return F.floor(c.cast("double") / F.lit(float(step)))
