"""The block index: bounds and counts of each grid cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.box import Box
from .cloud import PointCloud


def build(cloud: PointCloud) -> DataFrame:
    """One row for each occupied cell: its cell columns, lo_*, hi_*, n_points. Partial aggregation keeps the shuffle to cells."""
    if not cloud.grid or not cloud.grid.cell_columns():
        return cloud.bounds_frame()
    return cloud.bounds_frame(cloud.grid.cell_columns())


def candidates(stats: DataFrame, box: Box, dims: list[str]) -> DataFrame:
    """Cells whose bounds touch the box."""
    return stats.where(Box.of_columns(dims[: box.n]).intersects(box))


def contained(stats: DataFrame, box: Box, dims: list[str]) -> DataFrame:
    """Cells whose points are all inside the half-open box."""
    inner = Box.of_columns(dims[: box.n])
    test = F.lit(True)
    for low, high, a, b in zip(inner.lower, inner.upper, box.lower, box.upper, strict=True):
        test = test & (low >= a) & (high < b)
    return stats.where(test)


def query(cloud: PointCloud, stats: DataFrame, box: Box) -> DataFrame:
    """The same rows as the cloud's own query: cells that can't hold any are left out by a semi-join first.

    Spark broadcasts the cells if they are few, and else joins by cell.
    """
    columns = cloud.grid.cell_columns() if cloud.grid else []
    test = cloud.predicate(box)
    found = cloud.df if test is None else cloud.df.where(test)
    if not columns:
        return found
    return found.join(candidates(stats, box, cloud.dims).select(*columns), columns, "left_semi").select(*cloud.df.columns)
