"""Point algebra on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def from_slice(values: Sequence, n: int) -> tuple:
    """The first n values, with zeros for missing ones."""
    return tuple(values[:n]) + (0,) * max(0, n - len(values))


def component(df: DataFrame, dims: Sequence[str], k: int) -> Column:
    """The k-th dimension, or 0 where there is none."""
    return F.col(dims[k]) if k < len(dims) else F.lit(0)


def add(p: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    return [a + b for a, b in zip(p, q, strict=True)]


def subtract(p: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    return [a - b for a, b in zip(p, q, strict=True)]


def multiply(p: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    return [a * b for a, b in zip(p, q, strict=True)]


def divide(p: Sequence[Column], q: Sequence[Column], whole: bool = False) -> list[Column]:
    """Element by element; whole: of integers, cut towards zero."""
    if whole:
        return [F.call_function("div", a, b) for a, b in zip(p, q, strict=True)]
    return [a / b for a, b in zip(p, q, strict=True)]


def distance_2(p: Sequence[Column], q: Sequence[Column]) -> Column:
    first, *rest = [(a - b) * (a - b) for a, b in zip(p, q, strict=True)]
    return sum(rest, first)


def cast_dimensions(df: DataFrame, dims: Sequence[str], kind: str, n: int) -> DataFrame:
    """x, y, z, i as kind: dimensions beyond the n-th dropped, missing ones 0; integers are cut towards zero."""
    made = [component(df, dims, k).cast(kind).alias(name) for k, name in enumerate("xyzi"[:n])]
    return df.select(*made)


def without_negative_zero(c: Column) -> Column:
    return c + F.lit(0.0)


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))
