"""The importance of points: uniform in [0, 1), with 24 bits so that every value is an exact float below 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import DIMENSION, PREFIX, dimensions, metadata, role

STEPS = 1 << 24


def hashed(*keys: str) -> Column:
    """From integer key columns, alike in every engine that has MD5."""
    digits = F.substring(F.md5(F.concat_ws("-", *keys)), 1, 6)
    return (F.conv(digits, 16, 10).cast("bigint") / F.lit(float(STEPS))).cast("float")


def random(seed: int | None = None) -> Column:
    """From Spark's generator; must be stored before it is queried twice."""
    return (F.floor(F.rand(seed) * STEPS) / F.lit(float(STEPS))).cast("float")


def add_importance(df: DataFrame, keys: list[str] | None = None, seed: int | None = None, name: str = "i") -> DataFrame:
    """df with the importance as its first column and last dimension; df itself if it has a column of that name."""
    if name in df.columns:
        return df
    place = len(dimensions(df.schema)) + 1
    made = hashed(*keys) if keys else random(seed)
    return df.select(made.alias(name, metadata=metadata(place, importance="random")), *df.columns)


def has_role(df: DataFrame, column: str) -> bool:
    return role(df.schema[column], DIMENSION) is not None or PREFIX + DIMENSION in (df.schema[column].metadata or {})
