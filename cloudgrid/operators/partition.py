"""Random fractions and splits of a cloud, fixed by a row's importance or keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.importance import hashed


def roll(keys: list[str], salt: str = "part") -> Column:
    """A number in [0, 1) from key columns, independent of their importance."""
    return hashed(*keys, *([F.lit(salt)] if salt else [])).cast("double")


def fraction(df: DataFrame, keys: list[str], start: float = 0.0, end: float = 1.0, salt: str = "part") -> DataFrame:
    """The rows whose number is in [start, end); disjoint ranges give disjoint rows, [0, 1) gives all."""
    if not 0 <= start <= end <= 1:
        raise ValueError("0 <= start <= end <= 1")
    r = roll(keys, salt)
    return df.where((r >= start) & (r < end))


def worker(keys: list[str], n: int, salt: str = "part") -> Column:
    """The worker, 0 to n - 1, that a row falls to: equal consecutive ranges of its number."""
    return F.floor(roll(keys, salt) * n).cast("int")


def split(df: DataFrame, keys: list[str], n: int, salt: str = "part") -> list[DataFrame]:
    return [fraction(df, keys, k / n, (k + 1) / n, salt) for k in range(n)]


def spread(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Rows dealt to n partitions by a hash of their keys."""
    return df.repartition(n, *keys)
