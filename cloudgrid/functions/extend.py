"""Functions of one's own in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_function(spark: SparkSession, name: str, fn: Callable, returns: str) -> None:
    """Make fn, from pandas Series to a Series of type returns, a function of SQL; batches of rows cross to Python through Arrow."""
    spark.udf.register(name, F.pandas_udf(fn, returns))
