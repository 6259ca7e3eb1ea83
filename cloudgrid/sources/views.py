"""Clouds over ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.importance import add_importance
from ..functions.schema import mark_axes


def _cloud(df: DataFrame, keys: list[str]) -> DataFrame:
    return add_importance(mark_axes(df), keys)


def lineitem_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x price, y quantity, z days since 1970 of shipping."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    df = t.select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), days.cast("double").alias("z"), *t.columns)
    return _cloud(df, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


def events_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x user, y value, z seconds since 2024."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    return _cloud(t.select(F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), seconds.alias("z"), "event_id", "user_id", "event_type"), ["event_id"])


def embeddings_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three elements of each vector."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return _cloud(t.select(*(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")), "vec_id", "label"), ["vec_id"])
