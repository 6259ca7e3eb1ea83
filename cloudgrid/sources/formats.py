"""Formats by file extension, and conversion to Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.importance import add_importance
from ..functions.points import is_floating, without_negative_zero
from ..functions.schema import dimensions, mark_axes, with_roles
from .files import exists
from .ipc import IpcDataSource
from .las import LasDataSource
from .ply import PlyDataSource

#: Reader of each extension. Fixed values.
READERS = {"las": "las", "laz": "las", "ply": "ply", "arrow": "arrow", "ipc": "arrow", "parquet": "parquet"}


def format_of(path: str) -> str:
    extension = path.rstrip("/").rpartition(".")[2].lower()
    if extension not in READERS:
        raise ValueError(f"unknown extension of {path}; known: {', '.join(READERS)}")
    return READERS[extension]


def register(spark: SparkSession) -> None:
    """Make the readers known to a session."""
    for source in (LasDataSource, PlyDataSource, IpcDataSource):
        spark.dataSource.register(source)


def normalised(df: DataFrame) -> DataFrame:
    """Without negative zeros in dimensions, which compare unlike 0 elsewhere; x, y, z are marked if nothing is."""
    if not dimensions(df.schema) and {"x", "y", "z"} <= set(df.columns):
        df = mark_axes(df)
    floating = [d for d in dimensions(df.schema) if is_floating(df.schema[d].dataType)]
    made = {d: without_negative_zero(df[d]).cast(df.schema[d].dataType) for d in floating}
    return with_roles(df.withColumns(made), df.schema) if made else df


def read(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """The rows of files of one format; schemas must agree."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = {format_of(p) for p in paths}
    if len(kinds) != 1:
        raise ValueError(f"files of one format are needed, not {sorted(kinds)}")
    kind = kinds.pop()
    if kind == "parquet":
        return normalised(spark.read.parquet(*paths))
    register(spark)
    return normalised(spark.read.format(kind).options(**options).load("\n".join(paths)) if len(paths) == 1 else spark.read.format(kind).options(**options, path="\n".join(paths)).load())


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, by: Sequence[str] = ()) -> None:
    """Parquet with ZSTD; dimensions, which hardly repeat, without a dictionary."""
    out = df.write.option("compression", "zstd").mode("overwrite" if overwrite else "error")
    for d in dimensions(df.schema):
        out = out.option(f"parquet.enable.dictionary#{d}", "false")
    (out.partitionBy(*by) if by else out).parquet(path)


def convert(spark: SparkSession, sources: str | Sequence[str], target: str | None = None, importance: bool = False, overwrite: bool = False, seed: int | None = None) -> str | None:
    """Files of any known format to one Parquet folder; None, and nothing done, if it is there already.

    Without a target, it stands beside the first source with the extension .parquet.
    """
    sources = [sources] if isinstance(sources, str) else list(sources)
    target = target or sources[0].rpartition(".")[0] + ".parquet"
    if exists(target) and not overwrite:
        return None
    df = read(spark, sources)
    write_parquet(add_importance(df, seed=seed) if importance else df, target, overwrite)
    return target
