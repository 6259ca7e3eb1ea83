"""Roles of columns, kept in field metadata.

A dimension column holds its place among the dimensions, a location column its
axis, the importance column how it was made. Metadata survives filters, joins
and Parquet, but not computed columns: with_roles() puts it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "cloudgrid:"
DIMENSION, LOCATION, IMPORTANCE = "dimension", "location", "importance"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class SchemaError(ValueError):
    pass


def role(field: T.StructField, name: str) -> str | None:
    """A role's value, whatever prefix wrote it."""
    return next((str(v) for k, v in (field.metadata or {}).items() if k.rpartition(":")[2] == name), None)


def dimensions(schema: T.StructType) -> list[str]:
    """Dimension columns by their place; places are compared as text, as they are stored."""
    found = [(role(f, DIMENSION), f.name) for f in schema if role(f, DIMENSION) is not None]
    return [name for _, name in sorted(found, key=lambda x: x[0])]


def importance_column(schema: T.StructType) -> str | None:
    return next((f.name for f in schema if role(f, DIMENSION) is not None and role(f, IMPORTANCE) is not None), None)


def validate(schema: T.StructType) -> None:
    """A cloud needs three numeric dimensions at least."""
    dims = dimensions(schema)
    if len(dims) < 3:
        raise SchemaError(f"a point cloud needs three dimensions, found {dims}")
    odd = [d for d in dims if not isinstance(schema[d].dataType, NUMERIC)]
    if odd:
        raise SchemaError(f"dimensions must be numeric: {odd}")


def metadata(place: int, axis: str | None = None, importance: str | None = None) -> dict:
    found = {PREFIX + DIMENSION: str(place)}
    if axis:
        found[PREFIX + LOCATION] = axis
    if importance:
        found[PREFIX + IMPORTANCE] = importance
    return found


def with_roles(df: DataFrame, like: T.StructType) -> DataFrame:
    """df with the metadata of columns of the same name in like."""
    known = {f.name: f.metadata for f in like}
    return df.select(*(F.col(c).alias(c, metadata=known[c]) if known.get(c) else F.col(c) for c in df.columns))


def mark_axes(df: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), importance: str | None = None) -> DataFrame:
    """df with axes marked as the first dimensions, and importance as the next."""
    made = {c: metadata(k, c) for k, c in enumerate(axes, 1)}
    if importance:
        made[importance] = metadata(len(axes) + 1, importance="random")
    return df.select(*(F.col(c).alias(c, metadata=made[c]) if c in made else F.col(c) for c in df.columns))


def point_schema(kind: T.DataType, n: int) -> T.StructType:
    """The schema of bare points of n dimensions x, y, z, i."""
    if n > 4:
        raise SchemaError("points have four dimensions at most")
    fields = []
    for place, name in enumerate("xyzi"[:n], 1):
        fields.append(T.StructField(name, kind, False, metadata(place, name if name != "i" else None, "unknown" if name == "i" else None)))
    return T.StructType(fields)
