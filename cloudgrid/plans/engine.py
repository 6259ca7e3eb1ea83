"""Named collections: load, append, drop, index and query."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.box import parse_bounds
from ..functions.importance import add_importance
from ..functions.schema import dimensions, validate, with_roles
from ..operators import index
from ..operators.cloud import PointCloud
from ..operators.grid import Grid
from ..operators.partition import fraction
from ..sources import formats, ipc
from ..sources.files import shared_root


#: Where a store keeps its collections' descriptions.
CATALOG = "_collections"


class NotFound(KeyError):
    """No collection of that name."""


@dataclass
class Collection:
    path: str
    grid: Grid
    schema: object
    index_path: str | None = None
    owned: bool = True
    uris: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)


class Engine:
    """Collections are Parquet folders under store, clustered by cell and, within it, by importance.

    ci, of few values, is a partition column and prunes folders; the other cells
    are clustered, so that row-group statistics prune them without many small files.
    Each append is a folder of its own, and a collection's description lies beside
    its folders, so that Engine.open() finds it again.
    """

    def __init__(self, spark: SparkSession, store: str | None = None):
        self.spark = spark
        self.store = store or shared_root(spark)
        self.collections: dict[str, Collection] = {}

    @classmethod
    def open(cls, spark: SparkSession, store: str) -> Engine:
        """An engine with the collections that others have left in a store."""
        made = cls(spark, store)
        folder = made._hadoop(f"{store.rstrip('/')}/{CATALOG}")
        if folder[0].exists(folder[1]):
            for row in spark.read.option("wholetext", True).text(f"{store.rstrip('/')}/{CATALOG}").collect():  # one for each collection
                d = json.loads(row["value"])
                name = d.pop("name")
                made.collections[name] = Collection(**d | {"grid": Grid(**d["grid"]), "schema": StructType.fromJson(d["schema"])})
        return made

    def _save(self, name: str) -> None:
        """Describe a collection in the store, or remove its description."""
        fs, path = self._hadoop(f"{self.store.rstrip('/')}/{CATALOG}/{name}.json")
        if name not in self.collections:
            fs.delete(path, False)
            return
        d = vars(self.collections[name]) | {"name": name}
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(d | {"grid": d["grid"].steps(), "schema": d["schema"].jsonValue()}).encode()))
        out.close()

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _get(self, name: str) -> Collection:
        if name not in self.collections:
            raise NotFound(name)
        return self.collections[name]

    def _write(self, df: DataFrame, c: Collection, part: str) -> None:
        cells = c.grid.cell_columns()
        made = c.grid.with_cells(df)
        if cells:
            spread = [x for x in cells if x != "ci"] or cells
            # rebalanced, not only dealt by cell: a cell with very many points becomes several partitions
            made = made.hint("rebalance", *spread).sortWithinPartitions(*cells, *(["i"] if "i" in df.columns else []))
        out = made.write.mode("overwrite").option("compression", "zstd")
        for d in dimensions(df.schema):
            out = out.option(f"parquet.enable.dictionary#{d}", "false")
        (out.partitionBy("ci") if "ci" in cells else out).parquet(f"{c.path}/load_={part}")
        if part not in c.parts:
            c.parts.append(part)

    def load(self, uris: str | Sequence[str], collection: str = "default", delta: str | None = None, start: float = 0.0, end: float = 1.0, keys: list[str] | None = None, seed: int | None = None, store: str | None = None) -> PointCloud:
        """Read files, keep the fraction [start, end) of their rows, add the importance and store them by cell.

        keys: integer columns from which importance and fraction are derived;
        else both are random, and stored. Loading into a known collection appends.
        """
        uris = [u for u in uris.split(",") if u] if isinstance(uris, str) else list(uris)
        return self.append(self._part(formats.read(self.spark, uris), start, end, keys, seed), collection, delta, keys, seed, store, uris)

    def _part(self, df: DataFrame, start: float, end: float, keys, seed) -> DataFrame:
        if (start, end) == (0.0, 1.0):
            return df
        if keys:
            return fraction(df, keys, start, end)
        parts = [w for w in (start, end - start, 1.0 - end) if w > 0]
        return df.randomSplit(parts, seed if seed is not None else 0)[1 if start > 0 else 0]

    def append(self, data: DataFrame | bytes, collection: str = "default", delta: str | None = None, keys: list[str] | None = None, seed: int | None = None, store: str | None = None, uris: Sequence[str] = (), batch: str | None = None) -> PointCloud:
        """Store rows, given as a DataFrame or an Arrow IPC stream. The collection's index is dropped, as it is out of date.

        batch: a name for these rows; appending a batch again replaces it.
        """
        df = formats.normalised(ipc.from_stream(self.spark, data) if isinstance(data, bytes) else data)
        df = add_importance(df, keys, seed)
        validate(df.schema)
        c = self.collections.get(collection)
        if c is None:
            c = Collection(f"{(store or self.store).rstrip('/')}/{collection}-{uuid.uuid4().hex}", Grid.parse(delta), df.schema)
            self.collections[collection] = c
        elif set(df.columns) != set(c.schema.names):
            raise ValueError(f"collection {collection} has columns {c.schema.names}")
        self._write(with_roles(df.select(*c.schema.names), c.schema), c, f"batch-{batch}" if batch else f"part-{uuid.uuid4().hex}")
        c.index_path = None
        c.uris += uris
        self._save(collection)
        return self.cloud(collection)

    def cloud(self, collection: str = "default") -> PointCloud:
        c = self._get(collection)
        df = self.spark.read.option("basePath", c.path).parquet(*(f"{c.path}/load_={p}" for p in c.parts))
        names = [n for n in c.schema.names if n in df.columns]
        cells = [F.col(x).cast("bigint").alias(x) if x != "ci" else F.col(x) for x in c.grid.cell_columns()]
        return PointCloud(with_roles(df.select(*names, *cells), c.schema), c.grid)

    def points(self, bounds: str | Sequence[float] | None = None, p: float | None = None, collection: str = "default", budget: int | None = None) -> DataFrame:
        """The columns of the collection for points in the box; an empty result keeps its schema."""
        c, cloud = self._get(collection), self.cloud(collection)
        if c.index_path and budget is None:
            box = parse_bounds(bounds, p, len(cloud.dims))
            found = index.query(cloud, self.spark.read.parquet(c.index_path), box)
        else:
            found = cloud.query(bounds, p, budget)
        return found.select(*c.schema.names)

    def points_stream(self, *args, **options) -> bytes:
        return ipc.to_stream(self.points(*args, **options))

    def build_index(self, collection: str = "default") -> DataFrame:
        """Bounds and counts by cell, stored beside the collection."""
        c = self._get(collection)
        path = f"{c.path}-index-{uuid.uuid4().hex}"
        index.build(self.cloud(collection)).write.parquet(path)
        c.index_path = path
        self._save(collection)
        return self.spark.read.parquet(path)

    def drop_index(self, collection: str | None = None) -> None:
        for name in [collection] if collection else list(self.collections):
            c = self._get(name)
            if c.index_path:
                self._delete(c.index_path)
                c.index_path = None
                self._save(name)

    def _delete(self, path: str) -> None:
        fs, target = self._hadoop(path)
        fs.delete(target, True)

    def drop(self, collection: str = "default") -> None:
        """Forget a collection and delete the folders that it made; an unknown one is no error."""
        c = self.collections.pop(collection, None)
        self._save(collection)
        if c and c.owned:
            self._delete(c.path)
            if c.index_path:
                self._delete(c.index_path)

    def sql(self, query: str) -> DataFrame:
        """Spark SQL over all collections as views of their names."""
        for name in self.collections:
            self.cloud(name).register(name)
        return self.spark.sql(query)

    def status(self) -> dict:
        """Collections with their paths, steps and whether they have an index; executors are the cluster's business."""
        return {n: {"path": c.path, "grid": c.grid.steps(), "columns": list(c.schema.names), "indexed": bool(c.index_path), "uris": list(c.uris)} for n, c in self.collections.items()}
