"""PLY files: the vertex element, in ASCII or binary."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions.schema import metadata
from .files import open_input, open_output
from .las import CHUNK, Split, paths_of

#: PLY scalar types: numpy code and Spark type. Fixed values.
TYPES = {
    "char": ("i1", T.ByteType()),
    "uchar": ("u1", T.ShortType()),
    "short": ("i2", T.ShortType()),
    "ushort": ("u2", T.IntegerType()),
    "int": ("i4", T.IntegerType()),
    "uint": ("u4", T.LongType()),
    "float": ("f4", T.FloatType()),
    "double": ("f8", T.DoubleType()),
}
_ALIASES = {"int8": "char", "uint8": "uchar", "int16": "short", "uint16": "ushort", "int32": "int", "uint32": "uint", "float32": "float", "float64": "double"}
#: What a Spark column is written as; PLY has no 64-bit integers, so these become doubles.
WRITTEN = {"tinyint": "char", "smallint": "short", "int": "int", "bigint": "double", "float": "float", "double": "double", "boolean": "uchar"}


@dataclass
class PlyHeader:
    kind: str  # ascii, binary_little_endian or binary_big_endian
    skip: int  # bytes, or lines in ASCII, from the header's end to the first vertex
    count: int
    fields: list[tuple[str, str]]
    size: int  # of the header in bytes

    @property
    def order(self) -> str:
        return ">" if self.kind.endswith("big_endian") else "<"

    def dtype(self) -> np.dtype:
        return np.dtype([(n, self.order + TYPES[t][0]) for n, t in self.fields])

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, TYPES[t][1], False, metadata("xyz".index(n) + 1, n) if n in ("x", "y", "z") else {}) for n, t in self.fields])

    @classmethod
    def read(cls, file) -> PlyHeader:
        if file.readline().strip() != b"ply":
            raise ValueError("no PLY file")
        kind, elements, size = "", [], 0
        while (line := file.readline()) and (words := line.decode("latin-1").split()) != ["end_header"]:
            if not words or words[0] in ("comment", "obj_info"):
                continue
            if words[0] == "format":
                kind = words[1]
            elif words[0] == "element":
                elements.append((words[1], int(words[2]), []))
            elif words[0] == "property":
                elements[-1][2].append((words[-1], "list" if words[1] == "list" else _ALIASES.get(words[1], words[1])))
        size, skip = file.tell(), 0
        for name, count, fields in elements:
            listed = [n for n, t in fields if t == "list"]
            if name == "vertex":
                if listed:
                    raise ValueError(f"list properties of vertices aren't supported: {listed}")
                return cls(kind, skip, count, fields, size)
            if listed and kind != "ascii":
                raise ValueError(f"can't skip element {name}, which has lists")
            skip += count if kind == "ascii" else count * sum(np.dtype(TYPES[t][0]).itemsize for _, t in fields)
        raise ValueError("no vertex element")


class PlyReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.paths = schema, paths_of(options)

    def partitions(self):
        out = []
        for path in self.paths:
            with open_input(path) as f:
                h = PlyHeader.read(f)
            step = CHUNK if h.kind != "ascii" else max(1, h.count)  # lines have no fixed places
            out += [Split(path, at, min(step, h.count - at)) for at in range(0, h.count, step)]
        return out or [Split(self.paths[0], 0, 0)]

    def read(self, split):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        with open_input(split.path) as f:
            h = PlyHeader.read(f)
            dtype = h.dtype()
            if h.kind != "ascii":
                f.seek(h.size + h.skip + split.first * dtype.itemsize)
                found = [np.frombuffer(f.read(split.count * dtype.itemsize), dtype)]
            else:
                lines = (line for k, line in enumerate(io.TextIOWrapper(f, "ascii")) if k >= h.skip)
                found = _ascii(lines, dtype.newbyteorder("="), split.count)
            for raw in found:
                if len(raw):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(raw[x.name]).astype(raw[x.name].dtype.newbyteorder("="))).cast(x.type) for x in arrow], schema=arrow)


def _ascii(lines, dtype, count: int):
    import itertools

    while count > 0 and (some := list(itertools.islice(lines, min(CHUNK, count)))):
        count -= len(some)
        rows = [tuple(line.split()) for line in some]
        out = np.empty(len(rows), dtype)
        for name, column in zip(dtype.names, zip(*rows)):
            out[name] = np.array(column, dtype=dtype[name] if dtype[name].kind == "f" else np.int64)
        yield out


class PlyDataSource(DataSource):
    """spark.read.format("ply").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        found = []
        for path in paths_of(self.options):
            with open_input(path) as f:
                found.append(PlyHeader.read(f).schema())
        if any(s != found[0] for s in found):
            raise ValueError("files of different schemas")
        return found[0]

    def reader(self, schema):
        return PlyReader(schema, self.options)


def write_ply(df: DataFrame, path: str, binary: bool = False) -> int:
    """Write the rows as vertices of one file; returns the points.

    Executors encode, a block for each Arrow batch; the driver only passes blocks on, a partition at a time.
    """
    kinds = [(f.name, WRITTEN.get(f.dataType.simpleString())) for f in df.schema]
    if odd := [n for n, k in kinds if k is None]:
        raise ValueError(f"columns that PLY can't hold: {odd}")
    df, dtype = df.persist(), np.dtype([(n, "<" + TYPES[k][0]) for n, k in kinds])

    def encode(batches):
        for b in batches:
            if binary:
                raw = np.empty(b.num_rows, dtype)
                for k, n in enumerate(dtype.names):
                    raw[n] = b.column(k).to_numpy(zero_copy_only=False)
                body = raw.tobytes()
            else:
                text = [[repr(float(v)) if kind in ("float", "double") else str(int(v)) for v in b.column(k).to_pylist()] for k, (_, kind) in enumerate(kinds)]
                body = "".join(" ".join(row) + "\n" for row in zip(*text)).encode()
            yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["body"])

    try:
        count = df.count()
        head = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", f"element vertex {count}", *(f"property {k} {n}" for n, k in kinds), "end_header", ""]
        with open_output(path) as out:
            out.write("\n".join(head).encode())
            for block in df.mapInArrow(encode, "body binary").toLocalIterator(prefetchPartitions=True):
                out.write(block["body"])
    finally:
        df.unpersist()
    return count
