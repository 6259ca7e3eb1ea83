"""Arrow IPC files and streams."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..functions.schema import PREFIX
from .files import open_input, open_output
from .las import Split, paths_of

_UNSIGNED = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}


def spark_schema(schema: pa.Schema) -> T.StructType:
    """The Spark schema, unsigned integers one size up, roles from the fields' metadata."""
    plain = pa.schema([pa.field(f.name, _UNSIGNED.get(f.type, f.type), f.nullable) for f in schema])
    made = from_arrow_schema(plain)
    for mine, theirs in zip(made, schema):
        roles = {k.decode(): v.decode() for k, v in (theirs.metadata or {}).items()}
        mine.metadata = {PREFIX + k.rpartition(":")[2]: v for k, v in roles.items() if k.rpartition(":")[2] in ("dimension", "location", "importance")}
    return made


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(a.name, a.type, a.nullable, {k: str(v) for k, v in f.metadata.items()}) for a, f in zip(to_arrow_schema(schema), schema)])


def open_reader(file):
    """A reader of batches for the file or the stream format."""
    lead = file.read(6)
    file.seek(0)
    if lead == b"ARROW1":
        whole = pa.ipc.open_file(file)
        return whole.schema, lambda k: whole.get_batch(k), whole.num_record_batches
    stream = pa.ipc.open_stream(file)
    return stream.schema, None, 1


class IpcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.paths = schema, paths_of(options)

    def partitions(self):
        out = []
        for path in self.paths:
            with open_input(path) as f:
                out += [Split(path, k, 1) for k in range(open_reader(f)[2])]
        return out or [Split(self.paths[0], 0, 0)]

    def read(self, split):
        arrow = to_arrow_schema(self.schema)
        with open_input(split.path) as f:
            _, get, _ = open_reader(f)
            f.seek(0)
            for b in ([get(split.first)] if get else pa.ipc.open_stream(f)) if split.count else ():
                yield pa.RecordBatch.from_arrays([b.column(x.name).cast(x.type) for x in arrow], schema=arrow)


class IpcDataSource(DataSource):
    """spark.read.format("arrow").load(path): a partition for each batch of a file; a stream is one partition."""

    @classmethod
    def name(cls) -> str:
        return "arrow"

    def schema(self):
        with open_input(paths_of(self.options)[0]) as f:
            return spark_schema(open_reader(f)[0])

    def reader(self, schema):
        return IpcReader(schema, self.options)


def from_stream(spark: SparkSession, body: bytes) -> DataFrame:
    """A DataFrame of an IPC stream that the driver has."""
    with pa.ipc.open_stream(io.BytesIO(body)) as r:
        schema, table = spark_schema(r.schema), r.read_all()
    plain = table.cast(pa.schema([pa.field(f.name, _UNSIGNED.get(f.type, f.type)) for f in table.schema]))
    df = spark.createDataFrame(plain)
    from ..functions.schema import with_roles

    return with_roles(df, schema)


def batches_of(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """The result's Arrow batches on the driver, a partition at a time; executors serialise them."""

    def run(batches):
        for b in batches:
            out = io.BytesIO()
            with pa.ipc.new_stream(out, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["body"])

    schema = arrow_schema(df.schema)
    for row in df.mapInArrow(run, "body binary").toLocalIterator(prefetchPartitions=True):
        with pa.ipc.open_stream(row["body"]) as r:
            for b in r:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema)


def send_stream(df: DataFrame, sink) -> int:
    """Write an IPC stream of a result to a file-like object, a batch at a time; returns its rows. Roles go into the fields' metadata."""
    rows = 0
    with pa.ipc.new_stream(sink, arrow_schema(df.schema)) as w:
        for b in batches_of(df):
            w.write_batch(b)
            rows += b.num_rows
    return rows


def to_stream(df: DataFrame) -> bytes:
    """send_stream() into bytes, for results that fit the driver."""
    out = io.BytesIO()
    send_stream(df, out)
    return out.getvalue()


def write_ipc(df: DataFrame, path: str, compress: bool = False) -> int:
    """One IPC file of a result, through the driver a partition at a time; returns its rows."""
    rows, options = 0, pa.ipc.IpcWriteOptions(compression="zstd" if compress else None)
    with open_output(path) as f, pa.ipc.new_file(f, arrow_schema(df.schema), options=options) as w:
        for b in batches_of(df):
            w.write_batch(b)
            rows += b.num_rows
    return rows
