"""Helpers shared by the text operators: inputs, the shared folder, file access."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_root

#: A word is a run of anything but the six ASCII white space characters.
WORD_GAP = "[\x20\x09-\x0d]+"


_held: dict = {}


def held(key, make):
    """What a Python worker keeps between tasks: one thing at a time, so that stages don't add up."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of what an earlier stage has left in this worker."""
    _held.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system, so that workers waiting for a task hold little."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def rows_of(batches: Iterable, step: int = 500) -> Iterator[tuple]:
    """Rows of Arrow batches, a few at a time as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder, not yet made, under the folder that driver and executors share."""
    return f"{shared_root(spark)}/llm-{uuid.uuid4().hex}"


#: Rows of one Arrow batch at most: a batch of texts is in memory as a whole, in Spark and in Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches have BATCH_ROWS rows at most; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def chunks(rows: Iterable[tuple], size, limit: int) -> Iterator[list[tuple]]:
    """Consecutive rows in lists whose sizes sum to about limit."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= limit:
            yield held
            held, n = [], 0
    if held:
        yield held


def local_path(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    return uri if "://" not in uri else None


def write_file(uri: str, parts: Iterable[bytes]) -> int:
    """Write a new file; a name is used by one task attempt only, so nothing is replaced."""
    path, n = local_path(uri), 0
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        out = open(path, "wb")
    else:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(uri)
        system.create_dir(os.path.dirname(name), recursive=True)
        out = system.open_output_stream(name)
    with out:
        for part in parts:
            out.write(part)
            n += len(part)
    return n


def open_file(uri: str):
    """A readable, seekable binary file."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def row_batches(rows: Iterable[tuple], schema, limit: int = 4 << 20) -> Iterator:
    """Arrow batches of rows, about limit bytes each."""
    import pyarrow as pa

    def weight(row):
        return 16 + sum(len(v) * (8 if isinstance(v, list) else 1) if isinstance(v, (str, bytes, list)) else 8 for v in row)

    for some in chunks(rows, weight, limit):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow for a generator that takes Arrow batches and yields tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        try:
            yield from row_batches(fn(batches), arrow)
        finally:
            give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, text_col: str, decide) -> DataFrame:
    """The rows for which decide holds, all columns as they are; decide takes a batch of texts and gives Booleans."""
    name = "_text"
    while name in df.columns:
        name += "_"
    own = df.withColumn(name, F.col(text_col).cast("string"))

    def run(batches):
        import pyarrow as pa

        try:
            for batch in batches:
                text = batch.column(batch.num_columns - 1)
                kept = batch.select(range(batch.num_columns - 1))
                yield kept.filter(pa.array(decide(pa.RecordBatch.from_arrays([text], ["text"])), pa.bool_()))
        finally:
            give_back()

    small_batches(df.sparkSession)
    return own.mapInArrow(run, df.schema)
