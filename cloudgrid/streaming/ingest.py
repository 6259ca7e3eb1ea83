"""Streaming ingest into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def ingest(stream: DataFrame, engine: Engine, collection: str, checkpoint: str, delta: str | None = None, keys: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Append each micro-batch to a collection's cells.

    Each batch is a folder named by its number, so one that is written again after
    a failure replaces what it wrote before. With keys, importance is derived from
    the row, so it has the same points again.
    """

    def store(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            engine.append(df, collection, delta, keys, batch=str(number))

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer).start()
