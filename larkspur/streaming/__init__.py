"""Structured Streaming into managed tables: each micro-batch is one atomic load, and is loaded once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def append(engine, table: str, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream of the table's columns to it and its indexes.

    Spark may hand over a micro-batch again after a failure; the catalog knows it by the checkpoint's path and its number.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: engine.load(table, df, (checkpoint, n)) and None)
    return (writer.trigger(availableNow=True) if once else writer).start()
