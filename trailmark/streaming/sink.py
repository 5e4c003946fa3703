"""Appending sinks of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import chosen_format


def append(stream: DataFrame, path: str, checkpoint: str, fmt: str | None = None, once: bool = True) -> StreamingQuery:
    """Writes a stream to Parquet or CSV, with a header in each file; empty batches add nothing. The file sink's log
    makes a batch that is tried again count once."""
    writer = stream.writeStream.format(chosen_format(path, fmt)).option("path", path).option("header", True).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
