"""Progress of streams as events, and stopping them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls hook(event, payload) as streams start ("started"), take a batch ("frames", with its rows and rows a
    second), rest ("idle") and end ("done", or "failed" with the message)."""

    def __init__(self, hook: Callable[[str, dict], None]):
        self.hook = hook

    def onQueryStarted(self, event) -> None:
        self.hook("started", {"name": event.name, "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.hook("frames", {"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        self.hook("idle", {"id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.hook("failed" if event.exception else "done", {"id": str(event.id), "error": event.exception})


def watch(spark: SparkSession, hook: Callable[[str, dict], None]) -> Progress:
    listener = Progress(hook)
    spark.streams.addListener(listener)
    return listener


def cancel(query: StreamingQuery) -> bool:
    """Stops a stream after its batch; whether it was running."""
    running = query.isActive
    query.stop()
    return running
