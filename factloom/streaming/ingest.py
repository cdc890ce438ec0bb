"""Facts from a stream: each micro-batch is interned as one batch.

Interning deduplicates, so a batch that is delivered again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factloom.sources.store import Database


def ingest(stream: DataFrame, db: Database, predicate: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Starts interning a streaming frame of ``key`` and, if declared, ``value``; one stream writes to a database at a time."""

    def intern(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            db.write({predicate: batch})

    writer = stream.writeStream.foreachBatch(intern).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
