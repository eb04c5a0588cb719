"""Structured Streaming into a relation.

Streams can't be intersected, subtracted or cross joined by Spark, so views are maintained in batches: each micro-batch is
inserted, and views refresh when they are read.  Inserting a batch again changes nothing, so retries are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..database import Database
from ..operators.nodes import Relation


def ingest(db: Database, relation: Relation, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that inserts each micro-batch of ``stream``; ``trigger`` goes to ``DataStreamWriter.trigger``."""

    def batch(df: DataFrame, _: int) -> None:
        db.insert(relation, db._store.keep(df))  # a micro-batch can only be read within its call

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
