"""Appending a stream to a database table, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.database import Database


def ingest(stream: DataFrame, database: Database, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write a stream's columns to the table's columns of those names.

    A micro-batch goes through the checks of INSERT and is published with its
    number in one manifest, so a batch that is replayed after a failure isn't
    appended again. A batch that breaks a constraint stops the stream and leaves
    the table as it was. ``once`` ends when what is there has been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            database.append(table, batch, stamp=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
