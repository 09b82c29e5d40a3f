"""Structured streaming over change feeds, reference state and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.changefeed import ChangeLogTable
from loomspark.operators.orphans import OrphanStore


def follow_changes(spark: SparkSession, feed: DataFrame, table_path: str, checkpoint: str):
    """Append a streaming feed to a change log table; a batch that is retried overwrites its own files."""
    return ChangeLogTable(spark, table_path).write_stream(feed, checkpoint)


class OrphanFollower(OrphanStore):
    """Orphan state kept on disk and advanced by a stream."""

    def follow(self, events: DataFrame, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str):
        """Advance by a stream whose batches split cuts into (references, parent changes)."""
        return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: self.advance(n, *split(df)) and None).start()


def event_counts(events: DataFrame, window: str, late: str) -> DataFrame:
    """Events per window and type with their value summed; rows later than the watermark are dropped, as a stream must end somewhere."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
