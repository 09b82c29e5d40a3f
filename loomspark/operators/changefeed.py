"""State of a table rebuilt from a feed of inserts, updates and deletes (problem 4).

Equality deletes with sequence numbers: a feed is split into three append-only logs. A data row is visible
when no delete of its key has a later sequence number; updates are overlaid on visible rows only. Arrival
order never matters, and a change that arrives twice has the same sequence number and so counts once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.session import delete_path, exists, list_names

# Spellings of the three operations.
INSERT_WORDS = ["insert", "i", "ins", "c", "create", "add", "r"]
UPDATE_WORDS = ["update", "u", "upd", "modify", "change"]
DELETE_WORDS = ["delete", "d", "del", "remove", "rm"]

KEYS = ["table_name", "row_key"]


def canonical_text(c: Column) -> Column:
    """Lower case without outer blanks of any kind."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def canonical_op(c: Column) -> Column:
    """i, u or d; null for a word that names no operation."""
    w = canonical_text(c)
    return F.when(w.isin(INSERT_WORDS), "i").when(w.isin(UPDATE_WORDS), "u").when(w.isin(DELETE_WORDS), "d")


@dataclass(frozen=True)
class ChangeLogs:
    """The three logs; columns table_name, row_key, seq and, but for deletes, data."""

    rows: DataFrame
    deletes: DataFrame
    updates: DataFrame


def changes(feed: DataFrame) -> DataFrame:
    """kind (i, u or d), table_name, row_key, seq, data of the changes that a feed names.

    feed: op, table_name, row_key, seq, data; other columns are ignored. Changes with a null key part, a null
    seq or an unknown op name no change to a row: they are left out here and listed by rejected_changes.
    """
    return feed.select(
        canonical_op(F.col("op")).alias("kind"),
        canonical_text(F.col("table_name")).alias("table_name"),
        canonical_text(F.col("row_key")).alias("row_key"),
        F.col("seq").cast("long").alias("seq"),
        "data",
    ).where("kind is not null and table_name is not null and row_key is not null and seq is not null")


def split_feed(feed: DataFrame) -> ChangeLogs:
    """Inserts, equality deletes and updates of a feed, not written; see changes."""
    part = lambda k: changes(feed).where(F.col("kind") == k).drop("kind")
    return ChangeLogs(part("i"), part("d").drop("data"), part("u"))


def rejected_changes(feed: DataFrame) -> DataFrame:
    """Feed lines that name no change: unknown op, or null key or seq."""
    return feed.where(canonical_op(F.col("op")).isNull() | F.col("table_name").isNull() | F.col("row_key").isNull() | F.col("seq").isNull())


def live_keys(logs: ChangeLogs) -> DataFrame:
    """table_name, row_key, insert_seq, last_seq of every row that exists.

    Each log is reduced to its latest sequence number per key before any shuffle, so a key with a third of all
    changes is one row per task by then; the three results share one hash partitioning, so the joins add none.
    """
    rows = logs.rows.groupBy(*KEYS).agg(F.max("seq").alias("insert_seq"))
    gone = logs.deletes.groupBy(*KEYS).agg(F.max("seq").alias("delete_seq"))
    changed = logs.updates.groupBy(*KEYS).agg(F.max("seq").alias("update_seq"))
    later = [rows[k] == gone[k] for k in KEYS] + [gone["delete_seq"] > rows["insert_seq"]]
    return rows.join(gone, later, "left_anti").join(changed, KEYS, "left").select(*KEYS, "insert_seq", F.greatest("insert_seq", "update_seq").alias("last_seq"))


def current_values(logs: ChangeLogs) -> DataFrame:
    """table_name, row_key, last_seq, column_name, value of every row that exists, one row per column.

    An insert replaces the whole row; each later update sets the columns its JSON names (also to null). Values
    are the JSON scalars as text. A live row whose changes carry no JSON object gives no row here.
    """
    sets = logs.rows.unionByName(logs.updates).select(*KEYS, "seq", F.explode(F.from_json("data", "map<string,string>")).alias("column_name", "value"))
    # the latest setting of a column is the only one that may hold, so a hot key is one row per column and task before it is shuffled
    last = sets.groupBy(*KEYS, "column_name").agg(F.max(F.struct("seq", "value")).alias("m"))
    return last.join(live_keys(logs), KEYS).where(F.col("m.seq") >= F.col("insert_seq")).select(*KEYS, "last_seq", "column_name", F.col("m.value").alias("value"))


class ChangeLogTable:
    """The three logs kept as append-only parquet under one path; also the sink of a streaming feed.

    A batch is one scan of its feed: changes are written apart by kind, deletes as equality-delete files of keys and
    sequence numbers. compact replaces the files of earlier batches by one change per key where that is all a reader
    needs.
    """

    _SCHEMA = "table_name string, row_key string, seq long, data string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, feed: DataFrame, batch: str | None = None) -> None:
        """Append one batch. A batch id makes a replay overwrite its own files, so retries repeat nothing."""
        changes(feed).withColumn("data", F.when(F.col("kind") != "d", F.col("data"))).write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/batch={batch or uuid.uuid4().hex}")

    def _batches(self) -> list[str]:
        return [f"{self.path}/{n}" for n in list_names(self.spark, self.path) if n.startswith("batch=")] if exists(self.spark, self.path) else []

    def logs(self) -> ChangeLogs:
        paths = [b for b in self._batches() if any(n.startswith("kind=") for n in list_names(self.spark, b))]
        read = lambda k: self.spark.read.schema(self._SCHEMA).parquet(*at) if (at := [f"{b}/kind={k}" for b in paths if exists(self.spark, f"{b}/kind={k}")]) else self.spark.createDataFrame([], self._SCHEMA)
        return ChangeLogs(read("i"), read("d").drop("data"), read("u"))

    def read(self) -> DataFrame:
        return live_keys(self.logs())

    def compact(self) -> None:
        """Put all batches so far into one: of each key the last insert, the last delete, and the updates after that insert.

        The new batch is complete before the old ones are deleted; a reader in between sees changes twice, which counts
        once. Later batches may hold changes of any age, so the last delete of a key stays.
        """
        old, logs = self._batches(), self.logs()
        rows = logs.rows.groupBy(*KEYS).agg(F.max(F.struct("seq", "data")).alias("m")).select(*KEYS, "m.seq", "m.data")
        gone = logs.deletes.groupBy(*KEYS).agg(F.max("seq").alias("seq"))
        # updates before the last insert are void whatever comes later; those before a delete may count for an insert that is late, if it is later than the delete, never
        known = rows.select(*KEYS, F.col("seq").alias("at")).unionByName(gone.select(*KEYS, F.col("seq").alias("at"))).groupBy(*KEYS).agg(F.max("at").alias("at"))
        updates = logs.updates.distinct().join(known, KEYS, "left").where("at is null or seq > at").drop("at")
        parts = [rows.withColumn("kind", F.lit("i")), gone.withColumn("data", F.lit(None).cast("string")).withColumn("kind", F.lit("d")), updates.withColumn("kind", F.lit("u"))]
        parts[0].unionByName(parts[1]).unionByName(parts[2]).write.partitionBy("kind").parquet(f"{self.path}/batch={uuid.uuid4().hex}")
        for path in old:
            delete_path(self.spark, path)

    def write_stream(self, feed: DataFrame, checkpoint: str):
        """Append a streaming feed batch by batch until it is used up; exactly once, as batches overwrite themselves."""
        return feed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: self.append(df, str(n))).start()
