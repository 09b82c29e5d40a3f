"""Sinks: staged overwrites, partition overwrites, batches, JSON lines and TSV."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.session import safe_child, write_text


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def replace_tables(spark: SparkSession, tables: dict[str, DataFrame], root: str, dry_run: bool = False) -> dict[str, int]:
    """Write tables to a staging folder, then put it in the place of root in two renames; returns rows per table.

    A failure before the renames leaves root as it was. A dry run counts and writes nothing.
    """
    if dry_run:
        return {n: df.count() for n, df in tables.items()}
    stage, old = f"{root}.stage-{uuid.uuid4().hex}", f"{root}.old-{uuid.uuid4().hex}"
    for n, df in tables.items():
        df.write.parquet(f"{stage}/{n}")
    counts = {n: spark.read.parquet(f"{stage}/{n}").count() for n in tables}
    fs, target, path = _fs(spark, root)
    if fs.exists(target):
        fs.rename(target, path(old))
    if not fs.rename(path(stage), target):
        fs.rename(path(old), target)
        raise OSError(f"could not put {stage} in the place of {root}")
    fs.delete(path(old), True)
    return counts


def replace_partitions(df: DataFrame, root: str, columns: list[str]) -> None:
    """Overwrite only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(root)


def number_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """df with batch, rows of size in order of a unique column, numbered from 0.

    The running number is taken within ranges of the order, offset by the counts of the ranges before, so no task
    sees all rows.
    """
    n = max(1, math.ceil(df.count() / 1_000_000), df.sparkSession.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    out = ranged.withColumn("_r", rank).join(F.broadcast(offsets), "_part")
    return out.withColumn("batch", F.floor((F.col("_off") + F.col("_r") - 1) / size).cast("long")).drop("_part", "_r", "_off")


def write_batches(df: DataFrame, order: str, size: int, root: str) -> None:
    """One folder of JSON lines per batch."""
    number_batches(df, order, size).repartition("batch").write.mode("overwrite").partitionBy("batch").json(root)


def write_json_lines(df: DataFrame, root: str) -> None:
    """JSON lines; nothing is seen of a job that fails, as files are committed by rename."""
    df.write.mode("overwrite").json(root)


def activate_stage(spark: SparkSession, files: dict[str, DataFrame], root: str) -> dict[str, int]:
    """replace_tables for files by name; names that lead out of root are refused before anything is written."""
    for name in files:
        safe_child(root, name)
    return replace_tables(spark, files, root)


def level_columns(rows: DataFrame, levels: list[int]) -> DataFrame:
    """place, level_<n>...: entries (level, name) in columns by level, each column's names in order from the top; blank where it has ended."""
    placed = rows.where(F.col("level").isin(levels)).withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy(F.lower("name"), "name")))
    wide = placed.groupBy("place").agg(*[F.coalesce(F.max(F.when(F.col("level") == n, F.col("name"))), F.lit("")).alias(f"level_{n}") for n in levels])
    return wide


def write_report(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], title: str, path: str) -> None:
    """A Markdown report of small tables: heading to (table, order)."""
    from loomspark.operators.corpus import markdown_table

    parts = [f"# {title}"] + [f"## {name}\n\n{markdown_table(df, order)}" for name, (df, order) in tables.items()]
    write_text(spark, path, "\n\n".join(parts) + "\n")


def write_tsv(df: DataFrame, root: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(root)


def replace_search_index(spark: SparkSession, documents: DataFrame, key: str, columns: list[str], entities: DataFrame, root: str, dry_run: bool = False) -> dict[str, int]:
    """Put documents, their trigram postings and the index state in the place of the index at root; refused when entities outnumber documents."""
    from loomspark.operators.search import SCHEMA_VERSION, postings

    n = documents.count()
    if n < entities.select(key).distinct().count():
        raise ValueError("the index has fewer documents than there are entities")
    state = spark.createDataFrame([(1, SCHEMA_VERSION, n)], "id int, schema_version int, document_count long").withColumn("rebuilt_at", F.current_timestamp())
    return replace_tables(spark, {"documents": documents, "postings": postings(documents, key, columns), "state": state}, root, dry_run)


def replace_browse_index(spark: SparkSession, levels: DataFrame, spells: DataFrame, root: str, dry_run: bool = False) -> dict[str, int]:
    """Put the derived browse edges (spell_id, owner_id, level, rulebook_id, extra), one row each, in the place of those at root."""
    edges = levels.join(spells.select(F.col("id").alias("spell_id"), "rulebook_id"), "spell_id").select("spell_id", "owner_id", "level", "rulebook_id", F.coalesce("extra", F.lit("")).alias("extra")).distinct()
    return replace_tables(spark, {"edges": edges}, root, dry_run)
