"""Operators on ordered or positioned rows: islands, fills, segments, look-ahead, boxes and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ordered(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """df with the number of the run a row is in, from 0; breaks (may use lag over the same window) opens a new one."""
    w = ordered(keys, *order)
    return df.withColumn("_b", F.coalesce(breaks.cast("int"), F.lit(0))).withColumn(name, F.sum("_b").over(_before(w)).cast("long")).drop("_b")


def fill_forward(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """df with the last value of column that isn't null up to each row."""
    return df.withColumn(name, F.last(column, ignorenulls=True).over(_before(ordered(keys, *order))))


def segments(df: DataFrame, keys: list[str], order: list[str], heading: Column) -> DataFrame:
    """keys, segment, start and end position (from 1) of the stretch each heading opens; rows before the first heading belong to none."""
    w = ordered(keys, *order)
    rows = df.select(*keys, F.row_number().over(w).alias("_pos"), F.sum(heading.cast("int")).over(_before(w)).alias("segment"))
    return rows.where("segment > 0").groupBy(*keys, "segment").agg(F.min("_pos").alias("start_pos"), F.max("_pos").alias("end_pos"))


def ahead(df: DataFrame, keys: list[str], order: list[str], flag: Column, n: int, name: str) -> DataFrame:
    """df with whether flag holds in any of the next n rows."""
    w = ordered(keys, *order).rowsBetween(1, n)
    return df.withColumn(name, F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)) == 1)


def join_lines(df: DataFrame, keys: list[str], order: list[str], line: str) -> DataFrame:
    """keys, text: lines of a group as one text; a line that ends in a hyphen after a letter runs on."""
    lines = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: F.trim(x[line])).alias("_l"))
    step = lambda acc, x: F.when(acc == "", x).when(acc.rlike("[A-Za-z]-$"), F.concat(F.regexp_replace(acc, "-$", ""), x)).otherwise(F.concat(acc, F.lit(" "), x))
    return lines.select(*keys, F.aggregate("_l", F.lit(""), step).alias("text"))


def tolerance_distinct(values: Column, tolerance: float) -> Column:
    """Ascending array of numbers in which one within tolerance of the last kept is dropped."""
    empty = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), empty, lambda acc, x: F.when((F.size(acc) > 0) & (x - F.element_at(acc, -1) <= tolerance), acc).otherwise(F.array_append(acc, x)))


def smallest_box(points: DataFrame, boxes: DataFrame, page: str, point_id: str) -> DataFrame:
    """points with the smallest box (box_id, x0, y0, x1, y1) of their page that holds them, the lower id on ties; points in none are left out.

    Joined on page, with the range test as a residual, so it stays a hash join.
    """
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    hits = points.join(boxes, page).where(inside)
    return hits.groupBy(page, point_id).agg(F.min(F.struct(area.alias("area"), "box_id")).alias("m")).select(page, point_id, F.col("m.box_id").alias("box_id"), F.col("m.area").alias("area"))


def nearest(left: DataFrame, right: DataFrame, page: str, left_id: str, right_id: str, a: str, b: str, most: float) -> DataFrame:
    """Each left row's nearest right row of its page by |a - b|, within most; the lower id on ties."""
    gap = F.abs(F.col(a) - F.col(b))
    hits = left.join(right, page).withColumn("_d", gap).where(F.col("_d") <= most)
    return hits.groupBy(page, left_id).agg(F.min(F.struct("_d", right_id)).alias("m")).select(page, left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m._d").alias("distance"))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of one key whose half-open intervals [a0, a1) and [b0, b1) overlap, with the overlap."""
    j = left.join(right, key).where("a0 < b1 and b0 < a1")
    return j.withColumn("overlap", F.least("a1", "b1") - F.greatest("a0", "b0"))
