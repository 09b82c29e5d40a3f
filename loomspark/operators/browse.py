"""Browse lists: union of owner edges, pages with totals, hydration of nested children, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order given; the order must break all ties that matter."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def union_edges(*sources: DataFrame) -> DataFrame:
    """Distinct union of edge tables with the same columns."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.distinct()


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page number (from 1) in an order that breaks all ties; a top-k plan, no full sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def with_total(paged: DataFrame, all_rows: DataFrame) -> DataFrame:
    """paged with total, the number of rows of all pages, as a scalar subquery."""
    return paged.select("*", all_rows.agg(F.count("*")).scalar().alias("total"))


def in_order(ids: list, df: DataFrame, key: str) -> DataFrame:
    """Rows of the ids in their order, with repeats, misses dropped; column pos from 0."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"pos int, {key} {kind}")
    return df.join(F.broadcast(wanted), key)


def missing_of(ids: list, df: DataFrame, key: str) -> DataFrame:
    """Ids of which df has no row."""
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(ids)], f"{key} {kind}").join(df.select(key), key, "left_anti")


def hydrate(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """parents with one array of structs per child table, ordered by the columns listed; none gives an empty array."""
    out = parents
    for name, (child, cols) in children.items():
        packed = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))
    return out


def overlay(df: DataFrame, texts: DataFrame, key: str, lang: str, variants: list[str], fields: list[str]) -> DataFrame:
    """df with each field's text in the language, from the first variant that has the row, kept where it has none."""
    rank = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col("variant"))
    chosen = best_per_key(texts.where((F.col("lang") == lang) & F.col("variant").isin(variants)), [key], rank.asc(), *[F.col(f).asc_nulls_last() for f in fields])
    names = chosen.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = df.join(names, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.trim(f"_{f}") != "", F.col(f"_{f}")).otherwise(F.col(f))).drop(f"_{f}")
    return out


def used_dimension(dimension: DataFrame, key: str, used: DataFrame) -> DataFrame:
    """Members of a dimension that occur in used."""
    return dimension.join(used.select(key).distinct(), key, "left_semi")


#: Keys of one list; a longer list goes on in the rows of the next ranges.
LIST_RANGE = 1000


def listed_by(df: DataFrame, group: str, key: str) -> DataFrame:
    """group, id_range, n, keys: the distinct whole-number keys of each group, ascending, in one row per range of LIST_RANGE keys, so no list grows with the data."""
    rows = df.select(group, key).distinct().withColumn("id_range", F.floor(F.col(key) / LIST_RANGE).cast("long"))
    return rows.groupBy(group, "id_range").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("keys"))


def by_level(edges: DataFrame, key: str) -> DataFrame:
    """level, id_range, n, keys (ascending) per level; see listed_by."""
    return listed_by(edges, "level", key)
