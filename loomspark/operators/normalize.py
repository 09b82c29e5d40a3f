"""Wide rows to facet, component, mechanic, list and issue rows, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import mechanics
from loomspark.functions.text import clean, list_extra

# The component columns.
COMPONENTS = ["verbal", "somatic", "material", "arcane_focus", "divine_focus", "xp", "meta_breath", "true_name", "corrupt"]
MECHANIC_COLUMNS = {"casting_time": "casting_time", "range": "range_text", "target": "target", "effect": "effect", "area": "area", "duration": "duration", "saving_throw": "saving_throw", "spell_resistance": "spell_resistance"}


def components(spells: DataFrame) -> DataFrame:
    """spell_id, component_type, present: nine rows per spell, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("component_type"), F.coalesce(F.col(f"{c}_component"), F.lit(False)).alias("present")) for c in COMPONENTS])
    return spells.select(F.col("id").alias("spell_id"), F.explode(pairs).alias("p")).select("spell_id", "p.*")


def mechanics_of(spells: DataFrame) -> DataFrame:
    """spell_id, mechanic_type, raw_text and the parsed columns: eight rows per spell, in one pass."""
    parts = F.array(*[F.struct(F.lit(t).alias("mechanic_type"), clean(F.col(c)).alias("raw_text"), mechanics.READERS[t](F.col(c)).alias("m")) for t, c in MECHANIC_COLUMNS.items()])
    review = F.when(F.col("p.m.issue_code").isNotNull(), "review").otherwise("accepted")
    return spells.select(F.col("id").alias("spell_id"), F.explode(parts).alias("p")).select("spell_id", "p.mechanic_type", "p.raw_text", "p.m.*", review.alias("review_status"))


def list_entries(levels: DataFrame) -> DataFrame:
    """spell_id, list_type, owner_id, level, raw_extra, variant_label, note, issue_code, review_status of class list rows."""
    e = list_extra(F.col("extra"))
    rows = levels.select("spell_id", F.lit("class").alias("list_type"), F.col("character_class_id").alias("owner_id"), "level", clean(F.col("extra")).alias("raw_extra"), e.alias("e"))
    return rows.select("spell_id", "list_type", "owner_id", "level", "raw_extra", "e.*", F.when(F.col("e.issue_code").isNotNull(), "review").otherwise("accepted").alias("review_status"))


def split_facets(rows: DataFrame, column: str, combined: DataFrame) -> DataFrame:
    """rows with a facet row each: a value that combined (whole, part, part_order) divides gives its parts, any other itself; sort_order from 0."""
    parts = combined.groupBy(F.col("whole").alias(column)).agg(F.transform(F.array_sort(F.collect_list(F.struct("part_order", "part"))), lambda x: x["part"]).alias("_parts"))
    return rows.join(parts, column, "left").select(*rows.columns, F.posexplode(F.coalesce("_parts", F.array(column))).alias("sort_order", "facet"))


def issues(spells: DataFrame, levels: DataFrame) -> DataFrame:
    """spell_id, source_table, source_field, raw_text, issue_code, severity: what normalization leaves to review."""
    m = mechanics_of(spells).where("issue_code is not null").select("spell_id", F.lit("dnd_spell").alias("source_table"), F.col("mechanic_type").alias("source_field"), "raw_text", "issue_code", F.lit("warning").alias("severity"))
    e = list_entries(levels).where("issue_code is not null").select("spell_id", F.lit("dnd_spellclasslevel").alias("source_table"), F.lit("extra").alias("source_field"), F.col("raw_extra").alias("raw_text"), "issue_code", F.lit("warning").alias("severity"))
    return m.unionByName(e)


def components_wide(rows: DataFrame) -> DataFrame:
    """Component rows back to one row per spell."""
    return rows.groupBy("spell_id").agg(*[F.max(F.when(F.col("component_type") == c, F.col("present"))).alias(f"{c}_component") for c in COMPONENTS])


def descriptor_buckets(facets: DataFrame, name: str = "name") -> DataFrame:
    """facets with bucket: names that begin 'see text' share one bucket."""
    return facets.withColumn("bucket", F.when(F.col(name).rlike(r"(?i)^see[\s-]+text\b"), "see-text").otherwise(F.lower(name)))
