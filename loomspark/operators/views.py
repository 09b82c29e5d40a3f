"""What the catalogue shows: dimension lists, filter vocabularies, list and detail records with nested children, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import iso_time

# Columns of the named projections.
MIN_COLUMNS = ["id", "name", "slug"]
LIST_COLUMNS = [*MIN_COLUMNS, "page", "rulebook_id", "school_id", "sub_school_id", "extra_components", "corrupt_level"]
DETAIL_COLUMNS = [*LIST_COLUMNS, "description", "description_html", "added", "verified", "verified_author_id", "verified_time"]
PROJECTIONS = {"min": MIN_COLUMNS, "list": LIST_COLUMNS, "detail": DETAIL_COLUMNS}
# The short names of components in a record.
COMPONENT_NAMES = {"V": "verbal", "S": "somatic", "M": "material", "AF": "arcane_focus", "DF": "divine_focus", "XP": "xp", "metabreath": "meta_breath", "truename": "true_name", "corrupt": "corrupt"}
CASTING_NAMES = {"castingTime": "casting_time", "range": "range_text", "target": "target", "effect": "effect", "area": "area", "duration": "duration", "savingThrow": "saving_throw", "spellResistance": "spell_resistance"}
#: Descriptors that only refer to the text share one bucket.
SEE_TEXT = r"(?i)^see[\s-]+text\b"
OTHER_BUCKET = ("see-text", "See text")


def project(df: DataFrame, name: str) -> DataFrame:
    """df under a named projection (min, list, detail); only its columns reach the scan."""
    return df.select(*PROJECTIONS[name])


def exact_variant(texts: DataFrame, key: str, lang: str, variant: str | None, field: str = "name") -> DataFrame:
    """key, i18n_name: the localized field of one language and variant ('default' if none is asked for); of repeated rows the largest text."""
    rows = texts.where((F.col("lang") == lang) & (F.col("variant") == (variant or "default")))
    return rows.groupBy(key).agg(F.max(field).alias("i18n_name"))


def overlay_maps(kinds: dict[str, DataFrame], lang: str, variant: str | None = None) -> DataFrame:
    """kind, id, i18n_name of every kind of entity (each id, lang, variant, name); no rows for English, which needs none."""
    out = None
    for kind, texts in kinds.items():
        one = exact_variant(texts, "id", lang, variant).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "i18n_name")
        out = one if out is None else out.unionByName(one)
    return out.limit(0) if lang == "en" else out


def dimension_list(members: DataFrame, used: DataFrame, names: DataFrame, lang: str, variant: str | None = None, include_prestige: bool = True) -> DataFrame:
    """place, id, slug, name, prestige, i18n_name of the members (id, slug, name, prestige) that occur in used (id), in order of prestige, name and id, from 0.

    The list is that of a closed dimension, so one window over it is small.
    """
    from pyspark.sql.window import Window

    kept = members.join(used.select("id").distinct(), "id", "left_semi")
    kept = kept if include_prestige else kept.where(~F.col("prestige"))
    out = kept.withColumn("place", F.row_number().over(Window.orderBy("prestige", "name", "id")) - 1)
    if lang == "en":
        return out.select("place", "id", "slug", "name", "prestige", F.lit(None).cast("string").alias("i18n_name"))
    return out.join(exact_variant(names, "id", lang, variant), "id", "left").select("place", "id", "slug", "name", "prestige", "i18n_name")


def rulebook_list(rulebooks: DataFrame, editions: DataFrame, spells: DataFrame, publications: DataFrame, system: str) -> DataFrame:
    """Books (id, name, abbr, edition_id) of one game system that have a spell, with edition_slug and, where publications (id and more columns) knows them, what it tells; null where it doesn't."""
    scoped = rulebooks.join(spells.select(F.col("rulebook_id").alias("id")).distinct(), "id", "left_semi")
    named = scoped.join(editions.where(F.col("system") == system).select("edition_id", F.col("slug").alias("edition_slug")), "edition_id")
    return named.join(publications, "id", "left")


def default_ids(books: DataFrame, edition: str) -> DataFrame:
    return books.where(F.col("edition_slug") == edition).select("id")


def filter_vocabulary(facets: DataFrame, combined: DataFrame, overlays: DataFrame) -> DataFrame:
    """facet_type, id, key, name, category, query_param, query_value, i18n_name of the values to filter by.

    facets: facet_type, id, key, name, review_status; accepted ones count, each once. Combined values (facet_type, id) are
    left out, as their parts stand for them; descriptors that say 'see text' are one bucket without an id. overlays:
    kind, id, i18n_name.
    """
    rows = facets.where("review_status = 'accepted'").select("facet_type", "id", "key", "name").distinct()
    rows = rows.join(combined.select("facet_type", "id").distinct(), ["facet_type", "id"], "left_anti")
    see = (F.col("facet_type") == "descriptor") & F.coalesce(F.col("name").rlike(SEE_TEXT) | (F.col("key") == OTHER_BUCKET[0]), F.lit(False))
    bucket = rows.where(see).select("facet_type").distinct().select("facet_type", F.lit(None).cast("int").alias("id"), F.lit(OTHER_BUCKET[0]).alias("key"), F.lit(OTHER_BUCKET[1]).alias("name"))
    public = rows.where(~see).unionByName(bucket)
    param = F.when(F.col("id").isNull(), "descriptorBuckets").otherwise(F.concat("facet_type", F.lit("Ids")))
    j = public.join(overlays.select(F.col("kind").alias("facet_type"), F.col("id").cast("int").alias("id"), "i18n_name"), ["facet_type", "id"], "left")
    return j.select("facet_type", "id", "key", "name", F.concat(F.lit("spell_"), "facet_type").alias("category"), param.alias("query_param"), F.coalesce(F.col("id").cast("string"), "key").alias("query_value"), "i18n_name")


def descriptor_list(rows: DataFrame) -> DataFrame:
    """spell_id, descriptors: array of struct(name, id, key, note) in order of name and id.

    rows: spell_id, id, name, slug, order. Those that say 'see text' are one entry with the bucket's key and name, and what
    follows as note; of entries with one id or bucket the last by order counts.
    """
    see = F.col("name").rlike(SEE_TEXT)
    note = F.nullif(F.trim(F.regexp_replace("name", r"(?i)^see[\s-]+text\b[:\s-]*", "")), F.lit(""))
    mapped = rows.select(
        "spell_id", "order", F.when(see, OTHER_BUCKET[0]).otherwise(F.col("id").cast("string")).alias("_k"),
        F.struct(F.when(see, OTHER_BUCKET[1]).otherwise(F.col("name")).alias("name"), F.when(~see, F.col("id")).alias("id"), F.when(see, OTHER_BUCKET[0]).alias("key"), F.when(see, note).alias("note")).alias("d"),
    )
    last = mapped.groupBy("spell_id", "_k").agg(F.max_by("d", "order").alias("d"))
    return last.groupBy("spell_id").agg(F.array_sort(F.collect_list("d")).alias("descriptors"))


def spell_items(spells: DataFrame, rulebooks: DataFrame, schools: DataFrame, subschools: DataFrame, levels: DataFrame, descriptors: DataFrame, names: DataFrame) -> DataFrame:
    """One record per spell: id, slug, name, page, rulebook, school, sub_school, descriptors, class_levels, components, casting, corrupt_level, i18n_name.

    rulebooks, schools and subschools: id, name, slug (and abbr). levels: spell_id, id, slug, name, prestige, level, extra,
    put in order of level, prestige, name and id. descriptors: see descriptor_list. names: id, i18n_name. A spell without
    children has empty arrays, one without school a null.
    """
    packed = levels.groupBy("spell_id").agg(F.array_sort(F.collect_list(F.struct("level", "prestige", "name", "id", "slug", "extra"))).alias("class_levels"))
    ref = lambda df, name, *cols: df.select(F.col("id").alias(f"{name}_id"), F.struct("id", "name", *cols).alias(name))
    j = spells.join(ref(rulebooks, "rulebook", "abbr"), "rulebook_id", "left").join(ref(schools, "school", "slug"), "school_id", "left").join(ref(subschools, "sub_school", "slug"), "sub_school_id", "left")
    j = j.join(packed.withColumnRenamed("spell_id", "id"), "id", "left").join(descriptor_list(descriptors).withColumnRenamed("spell_id", "id"), "id", "left").join(names, "id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(j.schema[c].dataType)).alias(c)
    flags = F.struct(*[F.coalesce(f"{c}_component", F.lit(False)).alias(n) for n, c in COMPONENT_NAMES.items()], F.col("extra_components").alias("extra"))
    casting = F.struct(*[F.col(c).alias(n) for n, c in CASTING_NAMES.items()])
    return j.select("id", "slug", "name", "page", "rulebook", "school", "sub_school", empty("descriptors"), empty("class_levels"), flags.alias("components"), casting.alias("casting"), "corrupt_level", "i18n_name", *[c for c in ("description", "description_html", "added", "verified", "verified_author_id", "verified_time") if c in spells.columns])


def spell_details(items: DataFrame, texts: DataFrame) -> DataFrame:
    """items (with the detail columns) as detail records: added and verified times as ISO texts, description of both forms, and the localized text's (id, lang, variant, source_key, html, text)."""
    local = texts.groupBy("id").agg(F.max(F.struct("lang", "variant", "source_key", "html", "text")).alias("localized"))
    verified = F.struct(F.coalesce("verified", F.lit(False)).alias("verified"), F.col("verified_author_id").alias("author_id"), iso_time(F.col("verified_time")).alias("time"))
    out = items.withColumn("verified", verified).withColumn("added", iso_time(F.col("added"))).withColumn("description", F.struct(F.col("description").alias("text"), F.col("description_html").alias("html")))
    return out.drop("description_html", "verified_author_id", "verified_time").join(local, "id", "left")


def with_level(items: DataFrame, owners: list[int], level: int | None = None) -> DataFrame:
    """Records that have a class level of any of the owners, at level if one is given; the records stay whole."""
    wanted = lambda x: x["id"].isin(owners) & ((x["level"] == level) if level is not None else F.lit(True))
    return items.where(F.exists("class_levels", wanted))


def only_levels(items: DataFrame, owners: list[int], level: int | None = None) -> DataFrame:
    """Records with only those class levels that are of the owners, at level if one is given."""
    wanted = lambda x: x["id"].isin(owners) & ((x["level"] == level) if level is not None else F.lit(True))
    return items.withColumn("class_levels", F.filter("class_levels", wanted))


def wide_facets(facets: DataFrame, components: DataFrame) -> DataFrame:
    """spell_id, school, sub_school, descriptors and the component flags: facet rows (spell_id, facet_type, name, sort_order) and component rows (spell_id, component_type, present) back to one row per spell.

    Of the schools and subschools the first by sort_order counts, descriptors are joined in order.
    """
    first = lambda t: F.min_by(F.when(F.col("facet_type") == t, F.col("name")), F.when(F.col("facet_type") == t, F.struct("sort_order", "name")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("facet_type") == "descriptor", F.struct("sort_order", "name")))), lambda x: x["name"]), ", ")
    wide = facets.groupBy("spell_id").agg(first("school").alias("school"), first("subschool").alias("sub_school"), listed.alias("descriptors"))
    flags = components.groupBy("spell_id").agg(*[F.max(F.when(F.col("component_type") == c, F.col("present"))).alias(f"{c}_component") for c in COMPONENT_NAMES.values()])
    return wide.join(flags, "spell_id", "full_outer")


def mechanic_metadata(mechanics: DataFrame) -> DataFrame:
    """spell_id, metadata: map of mechanic type to struct(category, coverage, normalized_text, flags) of the accepted mechanics, flags being those that hold."""
    value = F.struct("category", "coverage", "normalized_text", F.filter(F.split("flags", ","), lambda x: x != "").alias("flags"))
    ok = mechanics.where("review_status = 'accepted'").groupBy("spell_id", "mechanic_type").agg(F.max(value).alias("v"))
    return ok.groupBy("spell_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mechanic_type", "v")))).alias("metadata"))


def content_status(builds: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: build_id and generated_at of the latest build (latest time, then id; null without one) and n_<table> of each table."""
    latest = builds.agg(F.max(F.struct("generated_at", "build_id")).alias("b")).select("b.build_id", "b.generated_at")
    for name, df in tables.items():
        latest = latest.withColumn(f"n_{name}", df.agg(F.count("*")).scalar())
    return latest


def table_overview(spark: SparkSession, tables: dict[str, DataFrame], samples: int = 3) -> DataFrame:
    """table_name, place, column_name, column_type, n_rows, sample (the smallest values as text, at most samples) of every column of the tables."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*")).scalar()
        for k, f in enumerate(df.schema.fields):
            least = df.select(F.col(f"`{f.name}`").cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(samples).agg(F.array_join(F.array_sort(F.collect_list("v")), ", ")).scalar()
            one = spark.range(1).select(F.lit(name).alias("table_name"), F.lit(k).alias("place"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"), n.alias("n_rows"), least.alias("sample"))
            out = one if out is None else out.unionByName(one)
    return out


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """SQL with the tables in place of their names in braces, as in 'select * from {spells}'; no view is left behind."""
    return spark.sql(sql, **tables)


def as_text(c: Column) -> Column:
    """A nested value as JSON with nulls, to be compared as a whole."""
    return F.to_json(c, {"ignoreNullFields": "false"})
