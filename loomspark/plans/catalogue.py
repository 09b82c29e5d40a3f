"""Queries of filters, browse lists, hydration and search over the catalogue tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.catalog import table
from loomspark.operators import browse, filters, normalize, search

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def spells(spark: SparkSession, d: str) -> DataFrame:
    """One row per spell that isn't deleted; of repeated rows the verified one, then the latest verified."""
    t = table(spark, d, "dnd_spell").where("deleted_at is null")
    return browse.best_per_key(t, ["id"], F.col("verified").desc(), F.col("verified_time").desc_nulls_last(), F.col("verified_author_id").desc_nulls_last())


def edges(spark: SparkSession, d: str) -> DataFrame:
    """spell_id, list_type, owner_id, level: class list entries, and descriptors as a second kind of owner at the spell's corrupt level or 0."""
    c = table(spark, d, "dnd_spellclasslevel").where("spell_id is not null and character_class_id is not null").select("spell_id", F.lit("class").alias("list_type"), F.col("character_class_id").alias("owner_id"), "level")
    s = table(spark, d, "dnd_spell").select(F.col("id").alias("spell_id"), "corrupt_level")
    x = table(spark, d, "dnd_spell_descriptors").where("spelldescriptor_id is not null").join(s, "spell_id").select("spell_id", F.lit("descriptor").alias("list_type"), F.col("spelldescriptor_id").alias("owner_id"), F.coalesce("corrupt_level", F.lit(0)).alias("level"))
    return browse.union_edges(c, x)


S = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY verified DESC, verified_time DESC NULLS LAST, verified_author_id DESC NULLS LAST) AS rk FROM dnd_spell WHERE deleted_at IS NULL) q WHERE rk = 1)"
E = """e AS (SELECT DISTINCT spell_id, 'class' AS list_type, character_class_id AS owner_id, level FROM dnd_spellclasslevel WHERE spell_id IS NOT NULL AND character_class_id IS NOT NULL
 UNION SELECT x.spell_id, 'descriptor', x.spelldescriptor_id, coalesce(s0.corrupt_level, 0) FROM dnd_spell_descriptors x JOIN dnd_spell s0 ON s0.id = x.spell_id WHERE x.spelldescriptor_id IS NOT NULL)"""


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' ORDER BY lower(p_name), p_partkey LIMIT 2000")
def q_name_search(spark, d):
    t = table(spark, d, "part").where(filters.name_contains(F.col("p_name"), "ring")).select("p_partkey", "p_name")
    return t.orderBy(F.lower("p_name"), "p_partkey").limit(2000)


@query(f"""WITH {S} SELECT id, name FROM s WHERE (lower(coalesce(casting_time, '')) LIKE '%minute%' OR (lower(coalesce(casting_time, '')) LIKE '%round%' AND lower(coalesce(casting_time, '')) NOT LIKE '%full-round action%'))
 AND (coalesce(range_text, '') SIMILAR TO '[0-9].*' OR lower(coalesce(range_text, '')) LIKE 'far%') AND (lower(coalesce(saving_throw, '')) IN ('', 'none') OR lower(coalesce(saving_throw, '')) LIKE 'no %')""")
def q_and_of_ors(spark, d):
    return spells(spark, d).where(filters.mechanic_filter({"casting_time": ["minute", "round"], "range_text": ["fixed", "far"], "saving_throw": ["none"]})).select("id", "name")


@query(f"""WITH {S} SELECT id FROM s WHERE regexp_matches(coalesce(duration, ''), '[0-9]') AND lower(coalesce(duration, '')) NOT LIKE '%permanent%' AND lower(coalesce(duration, '')) NOT LIKE '%instantaneous%'
 AND lower(coalesce(duration, '')) NOT LIKE '%concentration%' AND (lower(coalesce(spell_resistance, '')) = 'yes' OR lower(coalesce(spell_resistance, '')) LIKE 'yes %')""")
def q_duration_resistance(spark, d):
    return spells(spark, d).where(filters.mechanic_filter({"duration": ["timed"], "spell_resistance": ["yes"], "casting_time": []})).select("id")


@query(f"WITH {S} SELECT id, name FROM s WHERE EXISTS (SELECT 1 FROM dnd_spell_descriptors f WHERE f.spell_id = s.id AND f.spelldescriptor_id IN (1, 2, 3))")
def q_facet_semi(spark, d):
    f = table(spark, d, "dnd_spell_descriptors").withColumn("id", F.col("spell_id"))
    return filters.with_facet(spells(spark, d), f, "id", F.col("spelldescriptor_id").isin(1, 2, 3)).select("id", "name")


@query(f"""WITH {S} SELECT id FROM s WHERE EXISTS (SELECT 1 FROM dnd_spell_descriptors f JOIN lookup_entry l ON l.kind = 'descriptor' AND l.id = f.spelldescriptor_id
 WHERE f.spell_id = s.id AND (f.spelldescriptor_id = 5 OR lower(l.name) LIKE 's%' OR l.slug = 'glare'))""")
def q_facet_or(spark, d):
    names = table(spark, d, "lookup_entry").where("kind = 'descriptor'").select(F.col("id").alias("spelldescriptor_id"), "name", "slug")
    f = table(spark, d, "dnd_spell_descriptors").join(names, "spelldescriptor_id").withColumn("id", F.col("spell_id"))
    any_ = filters.any_of([F.col("spelldescriptor_id") == 5, F.lower("name").startswith("s"), F.col("slug") == "glare"])
    return filters.with_facet(spells(spark, d).select("id"), f, "id", any_)


@query(f"WITH {S}, c AS (SELECT id, 'verbal' AS k FROM s WHERE verbal_component UNION ALL SELECT id, 'material' FROM s WHERE material_component UNION ALL SELECT id, 'arcane_focus' FROM s WHERE arcane_focus_component) SELECT id FROM c GROUP BY id HAVING count(DISTINCT k) = 3")
def q_component_all(spark, d):
    held = normalize.components(spells(spark, d)).where("present").select(F.col("spell_id").alias("id"), "component_type")
    return filters.with_all(spells(spark, d).select("id"), held, "id", "component_type", ["verbal", "material", "arcane_focus"])


@query(f"""WITH {S}, {E} SELECT id, name FROM s WHERE EXISTS (SELECT 1 FROM e WHERE e.spell_id = s.id AND ((list_type = 'class' AND owner_id IN (1, 2)) OR (list_type = 'descriptor' AND owner_id IN (3))) AND level = 0)""")
def q_list_scope(spark, d):
    e = edges(spark, d).withColumnRenamed("spell_id", "id")
    return filters.in_list_scope(spells(spark, d), e, "id", {"class": [1, 2], "descriptor": [3]}, 0).select("id", "name")


@query(f"""WITH {S}, {E} SELECT e.level, s.id AS spell_id, s.name FROM (SELECT DISTINCT spell_id, level FROM e) e JOIN s ON s.id = e.spell_id WHERE e.level = 2 ORDER BY e.level, lower(s.name), s.id LIMIT 20 OFFSET 20""")
def q_browse_level(spark, d):
    e = edges(spark, d).where("level = 2").select("spell_id", "level").distinct()
    j = e.join(spells(spark, d).select(F.col("id").alias("spell_id"), "name"), "spell_id").select("level", "spell_id", "name")
    return browse.page(j, [F.col("level"), F.lower("name"), F.col("spell_id")], 2, 20)


@query(f"""WITH {S}, {E}, j AS (SELECT DISTINCT e.level, s.id AS spell_id, s.name FROM e JOIN s ON s.id = e.spell_id)
SELECT level, spell_id, name, (SELECT count(*) FROM j) AS total FROM j ORDER BY level, lower(name), spell_id LIMIT 50""")
def q_browse_all_levels(spark, d):
    j = edges(spark, d).select("spell_id", "level").distinct().join(spells(spark, d).select(F.col("id").alias("spell_id"), "name"), "spell_id").select("level", "spell_id", "name")
    return browse.with_total(browse.page(j, [F.col("level"), F.lower("name"), F.col("spell_id")], 1, 50), j)


@query(f"WITH {E} SELECT list_type, level, count(DISTINCT spell_id) AS spells, count(*) AS edges FROM e GROUP BY list_type, level")
def q_browse_total(spark, d):
    return edges(spark, d).groupBy("list_type", "level").agg(F.count_distinct("spell_id").alias("spells"), F.count("*").alias("edges"))


@query(f"""WITH {S}, {E}, c AS (SELECT spell_id, string_agg(list_type || ':' || owner_id || ':' || level, ',' ORDER BY list_type, owner_id, level) AS lists FROM e GROUP BY spell_id),
x AS (SELECT spell_id, string_agg(CAST(spelldescriptor_id AS VARCHAR), ',' ORDER BY spelldescriptor_id) AS descriptors FROM (SELECT DISTINCT spell_id, spelldescriptor_id FROM dnd_spell_descriptors WHERE spelldescriptor_id IS NOT NULL) q GROUP BY spell_id)
SELECT s.id, s.name, coalesce(c.lists, '') AS lists, coalesce(x.descriptors, '') AS descriptors FROM s LEFT JOIN c ON c.spell_id = s.id LEFT JOIN x ON x.spell_id = s.id""")
def q_hydrate(spark, d):
    e = edges(spark, d).withColumnRenamed("spell_id", "id")
    x = table(spark, d, "dnd_spell_descriptors").where("spelldescriptor_id is not null").select(F.col("spell_id").alias("id"), "spelldescriptor_id").distinct()
    h = browse.hydrate(spells(spark, d).select("id", "name"), "id", {"lists": (e, ["list_type", "owner_id", "level"]), "descriptors": (x, ["spelldescriptor_id"])})
    flat = F.array_join(F.transform("lists", lambda r: F.concat_ws(":", r["list_type"], r["owner_id"], r["level"])), ",")
    return h.select("id", "name", flat.alias("lists"), F.array_join(F.transform("descriptors", lambda r: r["spelldescriptor_id"].cast("string")), ",").alias("descriptors"))


@query(f"""WITH {S}, t AS (SELECT * FROM (SELECT spell_id, name, row_number() OVER (PARTITION BY spell_id ORDER BY CASE variant WHEN 'chm' THEN 1 ELSE 2 END, name ASC NULLS LAST) AS rk2 FROM i18n_spell_text
 WHERE lang = 'zh' AND variant IN ('chm', 'default')) q WHERE rk2 = 1) SELECT s.id, CASE WHEN trim(coalesce(t.name, '')) = '' THEN s.name ELSE t.name END AS name FROM s LEFT JOIN t ON t.spell_id = s.id""")
def q_overlay(spark, d):
    t = table(spark, d, "i18n_spell_text").withColumn("id", F.col("spell_id")).select("id", "lang", "variant", "name")
    return browse.overlay(spells(spark, d).select("id", "name"), t, "id", "zh", ["chm", "default"], ["name"])


@query(f"WITH {S} SELECT w.pos, s.id, s.name FROM (VALUES (0, 20), (1, 12), (2, 12), (3, 9), (4, 999999)) AS w(pos, id) JOIN s ON s.id = w.id")
def q_ordered_fetch(spark, d):
    return browse.in_order([20, 12, 12, 9, 999999], spells(spark, d), "id").select("pos", "id", "name")


@query(f"WITH {S} SELECT w.id FROM (VALUES (5), (3), (999999), (888888)) AS w(id) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = w.id)")
def q_missing_ids(spark, d):
    return browse.missing_of([5, 3, 3, 999999, 888888], spells(spark, d), "id")


@query(f"WITH {E} SELECT id, name, slug FROM lookup_entry l WHERE kind = 'characterclass' AND deleted_at IS NULL AND EXISTS (SELECT 1 FROM e WHERE list_type = 'class' AND owner_id = l.id)")
def q_used_classes(spark, d):
    classes = table(spark, d, "lookup_entry").where("kind = 'characterclass' and deleted_at is null").select("id", "name", "slug")
    return browse.used_dimension(classes, "id", edges(spark, d).where("list_type = 'class'").select(F.col("owner_id").alias("id")))


@query(f"WITH {E} SELECT level, CAST(floor(spell_id / 1000) AS BIGINT) AS id_range, count(*) AS n, string_agg(CAST(spell_id AS VARCHAR), ',' ORDER BY spell_id) AS keys FROM (SELECT DISTINCT level, spell_id FROM e WHERE list_type = 'class') q GROUP BY level, 2")
def q_by_level(spark, d):
    b = browse.by_level(edges(spark, d).where("list_type = 'class'"), "spell_id")
    return b.select("level", "id_range", "n", F.array_join("keys", ",").alias("keys"))


@query("SELECT kind, count(*) AS n, count(DISTINCT slug) AS slugs, max(id) AS max_id, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS deleted FROM lookup_entry GROUP BY kind")
def q_vocabulary(spark, d):
    return table(spark, d, "lookup_entry").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("slug").alias("slugs"), F.max("id").alias("max_id"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"))


def _tf(t: str) -> str:
    one = lambda c: f"((length(coalesce({c}, '')) - length(replace(lower(coalesce({c}, '')), '{t}', ''))) / {len(t)})"
    return f"(8.0 * {one('source')} + 1.0 * {one('text')})"


def _bm25_sql(tokens: list[str], where: str = "TRUE", tail: str = "") -> str:
    dl = "greatest(0, length(coalesce(text, '')) - 2) + greatest(0, length(coalesce(source, '')) - 2)"
    tfs = ", ".join(f"{_tf(t)} AS f{i}" for i, t in enumerate(tokens))
    dfs = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(tokens)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(tokens)))
    match = " AND ".join(f"f{i} > 0" for i in range(len(tokens)))
    return f"WITH d AS (SELECT doc_id, lang, {tfs}, {dl} AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM d) SELECT doc_id, round({score}, 6) AS score FROM d, st WHERE {match} AND {where} {tail}"


@query(_bm25_sql(["correction", "wheel"]))
def q_fts_bm25(spark, d):
    docs = table(spark, d, "documents")
    return search.bm25(docs, {"source": 8.0, "text": 1.0}, "Correction of wheel").select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql(["lantern"], "lower(lang) = 'en'"))
def q_fts_filtered(spark, d):
    docs = table(spark, d, "documents")
    return search.bm25(docs, {"source": 8.0, "text": 1.0}, "lantern", F.lower("lang") == "en").select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql(["errata"], "TRUE", "ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10"))
def q_fts_page(spark, d):
    docs = table(spark, d, "documents")
    hits = search.bm25(docs, {"source": 8.0, "text": 1.0}, "errata of").select("doc_id", F.round("score", 6).alias("score"))
    return browse.page(hits, [F.col("score").desc(), F.col("doc_id")], 2, 10)


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%lantern%'")
def q_fts_trigram_index(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    maybe = search.candidates(search.postings(docs, "doc_id", ["text"]), "doc_id", "lantern")
    return docs.join(maybe, "doc_id", "left_semi").where(search.occurrences(F.col("text"), "lantern") > 0).select("doc_id")
