"""Queries of dimension lists, vocabularies, nested records and status, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.catalog import table
from loomspark.operators import normalize, views
from loomspark.plans.catalogue import S, spells
from loomspark.plans.records import MECHANIC_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _lookup(spark, d, kind):
    return table(spark, d, "lookup_entry").where(F.col("kind") == kind)


def _names(df):
    """Localized names of lookup entries: Chinese in the default variant, and an upper-case one in another."""
    rows = df.select("id", F.explode(F.array(F.struct(F.lit("zh").alias("lang"), F.lit("default").alias("variant"), F.col("name_zh").alias("name")), F.struct(F.lit("zh").alias("lang"), F.lit("chm").alias("variant"), F.upper("slug").alias("name")))).alias("x"))
    return rows.select("id", "x.*").where("name is not null")


def _class_list(kind: str, prestige: str, field: str) -> str:
    return f"""WITH u AS (SELECT DISTINCT {field} AS id FROM {'dnd_spellclasslevel' if kind == 'characterclass' else 'dnd_spell_descriptors'} WHERE {field} IS NOT NULL), m AS (SELECT id, slug, name, name_zh, id % 4 = 0 AS prestige FROM lookup_entry WHERE kind = '{kind}')
SELECT row_number() OVER (ORDER BY prestige, name, m.id) - 1 AS place, m.id, slug, name, prestige, """


@query(_class_list("characterclass", "TRUE", "character_class_id") + "name_zh AS i18n_name FROM m JOIN u ON u.id = m.id")
def q_class_list(spark, d):
    e = _lookup(spark, d, "characterclass")
    m = e.select("id", "slug", "name", (F.col("id") % 4 == 0).alias("prestige"))
    used = table(spark, d, "dnd_spellclasslevel").select(F.col("character_class_id").alias("id"))
    return views.dimension_list(m, used, _names(e), "zh")


@query(_class_list("descriptor", "FALSE", "spelldescriptor_id") + "upper(slug) AS i18n_name FROM m JOIN u ON u.id = m.id WHERE NOT prestige")
def q_domain_list(spark, d):
    e = _lookup(spark, d, "descriptor")
    m = e.select("id", "slug", "name", (F.col("id") % 4 == 0).alias("prestige"))
    used = table(spark, d, "dnd_spell_descriptors").select(F.col("spelldescriptor_id").alias("id"))
    return views.dimension_list(m, used, _names(e), "zh", "chm", include_prestige=False)


_BOOKS = f"""{S}, ed(edition_id, slug, system) AS (VALUES (0, 'core-35', 'dnd'), (1, 'core-30', 'dnd'), (2, 'other', 'else')), b AS (SELECT l.id, l.name, l.abbr, ed.edition_id, ed.slug AS edition_slug, CASE WHEN l.id % 5 <> 0 THEN upper(l.abbr) END AS display_abbr, CASE WHEN l.id % 5 <> 0 THEN 1970 + l.id % 50 END AS publication_year
 FROM lookup_entry l JOIN ed ON ed.edition_id = l.id % 3 AND ed.system = 'dnd' WHERE kind = 'rulebook' AND EXISTS (SELECT 1 FROM s WHERE s.rulebook_id = l.id))"""


def _books(spark, d):
    e = _lookup(spark, d, "rulebook")
    editions = spark.createDataFrame([(0, "core-35", "dnd"), (1, "core-30", "dnd"), (2, "other", "else")], "edition_id int, slug string, system string")
    pubs = e.select(F.when(F.col("id") % 5 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"), F.upper("abbr").alias("display_abbr"), (F.lit(1970) + F.col("id") % 50).alias("publication_year"))
    return views.rulebook_list(e.select("id", "name", "abbr", (F.col("id") % 3).cast("int").alias("edition_id")), editions, spells(spark, d), pubs, "dnd")


@query(f"WITH {_BOOKS} SELECT * FROM b")
def q_rulebook_list(spark, d):
    return _books(spark, d)


@query(f"WITH {_BOOKS} SELECT id FROM b WHERE edition_slug = 'core-35'")
def q_default_rulebooks(spark, d):
    return views.default_ids(_books(spark, d), "core-35")


_KINDS = ("school", "subschool", "descriptor")


def _overlays(spark, d):
    return views.overlay_maps({k: _names(_lookup(spark, d, k)) for k in (*_KINDS, "rulebook", "characterclass")}, "zh")


@query("SELECT kind, id, name_zh AS i18n_name FROM lookup_entry WHERE name_zh IS NOT NULL AND kind IN ('school', 'subschool', 'descriptor', 'rulebook', 'characterclass')")
def q_overlay_maps(spark, d):
    return _overlays(spark, d)


@query("""WITH f AS (SELECT DISTINCT kind AS facet_type, id, slug AS key, CASE WHEN kind = 'descriptor' AND id % 7 = 0 THEN 'See text: ' || name ELSE name END AS name, name_zh FROM lookup_entry WHERE kind IN ('school', 'subschool', 'descriptor') AND deleted_at IS NULL AND NOT (kind = 'school' AND id % 6 = 0)),
p AS (SELECT facet_type, id, key, name, name_zh FROM f WHERE NOT (facet_type = 'descriptor' AND regexp_matches(lower(name), '^see[\\s-]+text\\b')) UNION ALL SELECT DISTINCT facet_type, NULL, 'see-text', 'See text', NULL FROM f WHERE facet_type = 'descriptor' AND regexp_matches(lower(name), '^see[\\s-]+text\\b'))
SELECT facet_type, id, key, name, 'spell_' || facet_type AS category, CASE WHEN id IS NULL THEN 'descriptorBuckets' ELSE facet_type || 'Ids' END AS query_param, coalesce(CAST(id AS VARCHAR), key) AS query_value, name_zh AS i18n_name FROM p""")
def q_filter_vocabulary(spark, d):
    e = table(spark, d, "lookup_entry").where(F.col("kind").isin(*_KINDS))
    see = (F.col("kind") == "descriptor") & (F.col("id") % 7 == 0)
    facets = e.select(F.col("kind").alias("facet_type"), "id", F.col("slug").alias("key"), F.when(see, F.concat(F.lit("See text: "), "name")).otherwise(F.col("name")).alias("name"), F.when(F.col("deleted_at").isNull(), "accepted").otherwise("review").alias("review_status"))
    combined = e.select(F.when(F.col("id") % 6 == 0, F.col("kind")).otherwise("none").alias("facet_type"), "id").where("facet_type in ('school', 'none')")
    return views.filter_vocabulary(facets, combined, _overlays(spark, d))


def _items(spark, d):
    levels = table(spark, d, "dnd_spellclasslevel").join(_lookup(spark, d, "characterclass").select(F.col("id").alias("character_class_id"), F.col("slug"), F.col("name")), "character_class_id").select("spell_id", F.col("character_class_id").alias("id"), "slug", "name", (F.col("character_class_id") % 4 == 0).alias("prestige"), "level", "extra").distinct()
    desc = table(spark, d, "dnd_spell_descriptors").join(_lookup(spark, d, "descriptor").select(F.col("id").alias("spelldescriptor_id"), "slug", "name"), "spelldescriptor_id").select("spell_id", F.col("spelldescriptor_id").alias("id"), F.when(F.col("spelldescriptor_id") % 7 == 0, F.concat(F.lit("see text: "), "name")).otherwise(F.col("name")).alias("name"), "slug", F.col("id").alias("order"))
    names = views.exact_variant(table(spark, d, "i18n_spell_text").select(F.col("spell_id").alias("id"), "lang", "variant", "name"), "id", "zh", None)
    return views.spell_items(spells(spark, d), _lookup(spark, d, "rulebook"), _lookup(spark, d, "school"), _lookup(spark, d, "subschool"), levels, desc, names)


_LEVELS = f"""{S}, cl AS (SELECT DISTINCT x.spell_id, x.character_class_id AS cid, c.slug, c.name, x.character_class_id % 4 = 0 AS prestige, x.level, x.extra FROM dnd_spellclasslevel x JOIN lookup_entry c ON c.kind = 'characterclass' AND c.id = x.character_class_id),
ds AS (SELECT x.spell_id, CASE WHEN x.spelldescriptor_id % 7 = 0 THEN 'see-text' ELSE CAST(x.spelldescriptor_id AS VARCHAR) END AS k, x.id AS ord, CASE WHEN x.spelldescriptor_id % 7 = 0 THEN 'See text' ELSE c.name END AS name, CASE WHEN x.spelldescriptor_id % 7 <> 0 THEN x.spelldescriptor_id END AS did, CASE WHEN x.spelldescriptor_id % 7 = 0 THEN c.name END AS note FROM dnd_spell_descriptors x JOIN lookup_entry c ON c.kind = 'descriptor' AND c.id = x.spelldescriptor_id),
dl AS (SELECT spell_id, string_agg(name || '/' || coalesce(CAST(did AS VARCHAR), '-') || '/' || coalesce(note, '-'), ';' ORDER BY name, did) AS descriptors FROM (SELECT *, row_number() OVER (PARTITION BY spell_id, k ORDER BY ord DESC) AS rk FROM ds) q WHERE rk = 1 GROUP BY 1),
ll AS (SELECT spell_id, string_agg(level || '/' || name || '/' || cid || '/' || coalesce(extra, '-'), ';' ORDER BY level, prestige, name, cid, extra NULLS FIRST) AS levels FROM cl GROUP BY 1)"""


def _flat(items):
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return items.withColumn("descriptors", F.array_join(F.transform("descriptors", lambda x: F.concat_ws("/", x["name"], text(x["id"]), text(x["note"]))), ";")).withColumn("levels", F.array_join(F.transform("class_levels", lambda x: F.concat_ws("/", x["level"].cast("string"), x["name"], x["id"].cast("string"), text(x["extra"]))), ";"))


@query(f"""WITH {_LEVELS}, nm AS (SELECT spell_id, max(name) AS i18n_name FROM i18n_spell_text WHERE lang = 'zh' AND variant = 'default' GROUP BY 1)
SELECT s.id, s.name, b.abbr AS book, sc.name AS school, ss.name AS sub_school, coalesce(dl.descriptors, '') AS descriptors, coalesce(ll.levels, '') AS levels, coalesce(verbal_component, FALSE) AS v, coalesce(xp_component, FALSE) AS xp, s.range_text, nm.i18n_name
FROM s LEFT JOIN lookup_entry b ON b.kind = 'rulebook' AND b.id = s.rulebook_id LEFT JOIN lookup_entry sc ON sc.kind = 'school' AND sc.id = s.school_id LEFT JOIN lookup_entry ss ON ss.kind = 'subschool' AND ss.id = s.sub_school_id LEFT JOIN dl ON dl.spell_id = s.id LEFT JOIN ll ON ll.spell_id = s.id LEFT JOIN nm ON nm.spell_id = s.id""")
def q_spell_items(spark, d):
    return _flat(_items(spark, d)).select("id", "name", F.col("rulebook.abbr").alias("book"), F.col("school.name").alias("school"), F.col("sub_school.name").alias("sub_school"), "descriptors", "levels", F.col("components.V").alias("v"), F.col("components.XP").alias("xp"), F.col("casting.range").alias("range_text"), "i18n_name")


_ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(extract('millisecond' FROM {c}) % 1000 AS VARCHAR), 3, '0') || 'Z'"


@query(f"""WITH {S}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spell_id ORDER BY lang DESC, variant DESC, source_key DESC NULLS LAST, description_html DESC NULLS LAST, description_text DESC NULLS LAST) AS r FROM i18n_spell_text WHERE lang = 'zh') q WHERE r = 1)
SELECT s.id, {_ISO.format(c='s.added')} AS added, s.description AS text, s.description_html AS html, coalesce(s.verified, FALSE) AS verified, CASE WHEN s.verified_time IS NOT NULL THEN {_ISO.format(c='s.verified_time')} END AS verified_time, t.variant, t.source_key, t.description_text AS local_text FROM s LEFT JOIN t ON t.spell_id = s.id""")
def q_spell_details(spark, d):
    t = table(spark, d, "i18n_spell_text").where("lang = 'zh'").select(F.col("spell_id").alias("id"), "lang", "variant", "source_key", F.col("description_html").alias("html"), F.col("description_text").alias("text"))
    x = views.spell_details(_items(spark, d), t)
    return x.select("id", "added", F.col("description.text").alias("text"), F.col("description.html").alias("html"), F.col("verified.verified").alias("verified"), F.col("verified.time").alias("verified_time"), "localized.variant", "localized.source_key", F.col("localized.text").alias("local_text"))


@query(f"WITH {_LEVELS} SELECT s.id, ll.levels FROM s JOIN ll ON ll.spell_id = s.id WHERE EXISTS (SELECT 1 FROM cl WHERE cl.spell_id = s.id AND cid IN (1, 2) AND level = 3)")
def q_scope_filter(spark, d):
    return _flat(views.with_level(_items(spark, d), [1, 2], 3)).select("id", "levels")


@query(f"WITH {_LEVELS}, k AS (SELECT spell_id, string_agg(level || '/' || name || '/' || cid || '/' || coalesce(extra, '-'), ';' ORDER BY level, prestige, name, cid, extra NULLS FIRST) AS levels FROM cl WHERE cid IN (1, 2, 3) GROUP BY 1) SELECT s.id, coalesce(k.levels, '') AS levels FROM s LEFT JOIN k ON k.spell_id = s.id")
def q_nested_filter(spark, d):
    return _flat(views.only_levels(_items(spark, d), [1, 2, 3])).select("id", "levels")


@query(f"WITH {S} SELECT id, name, slug FROM s")
def q_projection_min(spark, d):
    return views.project(spells(spark, d), "min")


@query(f"""WITH {S}, f AS (SELECT s.id AS spell_id, 'school' AS t, l.name, 0 AS o FROM s JOIN lookup_entry l ON l.kind = 'school' AND l.id = s.school_id UNION ALL SELECT s.id, 'school', l.name || ' too', 1 FROM s JOIN lookup_entry l ON l.kind = 'school' AND l.id = s.school_id UNION ALL SELECT s.id, 'subschool', l.name, 0 FROM s JOIN lookup_entry l ON l.kind = 'subschool' AND l.id = s.sub_school_id
 UNION ALL SELECT DISTINCT x.spell_id, 'descriptor', l.name, l.id FROM dnd_spell_descriptors x JOIN s ON s.id = x.spell_id JOIN lookup_entry l ON l.kind = 'descriptor' AND l.id = x.spelldescriptor_id),
w AS (SELECT spell_id, min(CASE WHEN t = 'school' AND o = 0 THEN name END) AS school, min(CASE WHEN t = 'subschool' THEN name END) AS sub_school, coalesce(string_agg(CASE WHEN t = 'descriptor' THEN name END, ', ' ORDER BY o, name), '') AS descriptors FROM f GROUP BY 1)
SELECT s.id AS spell_id, w.school, w.sub_school, w.descriptors, coalesce(s.verbal_component, FALSE) AS verbal_component, coalesce(s.corrupt_component, FALSE) AS corrupt_component FROM s LEFT JOIN w ON w.spell_id = s.id""")
def q_wide_facets(spark, d):
    s = spells(spark, d)
    of = lambda kind, key: s.join(_lookup(spark, d, kind).select(F.col("id").alias(key), F.col("name").alias("facet")), key).select(F.col("id").alias("spell_id"), F.lit(kind).alias("facet_type"), F.col("facet").alias("name"), F.lit(0).alias("sort_order"))
    schools = of("school", "school_id")
    desc = table(spark, d, "dnd_spell_descriptors").join(s.select(F.col("id").alias("spell_id")), "spell_id").join(_lookup(spark, d, "descriptor").select(F.col("id").alias("spelldescriptor_id"), "name"), "spelldescriptor_id")
    facets = schools.unionByName(schools.withColumn("name", F.concat("name", F.lit(" too"))).withColumn("sort_order", F.lit(1))).unionByName(of("subschool", "sub_school_id"))
    facets = facets.unionByName(desc.select("spell_id", F.lit("descriptor").alias("facet_type"), "name", F.col("spelldescriptor_id").alias("sort_order")).distinct())
    return views.wide_facets(facets, normalize.components(s)).select("spell_id", "school", "sub_school", "descriptors", "verbal_component", "corrupt_component")


@query(f"WITH {S}, m AS ({MECHANIC_SQL}) SELECT spell_id, string_agg(mechanic_type || '=' || split_part(parsed, '|', 1) || '/' || split_part(parsed, '|', 6) || '/' || split_part(parsed, '|', 4), ';' ORDER BY mechanic_type) AS metadata FROM m WHERE split_part(parsed, '|', 6) <> 'review' GROUP BY 1")
def q_mechanic_metadata(spark, d):
    m = views.mechanic_metadata(normalize.mechanics_of(spells(spark, d)))
    flat = F.transform(F.array_sort(F.map_keys("metadata")), lambda k: F.concat(k, F.lit("="), F.element_at(F.col("metadata"), k)["category"], F.lit("/"), F.element_at(F.col("metadata"), k)["coverage"], F.lit("/"), F.array_join(F.element_at(F.col("metadata"), k)["flags"], ",")))
    return m.select("spell_id", F.array_join(flat, ";").alias("metadata"))


@query("SELECT arg_max(id, (added, id)) AS build_id, max(added) AS generated_at, (SELECT count(*) FROM dnd_spell) AS n_spells, (SELECT count(*) FROM i18n_spell_text) AS n_texts, (SELECT count(*) FROM dnd_spellclasslevel) AS n_levels FROM lookup_entry WHERE kind = 'rulebook'")
def q_content_status(spark, d):
    builds = _lookup(spark, d, "rulebook").select(F.col("id").alias("build_id"), F.col("added").alias("generated_at"))
    return views.content_status(builds, {"spells": table(spark, d, "dnd_spell"), "texts": table(spark, d, "i18n_spell_text"), "levels": table(spark, d, "dnd_spellclasslevel")})


@query("""SELECT 'nation' AS table_name, 1 AS place, 'n_name' AS column_name, 'string' AS column_type, (SELECT count(*) FROM nation) AS n_rows, (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT n_name AS v FROM nation ORDER BY v LIMIT 3) q) AS sample
UNION ALL SELECT 'mix_target', 0, 'source', 'string', (SELECT count(*) FROM mix_target), (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT source AS v FROM mix_target ORDER BY v LIMIT 3) q)""")
def q_table_overview(spark, d):
    t = views.table_overview(spark, {"nation": table(spark, d, "nation"), "mix_target": table(spark, d, "mix_target")})
    return t.where("column_name in ('n_name', 'source')")


@query("SELECT kind, count(*) AS n FROM lookup_entry WHERE deleted_at IS NULL GROUP BY kind")
def q_raw_sql(spark, d):
    return views.run_sql(spark, "select kind, count(*) as n from {entries} where deleted_at is null group by kind", {"entries": table(spark, d, "lookup_entry")})
