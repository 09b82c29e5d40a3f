"""Queries of catalogue upkeep with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.catalog import table
from loomspark.operators import browse
from loomspark.operators import editorial as ed
from loomspark.operators import reconcile
from loomspark.plans.catalogue import S, spells

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@query("SELECT DISTINCT id FROM (SELECT 1 AS id UNION ALL SELECT 2 UNION ALL SELECT id + 10 FROM lookup_entry WHERE kind = 'school' AND id IN (1, 2)) q")
def q_expand_filter(spark, d):
    x = table(spark, d, "lookup_entry").where("kind = 'school'").select("id", (F.col("id") + 10).alias("also_id"))
    return ed.expand_ids([1, 2, 2], x)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q_count_map(spark, d):
    return ed.count_map(table(spark, d, "events"), "event_type")


@query("SELECT w.match_method, coalesce(n, 0) AS n FROM (VALUES ('alias'), ('slug'), ('never')) AS w(match_method) LEFT JOIN (SELECT match_method, count(*) AS n FROM zh_record GROUP BY 1) q ON q.match_method = w.match_method")
def q_zero_filled(spark, d):
    return ed.zero_filled(table(spark, d, "zh_record"), "match_method", ["alias", "slug", "never"])


@query("SELECT rulebook_id, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE verified) * 100.0 / count(*), 1) END AS pct FROM dnd_spell GROUP BY 1")
def q_percent(spark, d):
    return table(spark, d, "dnd_spell").groupBy("rulebook_id").agg(ed.percent(F.count_if("verified"), F.count("*")).alias("pct"))


@query("SELECT id, CASE kind WHEN 'rulebook' THEN 0 WHEN 'school' THEN 1 ELSE 2 END AS place, kind FROM lookup_entry")
def q_ranked_order(spark, d):
    return table(spark, d, "lookup_entry").select("id", ed.ranked_order(F.col("kind"), ["rulebook", "school"]).alias("place"), "kind")


@query("SELECT kind, left(slug, 1) AS family, min(id) AS place, count(*) AS n, string_agg(name, ',' ORDER BY id, name) AS names FROM lookup_entry GROUP BY 1, 2")
def q_family_groups(spark, d):
    t = table(spark, d, "lookup_entry").withColumn("family", F.substring("slug", 1, 1))
    return ed.family_groups(t, "kind", "family", "id", "name").withColumn("names", F.array_join("names", ","))


@query("SELECT name, parsed_id FROM (SELECT name, parsed_id, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN page IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN page IS NOT NULL THEN -parsed_id ELSE parsed_id END) AS rk FROM parsed_spell) q WHERE rk = 1")
def q_preferred_first(spark, d):
    return ed.preferred_first(table(spark, d, "parsed_spell"), ["name"], F.col("page").isNotNull(), "parsed_id").select("name", "parsed_id")


@query("SELECT p_partkey, CASE i WHEN 1 THEN p_name ELSE split_part(p_name, ' ', 1) || ' ' || CASE i WHEN 2 THEN 'Good' ELSE 'Law' END END AS part FROM part CROSS JOIN (VALUES (1), (2), (3)) AS n(i)")
def q_fan_out(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("/Good/Law")).alias("n"))
    return ed.fan_out(t, "n", "part").select("p_partkey", "part")


@query(f"WITH {S}, b AS (SELECT id, trim(regexp_replace(regexp_replace(name, ',\\s*[^,]+$', ''), '\\s+[IVX]+$', '')) AS base FROM s) SELECT id, min(id) OVER (PARTITION BY base) AS family, count(*) OVER (PARTITION BY base) - 1 AS n_related FROM b")
def q_related_variants(spark, d):
    return ed.related_variants(spells(spark, d), "id", "name")


_NAMED = "n AS (SELECT DISTINCT parsed_id, name || CASE parsed_id % 5 WHEN 0 THEN ': ' || source WHEN 1 THEN ' ' || page WHEN 2 THEN ' ' || repeat('of the old order ', 4) ELSE '' END AS name FROM parsed_spell UNION SELECT DISTINCT -parsed_id, lower(name) FROM parsed_spell)"


@query(f"WITH {_NAMED} SELECT parsed_id, code FROM (SELECT parsed_id, 'long-name' AS code FROM n WHERE length(trim(name)) > 60 UNION SELECT parsed_id, 'colon' FROM n WHERE contains(name, ':') UNION SELECT parsed_id, 'digits' FROM n WHERE regexp_matches(name, '[0-9]') UNION SELECT parsed_id, 'lower-start' FROM n WHERE regexp_matches(trim(name), '^[a-z]') UNION SELECT parsed_id, 'empty' FROM n WHERE trim(coalesce(name, '')) = '') q")
def q_parsed_name_issues(spark, d):
    p, k = table(spark, d, "parsed_spell"), F.col("parsed_id") % 5
    tail = F.when(k == 0, F.concat(F.lit(": "), "source")).when(k == 1, F.concat(F.lit(" "), "page")).when(k == 2, F.concat(F.lit(" "), F.repeat(F.lit("of the old order "), 4))).otherwise("")
    named = p.select("parsed_id", F.concat("name", tail).alias("name")).unionByName(p.select((-F.col("parsed_id")).alias("parsed_id"), F.lower("name").alias("name")))
    return named.select("parsed_id", F.explode(ed.parsed_name_issues(F.col("name"))).alias("code")).distinct()


@query("SELECT id, CASE WHEN regexp_matches(lower(name), '^(handbook|manual)') THEN 'player' WHEN regexp_matches(lower(name), 'codex|compendium') THEN 'collection' WHEN regexp_matches(lower(name), 'atlas|gazetteer') THEN 'setting' ELSE 'other' END AS category FROM lookup_entry WHERE kind = 'rulebook'")
def q_publication_class(spark, d):
    rules = [("player", "^(handbook|manual)"), ("collection", "codex|compendium"), ("setting", "atlas|gazetteer")]
    return table(spark, d, "lookup_entry").where("kind = 'rulebook'").select("id", ed.classify_by_rules(F.col("name"), rules, "other").alias("category"))


@query("SELECT o_orderkey, coalesce(t.text, o_orderstatus) AS display FROM orders LEFT JOIN (VALUES ('F', '完成'), ('O', '进行')) AS t(value, text) ON t.value = o_orderstatus")
def q_localized_display(spark, d):
    t = spark.createDataFrame([("F", "zh", "完成"), ("O", "zh", "进行"), ("F", "en", "done")], "value string, lang string, text string")
    return ed.localized(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", t, "zh", "display").select("o_orderkey", "display")


@query("SELECT p_partkey, CASE WHEN i <= 2 THEN 'Summons' ELSE 'Other' END AS section, CASE i WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 1 END AS row_no, CASE i WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END AS cell_no, CASE i WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE p_brand END AS cell FROM part CROSS JOIN (VALUES (1), (2), (3)) AS n(i)")
def q_table_cells(spark, d):
    text = F.concat(F.lit("h4. Summons\n| "), "p_name", F.lit(" | "), "p_type", F.lit(" |\nnote\nh4. Other\n|"), "p_brand", F.lit("|"))
    return ed.table_cells(table(spark, d, "part").select("p_partkey", text.alias("t")), "t")


@query(f"WITH {S}, t AS (SELECT spell_id, max(name) AS name FROM i18n_spell_text WHERE lang = 'zh' GROUP BY 1), u AS (SELECT spell_id, max(name) AS name FROM i18n_spell_text WHERE lang = 'en' GROUP BY 1) SELECT s.id, coalesce(t.name, u.name, s.name) AS name FROM s LEFT JOIN t ON t.spell_id = s.id LEFT JOIN u ON u.spell_id = s.id")
def q_override_cascade(spark, d):
    i = table(spark, d, "i18n_spell_text")
    of = lambda lang: i.where(F.col("lang") == lang).groupBy(F.col("spell_id").alias("id")).agg(F.max("name").alias("name"))
    return ed.override_cascade(spells(spark, d).select("id", "name"), [of("zh"), of("en")], "id", ["name"])


@query("SELECT DISTINCT parsed_id, concat_ws(',', CASE WHEN source IS NULL THEN 'no-source' END, CASE WHEN coalesce(school, '') = '' THEN 'no-school' END, CASE WHEN page IS NULL THEN 'no-page' END) AS blockers FROM parsed_spell")
def q_conversion_blockers(spark, d):
    checks = {"no-source": F.col("source").isNull(), "no-school": F.coalesce("school", F.lit("")) == "", "no-page": F.col("page").isNull()}
    return ed.with_blockers(table(spark, d, "parsed_spell"), checks).select("parsed_id", F.array_join("blockers", ",").alias("blockers")).distinct()


@query("""WITH d AS (SELECT DISTINCT rec_id, CASE WHEN match_method IN ('alias', 'slug') THEN 'accept' ELSE 'reject' END AS decision, CAST(confidence * 1000 AS BIGINT) AS priority FROM zh_record), c AS (SELECT DISTINCT rec_id, spell_id FROM (SELECT CASE WHEN rec_id % 5 = 0 THEN -rec_id ELSE rec_id END AS rec_id, spell_id FROM zh_record) q WHERE spell_id IS NOT NULL),
j AS (SELECT d.*, c.spell_id, row_number() OVER (PARTITION BY c.spell_id, d.decision = 'accept' AND c.spell_id IS NOT NULL ORDER BY priority, d.rec_id) AS rk FROM d LEFT JOIN c ON c.rec_id = d.rec_id)
SELECT rec_id, spell_id, CASE WHEN spell_id IS NULL THEN 'stale' WHEN decision <> 'accept' THEN 'rejected' WHEN rk > 1 THEN 'duplicate' ELSE 'applied' END AS outcome FROM j""")
def q_apply_decisions(spark, d):
    z = table(spark, d, "zh_record")
    dec = z.select("rec_id", F.when(F.col("match_method").isin("alias", "slug"), "accept").otherwise("reject").alias("decision"), F.round(F.col("confidence") * 1000).cast("long").alias("priority")).distinct()
    cand = z.where("spell_id is not null").select(F.when(F.col("rec_id") % 5 == 0, -F.col("rec_id")).otherwise(F.col("rec_id")).alias("rec_id"), "spell_id")
    return ed.apply_decisions(cand, dec, "rec_id", "spell_id")


@query(f"WITH {S}, p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size % 22 END AS school_id, p_size AS page FROM part) SELECT p.id, CASE WHEN s.id IS NULL THEN 'missing' WHEN p.school_id IS NOT NULL AND p.school_id IS DISTINCT FROM s.school_id THEN 'mismatch' WHEN p.page IS NOT NULL AND p.page IS DISTINCT FROM s.page THEN 'mismatch' ELSE 'verified' END AS status, CASE WHEN s.id IS NULL THEN NULL WHEN p.school_id IS NOT NULL AND p.school_id IS DISTINCT FROM s.school_id THEN 'school_id' WHEN p.page IS NOT NULL AND p.page IS DISTINCT FROM s.page THEN 'page' END AS field FROM p LEFT JOIN s ON s.id = p.id")
def q_verify_patch(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") % 22).cast("int").alias("school_id"), F.col("p_size").cast("int").alias("page"))
    return ed.verify_patch(p, spells(spark, d), "id", ["school_id", "page"])


@query("WITH r AS (SELECT p_partkey AS k, sha256(p_name) AS h FROM part), c AS (SELECT CASE WHEN p_partkey % 7 = 2 THEN -p_partkey ELSE p_partkey END AS k, CASE WHEN p_partkey % 5 = 0 THEN sha256(upper(p_name)) ELSE sha256(p_name) END AS h FROM part) SELECT r.k, CASE WHEN c.h IS NULL THEN 'gone' WHEN r.h = c.h THEN 'fresh' ELSE 'stale' END AS status FROM r LEFT JOIN c ON c.k = r.k")
def q_stale_evidence(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    r = p.select(k.alias("k"), F.sha2("p_name", 256).alias("h"))
    c = p.select(F.when(k % 7 == 2, -k).otherwise(k).alias("k"), F.when(k % 5 == 0, F.sha2(F.upper("p_name"), 256)).otherwise(F.sha2("p_name", 256)).alias("h"))
    return ed.stale_evidence(r, c, "k", "h")


@query(f"WITH {S}, i AS (SELECT spell_id AS id, min(name) AS name FROM i18n_spell_text WHERE lang = 'en' GROUP BY 1) SELECT coalesce(i.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'unknown-id' WHEN i.id IS NULL THEN 'missing-id' ELSE 'name-mismatch' END AS warning FROM i FULL JOIN s ON s.id = i.id WHERE s.id IS NULL OR i.id IS NULL OR lower(trim(regexp_replace(coalesce(i.name, ''), '\\s+', ' ', 'g'))) <> lower(trim(regexp_replace(s.name, '\\s+', ' ', 'g')))")
def q_import_drift(spark, d):
    i = table(spark, d, "i18n_spell_text").where("lang = 'en'").groupBy(F.col("spell_id").alias("id")).agg(F.min("name").alias("name"))
    return ed.drift(i, spells(spark, d), "id", "name")


@query(f"WITH {S} SELECT n.name, CASE WHEN count(DISTINCT s.id) = 0 THEN 'missing' WHEN count(DISTINCT s.id) = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM (SELECT DISTINCT name FROM parsed_spell) n LEFT JOIN s ON s.name = n.name GROUP BY n.name")
def q_source_coverage(spark, d):
    return ed.source_coverage(table(spark, d, "parsed_spell"), spells(spark, d), "name", "id")


@query("SELECT rulebook_id, count(*) FILTER (WHERE page IS NULL) AS no_page, count(*) FILTER (WHERE NOT verified) AS unverified, count(*) FILTER (WHERE page IS NULL) + count(*) FILTER (WHERE NOT verified) = 0 AS ready FROM dnd_spell GROUP BY 1")
def q_readiness(spark, d):
    return ed.readiness(table(spark, d, "dnd_spell"), "rulebook_id", {"no_page": F.col("page").isNull(), "unverified": ~F.col("verified")})


@query("SELECT event_type, event_id, priority FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS priority FROM events) q WHERE priority <= 10 ORDER BY priority, event_type LIMIT 30")
def q_queue_samples(spark, d):
    e = table(spark, d, "events").withColumn("neg", -F.col("value"))
    return ed.queue_samples(e, "event_type", ["neg", "event_id"], 10, 30).select("event_type", "event_id", "priority")


@query("WITH x AS (SELECT DISTINCT source, doc_id FROM documents), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM x WHERE source IS NOT NULL) SELECT source, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE rk <= 5) AS examples FROM r GROUP BY source")
def q_label_histogram(spark, d):
    t = table(spark, d, "documents").where("source is not null")
    h = ed.label_histogram(t, "source", "doc_id")
    return h.select("source", "n", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query("""WITH l AS (SELECT slug AS k, name AS v FROM lookup_entry WHERE kind = 'descriptor'), r AS (SELECT CASE WHEN id % 9 = 0 THEN slug || '~' ELSE slug END AS k, CASE WHEN id % 4 = 0 THEN name ELSE name_zh END AS v FROM lookup_entry WHERE kind = 'descriptor'), j AS (SELECT coalesce(l.k, r.k) AS slug, l.k AS lk, r.k AS rk, l.v AS lv, r.v AS rv, n FROM l FULL JOIN r ON l.k = r.k LEFT JOIN (SELECT v, count(DISTINCT k) AS n FROM r GROUP BY 1) q ON q.v = r.v)
SELECT slug, issue FROM (SELECT slug, 'missing-left' AS issue FROM j WHERE lk IS NULL UNION ALL SELECT slug, 'missing-right' FROM j WHERE rk IS NULL UNION ALL SELECT slug, 'untranslated' FROM j WHERE lv = rv UNION ALL SELECT slug, 'duplicate-value' FROM j WHERE n > 1) q""")
def q_key_audit(spark, d):
    t = table(spark, d, "lookup_entry").where("kind = 'descriptor'")
    right = t.select(F.when(F.col("id") % 9 == 0, F.concat("slug", F.lit("~"))).otherwise(F.col("slug")).alias("slug"), F.when(F.col("id") % 4 == 0, F.col("name")).otherwise(F.col("name_zh")).alias("v"))
    return ed.key_audit(t.select("slug", F.col("name").alias("v")), right, "slug", "v")


@query("SELECT o_custkey, heading, n_lines FROM (SELECT o_custkey, island, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS heading, count(*) AS n_lines FROM (SELECT *, sum(CASE WHEN y - py BETWEEN 8 AND 16 AND font = pf AND h >= 10.5 AND ph >= 10.5 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT o_custkey, o_orderkey, o_orderpriority, (o_orderkey % 40) * 1.0 AS y, o_orderstatus AS font, (o_orderkey % 5) + 8.0 AS h, lag((o_orderkey % 40) * 1.0) OVER w AS py, lag(o_orderstatus) OVER w AS pf, lag((o_orderkey % 5) + 8.0) OVER w AS ph FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) a) b GROUP BY o_custkey, island) c")
def q_merge_headings(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") % 40 * 1.0).alias("y"), F.col("o_orderstatus").alias("font"), (F.col("o_orderkey") % 5 + 8.0).alias("height"))
    return ed.merge_wrapped_headings(o, ["o_custkey"], "o_orderkey").select("o_custkey", "heading", "n_lines")


@query("SELECT user_id, event_id, coalesce(sum(0) OVER (PARTITION BY user_id), 0) + CASE WHEN coalesce(max(CASE WHEN event_type = 'login' THEN event_id END) OVER w, -1) > coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER w, -1) THEN 1 ELSE 0 END = 1 AS detached FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def q_detach_between(spark, d):
    e = table(spark, d, "events")
    return ed.detach_between(e, ["user_id"], ["event_id"], F.col("event_type") == "login", F.col("event_type") == "purchase").select("user_id", "event_id", "detached")


@query(f"WITH {S}, p AS (SELECT CASE WHEN id % 3 = 0 THEN -id ELSE id END AS id FROM s UNION ALL SELECT CASE WHEN id % 10 = 1 THEN id ELSE -1000000 - id END FROM s), n AS (SELECT id, count(*) AS n FROM p GROUP BY 1) SELECT count(s.id) AS n_whole, CAST(sum(coalesce(n.n, 0)) AS BIGINT) AS n_parts, count(*) FILTER (WHERE n.n > 1) AS n_repeated, count(*) FILTER (WHERE n.n IS NULL) AS n_missing, count(*) FILTER (WHERE s.id IS NULL) AS n_unknown, FALSE AS balanced FROM s FULL JOIN n ON n.id = s.id")
def q_set_balance(spark, d):
    s = spells(spark, d).select("id")
    i = F.col("id")
    parts = s.select(F.when(i % 3 == 0, -i).otherwise(i).alias("id")).unionByName(s.select(F.when(i % 10 == 1, i).otherwise(-1_000_000 - i).alias("id")))
    return ed.set_balance(parts, s, "id")


@query("SELECT id, name FROM lookup_entry WHERE kind = 'rulebook' ORDER BY added DESC NULLS LAST, id DESC LIMIT 1")
def q_latest_build(spark, d):
    t = table(spark, d, "lookup_entry").where("kind = 'rulebook'").withColumn("generated_at", F.col("added"))
    return ed.latest_build(t).select("id", "name")


@query("SELECT lang, variant, count(*) AS n, count(DISTINCT spell_id) AS spells, CAST(max(updated_at) AS VARCHAR) AS latest FROM i18n_spell_text GROUP BY 1, 2")
def q_overlay_status(spark, d):
    return table(spark, d, "i18n_spell_text").groupBy("lang", "variant").agg(F.count("*").alias("n"), F.count_distinct("spell_id").alias("spells"), F.max("updated_at").cast("string").alias("latest"))


@query(f"WITH {S}, z AS (SELECT DISTINCT spell_id AS id FROM zh_record WHERE spell_id IS NOT NULL) SELECT rulebook_id, CAST(floor(s.id / 1000) AS BIGINT) AS id_range, count(*) AS n, string_agg(CAST(s.id AS VARCHAR), ',' ORDER BY s.id) AS missing FROM s WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.id = s.id) GROUP BY rulebook_id, 2")
def q_back_check(spark, d):
    s = spells(spark, d).select("id", "rulebook_id")
    rest = s.join(table(spark, d, "zh_record").select(F.col("spell_id").alias("id")), "id", "left_anti")
    ids = browse.listed_by(rest, "rulebook_id", "id")
    return ids.select("rulebook_id", "id_range", "n", F.array_join(F.col("keys").cast("array<string>"), ",").alias("missing"))


@query("SELECT lower(name_key) AS name_key, sources, conflicting FROM (SELECT name AS name_key, count(DISTINCT source) AS sources, count(DISTINCT lower(trim(regexp_replace(coalesce(array_to_string(description, ' '), ''), '\\s+', ' ', 'g')))) > 1 AS conflicting FROM parsed_spell GROUP BY 1) q WHERE sources > 1")
def q_wording_groups(spark, d):
    t = table(spark, d, "parsed_spell")
    norm = F.lower(F.trim(F.regexp_replace(F.coalesce(F.array_join("description", " "), F.lit("")), r"\s+", " ")))
    g = t.groupBy(F.col("name").alias("name_key")).agg(F.count_distinct("source").alias("sources"), (F.count_distinct(norm) > 1).alias("conflicting"))
    return g.where("sources > 1").withColumn("name_key", F.lower("name_key"))


@query(f"WITH {S} SELECT id, CASE WHEN verified THEN 'verified' ELSE 'open' END AS queue FROM s WHERE verified <> FALSE OR page IS NULL OR corrupt_level IS NOT NULL")
def q_review_queue(spark, d):
    s = spells(spark, d).where("verified <> false or page is null or corrupt_level is not null")
    return reconcile.inventory(s, "id", [("verified", F.col("verified"))], "open").withColumnRenamed("disposition", "queue")


@query(f"""WITH {S}, l AS (SELECT DISTINCT character_class_id, level, spell_id FROM dnd_spellclasslevel WHERE spell_id IS NOT NULL AND character_class_id IS NOT NULL), t AS (SELECT l.*, trim(replace(s.name, ':', ' ') || ': entry ' || spell_id) AS line FROM l JOIN s ON s.id = l.spell_id),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][^:]{{1,60}}:\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY character_class_id, level ORDER BY spell_id ROWS UNBOUNDED PRECEDING) AS run FROM t), r AS (SELECT character_class_id, level, run, string_agg(line, ' ' ORDER BY spell_id) AS r FROM g WHERE run > 0 GROUP BY 1, 2, 3)
SELECT character_class_id, 'CLASS' AS owner, level, trim(split_part(r, ':', 1)) AS name, trim(substr(r, strpos(r, ':') + 1)) AS summary FROM r""")
def q_list_records(spark, d):
    """Pages made from class levels, read back to records."""
    levels = table(spark, d, "dnd_spellclasslevel").where("spell_id is not null and character_class_id is not null").select("character_class_id", "level", "spell_id").distinct()
    s = spells(spark, d).select(F.col("id").alias("spell_id"), F.regexp_replace("name", ":", " ").alias("name"))
    rows = levels.join(s, "spell_id")
    suffix = F.element_at(F.array(F.lit("TH"), F.lit("ST"), F.lit("ND"), F.lit("RD"), *[F.lit("TH")] * 6), F.col("level") + 1)
    heads = levels.select("character_class_id", F.lit(-1).alias("level"), F.lit(-1).alias("o"), F.lit("CLASS SPELLS").alias("line")).distinct()
    marks = levels.select("character_class_id", "level", F.lit(-1).alias("o"), F.concat(F.col("level").cast("string"), suffix, F.lit("-LEVEL")).alias("line")).distinct()
    body = rows.select("character_class_id", "level", F.col("spell_id").alias("o"), F.concat("name", F.lit(": entry "), F.col("spell_id").cast("string")).alias("line"))
    pages = heads.unionByName(marks).unionByName(body)
    return ed.list_records(pages, ["character_class_id"], ["level", "o"], "line")


@query("SELECT id AS row_id, 'entry-0' AS id, spell_id, 1 AS used FROM dnd_spellclasslevel WHERE spell_id > 0 UNION ALL SELECT id, 'x', 7, 0 FROM dnd_spellclasslevel")
def q_import_collection(spark, d):
    """A JSON collection per class level row."""
    t = table(spark, d, "dnd_spellclasslevel").select("id", F.concat(F.lit('[{"spellId": '), F.coalesce("spell_id", F.lit(0)).cast("string"), F.lit(', "used": 1}, {"id": "x", "spellId": 7, "levels": [1, 2]}, {"id": "x", "spellId": 8}, {"spellId": -1}]')).alias("json"))
    return ed.import_collection(t.withColumnRenamed("id", "row_id"), "json").select("row_id", "id", "spell_id", "used")
