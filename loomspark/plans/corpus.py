"""Queries of corpus upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.catalog import table
from loomspark.operators import corpus, editorial, filters, normalize
from loomspark.plans.catalogue import S, spells
from loomspark.plans.records import MECHANIC_SQL
from loomspark.sources import writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_MN = "trim(regexp_replace(regexp_replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '\\s*\\((m|f|df|xp|v|s|af|x)\\)\\s*$', ''), ',\\s*(greater|lesser)$', ' \\1'))"

_INV = f"""{S}, z AS (SELECT rec_id AS cand_id, any_value(en_name) AS name, any_value(coalesce(en_name_hint, '-')) AS slug0, any_value(rec_id % 17 = 0) AS is_artifact, any_value(rec_id % 3 = 0) AS is_core, any_value(rec_id % 11 = 0) AS is_blocked, any_value(rulebook_id) AS b0 FROM zh_record GROUP BY 1),
c AS (SELECT cand_id, {_MN.format(c='name')} AS n, lower(replace(name, ' ', '-')) || CASE WHEN cand_id % 4 = 0 THEN '' ELSE '-x' END AS slug, is_artifact, is_core, is_blocked FROM z),
ap AS (SELECT cand_id, b0 AS rulebook_id FROM z UNION SELECT cand_id, CASE WHEN cand_id % 5 = 0 THEN CAST(1 + cand_id % 20 AS INT) ELSE b0 END FROM z UNION SELECT cand_id, CASE WHEN cand_id % 13 <> 0 THEN b0 END FROM z),
e AS (SELECT DISTINCT {_MN.format(c='name')} AS n, slug, rulebook_id FROM s), st AS (SELECT CASE WHEN cand_id % 7 = 0 THEN cand_id ELSE -cand_id END AS cand_id FROM z),
ct AS (SELECT cand_id, count(rulebook_id) AS k, bool_or(rulebook_id IS NULL) AS u FROM ap GROUP BY 1),
j AS (SELECT c.*, ct.k, ct.u, ap.rulebook_id, EXISTS (SELECT 1 FROM e WHERE e.n = c.n) AS named, EXISTS (SELECT 1 FROM e WHERE e.slug = c.slug) AS slugged, EXISTS (SELECT 1 FROM e WHERE e.n = c.n AND e.rulebook_id = ap.rulebook_id) AS in_book, c.cand_id IN (SELECT cand_id FROM st) AS stuck FROM c JOIN ct ON ct.cand_id = c.cand_id LEFT JOIN ap ON ap.cand_id = c.cand_id AND ap.rulebook_id IS NOT NULL),
o AS (SELECT *, bool_or(in_book) OVER (PARTITION BY cand_id) AS other FROM j),
inv AS (SELECT DISTINCT cand_id, CASE WHEN NOT is_artifact THEN rulebook_id END AS rulebook_id, CASE WHEN is_artifact THEN 'manual-review' WHEN k = 0 AND is_core AND named THEN 'duplicate' WHEN k = 0 THEN 'deferred' WHEN in_book OR slugged OR other THEN 'duplicate' WHEN is_blocked OR u OR k > 1 OR named THEN 'manual-review' WHEN stuck THEN 'mismatch' ELSE 'ready' END AS category,
 CASE WHEN is_artifact THEN 'artifact' WHEN k = 0 AND is_core AND named THEN 'core-label' WHEN k = 0 THEN 'no-known-book' WHEN in_book OR slugged THEN 'exists' WHEN other THEN 'other-book' WHEN is_blocked THEN 'blocked' WHEN u OR k > 1 THEN 'several-books' WHEN named THEN 'name-elsewhere' WHEN stuck THEN 'blockers' END AS reason FROM o)"""


def _inventory(spark, d):
    k = F.col("rec_id")
    z = table(spark, d, "zh_record").groupBy("rec_id").agg(F.first("en_name").alias("name"), F.first("rulebook_id").alias("b0"))
    c = z.select(k.alias("cand_id"), "name", F.concat(F.lower(F.replace("name", F.lit(" "), F.lit("-"))), F.when(k % 4 == 0, "").otherwise("-x")).alias("slug"), (k % 17 == 0).alias("is_artifact"), (k % 3 == 0).alias("is_core"), (k % 11 == 0).alias("is_blocked"))
    b0 = F.col("b0")
    books = F.array(b0, F.when(k % 5 == 0, (1 + k % 20).cast("int")).otherwise(b0), F.when(k % 13 != 0, b0))
    ap = z.select(k.alias("cand_id"), F.explode(books).alias("rulebook_id"))
    stuck = c.select(F.when(F.col("cand_id") % 7 == 0, F.col("cand_id")).otherwise(-F.col("cand_id")).alias("cand_id"))
    return corpus.corpus_inventory(c, ap, spells(spark, d).select("id", "name", "slug", "rulebook_id"), stuck)


@query(f"WITH {_INV} SELECT * FROM inv")
def q_corpus_inventory(spark, d):
    return _inventory(spark, d)


@query(f"WITH {_INV} SELECT rulebook_id, count(*) FILTER (category = 'deferred') AS deferred, count(*) FILTER (category = 'duplicate') AS duplicate, count(*) FILTER (category = 'manual-review') AS manual_review, count(*) FILTER (category = 'mismatch') AS mismatch, count(*) FILTER (category = 'ready') AS ready, count(*) AS n FROM inv GROUP BY 1")
def q_inventory_summary(spark, d):
    return corpus.inventory_summary(_inventory(spark, d))


_NORM = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


@query(f"""WITH p AS (SELECT parsed_id AS cand_id, min(school) AS school, min(subschool) AS subschool, min(descriptors) AS ds, min(class_levels) AS cl FROM parsed_spell GROUP BY 1), k AS (SELECT kind, {_NORM.format(c='name')} AS k FROM lookup_entry GROUP BY 1, 2),
a AS (SELECT cand_id, 'school' AS kind, coalesce(school, '') AS label FROM p UNION SELECT cand_id, 'subschool', subschool FROM p WHERE trim(coalesce(subschool, '')) <> '' UNION SELECT cand_id, 'descriptor', ds FROM p WHERE ds IS NOT NULL),
lost AS (SELECT cand_id, string_agg('unresolved ' || a.kind || ': ' || label, '; ' ORDER BY 'unresolved ' || a.kind || ': ' || label) AS x FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.kind = a.kind AND k.k = {_NORM.format(c='a.label')}) GROUP BY 1),
m AS (SELECT cand_id, u.c AS cls, json_extract_string(cl, '$."' || u.c || '"') AS raw FROM p, unnest(json_keys(CASE WHEN json_valid(cl) THEN cl ELSE '{{}}' END)) AS u(c)),
r AS (SELECT *, coalesce(regexp_matches(raw, '^\\s*[0-9]+\\s*(\\(.*\\))?\\s*$'), FALSE) AS ok, EXISTS (SELECT 1 FROM k WHERE k.kind = 'characterclass' AND k.k = {_NORM.format(c='m.cls')}) AS hit FROM m),
g AS (SELECT cand_id, string_agg(cls || '=' || regexp_extract(raw, '([0-9]+)', 1) || '/' || coalesce(nullif(regexp_extract(raw, '\\((.*)\\)', 1), ''), '-'), '; ' ORDER BY cls) FILTER (ok AND hit) AS levels, string_agg('unparsed class level: ' || cls || '=' || coalesce(raw, ''), '; ' ORDER BY 'unparsed class level: ' || cls || '=' || coalesce(raw, '')) FILTER (NOT ok) AS bad, string_agg('skipped unresolved class: ' || cls, '; ' ORDER BY cls) FILTER (ok AND NOT hit) AS notes FROM r GROUP BY 1)
SELECT p.cand_id, coalesce(g.levels, '') AS levels, concat_ws('; ', lost.x, g.bad, CASE WHEN g.levels IS NULL THEN 'no resolvable levels' END) AS blockers, coalesce(g.notes, '') AS notes FROM p LEFT JOIN lost ON lost.cand_id = p.cand_id LEFT JOIN g ON g.cand_id = p.cand_id""")
def q_conversion_check(spark, d):
    p = table(spark, d, "parsed_spell").groupBy(F.col("parsed_id").alias("cand_id")).agg(F.min("school").alias("school"), F.min("subschool").alias("subschool"), F.min("descriptors").alias("ds"), F.min("class_levels").alias("cl"))
    c = p.select("cand_id", "school", "subschool", F.when(F.col("ds").isNotNull(), F.array("ds")).alias("descriptors"), F.from_json("cl", "map<string,string>").alias("class_levels"))
    out = corpus.conversion_check(c, table(spark, d, "lookup_entry").select("kind", "name"))
    level = F.transform("levels", lambda x: F.concat(x["class"], F.lit("="), x["level"].cast("string"), F.lit("/"), F.coalesce(x["extra"], F.lit("-"))))
    return out.select("cand_id", F.array_join(level, "; ").alias("levels"), F.array_join("blockers", "; ").alias("blockers"), F.array_join("notes", "; ").alias("notes"))


_SV = "regexp_replace(translate(regexp_replace(coalesce({c}, ''), '\\s+', '', 'g'), '，。；：（）！？', ',.;:()!?'), '[.,;]+$', '')"


@query(f"""WITH r AS (SELECT spell_id, rulebook_abbr, CASE WHEN rec_id % 6 = 0 THEN zh_name || '。' WHEN rec_id % 19 = 0 THEN ' ' ELSE coalesce(en_name, zh_name) END AS t0, source_key, CASE rec_id % 4 WHEN 0 THEN 'class-list' WHEN 1 THEN 'domain-list' ELSE 'other' END AS kind, match_method AS owner FROM zh_record WHERE spell_id IS NOT NULL),
x AS (SELECT *, trim(t0, ' ') AS t FROM r), dd AS (SELECT spell_id, CASE WHEN spell_id % 3 = 0 THEN 'choose' ELSE 'needs_human' END AS decision, min(source_key) AS ck, min(zh_name) AS ctext FROM (SELECT CASE WHEN spell_id % 3 = 1 THEN -spell_id ELSE spell_id END AS spell_id, source_key, zh_name FROM zh_record) q WHERE spell_id IS NOT NULL GROUP BY 1),
j AS (SELECT x.*, dd.decision, CASE WHEN dd.decision IS NULL THEN 0 WHEN source_key = ck THEN 0 WHEN t0 = ctext THEN 1 WHEN {_SV.format(c='t0')} = {_SV.format(c='ctext')} THEN 2 END AS tier, CASE WHEN dd.decision IS NULL THEN 0 ELSE CASE kind WHEN 'class-list' THEN 1 WHEN 'domain-list' THEN 3 ELSE 4 END END AS kr FROM x LEFT JOIN dd ON dd.spell_id = x.spell_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spell_id ORDER BY tier, length(t), kr, coalesce(source_key, ''), coalesce(owner, '')) AS rk FROM j WHERE (decision IS NOT NULL AND tier IS NOT NULL) OR (decision IS NULL AND t <> '')) q WHERE rk = 1),
g AS (SELECT spell_id, max(decision) AS decision, count(DISTINCT CASE WHEN t <> '' THEN {_SV.format(c='t')} END) AS n FROM j GROUP BY 1),
f AS (SELECT g.spell_id, b.t, b.source_key, CASE WHEN g.decision = 'needs_human' THEN 'conflict-needs-human' WHEN g.decision IS NOT NULL AND b.spell_id IS NULL THEN 'conflict-unmatched' WHEN g.decision IS NULL AND n > 1 THEN 'unreviewed-variants' WHEN b.spell_id IS NULL OR b.t = '' THEN 'empty' WHEN b.source_key IS NULL OR b.rulebook_abbr IS NULL THEN 'incomplete' END AS reason FROM g LEFT JOIN b ON b.spell_id = g.spell_id)
SELECT spell_id, CASE WHEN reason IS NULL THEN t END AS summary_text, CASE WHEN reason IS NULL THEN source_key END AS source_key, reason FROM f""")
def q_choose_summaries(spark, d):
    z, k = table(spark, d, "zh_record").where("spell_id is not null"), F.col("rec_id")
    text = F.when(k % 6 == 0, F.concat("zh_name", F.lit("。"))).when(k % 19 == 0, " ").otherwise(F.coalesce("en_name", "zh_name"))
    r = z.select("spell_id", "rulebook_abbr", text.alias("summary_text"), "source_key", F.when(k % 4 == 0, "class-list").when(k % 4 == 1, "domain-list").otherwise("other").alias("source_kind"), F.col("match_method").alias("list_owner"))
    dec = z.withColumn("spell_id", F.when(F.col("spell_id") % 3 == 1, -F.col("spell_id")).otherwise(F.col("spell_id"))).groupBy("spell_id").agg(F.min("source_key").alias("chosen_key"), F.min("zh_name").alias("chosen_text")).withColumn("decision", F.when(F.col("spell_id") % 3 == 0, "choose").otherwise("needs_human"))
    return corpus.choose_summaries(r, dec)


_ITEMS = "i AS (SELECT rec_id AS item_id, min(CASE WHEN rec_id % 9 = 0 THEN NULL WHEN rec_id % 8 = 0 THEN 'nowhere' ELSE rulebook_abbr END) AS abbr, min(CASE WHEN rec_id % 7 = 0 THEN ' ' ELSE en_name END) AS name, min(CASE WHEN rec_id % 5 = 0 THEN NULL ELSE zh_name END) AS summary FROM zh_record GROUP BY 1)"


def _items(spark, d):
    k = F.col("rec_id")
    return table(spark, d, "zh_record").groupBy(k.alias("item_id")).agg(F.min(F.when(k % 9 == 0, None).when(k % 8 == 0, "nowhere").otherwise(F.col("rulebook_abbr"))).alias("abbr"), F.min(F.when(k % 7 == 0, " ").otherwise(F.col("en_name"))).alias("name"), F.min(F.when(k % 5 != 0, F.col("zh_name"))).alias("summary"))


_SPELL_BOOKS = f"sb AS (SELECT s.id, {_MN.format(c='s.name')} AS n, b.abbr FROM s JOIN lookup_entry b ON b.kind = 'rulebook' AND b.id = s.rulebook_id)"


def _spell_books(spark, d):
    b = table(spark, d, "lookup_entry").where("kind = 'rulebook'")
    return spells(spark, d).join(b.select(F.col("id").alias("rulebook_id"), "abbr"), "rulebook_id").select("id", "name", "abbr")


@query(f"""WITH {S}, {_SPELL_BOOKS}, {_ITEMS}, m AS (SELECT i.*, {_MN.format(c='i.name')} AS n FROM i), g AS (SELECT abbr, n, count(DISTINCT id) AS k, min(id) AS id FROM sb GROUP BY 1, 2),
j AS (SELECT m.item_id, g.id, CASE WHEN trim(coalesce(m.abbr, '')) = '' THEN 'source-without-book' WHEN m.abbr NOT IN (SELECT abbr FROM lookup_entry WHERE kind = 'rulebook' AND abbr IS NOT NULL) THEN 'book-not-known' WHEN trim(coalesce(m.name, '')) = '' THEN 'missing-name' WHEN trim(coalesce(m.summary, '')) = '' THEN 'missing-summary' WHEN g.k IS NULL THEN 'no-match' WHEN g.k > 1 THEN 'ambiguous' END AS r FROM m LEFT JOIN g ON g.abbr = m.abbr AND g.n = m.n),
f AS (SELECT *, min(CASE WHEN r IS NULL THEN item_id END) OVER (PARTITION BY id) AS first FROM j) SELECT item_id, CASE WHEN r IS NULL AND first = item_id THEN id END AS spell_id, coalesce(r, CASE WHEN first <> item_id THEN 'duplicate' END) AS reason FROM f""")
def q_match_items(spark, d):
    return corpus.match_items(_items(spark, d), _spell_books(spark, d), table(spark, d, "lookup_entry").where("kind = 'rulebook' and abbr is not null"))


@query(f"WITH {S}, {_SPELL_BOOKS}, {_ITEMS}, m AS (SELECT i.*, {_MN.format(c='i.name')} AS n FROM i) SELECT item_id, CASE WHEN abbr IS NULL THEN 'unmapped' WHEN EXISTS (SELECT 1 FROM sb WHERE sb.n = m.n) THEN 'not-in-source-book' ELSE 'not-in-db' END AS gap FROM m WHERE NOT EXISTS (SELECT 1 FROM sb WHERE sb.n = m.n AND sb.abbr = m.abbr)")
def q_source_gaps(spark, d):
    return corpus.source_gaps(_items(spark, d), _spell_books(spark, d))


_REUSE = "dd AS (SELECT DISTINCT l_suppkey AS target, l_partkey AS source, CASE WHEN l_linestatus = 'F' THEN 'auto' ELSE 'reviewed' END AS origin, CASE WHEN l_returnflag = 'R' THEN 'reject' ELSE 'accept' END AS decision FROM lineitem), cc AS (SELECT DISTINCT l_suppkey AS target, l_partkey AS source FROM lineitem WHERE l_quantity < 25)"


@query(f"""WITH {_REUSE}, j AS (SELECT dd.*, CASE WHEN decision <> 'accept' THEN 'not-accepted' WHEN cc.target IS NULL THEN 'stale' END AS r FROM dd LEFT JOIN cc ON cc.target = dd.target AND cc.source = dd.source),
f AS (SELECT target, arg_min(source, (origin <> 'auto', source, origin)) AS s1, arg_min(origin, (origin <> 'auto', source, origin)) AS o1 FROM j WHERE r IS NULL GROUP BY 1) SELECT j.target, j.source, j.origin, coalesce(r, CASE WHEN NOT (s1 = source AND o1 = origin) THEN 'duplicate' END) AS reason FROM j LEFT JOIN f ON f.target = j.target""")
def q_apply_reuse(spark, d):
    li = table(spark, d, "lineitem")
    dec = li.select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("source"), F.when(F.col("l_linestatus") == "F", "auto").otherwise("reviewed").alias("origin"), F.when(F.col("l_returnflag") == "R", "reject").otherwise("accept").alias("decision")).distinct()
    cand = li.where("l_quantity < 25").select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("source"))
    return corpus.apply_reuse(dec, cand)


@query("""WITH b AS (SELECT en_name AS name, spell_id AS target, count(*) AS k, max(CASE WHEN confidence < 0.4 THEN 3 WHEN confidence < 0.7 THEN 2 WHEN match_method IS NOT NULL THEN 1 ELSE 0 END) AS s FROM zh_record WHERE en_name IS NOT NULL GROUP BY 1, 2)
SELECT name, CAST(sum(k) AS BIGINT) AS n, count(target) AS n_targets, coalesce(string_agg(target || 'x' || k, ',' ORDER BY target) FILTER (target IS NOT NULL), '') AS targets, ['none', 'accepted', 'needs_check', 'needs_human'][max(s) + 1] AS review FROM b GROUP BY 1""")
def q_alias_audit(spark, d):
    review = F.when(F.col("confidence") < 0.4, "needs_human").when(F.col("confidence") < 0.7, "needs_check").when(F.col("match_method").isNotNull(), "accepted")
    return corpus.alias_audit(table(spark, d, "zh_record").select(F.col("en_name").alias("name"), F.col("spell_id").alias("target"), review.alias("review")))


@query(f"WITH {S}, u AS (SELECT name, 0 AS source, id AS place FROM s UNION ALL SELECT name, 1, spell_id FROM i18n_spell_text WHERE name IS NOT NULL) SELECT name, source, place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source, place) AS rk FROM u) q WHERE rk = 1")
def q_ordered_union(spark, d):
    t = table(spark, d, "i18n_spell_text").where("name is not null")
    return corpus.ordered_union([spells(spark, d), t.select("name", F.col("spell_id").alias("id"))], "name", "id")


@query("""WITH l AS (SELECT DISTINCT zh_name AS name FROM zh_record), r AS (SELECT DISTINCT en_name AS name FROM zh_record WHERE en_name IS NOT NULL), a AS (SELECT DISTINCT CASE WHEN rec_id % 5 = 0 THEN zh_name || '?' ELSE zh_name END AS x, CASE WHEN rec_id % 9 = 0 THEN en_name || '!' ELSE en_name END AS y FROM zh_record WHERE en_name IS NOT NULL)
SELECT name, 'left-unpaired' AS error FROM l WHERE name NOT IN (SELECT x FROM a) UNION ALL SELECT name, 'right-unpaired' FROM r WHERE name NOT IN (SELECT y FROM a) UNION ALL SELECT DISTINCT y, 'unknown-right' FROM a WHERE y NOT IN (SELECT name FROM r) UNION ALL SELECT DISTINCT x, 'unknown-left' FROM a WHERE x NOT IN (SELECT name FROM l)
UNION ALL SELECT x, 'left-twice' FROM a GROUP BY x HAVING count(*) > 1 UNION ALL SELECT y, 'right-twice' FROM a GROUP BY y HAVING count(*) > 1""")
def q_bijection_errors(spark, d):
    z = table(spark, d, "zh_record")
    a = z.where("en_name is not null").select(F.when(F.col("rec_id") % 5 == 0, F.concat("zh_name", F.lit("?"))).otherwise(F.col("zh_name")).alias("left_name"), F.when(F.col("rec_id") % 9 == 0, F.concat("en_name", F.lit("!"))).otherwise(F.col("en_name")).alias("right_name")).distinct()
    return corpus.bijection_errors(z.select(F.col("zh_name").alias("name")), z.where("en_name is not null").select(F.col("en_name").alias("name")), a)


@query(f"WITH {S}, m AS ({MECHANIC_SQL}) SELECT 'mechanics by coverage' AS metric, split_part(parsed, '|', 6) AS key, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'issues by code', split_part(parsed, '|', 7), count(*) FROM m WHERE split_part(parsed, '|', 7) <> '' GROUP BY 2 UNION ALL SELECT 'spells by book', coalesce(CAST(rulebook_id AS VARCHAR), ''), count(*) FROM s GROUP BY 2")
def q_audit_bundle(spark, d):
    m = normalize.mechanics_of(spells(spark, d))
    return corpus.audit_bundle({"mechanics by coverage": (m, "coverage"), "issues by code": (m.where("issue_code is not null"), "issue_code"), "spells by book": (spells(spark, d), "rulebook_id")})


_EIGHT = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax", "l_suppkey", "l_quantity", "l_shipdate"]


@query(f"SELECT {', '.join(_EIGHT)}, count(*) AS n, count(*) FILTER (l_extendedprice > 50000) AS n_used FROM lineitem GROUP BY {', '.join(_EIGHT)}")
def q_stacked_rows(spark, d):
    return corpus.stacked_rows(table(spark, d, "lineitem").withColumn("used", F.col("l_extendedprice") > 50000), _EIGHT, "used")


_PATCH = f"""{S}, pp AS (SELECT CAST(500000 + id AS INT) AS id, name, id AS old FROM s), x AS (SELECT DISTINCT p.id, l.character_class_id, l.level FROM dnd_spellclasslevel l JOIN pp p ON p.old = l.spell_id WHERE l.character_class_id IS NOT NULL)"""


@query(f"WITH {_PATCH} SELECT (SELECT max(id) FROM dnd_spellclasslevel) + row_number() OVER (ORDER BY id, character_class_id, level) AS id, id AS spell_id, character_class_id, level FROM x")
def q_insert_patch(spark, d):
    levels = table(spark, d, "dnd_spellclasslevel")
    packed = levels.where("character_class_id is not null").groupBy(F.col("spell_id").alias("old")).agg(F.array_sort(F.collect_set(F.struct("character_class_id", "level"))).alias("levels"))
    patch = spells(spark, d).select((F.col("id") + 500000).cast("int").alias("id"), "name", F.col("id").alias("old")).join(packed, "old").drop("old")
    return corpus.insert_patch(patch, {"levels": (levels, "spell_id")})["levels"]


@query(f"WITH {S}, p AS (SELECT DISTINCT l.spell_id, l.level + CASE WHEN l.id % 4 = 0 THEN 1 ELSE 0 END AS level, upper(c.name) AS name, l.extra FROM dnd_spellclasslevel l JOIN lookup_entry c ON c.kind = 'characterclass' AND c.id = l.character_class_id) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM dnd_spellclasslevel l JOIN lookup_entry c ON c.kind = 'characterclass' AND c.id = l.character_class_id WHERE l.spell_id = p.spell_id AND l.level = p.level AND lower(c.name) = lower(p.name) AND coalesce(l.extra, '') = coalesce(p.extra, ''))")
def q_verify_children(spark, d):
    c = table(spark, d, "lookup_entry").where("kind = 'characterclass'").select(F.col("id").alias("character_class_id"), "name")
    held = table(spark, d, "dnd_spellclasslevel").join(c, "character_class_id")
    patch = held.select("spell_id", (F.col("level") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("level"), F.upper("name").alias("name"), "extra")
    return corpus.verify_children(patch, held.select("spell_id", "level", "name", "extra"), ["spell_id", "level"], "extra")


@query(f"WITH {S} SELECT 'spells' AS name, (SELECT count(*) FROM dnd_spell) AS n_left, (SELECT count(*) FROM s) AS n_right, (SELECT count(*) FROM dnd_spell) = (SELECT count(*) FROM s) AS same UNION ALL SELECT 'nations', (SELECT count(*) FROM nation), (SELECT count(DISTINCT n_nationkey) FROM nation), (SELECT count(*) FROM nation) = (SELECT count(DISTINCT n_nationkey) FROM nation)")
def q_count_parity(spark, d):
    n = table(spark, d, "nation")
    return corpus.count_parity({"spells": (table(spark, d, "dnd_spell"), spells(spark, d)), "nations": (n, n.select("n_nationkey").distinct())})


@query(f"WITH {S} SELECT id FROM s WHERE coalesce(verbal_component, FALSE) AND coalesce(somatic_component, FALSE) AND NOT coalesce(xp_component, FALSE)")
def q_component_flags(spark, d):
    flag = lambda c: F.coalesce(f"{c}_component", F.lit(False))
    return spells(spark, d).where(filters.all_of([flag("verbal"), flag("somatic"), ~flag("xp")])).select("id")


@query(f"WITH {S}, m AS ({MECHANIC_SQL}) SELECT id FROM s WHERE EXISTS (SELECT 1 FROM m WHERE m.spell_id = s.id AND mechanic_type = 'range' AND split_part(parsed, '|', 1) IN ('close', 'fixed') AND split_part(parsed, '|', 6) <> 'review')")
def q_mechanic_filter(spark, d):
    m = normalize.mechanics_of(spells(spark, d)).where("review_status = 'accepted' and mechanic_type = 'range'").withColumnRenamed("spell_id", "id")
    return filters.with_facet(spells(spark, d).select("id"), m, "id", F.col("category").isin("close", "fixed"))


@query(f"""WITH l AS (SELECT DISTINCT id, spell_id, character_class_id, level, extra FROM dnd_spellclasslevel), p AS (SELECT DISTINCT spell_id, character_class_id, level + id % 2 AS level, nullif(extra, '') AS extra FROM l)
SELECT l.id, p.spell_id IS NOT NULL AS found FROM l LEFT JOIN p ON p.spell_id = l.spell_id AND p.character_class_id = l.character_class_id AND p.level = l.level AND coalesce(p.extra, '') = coalesce(l.extra, '')""")
def q_nullsafe_left_join(spark, d):
    left = table(spark, d, "dnd_spellclasslevel").select("id", "spell_id", "character_class_id", "level", "extra").distinct()
    p = left.select("spell_id", "character_class_id", (F.col("level") + F.col("id") % 2).cast("int").alias("level"), F.nullif("extra", F.lit("")).alias("extra")).distinct()
    keys = ["spell_id", "character_class_id", "level"]
    r = p.select(*[F.col(c).alias(f"_{c}") for c in keys], F.coalesce("extra", F.lit("")).alias("_x"))
    on = [F.col(c) == F.col(f"_{c}") for c in keys] + [F.coalesce("extra", F.lit("")) == F.col("_x")]
    return left.join(r, on, "left").select("id", F.col("_spell_id").isNotNull().alias("found"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size END, 2147483647), p_name, p_partkey) AS place FROM part")
def q_sentinel_order(spark, d):
    from pyspark.sql.window import Window

    year = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(year.asc_nulls_last(), "p_name", "p_partkey")).alias("place"))


@query("SELECT coalesce(max(id), 0) + 1 AS next_level, (SELECT coalesce(max(id), 0) + 1 FROM dnd_spell WHERE id < 0) AS next_none FROM dnd_spellclasslevel")
def q_next_ids(spark, d):
    s, none = table(spark, d, "dnd_spellclasslevel"), table(spark, d, "dnd_spell").where("id < 0")
    return spark.range(1).select(corpus.next_id(s, "id").alias("next_level"), corpus.next_id(none, "id").alias("next_none"))


@query("""WITH h AS (SELECT source, count(*) AS n FROM parsed_spell GROUP BY 1), x AS (SELECT source, string_agg(name, '|' ORDER BY name) AS examples FROM (SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY name) AS r FROM (SELECT DISTINCT source, name FROM parsed_spell WHERE name IS NOT NULL) q) q2 WHERE r <= 5 GROUP BY 1)
SELECT h.source, h.n, x.examples, CASE WHEN regexp_matches(lower(h.source), '\\d') THEN 'numbered' WHEN regexp_matches(lower(h.source), '^(the )?annals|codex') THEN 'series' ELSE 'other' END AS class FROM h LEFT JOIN x ON x.source = h.source""")
def q_classified_labels(spark, d):
    out = editorial.classified_labels(table(spark, d, "parsed_spell"), "source", "name", [("numbered", r"\d"), ("series", "^(the )?annals|codex")], "other")
    return out.select("source", "n", F.array_join("examples", "|").alias("examples"), "class")


@query(f"""WITH {S}, p AS (SELECT DISTINCT rulebook_id AS book, lower(en_name) AS k FROM zh_record WHERE rulebook_id IS NOT NULL AND en_name IS NOT NULL), r AS (SELECT DISTINCT rulebook_id AS book, lower(name) AS k FROM s WHERE rulebook_id IS NOT NULL),
j AS (SELECT coalesce(p.book, r.book) AS book, count(p.k) AS n_parsed, count(r.k) AS n_reference, count(*) FILTER (p.k IS NULL) AS n_missing, count(*) FILTER (r.k IS NULL) AS n_extra FROM p FULL JOIN r ON p.book = r.book AND p.k = r.k GROUP BY 1)
SELECT *, CASE WHEN n_parsed = 0 THEN 'missing-book' WHEN n_reference = 0 THEN 'unknown-book' WHEN n_reference - n_missing < n_reference * 0.5 THEN 'below' ELSE 'ok' END AS status FROM j""")
def q_reference_report(spark, d):
    p = table(spark, d, "zh_record").where("rulebook_id is not null and en_name is not null").select(F.col("rulebook_id").alias("book"), F.lower("en_name").alias("k"))
    r = spells(spark, d).where("rulebook_id is not null").select(F.col("rulebook_id").alias("book"), F.lower("name").alias("k"))
    return editorial.reference_report(p, r, "book", "k", 0.5)


@query("""WITH l AS (SELECT l_linenumber AS level, l_comment AS name FROM (SELECT DISTINCT l_linenumber, l_returnflag || ' ' || l_partkey AS l_comment FROM lineitem WHERE l_linenumber IN (1, 2, 7)) q), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY lower(name), name) AS place FROM l)
SELECT place, coalesce(max(CASE WHEN level = 1 THEN name END), '') AS level_1, coalesce(max(CASE WHEN level = 2 THEN name END), '') AS level_2, coalesce(max(CASE WHEN level = 7 THEN name END), '') AS level_7 FROM r GROUP BY 1""")
def q_level_columns(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("level"), F.concat("l_returnflag", F.lit(" "), F.col("l_partkey").cast("string")).alias("name")).distinct()
    return writers.level_columns(rows, [1, 2, 7])
