"""Queries of search documents and ranking as stored, of text edits, reviews and label lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.catalog import table
from loomspark.functions import mechanics
from loomspark.functions import text as tx
from loomspark.operators import browse, filters, normalize, reconcile, resolve, search
from loomspark.plans.catalogue import S, spells
from loomspark.plans.records import MECHANIC_SQL
from loomspark.session import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_RAW = ["casting_time", "range_text", "target", "effect", "area", "duration", "saving_throw", "spell_resistance"]
_TYPES = list(normalize.MECHANIC_COLUMNS)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Search documents of the spells; summaries are the names of the records matched to them, by book."""
    s = spells(spark, d).withColumnRenamed("id", "spell_id")
    z = table(spark, d, "zh_record").where("spell_id is not null").select("spell_id", F.lit("zh").alias("lang"), F.coalesce("rulebook_abbr", F.lit("default")).alias("variant"), F.col("zh_name").alias("summary_text"))
    m = normalize.mechanics_of(spells(spark, d)).where("review_status = 'accepted'").withColumn("place", F.array_position(F.array(*[F.lit(t) for t in _TYPES]), F.col("mechanic_type")))
    return search.build_documents(s, table(spark, d, "i18n_spell_text"), z, m, _RAW)


def _uniq(col: str) -> str:
    return f"list_filter({col}, lambda v, i: list_position(list_transform({col}, lambda x: lower(x)), lower(v)) = i)"


def _full(expr: str) -> str:
    return f"list_filter(list_transform({expr}, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')"


DOCS = f"""{S}, mech AS ({MECHANIC_SQL}),
facet AS (SELECT m.spell_id, flatten(list([nullif(split_part(parsed, '|', 5), ''), nullif(trim(CASE mechanic_type {' '.join(f"WHEN '{t}' THEN s.{c}" for t, c in normalize.MECHANIC_COLUMNS.items())} END), ''), split_part(parsed, '|', 1)]
 ORDER BY list_position({_TYPES!r}, mechanic_type))) AS facets FROM mech m JOIN s ON s.id = m.spell_id WHERE split_part(parsed, '|', 6) <> 'review' GROUP BY 1),
tx AS (SELECT DISTINCT spell_id, lang, variant, name, description_text FROM i18n_spell_text),
loc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spell_id, lang, variant ORDER BY name DESC NULLS LAST, description_text DESC NULLS LAST) AS rk FROM tx) q WHERE rk = 1),
sm AS (SELECT DISTINCT spell_id, 'zh' AS lang, coalesce(rulebook_abbr, 'default') AS variant, zh_name AS summary_text FROM zh_record WHERE spell_id IS NOT NULL),
want AS (SELECT id AS spell_id, 'en' AS lang, 'default' AS variant FROM s UNION SELECT spell_id, lang, variant FROM loc UNION SELECT spell_id, lang, variant FROM sm),
nm AS (SELECT spell_id, list(name ORDER BY lang, variant, name) AS names FROM (SELECT DISTINCT spell_id, lang, variant, name FROM tx) q GROUP BY 1),
sums AS (SELECT w.spell_id, w.lang, w.variant, list(sm.summary_text ORDER BY (sm.variant <> w.variant), sm.variant, sm.summary_text) AS told FROM want w JOIN sm ON sm.spell_id = w.spell_id AND sm.lang = w.lang GROUP BY 1, 2, 3),
parts AS (SELECT w.*, coalesce(loc.name, s.name) AS name, coalesce(loc.description_text, CASE WHEN w.lang = 'en' AND w.variant = 'default' THEN s.description END, '') AS body,
 {_full("list_concat([s.name, replace(s.slug, '-', ' ')], coalesce(nm.names, []))")} AS a, {_full("coalesce(sums.told, [])")} AS b, {_full(f"list_concat([{', '.join(f's.{c}' for c in _RAW)}], coalesce(facet.facets, []))")} AS c
 FROM want w JOIN s ON s.id = w.spell_id LEFT JOIN loc ON loc.spell_id = w.spell_id AND loc.lang = w.lang AND loc.variant = w.variant LEFT JOIN nm ON nm.spell_id = w.spell_id LEFT JOIN sums ON sums.spell_id = w.spell_id AND sums.lang = w.lang AND sums.variant = w.variant LEFT JOIN facet ON facet.spell_id = w.spell_id),
docs AS (SELECT spell_id, lang, variant, name, array_to_string(list_filter({_uniq('a')}, lambda v: v <> name), chr(10)) AS aliases, array_to_string({_uniq('b')}, chr(10)) AS summary, array_to_string({_uniq('c')}, chr(10)) AS mechanics, body FROM parts)"""


@query(f"WITH {DOCS} SELECT * FROM docs")
def q_search_documents(spark, d):
    return _documents(spark, d)


_WEIGHTS = {"name": 12, "aliases": 8, "summary": 4, "mechanics": 2, "body": 1}


def _ranked_sql(tokens: list[str], where: str = "TRUE") -> str:
    hits = lambda t: " + ".join(f"{w} * (length({c}) - length(replace(lower({c}), '{t}', ''))) / {len(t)}" for c, w in _WEIGHTS.items())
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(tokens)))
    return (
        f"{DOCS}, f AS (SELECT spell_id, {', '.join(f'{hits(t)} AS f{i}' for i, t in enumerate(tokens))}, {' + '.join(f'greatest(0, length({c}) - 2)' for c in _WEIGHTS)} AS dl FROM docs), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (f{i} > 0) AS n{i}' for i in range(len(tokens)))} FROM f), "
        f"best AS (SELECT spell_id, max({score}) AS score FROM f, st WHERE {' AND '.join(f'f{i} > 0' for i in range(len(tokens)))} GROUP BY 1), hit AS (SELECT b.spell_id, s.name, b.score FROM best b JOIN s ON s.id = b.spell_id WHERE {where})"
    )


def _index(spark: SparkSession, d: str) -> search.SearchIndex:
    index = search.SearchIndex(spark, scratch(spark, "search"))
    index.write(_documents(spark, d))
    return index


@query(f"WITH {_ranked_sql(['minute', 'lantern'])} SELECT spell_id, round(score, 6) AS score FROM hit ORDER BY score DESC, lower(name), spell_id LIMIT 10 OFFSET 5")
def q_fts_spells(spark, d):
    hits = _index(spark, d).search("lantern MINUTE of lantern")
    named = hits.join(spells(spark, d).select(F.col("id").alias("spell_id"), "name"), "spell_id")
    page = named.orderBy(F.col("score").desc(), F.lower("name"), "spell_id").offset(5).limit(10)
    return page.select("spell_id", F.round("score", 6).alias("score"))


@query(f"WITH {_ranked_sql(['standard action'[:8]], 's.school_id IN (1, 2, 3)')} SELECT count(*) AS total FROM hit")
def q_fts_total(spark, d):
    some = spells(spark, d).where("school_id in (1, 2, 3)").select(F.col("id").alias("spell_id"))
    return _index(spark, d).search("standard", eligible=some).agg(F.count("*").alias("total"))


@query(f"WITH {_ranked_sql(['round'])} SELECT spell_id, round(score, 6) AS score FROM hit")
def q_fts_best_document(spark, d):
    return _index(spark, d).search("round").select("spell_id", F.round("score", 6).alias("score"))


# --- text edits

_PLAIN = "trim(regexp_replace(translate({t}, '‘’“”', {q}), '\\s+', ' ', 'g'))"
_FOLD = _PLAIN.format(t="t0", q="chr(39) || chr(39) || chr(34) || chr(34)")


@query(f"""WITH {S}, a AS (SELECT id, description AS t0, {_FOLD.replace('t0', 'description')} AS p0 FROM s),
b AS (SELECT id, CASE WHEN contains(p0, 'Whoever casts') THEN t0 WHEN contains(p0, 'The caster') THEN substr(p0, 1, strpos(p0, 'The caster') - 1) || 'Whoever casts' || substr(p0, strpos(p0, 'The caster') + 10) ELSE t0 END AS t1,
 CASE WHEN contains(p0, 'Whoever casts') THEN 'already-present' WHEN contains(p0, 'The caster') THEN 'applied' ELSE 'target-not-found' END AS s1 FROM a),
c AS (SELECT id, s1, t1, strpos(t1, 'It ') AS pos FROM b),
e AS (SELECT id, s1, t1, pos, regexp_extract(substr(t1, pos), '^((?:[^.!?]|[.!?]\\S)*[.!?])(?:\\s|$)', 1) AS gone FROM c),
f AS (SELECT id, s1, CASE WHEN pos = 0 THEN 'already-present' WHEN gone = '' THEN 'target-not-found' ELSE 'applied' END AS s2, CASE WHEN pos = 0 OR gone = '' THEN t1 ELSE regexp_replace(substr(t1, 1, pos - 1) || ltrim(substr(t1, pos + length(gone)), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g') END AS t2 FROM e),
g AS (SELECT id, s1, s2, t2, {_FOLD.replace('t0', 't2')} AS p2 FROM f)
SELECT id, CASE WHEN contains(p2, 'strictly within') THEN t2 WHEN contains(p2, 'within') THEN substr(p2, 1, length(p2) - strpos(reverse(p2), 'nihtiw') - 5) || 'strictly within' || substr(p2, length(p2) - strpos(reverse(p2), 'nihtiw') + 2) ELSE t2 END AS text,
 s1 || ',' || s2 || ',' || CASE WHEN contains(p2, 'strictly within') THEN 'already-present' WHEN contains(p2, 'within') THEN 'applied' ELSE 'target-not-found' END AS statuses FROM g""")
def q_text_edits(spark, d):
    s = spells(spark, d).select("id", "description")
    edit = lambda no, op, find, value, count=None, occurrence=None: F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in (("edit_no", no, "int"), ("op", op, "string"), ("find", find, "string"), ("value", value, "string"), ("count", count, "int"), ("occurrence", occurrence, "string"))])
    listed = F.array(edit(1, "replace", "The caster", "Whoever casts"), edit(2, "delete_sentences", "It ", None, 1), edit(3, "insert_before", "within", "strictly", None, "last"))
    edits = s.select("id", F.explode(listed).alias("e")).select("id", "e.*")
    return reconcile.apply_text_edits(s, edits, "id", "description").select("id", "text", F.array_join("statuses", ",").alias("statuses"))


_REVIEWS = """prev AS (SELECT p_partkey AS k, p_brand AS category, p_type AS evidence_ids, substr(p_type, 1, 4) AS flags, sha256(p_name) AS fingerprint, CASE WHEN p_size % 3 = 0 THEN 'proposed' WHEN p_size % 3 = 1 THEN 'accepted' ELSE 'rejected' END AS status FROM part),
cur AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 'other' ELSE p_brand END AS category, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS evidence_ids, CASE WHEN p_size % 11 = 0 THEN 'x' ELSE substr(p_type, 1, 4) END AS flags, CASE WHEN p_size % 13 = 0 THEN sha256(p_type) ELSE sha256(p_name) END AS fingerprint, CASE WHEN p_size % 2 = 0 THEN 'proposed' ELSE 'accepted' END AS status FROM part)"""


def _reviews(spark, d):
    p, n = table(spark, d, "part"), F.col("p_size")
    status = F.when(n % 3 == 0, "proposed").when(n % 3 == 1, "accepted").otherwise("rejected")
    prev = p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("category"), F.col("p_type").alias("evidence_ids"), F.substring("p_type", 1, 4).alias("flags"), F.sha2("p_name", 256).alias("fingerprint"), status.alias("status"))
    cur = p.select(
        F.col("p_partkey").alias("k"), F.when(n % 5 == 0, "other").otherwise(F.col("p_brand")).alias("category"), F.when(n % 7 != 0, F.col("p_type")).alias("evidence_ids"), F.when(n % 11 == 0, "x").otherwise(F.substring("p_type", 1, 4)).alias("flags"),
        F.when(n % 13 == 0, F.sha2("p_type", 256)).otherwise(F.sha2("p_name", 256)).alias("fingerprint"), F.when(n % 2 == 0, "proposed").otherwise("accepted").alias("status"),
    )
    return prev, cur


_SAME = "p.category = c.category AND p.evidence_ids = c.evidence_ids AND p.flags = c.flags AND p.fingerprint = c.fingerprint"


@query(f"WITH {_REVIEWS} SELECT c.k, c.category, c.evidence_ids, c.flags, c.fingerprint, CASE WHEN {_SAME} THEN p.status ELSE c.status END AS status, coalesce({_SAME}, FALSE) AS carried FROM cur c JOIN prev p ON p.k = c.k")
def q_merge_reviews(spark, d):
    prev, cur = _reviews(spark, d)
    return reconcile.merge_reviews(prev, cur, "k")


@query(f"WITH {_REVIEWS} SELECT c.k, CASE WHEN {_SAME} AND NOT (p.status = 'proposed' AND c.status <> 'proposed') THEN p.status ELSE c.status END AS status FROM cur c JOIN prev p ON p.k = c.k")
def q_merge_full_reviews(spark, d):
    prev, cur = _reviews(spark, d)
    return reconcile.merge_reviews(prev, cur, "k", full=True).select("k", "status")


# --- labels

_BOOKS = "b AS (SELECT id, name, abbr, name_zh FROM lookup_entry WHERE kind = 'rulebook')"


@query(f"""WITH n AS (SELECT DISTINCT parsed_id, source FROM parsed_spell WHERE source IS NOT NULL), {_BOOKS},
u AS (SELECT rule, k, min(id) AS id FROM (SELECT 1 AS rule, lower(name) AS k, id FROM b UNION ALL SELECT 2, lower(abbr), id FROM b WHERE abbr IS NOT NULL UNION ALL SELECT 3, lower(name_zh), id FROM b) q GROUP BY rule, k HAVING count(DISTINCT id) = 1),
h AS (SELECT n.parsed_id, n.source, u.id AS target, 2 * u.rule AS r FROM n JOIN u ON u.k = lower(trim(n.source)) UNION ALL SELECT n.parsed_id, n.source, u.id, 2 * u.rule + 1 FROM n JOIN u ON contains(n.source, ':') AND u.k = trim(split_part(lower(trim(n.source)), ':', -1)))
SELECT n.parsed_id, arg_min(h.target, h.r) AS target, CASE min(h.r) // 2 WHEN 1 THEN 'name' WHEN 2 THEN 'abbr' WHEN 3 THEN 'zh' END || CASE WHEN min(h.r) % 2 = 1 THEN ':suffix' ELSE '' END AS rule FROM n LEFT JOIN h ON h.parsed_id = n.parsed_id AND h.source = n.source GROUP BY n.parsed_id, n.source""")
def q_label_cascade(spark, d):
    b = table(spark, d, "lookup_entry").where("kind = 'rulebook'")
    look = lambda c: b.where(F.col(c).isNotNull()).select(F.col(c).alias("key"), F.col("id").alias("target"))
    rows = table(spark, d, "parsed_spell").where("source is not null").select("parsed_id", "source").distinct()
    return resolve.resolve_label(rows, F.col("source"), [("name", look("name")), ("abbr", look("abbr")), ("zh", look("name_zh"))]).select("parsed_id", "target", "rule")


@query("""WITH l AS (SELECT kind, id, lower(trim(name)) AS k FROM lookup_entry WHERE kind IN ('school', 'subschool')), u AS (SELECT k, arg_max(id, kind || lpad(CAST(id AS VARCHAR), 9, '0')) AS target FROM l GROUP BY k)
SELECT DISTINCT p.parsed_id, u.target, CASE WHEN trim(coalesce(p.school, '')) = '' THEN 'required' WHEN u.target IS NULL THEN 'not-found' END AS error FROM parsed_spell p LEFT JOIN u ON u.k = lower(trim(p.school))""")
def q_lookup_ids(spark, d):
    look = table(spark, d, "lookup_entry").where("kind in ('school', 'subschool')").select(F.col("name").alias("key"), F.col("id").alias("target"), F.concat("kind", F.lpad(F.col("id").cast("string"), 9, "0")).alias("place"))
    return resolve.lookup_ids(table(spark, d, "parsed_spell").select("parsed_id", "school"), "school", look, "place", required=True).select("parsed_id", "target", "error").distinct()


@query("""WITH RECURSIVE z AS (SELECT DISTINCT en_name AS name FROM zh_record WHERE en_name IS NOT NULL), al AS (SELECT lower(name) AS f, min(slug) AS t FROM lookup_entry GROUP BY 1), more AS (SELECT lower(slug) AS f, abbr AS t FROM lookup_entry WHERE abbr IS NOT NULL UNION SELECT lower(name), abbr FROM lookup_entry WHERE abbr IS NOT NULL),
w AS (SELECT name, name AS here, 0 AS hop, [lower(name)] AS seen FROM z UNION ALL SELECT w.name, al.t, hop + 1, list_append(seen, lower(al.t)) FROM w JOIN al ON al.f = lower(w.here) WHERE hop < 8 AND NOT list_contains(seen, lower(al.t))),
e AS (SELECT name, arg_max(here, hop) AS here FROM w GROUP BY 1), c AS (SELECT name, name AS candidate FROM e UNION SELECT name, here FROM e), a AS (SELECT * FROM c UNION SELECT c.name, more.t FROM c JOIN more ON more.f = lower(c.candidate))
SELECT name, min(candidate) AS candidate FROM a GROUP BY name, lower(candidate)""")
def q_alias_names(spark, d):
    e = table(spark, d, "lookup_entry")
    chain = e.select(F.col("name").alias("from_name"), F.col("slug").alias("to_name"))
    more = e.where("abbr is not null").select(F.explode(F.array("slug", "name")).alias("from_name"), F.col("abbr").alias("to_name")).distinct()
    return resolve.alias_names(table(spark, d, "zh_record").select(F.col("en_name").alias("name")), chain, more)


# --- names and canonical strings


@query(f"""WITH {S} SELECT id, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), '\\s*\\((m|f|df|xp|v|s|af|x)\\)\\s*$', ''), ',\\s*(greater|lesser)$', ' \\1')) AS k FROM s""")
def q_match_names(spark, d):
    return spells(spark, d).select("id", tx.match_name(F.col("name")).alias("k"))


@query("""WITH n AS (SELECT DISTINCT id, name || CASE id % 4 WHEN 0 THEN ' / ' || slug WHEN 1 THEN ' 2' WHEN 2 THEN '/' || upper(name) ELSE '' END AS name FROM lookup_entry WHERE kind = 'school' AND NOT contains(name, '/'))
SELECT id, variant FROM (SELECT id, CASE id % 4 WHEN 0 THEN split_part(name, ' / ', 1) WHEN 1 THEN name WHEN 2 THEN name ELSE name END AS variant FROM n UNION SELECT id, split_part(name, ' / ', 2) FROM n WHERE id % 4 = 0 UNION SELECT id, regexp_replace(name, '\\s+[0-9]+$', '') FROM n WHERE id % 4 = 1 UNION SELECT id, split_part(name, '/', 1) FROM n WHERE id % 4 = 2 UNION SELECT id, split_part(name, '/', 2) FROM n WHERE id % 4 = 2) q""")
def q_name_variants(spark, d):
    e = table(spark, d, "lookup_entry").where("kind = 'school' and not contains(name, '/')")
    tail = F.when(F.col("id") % 4 == 0, F.concat(F.lit(" / "), "slug")).when(F.col("id") % 4 == 1, " 2").when(F.col("id") % 4 == 2, F.concat(F.lit("/"), F.upper("name"))).otherwise("")
    return e.select("id", F.concat("name", tail).alias("name")).distinct().select("id", F.explode(tx.name_variants(F.col("name"))).alias("variant")).distinct()


@query(f"""WITH {S} SELECT id, concat_ws(', ', CASE WHEN verbal_component THEN 'V' END, CASE WHEN somatic_component THEN 'S' END, CASE WHEN material_component THEN 'M' END, CASE WHEN arcane_focus_component AND divine_focus_component THEN 'F/DF' WHEN arcane_focus_component THEN 'F' WHEN divine_focus_component THEN 'DF' END, CASE WHEN xp_component THEN 'XP' END, nullif(trim(extra_components, ' '), '')) AS components FROM s""")
def q_component_strings(spark, d):
    flags = {c: F.col(f"{c}_component") for c in ("verbal", "somatic", "material", "arcane_focus", "divine_focus", "xp")}
    return spells(spark, d).select("id", tx.component_key(flags, F.col("extra_components")).alias("components"))


@query("""WITH e AS (SELECT p.parsed_id, p.name, l.kind, l.name AS owner, CAST(p.parsed_id % 9 AS INT) AS level FROM (SELECT DISTINCT parsed_id, name, school FROM parsed_spell) p JOIN lookup_entry l ON l.kind = 'characterclass' AND l.id = p.parsed_id % 10)
SELECT parsed_id, regexp_replace(lower(owner), '[^a-z/]', '', 'g') || ' ' || level || ',sor/wiz ' || level AS k FROM e WHERE regexp_replace(lower(owner), '[^a-z/]', '', 'g') < 'sor/wiz'
UNION SELECT parsed_id, 'sor/wiz ' || level || ',' || regexp_replace(lower(owner), '[^a-z/]', '', 'g') || ' ' || level FROM e WHERE regexp_replace(lower(owner), '[^a-z/]', '', 'g') > 'sor/wiz'""")
def q_level_strings(spark, d):
    p = table(spark, d, "parsed_spell").select("parsed_id", (F.col("parsed_id") % 9).cast("int").alias("level"), (F.col("parsed_id") % 10).cast("int").alias("id")).distinct()
    j = p.join(table(spark, d, "lookup_entry").where("kind = 'characterclass'").select("id", F.col("name").alias("owner")), "id")
    line = F.concat(F.lit("Sor/Wiz "), F.col("level").cast("string"), F.lit(", "), F.col("owner"), F.lit(" "), F.col("level").cast("string"))
    return j.select("parsed_id", tx.level_key(line).alias("k")).distinct()


@query("SELECT DISTINCT parsed_id, json_extract_string(CASE WHEN json_valid(class_levels) THEN class_levels ELSE '{}' END, '$.bad') AS bad, len(json_keys(CASE WHEN json_valid(class_levels) THEN class_levels ELSE '{}' END)) AS n FROM parsed_spell")
def q_tolerant_json(spark, d):
    m = tx.tolerant_json(F.col("class_levels"), "map<string,string>")
    return table(spark, d, "parsed_spell").select("parsed_id", F.try_element_at(m, F.lit("bad")).alias("bad"), F.coalesce(F.size(F.map_keys(m)), F.lit(0)).cast("long").alias("n")).distinct()


@query(f"WITH {S} SELECT id, strftime(added, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(extract('millisecond' FROM added) % 1000 AS VARCHAR), 3, '0') || 'Z' AS added_at, strftime(added, '%Y-%m-%d') AS day, strftime(added, '%Y-%m') AS month FROM s")
def q_iso_dates(spark, d):
    s = spells(spark, d)
    day = tx.iso_date(F.date_format("added", "MMMM d, yyyy"))
    return s.select("id", tx.iso_time(F.col("added")).alias("added_at"), day.alias("day"), tx.iso_date(F.date_format("added", "yyyy/M")).alias("month"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS place FROM part")
def q_numeric_order(spark, d):
    label = F.concat(F.lit("Book "), F.col("p_size").cast("string"), F.lit(" part 000"), F.col("p_partkey").cast("string"))
    from pyspark.sql.window import Window

    # the order of all parts is the query: bounded runs are ranked first, then put one after another
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("run"), tx.numeric_order(label).alias("k"))
    within = rows.withColumn("at", F.row_number().over(Window.partitionBy("run").orderBy("k")))
    starts = rows.groupBy("run").agg(F.count("*").alias("n"), F.min("k").alias("first")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(starts.select("run", "before"), "run").select("p_partkey", (F.col("at") + F.col("before")).alias("place"))


# --- scalar functions

_TYPO = "translate({c}, '‘’‛“”„‐‑‒–—−', chr(39) || chr(39) || chr(39) || '\"\"\"------')"
_KEY = f"lower(trim(regexp_replace(regexp_replace({_TYPO.format(c='en_name')}, '(?i)\\s*\\(((m|f|df|xp)(\\s*[,/]\\s*)?)+\\)\\s*$', ''), '\\s+', ' ', 'g')))"


@query(f"""SELECT DISTINCT rec_id, {_TYPO.format(c='zh_name')} AS plain, translate(zh_name, '０１２３４５６７８９，：；（）！？', '0123456789,:;()!?') AS narrow, {_KEY} AS name_key, regexp_replace({_KEY}, '[^a-z0-9]+', '', 'g') AS compact,
 replace(replace(replace(replace(zh_description_html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, len(regexp_extract_all(lower(zh_name), '[\\p{{L}}\\p{{N}}]+')) AS n_tokens,
 length(regexp_replace(zh_name, '[^A-Za-z]', '', 'g')) >= 3 AND length(regexp_replace(zh_name, '[^\\x00-\\x7F]', '', 'g')) > 0.8 * length(zh_name) AS english, rec_id || ':' || coalesce(CAST(spell_id AS VARCHAR), '-') || ':' || source_key AS composite FROM zh_record""")
def q_text_scalars(spark, d):
    z, en = F.col("zh_name"), F.col("en_name")
    return table(spark, d, "zh_record").select(
        "rec_id", tx.fold_typography(z).alias("plain"), tx.fold_fullwidth(z).alias("narrow"), tx.name_key(en).alias("name_key"), tx.compact_key(en).alias("compact"), tx.escape_html(F.col("zh_description_html")).alias("escaped"),
        F.size(tx.unicode_tokens(z)).cast("long").alias("n_tokens"), tx.mostly_english(z).alias("english"), tx.composite_id(F.col("rec_id"), F.col("spell_id"), F.col("source_key")).alias("composite"),
    ).distinct()


@query("""SELECT DISTINCT parsed_id, trim(regexp_replace(CASE WHEN regexp_matches(x, '\\s[0-9]+\\s*$') THEN regexp_replace(x, '\\s+[0-9]+\\s*$', '') ELSE x END, '\\s+', ' ', 'g')) AS label, CAST(nullif(regexp_extract(x, '\\s([0-9]+)\\s*$', 1), '') AS INT) AS page FROM (SELECT parsed_id, unnest([trim(source), trim(trim(coalesce(school, '')) || ' ' || page)]) AS x FROM parsed_spell WHERE source IS NOT NULL AND page IS NOT NULL AND NOT contains(source, ';') AND NOT contains(coalesce(school, ''), ';')) q WHERE trim(x) <> ''""")
def q_source_appearances(spark, d):
    p = table(spark, d, "parsed_spell").where("source is not null and page is not null and not contains(source, ';') and not contains(coalesce(school, ''), ';')")
    listed = F.concat("source", F.lit("; "), F.trim(F.coalesce("school", F.lit(""))), F.lit(" "), "page")
    return p.select("parsed_id", F.explode(tx.appearances(listed)).alias("a")).select("parsed_id", "a.label", "a.page").distinct()


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') + 1 AS n_paragraphs, count(*) FILTER (l_returnflag <> 'N') AS n_rows, coalesce(string_agg(l_linestatus || '/' || l_linenumber, ';' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) FILTER (l_returnflag <> 'N'), '') AS cells FROM lineitem GROUP BY 1")
def q_body_blocks(spark, d):
    row = F.concat(F.lit(tx.ROW_OPENS + tx.CELL), "l_linestatus", F.lit(tx.CELL), F.col("l_linenumber").cast("string"), F.lit(tx.ROW_ENDS))
    line = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("text "), F.col("l_linenumber").cast("string"))).otherwise(row)
    packed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("t")))).alias("ls"))
    b = packed.select("l_orderkey", tx.body_blocks(F.concat(F.array(F.lit("head")), F.transform("ls", lambda x: x["t"]))).alias("b"))
    rows = F.filter("b", lambda x: x["kind"] == "table-row")
    return b.select("l_orderkey", F.size(F.filter("b", lambda x: x["kind"] == "paragraph")).cast("long").alias("n_paragraphs"), F.size(rows).cast("long").alias("n_rows"), F.array_join(F.transform(rows, lambda x: F.array_join(x["cells"], "/")), ";").alias("cells"))


@query(f"WITH {S}, m AS ({MECHANIC_SQL}), k AS (SELECT spell_id, mechanic_type, split_part(parsed, '|', 6) AS c, split_part(parsed, '|', 7) AS i, spell_id % 3 AS r FROM m) SELECT spell_id, mechanic_type, CASE WHEN r = 0 AND c = 'complete' THEN 'text-missing' WHEN r = 1 AND c <> 'review' THEN 'issue-unexpected' WHEN r = 2 AND c <> 'complete' THEN 'text-unexpected' ELSE '' END AS errors FROM k")
def q_mechanic_invariants(spark, d):
    m, r = normalize.mechanics_of(spells(spark, d)), F.col("spell_id") % 3
    text = F.when(r == 0, None).when((r == 2) & (F.col("coverage") != "complete"), "x").otherwise(F.col("normalized_text"))
    issue = F.when((r == 1) & (F.col("coverage") != "review"), "x").otherwise(F.col("issue_code"))
    broken = m.select("spell_id", "mechanic_type", F.struct("coverage", text.alias("normalized_text"), issue.alias("issue_code")).alias("v"))
    return broken.select("spell_id", "mechanic_type", F.array_join(mechanics.display_errors(F.col("v")), ",").alias("errors"))
