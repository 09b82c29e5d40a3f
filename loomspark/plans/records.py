"""Queries of joins, aggregates, windows, resolution, normalization, reconciliation and layout, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.catalog import table
from loomspark.functions import text as tx
from loomspark.operators import browse, layout, normalize, reconcile, resolve
from loomspark.plans.catalogue import S, spells

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# --- joins and sets


@query("SELECT l.id, p.id AS other_id FROM (SELECT DISTINCT id, spell_id, coalesce(extra, '') AS extra, level FROM dnd_spellclasslevel) l JOIN (SELECT DISTINCT id, spell_id, coalesce(extra, '') AS extra, level FROM dnd_spellclasslevel) p ON p.spell_id = l.spell_id AND p.level = l.level AND p.extra = l.extra AND p.id > l.id")
def q_nullsafe_join(spark, d):
    t = table(spark, d, "dnd_spellclasslevel").select("id", "spell_id", F.coalesce("extra", F.lit("")).alias("extra"), "level").distinct()
    return t.join(t.withColumnRenamed("id", "other_id"), ["spell_id", "level", "extra"]).where("other_id > id").select("id", "other_id")


@query("SELECT DISTINCT id, spell_id FROM dnd_spellclasslevel l WHERE NOT EXISTS (SELECT 1 FROM dnd_spell s WHERE s.id = l.spell_id)")
def q_anti(spark, d):
    return table(spark, d, "dnd_spellclasslevel").join(table(spark, d, "dnd_spell").select(F.col("id").alias("spell_id")), "spell_id", "left_anti").select("id", "spell_id").distinct()


@query("SELECT coalesce(a.k, b.k) AS spell_id, CASE WHEN b.k IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT id AS k FROM dnd_spell) a FULL JOIN (SELECT DISTINCT spell_id AS k FROM i18n_spell_text) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def q_symdiff(spark, d):
    a = table(spark, d, "dnd_spell").select(F.col("id").alias("spell_id"))
    return reconcile.symmetric_difference(a, table(spark, d, "i18n_spell_text").select("spell_id"), "spell_id")


@query("SELECT kind, src, count(*) AS n FROM (SELECT spell_id AS k, 'class' AS kind, 1 AS src FROM dnd_spellclasslevel UNION ALL SELECT spell_id, 'descriptor', 2 FROM dnd_spell_descriptors) q GROUP BY kind, src")
def q_union_all(spark, d):
    a = table(spark, d, "dnd_spellclasslevel").select("spell_id", F.lit("class").alias("kind"), F.lit(1).alias("src"))
    b = table(spark, d, "dnd_spell_descriptors").select("spell_id", F.lit("descriptor").alias("kind"), F.lit(2).alias("src"))
    return a.unionByName(b).groupBy("kind", "src").agg(F.count("*").alias("n"))


@query(f"WITH {S} SELECT s.id, r.name AS book, c.name AS school, u.name AS subschool FROM s JOIN lookup_entry c ON c.kind = 'school' AND c.id = s.school_id LEFT JOIN lookup_entry u ON u.kind = 'subschool' AND u.id = s.sub_school_id LEFT JOIN lookup_entry r ON r.kind = 'rulebook' AND r.id = s.rulebook_id")
def q_lookup_joins(spark, d):
    look = table(spark, d, "lookup_entry")
    of = lambda kind, key, name: look.where(F.col("kind") == kind).select(F.col("id").alias(key), F.col("name").alias(name))
    s = spells(spark, d).select("id", "school_id", "sub_school_id", "rulebook_id")
    return s.join(of("school", "school_id", "school"), "school_id").join(of("subschool", "sub_school_id", "subschool"), "sub_school_id", "left").join(of("rulebook", "rulebook_id", "book"), "rulebook_id", "left").select("id", "book", "school", "subschool")


# --- aggregates


@query("SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def q_zero_preserving_count(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def q_group_concat(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.expr("listagg(distinct c_mktsegment, ',') within group (order by c_mktsegment)").alias("segments"))


@query("SELECT * FROM (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned, count(*) AS lines FROM lineitem GROUP BY l_suppkey) q WHERE returned * 3 > lines")
def q_cond_sum_having(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("lines")).where("returned * 3 > lines")


@query("""PIVOT (SELECT rulebook_id, CASE WHEN school_id IN (SELECT id FROM lookup_entry WHERE kind = 'school') THEN 's' || school_id ELSE 'other' END AS c, 1 AS n FROM dnd_spell
 UNION ALL SELECT r.id, c.c, 0 FROM lookup_entry r CROSS JOIN (SELECT 's' || id AS c FROM lookup_entry WHERE kind = 'school' UNION ALL SELECT 'other') c WHERE r.kind = 'rulebook') ON c USING coalesce(CAST(sum(n) AS BIGINT), 0) GROUP BY rulebook_id""")
def q_pivot_all_schools(spark, d):
    e = table(spark, d, "lookup_entry")
    schools = e.where("kind = 'school'").select(F.col("id").alias("school_id"))
    books = e.where("kind = 'rulebook'").select(F.col("id").alias("rulebook_id"))
    return reconcile.pivot_counts(table(spark, d, "dnd_spell"), books, schools, "rulebook_id", "school_id", "s")


@query("SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, max(n) AS most FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) q GROUP BY l_returnflag")
def q_reaggregate(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return n.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.max("n").alias("most"))


@query(f"""WITH {S}, j AS (SELECT s.rulebook_id, s.id, max(CASE WHEN t.lang = 'zh' THEN 1 ELSE 0 END) AS zh, max(CASE WHEN x.spell_id IS NOT NULL THEN 1 ELSE 0 END) AS dx FROM s LEFT JOIN i18n_spell_text t ON t.spell_id = s.id LEFT JOIN dnd_spell_descriptors x ON x.spell_id = s.id GROUP BY s.rulebook_id, s.id)
SELECT rulebook_id, count(*) AS total, CAST(sum(zh) AS BIGINT) AS with_zh, CAST(sum(dx) AS BIGINT) AS with_descriptors, count(*) FILTER (WHERE zh = 0 AND dx = 0) AS missing_all FROM j GROUP BY GROUPING SETS ((rulebook_id), ())""")
def q_coverage(spark, d):
    zh = table(spark, d, "i18n_spell_text").where("lang = 'zh'").select(F.col("spell_id").alias("id"))
    dx = table(spark, d, "dnd_spell_descriptors").select(F.col("spell_id").alias("id"))
    return reconcile.coverage(spells(spark, d), "rulebook_id", "id", {"zh": zh, "descriptors": dx})


@query("SELECT md5_text, copies, first_id FROM (SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS md5_text, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1) q WHERE copies > 1")
def q_dup_groups(spark, d):
    t = table(spark, d, "documents").groupBy(F.sha2(tx.squeeze(F.col("text")), 256).alias("md5_text")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return t.where("copies > 1")


@query("SELECT spell_id, count(DISTINCT lower(trim(name))) AS n_texts FROM i18n_spell_text WHERE name IS NOT NULL AND trim(name) <> '' GROUP BY spell_id HAVING (count(DISTINCT CASE WHEN variant = 'chm' THEN lower(trim(name)) END) > 0 AND count(DISTINCT CASE WHEN variant = 'chm' THEN lower(trim(name)) END) >= 2) OR (count(DISTINCT CASE WHEN variant = 'chm' THEN lower(trim(name)) END) = 0 AND count(DISTINCT lower(trim(name))) >= 2)")
def q_conflicts(spark, d):
    t = table(spark, d, "i18n_spell_text")
    return reconcile.conflicts(t, "spell_id", "name", F.col("variant") == "chm")


# --- windows


@query("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rk FROM events GROUP BY event_type, user_id) q WHERE rk <= 10")
def q_topn_per_group(spark, d):
    n = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.col("n").desc(), "user_id")
    return n.withColumn("rk", F.row_number().over(w)).where("rk <= 10").drop("rk")


@query("SELECT spell_id, id FROM (SELECT spell_id, id, row_number() OVER (PARTITION BY spell_id ORDER BY length(description_text) DESC NULLS LAST, CASE variant WHEN 'chm' THEN 0 ELSE 1 END, id) AS rk FROM i18n_spell_text) q WHERE rk = 1")
def q_best_record(spark, d):
    rank = F.when(F.col("variant") == "chm", 0).otherwise(1)
    return browse.best_per_key(table(spark, d, "i18n_spell_text"), ["spell_id"], F.length("description_text").desc_nulls_last(), rank, F.col("id")).select("spell_id", "id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rk FROM events) q WHERE rk = 1")
def q_last_wins(spark, d):
    return browse.best_per_key(table(spark, d, "events"), ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_type", "event_id")


@query("SELECT name_key, first_id FROM (SELECT lower(name) AS name_key, min(parsed_id) AS first_id FROM parsed_spell GROUP BY 1) q")
def q_first_wins(spark, d):
    return browse.best_per_key(table(spark, d, "parsed_spell").withColumn("name_key", F.lower("name")), ["name_key"], F.col("parsed_id")).select("name_key", F.col("parsed_id").alias("first_id"))


@query("SELECT user_id, event_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type THEN 1 ELSE 0 END AS b FROM events) q")
def q_islands(spark, d):
    e = table(spark, d, "events")
    change = F.lag("event_type").over(layout.ordered(["user_id"], "ts", "event_id")) != F.col("event_type")
    return layout.islands(e, ["user_id"], ["ts", "event_id"], change).select("user_id", "event_id", "island")


@query("SELECT user_id, event_id, max(CASE WHEN event_type = 'login' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS login_event FROM events")
def q_fill_forward(spark, d):
    e = table(spark, d, "events").withColumn("l", F.when(F.col("event_type") == "login", F.col("event_id")))
    return layout.fill_forward(e, ["user_id"], ["event_id"], "l", "login_event").select("user_id", "event_id", "login_event")


@query("SELECT user_id, segment, min(pos) AS start_pos, max(pos) AS end_pos FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS pos, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM events) q WHERE segment > 0 GROUP BY 1, 2")
def q_segments(spark, d):
    return layout.segments(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")


@query("SELECT user_id, event_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) = 1 AS error_ahead FROM events")
def q_lookahead(spark, d):
    return layout.ahead(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 4, "error_ahead").select("user_id", "event_id", "error_ahead")


# --- resolution


@query(f"""WITH {S}, n AS (SELECT DISTINCT name FROM parsed_spell), m AS (SELECT n.name, count(DISTINCT s.id) AS k, min(s.id) AS id FROM n LEFT JOIN s ON lower(s.name) = lower(n.name) GROUP BY n.name)
SELECT name, CASE WHEN k = 0 THEN 'not_found' WHEN k = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, k AS n_matches, CASE WHEN k = 1 THEN id END AS id FROM m""")
def q_resolve(spark, d):
    names = table(spark, d, "parsed_spell").select("name").distinct()
    s = spells(spark, d).select("id", F.lower("name").alias("_k"))
    m = names.withColumn("_k", F.lower("name")).join(s, "_k").select("name", "id")
    return resolve.classify(m, "name", "id", names)


@query(f"""WITH {S}, n AS (SELECT DISTINCT name FROM parsed_spell), z AS (SELECT DISTINCT n.name, t.spell_id AS id FROM n JOIN i18n_spell_text t ON t.name = n.name), e AS (SELECT DISTINCT n.name, s.id FROM n JOIN s ON s.name = n.name)
SELECT name, id FROM z UNION ALL SELECT name, id FROM e WHERE name NOT IN (SELECT name FROM z)""")
def q_priority_match(spark, d):
    names = table(spark, d, "parsed_spell").select("name")
    zh = table(spark, d, "i18n_spell_text").where("name is not null").select("name", F.col("spell_id").alias("id"))
    return resolve.first_that_matches(names, "name", "id", [zh, spells(spark, d).select("name", "id")])


@query("""WITH RECURSIVE a(f, t) AS (VALUES ('small ring', 'red ring'), ('red ring', 'Blue Bolt'), ('blue bolt', 'hot gear'), ('old bolt', 'red bolt'), ('red bolt', 'old bolt'), ('hot gear', 'large plate')),
w AS (SELECT DISTINCT p_name AS name, p_name AS final_name, 0 AS hops, ',' || lower(p_name) || ',' AS seen FROM part UNION ALL SELECT w.name, a.t, w.hops + 1, w.seen || lower(a.t) || ',' FROM w JOIN a ON a.f = lower(w.final_name) WHERE w.hops < 8 AND position(',' || lower(a.t) || ',' IN w.seen) = 0)
SELECT name, final_name, hops FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY hops DESC) AS rk FROM w) q WHERE rk = 1""")
def q_alias_chain(spark, d):
    a = spark.createDataFrame([("small ring", "red ring"), ("red ring", "Blue Bolt"), ("blue bolt", "hot gear"), ("old bolt", "red bolt"), ("red bolt", "old bolt"), ("hot gear", "large plate")], "from_name string, to_name string")
    return resolve.alias_chain(table(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), F.broadcast(a))


@query(f"""WITH {S}, z AS (SELECT DISTINCT rec_id, en_name AS name, rulebook_id FROM zh_record WHERE en_name IS NOT NULL), x AS (SELECT z.rec_id, s.id, 'scoped' AS match_scope FROM z JOIN s ON s.name = z.name AND s.rulebook_id = z.rulebook_id)
SELECT * FROM x UNION ALL SELECT z.rec_id, s.id, 'global' FROM z JOIN s ON s.name = z.name WHERE z.rulebook_id IS NULL OR NOT EXISTS (SELECT 1 FROM s k WHERE k.name = z.name AND k.rulebook_id = z.rulebook_id)""")
def q_scoped_fallback(spark, d):
    z = table(spark, d, "zh_record").where("en_name is not null").select("rec_id", F.col("en_name").alias("name"), "rulebook_id").distinct()
    return resolve.scoped_or_global(z, spells(spark, d), "name", "rulebook_id", "id").select("rec_id", "id", "match_scope")


@query(f"""WITH {S}, l AS (SELECT DISTINCT rec_id, k FROM (SELECT rec_id, lower(en_name) AS k FROM zh_record UNION ALL SELECT rec_id, regexp_replace(lower(en_name), '[^a-z0-9]+', '', 'g') FROM zh_record UNION ALL SELECT rec_id, regexp_replace(lower(en_name), '^(.+), *(.+)$', '\\2 \\1') FROM zh_record) q WHERE k IS NOT NULL AND k <> ''),
r AS (SELECT DISTINCT id, k FROM (SELECT id, lower(name) AS k FROM s UNION ALL SELECT id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') FROM s) q WHERE k <> '')
SELECT DISTINCT rec_id, id FROM l JOIN r ON r.k = l.k""")
def q_multikey_match(spark, d):
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    z = table(spark, d, "zh_record").select("rec_id", "en_name")
    keys = [F.lower("en_name"), bare("en_name"), F.regexp_replace(F.lower("en_name"), r"^(.+), *(.+)$", "$2 $1")]
    return resolve.match_any_key(z, spells(spark, d), "rec_id", "id", keys, [F.lower("name"), bare("name")])


@query(f"WITH {S} SELECT id, min(id) OVER (PARTITION BY name) AS class_id, count(*) OVER (PARTITION BY name) - 1 AS n_others, count(*) OVER (PARTITION BY name, description) - 1 AS n_same_text FROM s")
def q_self_join_reuse(spark, d):
    return resolve.same_key_links(spells(spark, d), "name", "id", "description")


@query(f"WITH {S}, h AS (SELECT DISTINCT split_part(name, ' ', 1) AS head FROM s) SELECT s.id, h.head FROM s JOIN h ON lower(s.name) LIKE lower(h.head) || ' %'")
def q_prefix_join(spark, d):
    s = spells(spark, d).select("id", "name")
    return resolve.prefix_join(s, s.select(F.split_part("name", F.lit(" "), F.lit(1)).alias("head")), "name", "head").select("id", "head")


# --- normalization

_COMP = " UNION ALL ".join(f"SELECT id AS spell_id, '{c}' AS component_type, coalesce({c}_component, FALSE) AS present FROM s" for c in normalize.COMPONENTS)


@query(f"WITH {S} {_COMP}")
def q_unpivot_components(spark, d):
    return normalize.components(spells(spark, d))


@query(f"WITH {S} SELECT id AS spell_id, " + ", ".join(f"{c}_component" for c in normalize.COMPONENTS) + " FROM s")
def q_components_wide(spark, d):
    return normalize.components_wide(normalize.components(spells(spark, d)))


_N = "lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"


# What the rules texts say of each field, for SQL: (condition, category, amount, unit, text) in order; a text makes it complete.
_N1, _N2 = "regexp_extract(t, '^([0-9]+)', 1)", "nullif(regexp_extract(t, '([0-9]+)\\s*([a-z-]+)', 1), '')"
_U2 = "nullif(regexp_extract(t, '([0-9]+)\\s*([a-z-]+)', 2), '')"
_D = "CASE WHEN t LIKE '% (d)' THEN ' (D)' ELSE '' END"
_CAP = "upper(t[1]) || t[2:]"


def _count_of(noun: str) -> str:
    return f"CAST({_N1} AS INT) || ' {noun}' || CASE WHEN CAST({_N1} AS INT) = 1 THEN '' ELSE 's' END"


def _mechanic_rows(field: str) -> list[tuple[str, str, str, str, str | None]]:
    has = lambda w: f"contains(t, '{w}')"
    none = "NULL"
    if field == "casting_time":
        acts, times = ["immediate", "swift", "free", "standard", "full-round"], ["round", "minute", "hour"]
        out = [(f"regexp_full_match(t, '[0-9]+ {a} actions?')", f"'{a.replace('-', '_')}_action'", _N1, "'action'", _count_of(f"{a} action")) for a in acts]
        out += [(f"regexp_full_match(t, '[0-9]+ {u}s?')", f"'{u}'", _N1, f"'{u}'", _count_of(u)) for u in times]
        out += [(has(f"{a} action"), f"'{a.replace('-', '_')}_action'", _N2, "'action'", None) for a in acts]
        return out + [(has(u), f"'{u}'", _N2, f"'{u}'", None) for u in times]
    if field == "range_text":
        full = {"personal": "Personal", "touch": "Touch", "close": "Close (25 ft. + 5 ft./2 levels)", "medium": "Medium (100 ft. + 10 ft./level)", "long": "Long (400 ft. + 40 ft./level)", "unlimited": "Unlimited"}
        out = []
        for w, text in full.items():
            out += [(f"t IN ('{w}', '{text.lower()}')", f"'{w}'", none, none, f"'{text}'"), (f"starts_with(t, '{w}')", f"'{w}'", none, none, None)]
        out.append(("regexp_full_match(t, '[0-9]+ (ft|ft\\.|foot|feet)')", "'fixed'", _N1, "'ft'", f"CAST({_N1} AS INT) || ' ft.'"))
        return [*out, ("regexp_full_match(t, '[0-9]+ miles?')", "'fixed'", _N1, "'mile'", _count_of("mile")), ("regexp_matches(t, '^[0-9]')", "'fixed'", _N2, _U2, None)]
    if field == "duration":
        out = [(f"t IN ('{w}', '{w} (d)')", f"'{w}'", none, none, f"'{w.capitalize()}' || {_D}") for w in ("instantaneous", "permanent", "concentration")]
        out += [(f"regexp_full_match(t, '[0-9]+ {u}s?(/level)?( \\(d\\))?')", "'timed'", _N1, f"'{u}'", f"{_count_of(u)} || CASE WHEN contains(t, '/level') THEN '/level' ELSE '' END || {_D}") for u in ("round", "minute", "hour", "day")]
        return [*out, *[(has(w), f"'{w}'", none, none, None) for w in ("instantaneous", "permanent", "concentration")], (f"{_N2} IS NOT NULL", "'timed'", _N2, _U2, None)]
    notes = "( \\((harmless|object)(, (harmless|object))?\\))?"
    if field == "saving_throw":
        out = [("t IN ('none', 'no')", "'none'", none, none, "'None'")]
        out += [(f"regexp_full_match(t, '{w}( (negates|partial|half))?{notes}')", f"'{w}'", none, none, _CAP) for w in ("fortitude", "reflex", "will")]
        return [*out, *[(has(w), f"'{w}'", none, none, None) for w in ("fortitude", "reflex", "will")], ("starts_with(t, 'no ')", "'none'", none, none, None)]
    if field == "spell_resistance":
        return [*[(f"regexp_full_match(t, '{w}{notes}')", f"'{w}'", none, none, _CAP) for w in ("yes", "no")], *[(f"starts_with(t, '{w}')", f"'{w}'", none, none, None) for w in ("yes", "no")]]
    return [(has(w), f"'{w}'", none, none, None) for w in ("creature", "object", "area", "emanation", "burst", "spread", "ray")]


_SQL_FLAGS = {
    "duration": [("concentration", "contains(t, 'concentration')"), ("discharge", "contains(t, 'discharge')"), ("dismissible", "contains(t, '(d)') OR contains(t, 'dismissible')"), ("per_level", "regexp_full_match(t, '[0-9]+ (round|minute|hour|day)s?/level( \\(d\\))?')")],
    "saving_throw": [("allows_save", "t NOT IN ('', 'none', 'no')"), *[(w, f"contains(t, '{w}')") for w in ("fortitude", "half", "harmless", "negates", "object", "partial", "reflex", "will")]],
    "spell_resistance": [(w, f"contains(t, '{w}')") for w in ("harmless", "object")],
}


def _when_chain(t: str, field: str) -> str:
    """category|amount|unit|flags|text|coverage|issue of a mechanic text, in SQL."""
    kind = {"range_text": "range"}.get(field, field)
    review = f"{kind}.review" if field in ("casting_time", "range_text", "duration", "saving_throw", "spell_resistance") else "target_effect_area.review"
    flags = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _SQL_FLAGS[field]) + ")" if field in _SQL_FLAGS else "''"
    row = lambda c, a, u, x, v, i: f"concat_ws('|', {c}, coalesce(CAST(CAST({a} AS INT) AS VARCHAR), ''), coalesce({u}, ''), {flags}, {x or chr(39) * 2}, '{v}', '{i}')"
    blank = "'none'" if field == "saving_throw" else "'empty'"
    out = [f"WHEN t = '' THEN {row(blank, 'NULL', 'NULL', None, 'empty', '')}"]
    out += [f"WHEN {cond} THEN {row(c, a, u, x, 'complete' if x else 'partial', '')}" for cond, c, a, u, x in _mechanic_rows(field)]
    other = "'text'" if "target" in review else "'special'"
    return f"(SELECT CASE {' '.join(out)} ELSE {row(other, 'NULL', 'NULL', None, 'review', review)} END FROM (SELECT {t} AS t))"


MECHANIC_SQL = " UNION ALL ".join(f"SELECT id AS spell_id, '{t}' AS mechanic_type, {_when_chain(_N.format(c=c), c)} AS parsed FROM s" for t, c in normalize.MECHANIC_COLUMNS.items())


def _flat(of):
    """A mechanic's fields in one text; of gives a field by name."""
    return F.concat_ws("|", *[F.coalesce(of(c).cast("string"), F.lit("")) for c in ("category", "amount", "unit", "flags", "normalized_text", "coverage", "issue_code")])


@query(f"WITH {S} {MECHANIC_SQL}")
def q_mechanics(spark, d):
    m = normalize.mechanics_of(spells(spark, d))
    return m.select("spell_id", "mechanic_type", _flat(F.col).alias("parsed"))


_MADE = """made AS (SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN p_size || ' round' || CASE WHEN p_size = 1 THEN '' ELSE 's' END WHEN 1 THEN '1 standard action' WHEN 2 THEN p_size || ' minutes or a swift action' WHEN 3 THEN '2 Full-Round  Actions' WHEN 4 THEN 'see text' WHEN 5 THEN '' ELSE 'one hour' END AS casting_time,
 CASE p_partkey % 6 WHEN 0 THEN 'Close (25 ft. + 5 ft./2 levels)' WHEN 1 THEN p_size || ' ft.' WHEN 2 THEN p_size || ' miles' WHEN 3 THEN p_size || ' paces away' WHEN 4 THEN 'touch of a feather' ELSE 'sight' END AS range_text,
 CASE p_partkey % 5 WHEN 0 THEN p_size || ' rounds/level (D)' WHEN 1 THEN 'Instantaneous' WHEN 2 THEN 'Concentration, up to ' || p_size || ' minutes' WHEN 3 THEN 'until dawn' ELSE p_size || ' days or less' END AS duration,
 CASE p_partkey % 4 WHEN 0 THEN 'Will negates (harmless)' WHEN 1 THEN 'None' WHEN 2 THEN 'Reflex half; see text' ELSE 'no save' END AS saving_throw, CASE p_partkey % 3 WHEN 0 THEN 'Yes (harmless, object)' WHEN 1 THEN 'no' ELSE 'yes, see text' END AS spell_resistance FROM part)"""


@query(f"WITH {_MADE} SELECT id, " + ", ".join(f"{_when_chain(_N.format(c=c), c)} AS {c}" for c in ("casting_time", "range_text", "duration", "saving_throw", "spell_resistance")) + " FROM made")
def q_mechanics_made(spark, d):
    from loomspark.functions import mechanics

    p, k, n = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size").cast("string")
    case = lambda m, opts: F.element_at(F.array(*[o if not isinstance(o, str) else F.lit(o) for o in opts]), (k % m + 1).cast("int"))
    made = {
        "casting_time": case(7, [F.concat(n, F.lit(" round"), F.when(F.col("p_size") == 1, "").otherwise("s")), "1 standard action", F.concat(n, F.lit(" minutes or a swift action")), "2 Full-Round  Actions", "see text", "", "one hour"]),
        "range_text": case(6, ["Close (25 ft. + 5 ft./2 levels)", F.concat(n, F.lit(" ft.")), F.concat(n, F.lit(" miles")), F.concat(n, F.lit(" paces away")), "touch of a feather", "sight"]),
        "duration": case(5, [F.concat(n, F.lit(" rounds/level (D)")), "Instantaneous", F.concat(F.lit("Concentration, up to "), n, F.lit(" minutes")), "until dawn", F.concat(n, F.lit(" days or less"))]),
        "saving_throw": case(4, ["Will negates (harmless)", "None", "Reflex half; see text", "no save"]),
        "spell_resistance": case(3, ["Yes (harmless, object)", "no", "yes, see text"]),
    }
    readers = {"casting_time": "casting_time", "range_text": "range", "duration": "duration", "saving_throw": "saving_throw", "spell_resistance": "spell_resistance"}
    return p.select(k.alias("id"), *[_flat(lambda f, m=mechanics.READERS[readers[c]](v): m[f]).alias(c) for c, v in made.items()])


@query("""WITH l AS (SELECT DISTINCT id, spell_id, level, nullif(trim(coalesce(extra, '')), '') AS t FROM dnd_spellclasslevel)
SELECT id, CASE WHEN t IS NULL THEN NULL WHEN regexp_matches(t, '^\\([^)]+\\)$') THEN trim(substr(t, 2, length(t) - 2)) WHEN NOT (regexp_matches(lower(t), '^(see|except|only|including|as )') OR regexp_matches(lower(t), '[;,]|\\bor\\b|\\band\\b|[0-9]+\\s*gp|[0-9]+\\s*xp')) THEN t END AS variant_label,
 CASE WHEN t IS NOT NULL AND NOT regexp_matches(t, '^\\([^)]+\\)$') AND (regexp_matches(lower(t), '^(see|except|only|including|as )') OR regexp_matches(lower(t), '[;,]|\\bor\\b|\\band\\b|[0-9]+\\s*gp|[0-9]+\\s*xp')) THEN 'list.extra.review' END AS issue_code FROM l""")
def q_list_extras(spark, d):
    e = tx.list_extra(F.col("extra"))
    return table(spark, d, "dnd_spellclasslevel").select("id", "spell_id", "level", "extra").distinct().select("id", e["variant_label"].alias("variant_label"), e["issue_code"].alias("issue_code"))


@query(f"WITH {S}, m AS ({MECHANIC_SQL}) SELECT mechanic_type AS source_field, count(*) AS n FROM m WHERE split_part(parsed, '|', 6) = 'review' GROUP BY 1")
def q_issues(spark, d):
    i = normalize.issues(spells(spark, d), table(spark, d, "dnd_spellclasslevel"))
    return i.where("source_table = 'dnd_spell'").groupBy("source_field").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN f.facet ELSE p_type END AS facet, CASE WHEN p_type = 'PROMO' THEN f.o ELSE 0 END AS sort_order FROM part LEFT JOIN (VALUES ('PROMO', 0, 'SALE'), ('PROMO', 1, 'GIFT')) AS f(w, o, facet) ON f.w = p_type")
def q_split_facets(spark, d):
    combined = spark.createDataFrame([("PROMO", 0, "SALE"), ("PROMO", 1, "GIFT")], "whole string, part_order int, part string")
    return normalize.split_facets(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", combined).select("p_partkey", "facet", "sort_order")


@query("SELECT CASE WHEN regexp_matches(lower(name), '^see[\\s-]+text\\b') THEN 'see-text' ELSE lower(name) END AS bucket, count(*) AS n FROM lookup_entry WHERE kind = 'descriptor' GROUP BY 1")
def q_descriptor_buckets(spark, d):
    t = table(spark, d, "lookup_entry").where("kind = 'descriptor'")
    return normalize.descriptor_buckets(t).groupBy("bucket").agg(F.count("*").alias("n"))


# --- text functions


@query(f"WITH {S} SELECT id, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(regexp_replace(lower(trim(name)), '''', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug2, regexp_replace(name, '^(.+),\\s*(.+)$', '\\2 \\1') AS inverted FROM s")
def q_slug(spark, d):
    n = F.col("name")
    return spells(spark, d).select("id", tx.slug(n).alias("slug"), tx.slug(n, True).alias("slug2"), tx.invert_comma(n).alias("inverted"))


@query(f"WITH {S} SELECT id, len(regexp_extract_all(lower(description), '[a-z0-9]+(?:''[a-z0-9]+)*')) AS n_tokens, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(description_html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS plain FROM s")
def q_tokens_html(spark, d):
    return spells(spark, d).select("id", F.size(tx.tokens(F.col("description"))).cast("long").alias("n_tokens"), tx.strip_html(F.col("description_html")).alias("plain"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN trim(text) WHEN lower(lang) LIKE 'zh%' AND regexp_matches(trim(text), '[。！？]$') THEN trim(text) WHEN NOT coalesce(lower(lang) LIKE 'zh%', FALSE) AND regexp_matches(trim(text), '[.!?]$') THEN trim(text) WHEN lower(lang) LIKE 'zh%' THEN regexp_replace(trim(text), '[.,，、;；]+$', '') || '。' ELSE regexp_replace(trim(text), '[。，、,;；]+$', '') || '.' END AS fixed FROM documents")
def q_punct_fix(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.end_sentence(F.col("text"), F.coalesce("lang", F.lit(""))).alias("fixed"))


@query("SELECT DISTINCT id, sha256(concat_ws(chr(31), CAST(id AS VARCHAR), coalesce(lang, chr(0)), coalesce(name, chr(0)), coalesce(source_key, chr(0)))) AS fp FROM i18n_spell_text")
def q_fingerprint(spark, d):
    return table(spark, d, "i18n_spell_text").select("id", tx.fingerprint(F.col("id"), F.col("lang"), F.col("name"), F.col("source_key")).alias("fp")).distinct()


@query("SELECT DISTINCT parsed_id, trim(regexp_replace(src, '\\s+[0-9]+\\s*$', '')) AS label, TRY_CAST(nullif(regexp_extract(src, '\\s([0-9]+)\\s*$', 1), '') AS INTEGER) AS page FROM (SELECT parsed_id, regexp_replace(trim(source) || coalesce(' ' || page, ''), '\\s+', ' ', 'g') AS src FROM parsed_spell WHERE source IS NOT NULL) q")
def q_source_appearance(spark, d):
    t = table(spark, d, "parsed_spell").where("source is not null")
    a = tx.appearance_parts(tx.squeeze(F.concat(F.trim("source"), F.coalesce(F.concat(F.lit(" "), F.col("page")), F.lit("")))))
    return t.select("parsed_id", a["label"].alias("label"), a["page"].alias("page")).distinct()


@query("SELECT code, count(*) AS n FROM (SELECT 'empty' AS code FROM i18n_spell_text WHERE trim(coalesce(description_text, '')) = '' UNION ALL SELECT 'no-terminal' FROM i18n_spell_text WHERE trim(coalesce(description_text, '')) <> '' AND NOT regexp_matches(trim(description_text), '[.!?。！？]$') UNION ALL SELECT 'raw-html' FROM i18n_spell_text WHERE regexp_matches(coalesce(description_text, ''), '<[A-Za-z/][^>]*>') UNION ALL SELECT 'mojibake' FROM i18n_spell_text WHERE regexp_matches(coalesce(description_text, ''), '�|Ã.|â€')) q GROUP BY code")
def q_text_issues(spark, d):
    return table(spark, d, "i18n_spell_text").select(F.explode(tx.text_issues(F.col("description_text"))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


# --- reconciliation

_A = "a AS (SELECT CASE WHEN p_partkey % 10 = 3 THEN -p_partkey ELSE p_partkey END AS k, p_name AS name, p_type AS kind, p_size AS size FROM part)"
_B = "b AS (SELECT CASE WHEN p_partkey % 10 = 7 THEN -p_partkey ELSE p_partkey END AS k, CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) WHEN p_partkey % 13 = 0 THEN p_name || ' x' ELSE p_name END AS name, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type END AS kind, CASE WHEN p_partkey % 19 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part)"
_C = "c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 22 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 0 THEN p_name || ' y' ELSE p_name END AS name FROM part)"


def _snapshots(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    a = p.select(F.when(k % 10 == 3, -k).otherwise(k).alias("k"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
    name = F.when(k % 11 == 0, F.upper("p_name")).when(k % 13 == 0, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name"))
    b = p.select(F.when(k % 10 == 7, -k).otherwise(k).alias("k"), name.alias("name"), F.when(k % 17 != 0, F.col("p_type")).alias("kind"), F.when(k % 19 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"))
    c = p.select(k.alias("k"), F.when(k % 22 == 0, F.upper("p_name")).when(k % 5 == 0, F.concat("p_name", F.lit(" y"))).otherwise(F.col("p_name")).alias("name"))
    return a, b, c


@query(f"WITH {_A}, {_B} SELECT coalesce(x.name, y.name) AS name, coalesce(n1, 0) AS n_left, coalesce(n2, 0) AS n_right, CASE WHEN n2 IS NULL THEN 'left_only' WHEN n1 IS NULL THEN 'right_only' ELSE 'both' END AS membership FROM (SELECT name, count(*) AS n1 FROM a GROUP BY 1) x FULL JOIN (SELECT name, count(*) AS n2 FROM b GROUP BY 1) y ON x.name = y.name")
def q_full_outer_diff(spark, d):
    a, b, _ = _snapshots(spark, d)
    return reconcile.membership(a, b, "name")


_CMP = "CASE WHEN coalesce({x}, '') = coalesce({y}, '') THEN 'exact' WHEN trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]', '', 'g')) = trim(regexp_replace(lower(coalesce({y}, '')), '[^a-z0-9 ]', '', 'g')) THEN 'formatting' ELSE 'substantive' END"


@query(f"WITH {_A}, {_B}, j AS (SELECT a.k, {_CMP.format(x='a.name', y='b.name')} AS name_cmp, {_CMP.format(x='a.kind', y='b.kind')} AS kind_cmp FROM a JOIN b ON a.k = b.k) SELECT *, CASE WHEN 'substantive' IN (name_cmp, kind_cmp) THEN 'substantive' WHEN 'formatting' IN (name_cmp, kind_cmp) THEN 'formatting' ELSE 'exact' END AS worst FROM j")
def q_field_diff(spark, d):
    a, b, _ = _snapshots(spark, d)
    j = a.join(b.select("k", F.col("name").alias("name2"), F.col("kind").alias("kind2")), "k")
    j = j.select("k", reconcile.compare_text(F.col("name"), F.col("name2")).alias("name_cmp"), reconcile.compare_text(F.col("kind"), F.col("kind2")).alias("kind_cmp"))
    return j.withColumn("worst", reconcile.worst([F.col("name_cmp"), F.col("kind_cmp")]))


@query(f"WITH {_A}, {_B}, {_C} SELECT c.k, CASE WHEN a.name IS NULL OR b.name IS NULL THEN 'missing' WHEN a.name = b.name AND a.name = c.name THEN 'corroborated' WHEN a.name = c.name THEN 'ours-drift' WHEN a.name = b.name THEN 'theirs-drift' WHEN b.name = c.name THEN 'both-same-change' ELSE 'three-way' END AS disposition FROM c LEFT JOIN a ON a.k = c.k LEFT JOIN b ON b.k = c.k")
def q_three_way(spark, d):
    a, b, c = _snapshots(spark, d)
    j = c.withColumnRenamed("name", "c").join(a.select("k", F.col("name").alias("a")), "k", "left").join(b.select("k", F.col("name").alias("b")), "k", "left")
    return j.select("k", reconcile.three_way(F.col("a"), F.col("b"), F.col("c")).alias("disposition"))


@query(f"WITH {_A}, {_B} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL OR b.k IS NULL THEN '_row' WHEN a.name IS DISTINCT FROM b.name THEN 'name' WHEN a.kind IS DISTINCT FROM b.kind THEN 'kind' ELSE 'size' END AS field FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.name IS DISTINCT FROM b.name OR a.kind IS DISTINCT FROM b.kind OR a.size IS DISTINCT FROM b.size")
def q_parity(spark, d):
    a, b, _ = _snapshots(spark, d)
    return reconcile.first_mismatch(a, b, "k", ["name", "kind", "size"])


@query(f"WITH {_A}, {_B} SELECT b.k, CASE WHEN a.k IS NULL THEN 'inserted' WHEN a.name IS NOT DISTINCT FROM b.name AND a.kind IS NOT DISTINCT FROM b.kind AND a.size IS NOT DISTINCT FROM b.size THEN 'unchanged' ELSE 'updated' END AS action FROM b LEFT JOIN a ON a.k = b.k")
def q_upsert_plan(spark, d):
    a, b, _ = _snapshots(spark, d)
    return reconcile.upsert_plan(a, b, "k", ["name", "kind", "size"])


@query(f"WITH {_A}, {_B} SELECT * FROM b UNION ALL SELECT * FROM a WHERE k NOT IN (SELECT k FROM b)")
def q_upsert_applied(spark, d):
    a, b, _ = _snapshots(spark, d)
    return reconcile.apply_upsert(a, b, "k")


@query(f"WITH {_A}, {_B} SELECT a.k, CASE WHEN b.k IS NOT NULL AND a.k % 2 = 0 THEN b.name ELSE a.name END AS name, CASE WHEN b.k IS NOT NULL AND a.k % 3 = 0 THEN b.kind ELSE a.kind END AS kind, a.size FROM a LEFT JOIN b ON a.k = b.k")
def q_sparse_update(spark, d):
    a, b, _ = _snapshots(spark, d)
    patch = b.select("k", "name", "kind", (F.col("k") % 2 == 0).alias("set_name"), (F.col("k") % 3 == 0).alias("set_kind"))
    return reconcile.sparse_update(a, patch, "k", ["name", "kind"])


_TOK = "SELECT {k} AS spell_id, unnest(regexp_extract_all(lower({t}), '[a-z0-9]+(?:''[a-z0-9]+)*')) AS w FROM {f}"


@query(f"""WITH {S}, l AS (SELECT spell_id, w, count(*) AS n FROM ({_TOK.format(k='id', t='description', f='s')}) q GROUP BY 1, 2), r AS (SELECT spell_id, w, count(*) AS n FROM ({_TOK.format(k='id', t="replace(description_html, '<p>', ' paragraph ')", f='s')}) q GROUP BY 1, 2),
j AS (SELECT coalesce(l.spell_id, r.spell_id) AS spell_id, coalesce(l.n, 0) AS a, coalesce(r.n, 0) AS b FROM l FULL JOIN r ON l.spell_id = r.spell_id AND l.w = r.w), g AS (SELECT spell_id, CAST(sum(least(a, b)) AS BIGINT) AS matched, CAST(sum(a) AS BIGINT) AS n_left, CAST(sum(b) AS BIGINT) AS n_right FROM j GROUP BY 1)
SELECT s.id AS spell_id, coalesce(matched, 0) AS matched, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right, CASE WHEN coalesce(n_left, 0) = 0 THEN (CASE WHEN coalesce(matched, 0) = 0 THEN 1.0 ELSE 0.0 END) ELSE round(matched / n_left, 6) END AS recall,
 CASE WHEN coalesce(n_right, 0) = 0 THEN (CASE WHEN coalesce(matched, 0) = 0 THEN 1.0 ELSE 0.0 END) ELSE round(matched / n_right, 6) END AS precision FROM s LEFT JOIN g ON g.spell_id = s.id""")
def q_token_overlap(spark, d):
    s = spells(spark, d)
    left = s.select(F.col("id").alias("spell_id"), F.col("description").alias("t"))
    right = s.select(F.col("id").alias("spell_id"), F.replace("description_html", F.lit("<p>"), F.lit(" paragraph ")).alias("t"))
    return reconcile.token_overlap(left, right, "spell_id", "t")


@query("""WITH e AS (SELECT DISTINCT spell_id AS k FROM i18n_spell_text), a AS (SELECT spell_id AS k, count(*) AS n, min(match_method) AS m FROM zh_record WHERE spell_id IS NOT NULL GROUP BY 1)
SELECT coalesce(e.k, a.k) AS spell_id, CASE WHEN e.k IS NULL THEN 'stale' WHEN a.k IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN m NOT IN ('alias', 'slug', 'exact-name') THEN 'invalid' ELSE 'ok' END AS status FROM e FULL JOIN a ON a.k = e.k""")
def q_dq_decisions(spark, d):
    a = table(spark, d, "zh_record").where("spell_id is not null").select("spell_id", "match_method")
    return reconcile.decisions(table(spark, d, "i18n_spell_text").select("spell_id"), a, "spell_id", "match_method", ["alias", "slug", "exact-name"])


@query("""WITH p AS (SELECT p_partkey % 1500 AS k, p_name || ' ' || (p_partkey % 300) AS name, CAST(p_size AS INTEGER) AS parent FROM part), b AS (SELECT 30 * p_partkey AS k FROM part)
SELECT DISTINCT k, error FROM (SELECT k, 'duplicate-id' AS error FROM p WHERE k IN (SELECT k FROM p GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT k, 'duplicate-name' FROM p WHERE name IN (SELECT name FROM p GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT k, 'id-exists' FROM p WHERE k IN (SELECT k FROM b) UNION ALL SELECT k, 'parent-missing' FROM p WHERE parent NOT IN (SELECT n_nationkey FROM nation)) q""")
def q_dq_patch(spark, d):
    p = table(spark, d, "part")
    patch = p.select((F.col("p_partkey") % 1500).alias("k"), F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 300).cast("string")).alias("name"), F.col("p_size").cast("int").alias("parent"))
    base = p.select((F.col("p_partkey") * 30).alias("k"))
    return reconcile.patch_errors(patch, base, table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), "k", "name", "parent")


@query("""WITH l AS (SELECT DISTINCT parsed_id, source FROM parsed_spell), n AS (SELECT lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS k, count(DISTINCT parsed_id) AS n FROM l WHERE source IS NOT NULL GROUP BY 1)
SELECT parsed_id, source, CASE WHEN source IS NULL OR trim(source) = '' THEN 'defer' WHEN source <> trim(regexp_replace(source, '\\s+', ' ', 'g')) THEN 'replace' WHEN n.n > 1 THEN 'needs-review' ELSE 'keep' END AS status FROM l LEFT JOIN n ON n.k = lower(trim(regexp_replace(source, '\\s+', ' ', 'g')))""")
def q_label_audit(spark, d):
    return reconcile.label_audit(table(spark, d, "parsed_spell").select("parsed_id", "source").distinct(), "parsed_id", "source")


@query(f"WITH {S} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM lookup_entry l WHERE l.kind = 'rulebook' AND l.id = s.rulebook_id AND l.deleted_at IS NOT NULL) THEN 'deferred' WHEN verified THEN 'verified' WHEN contains(name, ',') THEN 'variant' ELSE 'candidate' END AS disposition FROM s")
def q_inventory(spark, d):
    gone = table(spark, d, "lookup_entry").where("kind = 'rulebook' and deleted_at is not null").select(F.col("id").alias("rulebook_id"), F.lit(True).alias("gone")).distinct()
    s = spells(spark, d).join(gone, "rulebook_id", "left")
    return reconcile.inventory(s, "id", [("deferred", F.coalesce("gone", F.lit(False))), ("verified", F.col("verified")), ("variant", F.contains("name", F.lit(",")))], "candidate")


# --- layout


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y FROM lineitem), b AS (SELECT l_orderkey, l_linenumber AS box_id, l_quantity - 10 AS x0, l_quantity + 10 AS x1, l_discount * 100 - 3 AS y0, l_discount * 100 + l_linenumber AS y1 FROM lineitem),
h AS (SELECT p.l_orderkey, p.l_linenumber, box_id, round((x1 - x0) * (y1 - y0), 6) AS area FROM p JOIN b ON p.l_orderkey = b.l_orderkey WHERE x >= x0 AND x <= x1 AND y >= y0 AND y <= y1)
SELECT l_orderkey, l_linenumber, min(box_id) AS box_id, area FROM h WHERE (l_orderkey, l_linenumber, area) IN (SELECT l_orderkey, l_linenumber, min(area) FROM h GROUP BY 1, 2) GROUP BY 1, 2, 4""")
def q_box_join(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 100).alias("y"))
    points = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), "y")
    boxes = li.select("l_orderkey", F.col("l_linenumber").alias("box_id"), (F.col("l_quantity") - 10).alias("x0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("y") - 3).alias("y0"), (F.col("y") + F.col("l_linenumber")).alias("y1"))
    hits = layout.smallest_box(points, boxes.distinct(), "l_orderkey", "l_linenumber")
    return hits.select("l_orderkey", "l_linenumber", "box_id", F.round("area", 6).alias("area"))


@query("""WITH h AS (SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b, abs(a.l_quantity - b.l_quantity) AS distance FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linestatus = 'F' WHERE a.l_linestatus = 'O' AND abs(a.l_quantity - b.l_quantity) <= 12)
SELECT l_orderkey, line_a, line_b, distance FROM (SELECT l_orderkey, line_a, line_b, distance, row_number() OVER (PARTITION BY l_orderkey, line_a ORDER BY distance, line_b) AS rk FROM h) q WHERE rk = 1""")
def q_nearest(spark, d):
    li = table(spark, d, "lineitem")
    a = li.where("l_linestatus = 'O'").select("l_orderkey", F.col("l_linenumber").alias("line_a"), F.col("l_quantity").alias("qa"))
    b = li.where("l_linestatus = 'F'").select("l_orderkey", F.col("l_linenumber").alias("line_b"), F.col("l_quantity").alias("qb"))
    return layout.nearest(a, b, "l_orderkey", "line_a", "line_b", "qa", "qb", 12.0)


@query("SELECT l_orderkey, line_a, line_b, least(a1, b1) - greatest(a0, b0) AS overlap FROM (SELECT l_orderkey, l_linenumber AS line_a, l_quantity AS a0, l_quantity + 5 AS a1 FROM lineitem WHERE l_returnflag = 'A') x JOIN (SELECT l_orderkey, l_linenumber AS line_b, l_quantity AS b0, l_quantity + 8 AS b1 FROM lineitem WHERE l_returnflag = 'R') y USING (l_orderkey) WHERE a0 < b1 AND b0 < a1")
def q_interval_overlap(spark, d):
    li, q = table(spark, d, "lineitem"), F.col("l_quantity")
    a = li.where("l_returnflag = 'A'").select("l_orderkey", F.col("l_linenumber").alias("line_a"), q.alias("a0"), (q + 5).alias("a1"))
    b = li.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("line_b"), q.alias("b0"), (q + 8).alias("b1"))
    return layout.overlapping(a, b, "l_orderkey").select("l_orderkey", "line_a", "line_b", "overlap")


@query("SELECT spell_id, CASE WHEN min(CASE WHEN character_class_id IN (1, 2, 3) THEN level END) > 9 THEN 9 ELSE min(CASE WHEN character_class_id IN (1, 2, 3) THEN level END) END AS chosen, greatest(0, coalesce(min(CASE WHEN character_class_id IN (1, 2, 3) THEN level END), min(level)) + 2) AS effective_level FROM dnd_spellclasslevel WHERE spell_id IS NOT NULL GROUP BY spell_id")
def q_effective_level(spark, d):
    t = table(spark, d, "dnd_spellclasslevel").where("spell_id is not null")
    chosen = F.min(F.when(F.col("character_class_id").isin(1, 2, 3), F.col("level")))
    g = t.groupBy("spell_id").agg(chosen.alias("c"), F.min("level").alias("m"))
    return g.select("spell_id", F.when(F.col("c").isNotNull(), F.least("c", F.lit(9))).alias("chosen"), F.greatest(F.lit(0), F.coalesce("c", "m") + 2).alias("effective_level"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 200 AS batch FROM documents")
def q_chunks(spark, d):
    from loomspark.sources.writers import number_batches

    return number_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 200).select("doc_id", "batch")


@query(f"WITH {S} SELECT spell_id, string_agg(line, chr(10) ORDER BY line) AS tsv FROM (SELECT DISTINCT l.spell_id, s.name || chr(9) || l.level || chr(9) || l.character_class_id AS line FROM s JOIN dnd_spellclasslevel l ON l.spell_id = s.id WHERE l.character_class_id IS NOT NULL) q GROUP BY spell_id")
def q_tsv_rows(spark, d):
    ls = table(spark, d, "dnd_spellclasslevel").where("character_class_id is not null").join(spells(spark, d).select(F.col("id").alias("spell_id"), "name"), "spell_id")
    line = F.concat_ws("\t", "name", "level", "character_class_id")
    return ls.select("spell_id", line.alias("line")).distinct().groupBy("spell_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("tsv"))
