"""Queries of positioned text and tables, with their SQL; items are order lines, whose numbers serve as places on a page."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.catalog import table
from loomspark.functions import text as tx
from loomspark.operators import pages

QUERIES: dict = {}
SQL: dict[str, str] = {}


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]
#: Order lines numbered anew within their order, as some numbers occur twice.
_LI = f"(SELECT * EXCLUDE (l_linenumber, rn), CAST(rn AS INT) AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS rn FROM lineitem) q)"


def _li(spark, d):
    t = table(spark, d, "lineitem")
    return t.withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)))


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, re.sub(r"\blineitem\b(?!\) q)", _LI, sql).replace(_LI + " l ", _LI + " AS l ")
        return f

    return keep


_ITEMS = """items AS (SELECT l_orderkey AS page, l_linenumber AS no, CASE WHEN l_linenumber % 5 = 3 THEN ' ' WHEN l_linenumber % 4 = 2 THEN ', ' || l_returnflag WHEN l_linenumber % 7 = 6 THEN '(' ELSE l_returnflag || l_linestatus || l_linenumber END AS text,
 CAST(l_linenumber * 10 AS DOUBLE) AS x, floor(l_quantity / 10) * 1.5 AS y, CASE WHEN l_discount > 0.05 THEN 10.0 ELSE 6.0 END AS width, 8 + l_linenumber % 3 AS height, l_linenumber % 6 = 4 AS has_eol FROM lineitem)"""


def _items(spark, d):
    n = F.col("l_linenumber")
    word = F.concat("l_returnflag", "l_linestatus", n.cast("string"))
    return _li(spark, d).select(
        F.col("l_orderkey").alias("page"), n.alias("no"), F.when(n % 5 == 3, " ").when(n % 4 == 2, F.concat(F.lit(", "), "l_returnflag")).when(n % 7 == 6, "(").otherwise(word).alias("text"), (n * 10).cast("double").alias("x"),
        (F.floor(F.col("l_quantity") / 10) * 1.5).alias("y"), F.when(F.col("l_discount") > 0.05, 10.0).otherwise(6.0).alias("width"), (F.lit(8) + n % 3).alias("height"), (n % 6 == 4).alias("has_eol"),
    )


_LINES = f"""{_ITEMS}, m AS (SELECT *, trim(text) <> '' AS vis, last_value(CASE WHEN trim(text) <> '' THEN y END IGNORE NULLS) OVER (PARTITION BY page ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base, coalesce(lag(has_eol) OVER (PARTITION BY page ORDER BY no), FALSE) AS eol FROM items),
k AS (SELECT *, sum(CASE WHEN eol OR (vis AND coalesce(abs(y - base) > 2, FALSE)) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY no ROWS UNBOUNDED PRECEDING) AS ln FROM m),
t AS (SELECT page, ln, no, text, vis, x, y, height, lag(text) OVER w AS pt, lag(x + width) OVER w AS pe FROM k WINDOW w AS (PARTITION BY page, ln ORDER BY no)),
j AS (SELECT page, ln, trim(regexp_replace(string_agg(CASE WHEN pt IS NOT NULL AND NOT regexp_matches(pt, '\\s$') AND NOT regexp_matches(text, '^\\s') AND NOT regexp_matches(text, '^[,.;:!?\\])}}]') AND NOT regexp_matches(pt, '[(\\[{{]$') AND x - pe > 1 THEN ' ' ELSE '' END || text, '' ORDER BY no), '\\s+', ' ', 'g')) AS text,
 min(x) FILTER (vis) AS x, max(y) FILTER (vis) AS y, max(height) FILTER (vis) AS height, bool_or(vis) AS any_vis FROM t GROUP BY 1, 2),
lines AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY ln) - 1 AS INT) AS line, text, x, y, height FROM j WHERE any_vis AND text <> '')"""


@query(f"WITH {_LINES} SELECT * FROM lines")
def q_reading_lines(spark, d):
    return pages.reading_lines(_items(spark, d), ["page"], "no")


@query(f"""WITH RECURSIVE {_ITEMS}, ys AS (SELECT page, list(DISTINCT y ORDER BY y DESC) AS ys FROM items GROUP BY 1), g AS (SELECT page, ys, 1 AS i, ys[1] AS top FROM ys UNION ALL SELECT page, ys, i + 1, CASE WHEN top - ys[i + 1] <= 1.5 THEN top ELSE ys[i + 1] END FROM g WHERE i < len(ys)),
p AS (SELECT items.*, g.top FROM items JOIN g ON g.page = items.page AND g.ys[g.i] = items.y), t AS (SELECT *, lag(text) OVER w AS pt, lag(x + width) OVER w AS pe FROM p WINDOW w AS (PARTITION BY page, top ORDER BY x, text)),
j AS (SELECT page, top, trim(regexp_replace(string_agg(CASE WHEN pt IS NOT NULL AND NOT regexp_matches(pt, '\\s$') AND NOT regexp_matches(text, '^\\s') AND NOT regexp_matches(text, '^[,.;:!?\\])}}]') AND NOT regexp_matches(pt, '[(\\[{{]$') AND x - pe > 1 THEN ' ' ELSE '' END || text, '' ORDER BY x, text), '\\s+', ' ', 'g')) AS text FROM t GROUP BY 1, 2)
SELECT page, string_agg(text, ' ' ORDER BY top DESC) AS text FROM j WHERE text <> '' GROUP BY 1""")
def q_clustered_lines(spark, d):
    return pages.clustered_lines(_items(spark, d), ["page"])


_WORDS = "lines0 AS (SELECT l_orderkey AS doc, l_linenumber AS no, CASE WHEN l_returnflag = 'R' THEN 'Heading ' || l_linestatus WHEN l_returnflag = 'A' THEN 'School of art' ELSE 'Level: ' || l_linenumber || CASE WHEN l_linestatus = 'O' THEN '-' ELSE '.' END END AS text FROM lineitem)"


def _words(spark, d):
    level = F.concat(F.lit("Level: "), F.col("l_linenumber").cast("string"), F.when(F.col("l_linestatus") == "O", "-").otherwise("."))
    return _li(spark, d).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("no"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Heading "), "l_linestatus")).when(F.col("l_returnflag") == "A", "School of art").otherwise(level).alias("text"))


@query(f"""WITH {_WORDS}, a AS (SELECT *, lead(text) OVER w AS nx, max(CASE WHEN starts_with(text, 'Level') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY no ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS f FROM lines0 WINDOW w AS (PARTITION BY doc ORDER BY no)),
h AS (SELECT *, starts_with(text, 'Heading') AND coalesce(nx = 'School of art', FALSE) AND coalesce(f, 0) = 1 OR text = 'School of art' AND coalesce(nx = 'School of art', FALSE) AND coalesce(f, 0) = 1 AS head FROM a), e AS (SELECT *, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY no ROWS UNBOUNDED PRECEDING) AS INT) AS entity_no FROM h),
g AS (SELECT doc, entity_no, max(text) FILTER (head) AS name, min(no) AS start, count(*) AS n_lines, coalesce(trim(replace(string_agg(text, ' ' ORDER BY no) FILTER (NOT head), '- ', '-')), '') AS body FROM e WHERE entity_no > 0 GROUP BY 1, 2)
SELECT *, CASE WHEN body = '' THEN 'no-body' WHEN count(*) OVER (PARTITION BY doc, lower(name)) > 1 THEN 'duplicate-name' END AS issue FROM g""")
def q_heading_entities(spark, d):
    return pages.heading_entities(_words(spark, d), "doc", "no", "text", "^School", "^Level")


@query("WITH b AS (SELECT DISTINCT o_orderkey AS page, k AS block_id, k AS first, k + 1 AS last FROM orders, (VALUES (1), (3), (6), (40)) AS v(k)) SELECT b.page, block_id, coalesce(string_agg(l.l_returnflag || l.l_linenumber, chr(10) ORDER BY l_linenumber), '') AS text, count(l.l_linenumber) AS n_lines, sha256(coalesce(string_agg(l.l_returnflag || l.l_linenumber, chr(10) ORDER BY l_linenumber), '')) AS sha256 FROM b LEFT JOIN lineitem l ON l.l_orderkey = b.page AND l.l_linenumber BETWEEN b.first AND b.last GROUP BY 1, 2")
def q_block_evidence(spark, d):
    lines = _li(spark, d).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("no"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    blocks = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(6), F.lit(40))).alias("block_id")).select("page", "block_id", F.col("block_id").alias("first"), (F.col("block_id") + 1).alias("last")).distinct()
    return pages.block_evidence(lines, blocks, "page", "no", "text")


_CELLS = """i AS (SELECT DISTINCT l_suppkey AS page, CAST(l_quantity AS DOUBLE) AS y, CAST(l_linenumber * 10 AS DOUBLE) AS x, CASE WHEN l_quantity IN (50, 30) AND l_linenumber = 1 THEN 'Section ' || CAST(l_quantity AS INT) ELSE 'v' || l_linenumber || '-' || CAST(l_quantity AS INT) END AS text FROM lineitem),
c(column_no, x_min, x_max) AS (VALUES (0, 0.0, 15.0), (1, 15.0, 45.0), (2, 45.0, 75.0)), p AS (SELECT * FROM i JOIN c ON x >= x_min AND x < x_max),
h AS (SELECT DISTINCT page, y AS top, text AS section FROM p WHERE starts_with(text, 'Section')), hb AS (SELECT *, coalesce(lead(top) OVER (PARTITION BY page ORDER BY top DESC), -1e9) AS bottom FROM h),
b AS (SELECT p.*, hb.top, hb.section FROM p JOIN hb ON hb.page = p.page AND p.y < hb.top AND p.y > hb.bottom WHERE NOT starts_with(text, 'Section')),
r AS (SELECT DISTINCT page, top, y FROM b WHERE column_no = 0), bd AS (SELECT page, top, row_number() OVER w - 1 AS row_no, coalesce((lag(y) OVER w + y) / 2, 1e9) AS f, coalesce((lead(y) OVER w + y) / 2, -1e9) AS t FROM r WINDOW w AS (PARTITION BY page, top ORDER BY y DESC))"""


@query(f"WITH {_CELLS} SELECT b.page, b.section, bd.row_no, b.column_no, string_agg(b.text, ' ' ORDER BY b.y DESC, b.x) AS text FROM b JOIN bd ON bd.page = b.page AND bd.top = b.top AND b.y <= bd.f AND b.y > bd.t GROUP BY 1, 2, 3, 4")
def q_coordinate_table(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    items = _li(spark, d).select(F.col("l_suppkey").alias("page"), F.col("l_quantity").cast("double").alias("y"), (n * 10).cast("double").alias("x"), F.when(q.isin(50, 30) & (n == 1), F.concat(F.lit("Section "), q.cast("string"))).otherwise(F.concat(F.lit("v"), n.cast("string"), F.lit("-"), q.cast("string"))).alias("text")).distinct()
    columns = items.select("page").distinct().withColumn("_r", F.explode(F.array(*[F.struct(F.lit(c).alias("column_no"), F.lit(a).alias("x_min"), F.lit(b).alias("x_max")) for c, a, b in ((0, 0.0, 15.0), (1, 15.0, 45.0), (2, 45.0, 75.0))]))).select("page", "_r.*")
    return pages.coordinate_table(items, "page", columns, F.col("text").startswith("Section"))


@query("""WITH l AS (SELECT l_orderkey AS page, l_linenumber AS no, l_returnflag || l_linestatus || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END AS text, CAST(l_quantity AS DOUBLE) AS x, l_returnflag = 'R' AS s, l_returnflag = 'A' AS e FROM lineitem),
n AS (SELECT page, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) AS INT) AS n_found, min(no) FILTER (s) AS at0, arg_min(x, no) FILTER (s) AS x0 FROM l GROUP BY 1), k AS (SELECT l.*, n.n_found, at0, min(CASE WHEN no > at0 AND (e OR abs(x - x0) > 24) THEN no END) OVER (PARTITION BY l.page) AS stop FROM l JOIN n ON n.page = l.page)
SELECT page, n_found, CASE WHEN n_found = 1 THEN string_agg(text, ' ' ORDER BY no) FILTER (no >= at0 AND (stop IS NULL OR no < stop)) END AS text FROM k GROUP BY 1, 2""")
def q_located_entry(spark, d):
    n = F.col("l_linenumber")
    lines = _li(spark, d).select(F.col("l_orderkey").alias("page"), n.alias("no"), F.concat("l_returnflag", "l_linestatus", n.cast("string"), F.when(n % 2 == 0, "-").otherwise("")).alias("text"), F.col("l_quantity").cast("double").alias("x"))
    return pages.located_entry(lines, "page", "no", "text", "x", F.col("text").startswith("R"), F.col("text").startswith("A"))


@query("SELECT l_orderkey AS page, count(*) AS n_blocks, string_agg(l_returnflag, ',' ORDER BY l_linenumber) AS kinds, string_agg(l_linestatus || l_linenumber, ',' ORDER BY l_linenumber) AS texts FROM lineitem GROUP BY 1")
def q_blocks_by_page(spark, d):
    b = _li(spark, d).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("kind"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("text"))
    return pages.blocks_by_page(b).select("page", "n_blocks", F.array_join("kinds", ",").alias("kinds"), F.array_join("texts", ",").alias("texts"))


_BOXES = "SELECT l_orderkey AS page, l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS x0, l_quantity + 4.0 AS x1, l_discount * 1000 AS y0, l_discount * 1000 + 5 AS y1, l_returnflag AS f FROM lineitem"


def _boxes(spark, d):
    return _li(spark, d).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("double").alias("x0"), (F.col("l_quantity") + 4.0).cast("double").alias("x1"), (F.col("l_discount") * 1000).cast("double").alias("y0"), (F.col("l_discount") * 1000 + 5).cast("double").alias("y1"), F.col("l_returnflag").alias("f"))


@query(f"WITH b AS ({_BOXES}), j AS (SELECT a.page, a.id AS a_id, b.id AS b_id, greatest(0, b.x0 - a.x1, a.x0 - b.x1) AS h, greatest(0, b.y0 - a.y1, a.y0 - b.y1) AS v FROM b a JOIN b ON a.page = b.page WHERE a.f <> 'N' AND b.f = 'N') SELECT page, a_id, b_id, row_number() OVER (PARTITION BY page, a_id ORDER BY round(v, 6), round(h, 6), b_id) AS place FROM j WHERE round(h, 6) <= 12 AND round(v, 6) <= 65")
def q_ranked_neighbours(spark, d):
    b = _boxes(spark, d).withColumn("y0", F.round("y0", 3)).withColumn("y1", F.round("y1", 3))
    left = b.where("f != 'N'").select("page", F.col("id").alias("a_id"), *[F.col(c).alias(f"a{c}") for c in ("x0", "x1", "y0", "y1")])
    right = b.where("f = 'N'").select("page", F.col("id").alias("b_id"), *[F.col(c).alias(f"b{c}") for c in ("x0", "x1", "y0", "y1")])
    return pages.ranked_neighbours(left, right, "page", 12.0, 65.0)


@query(f"WITH b AS ({_BOXES}), j AS (SELECT a.page, a.id AS a_id, b.id AS b_id FROM b a JOIN b ON a.page = b.page AND a.id < b.id AND b.y0 >= a.y0 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0) SELECT page, a_id, min(b_id) AS b_id FROM j GROUP BY 1, 2")
def q_following_overlap(spark, d):
    b = _boxes(spark, d)
    left = b.select("page", F.col("id").alias("a_id"), F.col("id").alias("a_no"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), F.col("y0").alias("ay"))
    right = b.select("page", F.col("id").alias("b_id"), F.col("id").alias("b_no"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by"))
    return pages.following_overlap(left, right, "page")


@query("""WITH k AS (SELECT DISTINCT l_suppkey AS id, CASE l_linenumber WHEN 1 THEN 'Sorcerer' WHEN 2 THEN 'Wizard' WHEN 3 THEN 'Bard' ELSE 'Fire' END AS owner, CAST(l_quantity AS INT) % 5 AS level FROM lineitem), s AS (SELECT DISTINCT s_suppkey AS id, s_suppkey % 5 AS lv FROM supplier)
SELECT id, 'Sorcerer/Wizard ' || CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.id = s.id AND owner = 'Sorcerer' AND level = lv) AND EXISTS (SELECT 1 FROM k WHERE k.id = s.id AND owner = 'Wizard' AND level = lv) THEN CAST(lv AS VARCHAR) ELSE '?' END || ', Bard ' || CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.id = s.id AND owner = 'Bard' AND level = lv) THEN CAST(lv AS VARCHAR) ELSE '?' END || ', Fire ?' AS text FROM s""")
def q_level_text(spark, d):
    n = F.col("l_linenumber")
    known = _li(spark, d).select(F.col("l_suppkey").alias("id"), F.when(n == 1, "Sorcerer").when(n == 2, "Wizard").when(n == 3, "Bard").otherwise("Fire").alias("owner"), (F.col("l_quantity").cast("int") % 5).alias("level"), F.lit(False).alias("domain"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).distinct()
    level = (F.col("id") % 5).cast("string")
    line = F.concat(F.lit("Sor/Wiz "), level, F.lit(", Brd "), level, F.lit(", Fire "), level)
    entries = s.select("id", F.posexplode(tx.level_entries(line)).alias("place", "e")).select("id", "place", "e.owner", "e.level", "e.domain")
    return pages.level_text(entries, known)


@query("""SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_linenumber) AS kept, replace(string_agg(CASE WHEN l_linenumber % 3 = 0 THEN 'low' ELSE 'Top' END || CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END, ' ' ORDER BY l_linenumber), '- low', 'low') AS joined FROM lineitem GROUP BY 1""")
def q_join_wrapped(spark, d):
    n = F.col("l_linenumber")
    li = _li(spark, d).select("l_orderkey", "l_linenumber", F.concat("l_returnflag", n.cast("string")).alias("a"), F.concat(F.when(n % 3 == 0, "low").otherwise("Top"), F.when(n % 2 == 0, "-").otherwise("")).alias("b"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "a", "b"))).alias("r"))
    return g.select("l_orderkey", pages.join_wrapped(F.transform("r", lambda x: x["a"]), False).alias("kept"), pages.join_wrapped(F.transform("r", lambda x: x["b"]), True).alias("joined"))
