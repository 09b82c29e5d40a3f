"""Queries of the general training-data problems (1, 4, 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.catalog import table
from loomspark.operators import changefeed, orphans, packed
from loomspark.session import scratch


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("dnd_spell", "id", "extra_components"), ("parsed_spell", "parsed_id", "descriptors"), ("dnd_spellclasslevel", "id", "extra")]
    fields = None
    for name, key, field in parts:
        one = table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.col(field).alias("raw")).where("raw is not null and trim(raw) != ''").distinct()
        fields = one if fields is None else fields.unionByName(one)
    return packed.unpack(fields).select("table_name", "row_key", "pos", "val").distinct()


def _change_log(spark: SparkSession, sf_dir: str) -> changefeed.ChangeLogTable:
    log = changefeed.ChangeLogTable(spark, scratch(spark, "changes"))
    log.append(table(spark, sf_dir, "spell_runtime"), "0")
    return log


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _change_log(spark, sf_dir).read().select("table_name", "row_key", "last_seq")


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.current_values(_change_log(spark, sf_dir).logs()).select("table_name", "row_key", "column_name", "value")


#: Batches in which the orphan queries feed their tables, in the order of time.
ORPHAN_BATCHES = 3
#: Buckets of their state; each of these batches touches all of them, so few will do.
ORPHAN_BUCKETS = 4


def _orphan_state(spark: SparkSession, sf_dir: str) -> orphans.OrphanState:
    """The state after all references and parents, fed in batches of the time at which rows were added or deleted."""

    def refs(name: str, field: str, kind: str, at: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        return t.select(F.lit(name).alias("table_name"), F.lit(field).alias("ref_field"), F.col("id").cast("string").alias("row_key"), F.lit(kind).alias("kind"), F.col(field).cast("long").alias("ref_key"), F.col(at).alias("ref_time"))

    spells = table(spark, sf_dir, "dnd_spell").select(F.lit("spell").alias("kind"), F.col("id").cast("long").alias("ref_key"), F.col("added").alias("parent_added"), F.col("deleted_at").alias("parent_deleted"))
    looked = table(spark, sf_dir, "lookup_entry").where("kind in ('characterclass', 'descriptor')").select("kind", F.col("id").cast("long").alias("ref_key"), F.col("added").alias("parent_added"), F.col("deleted_at").alias("parent_deleted"))
    parents = spells.unionByName(looked)
    # a deletion tells of the arrival too, which it can't come before
    changes = parents.withColumn("at", F.col("parent_added")).withColumn("parent_deleted", F.lit(None).cast("timestamp_ntz")).unionByName(parents.where("parent_deleted is not null").withColumn("at", F.greatest("parent_added", "parent_deleted")))
    new = (
        refs("dnd_spellclasslevel", "spell_id", "spell", "added")
        .unionByName(refs("dnd_spellclasslevel", "character_class_id", "characterclass", "added"))
        .unionByName(refs("i18n_spell_text", "spell_id", "spell", "created_at"))
        .unionByName(refs("dnd_spell_descriptors", "spelldescriptor_id", "descriptor", "added"))
    )
    first, last = new.agg(F.min("ref_time"), F.max("ref_time")).first()
    store = orphans.OrphanStore(spark, scratch(spark, "orphans"), ORPHAN_BUCKETS)
    state = None
    for n in range(ORPHAN_BATCHES):
        part = lambda df, at: df
        if first is not None:
            lo, hi = (first + (last - first) * k / ORPHAN_BATCHES for k in (n, n + 1))
            after, before = (lambda c: F.lit(True)) if n == 0 else (lambda c, lo=lo: F.col(c) >= F.lit(lo).cast("timestamp_ntz")), (lambda c: F.lit(True)) if n == ORPHAN_BATCHES - 1 else (lambda c, hi=hi: F.col(c) < F.lit(hi).cast("timestamp_ntz"))
            # rows without a time come first
            part = lambda df, at, a=after, b=before, n=n: df.where((a(at) & b(at)) if n else (b(at) | F.col(at).isNull()))
        state = store.advance(n, part(new, "ref_time"), part(changes, "at").drop("at"))
    return state


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.pending(_orphan_state(spark, sf_dir))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.counts(_orphan_state(spark, sf_dir))


def p5_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.snapshots(_orphan_state(spark, sf_dir))


P4_OPS = """
norm AS (SELECT CASE WHEN lower(trim(op)) IN ('insert','i','ins','c','create','add','r') THEN 'i' WHEN lower(trim(op)) IN ('update','u','upd','modify','change') THEN 'u'
 WHEN lower(trim(op)) IN ('delete','d','del','remove','rm') THEN 'd' END AS k, lower(trim(table_name)) AS table_name, lower(trim(row_key)) AS row_key, seq, data FROM spell_runtime),
ends AS (SELECT table_name, row_key, max(CASE WHEN k = 'i' THEN seq END) AS i, coalesce(max(CASE WHEN k = 'd' THEN seq END), -1) AS d, max(CASE WHEN k IN ('i', 'u') THEN seq END) AS last_seq FROM norm GROUP BY 1, 2),
live AS (SELECT * FROM ends WHERE i IS NOT NULL AND i > d)"""

P5_REFS = """
refs AS (
 SELECT DISTINCT 'dnd_spellclasslevel' AS table_name, 'spell_id' AS ref_field, CAST(id AS VARCHAR) AS row_key, 'spell' AS kind, spell_id AS ref_key, added AS ref_at FROM dnd_spellclasslevel WHERE spell_id IS NOT NULL
 UNION ALL SELECT DISTINCT 'dnd_spellclasslevel', 'character_class_id', CAST(id AS VARCHAR), 'characterclass', character_class_id, added FROM dnd_spellclasslevel WHERE character_class_id IS NOT NULL
 UNION ALL SELECT DISTINCT 'i18n_spell_text', 'spell_id', CAST(id AS VARCHAR), 'spell', spell_id, created_at FROM i18n_spell_text WHERE spell_id IS NOT NULL
 UNION ALL SELECT DISTINCT 'dnd_spell_descriptors', 'spelldescriptor_id', CAST(id AS VARCHAR), 'descriptor', spelldescriptor_id, added FROM dnd_spell_descriptors WHERE spelldescriptor_id IS NOT NULL),
parents AS (SELECT 'spell' AS kind, id, min(added) AS added, max(deleted_at) AS deleted_at FROM dnd_spell GROUP BY id
 UNION ALL SELECT kind, id, min(added), max(deleted_at) FROM lookup_entry WHERE kind IN ('characterclass', 'descriptor') GROUP BY kind, id),
found AS (SELECT DISTINCT table_name, ref_field, row_key, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.deleted_at IS NOT NULL THEN 'deleted' WHEN p.added > r.ref_at THEN 'late' END AS reason, strftime(r.ref_at, '%Y-%m') AS period
 FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.id = r.ref_key)"""

QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_values, p5_found, p5_counts, p5_snapshots)}

SQL = {
    "p4_values": f"""WITH {P4_OPS},
sets AS (SELECT n.table_name, n.row_key, n.seq, u.c AS column_name, json_extract_string(n.data, '$."' || u.c || '"') AS value, l.i FROM norm n JOIN live l USING (table_name, row_key), unnest(json_keys(CASE WHEN json_valid(n.data) AND json_type(n.data) = 'OBJECT' THEN n.data ELSE '{{}}' END)) AS u(c) WHERE n.k IN ('i', 'u')),
last AS (SELECT table_name, row_key, column_name, seq, i, value, row_number() OVER (PARTITION BY table_name, row_key, column_name ORDER BY seq DESC) AS rn FROM sets)
SELECT table_name, row_key, column_name, value FROM last WHERE rn = 1 AND seq >= i""",
    "p4_found": f"WITH {P4_OPS} SELECT table_name, row_key, last_seq FROM live",
    "p5_found": f"WITH {P5_REFS} SELECT * FROM found WHERE reason IS NOT NULL",
    "p5_counts": f"WITH {P5_REFS} SELECT table_name, ref_field, period, reason, count(*) AS n FROM found WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4",
    "p5_snapshots": f"""WITH {P5_REFS},
j AS (SELECT r.table_name, r.ref_field, r.ref_at, p.added, p.deleted_at FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.id = r.ref_key),
e AS (SELECT table_name, ref_field, ref_at AS t, 1 AS d FROM j WHERE added IS NULL OR added > ref_at
 UNION ALL SELECT table_name, ref_field, added, -1 FROM j WHERE added > ref_at
 UNION ALL SELECT table_name, ref_field, greatest(ref_at, added, deleted_at), 1 FROM j WHERE deleted_at IS NOT NULL),
m AS (SELECT table_name, ref_field, strftime(t, '%Y-%m') AS period, CAST(sum(d) AS BIGINT) AS change FROM e GROUP BY 1, 2, 3)
SELECT *, CAST(sum(change) OVER (PARTITION BY table_name, ref_field ORDER BY period ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open_orphans FROM m""",
}
