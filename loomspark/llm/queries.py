"""Queries of the llm problems and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.catalog import table
from loomspark.llm import bitext, canonical, leakage, lookalikes, mixture, pagescans, spans

#: Where the driver finds a public vocabulary file.
VOCABULARY = os.environ.get("LOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _scans(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pilot = table(spark, sf_dir, "pilot_entity")
    fields = None
    for f in ("source_text", "body_text", "summary_text"):
        one = pilot.select("case_id", F.lit(f).alias("field"), F.col(f).alias("text"))
        fields = one if fields is None else fields.unionByName(one)
    titles = table(spark, sf_dir, "lookup_entry").where("kind = 'rulebook'").select("name")
    clean = table(spark, sf_dir, "dnd_spell").where("description is not null").select("description").distinct().select(F.col("description").alias("text"))
    return {"fields": fields, "titles": titles, "clean": clean}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagescans.defects(**_scans(spark, sf_dir))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagescans.paragraphs(**_scans(spark, sf_dir))


def _bitexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    en = table(spark, sf_dir, "dnd_spell").where("id is not null and description is not null").groupBy(F.col("id").alias("spell_id")).agg(F.min("description").alias("en"))
    zh = table(spark, sf_dir, "i18n_spell_text").where("lower(lang) like 'zh%' and description_text is not null").select(F.col("id").alias("text_id"), "spell_id", F.col("description_text").alias("zh")).distinct()
    return zh.join(en, "spell_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitext.aligned(_bitexts(spark, sf_dir)).select("text_id", "en_pos", "zh_pos").distinct()


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitext.link_groups(_bitexts(spark, sf_dir)).select("text_id", "link_no", "kind", "en_positions", "zh_positions")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    zh, i18n = table(spark, sf_dir, "zh_record"), table(spark, sf_dir, "i18n_spell_text")
    key = lambda name, field, k, c: [F.lit(name).alias("table_name"), F.lit(field).alias("field"), F.col(k).cast("string").alias("row_key"), F.col(c).alias("name")]
    names = (
        zh.select(*key("zh_record", "zh_name", "rec_id", "zh_name"))
        .unionByName(zh.select(*key("zh_record", "en_name", "rec_id", "en_name")))
        .unionByName(i18n.select(*key("i18n_spell_text", "name", "id", "name")))
        .where("name is not null")
    )
    return lookalikes.consistent_names(names, changed_only=True).select("table_name", "field", "row_key", "clean_name").distinct()


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, entries = table(spark, sf_dir, "parsed_spell"), table(spark, sf_dir, "lookup_entry")
    out = None
    for field, kind in (("school", "school"), ("subschool", "subschool"), ("source", "rulebook")):
        values = parsed.select("parsed_id", F.lit(field).alias("field"), F.col(field).alias("value"))
        one = canonical.map_values(values, "value", entries.where(F.col("kind") == kind))
        out = one if out is None else out.unionByName(one)
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("parsed_id", "field", "entry_id").distinct()


def p7_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).where("entry_id = -1").groupBy("field", "value").agg(F.count("*").alias("n"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p8_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leakage.remove_leaked(docs, leakage.leaks(docs, table(spark, sf_dir, "eval_item"))).select("doc_id", "n_chars")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), VOCABULARY)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), VOCABULARY)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


def p10_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.document_links(table(spark, sf_dir, "documents"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_parts(table(spark, sf_dir, "documents"))


def p10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.maximal_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_paragraphs, p3_found, p3_links, p6_found, p7_found, p7_misses, p8_found, p8_clean_documents, p9_mixture, p9_shares, p10_found, p10_links, p10_shared, p10_repeats)}
# Windows of 320 characters and of 12 words, on whole tables; meant for small ones, where SQL is quick enough.
_TEXTS = "tx AS (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id)"
_SPANS = f"""{_TEXTS}, w AS (SELECT doc_id, i, hash(substr(text, CAST(i AS INT), 320)) AS h FROM tx, unnest(range(1, length(text) - 318)) AS u(i) WHERE length(text) >= 320),
pairs AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM (SELECT DISTINCT doc_id, h FROM w) a JOIN (SELECT DISTINCT doc_id, h FROM w) b ON a.h = b.h AND a.doc_id < b.doc_id)"""
_WORDS = """dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL), iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM eval_item WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 11], ' ') AS g FROM dw, unnest(range(1, len(ws) - 10)) AS u(i) WHERE len(ws) >= 12), ig AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 11], ' ') AS g FROM iw, unnest(range(1, len(ws) - 10)) AS u(i) WHERE len(ws) >= 12), leak AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))"""

SQL: dict[str, str] = {
    "p8_found": f"WITH {_WORDS} SELECT doc_id, item_id FROM leak",
    "p8_clean_documents": f"WITH {_WORDS} SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leak)",
    "p10_found": f"WITH {_SPANS} SELECT doc_a, doc_b FROM pairs",
    "p10_links": f"WITH {_SPANS}, c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM tx) SELECT c.doc_id, c.class_id, (SELECT count(*) FROM pairs p WHERE p.doc_a = c.doc_id OR p.doc_b = c.doc_id) AS n_links FROM c",
    "p10_shared": f"""WITH {_SPANS}, many AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), hit AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM w WHERE h IN (SELECT h FROM many)),
cov AS (SELECT doc_id, CAST(sum(least(320, coalesce(nx - i, 320))) AS BIGINT) AS n FROM hit GROUP BY 1), d AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
SELECT d.doc_id, CAST(coalesce(length(tx.text), 0) AS BIGINT) AS n_chars, coalesce(cov.n, 0) AS shared_chars, CASE WHEN coalesce(length(tx.text), 0) > 0 THEN round(coalesce(cov.n, 0) / length(tx.text), 6) ELSE 0.0 END AS shared_share FROM d LEFT JOIN tx ON tx.doc_id = d.doc_id LEFT JOIN cov ON cov.doc_id = d.doc_id""",
    "p10_repeats": f"""WITH {_SPANS}, r AS (SELECT min(doc_id) AS doc_id FROM tx GROUP BY text), m AS (SELECT a.doc_id AS class_a, b.doc_id AS class_b, a.i - b.i AS apart, a.i FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT doc_id FROM r) AND b.doc_id IN (SELECT doc_id FROM r)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY class_a, class_b, apart ORDER BY i) AS run FROM m) SELECT class_a, class_b, CAST(min(i) - 1 AS INT) AS start_a, CAST(min(i) - 1 - apart AS INT) AS start_b, CAST(count(*) + 319 AS INT) AS n_chars FROM g GROUP BY class_a, class_b, apart, run""",
}
