"""Weighted BM25 over substring tokens, with corpus statistics that filters don't change."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ranking's constants.
K1, B, IDF_FLOOR, MIN_TOKEN, SCHEMA_VERSION = 1.2, 0.75, 1e-6, 3, 1


def query_tokens(query: str) -> list[str]:
    """Words of at least MIN_TOKEN characters, repeats (whatever their case) away."""
    seen = {}
    for w in query.split():
        if len(w) >= MIN_TOKEN:
            seen.setdefault(w.lower(), w)
    return list(seen.values())


def occurrences(c: Column, token: str) -> Column:
    """Overlapping occurrences of a token, whatever its case."""
    quoted = "".join(f"\\{x}" if not x.isalnum() and x.isascii() else x for x in token.lower())
    return F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"(?={quoted})"))


def trigrams_of(c: Column) -> Column:
    """Number of character trigrams."""
    return F.greatest(F.lit(0), F.length(F.coalesce(c, F.lit(""))) - 2)


def bm25(documents: DataFrame, weights: dict[str, float], query: str, eligible: Column | None = None) -> DataFrame:
    """documents that hold every token of the query, with score.

    One pass counts the corpus statistics (one row) over all documents; the second scores those that match. eligible
    narrows the result but not the statistics. A query without a token gives no row.
    """
    tokens = query_tokens(query)
    if not tokens:
        return documents.limit(0).withColumn("score", F.lit(0.0))
    tf = {t: reduce(lambda a, b: a + b, [F.lit(float(w)) * occurrences(F.col(c), t) for c, w in weights.items()]) for t in tokens}
    size = reduce(lambda a, b: a + b, [trigrams_of(F.col(c)) for c in weights])
    stats = documents.agg(F.count("*").alias("n"), F.avg(size).alias("avgdl"), *[F.count_if(tf[t] > 0).alias(f"df{i}") for i, t in enumerate(tokens)]).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    score = F.lit(0.0)
    for i, t in enumerate(tokens):
        idf = math.log((n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)) if n else 0.0
        idf = idf if idf > 0 else IDF_FLOOR
        score = score + F.lit(idf) * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * size / avgdl))
    matched = documents.where(reduce(lambda a, b: a & b, [tf[t] > 0 for t in tokens]))
    return (matched if eligible is None else matched.where(eligible)).withColumn("score", score)


def postings(documents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """gram, key: each document's distinct character trigrams, a prefilter for corpora too large to scan for substrings."""
    chars = F.split(F.lower(F.concat_ws("\x00", *columns)), "")
    # characters are cut once: substrings by place would read a text from its start for every gram
    join, rest = (lambda a, b: F.concat(a, b)), (lambda k: F.slice(chars, k, F.size(chars)))
    grams = F.array_distinct(F.array_compact(F.zip_with(F.zip_with(chars, rest(2), join), rest(3), join)))
    return documents.select(key, F.explode(grams).alias("gram")).where(~F.col("gram").contains("\x00"))


def candidates(index: DataFrame, key: str, token: str) -> DataFrame:
    """Keys of documents that have all trigrams of a token; they may hold it, others can't."""
    t = token.lower()
    grams = sorted({t[i : i + 3] for i in range(len(t) - 2)})
    return index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(grams)).select(key)


def best_document(scored: DataFrame, key: str) -> DataFrame:
    """Best score per entity."""
    return scored.groupBy(key).agg(F.max("score").alias("score"))


def index_usable(state: DataFrame) -> bool:
    """Whether an index state (schema_version, document_count) fits this engine; a search on any other must fail."""
    row = state.limit(1).collect()
    return bool(row) and row[0]["schema_version"] == SCHEMA_VERSION and row[0]["document_count"] > 0


class IndexUnusable(RuntimeError):
    """The index state is of another version, or empty: no search may run on it."""


def _unique(values: Column) -> Column:
    """Array without blanks and, whatever the case, repeats: the first of each stays, trimmed."""
    kept = F.filter(F.transform(values, lambda v: F.regexp_replace(v, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda v: v.isNotNull() & (v != ""))
    folded = F.transform(kept, lambda v: F.lower(v))
    return F.filter(kept, lambda v, i: F.array_position(folded, F.lower(v)) == i + 1)


#: Weights of the columns of a search document.
WEIGHTS = {"name": 12.0, "aliases": 8.0, "summary": 4.0, "mechanics": 2.0, "body": 1.0}


def build_documents(spells: DataFrame, texts: DataFrame, summaries: DataFrame, mechanics: DataFrame, raw: list[str]) -> DataFrame:
    """spell_id, lang, variant, name, aliases, summary, mechanics, body: one search document per spell, language and variant.

    spells: spell_id, name, slug, description and the raw mechanic columns; texts: spell_id, lang, variant, name,
    description_text; summaries: spell_id, lang, variant, summary_text; mechanics: spell_id, place and the texts
    normalized_text, raw_text, category. en:default always is; a text overrides name and body of its variant, and a
    variant that only has a summary gets the spell's name and an empty body. Aliases are the spell's name, its slug's
    words and all localized names but the document's own name; summaries are those of the language, of the variant
    first. Of repeated texts of one variant the last by name and body counts. Texts of no spell give no document.
    """
    keys = ["spell_id", "lang", "variant"]
    local = texts.groupBy(*keys).agg(F.max(F.struct(F.col("name").alias("n"), F.col("description_text").alias("b"))).alias("t"))
    wanted = spells.select("spell_id", F.lit("en").alias("lang"), F.lit("default").alias("variant")).unionByName(local.select(*keys)).unionByName(summaries.select(*keys)).distinct()
    names = texts.groupBy("spell_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("lang", "variant", "name"))), lambda x: x["name"]).alias("local_names"))
    told = summaries.groupBy("spell_id", "lang").agg(F.array_sort(F.collect_set(F.struct("variant", "summary_text"))).alias("told"))
    facets = mechanics.groupBy("spell_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "normalized_text", "raw_text", "category"))), lambda m: F.array(m["normalized_text"], m["raw_text"], m["category"]))).alias("facets"))
    own = spells.select("spell_id", F.col("name").alias("own"), "slug", F.col("description").alias("own_body"), F.array(*raw).alias("raw"))
    j = wanted.join(own, "spell_id").join(local, keys, "left").join(names, "spell_id", "left").join(told, ["spell_id", "lang"], "left").join(facets, "spell_id", "left")
    default = (F.col("lang") == "en") & (F.col("variant") == "default")
    name = F.coalesce("t.n", "own")
    body = F.coalesce("t.b", F.when(default, F.col("own_body")), F.lit(""))
    none = F.array().cast("array<string>")
    aliases = F.filter(_unique(F.concat(F.array(F.col("own"), F.replace("slug", F.lit("-"), F.lit(" "))), F.coalesce("local_names", none))), lambda a: a != name)
    text_of = lambda xs: F.transform(xs, lambda x: x["summary_text"])
    ordered = F.concat(text_of(F.filter("told", lambda x: x["variant"] == F.col("variant"))), text_of(F.filter("told", lambda x: x["variant"] != F.col("variant"))))
    return j.select(
        *keys, name.alias("name"), F.array_join(aliases, "\n").alias("aliases"), F.array_join(_unique(F.coalesce(ordered, none)), "\n").alias("summary"),
        F.array_join(_unique(F.concat("raw", F.coalesce("facets", none))), "\n").alias("mechanics"), body.alias("body"),
    )


class SearchIndex:
    """Documents, their trigram postings and the corpus statistics, stored under one path; searches read nothing else.

    Postings are stored by gram, so a query reads the files of its own grams; only documents that have all of them are
    scored. Every search first checks the stored state and fails if it is of another version.
    """

    _BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, documents: DataFrame, weights: dict[str, float] = WEIGHTS, key: str = "spell_id") -> None:
        """Replace the index by one of documents; the state is written last."""
        docs = documents.withColumn("doc", F.xxhash64(*documents.columns)).withColumn("doc_size", reduce(lambda a, b: a + b, [trigrams_of(F.col(c)) for c in weights]))
        docs.write.mode("overwrite").parquet(f"{self.path}/documents")
        stored = self.spark.read.schema(docs.schema).parquet(f"{self.path}/documents")
        grams = postings(stored, "doc", list(weights)).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(self._BUCKETS)).cast("int"))
        grams.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        state = stored.agg(F.lit(SCHEMA_VERSION).alias("schema_version"), F.count("*").alias("document_count"), F.avg("doc_size").alias("avg_size"))
        state.write.mode("overwrite").parquet(f"{self.path}/state")

    def state(self) -> dict:
        row = self.spark.read.parquet(f"{self.path}/state").first()
        return row.asDict() if row else {}

    def search(self, query: str, weights: dict[str, float] = WEIGHTS, eligible: DataFrame | None = None, key: str = "spell_id") -> DataFrame:
        """key, score: the best score of each entity's documents that hold every token of the query; eligible (key) narrows the result but not the statistics."""
        state = self.state()
        if state.get("schema_version") != SCHEMA_VERSION or not state.get("document_count"):
            raise IndexUnusable(f"search index at {self.path}: {state}")
        docs = self.spark.read.parquet(f"{self.path}/documents")
        tokens = query_tokens(query)
        if not tokens:
            return docs.limit(0).select(key, F.lit(0.0).alias("score"))
        grams = {t: sorted({t.lower()[i : i + 3] for i in range(len(t) - 2)}) for t in tokens}
        every = sorted({g for gs in grams.values() for g in gs})
        buckets = [r[0] for r in self.spark.createDataFrame([(g,) for g in every], "g string").select(F.pmod(F.xxhash64("g"), F.lit(self._BUCKETS)).cast("int")).distinct().collect()]
        found = self.spark.read.schema("gram string, doc long, bucket int").parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(every))
        has = found.groupBy("doc").agg(*[F.count_if(F.col("gram").isin(gs)).alias(f"n{i}") for i, gs in enumerate(grams.values())])
        some = reduce(lambda a, b: a | b, [F.col(f"n{i}") == len(gs) for i, gs in enumerate(grams.values())])
        tf = [reduce(lambda a, b: a + b, [F.lit(float(w)) * occurrences(F.col(c), t) for c, w in weights.items()]) for t in tokens]
        held = docs.join(has.where(some).select("doc"), "doc", "left_semi").select(key, "doc_size", *[f.alias(f"f{i}") for i, f in enumerate(tf)])
        df = held.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(tokens))]).first()
        n, avg = state["document_count"], state["avg_size"] or 1.0
        score = F.lit(0.0)
        for i in range(len(tokens)):
            idf = max(math.log((n - df[i] + 0.5) / (df[i] + 0.5)), 0.0) or IDF_FLOOR
            score = score + F.lit(idf) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("doc_size") / avg))
        every_token = reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(tokens))])
        best = held.where(every_token).select(key, score.alias("score")).groupBy(key).agg(F.max("score").alias("score"))
        return best if eligible is None else best.join(eligible.select(key), key, "left_semi")
