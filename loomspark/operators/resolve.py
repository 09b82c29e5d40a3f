"""Names and labels resolved to records: alias chains, several keys, priorities, and ambiguity kept visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOPS = 8


def alias_chain(names: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """names with final_name and hops: aliases (from_name, to_name) followed up to MAX_HOPS, whatever the case, stopping before a name is met twice.

    Of several aliases of one name the smallest counts here; alias_names gives them all. Each hop is a hash join with
    the alias table, and the plan has MAX_HOPS of them; nothing loops on the driver.
    """
    step = aliases.where("from_name is not null and to_name is not null").groupBy(F.lower("from_name").alias("_from")).agg(F.min("to_name").alias("_to"))
    out = names.withColumn("final_name", F.col(column)).withColumn("hops", F.lit(0)).withColumn("_seen", F.array(F.lower(column)))
    for _ in range(MAX_HOPS):
        out = out.join(step, F.lower("final_name") == F.col("_from"), "left")
        go = F.col("_to").isNotNull() & ~F.array_contains("_seen", F.lower("_to"))
        out = out.withColumn("final_name", F.when(go, F.col("_to")).otherwise(F.col("final_name"))).withColumn("hops", F.col("hops") + F.when(go, 1).otherwise(0))
        out = out.withColumn("_seen", F.when(go, F.array_append("_seen", F.lower("_to"))).otherwise(F.col("_seen"))).drop("_from", "_to")
    return out.drop("_seen")


def alias_names(names: DataFrame, chain: DataFrame, more: DataFrame, column: str = "name") -> DataFrame:
    """column, candidate: every name to look a name up by: itself, the end of its alias chain, and what more (from_name, to_name) adds to either, each once whatever the case."""
    ends = alias_chain(names.select(column).where(F.col(column).isNotNull()).distinct(), chain, column)
    both = ends.select(column, F.explode(F.array(F.col(column), F.col("final_name"))).alias("candidate"))
    added = both.join(more.where("to_name is not null").select(F.lower("from_name").alias("_k"), "to_name"), F.lower("candidate") == F.col("_k")).select(column, F.col("to_name").alias("candidate"))
    return both.unionByName(added).groupBy(column, F.lower("candidate").alias("_k")).agg(F.min("candidate").alias("candidate")).drop("_k")


def scoped_or_global(rows: DataFrame, targets: DataFrame, key: str, scope: str, target: str) -> DataFrame:
    """rows joined to targets by key within their scope, and across scopes where that finds none; match_scope says which."""
    scoped = rows.join(targets.select(key, scope, target), [key, scope]).withColumn("match_scope", F.lit("scoped"))
    rest = rows.join(targets.select(key, scope).distinct(), [key, scope], "left_anti")
    everywhere = rest.join(targets.select(key, target), key).withColumn("match_scope", F.lit("global"))
    return scoped.unionByName(everywhere)


def match_any_key(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keys: list[Column], right_keys: list[Column]) -> DataFrame:
    """Distinct (left_id, right_id) that share any key; null and empty keys match nothing."""
    spread = lambda df, i, keys: df.select(i, F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("_key")).where("_key != ''")
    return spread(left, left_id, left_keys).join(spread(right, right_id, right_keys), "_key").select(left_id, right_id).distinct()


def classify(matches: DataFrame, name: str, target: str, names: DataFrame) -> DataFrame:
    """name, status (resolved, ambiguous or not_found), n_matches, target (null unless resolved) of every name."""
    found = matches.where(F.col(target).isNotNull()).groupBy(name).agg(F.count_distinct(target).alias("n"), F.min(target).alias(target))
    out = names.select(name).distinct().join(found, name, "left").withColumn("n_matches", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n_matches") == 0, "not_found").when(F.col("n_matches") == 1, "resolved").otherwise("ambiguous")
    return out.select(name, status.alias("status"), "n_matches", F.when(F.col("n_matches") == 1, F.col(target)).alias(target))


def first_that_matches(names: DataFrame, name: str, target: str, sources: list[DataFrame]) -> DataFrame:
    """(name, target) of the first source (name, target) that knows the name, all of that source's matches kept."""
    rest, out = names.select(name).distinct(), None
    for s in sources:
        hit = rest.join(s.select(name, target).distinct(), name)
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(s.select(name), name, "left_anti")
    return out


def resolve_label(rows: DataFrame, label: Column, rules: list[tuple[str, DataFrame]]) -> DataFrame:
    """rows with target and rule: the first lookup (key, target) whose key the label, or what follows its last ':', equals, whatever the case; lookups with several targets for a key name none.

    For each lookup the whole label is tried first; a hit by what follows the colon has ':suffix' after its rule.
    """
    whole = F.lower(F.trim(label))
    tail = F.trim(F.element_at(F.split(whole, ":"), -1))
    out = rows.withColumn("_label", whole).withColumn("_tail", F.when(tail != whole, tail)).withColumn("target", F.lit(None).cast("int")).withColumn("rule", F.lit(None).cast("string"))
    for name, lookup in rules:
        sure = lookup.where("key is not null").groupBy(F.lower("key").alias("_k")).agg(F.min("target").cast("int").alias("_target"), F.count_distinct("target").alias("_n")).where("_n = 1").drop("_n")
        out = out.join(sure.select(F.col("_k").alias("_label"), F.col("_target").alias("_t1")), "_label", "left").join(sure.select(F.col("_k").alias("_tail"), F.col("_target").alias("_t2")), "_tail", "left")
        hit = F.when(F.col("_t1").isNotNull(), name).when(F.col("_t2").isNotNull(), f"{name}:suffix")
        out = out.withColumn("rule", F.coalesce("rule", F.when(F.col("target").isNull(), hit))).withColumn("target", F.coalesce("target", "_t1", "_t2")).drop("_t1", "_t2")
    return out.drop("_label", "_tail")


def lookup_ids(rows: DataFrame, label: str, lookup: DataFrame, order: str, required: bool = False) -> DataFrame:
    """rows with target and error: the lookup (key, target) whose key equals the label but for case and outer blanks; of several rows with one key the last by order counts.

    error is required (a blank label, where one is required) or not-found; a label that may be blank and is has neither.
    """
    fold = lambda c: F.lower(F.trim(c))
    last = lookup.where("key is not null").groupBy(fold(F.col("key")).alias("_k")).agg(F.max_by("target", order).alias("target"))
    blank = F.coalesce(F.trim(label) == "", F.lit(True))
    out = rows.withColumn("_k", fold(F.col(label))).join(last, "_k", "left").drop("_k")
    return out.withColumn("error", F.when(blank, F.lit("required") if required else F.lit(None).cast("string")).when(F.col("target").isNull(), "not-found"))


def same_key_links(df: DataFrame, key: str, row_id: str, text: str) -> DataFrame:
    """row_id, class_id, n_others, n_same_text: each row with the class of its key (the least id in it), the number of other rows with the key, and of those with the same text; null texts are equal, a null key has no class.

    Classes are counted before they are joined back, so no pairs are written and a hot key is one row.
    """
    rows = df.select(row_id, key, F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("")), 256).alias("_t"))
    texts = rows.where(F.col(key).isNotNull()).groupBy(key, "_t").agg(F.count("*").alias("_n"), F.min(row_id).alias("_m"))
    keys = texts.groupBy(key).agg(F.sum("_n").alias("_all"), F.min("_m").alias("class_id"))
    out = rows.join(keys, key, "left").join(texts.drop("_m"), [key, "_t"], "left")
    return out.select(row_id, "class_id", F.coalesce(F.col("_all") - 1, F.lit(0)).alias("n_others"), F.coalesce(F.col("_n") - 1, F.lit(0)).alias("n_same_text"))


def prefix_join(rows: DataFrame, heads: DataFrame, text: str, head: str) -> DataFrame:
    """rows with each head that stands at the start of text followed by a blank; joined on the first word, so it stays a hash join."""
    first = lambda c: F.lower(F.element_at(F.split(F.trim(c), " "), 1))
    left, right = rows.withColumn("_w", first(F.col(text))), heads.select(head).distinct().withColumn("_w", first(F.col(head)))
    return left.join(right, "_w").where(F.startswith(F.lower(text), F.concat(F.lower(head), F.lit(" ")))).drop("_w")
