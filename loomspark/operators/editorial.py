"""Operators of catalogue upkeep: vocabularies, cascades, dispositions, drift, samples, headings and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark.functions.text import squeeze
from loomspark.operators.browse import best_per_key
from loomspark.operators.layout import fill_forward, islands, ordered


def expand_ids(ids: list[int], expansion: DataFrame) -> DataFrame:
    """Distinct ids with those that expansion (id, also_id) adds to them, ascending when ordered by id."""
    spark = expansion.sparkSession
    asked = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id int")
    more = expansion.join(F.broadcast(asked), "id", "left_semi").select(F.col("also_id").alias("id"))
    return asked.unionByName(more).where("id is not null").distinct()


def count_map(df: DataFrame, key: str) -> DataFrame:
    """key, n, most frequent first, the key breaking ties."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(key).asc_nulls_last())


def zero_filled(df: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """key, n for every member of a closed domain, also those without rows."""
    all_ = df.sparkSession.createDataFrame([(k,) for k in domain], f"{key} string")
    return all_.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").na.fill(0, ["n"])


def percent(part: Column, total: Column) -> Column:
    """One decimal; nothing of nothing is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / total, 1))


def ranked_order(c: Column, values: list[str]) -> Column:
    """Place of a value in a list, the list's length for others; for custom orders."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(len(values))).otherwise(at - 1).cast("int")


def family_groups(df: DataFrame, category: str, family: str, order: str, name: str) -> DataFrame:
    """category, family, place (least order of the family), n, names: two-level grouping, names in order."""
    return df.groupBy(category, family).agg(F.min(order).alias("place"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name]).alias("names"))


def preferred_first(df: DataFrame, keys: list[str], preferred: Column, order: str) -> DataFrame:
    """One row per key: the last preferred row, else the first row."""
    p = preferred.cast("int")
    place = F.when(preferred, -F.col(order)).otherwise(F.col(order))
    return best_per_key(df, keys, p.desc(), place)


def fan_out(df: DataFrame, column: str, out: str, separator: str = "/") -> DataFrame:
    """One row per part of 'Ward vs. Chaos/Evil/Law', each with the words before the last blank of the first part."""
    parts = F.transform(F.split(column, separator), lambda x: F.trim(x))
    head = F.regexp_extract(F.element_at(parts, 1), r"^(.*\s)?\S+$", 1)
    named = F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(head, x)))
    return df.withColumn(out, F.explode(named))


def variant_family(c: Column) -> Column:
    """Base of 'Cloak, Greater' and 'Cloak IV'."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, r",\s*[^,]+$", ""), r"\s+[IVX]+$", ""))


def related_variants(df: DataFrame, key: str, name: str) -> DataFrame:
    """key, family, n_related: each row with the family of its base name (the least key in it) and the number of others in it.

    Families are one row per task before they are shuffled, and no pairs are written; the members of a family are its
    rows. A null name has no family.
    """
    keyed = df.select(key, variant_family(F.col(name)).alias("_base"))
    families = keyed.where("_base is not null").groupBy("_base").agg(F.min(key).alias("family"), (F.count_distinct(key) - 1).alias("n_related"))
    return keyed.join(families, "_base", "left").select(key, "family", F.coalesce("n_related", F.lit(0)).alias("n_related"))


def parsed_name_issues(c: Column) -> Column:
    """Array of codes of suspicious parsed names: empty, long-name, colon, digits, lower-start."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(F.when(t == "", "empty"), F.when(F.length(t) > 60, "long-name"), F.when(t.contains(":"), "colon"), F.when(t.rlike("[0-9]"), "digits"), F.when(t.rlike("^[a-z]"), "lower-start")))


def classify_by_rules(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Name of the first rule whose pattern is found, whatever the case."""
    out = None
    for name, pattern in rules:
        hit = c.rlike(f"(?i){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def localized(df: DataFrame, column: str, table: DataFrame, lang: str, out: str) -> DataFrame:
    """df with a value's display text in a language (table: value, lang, text), the value itself where it has none."""
    t = table.where(F.col("lang") == lang).groupBy(F.col("value").alias(column)).agg(F.min("text").alias("_t"))
    return df.join(t, column, "left").withColumn(out, F.coalesce("_t", column)).drop("_t")


def table_cells(df: DataFrame, column: str) -> DataFrame:
    """Cells of 'h4.' sections of '|'-separated rows: section, row_no and cell_no from 1, cell; other columns pass through."""
    keep = [c for c in df.columns if c != column]
    lines = df.select(*keep, F.posexplode(F.split(column, "\n")).alias("_n", "_line"))
    key = keep or ["_n"]
    named = fill_forward(lines.withColumn("_h", F.when(F.col("_line").rlike(r"^h4\."), F.trim(F.regexp_replace("_line", r"^h4\.\s*", "")))), key, ["_n"], "_h", "section")
    rows = named.where(F.col("_line").startswith("|")).withColumn("row_no", F.row_number().over(Window.partitionBy(*key, "section").orderBy("_n")))
    cells = F.split(F.regexp_replace("_line", r"^\|+|\|+\s*$", ""), r"\|+")
    return rows.select(*keep, "section", "row_no", F.posexplode(F.transform(cells, lambda x: F.trim(x))).alias("cell_no", "cell")).withColumn("cell_no", F.col("cell_no") + 1)


def override_cascade(base: DataFrame, overrides: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """base with each field from the first override that sets it, else its own."""
    out = base
    for i, o in enumerate(overrides):
        out = out.join(o.select(key, *[F.col(f).alias(f"_{i}_{f}") for f in fields]), key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(*[F.col(f"_{i}_{f}") for i in range(len(overrides))], F.col(f)))
    return out.select(*base.columns)


def with_blockers(df: DataFrame, checks: dict[str, Column], out: str = "blockers") -> DataFrame:
    """df with the array of names of the checks that hold, in their order."""
    return df.withColumn(out, F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()])))


def apply_decisions(candidates: DataFrame, decisions: DataFrame, key: str, target: str) -> DataFrame:
    """key, target, outcome of every decision: applied, stale (no such candidate), rejected, or duplicate (its target was taken by an earlier decision).

    decisions: key, decision (accept or not), priority; lower priority first, then key.
    """
    j = decisions.join(candidates.select(key, target).distinct(), key, "left")
    accept = (F.col("decision") == "accept") & F.col(target).isNotNull()
    # the first of each target is found by a plain aggregate, so neither a hot target nor the stale ones meet in one task
    first = j.where(accept).groupBy(target).agg(F.min(F.struct("priority", key)).alias("_f"))
    mine = (F.col(f"_f.{key}") == F.col(key)) & F.col("_f.priority").eqNullSafe(F.col("priority"))
    outcome = F.when(F.col(target).isNull(), "stale").when(F.coalesce(F.col("decision") != "accept", F.lit(True)), "rejected").when(~F.coalesce(mine, F.lit(False)), "duplicate").otherwise("applied")
    return j.where(F.col(target).isNotNull()).join(first, target, "left").unionByName(j.where(F.col(target).isNull()), allowMissingColumns=True).select(key, target, outcome.alias("outcome"))


def verify_patch(patch: DataFrame, table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, status, field of patch rows: missing (no such row), mismatch with the first field that differs where the patch sets it, verified."""
    t = table.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(1).alias("_has"))
    j = patch.join(t, key, "left")
    field = None
    for f in fields:
        bad = F.col(f).isNotNull() & ~F.equal_null(f, f"_{f}")
        field = F.when(bad, f) if field is None else field.when(bad, f)
    status = F.when(F.col("_has").isNull(), "missing").when(field.isNotNull(), "mismatch").otherwise("verified")
    return j.select(key, status.alias("status"), F.when(F.col("_has").isNotNull(), field).alias("field"))


def stale_evidence(recorded: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status: fresh, stale (digest changed) or gone."""
    c = current.select(key, F.col(digest).alias("_d"))
    return recorded.join(c, key, "left").select(key, F.when(F.col("_d").isNull(), "gone").when(F.equal_null(digest, "_d"), "fresh").otherwise("stale").alias("status"))


def drift(imported: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """key, warning: unknown-id, missing-id or name-mismatch (white space and case apart)."""
    a, b = imported.select(key, F.col(name).alias("_a"), F.lit(1).alias("_i")), known.select(key, F.col(name).alias("_b"), F.lit(1).alias("_k"))
    j = a.join(b, key, "full_outer")
    fold = lambda c: F.lower(squeeze(F.coalesce(c, F.lit(""))))
    w = F.when(F.col("_k").isNull(), "unknown-id").when(F.col("_i").isNull(), "missing-id").when(fold(F.col("_a")) != fold(F.col("_b")), "name-mismatch")
    return j.select(key, w.alias("warning")).where("warning is not null")


def source_coverage(candidates: DataFrame, index: DataFrame, key: str, target: str) -> DataFrame:
    """key, status: matched (one target), ambiguous (several) or missing."""
    n = index.groupBy(key).agg(F.count_distinct(target).alias("_n"))
    return candidates.select(key).distinct().join(n, key, "left").select(key, F.when(F.coalesce("_n", F.lit(0)) == 0, "missing").when(F.col("_n") == 1, "matched").otherwise("ambiguous").alias("status"))


def readiness(df: DataFrame, group: str, checks: dict[str, Column]) -> DataFrame:
    """group, a count per check, and ready where none has a row."""
    out = df.groupBy(group).agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    total = None
    for n in checks:
        total = F.col(n) if total is None else total + F.col(n)
    return out.withColumn("ready", total == 0)


def queue_samples(df: DataFrame, queue: str, order: list[str], per_queue: int, most: int) -> DataFrame:
    """The first per_queue rows of each queue, most in all; a report, so its limits are its feature."""
    w = Window.partitionBy(queue).orderBy(*order)
    return df.withColumn("priority", F.row_number().over(w)).where(F.col("priority") <= per_queue).orderBy("priority", queue).limit(most)


def label_histogram(df: DataFrame, label: str, example: str, n: int = 5) -> DataFrame:
    """label, n, examples: how often each label occurs with its first n distinct examples in order."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(label).orderBy(example)
    few = df.where(F.col(example).isNotNull()).select(label, example).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return counts.join(few.groupBy(label).agg(F.array_sort(F.collect_list(example)).alias("examples")), label, "left")


def classified_labels(df: DataFrame, label: str, example: str, rules: list[tuple[str, str]], default: str, n: int = 5) -> DataFrame:
    """label_histogram with class: the name of the first of rules (name, pattern) that the label matches."""
    return label_histogram(df, label, example, n).withColumn("class", classify_by_rules(F.col(label), rules, default))


def reference_report(parsed: DataFrame, reference: DataFrame, book: str, key: str, least: float) -> DataFrame:
    """book, n_parsed, n_reference, n_missing, n_extra, status of the keys of a parser's output against a reference list, by book; status is missing-book, unknown-book, below (a smaller part than least of the reference was found) or ok."""
    p, r = parsed.select(book, key).distinct().withColumn("_p", F.lit(1)), reference.select(book, key).distinct().withColumn("_r", F.lit(1))
    j = p.join(r, [book, key], "full_outer").groupBy(book).agg(F.count("_p").alias("n_parsed"), F.count("_r").alias("n_reference"), F.count_if(F.col("_p").isNull()).alias("n_missing"), F.count_if(F.col("_r").isNull()).alias("n_extra"))
    status = F.when(F.col("n_parsed") == 0, "missing-book").when(F.col("n_reference") == 0, "unknown-book").when(F.col("n_reference") - F.col("n_missing") < F.col("n_reference") * least, "below").otherwise("ok")
    return j.withColumn("status", status)


def key_audit(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, issue of two localization tables: missing-left, missing-right, untranslated (equal values), duplicate-value (right value of several keys)."""
    a, b = left.select(key, F.col(value).alias("_a"), F.lit(1).alias("_l")), right.select(key, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    dup = b.where("_b is not null").groupBy("_b").agg(F.count_distinct(key).alias("_n"))
    j = a.join(b, key, "full_outer").join(dup, "_b", "left")
    found = F.array_compact(F.array(F.when(F.col("_l").isNull(), "missing-left"), F.when(F.col("_r").isNull(), "missing-right"), F.when(F.col("_a") == F.col("_b"), "untranslated"), F.when(F.col("_n") > 1, "duplicate-value")))
    return j.select(key, F.explode(found).alias("issue"))


_ENTRY = T.StructType([T.StructField("id", T.StringType()), T.StructField("spellId", T.IntegerType()), T.StructField("used", T.IntegerType()), T.StructField("levels", T.ArrayType(T.IntegerType()))])


def import_collection(df: DataFrame, column: str) -> DataFrame:
    """Entries of a JSON array text: invalid ones dropped, ids defaulted to 'entry-<place>', the first of repeated ids kept; the other columns pass through."""
    keep = [c for c in df.columns if c != column]
    entry = lambda e, i: F.struct(F.coalesce(F.nullif(F.trim(e["id"]), F.lit("")), F.concat(F.lit("entry-"), i.cast("string"))).alias("id"), e["spellId"].alias("spell_id"), F.coalesce(e["used"], F.lit(0)).alias("used"), e["levels"].alias("levels"))
    good = F.filter(F.transform(F.from_json(column, T.ArrayType(_ENTRY)), entry), lambda e: e["spell_id"] > 0)
    rows = df.withColumn("_e", good).withColumn("_ids", F.transform("_e", lambda e: e["id"]))
    first = F.filter("_e", lambda e, i: F.array_position(F.col("_ids"), e["id"]) == i + 1)
    return rows.select(*keep, F.explode(first).alias("e")).select(*keep, "e.id", "e.spell_id", "e.used", "e.levels")


def merge_wrapped_headings(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, heading, n_lines of heading lines (y, height, font, text): a line goes on with the one before when it is 8 to 16 below it in the same font, both at least 10.5 high."""
    w = ordered(keys, order)
    gap = F.col("y") - F.lag("y").over(w)
    goes_on = gap.between(8, 16) & (F.col("font") == F.lag("font").over(w)) & (F.col("height") >= 10.5) & (F.lag("height").over(w) >= 10.5)
    runs = islands(lines, keys, [order], ~F.coalesce(goes_on, F.lit(False)))
    return runs.groupBy(*keys, "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("heading"), F.count("*").alias("n_lines"))


def detach_between(lines: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """lines with detached: whether they stand from an opening marker to the line before the next closing one."""
    w = ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(closes, F.lit(0)).when(opens, F.lit(1)), ignorenulls=True).over(w)
    return lines.withColumn("detached", F.coalesce(state, F.lit(0)) == 1)


def list_records(lines: DataFrame, keys: list[str], order: list[str], line: str) -> DataFrame:
    """keys, owner, level, name, summary of list pages: 'OWNER SPELLS' opens an owner (and forgets the level), '3RD-LEVEL' a level, 'Name: summary' a record, other lines go on with the record before."""
    t = F.trim(line)
    owner = F.regexp_extract(t, r"^([A-Z][A-Z /]+) SPELLS$", 1)
    level = F.regexp_extract(t, r"^(\d)(?:ST|ND|RD|TH)[- ]LEVEL\b", 1)
    w = ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("_o", F.nullif(owner, F.lit(""))).withColumn("_l", F.nullif(level, F.lit(""))).withColumn("_t", t)
    df = df.withColumn("owner", F.last("_o", ignorenulls=True).over(w))
    # -1 stands for "no level since the owner"
    df = df.withColumn("level", F.last(F.when(F.col("_o").isNotNull(), F.lit(-1)).otherwise(F.col("_l").cast("int")), ignorenulls=True).over(w))
    body = df.where("_o is null and _l is null and _t != ''")
    starts = F.col("_t").rlike(r"^[A-Z][^:]{1,60}:\s")
    runs = islands(body, [*keys, "owner", "level"], order, starts)
    texts = runs.groupBy(*keys, "owner", "level", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_t"))), lambda x: x["_t"]), " ").alias("_r"))
    good = texts.where(F.col("_r").rlike(r"^[A-Z][^:]{1,60}:\s"))
    return good.select(*keys, "owner", F.when(F.col("level") >= 0, F.col("level")).alias("level"), F.trim(F.regexp_extract("_r", r"^([^:]+):", 1)).alias("name"), F.trim(F.regexp_replace("_r", r"^[^:]+:", "")).alias("summary"))


def latest_build(builds: DataFrame) -> DataFrame:
    """The build generated last, the greater id on ties."""
    return builds.orderBy(F.col("generated_at").desc_nulls_last(), F.col("id").desc()).limit(1)


def set_balance(parts: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: whole and part counts, repeated and missing keys, and balanced where every key is in exactly one part row."""
    p = parts.groupBy(key).agg(F.count("*").alias("_n"))
    j = whole.select(key).distinct().withColumn("_w", F.lit(1)).join(p, key, "full_outer")
    out = j.agg(F.count_if(F.col("_w").isNotNull()).alias("n_whole"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_parts"), F.count_if(F.col("_n") > 1).alias("n_repeated"), F.count_if(F.col("_n").isNull()).alias("n_missing"), F.count_if(F.col("_w").isNull()).alias("n_unknown"))
    return out.withColumn("balanced", (F.col("n_repeated") == 0) & (F.col("n_missing") == 0) & (F.col("n_unknown") == 0))
