"""Upkeep of a parsed corpus: inventory cascades, conversion, summaries with skip reasons, gaps, audits and patches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.text import match_name, squeeze


def _key(c: Column | str) -> Column:
    return F.lower(squeeze(F.col(c) if isinstance(c, str) else c))


def _cascade(rules: list[tuple[Column, str]], default: str) -> Column:
    """The value of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for cond, value in rules[1:]:
        out = out.when(cond, value)
    return out.otherwise(default)


def corpus_inventory(candidates: DataFrame, appearances: DataFrame, existing: DataFrame, blockers: DataFrame) -> DataFrame:
    """cand_id, rulebook_id, category, reason of each candidate's appearances in known books, or of the candidate where it has none.

    candidates: cand_id, name, slug, is_artifact, is_core (one of its labels is a core book's), is_blocked. appearances:
    cand_id, rulebook_id (null: no such book). existing: id, name, slug, rulebook_id. blockers: cand_id of those that can't
    be converted. Names are compared as match names. The first of these counts: artifact (manual-review), no known book
    (duplicate where the label is core and the name exists, else deferred), the name in that book or the slug anywhere
    (duplicate), the name in another of its books (duplicate), blocked, unknown or several books, the name elsewhere (all
    manual-review), blockers (mismatch), else ready. Repeated appearances count once.
    """
    c = candidates.withColumn("_n", match_name(F.col("name")))
    app = appearances.select("cand_id", "rulebook_id").distinct()
    known = app.where("rulebook_id is not null")
    e = existing.select("id", match_name(F.col("name")).alias("_n"), "slug", F.col("rulebook_id").alias("_book"))
    counts = app.groupBy("cand_id").agg(F.count("rulebook_id").alias("n_known"), F.max(F.col("rulebook_id").isNull()).alias("unknown"))
    in_book = e.select("_n", F.col("_book").alias("rulebook_id")).distinct().withColumn("in_book", F.lit(True))
    named = e.select("_n").distinct().withColumn("named", F.lit(True))
    slugs = e.select("slug").where("slug is not null").distinct().withColumn("slugged", F.lit(True))
    stuck = blockers.select("cand_id").distinct().withColumn("stuck", F.lit(True))
    j = c.join(counts, "cand_id", "left").join(named, "_n", "left").join(slugs, "slug", "left").join(stuck, "cand_id", "left").join(known, "cand_id", "left").join(in_book, ["_n", "rulebook_id"], "left")
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    other = F.max(yes("in_book").cast("int")).over(Window.partitionBy("cand_id")) == 1
    alone = F.coalesce("n_known", F.lit(0)) == 0
    rules = [
        (yes("is_artifact"), "manual-review:artifact"), (alone & yes("is_core") & yes("named"), "duplicate:core-label"), (alone, "deferred:no-known-book"), (yes("in_book") | yes("slugged"), "duplicate:exists"),
        (other, "duplicate:other-book"), (yes("is_blocked"), "manual-review:blocked"), (yes("unknown") | (F.col("n_known") > 1), "manual-review:several-books"), (yes("named"), "manual-review:name-elsewhere"), (yes("stuck"), "mismatch:blockers"),
    ]
    told = j.withColumn("_o", other).withColumn("_c", _cascade([(F.col("_o") if k == 4 else cond, v) for k, (cond, v) in enumerate(rules)], "ready:"))
    told = told.withColumn("rulebook_id", F.when(~yes("is_artifact"), F.col("rulebook_id")))
    parts = F.split("_c", ":")
    return told.select("cand_id", "rulebook_id", parts[0].alias("category"), F.nullif(parts[1], F.lit("")).alias("reason")).distinct()


def inventory_summary(entries: DataFrame) -> DataFrame:
    """rulebook_id (null: without a book), one count per category, n; zeros where there are none."""
    kinds = ["deferred", "duplicate", "manual-review", "mismatch", "ready"]
    return entries.groupBy("rulebook_id").agg(*[F.count_if(F.col("category") == k).alias(k.replace("-", "_")) for k in kinds], F.count("*").alias("n"))


def conversion_check(candidates: DataFrame, lookups: DataFrame) -> DataFrame:
    """cand_id, levels, blockers, notes: what can be converted of candidates (cand_id, school, subschool, descriptors, class_levels).

    lookups: kind (school, subschool, descriptor, characterclass), name. descriptors is an array, class_levels a map of class
    to texts such as '3 (extra)'. blockers are unresolved school, subschool and descriptors, levels that can't be read, and
    no level at all; a class that isn't known is a note. levels are structs of class, level and extra, in order of class.
    """
    known = lookups.select("kind", _key("name").alias("_k")).distinct().withColumn("_hit", F.lit(1))
    asked = F.concat(
        F.array(F.struct(F.lit("school").alias("kind"), F.coalesce("school", F.lit("")).alias("label"))),
        F.when(F.trim(F.coalesce("subschool", F.lit(""))) != "", F.array(F.struct(F.lit("subschool").alias("kind"), F.col("subschool").alias("label")))).otherwise(F.array().cast("array<struct<kind:string,label:string>>")),
        F.transform(F.coalesce("descriptors", F.array().cast("array<string>")), lambda d: F.struct(F.lit("descriptor").alias("kind"), d.alias("label"))),
    )
    labels = candidates.select("cand_id", F.explode(asked).alias("a")).select("cand_id", "a.*").distinct().withColumn("_k", _key("label"))
    lost = labels.join(known, ["kind", "_k"], "left").where("_hit is null").groupBy("cand_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("unresolved "), "kind", F.lit(": "), "label"))).alias("lost"))
    form = r"^\s*(\d+)\s*(?:\((.*)\))?\s*$"
    each = candidates.select("cand_id", F.explode(F.coalesce("class_levels", F.create_map().cast("map<string,string>"))).alias("class", "raw")).withColumn("_k", _key("class"))
    each = each.join(known.where("kind = 'characterclass'").drop("kind"), "_k", "left").withColumn("_read", F.coalesce(F.col("raw").rlike(form), F.lit(False)))
    level = F.struct("class", F.regexp_extract("raw", form, 1).cast("int").alias("level"), F.nullif(F.regexp_extract("raw", form, 2), F.lit("")).alias("extra"))
    sorted_ = lambda cond, value: F.array_sort(F.collect_list(F.when(cond, value)))
    levels = each.groupBy("cand_id").agg(
        sorted_(F.col("_read") & F.col("_hit").isNotNull(), level).alias("levels"), sorted_(~F.col("_read"), F.concat(F.lit("unparsed class level: "), "class", F.lit("="), F.coalesce("raw", F.lit("")))).alias("unread"),
        sorted_(F.col("_read") & F.col("_hit").isNull(), F.concat(F.lit("skipped unresolved class: "), "class")).alias("notes"),
    )
    j = candidates.select("cand_id").distinct().join(lost, "cand_id", "left").join(levels, "cand_id", "left")
    none = F.array().cast("array<string>")
    bare = F.when(F.coalesce(F.size("levels"), F.lit(0)) <= 0, F.array(F.lit("no resolvable levels"))).otherwise(none)
    blockers = F.concat(F.coalesce("lost", none), F.coalesce("unread", none), bare)
    return j.select("cand_id", F.coalesce("levels", F.array().cast(levels.schema["levels"].dataType)).alias("levels"), blockers.alias("blockers"), F.coalesce("notes", none).alias("notes"))


def summary_variant(c: Column) -> Column:
    """A summary for comparison: without blanks, half-width marks, no full stop at the end."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""), "，。；：（）！？", ",.;:()!?"), r"[.,;]+$", "")


# Order of the kinds of lists a summary may come from.
SOURCE_KINDS = ["class-list", "maneuver-list", "domain-list"]


def choose_summaries(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """spell_id, summary_text, source_key, reason: one summary per spell, or why there is none.

    records: spell_id, rulebook_abbr, summary_text, source_key, source_kind, list_owner. decisions (spell_id, decision,
    chosen_key, chosen_text) settle spells whose records say different things: the records with the chosen key count, else
    those with the chosen text, else those that say the same. Of these the shortest text, kind, key and owner in order
    wins; without a decision only spells of one text have a summary. reason is conflict-needs-human,
    conflict-unmatched, unreviewed-variants, empty or incomplete (no key or book), null where there is a summary. One
    decision per spell is expected.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in SOURCE_KINDS]), F.col("source_kind")), F.lit(0)), F.lit(len(SOURCE_KINDS) + 1))
    r = records.where("spell_id is not null").join(decisions, "spell_id", "left").withColumn("_t", F.trim(F.coalesce("summary_text", F.lit(""))))
    tier = F.when(F.col("decision").isNull(), 0).when(F.col("source_key") == F.col("chosen_key"), 0).when(F.col("summary_text") == F.col("chosen_text"), 1).when(summary_variant(F.col("summary_text")) == summary_variant(F.col("chosen_text")), 2)
    order = F.struct(F.length("_t").alias("n"), F.when(F.col("decision").isNotNull(), rank).otherwise(0).alias("k"), F.coalesce("source_key", F.lit("")).alias("key"), F.coalesce("list_owner", F.lit("")).alias("owner"))
    usable = (F.col("decision").isNotNull() & tier.isNotNull()) | (F.col("decision").isNull() & (F.col("_t") != ""))
    g = r.groupBy("spell_id").agg(
        F.max("decision").alias("decision"), F.count_distinct(F.when(F.col("_t") != "", summary_variant(F.col("_t")))).alias("n"),
        F.min_by(F.when(usable, F.struct(F.col("_t").alias("text"), "source_key", "rulebook_abbr")), F.when(usable, F.struct(tier.alias("tier"), order.alias("o")))).alias("best"),
    )
    reason = (
        F.when(F.col("decision") == "needs_human", "conflict-needs-human").when(F.col("decision").isNotNull() & F.col("best").isNull(), "conflict-unmatched").when(F.col("decision").isNull() & (F.col("n") > 1), "unreviewed-variants")
        .when(F.col("best").isNull() | (F.col("best.text") == ""), "empty").when(F.col("best.source_key").isNull() | F.col("best.rulebook_abbr").isNull(), "incomplete")
    )
    out = g.withColumn("reason", reason)
    return out.select("spell_id", F.when(F.col("reason").isNull(), F.col("best.text")).alias("summary_text"), F.when(F.col("reason").isNull(), F.col("best.source_key")).alias("source_key"), "reason")


def match_items(items: DataFrame, spells: DataFrame, books: DataFrame) -> DataFrame:
    """item_id, spell_id, reason: items (item_id, abbr, name, summary) matched to the spells (id, name, abbr) of their book by match name, or why not.

    books: abbr of the books that are known. reason is source-without-book, book-not-known, missing-name, missing-summary,
    no-match, ambiguous or duplicate (an earlier item by id has the spell); null where the item has its spell.
    """
    b = books.select("abbr").distinct().withColumn("_book", F.lit(True))
    s = spells.select("abbr", match_name(F.col("name")).alias("_n"), "id").where("_n is not null").groupBy("abbr", "_n").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    j = items.withColumn("_n", match_name(F.col("name"))).join(b, "abbr", "left").join(s, ["abbr", "_n"], "left")
    rules = [(blank("abbr"), "source-without-book"), (F.col("_book").isNull(), "book-not-known"), (blank("name"), "missing-name"), (blank("summary"), "missing-summary"), (F.col("n").isNull(), "no-match"), (F.col("n") > 1, "ambiguous")]
    j = j.withColumn("_r", F.nullif(_cascade(rules, ""), F.lit(""))).withColumn("_id", F.when(F.col("_r").isNull(), F.col("id")))
    firsts = j.where("_id is not null").groupBy("_id").agg(F.min("item_id").alias("_first"))
    j = j.join(firsts, "_id", "left").withColumn("reason", F.coalesce("_r", F.when(F.col("_first") != F.col("item_id"), "duplicate")))
    return j.select("item_id", F.when(F.col("reason").isNull(), F.col("_id")).alias("spell_id"), "reason")


def source_gaps(items: DataFrame, spells: DataFrame) -> DataFrame:
    """item_id, gap of items (item_id, abbr, name) that have no spell in their book: unmapped (no book), not-in-source-book (the name is in another), not-in-db."""
    named = spells.select(match_name(F.col("name")).alias("_n"), F.col("abbr").alias("_a")).where("_n is not null").distinct()
    i = items.withColumn("_n", match_name(F.col("name")))
    scoped = named.withColumnRenamed("_a", "abbr").withColumn("_in", F.lit(True))
    j = i.join(scoped, ["_n", "abbr"], "left").join(named.select("_n").distinct().withColumn("_any", F.lit(True)), "_n", "left")
    return j.where("_in is null").select("item_id", F.when(F.col("abbr").isNull(), "unmapped").when(F.col("_any"), "not-in-source-book").otherwise("not-in-db").alias("gap"))


def apply_reuse(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """target, source, reason: reuse decisions (target, source, origin, decision) joined to what may be reused (target, source, text), one per target.

    Automatic decisions (origin 'auto') come before reviewed ones, then the smaller source. reason is not-accepted, stale
    (no such candidate any more) or duplicate (another decision has the target); null where the row is applied.
    """
    c = candidates.select("target", "source").distinct().withColumn("_has", F.lit(True))
    j = decisions.join(c, ["target", "source"], "left").withColumn("_r", F.when(F.coalesce(F.col("decision") != "accept", F.lit(True)), "not-accepted").when(F.col("_has").isNull(), "stale"))
    first = j.where("_r is null").groupBy("target").agg(F.min(F.struct((F.col("origin") != "auto").alias("late"), "source", "origin")).alias("_f"))
    mine = (F.col("_f.source") == F.col("source")) & (F.col("_f.origin") == F.col("origin"))
    return j.join(first, "target", "left").select("target", "source", "origin", F.coalesce("_r", F.when(~mine, "duplicate")).alias("reason"))


def alias_audit(records: DataFrame) -> DataFrame:
    """name, n, n_targets, targets, review: records (name, target, review) by name, then by what they resolve to; review is the strongest of the name's: needs_human, needs_check, accepted or none."""
    strength = F.coalesce(F.nullif(F.array_position(F.array(F.lit("accepted"), F.lit("needs_check"), F.lit("needs_human")), F.col("review")), F.lit(0)), F.lit(0))
    by = records.where("name is not null").groupBy("name", "target").agg(F.count("*").alias("k"), F.max(strength).alias("s"))
    g = by.groupBy("name").agg(F.sum("k").alias("n"), F.count("target").alias("n_targets"), F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "k")))).alias("t"), F.max("s").alias("s"))
    listed = F.array_join(F.transform("t", lambda x: F.concat(x["target"].cast("string"), F.lit("x"), x["k"].cast("string"))), ",")
    return g.select("name", "n", "n_targets", listed.alias("targets"), F.element_at(F.array(F.lit("none"), F.lit("accepted"), F.lit("needs_check"), F.lit("needs_human")), (F.col("s") + 1).cast("int")).alias("review"))


def ordered_union(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """key, source (from 0): the keys of several ordered lists one after another, each where it comes first."""
    every = None
    for n, df in enumerate(parts):
        one = df.select(key, F.lit(n).alias("source"), F.col(order).alias("_o"))
        every = one if every is None else every.unionByName(one)
    first = every.groupBy(key).agg(F.min(F.struct("source", "_o")).alias("m"))
    return first.select(key, "m.source", F.col("m._o").alias("place"))


def bijection_errors(left: DataFrame, right: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, error: what keeps aliases (left_name, right_name) from pairing the names (name) of left and right one to one.

    left-unpaired, right-unpaired, unknown-left, unknown-right (an alias of no such name), left-twice and right-twice.
    """
    l, r = left.select("name").distinct(), right.select("name").distinct()
    a, b = aliases.select(F.col("left_name").alias("name")), aliases.select(F.col("right_name").alias("name"))
    twice = lambda x: aliases.distinct().groupBy(F.col(x).alias("name")).agg(F.count("*").alias("n")).where("n > 1").select("name")
    found = {
        "left-unpaired": l.join(a, "name", "left_anti"), "right-unpaired": r.join(b, "name", "left_anti"), "unknown-left": a.distinct().join(l, "name", "left_anti"), "unknown-right": b.distinct().join(r, "name", "left_anti"),
        "left-twice": twice("left_name"), "right-twice": twice("right_name"),
    }
    out = None
    for error, df in found.items():
        one = df.select("name", F.lit(error).alias("error"))
        out = one if out is None else out.unionByName(one)
    return out


def audit_bundle(counts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """metric, key, n: several counts by a column in one table, null keys as ''."""
    out = None
    for metric, (df, column) in counts.items():
        one = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "key", "n")
        out = one if out is None else out.unionByName(one)
    return out


def stacked_rows(rows: DataFrame, keys: list[str], used: str) -> DataFrame:
    """keys, n, n_used: equal entries as one row; nulls are equal."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(used).cast("long")), F.lit(0)).alias("n_used"))


def next_id(df: DataFrame, key: str) -> Column:
    """The id after the largest, 1 for an empty table, as a scalar subquery."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).select(F.col("m") + 1).scalar()


def insert_patch(patch: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The rows that a patch (id, columns and one array of structs per child table) adds: 'parents', and each child table with new ids after its largest, in order of parent and place.

    children: name of the array to (table, column of the parent's id). Numbers are taken within parents and offset by the
    counts of the parents before.
    """
    out = {"parents": patch.drop(*children)}
    for name, (table, parent) in children.items():
        rows = patch.select("id", F.posexplode(name).alias("_place", "_c"))
        counts = rows.groupBy("id").agg(F.count("*").alias("_n"))
        before = counts.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per patched parent
        out[name] = rows.join(before, "id").select((next_id(table, "id") + F.col("_off") + F.col("_place")).cast("long").alias("id"), F.col("id").alias(parent), "_c.*")
    return out


def verify_children(patch: DataFrame, children: DataFrame, keys: list[str], nullsafe: str) -> DataFrame:
    """patch rows (keys, nullsafe, name) of children that aren't there: names compared whatever the case, null in nullsafe as ''."""
    fold = lambda df: df.select(*keys, F.lower("name").alias("_name"), F.coalesce(nullsafe, F.lit("")).alias("_x")).distinct()
    p = patch.withColumn("_name", F.lower("name")).withColumn("_x", F.coalesce(nullsafe, F.lit("")))
    return p.join(fold(children), [*keys, "_name", "_x"], "left_anti").select(*keys, "name", nullsafe).distinct()


def count_parity(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """name, n_left, n_right, same of several pairs of tables."""
    out = None
    for name, (a, b) in pairs.items():
        n, m = a.agg(F.count("*").alias("n_left")), b.agg(F.count("*")).scalar()
        one = n.select(F.lit(name).alias("name"), "n_left", m.alias("n_right")).withColumn("same", F.col("n_left") == F.col("n_right"))
        out = one if out is None else out.unionByName(one)
    return out


def artifact_errors(artifact: dict, required: list[str], schema_version: int, hashes: dict[str, str]) -> list[str]:
    """What is wrong with a generated artifact {schema_version, scope, sources: [{path, sha256}], rows}: its version, its scope, parts that lack, rows without an id or with one id twice, and sources that have changed since."""
    errors = [] if artifact.get("schema_version") == schema_version else [f"schema_version is {artifact.get('schema_version')}, not {schema_version}"]
    if artifact.get("scope") not in ("full", "limited"):
        errors.append(f"unknown scope {artifact.get('scope')!r}")
    errors += [f"{k} is missing" for k in required if k not in artifact]
    ids = [r.get("id") for r in artifact.get("rows", [])]
    errors += [f"{n} rows without an id" for n in [ids.count(None)] if n] + [f"id {i} occurs twice" for i in sorted({i for i in ids if i is not None and ids.count(i) > 1})]
    for s in artifact.get("sources", []):
        now = hashes.get(s.get("path"))
        if now != s.get("sha256"):
            errors.append(f"{s.get('path')} {'is gone' if now is None else 'has changed'}")
    return errors


def markdown_table(df: DataFrame, order: list[str], most: int = 1000) -> str:
    """A report table (at most `most` rows in order; a note tells of more) as Markdown."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    cell = lambda v: "" if v is None else (json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (list, dict)) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"] + [f"| {' | '.join(cell(v) for v in r)} |" for r in rows[:most]]
    return "\n".join(lines + ([f"\nMore than {most} rows."] if len(rows) > most else []))
