"""Comparing datasets: full outer differences, three-way dispositions, parity, coverage, upserts, conflicts, text edits."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.text import squeeze, tokens

#: Categories of a pivot are collected as its columns; a longer list is refused.
MAX_CATEGORIES = 1_000


def membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, n_left, n_right, membership (both, left_only, right_only) of every key, whatever its number on either side."""
    a, b = left.groupBy(key).agg(F.count("*").alias("n_left")), right.groupBy(key).agg(F.count("*").alias("n_right"))
    out = a.join(b, key, "full_outer").na.fill(0, ["n_left", "n_right"])
    return out.withColumn("membership", F.when(F.col("n_right") == 0, "left_only").when(F.col("n_left") == 0, "right_only").otherwise("both"))


def compare_text(a: Column, b: Column) -> Column:
    """exact, formatting (equal but for case, white space and marks) or substantive; nulls equal blanks."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    bare = lambda c: F.regexp_replace(F.lower(squeeze(c)), "[^a-z0-9 ]", "")
    return F.when(a == b, "exact").when(squeeze(bare(a)) == squeeze(bare(b)), "formatting").otherwise("substantive")


def worst(categories: list[Column]) -> Column:
    """The worst of several comparison categories."""
    rank = F.greatest(*[F.when(c == "substantive", 2).when(c == "formatting", 1).otherwise(0) for c in categories])
    return F.element_at(F.array(F.lit("exact"), F.lit("formatting"), F.lit("substantive")), rank + 1)


def three_way(base: Column, ours: Column, theirs: Column) -> Column:
    """missing, corroborated, ours-drift, theirs-drift, both-same-change or three-way, of three versions of a value."""
    return (
        F.when(base.isNull() | ours.isNull() | theirs.isNull(), "missing")
        .when((base == ours) & (base == theirs), "corroborated")
        .when(base == theirs, "ours-drift")
        .when(base == ours, "theirs-drift")
        .when(ours == theirs, "both-same-change")
        .otherwise("three-way")
    )


def first_mismatch(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field of the first field in which the two sides differ (null-safe); '_row' where one side has no row."""
    a, b = left.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(1).alias("_a")), right.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(1).alias("_b"))
    j = a.join(b, key, "full_outer")
    field = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "_row")
    for f in fields:
        field = field.when(~F.equal_null(f"_a_{f}", f"_b_{f}"), f)
    return j.select(key, field.alias("field")).where("field is not null")


def upsert_plan(current: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, action (inserted, updated, unchanged) of every incoming key; one incoming row per key is expected."""
    old = current.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(1).alias("_old"))
    same = F.lit(True)
    for f in fields:
        same = same & F.equal_null(f, f"_{f}")
    action = F.when(F.col("_old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return incoming.join(old, key, "left").select(key, action.alias("action"))


def apply_upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """current with incoming's rows in place of those with the same key, and the new ones."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def sparse_update(current: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """current with the fields a patch sets: patch has value columns and set_<field> flags, so null can be set too."""
    p = patch.select(key, *[F.col(f).alias(f"_{f}") for f in fields], *[F.col(f"set_{f}").alias(f"_set_{f}") for f in fields])
    out = current.join(p, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.coalesce(f"_set_{f}", F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f)))
    return out.select(*current.columns)


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side of the keys that one side alone has."""
    return membership(left, right, key).where("membership != 'both'").select(key, F.col("membership").alias("side"))


def conflicts(rows: DataFrame, key: str, text: str, preferred: Column) -> DataFrame:
    """key, n_texts of keys with two or more different normalized texts, among the preferred rows where the key has any."""
    norm = rows.select(key, F.lower(squeeze(F.col(text))).alias("_t"), preferred.alias("_p")).where("_t is not null and _t != ''")
    n = norm.groupBy(key).agg(F.count_distinct(F.when(F.col("_p"), F.col("_t"))).alias("_pn"), F.count_distinct("_t").alias("_n"))
    return n.select(key, F.when(F.col("_pn") > 0, F.col("_pn")).otherwise(F.col("_n")).alias("n_texts")).where("n_texts >= 2")


def token_overlap(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, matched, n_left, n_right, recall, precision of token multisets; no tokens at all counts as 1."""
    count = lambda df, n: df.select(key, F.explode(tokens(F.col(text))).alias("_w")).groupBy(key, "_w").agg(F.count("*").alias(n))
    j = count(left, "_l").join(count(right, "_r"), [key, "_w"], "full_outer").na.fill(0, ["_l", "_r"])
    sums = j.groupBy(key).agg(F.sum(F.least("_l", "_r")).alias("matched"), F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    keys = left.select(key).unionByName(right.select(key)).distinct()
    out = keys.join(sums, key, "left").na.fill(0, ["matched", "n_left", "n_right"])
    ratio = lambda a, b: F.when(F.col(b) == 0, F.when(F.col(a) == 0, 1.0).otherwise(0.0)).otherwise(F.round(F.col(a) / F.col(b), 6))
    return out.withColumn("recall", ratio("matched", "n_left")).withColumn("precision", ratio("matched", "n_right"))


def coverage(entities: DataFrame, group: str, key: str, texts: dict[str, DataFrame]) -> DataFrame:
    """group and the grand total (null group): total, with_<name> per text table, missing_all; texts are keyed by key."""
    out = entities.select(group, key).distinct()
    for name, t in texts.items():
        out = out.join(t.select(key).distinct().withColumn(f"_{name}", F.lit(1)), key, "left")
    has = [F.col(f"_{n}").isNotNull() for n in texts]
    none = ~has[0]
    for h in has[1:]:
        none = none & ~h
    return out.rollup(group).agg(F.count("*").alias("total"), *[F.count_if(h).alias(f"with_{n}") for n, h in zip(texts, has)], F.count_if(none).alias("missing_all"))


def pivot_counts(rows: DataFrame, keys: DataFrame, domain: DataFrame, key: str, category: str, prefix: str) -> DataFrame:
    """key, one count per category of domain (prefix and value) and other, for every key of keys or rows; zeros where there are no rows.

    rows whose category is null or not in domain count as other, so that the counts of a key sum to its rows. domain is collected.
    """
    listed = domain.where(F.col(category).isNotNull()).select(category).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(listed) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    values = sorted(r[0] for r in listed)
    named = F.when(F.col(category).isin(values), F.concat(F.lit(prefix), F.col(category).cast("string"))).otherwise("other")
    each = rows.select(key, named.alias("_c"), F.lit(1).alias("_n")).unionByName(keys.select(key, F.lit("other").alias("_c"), F.lit(0).alias("_n")))
    return each.groupBy(key).pivot("_c", [f"{prefix}{v}" for v in values] + ["other"]).agg(F.sum("_n")).na.fill(0, [f"{prefix}{v}" for v in values] + ["other"])


def decisions(expected: DataFrame, actual: DataFrame, key: str, decision: str, allowed: list[str]) -> DataFrame:
    """key, status: ok, missing (no decision), stale (for nothing expected), invalid (value not allowed), duplicate."""
    a = actual.groupBy(key).agg(F.count("*").alias("_n"), F.min(decision).alias("_d"))
    j = expected.select(key).distinct().withColumn("_e", F.lit(1)).join(a, key, "full_outer")
    status = F.when(F.col("_e").isNull(), "stale").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").when(~F.coalesce(F.col("_d").isin(allowed), F.lit(False)), "invalid").otherwise("ok")
    return j.select(key, status.alias("status"))


def patch_errors(patch: DataFrame, base: DataFrame, parents: DataFrame, key: str, name: str, parent: str) -> DataFrame:
    """key, error of patch rows: duplicate-id, duplicate-name, id-exists, parent-missing; a row may have several."""
    dup = lambda col, code: patch.join(patch.groupBy(col).agg(F.count("*").alias("_n")).where("_n > 1").select(col), col, "left_semi").select(key, F.lit(code).alias("error"))
    exists = patch.join(base.select(key), key, "left_semi").select(key, F.lit("id-exists").alias("error"))
    orphan = patch.where(F.col(parent).isNotNull()).join(parents.select(F.col("id").alias(parent)).distinct(), parent, "left_anti").select(key, F.lit("parent-missing").alias("error"))
    return dup(key, "duplicate-id").unionByName(dup(name, "duplicate-name")).unionByName(exists).unionByName(orphan).distinct()


#: What must be as it was for an earlier review to hold.
EVIDENCE = ["category", "evidence_ids", "flags", "fingerprint"]


def merge_reviews(previous: DataFrame, proposed: DataFrame, key: str, full: bool = False) -> DataFrame:
    """proposed (key, EVIDENCE, status) with the earlier status where all of EVIDENCE is the same; carried says so.

    full: a new status that is no longer 'proposed' takes the place of one that still is. One row per key is expected.
    """
    p = previous.select(key, *[F.col(c).alias(f"_{c}") for c in EVIDENCE], F.col("status").alias("_status"))
    same = F.col("_status").isNotNull()
    for c in EVIDENCE:
        same = same & F.equal_null(c, f"_{c}")
    if full:
        same = same & ~((F.col("_status") == "proposed") & (F.col("status") != "proposed"))
    carried = F.coalesce(same, F.lit(False))
    return proposed.join(p, key, "left").select(key, *EVIDENCE, F.when(carried, F.col("_status")).otherwise(F.col("status")).alias("status"), carried.alias("carried"))


def _typography(t: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", t).translate(_QUOTES).split())


_QUOTES = str.maketrans("‘’“”", "''\"\"")
_STOP = re.compile(r"[.!?](?=\s|$)")


def _edit_sentences(text: str, op: str, find: str, value: str, count: int) -> tuple[str, str]:
    if op == "replace_first_sentence":
        if text.startswith(value):
            return text, "already-present"
        cut = re.search(r"(?<=[.!?])\s+(?=[A-Z])", text)
        return (f"{value} {text[cut.start():].strip()}", "applied") if cut else (text, "target-not-found")
    at = text.find(find)
    if op == "insert_before_sentence_end":
        if value in text:
            return text, "already-present"
        stop = max(text.rfind(c, 0, len(text[:at].rstrip())) for c in ".!?") if at >= 0 else -1
        return (f"{text[:stop]} {value}{text[stop:]}", "applied") if stop >= 0 else (text, "target-not-found")
    if at < 0:
        return text, "already-present"
    ends = [m.end() for m in _STOP.finditer(text, at)]
    if len(ends) < count:
        return text, "target-not-found"
    rest = text[ends[count - 1] :] if count else text[at:]
    return re.sub(r"\s+", " ", text[:at] + rest.lstrip()), "applied"


def _edit_words(parts: dict[str, str], op: str, find: str, value: str, separator: str, last: bool) -> str:
    """Edit the first of the parts (the text, then the fields) that holds the target; gives the status."""
    target = _typography(find)
    new = "" if op == "delete" else f"{value}{separator}{find}" if op == "insert_before" else value
    plain = {k: _typography(v) for k, v in parts.items()}
    if op == "delete":
        if not any(target in v for v in plain.values()):
            return "already-present"
    else:
        wanted = _typography(new)
        if any(wanted in v or re.sub(r"[.;:]$", "", wanted) in v for v in plain.values()):
            return "already-present"
    for k, v in plain.items():
        at = v.rfind(target) if last else v.find(target)
        if at >= 0:
            parts[k] = v[:at] + new + v[at + len(target) :]
            return "applied"
    return "target-not-found"


_TEXT = ""
_FOLDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("statuses", T.ArrayType(T.StringType()))])


@F.pandas_udf(_FOLDED)
def _fold_edits(text: pd.Series, fields: pd.Series, edits: pd.Series) -> pd.DataFrame:
    rows = []
    for t, f, es in zip(text, fields, edits):
        parts, out = {_TEXT: t or "", **{k: v for k, v in (dict(f) if f is not None else {}).items() if v is not None}}, []
        for e in es if es is not None else []:
            op, find, value = e["op"], e["find"] or "", e["value"] or ""
            if op == "replace_full_body":
                status = "already-present" if _typography(parts[_TEXT]) == _typography(value) else "applied"
                parts[_TEXT] = value
            elif op in ("replace_first_sentence", "insert_before_sentence_end", "delete_sentences"):
                parts[_TEXT], status = _edit_sentences(parts[_TEXT], op, find, value, 1 if e["count"] is None else int(e["count"]))
            elif op in ("replace", "insert_before", "delete"):
                status = _edit_words(parts, op, find, value, " " if e["separator"] is None else e["separator"], e["occurrence"] == "last")
            else:
                status = "unknown-op"
            out.append(status)
        rows.append((parts.pop(_TEXT), parts, out))
    return pd.DataFrame(rows, columns=["text", "fields", "statuses"])


def apply_text_edits(texts: DataFrame, edits: DataFrame, key: str, text: str, fields: str | None = None) -> DataFrame:
    """key, text, fields, statuses after the edits of a text and its fields (a map column) in order of edit_no.

    edits: key, edit_no, op, find, value and, where they are given, count, occurrence and separator. replace, delete and
    insert_before (with separator, a blank if null) change the first (or last) place of find in the text or else in a
    field, whatever its quotes and blanks; replace_full_body and replace_first_sentence put value in place;
    insert_before_sentence_end puts value before the end of the sentence before the one that begins with find;
    delete_sentences takes count sentences away from find on. A status is applied, already-present (also for what is to
    go and isn't there) or target-not-found; only the first changes anything. An unknown op is unknown-op.
    """
    optional = {"count": "int", "occurrence": "string", "separator": "string"}
    given = [F.col(c).cast(t).alias(c) if c in edits.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    listed = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("edit_no", "op", "find", "value", *given))).alias("_e"))
    kept = F.col(fields) if fields else F.lit(None).cast("map<string,string>")
    out = texts.select(key, F.col(text).alias("_t"), kept.alias("_f")).join(listed, key, "left").withColumn("_r", _fold_edits("_t", "_f", "_e"))
    return out.select(key, "_r.text", "_r.fields", F.coalesce("_r.statuses", F.array().cast("array<string>")).alias("statuses"))


def inventory(rows: DataFrame, key: str, checks: list[tuple[str, Column]], default: str) -> DataFrame:
    """key, disposition: the first check that holds."""
    chain = None
    for name, cond in checks:
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    return rows.select(key, chain.otherwise(default).alias("disposition"))


def label_audit(labels: DataFrame, key: str, label: str) -> DataFrame:
    """key, status: defer (no label), replace (outer blanks or double blanks), needs-review (label used by several keys), keep."""
    n = labels.where(F.col(label).isNotNull()).groupBy(F.lower(squeeze(F.col(label))).alias("_k")).agg(F.count_distinct(key).alias("_n"))
    j = labels.withColumn("_k", F.lower(squeeze(F.col(label)))).join(n, "_k", "left")
    status = F.when(F.col(label).isNull() | (F.trim(label) == ""), "defer").when(F.col(label) != squeeze(F.col(label)), "replace").when(F.col("_n") > 1, "needs-review").otherwise("keep")
    return j.select(key, label, status.alias("status"))


