"""Filters: text buckets, groups of alternatives, and facets as semi joins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def and_of_ors(groups: dict[str, list[Column]]) -> Column:
    """Every group that has conditions must meet one of them."""
    return all_of(any_of(g) for g in groups.values() if g)


def name_contains(c: Column, query: str) -> Column:
    """Substring without regard to case; the query's marks have no special meaning."""
    return F.lower(c).contains(query.lower())


def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def casting_time_bucket(c: Column, key: str) -> Column:
    t = _text(c)
    words = {"immediate_action": "immediate action", "swift_action": "swift action", "free_action": "free action", "standard_action": "standard action", "full_round_action": "full-round action"}
    if key == "round":
        return t.contains("round") & ~t.contains("full-round action")
    return t.contains(words.get(key, key))


def range_bucket(c: Column, key: str) -> Column:
    return F.coalesce(c, F.lit("")).rlike("^[0-9]") if key == "fixed" else _text(c).startswith(key)


def duration_bucket(c: Column, key: str) -> Column:
    t, words = _text(c), ("instantaneous", "permanent", "concentration")
    return t.rlike("[0-9]") & all_of(~t.contains(w) for w in words) if key == "timed" else t.contains(key)


def saving_throw_bucket(c: Column, key: str) -> Column:
    t = _text(c)
    return (t == "") | (t == "none") | t.startswith("no ") if key == "none" else t.contains(key)


def resistance_bucket(c: Column, key: str) -> Column:
    t = _text(c)
    return (t == key) | t.startswith(f"{key} ")


BUCKETS = {"casting_time": casting_time_bucket, "range_text": range_bucket, "duration": duration_bucket, "saving_throw": saving_throw_bucket, "spell_resistance": resistance_bucket}


def mechanic_filter(keys: dict[str, list[str]]) -> Column:
    """Keys of one field are alternatives, fields must all be met; fields without keys don't count."""
    return and_of_ors({field: [BUCKETS[field](F.col(field), k) for k in ks] for field, ks in keys.items()})


def with_facet(rows: DataFrame, facets: DataFrame, key: str, condition: Column) -> DataFrame:
    """Rows with some facet row that meets the condition: a semi join, so rows never multiply."""
    return rows.join(facets.where(condition).select(key), key, "left_semi")


def with_all(rows: DataFrame, facets: DataFrame, key: str, member: str, wanted: list) -> DataFrame:
    """Rows that have all wanted members among their facets (relational division); an empty list asks for nothing."""
    if not wanted:
        return rows
    full = facets.where(F.col(member).isin(wanted)).groupBy(key).agg(F.count_distinct(member).alias("_n")).where(F.col("_n") == len(set(wanted))).select(key)
    return rows.join(full, key, "left_semi")


def in_list_scope(rows: DataFrame, entries: DataFrame, key: str, owners: dict[str, list[int]], level: int | None = None) -> DataFrame:
    """Rows with a list entry of one of the owners (by list_type), at the level if given."""
    scope = any_of((F.col("list_type") == kind) & F.col("owner_id").isin(ids) for kind, ids in owners.items() if ids)
    return with_facet(rows, entries, key, scope if level is None else scope & (F.col("level") == level))


def parse_ids(raw: str | None) -> list[int]:
    """Distinct whole numbers of a comma list, ascending; anything else in it is ignored."""
    return sorted({int(x) for x in (raw or "").split(",") if x.strip().lstrip("-").isdigit()})


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return default if value is None else max(low, min(high, value))


def known_keys(raw: str | None, vocabulary: list[str]) -> list[str]:
    """Keys of a comma list that the vocabulary has, in its order."""
    asked = {x.strip() for x in (raw or "").split(",")}
    return [k for k in vocabulary if k in asked]


def long_enough(query: str) -> bool:
    """Two characters, or one where it is Han."""
    q = query.strip()
    return len(q) >= (1 if any("㐀" <= c <= "鿿" for c in q) else 2)
