"""Text functions as column expressions; those that Spark's built-ins can't express are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(c: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_typography(c: Column) -> Column:
    """Curly quotes and long dashes in ASCII."""
    return F.translate(c, "‘’‛“”„‐‑‒–—−", "'''\"\"\"------")


def fold_fullwidth(c: Column) -> Column:
    """Full-width digits and common CJK punctuation in ASCII."""
    return F.translate(c, "０１２３４５６７８９，：；（）！？", "0123456789,:;()!?")


# Numerals that compatibility forms have as one character.
_ROMAN = dict(zip("ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ", ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]))


def fold_roman(c: Column) -> Column:
    """Roman numerals of one character as letters."""
    for mark, letters in _ROMAN.items():
        c = F.replace(c, F.lit(mark), F.lit(letters))
    return c


def unicode_tokens(c: Column) -> Column:
    """Array of lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def appearances(c: Column) -> Column:
    """Array of appearance_parts of 'Book 128; Other book 9'; blank parts are left out."""
    return F.transform(F.filter(F.transform(F.split(c, ";"), squeeze), lambda x: x != ""), appearance_parts)


def slug(c: Column, drop_quotes: bool = False) -> Column:
    """Lower case letters and digits with single hyphens; quotes separate, or vanish with drop_quotes."""
    s = F.lower(F.trim(c))
    if drop_quotes:
        s = F.regexp_replace(s, "['’]", "")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def name_key(c: Column) -> Column:
    """Comparable form of a name: folded quotes, no trailing component marks such as '(M, XP)', single blanks, lower case."""
    bare = F.regexp_replace(fold_typography(c), r"(?i)\s*\((?:(?:m|f|df|xp)(?:\s*[,/]\s*)?)+\)\s*$", "")
    return F.lower(squeeze(bare))


def compact_key(c: Column) -> Column:
    """Letters and digits of a name key."""
    return F.regexp_replace(name_key(c), "[^a-z0-9]+", "")


def invert_comma(c: Column) -> Column:
    """'Cloak, Greater' as 'Greater Cloak'."""
    return F.regexp_replace(c, r"^(.+),\s*(.+)$", "$2 $1")


def strip_html(c: Column) -> Column:
    """Text of simple HTML: tags and entities away, single blanks."""
    s = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(mark))
    return squeeze(s)


def escape_html(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def tokens(c: Column) -> Column:
    """Array of lower-case words, an apostrophe inside kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+(?:'[a-z0-9]+)*)"), 1)


def level_parts(c: Column) -> Column:
    """'3 (arcane)' as struct(level, extra)."""
    return F.struct(
        F.nullif(F.regexp_extract(c, r"^\s*(\d+)", 1), F.lit("")).cast("int").alias("level"), clean(F.regexp_extract(c, r"\(([^)]*)\)\s*$", 1)).alias("extra")
    )


def appearance_parts(c: Column) -> Column:
    """'Book name 128' as struct(label, page)."""
    return F.struct(squeeze(F.regexp_replace(c, r"\s+\d+\s*$", "")).alias("label"), F.nullif(F.regexp_extract(c, r"\s(\d+)\s*$", 1), F.lit("")).cast("int").alias("page"))


def end_sentence(c: Column, lang: Column) -> Column:
    """Text with the full stop of its language where it ends in none; a stop of the other language is replaced."""
    t = F.trim(c)
    zh = F.lower(lang).startswith("zh")
    return (
        F.when(t == "", t)
        .when(zh & t.rlike("[。！？]$"), t)
        .when(~zh & t.rlike("[.!?]$"), t)
        .when(zh, F.concat(F.regexp_replace(t, "[.,，、;；]+$", ""), F.lit("。")))
        .otherwise(F.concat(F.regexp_replace(t, "[。，、,;；]+$", ""), F.lit(".")))
    )


def text_issues(c: Column) -> Column:
    """Array of issue codes: empty, mojibake, raw-html, no-terminal."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.array_compact(
        F.array(
            F.when(t == "", "empty"),
            F.when(t.rlike("�|Ã.|â€"), "mojibake"),
            F.when(t.rlike("<[A-Za-z/][^>]*>"), "raw-html"),
            F.when((t != "") & ~t.rlike("[.!?。！？]$"), "no-terminal"),
        )
    )


def mostly_english(c: Column) -> Column:
    """At least three letters and more than four fifths of the characters ASCII."""
    ascii_ = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return (F.length(F.regexp_replace(c, "[^A-Za-z]", "")) >= 3) & (ascii_ > 0.8 * F.length(c))


def list_extra(c: Column) -> Column:
    """struct(variant_label, note, issue_code) of a list entry's free remark: a bracketed or plain short remark is a variant, others are notes to review."""
    t = clean(c)
    bracketed = t.rlike(r"^\([^)]+\)$")
    complex_ = t.rlike(r"(?i)^(see|except|only|including|as )") | t.rlike(r"(?i)[;,]|\bor\b|\band\b|\d+\s*gp|\d+\s*xp")
    label = F.when(bracketed, F.trim(F.regexp_extract(t, r"^\((.*)\)$", 1))).when(~complex_, t)
    review = ~bracketed & complex_
    return F.struct(label.alias("variant_label"), F.when(review, t).alias("note"), F.when(review, F.lit("list.extra.review")).alias("issue_code"))


def fingerprint(*cols: Column) -> Column:
    """SHA-256 over columns in the order given; null differs from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility form."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Compatibility form without combining marks."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def bracket_groups(s: pd.Series) -> pd.Series:
    """Contents of the outermost brackets, full or half width, in order; nesting kept inside, unclosed ones left out."""

    def groups(x: str | None) -> list[str]:
        out, depth, at = [], 0, 0
        for i, c in enumerate(x or ""):
            if c in "(（":
                depth += 1
                if depth == 1:
                    at = i + 1
            elif c in ")）" and depth:
                depth -= 1
                if depth == 0:
                    out.append(x[at:i].strip())
        return out

    return s.map(groups)


# Marks that a table's first cell, each further cell and each row's end are told by in paragraphs.
ROW_OPENS, CELL, ROW_ENDS = "\ue000", "\ue001", "\ue002"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("cells", T.ArrayType(T.StringType()))])))
def body_blocks(paragraphs: pd.Series) -> pd.Series:
    """Array of struct(kind, text, cells): the paragraphs and table rows of an array of paragraphs with cell marks.

    A row goes from its first mark to its end mark, or to the end of the text; text in it is the cell opened last, or a
    cell of its own where that has text already.
    """

    def blocks(lines) -> list[dict]:
        out: list[dict] = []
        cells: list[str] | None = None
        for piece in re.split(f"([{ROW_OPENS}-{ROW_ENDS}])", "\n".join(x or "" for x in lines)) if lines is not None else []:
            if piece in (ROW_OPENS, CELL):
                cells = [*(cells or []), *([""] if piece == CELL else [])]
            elif piece == ROW_ENDS:
                out.append({"kind": "table-row", "text": None, "cells": cells or []})
                cells = None
            else:
                for text in filter(None, map(str.strip, piece.split("\n"))):
                    if cells is None:
                        out.append({"kind": "paragraph", "text": text, "cells": None})
                    elif cells and not cells[-1]:
                        cells[-1] = text
                    else:
                        cells.append(text)
        return out if cells is None else [*out, {"kind": "table-row", "text": None, "cells": cells}]

    return paragraphs.map(blocks)


def locale_order(c: Column) -> Column:
    """Sort key of the Unicode root order: case and accents break ties only."""
    return F.collate(c, "UNICODE")


def numeric_order(c: Column) -> Column:
    """Sort key in which runs of digits of any length compare as numbers: each has its number of digits before it, leading zeros away."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    bare = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 10, "0"), F.lit("."), bare(x))).otherwise(x)), "")


def true_flags(keys: Column, values: Column) -> Column:
    """Map of the flags that hold."""
    return F.map_filter(F.map_from_arrays(keys, values), lambda k, v: v)


def typography(c: Column) -> Column:
    """Compatibility form with straight quotes and single blanks, none outside."""
    return squeeze(F.translate(nfkc(c), "‘’“”", "\'\'\"\""))


# Component marks that may follow a name, and the modifiers that follow a comma.
_MARK = r"\s*\((?:m|f|df|xp|v|s|af|x)\)\s*$"
_MODIFIER = r",\s*(greater|lesser)$"


def match_name(c: Column) -> Column:
    """A name to be compared: lower case, without a component mark at the end, and 'x, greater' without its comma."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(squeeze(c)), _MARK, ""), _MODIFIER, " $1"))


def name_variants(c: Column, aliases: Column | None = None) -> Column:
    """Array of the names that a name stands for: its parts between ' / ', or between slashes that only repeat one name, without a running number at the end; aliases maps match names to more names."""
    parts = lambda by: F.filter(F.transform(F.split(c, by), lambda x: F.trim(x)), lambda x: x != "")
    spaced, close = parts(r"\s+/\s+"), parts("/")
    one = F.size(F.array_distinct(F.transform(close, lambda x: F.regexp_replace(F.lower(x), r"\s+", "")))) == 1
    named = F.when((F.size(spaced) == 1) & (F.size(close) > 1) & one, F.concat(spaced, close)).otherwise(spaced)
    named = F.when(F.size(named) == 0, F.array(c)).otherwise(named)
    bare = F.filter(F.transform(named, lambda x: F.trim(F.regexp_replace(x, r"\s+\d+$", ""))), lambda x: x != "")
    every = F.array_distinct(F.concat(named, bare))
    if aliases is None:
        return every
    more = F.flatten(F.transform(every, lambda x: F.coalesce(F.try_element_at(aliases, match_name(x)), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(every, more))


def school_key(c: Column) -> Column:
    """'Evocation (b, a) [Fire and cold]' as 'evocation|a,b|cold,fire': case, order and spelling of the lists don't count; a text of another form gives its words."""
    whole = r"^([^\[(]+?)(?:\s*\(([^)]*)\))?(?:\s*\[([^\]]*)\])?$"
    t = squeeze(c)
    words = lambda x: F.array_join(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0), " ")
    listed = lambda g: F.array_join(F.array_sort(F.filter(F.transform(F.split(F.regexp_extract(t, whole, g), r"(?i)\s*(?:,|\band\b)\s*"), words), lambda x: x != "")), ",")
    return F.when(t.rlike(whole), F.concat_ws("|", words(F.regexp_extract(t, whole, 1)), listed(2), listed(3))).otherwise(words(t))


# Short forms of the owners in level lines.
OWNER_ALIASES = {"brd": "Bard", "clr": "Cleric", "drd": "Druid", "pal": "Paladin", "rgr": "Ranger", "sor/wiz": "Sorcerer/Wizard", "wiz": "Wizard"}


def level_entries(c: Column) -> Column:
    """Array of struct(owner, level, domain) of a line such as 'Clr 3, Fire 4'; an owner without a short form is a domain."""
    names = F.create_map(*[F.lit(x) for k, v in OWNER_ALIASES.items() for x in (k, v)])
    good = F.filter(F.transform(F.split(c, r",\s*"), lambda x: F.trim(x)), lambda x: x.rlike(r"^.*?\s+\d+$"))
    raw = lambda x: F.regexp_extract(x, r"^(.*?)\s+\d+$", 1)
    return F.transform(good, lambda x: F.struct(F.coalesce(F.try_element_at(names, F.lower(raw(x))), raw(x)).alias("owner"), F.regexp_extract(x, r"(\d+)$", 1).cast("int").alias("level"), F.try_element_at(names, F.lower(raw(x))).isNull().alias("domain")))


def owner_key(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(c), F.lit("sorcerer/wizard"), F.lit("sor/wiz")), "[^a-z/]", "")


def level_key(c: Column) -> Column:
    """A level line in one form: owners in letters only, sorted."""
    return F.array_join(F.array_sort(F.transform(level_entries(c), lambda e: F.concat_ws(" ", owner_key(e["owner"]), e["level"].cast("string")))), ",")


def component_key(flags: dict[str, Column], extra: Column) -> Column:
    """V, S, M, F, DF, XP and the extra text of a spell's component flags, in that order; both foci are F/DF."""
    f = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    focus = F.when(f["arcane_focus"] & f["divine_focus"], "F/DF").when(f["arcane_focus"], "F").when(f["divine_focus"], "DF")
    marks = [F.when(f["verbal"], "V"), F.when(f["somatic"], "S"), F.when(f["material"], "M"), focus, F.when(f["xp"], "XP"), F.nullif(F.trim(extra), F.lit(""))]
    return F.concat_ws(", ", *marks)


def tolerant_json(c: Column, schema: str) -> Column:
    """JSON read as schema; null where the text isn't JSON of that kind."""
    return F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))


def iso_time(c: Column) -> Column:
    """A timestamp as 2021-03-01T10:00:00.000Z; null stays null."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_date(c: Column) -> Column:
    """2021-03-01 from '2021-3-1', 'March 1, 2021' and the like; a year or a year and month alone are kept as such; null for other texts."""
    t = F.trim(c)
    pad = lambda g: F.lpad(F.regexp_extract(t, r"^(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?$", g), 2, "0")
    year = F.regexp_extract(t, r"^(\d{4})", 1)
    months = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
    named = r"(?i)^([a-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})$"
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in months]), F.lower(F.substring(F.regexp_extract(t, named, 1), 1, 3)))
    return (
        F.when(t.rlike(r"^\d{4}$"), t)
        .when(t.rlike(r"^\d{4}[-/.]\d{1,2}$"), F.concat_ws("-", year, pad(2)))
        .when(t.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"), F.concat_ws("-", year, pad(2), pad(3)))
        .when(t.rlike(named) & (month > 0), F.concat_ws("-", F.regexp_extract(t, named, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, named, 2), 2, "0")))
    )


def stable_json(columns: dict[str, Column]) -> Column:
    """JSON of the columns with keys in order, nulls included."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def composite_id(*parts: Column) -> Column:
    """Parts joined by ':'; null parts are '-', so that ids of different parts differ."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
