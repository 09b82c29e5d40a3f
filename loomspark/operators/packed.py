"""Several values packed in one field, split by the cheapest dialect (problem 1).

A dialect says which separators are live in a field and whether quotes protect. Every field is parsed under
its candidate dialects; a parse costs what its values cost under a code learned from all fields (a value seen
in n fields costs -log2 of its share, a new one is spelled in characters), plus what it costs to say of every
separator and quoted stretch that it is live or inert. The cheapest parse wins: minimum description length.
The rates of live and inert marks are learned from the parses chosen with even rates, then used to choose again.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark.session import materialize

# Separator classes, quotes, brackets, words that connect, and placeholders for "nothing".
SEPARATORS = {",": ",，", ";": ";；", "/": "/／", "|": "|｜", "、": "、", "&": "&＆", "+": "+＋", "\n": "\n\r", "\t": "\t"}
WORDS = {"and": r"(?:and|und|et|or)\b", "和": r"(?:和|及|与|以及)(?=\s)"}
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "‘": "’", "「": "」", "『": "』", "«": "»", "`": "`"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "［": "］"}
PLACEHOLDERS = {"", "n/a", "na", "n.a.", "-", "--", "—", "–", "―", "none", "null", "nil", "无", "?", "."}

_SEP_OF = {c: k for k, cs in SEPARATORS.items() for c in cs}
_WORD_RE = {k: re.compile(p, re.I) for k, p in WORDS.items()}
_NA_RE = re.compile(r"n/a(?![^\W_])", re.I)
#: Parses that one frame holds at most; a field of k kinds of separators has up to 2^k of them, with and without quotes.
_FRAME_ROWS = 10_000
_VALUE_BITS, _SPELL_BITS = 2.0, 8.0
#: What a mark costs before its rates are known: a live one, and one read as an ordinary character of a value.
_FIRST_LIVE, _FIRST_INERT = 1.0, 12.0
_MARKS = [*SEPARATORS, *WORDS, "quote"]


def _quote_end(s: str, i: int) -> int:
    """Index after the quoted stretch that opens at s[i], or i if it doesn't close before a separator or the end."""
    close, j = QUOTES[s[i]], i + 1
    while j < len(s):
        if s[j] == "\\" and j + 1 < len(s):
            j += 2
            continue
        if s[j] == close:
            if s[j + 1 : j + 2] == close and close == s[i]:
                j += 2
                continue
            rest = s[j + 1 :]
            if close != s[i] or not rest or rest[0].isspace() or rest[0] in _SEP_OF or rest[0] in "([{（【":
                return j + 1
        j += 1
    return i


def _bracket_end(s: str, i: int) -> int:
    """Index after the bracket that opens at s[i], nesting included, or i if it isn't closed."""
    stack, j = [BRACKETS[s[i]]], i + 1
    while j < len(s):
        if s[j] in BRACKETS:
            stack.append(BRACKETS[s[j]])
        elif s[j] == stack[-1]:
            stack.pop()
            if not stack:
                return j + 1
        j += 1
    return i


def cut_points(s: str, quoting: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, separator class) of every place that may separate values: not in quotes, brackets or numbers."""
    out, i, fresh = [], 0, True
    while i < len(s):
        c = s[i]
        if quoting and fresh and c in QUOTES and (e := _quote_end(s, i)) > i:
            i, fresh = e, False
            continue
        if c in BRACKETS and (e := _bracket_end(s, i)) > i:
            i, fresh = e, False
            continue
        if c in "nN" and fresh and (m := _NA_RE.match(s, i)):
            i, fresh = m.end(), False
            continue
        if (k := _SEP_OF.get(c)) is not None:
            if not (k == "," and s[i - 1 : i].isdigit() and re.match(r"\d{3}(?!\d)", s[i + 1 : i + 5])):
                out.append((i, i + 1, k))
                fresh = True
            i += 1
            continue
        if c.isspace():
            i += 1
            if not fresh:
                for k, r in _WORD_RE.items():
                    if (m := r.match(s, i)) and s[m.end() : m.end() + 1].isspace():
                        out.append((i, m.end(), k))
                        i, fresh = m.end(), True
                        break
            continue
        fresh, i = False, i + 1
    return out


def clean_value(v: str, quoting: bool = True) -> str:
    """Trimmed, without the enclosing quotes, quotes within it once."""
    v = v.strip()
    if quoting and len(v) > 1 and v[0] in QUOTES and _quote_end(v, 0) == len(v):
        close, inner = QUOTES[v[0]], v[1:-1]
        if close == v[0]:
            inner = inner.replace(close * 2, close)
        return re.sub(r"\\(.)", r"\1", inner).strip()
    return v


def parse(s: str, live: frozenset[str] | None = None, quoting: bool = True, cuts: list[tuple[int, int, str]] | None = None) -> list[str]:
    """The values of a field under a dialect; live None: every separator. cuts: its cut points, where they are known."""
    out, at = [], 0
    for a, b, k in cut_points(s, quoting) if cuts is None else cuts:
        if live is None or k in live:
            out.append(s[at:a])
            at = b
    out.append(s[at:])
    values = (clean_value(v, quoting) for v in out)
    return [v for v in values if v.strip().lower() not in PLACEHOLDERS]


def dialects(s: str) -> list[tuple[frozenset[str], bool]]:
    """Candidate dialects of a field: the first has every separator live and quotes protecting.

    All subsets of its kinds of separators are tried, whatever their number (2,048 for all 11 kinds).
    """
    out: list[tuple[frozenset[str], bool]] = []
    for quoting in (True, False) if any(q in s for q in QUOTES) else (True,):
        kinds = sorted({k for _, _, k in cut_points(s, quoting)})
        out += [(frozenset(c), quoting) for n in range(len(kinds), -1, -1) for c in itertools.combinations(kinds, n)]
    return out


def encode(live: frozenset[str], quoting: bool) -> str:
    return ("q" if quoting else "p") + "".join(sorted(live, key=lambda k: (len(k), k)))


def decode(code: str) -> tuple[frozenset[str], bool]:
    rest = code[1:]
    words = {w for w in WORDS if w in rest}
    for w in words:
        rest = rest.replace(w, "")
    return frozenset(rest) | words, code[0] == "q"


def quoted_stretches(s: str) -> int:
    """Values that stand in quotes when quotes protect."""
    ends, n = [-1, *(b - 1 for _, b, _ in cut_points(s)), len(s)], 0
    for a, b in itertools.pairwise(ends):
        v = s[a + 1 : b].strip()
        n += len(v) > 1 and v[0] in QUOTES and _quote_end(v, 0) > 1
    return n


def _field_parses(raw: str) -> Iterator[tuple]:
    seen, options, quoted = set(), dialects(raw), quoted_stretches(raw)
    cuts = {quoting: cut_points(raw, quoting) for quoting in {q for _, q in options}}
    for n, (live, quoting) in enumerate(options):
        values = tuple(parse(raw, live, quoting, cuts[quoting]))
        if values in seen:  # an earlier, simpler dialect gives the same parse
            continue
        seen.add(values)
        on, off = dict.fromkeys(_MARKS, 0), dict.fromkeys(_MARKS, 0)
        for _, _, k in cuts[quoting]:
            (on if k in live else off)[k] += 1
        (on if quoting else off)["quote"] += quoted
        yield raw, encode(live, quoting), n, list(on.values()), list(off.values()), list(values), len(options) > 1


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (row for b in batches for raw in b["raw"] for row in _field_parses(raw))
    while part := list(itertools.islice(rows, _FRAME_ROWS)):
        yield pd.DataFrame(part, columns=["raw", "dialect", "rank", "on", "off", "vals", "contested"])


def _mark_bits(on_bits: list[float], off_bits: list[float]):
    dot = lambda col, ws: sum((F.col(col)[i] * F.lit(w) for i, w in enumerate(ws)), F.lit(0.0))
    return dot("on", on_bits) + dot("off", off_bits)


def _cheapest(scored: DataFrame, on_bits: list[float], off_bits: list[float]) -> DataFrame:
    bits = F.round(F.col("value_bits") + _mark_bits(on_bits, off_bits), 6).alias("bits")
    return scored.groupBy("raw").agg(F.min(F.struct(bits, "rank", "dialect", "on", "off")).alias("m"))


def choose_dialects(fields: DataFrame) -> DataFrame:
    """raw, dialect of every distinct field text of column raw that offers more than one parse.

    The value code is a distributed table joined by value, never collected; only the character code (one row per
    character of Unicode at most) and the rates of marks (one row) are sent to the tasks. Hot values are split by
    adaptive skew joins, as the value table has one row each.
    """
    # distinct texts are dealt out evenly before they are parsed: they are few bytes and much work
    raws = fields.select("raw").where("raw is not null").distinct().repartition(max(fields.sparkSession.sparkContext.defaultParallelism, int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cand = materialize(raws.mapInPandas(_candidates, "raw string, dialect string, rank int, on array<int>, off array<int>, vals array<string>, contested boolean"), "dialects")
    full = cand.where("rank = 0").select("raw", F.explode("vals").alias("v"))
    # a value counts once for each field whose finest parse has it
    code = materialize(full.groupBy("v").agg(F.count("*").alias("m"), F.count_distinct("raw").alias("n")), "values")
    chars = code.select("m", F.explode(F.split("v", "")).alias("c")).groupBy("c").agg(F.sum("m").alias("m"))
    counts = {r["c"]: r["m"] for r in chars.collect()}
    total, n_values = sum(counts.values()), code.agg(F.sum("m")).first()[0] or 1
    bits = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, -math.log2(n / (total + 1)))]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    spell = F.aggregate(F.split("v", ""), F.lit(0.0), lambda acc, c: acc + F.coalesce(F.try_element_at(bits, c), F.lit(math.log2(total + 2)))) + _SPELL_BITS
    # a value that one field alone has is new to the code; every other is joined with its share
    cost = F.when(F.col("n") > 1, F.least(-F.log2(F.col("n") / F.lit(float(n_values + 1))), F.col("spell"))).otherwise(F.col("spell")) + _VALUE_BITS
    contested = cand.where("contested")
    each = contested.select("raw", "rank", F.explode("vals").alias("v"))
    known = code.withColumn("spell", spell).select("v", cost.alias("cost"))
    paid = each.join(known, "v", "left").groupBy("raw", "rank").agg(F.sum(F.coalesce("cost", spell + _VALUE_BITS)).alias("value_bits"))
    # a parse without any value costs nothing for values
    scored = materialize(contested.select("raw", "dialect", "rank", "on", "off").join(paid, ["raw", "rank"], "left").na.fill(0.0, ["value_bits"]), "parses")
    first = _cheapest(scored, [_FIRST_LIVE] * len(_MARKS), [_FIRST_INERT] * len(_MARKS))
    sums = first.agg(*(F.sum(F.col(f"m.{c}")[i]).alias(f"{c}{i}") for c in ("on", "off") for i in range(len(_MARKS)))).first()
    on_bits, off_bits = [], []
    for i in range(len(_MARKS)):
        on, off = (sums[f"on{i}"] or 0) + 1, (sums[f"off{i}"] or 0) + 0.01
        on_bits.append(-math.log2(on / (on + off)))
        off_bits.append(-math.log2(off / (on + off)))
    return _cheapest(scored, on_bits, off_bits).select("raw", F.col("m.dialect").alias("dialect"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parse_udf(raw: pd.Series, dialect: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str | None], list[str]] = {}

    def one(s: str | None, d: str | None) -> list[str]:
        if s is None:
            return []
        if (s, d) not in memo:
            memo[s, d] = parse(s) if d is None else parse(s, *decode(d))
        return memo[s, d]

    return pd.Series([one(s, d) for s, d in zip(raw, dialect)])


def unpack(fields: DataFrame) -> DataFrame:
    """One row per value: the columns of fields without raw, then pos INT from 1 and val STRING.

    fields has a column raw with the packed text; null, blank and placeholder-only texts give no row, and blank
    or placeholder pieces take no position. Other columns pass through, whatever their names but raw, pos and val.
    """
    chosen = choose_dialects(fields)
    # a field with one possible parse needs no lookup, so only fields with separators or quotes go through the join
    plain = ~F.col("raw").rlike("[,，;；/／|｜、&＆+＋\\n\\r\\t\"'“„‘「『«`]|\\s(?i:and|und|et|or|和|及|与|以及)\\s")
    live = fields.where("raw is not null")
    parsed = live.where(plain).withColumn("_vals", _parse_udf("raw", F.lit(None).cast("string")))
    looked = live.where(~plain).join(chosen.withColumnRenamed("dialect", "_dialect"), "raw", "left")
    parsed = parsed.unionByName(looked.withColumn("_vals", _parse_udf("raw", "_dialect")).drop("_dialect"))
    keep = [F.col(f"`{c}`") for c in fields.columns if c != "raw"]
    return parsed.select(*keep, F.posexplode("_vals").alias("pos", "val")).withColumn("pos", (F.col("pos") + 1).cast("int"))
