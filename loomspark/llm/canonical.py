"""Free-entered values mapped to a reference list (problem 7).

A symmetric-delete dictionary of the reference list is sent to the tasks: the first PREFIX letters of every entry's
name under up to MAX_EDITS deletions. A value's own deletions meet it there, so candidates within the bounded edit
distance come from hash lookups (names within k edits have prefixes that are equal after k deletions each); they are
ranked by a weighted Damerau-Levenshtein distance, then by how often the entry occurs. Each distinct value is looked
up once. A long reference list is sent in parts, and the best of the parts' answers counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_EDITS = 2
#: Shortest key that may differ by two edits, and by one; shorter keys must be equal.
TWO_EDITS_FROM, ONE_EDIT_FROM = 7, 5
#: Letters of a name whose deletions the dictionary holds.
PREFIX = 16
#: Entries of the dictionary that a task holds at once: at most 2 names of 137 deletions each, some 300 MB.
PART_ENTRIES = 10_000

# Decorations around a name, and short forms of its little words.
_PREFIX = re.compile(r"^(?:the\s+)?(?:schools?|subschools?|sub-schools?|disciplines?|arts?|traditions?|books?)\s+of\s+(?:the\s+)?|^the\s+")
_SUFFIX = re.compile(r"\s+(?:schools?|subschools?|traditions?|disciplines?|magic|spells?)$")
_PAGE = re.compile(r"[\s,;:(]*\b(?:p|pp|pg|page|pages)\b\.?\s*\d+(?:\s*-\s*\d+)?\)?$")
_PRINTING = re.compile(r"[\s,;]*[(\[]?\s*\d+(?:st|nd|rd|th)\s+(?:printing|edition|ed\.?)\s*[)\]]?$|[\s,;]*[(\[](?:revised|reprint|errata|hardcover|paperback|softcover)[)\]]$")
_VOLUME = re.compile(r"[\s,;:]*[(\[]?\b(?:volume|vol|part|book|bk|pt)\b\.?\s*([ivx]+|\d+)[)\]]?$")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_SHORT = [(re.compile(r"\bo/t\b"), "of the"), (re.compile(r"\bo/\s*"), "of "), (re.compile(r"\bw/\s*"), "with "), (re.compile(r"\s*&\s*"), " and ")]
_ENDS = ("of", "the", "and", "a", "an")


def plain(s: str) -> str:
    """Compatibility form, lower case, no accents, single blanks, underscores and hyphens as blanks."""
    s = unicodedata.normalize("NFKD", s).casefold()
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return " ".join(re.sub(r"[_\-‐-―]+", " ", s).replace("’", "'").split())


def strip_decoration(s: str) -> str:
    """A plain value without page, printing, brackets and words such as 'school of'."""
    last = None
    while last != s:
        last = s
        if len(s) > 1 and (s[0], s[-1]) in {("(", ")"), ("[", "]"), ('"', '"'), ("'", "'"), ("{", "}"), ("<", ">"), ("*", "*"), ("《", "》")}:
            s = s[1:-1].strip()
        s = _PRINTING.sub("", _PAGE.sub("", s)).strip(" ,;:*?!~")
    m = re.fullmatch(r"([^,]+),\s+([^,]+)", s)
    if m and not _VOLUME.search(s):
        s = f"{m[2]} {m[1]}"
    for r, w in _SHORT:
        s = r.sub(w, s)
    return _SUFFIX.sub("", _PREFIX.sub("", s)).strip() or s


def split_number(s: str) -> tuple[str, int | None]:
    """(name, volume number) of a plain value; volumes are told apart by number only, never by edits."""
    if m := _VOLUME.search(s):
        return s[: m.start()].strip(" ,;:"), _ROMAN.get(m[1]) or (int(m[1]) if m[1].isdigit() else None)
    head, _, tail = s.rpartition(" ")
    if head and (tail in _ROMAN or tail.isdigit() and len(tail) < 3):
        return head, _ROMAN.get(tail) or int(tail)
    return s, None


def compact(s: str) -> str:
    """Letters and digits of a plain value."""
    return "".join(re.findall(r"[^\W_]+", s))


def keys(s: str) -> list[str]:
    """A plain value's compact form, with and without little words."""
    bare = "".join(w for w in re.findall(r"[^\W_]+", s) if w not in _ENDS)
    return [compact(s), bare] if bare and bare != compact(s) else [compact(s)]


def deletes(s: str, k: int) -> set[str]:
    """s under up to k deletions."""
    out = level = {s}
    for _ in range(k):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out = out | level
    return out


def budget(n: int) -> int:
    return 0 if n < ONE_EDIT_FROM else 1 if n < TWO_EDITS_FROM else MAX_EDITS


_VOWELS = set("aeiou")


def weighted_distance(a: str, b: str, most: int | None = None) -> tuple[int, float]:
    """(edits, weighted edits) of the full Damerau-Levenshtein distance, in which a swap may have letters dropped from its middle.

    Of the ways with the fewest edits the one of least weight counts. Weights: swap .7, double letter dropped or typed
    twice .6, vowel for vowel .8, else 1; an edit of the first letter costs .3 more. With most, only ways of at most that
    many edits are looked for: a greater distance is told as more than most, by whatever number.
    """
    big = (len(a) + len(b) + 1, 1e9)
    n, m = len(a), len(b)
    band = max(n, m) if most is None else most
    if abs(n - m) > band:
        return big
    d = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(min(n, band) + 1):
        d[i + 1][1] = (i, i + 0.3 * (i > 0))
    for j in range(min(m, band) + 1):
        d[1][j + 1] = (j, j + 0.3 * (j > 0))
    seen: dict[str, int] = {}
    for i in range(1, n + 1):
        row, start = a[i - 1], max(1, i - band)
        col = b.rfind(row, 0, start - 1) + 1
        for j in range(start, min(m, i + band) + 1):
            y, i0, j0 = b[j - 1], seen.get(b[j - 1], 0), col
            first = 0.3 * (i == 1 or j == 1)
            if row == y:
                best, col = d[i][j], j
            else:
                p = d[i][j]
                best = (p[0] + 1, p[1] + (0.8 if row in _VOWELS and y in _VOWELS else 1.0) + first)
            p = d[i][j + 1]
            best = min(best, (p[0] + 1, p[1] + (0.6 if i > 1 and row == a[i - 2] else 1.0) + first))
            p = d[i + 1][j]
            best = min(best, (p[0] + 1, p[1] + (0.6 if j > 1 and y == b[j - 2] else 1.0) + first))
            if i0 and j0:
                p, gap = d[i0][j0], (i - i0 - 1) + (j - j0 - 1)
                best = min(best, (p[0] + 1 + gap, p[1] + 0.7 + gap + 0.3 * (i0 == 1 or j0 == 1)))
            d[i + 1][j + 1] = best
        seen[row] = i
    return d[n + 1][m + 1]


@dataclass(frozen=True)
class Entry:
    id: int
    name: str
    abbr: str | None = None
    other: tuple[str, ...] = ()


class SymmetricDelete:
    """The dictionary of one reference list."""

    def __init__(self, entries: Iterable[Entry], frequency: dict[int, int] | None = None):
        self.entries = sorted(set(entries), key=lambda e: (e.id, e.name))
        self.frequency = frequency or {}
        self.exact: dict[str, set[int]] = {}
        self.short: dict[str, set[int]] = {}
        self.by_delete: dict[str, set[str]] = {}
        self.of_key: dict[str, list[tuple[int, int | None]]] = {}
        #: (small words dropped, number of words, volume number, place of a word, its first letter) to (words, id).
        self.cut: dict[tuple, list[tuple[list[str], int]]] = {}
        for e in self.entries:
            for n in (e.name, *e.other):
                self.exact.setdefault(re.sub(r"\s", "", plain(n)), set()).add(e.id)
            if e.abbr:
                self.short.setdefault(compact(plain(e.abbr)), set()).add(e.id)
            body, number = split_number(strip_decoration(plain(e.name)))
            for key in keys(body):
                self.of_key.setdefault(key, []).append((e.id, number))
            words = re.findall(r"[^\W_]+", body)
            for drop in (False, True):
                ws = [w for w in words if not (drop and w in _ENDS)]
                for k, w in enumerate(ws):
                    self.cut.setdefault((drop, len(ws), number, k, w[0]), []).append((ws, e.id))
        for key in self.of_key:
            for d in deletes(key[:PREFIX], budget(len(key))):
                self.by_delete.setdefault(d, set()).add(key)
        self.longest = max(map(len, self.of_key), default=0)

    def lookup(self, value: str) -> int:
        """The id meant by a value, -1 if none."""
        rank = self.rank(value)
        return -1 if rank is None else rank[3]

    def _one(self, tier: int, weight: float, ids: Iterable[int]) -> tuple[int, float, int, int]:
        return min((tier, round(weight, 9), -self.frequency.get(i, 0), i) for i in ids)

    def rank(self, value: str) -> tuple[int, float, int, int] | None:
        """(how it was found, weighted distance, minus the entry's frequency, id) of the entry meant, None if none is; the smallest of several lists' ranks is that of all of them together."""
        p = plain(value)
        s = strip_decoration(p)
        for tier, x in enumerate((p, s)):
            if ids := self.exact.get(re.sub(r"\s", "", x)):
                return self._one(tier, 0.0, ids)
        if ids := self.short.get(re.sub(r"[\W_]", "", s)):
            return self._one(2, 0.0, ids)
        if ids := self._abbreviated(s):
            return self._one(3, 0.0, ids)
        body, number = split_number(s)
        tier, found = 4, self._near(body, number)
        if not found and number is None and (m := re.search(r"([ivx]{1,3}|\d)$", s)) and len(s) > 8:  # the number run into the name
            tier, found = 5, self._near(s[: m.start()], _ROMAN.get(m[1]) or (int(m[1]) if m[1].isdigit() else None))
        return min((self._one(tier, w, [i]) for w, i in found), default=None)

    def _near(self, body: str, number: int | None) -> list[tuple[float, int]]:
        out = []
        for key in filter(None, keys(body)):
            k = budget(len(key))
            if len(key) > self.longest + k:
                continue
            for cand in set().union(*(self.by_delete.get(d, ()) for d in deletes(key[:PREFIX], k))):
                most = min(k, budget(len(cand)))
                ids = [i for i, n in self.of_key[cand] if n == number] if abs(len(key) - len(cand)) <= most else []
                if ids:
                    edits, w = weighted_distance(key, cand, most)
                    if edits <= most:
                        out += [(w, i) for i in ids]
        return out

    def _abbreviated(self, s: str) -> set[int]:
        """Entries of whose words the value's are beginnings, where those cut short end in a full stop."""
        if "." not in s:
            return set()
        body, number = split_number(s)
        pieces = [(w, dot == ".") for w, dot in re.findall(r"([^\W_]+)(\.?)", body)]
        if not any(dot and len(w) > 1 for w, dot in pieces):
            return set()
        out = set()
        for drop in (False, True):
            ps = [x for x in pieces if not (drop and x[0] in _ENDS)]
            k = next((k for k, (w, dot) in enumerate(ps) if dot), None)
            if k is None:
                continue
            for ws, i in self.cut.get((drop, len(ps), number, k, ps[k][0][0]), ()):
                if all(w.startswith(p) if dot else p == w or budget(len(w)) > 0 and weighted_distance(p, w, 1)[0] <= 1 for w, (p, dot) in zip(ws, ps)):
                    out.add(i)
        return out


def entry_parts(reference: DataFrame) -> list[DataFrame]:
    """The entries of a reference list (id, name, abbr, name_zh) in parts of about PART_ENTRIES."""
    rows = reference.where("id is not null and name is not null").select("id", "name", "abbr", "name_zh").distinct()
    n = max(1, -(-rows.count() // PART_ENTRIES))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("id", "name"), F.lit(n)) == k) for k in range(n)]


def map_values(values: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """values with entry_id INT: the id of the reference entry meant by column, -1 where none is; rows with a null or blank value are left out.

    Distinct values are looked up and joined back, so a frequent value costs one lookup; its rows may be split by
    adaptive skew joins. Reference frequencies (one row per entry) are counted first from the values that equal an
    entry. Ties go to the more frequent entry, then the smaller id. An empty reference gives -1.
    """
    spark = values.sparkSession
    present = values.where(F.col(column).isNotNull() & (F.regexp_replace(column, r"[\s\p{Z}]", "") != ""))
    counted = present.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    told = None
    for part in entry_parts(reference):
        entries = [Entry(r["id"], r["name"], r["abbr"], (r["name_zh"],) if r["name_zh"] else ()) for r in part.collect()]
        names = {re.sub(r"\s", "", plain(e.name)).replace("-", ""): e.id for e in entries}
        seen = counted.groupBy(F.lower(F.regexp_replace("_value", r"[\s\-_]", "")).alias("k")).agg(F.sum("_n").alias("n"))
        wanted = spark.createDataFrame([(k,) for k in names] or [("",)], "k string")
        held = spark.sparkContext.broadcast((entries, {names[r["k"]]: r["n"] for r in seen.join(F.broadcast(wanted), "k", "left_semi").collect() if r["k"] in names}))
        one = counted.select("_value").mapInPandas(_ranked(held), "_value string, tier int, weight double, freq long, entry int")
        told = one if told is None else told.unionByName(one)
    best = told.groupBy("_value").agg(F.min(F.struct("tier", "weight", "freq", "entry"))["entry"].alias("entry_id"))
    kept = [F.col(f"`{c}`") for c in values.columns if c != "entry_id"]
    return present.join(best, present[column] == best["_value"], "left").select(*kept, F.coalesce("entry_id" if "entry_id" not in values.columns else best["entry_id"], F.lit(-1)).alias("entry_id"))


def _ranked(held):
    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = SymmetricDelete(*held.value)
        for b in batches:
            rows = [(v, *r) for v in b["_value"] if (r := index.rank(v)) is not None]
            yield pd.DataFrame(rows, columns=["_value", "tier", "weight", "freq", "entry"])

    return ranked


def misses(mapped: DataFrame, column: str) -> DataFrame:
    """Unmatched values with how often they occur."""
    return mapped.where("entry_id = -1").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
