"""Visually identical names brought to one form (problem 6).

After compatibility normalization and deletion of ignorable characters, every character that has look-alikes in
another script opens a column of a lattice. Viterbi picks the path with the best script-consistent character
n-gram score; the n-grams are counted over all names, on characters that have no look-alike in another script. A word
that has letters of one alphabet only, by their shape, is read in that alphabet as far as it goes: Latin letters that
have strayed into a Cyrillic or Greek word are look-alikes there too.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("АВСЕНІЈКМОРЅТХУԚԜҮаԁеһіјорԛѕԝхусѵӏӀԌ", "ABCEHIJKMOPSTXYQWYadehijopqswxycvlIG"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρκυϲϳ", "ABEZHIKMNOPTYXoavipkucj"))
OTHER = dict(zip("ՕօսհոցԼꓐꓚꓓꓰꓖꓧꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓮℓℯℊℴıɩɡɑƖ", "OouhnglBCDEGHJKLMNOPRSTUVWXYAlegoiigaI"))
LOOKALIKES = CYRILLIC | GREEK | OTHER
#: Latin letters and what they may stand for in a word of another alphabet.
_BACK = {script: {latin: c for c, latin in reversed(table.items())} for script, table in (("C", CYRILLIC), ("G", GREEK))}
# Punctuation that compatibility normalization leaves alone.
PUNCTUATION = str.maketrans({**dict.fromkeys("‘’‛ʼʹ′`´ˈ＇", "'"), **dict.fromkeys("“”„‟″〝〞", '"'), **dict.fromkeys("‐‑‒–—―−﹘﹣⁃", "-"), **dict.fromkeys("•‧・･∙⋅●ᐧ⸱", "·"), "。": ".", "、": ",", "⁄": "/", "∕": "/", "：": ":", "‚": ","})
#: Letters and marks without width or ink.
_IGNORABLE = {"͏", "ᅟ", "ᅠ", "឴", "឵", "ㅤ", "ﾠ", "⠀"}


def script_of(c: str) -> str:
    """L Latin, C Cyrillic, G Greek, H Han, O other letters, blank or p for the rest."""
    if not c.isalpha():
        return " " if c == " " else "p"
    if c.isascii():
        return "L"
    name = unicodedata.name(c, "?")
    return {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "CJK": "H"}.get(name.split()[0].split("-")[0], "O")


def fold(s: str) -> str:
    """Compatibility form, decomposed, without ignorable characters, single blanks, ASCII punctuation."""
    s = s.translate(PUNCTUATION)
    out = []
    for c in unicodedata.normalize("NFKD", s).translate(PUNCTUATION):
        if c in _IGNORABLE or unicodedata.category(c) in ("Cf", "Cc") and not c.isspace() or "︀" <= c <= "️":
            continue
        out.append(" " if c.isspace() or unicodedata.category(c).startswith("Z") else c)
    return " ".join("".join(out).split())


def symbol(c: str) -> str:
    """What the n-gram model sees: a Latin letter or mark as itself, any other character as its script."""
    return c if script_of(c) in "L " or c in "'-,·" else script_of(c)


_LATIN_ALIKE = set(LOOKALIKES.values())


def bigrams(s: str) -> list[str]:
    """Bigrams of a folded name, with its marks left out, where neither character is from another alphabet."""
    base = [" ", *(c for c in s if not unicodedata.combining(c)), " "]
    return [symbol(a) + symbol(b) for a, b in zip(base, base[1:]) if a not in LOOKALIKES and b not in LOOKALIKES]


def count_bigrams(names: DataFrame) -> DataFrame:
    """gram, n over all names (column name). Its size is bounded by the squared Latin alphabet, not by the data."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: dict[str, int] = {}
            for s in b["name"]:
                for g in bigrams(fold(s)):
                    n[g] = n.get(g, 0) + 1
            yield pd.DataFrame(list(n.items()), columns=["gram", "n"])

    return names.where("name is not null").select("name").mapInPandas(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Lattice:
    """Viterbi over look-alike lattices under a bigram model. Switching script within a word costs, as does every letter of an alphabet in which no name of the data is written."""

    SWITCH, FOREIGN, FLOOR = 6.0, 2.0, 9.0

    def __init__(self, counts: dict[str, int]):
        first: dict[str, int] = {}
        for g, n in counts.items():
            first[g[0]] = first.get(g[0], 0) + n
        self.cost = {g: -math.log2(n / first[g[0]]) for g, n in counts.items()}
        self.best = lru_cache(200_000)(self._best)

    def _edge(self, a: str, b: str) -> float:
        sa, sb = script_of(a), script_of(b)
        cost = self.cost.get(symbol(a) + symbol(b), self.FLOOR)
        if sa != sb and {sa, sb} <= {"L", "C", "G", "O"}:
            cost += self.SWITCH
        return cost + (self.FOREIGN if sb in "CGO" else 0.0)

    @staticmethod
    def _columns(base: list[str]) -> list[list[str]]:
        """What each character may be: itself or its Latin look-alike, and in a word with letters that only Cyrillic or Greek has, a Latin letter's look-alike there."""
        out: list[list[str]] = [[LOOKALIKES[c], c] if c in LOOKALIKES else [c] for c in base]
        if not any(c in LOOKALIKES or script_of(c) in "CG" for c in base):
            return out
        start = 0
        for i in range(len(base) + 1):
            if i == len(base) or not base[i].isalpha():
                own = {s for c in base[start:i] if c not in LOOKALIKES and (s := script_of(c)) in "CG"}
                for k in range(start, i):
                    out[k] += [_BACK[s][base[k]] for s in sorted(own) if base[k] in _BACK[s]]
                start = i + 1
        return out

    def _best(self, name: str) -> str:
        s = fold(name)
        base, marks = [], []
        for c in s:
            if unicodedata.combining(c) and base:
                marks[-1] += c
            else:
                base.append(c)
                marks.append("")
        columns = self._columns(base)
        if any(len(x) > 1 for x in columns):
            paths = {" ": (0.0, "")}
            for options in columns:
                paths = {o: min((p[0] + self._edge(a, o), p[1] + o) for a, p in paths.items()) for o in options}
            _, path = min((p[0] + self._edge(a, " "), p[1]) for a, p in paths.items())
            base = list(path)
        return unicodedata.normalize("NFC", "".join(c + m for c, m in zip(base, marks)))


def consistent_names(names: DataFrame, changed_only: bool = False) -> DataFrame:
    """names with clean_name, the consistent form of column name; null stays null, a name of invisible characters becomes ''.

    Two passes: the bigram counts (bounded by the alphabet, so they may be sent to every task), then a map over the
    rows without any shuffle, in which each row goes through Python once. changed_only leaves out names that are in the
    consistent form already. Idempotent: a consistent name maps to itself.
    """
    counts = {r["gram"]: r["n"] for r in count_bigrams(names).collect()}

    @F.pandas_udf(T.StringType())
    def clean(s: pd.Series) -> pd.Series:
        global _MODEL
        if _MODEL is None or _MODEL[0] != counts:
            _MODEL = (counts, Lattice(counts))
        best = _MODEL[1].best
        return s.map(lambda x: None if x is None else best(x))

    # marked as if it weren't deterministic, so that filters on its result don't have it computed twice
    out = names.withColumn("clean_name", clean.asNondeterministic()("name"))
    return out.where("clean_name != name") if changed_only else out


_MODEL = None
