"""Mechanic texts read into struct(category, amount, unit, flags, normalized_text, coverage, issue_code).

The rules are a table: a form that a text may have, what it is then, and whether the form covers the whole text. One
evaluator reads it for all mechanics: the first form that fits counts. A text covered whole is complete and gets its
normalized text by rewriting (numbers agree with their nouns, short forms are written out); one of which a form tells
the kind only is partial, a blank one empty, and any other goes to review with an issue code. Null counts as blank.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ["casting_time", "range", "target", "effect", "area", "duration", "saving_throw", "spell_resistance"]


class Rule(NamedTuple):
    """form: a pattern found in the lower-case text. category and unit may name its groups ($1); amount is a group, and # stands for the first number that a word follows, or that word."""

    form: str
    category: str
    amount: str | None = None
    unit: str | None = None
    whole: bool = False


# Wordings of the rules texts, in the order in which they count, with their categories.
_ACTIONS = ["immediate", "swift", "free", "standard", "full-round"]
_TIMES = ["round", "minute", "hour"]
_REACH = {"personal": "", "touch": "", "close": "25 ft. + 5 ft./2 levels", "medium": "100 ft. + 10 ft./level", "long": "400 ft. + 40 ft./level", "unlimited": ""}
_AIMS = ["creature", "object", "area", "emanation", "burst", "spread", "ray"]
_SAVES = ["fortitude", "reflex", "will"]
_NOTES = r"(?: \((?:harmless|object)(?:, (?:harmless|object))?\))?$"
_FOUND = Rule(r"\d\s*[a-z-]", "timed", "#", "#")

_aims = [Rule(w, w) for w in _AIMS]
RULES: dict[str, list[Rule]] = {
    "casting_time": [
        Rule(rf"^(\d+) ({'|'.join(_ACTIONS)}) actions?$", "$2_action", "$1", "action", True),
        Rule(rf"^(\d+) ({'|'.join(_TIMES)})s?$", "$2", "$1", "$2", True),
        *[Rule(f"{w} action", f"{w}_action", "#", "action") for w in _ACTIONS],
        *[Rule(w, w, "#", w) for w in _TIMES],
    ],
    "range": [
        *[r for w, reach in _REACH.items() for r in (Rule(rf"^{w}(?: \({re.escape(reach)}\))?$" if reach else f"^{w}$", w, whole=True), Rule(f"^{w}", w))],
        Rule(r"^(\d+) (?:ft\.?|foot|feet)$", "fixed", "$1", "ft", True),
        Rule(r"^(\d+) miles?$", "fixed", "$1", "mile", True),
        Rule(r"^\d", "fixed", "#", "#"),
    ],
    "target": _aims,
    "effect": _aims,
    "area": _aims,
    "duration": [
        Rule(r"^(instantaneous|permanent|concentration)(?: \(d\))?$", "$1", whole=True),
        Rule(rf"^(\d+) ({'|'.join(_TIMES)}|day)s?(?:/level)?(?: \(d\))?$", "timed", "$1", "$2", True),
        *[Rule(w, w) for w in ("instantaneous", "permanent", "concentration")],
        _FOUND,
    ],
    "saving_throw": [Rule("^(?:none|no)$", "none", whole=True), Rule(rf"^({'|'.join(_SAVES)})(?: (?:negates|partial|half))?{_NOTES}", "$1", whole=True), *[Rule(w, w) for w in _SAVES], Rule("^no ", "none")],
    "spell_resistance": [Rule(f"^(yes|no){_NOTES}", "$1", whole=True), Rule("^yes", "yes"), Rule("^no", "no")],
}
# What blank texts and texts of no known form are.
_BLANK = {"saving_throw": "none"}
_OTHER = dict.fromkeys(("target", "effect", "area"), ("text", "target_effect_area.review"))
# Flags by the words that set them.
FLAGS: dict[str, dict[str, str]] = {
    "duration": {"concentration": "concentration", "discharge": "discharge", "dismissible": r"\(d\)|dismissible", "per_level": rf"^\d+ (?:{'|'.join(_TIMES)}|day)s?/level(?: \(d\))?$"},
    "saving_throw": {"allows_save": "^(?!none$|no$|$)"} | {w: w for w in (*_SAVES, "partial", "negates", "half", "harmless", "object")},
    "spell_resistance": {"harmless": "harmless", "object": "object"},
}
#: How a text that is covered whole is rewritten.
_AGREE = [(r"^0+(?=\d)", ""), (r"^1 ([a-z -]+?)s?(?=$|/| \()", "1 $1"), (r"^(?!1 )(\d+ [a-z -]+?)s?(?=$|/| \()", "$1s")]
_REWRITE: dict[str, list[tuple[str, str]]] = {
    "casting_time": _AGREE,
    "range": [(f"^{w}$", f"{w} ({reach})") for w, reach in _REACH.items() if reach] + [(r"(?<=\d) (?:ft\.?|foot|feet)$", " ft."), *_AGREE],
    "duration": [*_AGREE, (r"\(d\)$", "(D)")],
    "saving_throw": [("^no$", "none")],
}


def _fill(template: str | None, t: Column, form: str) -> Column:
    """A template with the groups of a form put in; blanks and hyphens of categories become underscores."""
    if template is None:
        return F.lit(None).cast("string")
    parts = re.split(r"(\$\d)", template)
    return F.concat(*[F.regexp_extract(t, form, int(p[1])) if p.startswith("$") else F.lit(p) for p in parts if p])


def _read(kind: str, c: Column) -> Column:
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    number = lambda g: F.nullif(F.regexp_extract(t, r"(\d+)\s*([a-z-]+)", g), F.lit(""))
    text = t
    for old, new in _REWRITE.get(kind, []):
        text = F.regexp_replace(text, old, new)
    text = F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))
    flags = F.array_join(F.array_compact(F.array(*[F.when(t.rlike(p), name) for name, p in sorted(FLAGS.get(kind, {}).items())])), ",") if kind in FLAGS else F.lit("")

    def told(category: Column, amount: Column, unit: Column, normalized: Column, coverage: str, issue: str | None) -> Column:
        values = {"category": category, "amount": amount.cast("int"), "unit": unit, "flags": flags, "normalized_text": normalized, "coverage": F.lit(coverage), "issue_code": F.lit(issue).cast("string")}
        return F.struct(*[v.alias(n) for n, v in values.items()])

    none = F.lit(None).cast("string")
    found = [F.when(t == "", told(F.lit(_BLANK.get(kind, "empty")), none, none, none, "empty", None))]
    for r in RULES[kind]:
        category = F.translate(_fill(r.category, t, r.form), "- ", "__")
        amount = number(1) if r.amount == "#" else _fill(r.amount, t, r.form)
        unit = number(2) if r.unit == "#" else _fill(r.unit, t, r.form)
        found.append(F.when(t.rlike(r.form), told(category, amount, unit, text if r.whole else none, "complete" if r.whole else "partial", None)))
    category, issue = _OTHER.get(kind, ("special", f"{kind}.review"))
    return F.coalesce(*found, told(F.lit(category), none, none, none, "review", issue))


READERS = {kind: (lambda c, kind=kind: _read(kind, c)) for kind in TYPES}


def display_errors(value: Column) -> Column:
    """Names of the invariants that a mechanic struct breaks: complete has a text and no other coverage has, review has an issue and no other has."""
    broken = []
    for coverage, field, name in (("complete", "normalized_text", "text"), ("review", "issue_code", "issue")):
        due, there = value["coverage"] == coverage, value[field].isNotNull()
        broken += [F.when(due & ~there, f"{name}-missing"), F.when(~due & there, f"{name}-unexpected")]
    return F.array_compact(F.array(*broken))
