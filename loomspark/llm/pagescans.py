"""Text of scanned pages repaired into continuous paragraphs (problem 2) by a noisy channel.

Lines are sorted into running titles, page numbers and text; words broken at line ends are put together. Every
word then has candidate readings: what the page may have said if marks were misread (the confusions below, whose
rates are estimated from the corpus). Words that may be read for one another have the same skeleton, so dictionary and
page words meet by skeleton, and a trie of the dictionary words of a skeleton is walked with each page word: only
readings that are in the dictionary are formed, with any number of misread marks. Readings are weighed by the channel
and by a bigram model of the corpus, and Viterbi picks the best path through the words of each text. Dictionary,
candidates and bigrams are distributed tables; only tables bounded by the alphabet are sent to tasks.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark.session import materialize

# Fixed values: (read, printed) pairs of marks that scans take for each other.
CONFUSIONS = [
    ("c", "e"), ("b", "h"), ("cl", "d"), ("ii", "u"), ("ii", "ll"), ("rn", "m"), ("vv", "w"), ("m", "rn"), ("h", "li"), ("d", "cl"), ("nn", "m"), ("li", "h"), ("w", "vv"), ("u", "ii"),
    ("i", "l"), ("l", "i"), ("e", "c"), ("h", "b"), ("f", "t"), ("t", "f"), ("n", "u"), ("u", "n"), ("ri", "n"), ("tl", "d"),
    ("0", "o"), ("5", "s"), ("1", "l"), ("1", "i"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("4", "a"), ("2", "z"), ("7", "t"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("†", "t"), ("$", "s"), ("@", "a"), ("(", "c"), ("€", "e"), ("¢", "c"), ("£", "f"), ("§", "s"), ("ı", "i"), ("ł", "l"), ("ø", "o"), ("ð", "d"), ("ß", "b"), ("þ", "p"), ("µ", "u"),
    ("ſ", "s"), ("á", "a"), ("à", "a"), ("â", "a"), ("ä", "a"), ("ã", "a"), ("å", "a"), ("é", "e"), ("è", "e"), ("ê", "e"), ("ë", "e"), ("í", "i"), ("ì", "i"), ("î", "i"), ("ï", "i"), ("ó", "o"), ("ò", "o"), ("ô", "o"), ("ö", "o"), ("õ", "o"), ("ú", "u"), ("ù", "u"), ("û", "u"), ("ü", "u"), ("ñ", "n"), ("ç", "c"), ("ý", "y"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬅ", "st"),
    ("l", "1"), ("i", "1"), ("!", "1"), ("|", "1"), ("o", "0"), ("s", "5"), ("g", "9"), ("b", "6"), ("b", "8"), ("z", "2"),
]
_LETTERS = [c for c in CONFUSIONS if not c[1].isdigit()]
_DIGITS = {"l": "1", "i": "1", "!": "1", "|": "1", "ı": "1", "o": "0", "s": "5", "ſ": "5", "g": "9", "b": "6", "z": "2", "ó": "0", "q": "9"}
#: Page words of one skeleton that a task walks at a time through a trie of its own.
TRIE_BLOCK = 4096
#: Bits of a confusion before its rate is known, and of one that the corpus never shows.
_FIRST_BITS, _FLOOR_BITS = 10.0, 16.0
_HYPHENS = "-‐‑¬­"
_SMALL = {"of", "the", "and", "in", "a", "an", "to", "for", "on", "de", "la"}
_NUMBER = re.compile(r"\d+(?:d\d+)?")
_EDGE = re.compile(r"^[\"'(\[“‘«{]+|[.,;:?)\]\"'”’»}]+$")
_PAGE = re.compile(r"^[\s\-–—_~*=.|\[\](){}<>•·]*(?:(?:p|pg|page|P|Pg|Page|PAGE)\b\.?\s*)?[\dlIiOoSs!|]+[\s\-–—_~*=.|\[\](){}<>•·]*$")
_TITLE_NUMBER = re.compile(r"^\s*[\[(]?[\dlIO]+[\])]?(?:\s{2,}|\t|\s*[|·—–]\s*)|(?:\s{2,}|\t|\s*[|·—–]\s*)[\[(]?[\dlIO]+[\])]?\s*$")


def title_key(line: str) -> str | None:
    """The running title of a line shaped like one, folded over misread marks, with ! before it if it is a chapter's; None for other lines."""
    body = _TITLE_NUMBER.sub("", line).strip()
    ws = body.split()
    if not ws or body[-1] in ".,;" or body[-1] in _HYPHENS:
        return None
    letters = re.sub(r"[^A-Za-z]", "", body)
    capital = len(letters) >= 4 and sum(c.isupper() for c in letters) >= 0.7 * len(letters)
    chapter = re.match(r"[A-Za-z0-9]+\s+[\dlIVX]+\s*:", body) is not None
    titled = len(ws) >= 2 and all(w[:1].isupper() or w[:1].isdigit() or w.lower().translate(_FOLD) in _SMALL_FOLDED for w in ws) and sum(w[:1].isupper() for w in ws) >= 2
    numbered = body != line.strip() and ws[0][:1].isupper()
    if not (capital or chapter or titled or numbered):
        return None
    key = re.sub(r"[^a-z]", "", body.lower().translate(_FOLD).replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("ii", "u"))
    return f"{'!' if chapter else ''}{key}"


_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "!": "l", "|": "l", "5": "s", "9": "g", "6": "b", "8": "b", "†": "t", "ſ": "s", "c": "e", "á": "a", "h": "b"})
_SMALL_FOLDED = {w.translate(_FOLD) for w in _SMALL}


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 40_000) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded size, whatever a batch of input gives."""
    while part := list(itertools.islice(rows, size)):
        yield pd.DataFrame(part, columns=columns)


def core(token: str) -> str:
    return _EDGE.sub("", token)


def page_lines(fields: DataFrame) -> DataFrame:
    """case_id, field, line_no, line, page, title of every line that is not blank; title is the folded title of a line shaped like one."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for c, f, t in zip(b["case_id"], b["field"], b["text"]):
                for n, line in enumerate(t.split("\n"), 1):
                    if line.strip():
                        page = bool(_PAGE.match(line)) and any(x.isdigit() for x in line)
                        yield c, f, n, line, page, None if page else title_key(line)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(rows(batches), ["case_id", "field", "line_no", "line", "page", "title"])

    return fields.mapInPandas(cut, "case_id string, field string, line_no int, line string, page boolean, title string")


def furniture(lines: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """case_id, field, line_no, defect: the lines that are running titles (header) or page numbers (page).

    A line shaped like a title is one if it is a chapter line, if the same title runs over several cases, or if it is
    among titles (column name). A line in capitals that occurs once is text.
    """
    lines = materialize(lines.where("page or title is not null").drop("line"), "shaped")
    shaped = lines.where("title is not null")
    bare = F.regexp_replace("title", "^!", "")
    often = shaped.groupBy(bare.alias("bare")).agg(F.count_distinct("case_id").alias("n")).where("n > 1").select("bare")
    if titles is not None:
        key = F.pandas_udf(lambda s: s.map(lambda x: (title_key(x) or "").lstrip("!")), T.StringType())
        often = often.unionByName(titles.where("name is not null").select(key("name").alias("bare"))).distinct()
    sure = shaped.where("title like '!%'").select("case_id", "field", "line_no")
    known = shaped.where("title not like '!%'").withColumn("bare", bare).join(often, "bare", "left_semi").select("case_id", "field", "line_no")
    headers = sure.unionByName(known).withColumn("defect", F.lit("header"))
    return headers.unionByName(lines.where("page").select("case_id", "field", "line_no", F.lit("page").alias("defect")))


def _tokens(text: str, skip: set[int]) -> list[tuple[int, str, bool, bool]]:
    """(line_no, word, broken, start) of the text lines; a word broken at a line end is its two parts with a soft hyphen between."""
    lines = [(n, line) for n, line in enumerate(text.split("\n"), 1) if line.strip() and n not in skip]
    out: list[tuple[int, str, bool, bool]] = []
    start, carry = True, None
    for k, (n, line) in enumerate(lines):
        ws = line.split()
        for j, w in enumerate(ws):
            if carry is not None:
                word, at = carry[0] + "\xad" + w, carry[1]
                broken, carry = True, None
            else:
                word, at, broken = w, n, False
            if j == len(ws) - 1 and k + 1 < len(lines) and len(w) > 1 and w[-1] in _HYPHENS and w[-2].isalnum() | (w[-2] in "!†|"):
                carry = (word[:-1], at)
                break
            c = core(word)
            if c:
                out.append((at, c, broken, start))
            start = word.rstrip("\"')]”’")[-1:] in tuple(".!?") and not re.fullmatch(r"\w!.*", word)
    return out


def page_tokens(fields: DataFrame, skipped: DataFrame) -> DataFrame:
    """case_id, field, pos, line_no, word, key, broken, start, after of every word of text lines; after is the next word, where neither is broken."""
    skip = skipped.groupBy("case_id", "field").agg(F.collect_set("line_no").alias("skip"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for c, f, t, s in zip(b["case_id"], b["field"], b["text"], b["skip"]):
                words = _tokens(t, set() if s is None else set(s))
                after = [None if a[2] or b[2] else b[1].lower() for a, b in itertools.pairwise(words)] + [None]
                for pos, ((n, w, broken, start), x) in enumerate(zip(words, after)):
                    yield c, f, pos, n, w, w.lower(), broken, start, x

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(rows(batches), ["case_id", "field", "pos", "line_no", "word", "key", "broken", "start", "after"])

    return fields.join(skip, ["case_id", "field"], "left").mapInPandas(cut, "case_id string, field string, pos int, line_no int, word string, key string, broken boolean, start boolean, after string")


_STROKES = {**dict.fromkeys("bhilmnru", "I"), **dict.fromkeys("cetf", "E"), "d": "EI", "v": "V", "w": "V"}
_SKELETON = dict(_STROKES)
for _read, _printed in _LETTERS:
    if len(_read) == 1 and (not _read.isalpha() or not _read.isascii()):
        _SKELETON.setdefault(_read, "".join(_STROKES.get(c, c) for c in _printed))
_FROM = {c: [(r, p) for r, p in _LETTERS if r[0] == c] for c in {r[0] for r, _ in _LETTERS}}
#: Marks that no word has.
_ODD = {r for r, _ in _LETTERS if len(r) == 1 and (not r.isalpha() or not r.isascii())}


def skeleton(word: str) -> str:
    """The same for both sides of every confusion, and so for all words that may be read for one another: runs of strokes are one stroke."""
    return re.sub(r"I+", "I", re.sub(r"V+", "V", "".join(_SKELETON.get(c, c) for c in word)))


def spellings(key: str) -> list[str]:
    """A lower-case word as it stands; a broken one without and with a hyphen where it is broken."""
    return [key] if "\xad" not in key else [key.replace("\xad", ""), key.replace("\xad", "-")]


def number_reading(base: str) -> tuple[str, list[str]] | None:
    """The number that a word of digits and marks like digits may have been, with the confusions used."""
    if not (any(c.isdigit() for c in base) and all(c.isdigit() or c in _DIGITS or c == "d" for c in base)):
        return None
    head, *rest = base.split("d") if re.fullmatch(r"[^d]+d[^d]+", base) else [base]
    number = "d".join("".join(_DIGITS.get(c, c) for c in part) for part in [head, *rest])
    return number, [f"{a}>{b}" for a, b in zip(base, number) if a != b]


class Trie:
    """Dictionary words, each with what is known of it."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, known: tuple) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = (word, known)

    def readings(self, base: str) -> dict[str, tuple[tuple, set[tuple[str, ...]]]]:
        """Words that base may have been printed as: what is known of them, and the sets of confusions that lead there.

        Marks that no word has must all be misread; of the other letters any number may be.
        """
        n = len(base)
        at: list[dict[int, tuple[dict, set]]] = [{} for _ in range(n + 1)]
        at[0][id(self.root)] = (self.root, {()})
        for i in range(n):
            for node, used in at[i].values():
                c = base[i]
                if c not in _ODD and c in node:
                    self._reach(at[i + 1], node[c], used)
                for r, p in _FROM.get(c, ()):
                    if base.startswith(r, i):
                        end = node
                        for x in p:
                            end = end.get(x)
                            if end is None:
                                break
                        else:
                            self._reach(at[i + len(r)], end, {tuple(sorted((*u, f"{r}>{p}"))) for u in used})
            at[i] = {}
        return {node[""][0]: (node[""][1], used) for node, used in at[n].values() if "" in node}

    @staticmethod
    def _reach(there: dict, node: dict, used: set) -> None:
        if (held := there.get(id(node))) is None:
            there[id(node)] = (node, set(used))
        else:
            held[1].update(used)


def dictionary_readings(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """obs, broken, n_form, reading, used, cap and what the dictionary knows, from rows in blocks (skeleton, block), in each of which dictionary words come first."""
    name, trie = None, Trie()
    for b in batches:
        for sk, block, is_obs, word, obs, broken, n_form, cap, *known in b[["skeleton", "block", "is_obs", "word", "obs", "broken", "n_form", "cap_form", "n", "n_clean", "n_mid", "n_cap"]].itertuples(index=False, name=None):
            if (sk, block) != name:
                name, trie = (sk, block), Trie()
            if not is_obs:
                trie.add(word, tuple(known))
                continue
            for reading, (held, ways) in trie.readings(word).items():
                for used in ways:
                    if used:
                        yield obs, broken, n_form, reading, list(used), cap, *held


class NameModel:
    """Character trigrams of names, in bits."""

    def __init__(self, counts: dict[str, int]):
        pair: dict[str, int] = {}
        for g, n in counts.items():
            pair[g[:2]] = pair.get(g[:2], 0) + n
        self.counts, self.pair = counts, pair

    def bits(self, name: str) -> float:
        s = f"^^{name}$"
        return sum(self.next(s[i : i + 2], s[i + 2]) for i in range(len(s) - 2))

    def next(self, two: str, c: str) -> float:
        return -math.log2((self.counts.get(two + c, 0) + 0.02) / (self.pair.get(two, 0) + 0.6))

    def best_spelling(self, base: str, rates: dict[str, float]) -> tuple[str, list[str]] | None:
        """The cheapest spelling in letters by channel and trigrams, with the confusions used: Viterbi over the last two letters at each place."""
        at: list[dict[str, tuple[float, str, tuple]]] = [{} for _ in range(len(base) + 1)]
        at[0]["^^"] = (0.0, "", ())
        for i, c in enumerate(base):
            steps = [(1, c, 0.0, ())] if c == "'" or (c.isascii() and c.isalpha()) else []
            steps += [(len(r), p, rates.get(f"{r}>{p}", _FLOOR_BITS), (f"{r}>{p}",)) for r, p in _FROM.get(c, ()) if base.startswith(r, i)]
            for two, (bits, word, used) in at[i].items():
                for length, p, cost, use in steps:
                    last, sum_ = two, bits + cost
                    for x in p:
                        sum_ += self.next(last, x)
                        last = last[1] + x
                    old = at[i + length].get(last)
                    if old is None or sum_ < old[0]:
                        at[i + length][last] = (sum_, word + p, used + use)
            at[i] = {}
        ends = [(bits + self.next(two, "$"), word, used) for two, (bits, word, used) in at[-1].items()]
        return (min(ends)[1], list(min(ends)[2])) if ends else None


def _trigrams(names: DataFrame) -> dict[str, int]:
    """Trigram counts of names (column key, n), restricted to 27 letters so that they are bounded."""
    s = F.concat(F.lit("^^"), F.col("key"), F.lit("$"))
    grams = names.where(F.col("key").rlike("^[a-z']+$")).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: s.substr(i, F.lit(3)))).alias("g"), "n")
    return {r["g"]: r["n"] for r in grams.groupBy("g").agg(F.sum("n").alias("n")).collect()}


def _clean_words(texts: DataFrame) -> DataFrame:
    """key, cap, start, after of the words of clean texts (column text)."""
    bare = lambda w: F.regexp_replace(w, r"^[\"'(\[“‘«{]+|[.,;:!?)\]\"'”’»}]+$", "")
    words = F.filter(F.transform(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), bare), lambda w: w != "")
    listed = texts.select(words.alias("ws"))
    each = F.transform("ws", lambda w, i: F.struct(w.alias("w"), (i == 0).alias("start"), F.lower(F.try_element_at("ws", i + 2)).alias("after")))
    return listed.select(F.explode(each).alias("x")).select(F.lower("x.w").alias("key"), F.col("x.w").rlike("^[A-Z]").alias("cap"), "x.start", "x.after")


_NAME_BITS, _WORD_BITS = 8.0, 34.0
#: Occurrences that a word's own share weighs as much as in the bigram model.
_BACKOFF = 12.0


def repair_words(tokens: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """The words of tokens (of page_tokens) that were broken or misread, with reading, the word as it was printed; clean is text (column text) without defects that the language model may also learn from."""
    tokens = materialize(tokens, "tokens")
    number = lambda c: F.when(F.col(c).rlike(r"^\d+(d\d+)?$"), F.regexp_replace(c, r"\d+", "#")).otherwise(F.col(c))
    whole = tokens.where("not broken").select(number("key").alias("key"), F.col("word").rlike("^[A-Z]").alias("cap"), "start", number("after").alias("after"), F.lit(0).alias("is_clean"))
    if clean is not None:
        whole = whole.unionByName(_clean_words(clean).select(number("key").alias("key"), "cap", "start", number("after").alias("after"), F.lit(1).alias("is_clean")))
    lexicon = materialize(
        whole.groupBy("key").agg(F.count("*").alias("n"), F.sum("is_clean").alias("n_clean"), F.count_if(~F.col("start")).alias("n_mid"), F.count_if(F.col("cap") & ~F.col("start")).alias("n_cap")), "lexicon"
    )
    total = lexicon.agg(F.sum("n")).first()[0] or 1
    names = _trigrams(lexicon.where("n_cap > 0 and n_cap * 2 > n_mid").select("key", "n"))
    forms = materialize(tokens.groupBy("key", "broken").agg(F.count("*").alias("n_form"), F.max(F.col("word").rlike("^[A-Z0-9!|]")).alias("cap_form")), "forms")
    spelt = lambda r: r.replace("'", "").isalpha() and r.isascii()

    def as_seen(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        model = NameModel(names)
        for b in batches:
            for key, broken, n, cap in zip(b["key"], b["broken"], b["n_form"], b["cap_form"]):
                told = {}
                for base in spellings(key):
                    told.setdefault(base, [])
                    if number := number_reading(base):
                        told.setdefault(*number)
                for rank, (r, used) in enumerate(told.items()):
                    yield key, broken, n, min(rank, 1), r, re.sub(r"\d+", "#", r) if _NUMBER.fullmatch(r) else r, used, model.bits(r) if cap and spelt(r) else None

    def in_dictionary(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        model = NameModel(names)
        for obs, broken, n_form, r, used, cap, *known in dictionary_readings(batches):
            yield obs, broken, n_form, 1, r, r, used, model.bits(r) if cap and spelt(r) else None, *(int(x) for x in known)

    seen_schema = "obs string, broken boolean, n_form long, rank int, reading string, look string, used array<string>, name_bits double"
    columns = [c.split()[0] for c in seen_schema.split(", ")]
    lex = lexicon.select(F.col("key").alias("look"), "n", "n_clean", "n_mid", "n_cap")
    own_form = forms.mapInPandas(lambda b: _frames(as_seen(b), columns), seen_schema).join(lex, "look", "left")
    both = _by_skeleton(forms, lexicon).mapInPandas(lambda b: _frames(in_dictionary(b), [*columns, "n", "n_clean", "n_mid", "n_cap"]), f"{seen_schema}, n long, n_clean long, n_mid long, n_cap long")
    # a number is read as such, and a word as seen counts once
    held = materialize(own_form.select(*columns, "n", "n_clean", "n_mid", "n_cap").unionByName(both), "held")
    rates = confusion_bits(held, total)
    bit_map = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(v))]) if rates else F.create_map()
    channel = F.aggregate("used", F.lit(0.0), lambda acc, u: acc + F.coalesce(F.try_element_at(bit_map, u), F.lit(_FLOOR_BITS)))
    unseen_bits = F.least(F.lit(_WORD_BITS), F.coalesce(F.col("name_bits") + _NAME_BITS, F.lit(_WORD_BITS)))

    def as_names(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        model = NameModel(names)
        for b in batches:
            for key, broken, n in zip(b["key"], b["broken"], b["n_form"]):
                best = model.best_spelling(spellings(key)[0], rates)
                if best is not None and best[1] and spelt(best[0]):
                    yield key, broken, n, 1, best[0], best[0], best[1], model.bits(best[0])

    # spellings that the dictionary lacks have no bigrams, so of all of them only the cheapest by channel and own bits can win
    named = forms.where("cap_form").mapInPandas(lambda b: _frames(as_names(b), columns), seen_schema).join(lex.select("look"), "look", "left_anti")
    missing = [F.lit(None).cast("long").alias(c) for c in ("n", "n_clean", "n_mid", "n_cap")]
    weighed = held.unionByName(named.select(*columns, *missing)).withColumn("channel", channel)
    # of the ways to one reading the cheapest counts
    scored = weighed.groupBy("obs", "broken", "reading").agg(F.min_by(F.struct(*[c for c in weighed.columns if c not in ("obs", "broken", "reading")]), F.struct("channel", "rank")).alias("w")).select("obs", "broken", "reading", "w.*")
    scored = materialize(scored, "readings")
    # a form that misreadings of a common word explain is not counted as a word, but for its clean occurrences
    best = scored.where("not broken and size(used) > 0 and n is not null").groupBy("obs").agg(F.max(F.col("n") * F.pow(F.lit(2.0), -F.col("channel"))).alias("expected"))
    explained = lexicon.join(best, lexicon["key"] == best["obs"]).where("expected * 12 > n - n_clean").select(F.col("key").alias("reading"), F.lit(True).alias("is_misread"))
    scored = scored.join(explained, "reading", "left")
    real = F.when(F.col("is_misread"), F.coalesce("n_clean", F.lit(0))).otherwise(F.coalesce("n", F.lit(0))).cast("double")
    scored = scored.withColumn("real", real).withColumn("own", F.when(real > 0, F.least(-F.log2(real / F.lit(float(total))), unseen_bits)).otherwise(unseen_bits))
    # what isn't counted as a word has no bigrams: beside others of its kind only the cheapest can win, and beside a word
    # only if it is cheaper than that word is without bigrams on either side
    lone, bits = F.col("real") == 0, F.col("channel") + F.col("own")
    w = Window.partitionBy("obs", "broken")
    scored = scored.withColumn("cheapest", F.min(F.when(lone, F.struct(bits, "rank", "reading"))).over(w)).withColumn("most", F.min(F.when(~lone, bits + F.log2(F.col("real") / _BACKOFF + 1))).over(w))
    scored = scored.where(~lone | ((F.col("reading") == F.col("cheapest.reading")) & (F.col("most").isNull() | (bits <= F.col("most")))))
    name = F.coalesce(F.col("n_cap") * 2 > F.col("n_mid"), F.col("name_bits").isNotNull())
    options = scored.groupBy("obs", "broken").agg(F.collect_list(F.struct("rank", "reading", "look", "channel", "own", F.col("real").alias("n"), name.alias("name"))).alias("options"))
    # every reading that is counted as a word stays: what the words beside it say may outweigh any difference in its own bits
    # a text's lattice is one string of words, options and their fields, which tasks read word by word
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    packed = F.array_join(F.transform("options", lambda o: F.concat_ws(_FIELD, *[text(o[c]) for c in ("reading", "look", "channel", "own", "n", "name")])), _OPTION)
    options = options.select(F.col("obs").alias("key"), "broken", packed.alias("packed"), (F.size("options") > 1).alias("unsure"))
    word = F.concat_ws(_OPTION, F.concat_ws(_FIELD, text(F.col("pos")), text(F.col("line_no")), "word", text(F.col("broken")), text(F.col("start"))), "packed")
    lattice = tokens.join(options, ["key", "broken"]).select("case_id", "field", "pos", word.alias("w"), "unsure", "broken")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), _WORD)
    texts = lattice.groupBy("case_id", "field").agg(words.alias("words"), F.max("unsure").alias("unsure"))
    texts = materialize(texts, "lattices")
    bigrams = materialize(_bigrams(whole), "bigrams")
    edges = texts.where("unsure").mapInPandas(_edges(_bigram_bits(bigrams)), "case_id string, field string, a string, b string")
    counted = edges.join(bigrams, ["a", "b"]).groupBy("case_id", "field").agg(F.array_join(F.collect_list(F.concat_ws(_FIELD, "a", "b", text(F.col("n")))), _WORD).alias("pairs"))
    ready = texts.join(counted, ["case_id", "field"], "left")
    return ready.mapInPandas(_viterbi, "case_id string, field string, pos int, line_no int, word string, broken boolean, start boolean, reading string")


def _by_skeleton(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Dictionary and page words by skeleton and block, dictionary words first; a skeleton of many page words has several blocks, each with all of its dictionary words."""
    name = F.pandas_udf(lambda s: s.map(skeleton), T.StringType())
    spelt = forms.select(F.col("key").alias("obs"), "broken", "n_form", "cap_form", F.explode(F.when(F.col("broken"), F.array(F.replace("key", F.lit("\xad"), F.lit("")), F.replace("key", F.lit("\xad"), F.lit("-")))).otherwise(F.array("key"))).alias("word"))
    page = spelt.withColumn("skeleton", name("word"))
    words = lexicon.where(~F.col("key").contains("#")).select(name("key").alias("skeleton"), F.col("key").alias("word"), "n", "n_clean", "n_mid", "n_cap")
    blocks = page.groupBy("skeleton").agg(F.ceil(F.count("*") / TRIE_BLOCK).cast("int").alias("blocks"))
    page = page.join(blocks, "skeleton").withColumn("block", F.pmod(F.xxhash64("obs"), F.col("blocks")).cast("int")).withColumn("is_obs", F.lit(1))
    words = words.join(blocks, "skeleton").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("is_obs", F.lit(0))
    both = page.unionByName(words, allowMissingColumns=True).drop("blocks")
    return both.repartition("skeleton", "block").sortWithinPartitions("skeleton", "block", "is_obs")


_WORD, _OPTION, _FIELD = "\x1d", "\x1e", "\x1f"


def _lattice(words: str) -> list[tuple]:
    """(pos, line_no, word, broken, start, options) of a packed text; options are (reading, look, channel, own, n, name)."""
    out = []
    for w in words.split(_WORD):
        head, *options = w.split(_OPTION)
        pos, line, word, broken, start = head.split(_FIELD)
        opts = []
        for o in options:
            r, look, channel, own, n, name = o.split(_FIELD)
            opts.append((r, look, float(channel), float(own), float(n), name == "true"))
        out.append((int(pos), int(line), word, broken == "true", start == "true", opts))
    return out


def confusion_bits(known: DataFrame, total: int) -> dict[str, float]:
    """Bits per confusion, from words that have one well supported reading that needs one confusion; bounded by the list of confusions."""
    rare = known.where("not broken").groupBy("obs").agg(
        F.max(F.when(F.size("used") == 0, F.coalesce("n", F.lit(0)))).alias("own"),
        F.max(F.when(F.size("used") == 1, F.struct("n", "used", "reading", "n_form"))).alias("best"),
    )
    clear = rare.where("best.n > 20 * own and best.n >= 20")
    hits = {r["u"]: r["n"] for r in clear.select(F.col("best.used")[0].alias("u"), F.col("best.n_form").alias("n")).groupBy("u").agg(F.sum("n").alias("n")).collect()}
    if not hits:
        return {f"{r}>{p}": _FIRST_BITS for r, p in CONFUSIONS}
    marks = sorted({p for _, p in CONFUSIONS})
    own = known.where("rank = 0 and not broken")
    sums = own.agg(*(F.sum((F.length("obs") - F.length(F.replace(F.col("obs"), F.lit(m)))) / len(m) * F.col("n_form")).alias(f"m{i}") for i, m in enumerate(marks))).first()
    printed = {m: float(sums[f"m{i}"] or 0) for i, m in enumerate(marks)}
    out = {}
    for r, p in CONFUSIONS:
        n = hits.get(f"{r}>{p}", 0)
        out[f"{r}>{p}"] = min(_FLOOR_BITS, -math.log2((n + 0.05) / (printed[p] + n + 100))) if n else (_FIRST_BITS if p.isdigit() else _FLOOR_BITS)
    return out


def _bigrams(words: DataFrame) -> DataFrame:
    """a, b, n of neighbouring words."""
    return words.where("after is not null").groupBy(F.col("key").alias("a"), F.col("after").alias("b")).agg(F.count("*").alias("n"))


#: Bits of the filter that says which bigrams there may be: it has a fixed size, and where it is full it only keeps nothing out.
_FILTER_BITS = 27


def _bigram_bits(bigrams: DataFrame):
    """The filter, broadcast: a bit for the hash of every bigram."""
    h = F.pmod(F.xxhash64(F.concat("a", F.lit(_FIELD), "b")), F.lit(1 << _FILTER_BITS)) + 1
    rows = bigrams.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    bits = bytearray(1 << (_FILTER_BITS - 3))
    for r in rows:
        at = (r["bucket"] - 1) * len(r["bits"])
        bits[at : at + len(r["bits"])] = r["bits"]
    return bigrams.sparkSession.sparkContext.broadcast(bytes(bits))


def may_be(bits: bytes, a: str, b: str) -> bool:
    h = xxhash.xxh64_intdigest(f"{a}{_FIELD}{b}".encode(), 42) & ((1 << _FILTER_BITS) - 1)
    return bool(bits[h >> 3] >> (h & 7) & 1)


def _edges(held):
    """The bigrams that a text's lattice may ask for: of neighbours that are counted as words, where either is in doubt."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value

        def rows() -> Iterator[tuple]:
            for b in batches:
                for c, f, ws in zip(b["case_id"], b["field"], b["words"]):
                    pairs = {(o[1], p[1]) for x, y in itertools.pairwise(_lattice(ws)) if len(x[5]) > 1 or len(y[5]) > 1 for o in x[5] if o[4] > 0 for p in y[5] if p[4] > 0}
                    yield from ((c, f, *p) for p in pairs if may_be(bits, *p))

        return _frames(rows(), ["case_id", "field", "a", "b"])

    return edges


def best_path(words: list[tuple], counts: dict[str, dict[str, int]]) -> list[tuple]:
    """The option of each word on the cheapest path, in bits of channel and bigrams.

    Without a common bigram a step costs the option's own bits and what its predecessor's frequency says, so the cheapest
    predecessor is the same for all options; steps with a bigram are looked at one by one.
    """
    paths: list[tuple] = [(0.0, None, None)]  # (bits, option, path before)
    for w in words:
        options = w[5]
        if paths[0][1] is None:
            paths = [(o[3] + o[2], o, paths[0]) for o in options]
            continue
        if len(paths) == 1 and len(options) == 1:
            paths = [(paths[0][0] + options[0][2], options[0], paths[0])]
            continue
        any_, before = min(((p[0] + math.log2((p[1][4] + _BACKOFF) / _BACKOFF), p) for p in paths), key=lambda x: x[0])
        best = [(any_ + o[3] + o[2], before) for o in options]
        for p in paths:
            if (after := counts.get(p[1][1])) and p[1][4] > 0:
                for k, o in enumerate(options):
                    # a form that isn't counted as a word isn't counted beside others either
                    if (n := min(after.get(o[1], 0), p[1][4], o[4])) > 0:
                        bits = p[0] - math.log2((n + _BACKOFF * 2.0 ** -o[3]) / (p[1][4] + _BACKOFF)) + o[2]
                        if bits < best[k][0]:
                            best[k] = (bits, p)
        paths = [(bits, o, p) for (bits, p), o in zip(best, options)]
    node, chosen = min(paths, key=lambda x: x[0]), []
    while node[1] is not None:
        chosen.append(node[1])
        node = node[2]
    return chosen[::-1]


def _viterbi(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words that were broken or read otherwise than seen."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for c, f, ws, pairs in zip(b["case_id"], b["field"], b["words"], b["pairs"]):
                words = _lattice(ws)
                counts: dict[str, dict[str, int]] = {}
                for p in pairs.split(_WORD) if pairs else ():
                    x, y, n = p.split(_FIELD)
                    counts.setdefault(x, {})[y] = int(n)
                for w, o in zip(words, best_path(words, counts)):
                    reading = as_printed(w[2], o[0], o[5], w[4])
                    if w[3] or reading != w[2]:
                        yield c, f, w[0], w[1], w[2], w[3], w[4], reading

    return _frames(rows(), ["case_id", "field", "pos", "line_no", "word", "broken", "start", "reading"])


def as_printed(word: str, r: str, name: bool, start: bool) -> str:
    """The reading in the case of the word seen; a misread first letter takes the case of its place."""
    seen = word.replace("\xad", "")
    if r == seen.lower():
        return seen
    if "\xad" in word and r == word.replace("\xad", "-").lower():
        return word.replace("\xad", "-")
    if len(seen) > 1 and sum(c.isupper() for c in seen) > 0.6 * len(seen) and len(seen) > 2:
        return r.upper()
    if seen[:1].isupper():
        return r[:1].upper() + r[1:]
    if not seen[:1].isalpha() and (start or name):
        return r[:1].upper() + r[1:]
    return r


def defects(fields: DataFrame, titles: DataFrame | None = None, clean: DataFrame | None = None) -> DataFrame:
    """case_id, field, line_no, defect, repaired of every defect of the texts (case_id, field, text).

    Null and empty texts have none; repeated rows count once. See furniture for titles and repair_words for clean.
    """
    fields = fields.where("text is not null and text != ''").select("case_id", "field", "text").distinct()
    marked = materialize(furniture(page_lines(fields), titles), "furniture")
    words = repair_words(page_tokens(fields, marked), clean)
    changed = words.where("broken or reading != word").select("case_id", "field", "line_no", F.when(F.col("broken"), "hyphen").otherwise("char").alias("defect"), F.col("reading").alias("repaired"))
    return changed.unionByName(marked.withColumn("repaired", F.lit(""))).distinct()


def paragraphs(fields: DataFrame, titles: DataFrame | None = None, clean: DataFrame | None = None) -> DataFrame:
    """case_id, field, paragraph_no, paragraph: the repaired texts, cut at empty lines, one blank between words."""
    fields = fields.where("text is not null and text != ''").select("case_id", "field", "text").distinct()
    marked = materialize(furniture(page_lines(fields), titles), "furniture")
    words = repair_words(page_tokens(fields, marked), clean)
    fixes = words.where("broken or reading != word").groupBy("case_id", "field").agg(F.collect_list(F.struct("pos", "reading")).alias("fixes"))
    skip = marked.groupBy("case_id", "field").agg(F.collect_set("line_no").alias("skip"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c, f, t, s, x in zip(b["case_id"], b["field"], b["text"], b["skip"], b["fixes"]):
                fix = {} if x is None else {r["pos"]: r["reading"] for r in x}
                for n, p in enumerate(_paragraphs(t, set() if s is None else set(s), fix), 1):
                    rows.append((c, f, n, p))
            yield pd.DataFrame(rows, columns=["case_id", "field", "paragraph_no", "paragraph"])

    return fields.join(skip, ["case_id", "field"], "left").join(fixes, ["case_id", "field"], "left").mapInPandas(build, "case_id string, field string, paragraph_no int, paragraph string")


def _paragraphs(text: str, skip: set[int], fix: dict[int, str]) -> list[str]:
    out, words, pos, carry, blank = [], [], 0, None, False
    kept = [(n, line) for n, line in enumerate(text.split("\n"), 1) if n not in skip]
    last = max((k for k, (_, line) in enumerate(kept) if line.strip()), default=-1)
    for k, (_, line) in enumerate(kept):
        if not line.strip():
            blank = True
            continue
        if blank and carry is None and words and words[-1][-1:] in tuple(".!?:\"')”"):
            out.append(" ".join(words))
            words = []
        blank = False
        ws = line.split()
        for j, w in enumerate(ws):
            if carry is not None:
                w, carry = carry + "\xad" + w, None
            if j == len(ws) - 1 and k < last and len(ws[j]) > 1 and ws[j][-1] in _HYPHENS and (ws[j][-2].isalnum() or ws[j][-2] in "!†|"):
                carry = w[:-1]
                break
            c = core(w)
            if c:
                words.append(w.replace(c, fix[pos], 1) if pos in fix else w)
                pos += 1
            else:
                words.append(w)
    return [*out, " ".join(words)] if words else out
