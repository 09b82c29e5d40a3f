"""Evaluation passages inside training documents (problem 8), by suffix arrays over shards of the training text.

A shard is a batch of whole documents. Its words become one array of numbers with a separator after each document,
and prefix doubling sorts its suffixes. Every suffix of every test item is then binary-searched in all shards: the
interval of suffixes that start with the same MIN_WORDS words holds every place of the passage, and runs of such
places along one diagonal give the longest verbatim match. Test items are sent to tasks in parts of bounded size.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Characters of test items that are sent to the tasks at once; a larger set is searched part by part.
PART_CHARS = 16_000_000
#: Words of a shard's suffix array; a longer document is a shard of its own.
SHARD_WORDS = 400_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, case folded."""
    return _WORD.findall(text.casefold())


def suffix_order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of ids, with suffixes ordered by at least their first depth numbers; prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    h = 1
    while h < depth:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        steps = np.empty(n, np.int64)
        steps[0] = 0
        np.cumsum(key[order][1:] != key[order][:-1], out=steps[1:])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        h *= 2
        if steps[-1] == n - 1:
            break
    return np.argsort(rank, kind="stable"), rank


def _interval(text: np.ndarray, sa: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last index of the suffixes that start with each row of queries; all rows at once.

    text ends in a separator below every word and is padded by the width of queries.
    """
    width = queries.shape[1]
    ends = []
    for strict in (False, True):
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(sa), np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) // 2
            rows = text[sa[np.minimum(mid, len(sa) - 1)][:, None] + np.arange(width)]
            differ = rows != queries
            at = differ.argmax(1)
            some = differ.any(1)
            r = np.arange(len(queries))
            less = np.where(some, rows[r, at] < queries[r, at], strict)
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        ends.append(lo)
    return ends[0], ends[1]


class TestItems:
    """Words of the test items as numbers from 1, in one array, and where each suffix of at least min_words words starts in it."""

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words = min_words
        parts = [(i, ws) for i, t in items if t and len(ws := words(t)) >= min_words]
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.flat = np.array([number(w, len(self.vocabulary) + 1) for _, ws in parts for w in ws], np.int32)
        lengths = np.array([len(ws) for _, ws in parts], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(parts) else np.empty(0, np.int64)
        counts = lengths - min_words + 1
        self.which = np.repeat(np.arange(len(parts)), counts)
        self.ids = [i for i, _ in parts]
        self.start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) if len(parts) else np.empty(0, np.int64)
        self.at = (begins[self.which] + self.start) if len(parts) else np.empty(0, np.int64)

    def matches(self, doc_ids: list[int], texts: list[list[str]]) -> pd.DataFrame:
        """doc_id, item_id, item_word, match_words of the longest match per document and item of one shard."""
        rows: list[tuple] = []
        if len(self.at):
            get, other, w = self.vocabulary.get, len(self.vocabulary) + 1, self.min_words
            lengths = np.array([len(ws) + 1 for ws in texts])
            # a word in no item matches nothing, so all such words may be one
            ids = np.fromiter((x for ws in texts for x in (*(get(t, other) for t in ws), 0)), np.int64, int(lengths.sum()))
            owner = np.repeat(np.arange(len(texts)), lengths)
            sa, _ = suffix_order(ids, w)
            text = np.concatenate([ids, np.full(w, -1, np.int64)])
            ends = [_interval(text, sa, self.flat[self.at[a : a + _QUERIES, None] + np.arange(w)]) for a in range(0, len(self.at), _QUERIES)]
            first, last = (np.concatenate(x) for x in zip(*ends))
            rows = self._longest(first, last, sa, owner, len(texts))
        return pd.DataFrame([(doc_ids[d], self.ids[i], s, n) for d, i, s, n in rows], columns=["doc_id", "item_id", "item_word", "match_words"])

    def _longest(self, first: np.ndarray, last: np.ndarray, sa: np.ndarray, owner: np.ndarray, n_docs: int) -> list[tuple[int, int, int, int]]:
        """(document, item, item word, words) of the longest match, from the places of every suffix of the items.

        From an item's last suffix to its first, a place that starts the same words as the suffix one word on starts a
        run longer by one. Only two numbers per place and document of the shard are held.
        """
        rows, hits = [], np.flatnonzero(last > first)
        run, best, word = np.zeros(len(sa) + 1, np.int32), np.zeros(n_docs, np.int32), np.zeros(n_docs, np.int32)
        for i, qs in itertools.groupby(hits[::-1].tolist(), key=lambda q: int(self.which[q])):
            seen: list[np.ndarray] = []
            before = np.empty(0, np.int64)
            q_before = -1
            for q in qs:
                places = sa[first[q] : last[q]]
                longer = run[places + 1] + 1 if q_before == q + 1 else np.ones(len(places), np.int32)
                run[before] = 0
                run[places] = longer
                docs = owner[places]
                np.maximum.at(best, docs, longer)
                at = docs[best[docs] == longer]
                word[at] = self.start[q]
                seen.append(np.unique(docs))
                before, q_before = places, q
            run[before] = 0
            for d in np.unique(np.concatenate(seen)).tolist():
                rows.append((d, i, int(word[d]), int(best[d]) + self.min_words - 1))
                best[d] = 0
        return rows


#: Suffixes of items looked up at once.
_QUERIES = 100_000
_HELD: dict = {}


def _item_parts(rows: DataFrame, part_chars: int) -> list[DataFrame]:
    """The items in parts of about part_chars characters; an item longer than that is a part by itself, or shares one with few others."""
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // part_chars))
    if n == 1:
        return [rows]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [rows.where(part == k) for k in range(n)]


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, item_id, item_word, match_words: each document with at least min_words consecutive words of an item.

    match_words is the longest match of that item in the document, item_word where it starts in the item (from 0).
    Null or empty texts match nothing; repeated rows give one row. Documents never move: each task sorts the shards
    of its own split, so the only shuffle is the distinct of what was found. Items above part_chars are searched in
    parts, with the same result.
    """
    rows = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    docs = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    found = None
    for part in _item_parts(rows, part_chars):
        held = documents.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.collect()])
        one = docs.mapInPandas(_searcher(held, min_words), "doc_id long, item_id long, item_word int, match_words int")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("match_words", -F.col("item_word"))).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.col2")).alias("item_word"), F.col("m.match_words").alias("match_words"))


def _searcher(held, min_words: int):
    name = uuid.uuid4().hex

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a worker builds the index of a part of the items once, and keeps the latest
        if name not in _HELD:
            _HELD.clear()
            _HELD[name] = TestItems(held.value, min_words)
        test, ids, texts, n = _HELD[name], [], [], 0
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                ws = words(t)
                if len(ws) < min_words:
                    continue
                ids.append(i)
                texts.append(ws)
                n += len(ws) + 1
                if n >= SHARD_WORDS:
                    yield test.matches(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield test.matches(ids, texts)

    return shards


def remove_leaked(documents: DataFrame, found: DataFrame) -> DataFrame:
    """documents without those in found."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
