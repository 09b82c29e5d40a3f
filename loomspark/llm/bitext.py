"""Sentences of a bilingual document paired up (problem 3) by entropic optimal transport.

A cross-lingual lexicon is learned from the document pairs themselves: how often English and Chinese features occur
in the same pair, in a matrix of fixed size (features are hashed), so it costs the same whatever the corpus size.
It turns an English sentence into a vector over Chinese features, to be compared with the Chinese sentences'. Sinkhorn
scaling then moves the mass of the sentences (their lengths) with a null sentence on either side to take what has
no counterpart, until it converges. Pairs that carry a real part of the smaller sentence's mass belong together, and
each connected group of such pairs is a link: a match, a split or merge, a block of several on both sides, or an
omission on either side. Order plays no part, so moved sentences are found like any other.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import materialize

EN_DIM, ZH_DIM = 2048, 4096
#: Cost of mass that goes to a null sentence, entropy weight, and the least part of the smaller sentence that a link carries.
NULL_COST, EPSILON, LINK_PART = 0.42, 0.03, 0.25
#: Scaling ends when no sentence's mass is off by more than this part of all mass, looked at every CHECK_EVERY rounds; if costs are so far apart that it never is, after MOST_ROUNDS.
TOLERANCE, CHECK_EVERY, MOST_ROUNDS = 1e-4, 10, 5000
#: Cells of the plans that are scaled together.
_TOGETHER = 1 << 16
#: Least similarity of a link as a part of the best its sentences have.
STRAY_PART = 0.25

_EN_END = re.compile(r"[.!?]+(?=\s|$)")
_ZH_END = re.compile(r"[。！？]+")
_EN_WORD = re.compile(r"\d+d\d+|\d+|[A-Za-z][A-Za-z'’\-]*")
_HAN = re.compile(r"[㐀-鿿]+")
_DICE = re.compile(r"\d+d\d+|\d+")
# Chinese digits and places.
_ZH_DIGIT = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2, "〇": 0}
_ZH_PLACE = {"十": 10, "百": 100, "千": 1000}
_ZH_NUMBER = re.compile(r"[零〇一二两三四五六七八九十百千]{2,}|[一二两三四五六七八九十](?=枚|尺|份|步|小时|轮|分钟|点|天|里|磅|级)")
# English number words.
_EN_NUMBER = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}


def _split(text: str, end: re.Pattern) -> list[str]:
    out, at = [], 0
    for m in end.finditer(text):
        if text[at : m.end()].strip():
            out.append(text[at : m.end()].strip())
        at = m.end()
    if text[at:].strip():
        out.append(text[at:].strip())
    return out


def en_sentences(text: str) -> list[str]:
    return _split(text, _EN_END)


def zh_sentences(text: str) -> list[str]:
    return _split(text, _ZH_END)


def zh_number(s: str) -> int:
    total, digit = 0, None
    for c in s:
        if c in _ZH_DIGIT:
            digit = _ZH_DIGIT[c]
        else:
            total += (1 if digit is None else digit) * _ZH_PLACE[c]
            digit = None
    return total + (digit or 0)


def _h(s: str, dim: int) -> int:
    return xxhash.xxh32_intdigest(s) % dim


def en_features(sentence: str) -> tuple[set[int], set[str]]:
    """(hashed words and letter trigrams of names, numbers)."""
    out, numbers = set(), set()
    for k, m in enumerate(_EN_WORD.finditer(sentence)):
        w = m[0]
        if w[0].isdigit():
            numbers.add(w)
            continue
        low = w.lower()
        if low in _EN_NUMBER and _EN_NUMBER[low] > 1:
            numbers.add(str(_EN_NUMBER[low]))
        out.add(_h(low.removesuffix("'s"), EN_DIM))
        if k and w[0].isupper():
            s = f"^{low}$"
            out.update(_h(s[i : i + 3], EN_DIM) for i in range(len(s) - 2))
    return out, numbers


def zh_features(sentence: str) -> tuple[set[int], set[str]]:
    """(hashed character pairs and triples, numbers)."""
    out, numbers = set(), set(_DICE.findall(sentence))
    for m in _ZH_NUMBER.finditer(sentence):
        if (n := zh_number(m[0])) > 1:
            numbers.add(str(n))
    for run in _HAN.findall(sentence):
        for n in (2, 3):
            out.update(_h(run[i : i + n], ZH_DIM) for i in range(len(run) - n + 1))
    return out, numbers


class Document:
    """Sentences and features of a document pair."""

    def __init__(self, en: str, zh: str):
        self.en, self.zh = en_sentences(en), zh_sentences(zh)
        self.x = [en_features(s) for s in self.en]
        self.y = [zh_features(s) for s in self.zh]


class Lexicon:
    """Association of English and Chinese features, their weights, and the usual length of Chinese per English text."""

    def __init__(self, table: np.ndarray, en_idf: np.ndarray, zh_weight: np.ndarray, ratio: float):
        self.table, self.en_idf, self.zh_weight, self.ratio = table, en_idf, zh_weight, ratio
        self.products: np.ndarray | None = None

    @classmethod
    def fit(cls, joint: np.ndarray, en: np.ndarray, zh: np.ndarray, total: float, ratio: float) -> Lexicon:
        """From how many document pairs have both features, each English one and each Chinese one, of total pairs."""
        n1, n2, n = en[:, None].astype(np.float32), zh[None, :].astype(np.float32), np.float32(max(total, 1.0))
        phi = joint.astype(np.float32)
        unsure = phi < 2
        phi *= n
        phi -= n1 * n2
        phi /= np.sqrt(n1 * (n - n1) + 1e-6)
        phi /= np.sqrt(n2 * (n - n2) + 1e-6)
        unsure |= phi * np.sqrt(n) < 4
        phi[unsure] = 0
        phi **= 1.5
        # a Chinese feature explained by several English ones belongs to the strongest
        phi *= phi / np.maximum(phi.max(0, keepdims=True), 1e-9)
        phi /= np.maximum(np.sqrt((phi**2).sum(1, keepdims=True)), 1e-9)
        idf = lambda c: np.where(c > 0, np.log(n / np.maximum(c, 1)) + 0.05, 0)
        return cls(phi.astype(np.float16), idf(en).astype(np.float32), (np.sqrt(idf(zh)) * (phi.max(0) > 0)).astype(np.float32), ratio)

    def similarity(self, d: Document) -> np.ndarray:
        """Cosine of each English sentence, carried over, with each Chinese one; numbers in both add, differing ones subtract.

        Only the columns of the document's own Chinese features are read; lengths come from the products of rows.
        """
        if self.products is None:  # sent in half precision, widened once per worker
            self.table = self.table.astype(np.float32)
            self.products = self.table @ self.table.T
        s = np.zeros((len(d.x), len(d.y)))
        y = [np.fromiter(f, np.int64, len(f)) for f, _ in d.y]
        columns, at = np.unique(np.concatenate(y), return_inverse=True)
        weights = np.zeros((len(columns), len(y)), np.float32)
        k = 0
        for j, f in enumerate(y):
            w = self.zh_weight[f]
            weights[at[k : k + len(f)], j] = w / max(float(np.sqrt((w**2).sum())), 1e-6)
            k += len(f)
        for i, (f, a) in enumerate(d.x):
            f = np.fromiter(f, np.int64, len(f))
            if len(f):
                w = self.en_idf[f]
                length = float(np.sqrt(max(float(w @ self.products[np.ix_(f, f)] @ w), 0.0)))
                s[i] = (w @ self.table[f[:, None], columns]) @ weights / max(length, 1e-6)
            for j, (_, b) in enumerate(d.y):
                if a and b:
                    s[i, j] += 0.25 if a & b else -0.15
        return s


def transport(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Entropic transport plan between masses a and b, each with a null sentence that may take or give all of the other side."""
    return transports([(cost, a, b)])[0]


def transports(problems: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The plans of several problems, those of like size scaled together; each ends by its own convergence."""
    out: list[np.ndarray] = [np.empty(0)] * len(problems)
    order = sorted(range(len(problems)), key=lambda i: problems[i][0].shape)
    while order:
        n, m = (max(problems[order[0]][0].shape[k], 1) + 1 for k in (0, 1))
        some = 1
        while some < len(order):
            x, y = problems[order[some]][0].shape
            if max(n, x + 1) * max(m, y + 1) * (some + 1) > _TOGETHER:
                break
            n, m, some = max(n, x + 1), max(m, y + 1), some + 1
        who, order = order[:some], order[some:]
        k, a, b = np.zeros((some, n, m)), np.zeros((some, n)), np.zeros((some, m))
        for i, w in enumerate(who):
            cost, left, right = problems[w]
            x, y = cost.shape
            k[i, :x, :y], k[i, :x, y], k[i, x, :y], k[i, x, y] = np.exp(-cost / EPSILON), np.exp(-NULL_COST / EPSILON), np.exp(-NULL_COST / EPSILON), 1.0
            a[i, :x], a[i, x], b[i, :y], b[i, y] = left, right.sum(), right, left.sum()
        u, v, live = np.ones((some, n)), np.ones((some, m)), np.arange(some)
        for n_round in range(1, MOST_ROUNDS + 1):
            kk, aa = k[live], a[live]
            uu = aa / np.maximum((kk @ v[live][:, :, None])[:, :, 0], 1e-300)
            vv = b[live] / np.maximum((uu[:, None, :] @ kk)[:, 0, :], 1e-300)
            u[live], v[live] = uu, vv
            if n_round % CHECK_EVERY == 0:
                off = np.abs(uu * (kk @ vv[:, :, None])[:, :, 0] - aa).max(1)
                live = live[off > TOLERANCE * aa.sum(1)]
                if not len(live):
                    break
        for i, w in enumerate(who):
            x, y = problems[w][0].shape
            out[w] = u[i, :x, None] * k[i, :x, :y] * v[i, None, :y]
    return out


def links(documents: list[Document], lexicon: Lexicon) -> list[list[tuple[int, int, float]]]:
    """(English position, Chinese position, part of the smaller sentence carried) of the translations in each document pair."""
    held, problems = [], []
    for k, d in enumerate(documents):
        if d.en and d.zh:
            s = lexicon.similarity(d)
            a, b = np.array([len(t) for t in d.en], float) * lexicon.ratio, np.array([len(t) for t in d.zh], float)
            problems.append((1.0 - s / max(0.4, float(np.quantile(s.max(1), 0.6))), a / b.sum(), b / b.sum()))
            held.append((k, s))
    out: list[list[tuple[int, int, float]]] = [[] for _ in documents]
    for (k, s), (_, a, b), plan in zip(held, problems, transports(problems)):
        part = plan / np.minimum(a[:, None], b[None, :])
        # mass left over by a shortened translation may stray to a pair with the same frame: such a pair is far below its better ones
        alike = s >= STRAY_PART * np.maximum(s.max(1)[:, None], s.max(0)[None, :])
        out[k] = [(i + 1, j + 1, min(1.0, float(part[i, j]))) for i, j in zip(*np.nonzero((part >= LINK_PART) & alike))]
    return out


def groups(pairs: list[tuple[int, int, float]], n_en: int, n_zh: int) -> list[tuple[str, list[int], list[int], list[tuple[int, int]], float]]:
    """(kind, English positions, Chinese positions, pairs, part) of each connected group of pairs and of every sentence in none, in order.

    kind is match (1 to 1), split (1 to several), merge (several to 1), block (several to several), omission (an English
    sentence alone) or addition (a Chinese one). part is the least that a pair of the group carries.
    """
    of: dict[tuple[str, int], int] = {}
    held: dict[int, list[tuple[int, int, float]]] = {}
    fresh = itertools.count()
    for i, j, p in pairs:
        a, b = of.get(("en", i)), of.get(("zh", j))
        at = a if a is not None else b if b is not None else next(fresh)
        held.setdefault(at, []).append((i, j, p))
        if a is not None and b is not None and a != b:
            held[a] += (moved := held.pop(b))
            for x, y, _ in moved:
                of["en", x] = of["zh", y] = a
        of["en", i] = of["zh", j] = at
    out = []
    for members in held.values():
        en, zh = sorted({i for i, _, _ in members}), sorted({j for _, j, _ in members})
        kind = ("match" if len(zh) == 1 else "split") if len(en) == 1 else ("merge" if len(zh) == 1 else "block")
        out.append((kind, en, zh, sorted((i, j) for i, j, _ in members), min(p for _, _, p in members)))
    out += [("omission", [i], [], [], 0.0) for i in range(1, n_en + 1) if ("en", i) not in of]
    out += [("addition", [], [j], [], 0.0) for j in range(1, n_zh + 1) if ("zh", j) not in of]
    return sorted(out, key=lambda g: (g[1] or [n_en + 1], g[2]))


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of a task: for each English feature how often each Chinese one occurs in the same pair, as the numbers that aren't 0.

    The last row has the Chinese features' own counts, then the pairs and the characters of either side.
    """
    joint, en, tail = np.zeros((EN_DIM, ZH_DIM), np.int64), np.zeros(EN_DIM, np.int64), np.zeros(ZH_DIM + 3, np.int64)
    for b in batches:
        for e, z in zip(b["en"], b["zh"]):
            d = Document(e, z)
            x, y = (np.fromiter(fs, np.int64, len(fs)) for fs in (set().union(*(f for f, _ in side)) for side in (d.x, d.y)))
            joint[x[:, None], y] += 1
            en[x] += 1
            tail[y] += 1
            tail[ZH_DIM:] += 1, len(e), len(z)
    if tail[ZH_DIM]:
        rows = [(int(f), int(en[f]), (at := np.flatnonzero(joint[f])).astype(np.int32).tobytes(), joint[f][at].tobytes()) for f in np.flatnonzero(en)]
        at = np.flatnonzero(tail)
        yield pd.DataFrame([*rows, (EN_DIM, 0, at.astype(np.int32).tobytes(), tail[at].tobytes())], columns=["feature", "n", "at", "counts"])


def _sum_rows(g: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(ZH_DIM + 3, np.int64)
    for at, counts in zip(g["at"], g["counts"]):
        total[np.frombuffer(at, np.int32)] += np.frombuffer(counts, np.int64)
    at = np.flatnonzero(total)
    return pd.DataFrame({"feature": [g["feature"].iloc[0]], "n": [int(g["n"].sum())], "at": [at.astype(np.int32).tobytes()], "counts": [total[at].tobytes()]})


def learn(pairs: DataFrame) -> Lexicon:
    """A lexicon from pairs (en, zh). All pairs count, in whole numbers; what is collected is a matrix of EN_DIM by ZH_DIM, at any corpus size."""
    schema = "feature int, n long, at binary, counts binary"
    rows = pairs.select("en", "zh").mapInPandas(_count_rows, schema).groupBy("feature").applyInPandas(_sum_rows, schema).collect()
    joint, en, zh, total, ratio = np.zeros((EN_DIM, ZH_DIM), np.float64), np.zeros(EN_DIM), np.zeros(ZH_DIM), 0.0, 0.3
    for r in rows:
        row = np.zeros(ZH_DIM + 3)
        row[np.frombuffer(bytes(r["at"]), np.int32)] = np.frombuffer(bytes(r["counts"]), np.int64)
        if r["feature"] == EN_DIM:
            zh, total, ratio = row[:ZH_DIM], row[ZH_DIM], row[ZH_DIM + 2] / max(row[ZH_DIM + 1], 1.0)
        else:
            joint[r["feature"]], en[r["feature"]] = row[:ZH_DIM], r["n"]
    return Lexicon.fit(joint, en, zh, total, ratio)


def link_groups(texts: DataFrame) -> DataFrame:
    """text_id, link_no, kind, en_positions, zh_positions, pairs, part: the links of texts (text_id, en, zh), each sentence in one, positions from 1; see groups.

    Rows with a null or blank text give none; repeated rows count once.
    """
    pairs = materialize(texts.where("trim(en) != '' and trim(zh) != ''").select("text_id", "en", "zh").distinct(), "bitext")
    model = pairs.sparkSession.sparkContext.broadcast(learn(pairs))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, documents = [], [Document(e, z) for e, z in zip(b["en"], b["zh"])]
            for t, d, found in zip(b["text_id"], documents, links(documents, model.value)):
                for n, (kind, en, zh, both, part) in enumerate(groups(found, len(d.en), len(d.zh)), 1):
                    rows.append((t, n, kind, en, zh, [{"en_pos": i, "zh_pos": j} for i, j in both], part))
            yield pd.DataFrame(rows, columns=["text_id", "link_no", "kind", "en_positions", "zh_positions", "pairs", "part"])

    return pairs.mapInPandas(link, "text_id string, link_no int, kind string, en_positions array<int>, zh_positions array<int>, pairs array<struct<en_pos:int,zh_pos:int>>, part double")


def aligned(texts: DataFrame) -> DataFrame:
    """text_id, en_pos, zh_pos, kind: the sentence pairs of the links of texts (see link_groups); sentences without counterpart give no row."""
    return link_groups(texts).select("text_id", F.explode("pairs").alias("p"), "kind").select("text_id", "p.en_pos", "p.zh_pos", "kind")
