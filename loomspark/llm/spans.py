"""Long exact spans shared between documents (problem 10), by prefix-partitioned sparse suffix trees.

Two texts that share a span of MIN_SPAN characters share every anchor in it: the places whose 32 characters have the
smallest hash among WINDOW neighbours. So only suffixes at anchors are kept, and one of those in the first WINDOW
characters of a shared span has at least MIN_SPAN - WINDOW + 1 shared characters to its right. Suffixes are split by
that prefix, and groups of more than TREE_LEAVES different suffixes by longer ones, until every group fits into a
task's memory. A group's suffix tree is built from its sorted suffixes and their common prefixes; at an internal node
r characters deep, leaves of different children share exactly r characters to the right, so those that also agree in
the MIN_SPAN - r characters to the left of their anchors share a span. Nothing is lost, and leaves are never compared
in pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.session import materialize

MIN_SPAN = 320
WINDOW = 128
#: Characters right of an anchor that every shared span has: the shortest prefix that names a group.
PREFIX = MIN_SPAN - WINDOW + 1
GRAM = 32
_CHUNK = 1 << 18
#: Leaves of a tree, which one task holds; larger groups are split by longer prefixes.
TREE_LEAVES = 4096


def _gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the GRAM characters from each place on."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64((0xBF58476D1CE4E5B9 * (2 * step + 1)) & (2**64 - 1)) + (h[step:] ^ (h[step:] >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        step *= 2
    return h * np.uint64(0x94D049BB133111EB)


def anchors(text: str) -> np.ndarray:
    """Places whose gram has the smallest hash, the leftmost on ties, of some WINDOW consecutive places."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n_grams = len(codes) - GRAM + 1
    if n_grams < WINDOW:
        return np.empty(0, np.int64)
    found = []
    for a in range(0, n_grams - WINDOW + 1, _CHUNK):  # windows that start in [a, a + _CHUNK)
        h = _gram_hashes(codes[a : a + _CHUNK + WINDOW - 1 + GRAM - 1])
        key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        low, step = key, 1
        while step * 2 <= WINDOW:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        found.append(np.unique(low & np.uint64((1 << 20) - 1)).astype(np.int64) + a)
    return np.unique(np.concatenate(found))


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys, docs, places, gaps = [], [], [], []
        for d, text in zip(b["doc_id"], b["text"]):
            before = -1
            for p in anchors(text).tolist():
                if p + PREFIX <= len(text):
                    keys.append(xxhash.xxh3_128_digest(text[p : p + PREFIX].encode("utf-8", "surrogatepass")))
                    docs.append(d)
                    places.append(p)
                    gaps.append(p - before if before >= 0 else -1)
                before = p
        yield pd.DataFrame({"key": keys, "doc_id": docs, "place": places, "gap": gaps})


def _surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands left of a document's anchors and right of their prefixes, as far as it may count."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for d, t, anchored in zip(b["doc_id"], b["text"], b["anchors"]):
                for x in anchored:
                    p, g = x["place"], x["gap"]
                    left, right = t[max(0, p - WINDOW + 1) : p], t[p + PREFIX : p + MIN_SPAN]
                    yield bytes(x["key"]), d, p, g, left, right, xxhash.xxh3_128_digest(f"{left}\0{g}\0{right}".encode("utf-8", "surrogatepass"))

    found = rows()
    while part := list(itertools.islice(found, 20_000)):
        yield pd.DataFrame(part, columns=["key", "doc_id", "place", "gap", "left", "right", "leaf"])


def _matrix(strings: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(strings), width), fill, np.int64)
    for i, s in enumerate(strings):
        if s:
            out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a with row b."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def common_length(a: str, b: str) -> int:
    """Length of the common prefix of two strings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _node(depth: int, lefts: np.ndarray, gaps: np.ndarray, only: np.ndarray) -> tuple[np.ndarray, bool] | None:
    """(shared characters to the left of each leaf, whether the span is told here first) of leaves in the order of their left sides that share a span at a node; None where they are of one document."""
    beside = _common(lefts[1:], lefts[:-1])
    reach = np.zeros(len(lefts), np.int64)
    for order in (range(len(lefts)), range(len(lefts) - 1, -1, -1)):  # nearest leaf of another document on either side
        last: list[tuple[int, int]] = []  # (document, common part) of the nearest leaf, and of the nearest of another document
        for k, i in enumerate(order):
            if k:
                c = int(beside[min(i, prev)])
                last = [(d, min(c, n)) for d, n in last]
            reach[i] = max([reach[i], *(n for d, n in last if d < 0 or d != only[i])])
            last = [(int(only[i]), WINDOW), *(x for x in last if x[0] < 0 or x[0] != only[i])][:2]
            prev = i
    if not (only < 0).any() and (only == only[0]).all():
        return None
    common = int(beside.min())
    return reach, not ((gaps == gaps[0]).all() and 0 <= gaps[0] <= common)


def tree_spans(rows: list[tuple[str, str, int, int]]) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(class, child, leaf, l, r, first) of the spans that leaves share, from the suffix tree of one group.

    rows: (left, right, gap, document or -1 for several) of each leaf, sorted by right. Leaves of one class in different
    children share r characters from the anchor and MIN_SPAN in all; l is the most that a leaf shares to the left with a
    leaf of another document.
    """
    n = len(rows)
    own = -2 - np.arange(n)[:, None]  # padding never equals padding
    right, left = (np.where((m := _matrix(x, WINDOW - 1, -1)) == -1, own, m) for x in ([r[1] for r in rows], [r[0][::-1] for r in rows]))
    gaps, only = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    lcp = np.concatenate([[-1], _common(right[1:], right[:-1])])
    by_left = np.lexsort(left.T[::-1])
    left_lcp = np.concatenate([[-1], _common(left[by_left][1:], left[by_left][:-1])])
    place = np.empty(n, np.int64)
    place[by_left] = np.arange(n)
    alike: dict[int, np.ndarray] = {}
    n_class = 0
    for depth, a, b in intervals(lcp.tolist()):
        need = WINDOW - 1 - depth
        if need not in alike:
            alike[need] = np.cumsum(left_lcp < need)[place]
        members = np.arange(a, b + 1)
        child = np.cumsum(np.concatenate([[0], lcp[a + 1 : b + 1] == depth]))
        order = np.lexsort((place[members], alike[need][members]))
        kind = alike[need][members][order]
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        sorted_child = child[order]
        several = np.minimum.reduceat(sorted_child, starts) != np.maximum.reduceat(sorted_child, starts)
        ends = np.append(starts[1:], len(order))
        for s, e in zip(starts[several].tolist(), ends[several].tolist()):
            who = members[order[s:e]]
            told = _node(depth, left[who], gaps[who], only[who])
            if told is not None:
                for k, i in enumerate(who.tolist()):
                    yield n_class, int(sorted_child[s + k]), i, int(told[0][k]), PREFIX + depth, told[1]
                n_class += 1


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of the internal nodes of the suffix tree whose sorted leaves have these common prefixes with the leaf before."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        h, start = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > h:
            depth, start = stack.pop()
            yield depth, start, i - 1
        if h >= 0 and (not stack or stack[-1][0] < h):
            stack.append((h, start))


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Classes of each group; groups come one after another, each with its leaves sorted by what stands to their right."""

    def groups() -> Iterator[tuple[bytes, list[tuple]]]:
        name, rows = None, []
        for b in batches:
            for gid, *leaf in b[["gid", "key", "leaf", "left", "right", "gap", "only"]].itertuples(index=False, name=None):
                if gid != name:
                    if len(rows) > 1:
                        yield name, rows
                    name, rows = gid, []
                rows.append(tuple(leaf))
        if len(rows) > 1:
            yield name, rows

    def found() -> Iterator[tuple]:
        for gid, rows in groups():
            for c, child, i, n, r, first in tree_spans([x[2:] for x in rows]):
                yield gid, c, str(child), rows[i][0], rows[i][1], n, r, first

    rows = found()
    while part := list(itertools.islice(rows, 20_000)):
        yield pd.DataFrame(part, columns=["gid", "class_no", "child", "key", "leaf", "l", "r", "first"])


_SPAN_SCHEMA = "gid binary, class_no long, child string, key binary, leaf binary, l int, r int, first boolean"


def copy_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, copies: documents with exactly the same text share the class of the smallest doc_id.

    Null texts have no class; of rows with the same doc_id the one with the smallest text digest counts. Texts are
    told apart by their SHA-256, and a class of any size is one row per task before it is shuffled.
    """
    docs = documents.where("text is not null and doc_id is not null").select("doc_id", F.sha2("text", 256).alias("_h")).groupBy("doc_id").agg(F.min("_h").alias("_h"))
    classes = docs.groupBy("_h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return docs.join(classes, "_h").select("doc_id", "class_id", "copies")


def representatives(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, text of the first document of each class."""
    first = classes.where("doc_id = class_id").select("doc_id")
    return documents.where("text is not null").select("doc_id", "text").join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))


def _split_large(leaves: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(groups, whole): leaves in groups (gid) of at most TREE_LEAVES, and leaves of groups that are one class by themselves (gid, r).

    A group stands for the pairs whose common right part has lo to hi - 1 characters. A large one is split in two: pairs
    with mid or more share a longer prefix, the others the MIN_SPAN - mid + 1 characters to the left. Seven splits at
    most leave groups whose leaves all share MIN_SPAN characters.
    """
    groups = leaves.withColumn("gid", F.col("key")).withColumn("lo", F.lit(PREFIX)).withColumn("hi", F.lit(MIN_SPAN + 1))
    sized = lambda g: g.join(g.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1"), "gid")
    groups = materialize(sized(groups), "groups")
    small, whole = groups.where(F.col("n") <= TREE_LEAVES), None
    large = groups.where(F.col("n") > TREE_LEAVES)
    while not large.isEmpty():
        mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        named = lambda kind, text: F.sha2(F.concat(F.hex("gid"), F.lit(kind), text), 256).cast("binary")
        deep = large.withColumn("mid", mid).where(F.length("right") + PREFIX >= F.col("mid"))
        deep = deep.withColumn("gid", named(">", F.expr("left(right, mid - %d)" % PREFIX))).withColumn("lo", F.col("mid"))
        wide = large.withColumn("mid", mid).where(F.length("left") >= MIN_SPAN + 1 - F.col("mid"))
        wide = wide.withColumn("gid", named("<", F.expr("right(left, %d - mid)" % (MIN_SPAN + 1)))).withColumn("hi", F.col("mid"))
        groups = materialize(sized(deep.unionByName(wide).drop("n", "mid")), "groups")
        done = groups.where((F.col("n") > TREE_LEAVES) & (F.col("hi") - F.col("lo") == 1))
        whole = done if whole is None else whole.unionByName(done)
        small, large = small.unionByName(groups.where(F.col("n") <= TREE_LEAVES)), groups.where((F.col("n") > TREE_LEAVES) & (F.col("hi") - F.col("lo") > 1))
    return small, whole


def shared_leaves(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, spans) of documents with different texts, one row each.

    members: the anchors of shared prefixes (key, leaf, doc_id, place), a leaf being a prefix with its surroundings.
    spans: gid, class_no, child, key, leaf, l, r, first; leaves of one class (gid, class_no) in different children share a
    span of r characters from the anchor and MIN_SPAN in all. first says that no earlier anchor tells of the same span.
    """
    long = documents.where(F.length("text") >= MIN_SPAN).select("doc_id", "text")
    rows = materialize(long.mapInPandas(_anchor_rows, "key binary, doc_id long, place int, gap int"), "anchors")
    several = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b").select("key")
    # a text goes to its task once, whatever the number of its anchors
    anchored = rows.join(several, "key", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("place", "gap", "key")).alias("anchors"))
    placed = long.join(anchored, "doc_id").mapInPandas(_surroundings, "key binary, doc_id long, place int, gap int, left string, right string, leaf binary")
    members = materialize(placed, "leaves")
    leaves = members.groupBy("key", "leaf").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.first("gap").alias("gap"), F.min("doc_id").alias("lo_doc"), F.max("doc_id").alias("hi_doc"))
    leaves = leaves.withColumn("only", F.when(F.col("lo_doc") == F.col("hi_doc"), F.col("lo_doc")))
    small, whole = _split_large(leaves)
    # documents may have any id, so trees see those of one group as numbers from 0
    number = F.when(F.col("only").isNull(), -1).otherwise(F.dense_rank().over(Window.partitionBy("gid").orderBy("only")))
    groups = small.select("gid", "key", "leaf", "left", "right", "gap", number.cast("long").alias("only"))
    spans = groups.repartition("gid").sortWithinPartitions("gid", "right", "leaf").mapInPandas(_trees, _SPAN_SCHEMA)
    if whole is not None:
        apart = whole.groupBy("gid").agg(F.min("lo_doc").alias("a"), F.max("hi_doc").alias("b")).where("a != b").select("gid")
        spans = spans.unionByName(whole.join(apart, "gid", "left_semi").select("gid", F.lit(0).cast("long").alias("class_no"), F.hex("leaf").alias("child"), "key", "leaf", (MIN_SPAN - F.col("lo")).alias("l"), F.col("lo").alias("r"), F.lit(True).alias("first")))
    return members, materialize(spans, "spans")


def _leaf_classes(members: DataFrame) -> DataFrame:
    """Leaves of several documents, which share all there is about the anchor: key, leaf, l, r, first."""
    left, right = F.length("left"), F.length("right") + PREFIX
    of = members.groupBy("key", "leaf").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first(left).alias("l"), F.first(right).alias("r"), F.first("gap").alias("gap"))
    return of.where("lo != hi").where(F.col("l") + F.col("r") >= MIN_SPAN).select("key", "leaf", "l", "r", (~F.col("gap").between(F.lit(0), F.col("l"))).alias("first"))


def class_pairs(representatives: DataFrame) -> DataFrame:
    """class_a, class_b: each pair of different texts, smaller id first, with MIN_SPAN characters in common."""
    members, spans = shared_leaves(representatives)
    of = members.select("key", "leaf", "doc_id").distinct()
    apart = spans.where("first").select("gid", "class_no", "child", "key", "leaf").join(of, ["key", "leaf"]).select("gid", "class_no", "child", "doc_id")
    alike = _leaf_classes(members).where("first").select("key", "leaf").join(of, ["key", "leaf"]).select(F.concat("key", "leaf").alias("gid"), F.lit(-1).cast("long").alias("class_no"), F.col("doc_id").cast("string").alias("child"), "doc_id")
    all_of = materialize(apart.unionByName(alike).distinct(), "sharers")
    a, b = all_of.withColumnsRenamed({"child": "child_a", "doc_id": "x"}), all_of.withColumnsRenamed({"child": "child_b", "doc_id": "y"})
    return a.join(b, ["gid", "class_no"]).where("child_a != child_b and x < y").select(F.col("x").alias("class_a"), F.col("y").alias("class_b")).distinct()


def shared_pairs(documents: DataFrame) -> DataFrame:
    """doc_a, doc_b: each pair of documents, smaller id first, whose texts have MIN_SPAN characters in common.

    Texts are compared as stored, by code points. Null texts and texts below MIN_SPAN share nothing; of rows with the
    same doc_id one counts. Copies are compared once, by their class; document_links tells of large classes without
    writing out their pairs.
    """
    classes = materialize(copy_classes(documents), "classes")
    reps = materialize(representatives(documents, classes), "texts")
    a, b = classes.select(F.col("class_id").alias("class_a"), F.col("doc_id").alias("x")), classes.select(F.col("class_id").alias("class_b"), F.col("doc_id").alias("y"))
    across = class_pairs(reps).join(a, "class_a").join(b, "class_b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    twice = classes.where("copies > 1").join(reps.where(F.length("text") >= MIN_SPAN).select(F.col("doc_id").alias("class_id")), "class_id", "left_semi")
    within = twice.select("class_id", F.col("doc_id").alias("doc_a")).join(twice.select("class_id", F.col("doc_id").alias("doc_b")), "class_id").where("doc_a < doc_b").select("doc_a", "doc_b")
    return across.unionByName(within)


def document_links(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links: each document with its class of copies and the number of documents that share a span with it.

    Pairs are formed between classes only, so a class with a third of all documents costs no more than its rows.
    """
    classes = materialize(copy_classes(documents), "classes")
    reps = materialize(representatives(documents, classes), "texts")
    pairs = class_pairs(reps)
    sizes = classes.where("doc_id = class_id").select("class_id", "copies")
    both = pairs.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(pairs.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))
    links = both.join(sizes.select(F.col("class_id").alias("other"), "copies"), "other").groupBy("class_id").agg(F.sum("copies").alias("_n"))
    long = reps.where(F.length("text") >= MIN_SPAN).select(F.col("doc_id").alias("class_id"), F.lit(1).alias("_long"))
    out = classes.join(links, "class_id", "left").join(long, "class_id", "left")
    n = F.coalesce("_n", F.lit(0)) + F.when(F.col("_long").isNotNull(), F.col("copies") - 1).otherwise(0)
    return out.select("doc_id", "class_id", n.cast("long").alias("n_links"))


def shared_parts(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_share: how much of each document stands in spans shared with others.

    shared_chars counts the characters in the union of the document's shared spans; 0 where there are none.
    """
    classes = materialize(copy_classes(documents), "classes")
    reps = materialize(representatives(documents, classes), "texts")
    members, spans = shared_leaves(reps)
    reach = spans.select("key", "leaf", "l", "r").unionByName(_leaf_classes(members).select("key", "leaf", "l", "r")).groupBy("key", "leaf").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    parts = members.join(reach, ["key", "leaf"]).select("doc_id", (F.col("place") - F.col("l")).alias("a"), (F.col("place") + F.col("r")).alias("b"))
    before = Window.partitionBy("doc_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce(F.max("b").over(before), F.lit(0))))
    covered = parts.distinct().withColumn("new", fresh).groupBy("doc_id").agg(F.sum("new").cast("long").alias("shared_chars"))
    lengths = reps.select(F.col("doc_id").alias("class_id"), F.length("text").cast("long").alias("n_chars")).join(covered.withColumnRenamed("doc_id", "class_id"), "class_id", "left")
    docs = documents.where("doc_id is not null").select("doc_id").distinct().join(classes, "doc_id", "left").join(lengths, "class_id", "left")
    whole = (F.col("copies") > 1) & (F.col("n_chars") >= MIN_SPAN)
    out = docs.select("doc_id", F.coalesce("n_chars", F.lit(0).cast("long")).alias("n_chars"), F.when(whole, F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0).cast("long"))).alias("shared_chars"))
    return out.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))


def _common_sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["l"] = [common_length(x[::-1], y[::-1]) for x, y in zip(b["left_a"], b["left_b"])]
        b["r"] = [PREFIX + common_length(x, y) for x, y in zip(b["right_a"], b["right_b"])]
        yield b[["doc_a", "doc_b", "place_a", "place_b", "l", "r"]]


def maximal_repeats(documents: DataFrame) -> DataFrame:
    """class_a, class_b, start_a, start_b, n_chars: every span of MIN_SPAN characters or more that two different texts share and that can't be made longer on either side.

    Texts stand for their class of exact copies (see copy_classes); starts count from 0. The parts told at the anchors
    along one diagonal are put together, so a span of any length is one row.
    """
    reps = materialize(representatives(documents, materialize(copy_classes(documents), "classes")), "texts")
    members, spans = shared_leaves(reps)
    own = spans.select("gid", "class_no", "child", "key", "leaf")
    pairs = own.withColumnsRenamed({"child": "child_a", "leaf": "leaf_a"}).join(own.drop("key").withColumnsRenamed({"child": "child_b", "leaf": "leaf_b"}), ["gid", "class_no"]).where("child_a < child_b").select("key", "leaf_a", "leaf_b").distinct()
    alike = _leaf_classes(members).select("key", F.col("leaf").alias("leaf_a"), F.col("leaf").alias("leaf_b"))
    side = lambda x: members.select("key", F.col("leaf").alias(f"leaf_{x}"), *(F.col(c).alias(f"{n}_{x}") for c, n in (("doc_id", "doc"), ("place", "place"), ("left", "left"), ("right", "right"))))
    both = pairs.unionByName(alike).join(side("a"), ["key", "leaf_a"]).join(side("b"), ["key", "leaf_b"]).where("doc_a != doc_b")
    swap = {f"{c}_{x}": f"{c}_{y}" for c in ("doc", "place", "left", "right") for x, y in (("a", "b"), ("b", "a"))}
    ordered = both.select(*(F.when(F.col("doc_a") < F.col("doc_b"), F.col(c)).otherwise(F.col(o)).alias(c) for c, o in swap.items())).distinct()
    found = ordered.mapInPandas(_common_sides, "doc_a long, doc_b long, place_a int, place_b int, l int, r int").where(F.col("l") + F.col("r") >= MIN_SPAN)
    at = found.select("doc_a", "doc_b", (F.col("place_a") - F.col("place_b")).alias("apart"), (F.col("place_a") - F.col("l")).alias("a"), (F.col("place_a") + F.col("r")).alias("b"))
    w = Window.partitionBy("doc_a", "doc_b", "apart").orderBy("a", "b")
    islands = at.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")).withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_a", "doc_b", "apart", "no").agg(F.min("a").alias("start_a"), F.max("b").alias("end"))
    return merged.select(F.col("doc_a").alias("class_a"), F.col("doc_b").alias("class_b"), "start_a", (F.col("start_a") - F.col("apart")).alias("start_b"), (F.col("end") - F.col("start_a")).alias("n_chars"))
