"""Sources mixed to target shares of tokens (problem 9) by a low-discrepancy schedule.

Each source's documents are shuffled, put end to end and cut into blocks of equal tokens, so a document that crosses an
edge stands in both blocks with its parts. Slot k of the mixture takes the source in whose stretch of the cumulative weights the golden-ratio point frac(k * phi) falls, so every stretch of
the mixture has nearly the target shares. Slots are ranked per source, and the rank names the repeat and the block.
Nothing is sampled or sent to one task: ranks and running token sums are taken within chunks and offset by the
sums of the chunks before.
"""

from __future__ import annotations

import base64
import math
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark.session import materialize

#: Split pattern of the byte-pair vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 2048
#: Rows of a chunk in which a rank or running sum is taken by one task.
CHUNK_ROWS = 65_536
#: The target list is planned on the driver; a longer one is refused.
MAX_SOURCES = 100_000
_GOLDEN = (math.sqrt(5) - 1) / 2

_ENCODINGS: dict = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_count(spark: SparkSession, column: str, vocabulary: str):
    """Tokens of a text column under a public vocabulary file, which the driver reads and sends to every executor; null counts 0."""
    if not os.path.isfile(vocabulary):
        raise ValueError(f"no vocabulary file {vocabulary}")
    spark.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        e = _encoding(SparkFiles.get(name))
        return s.map(lambda t: 0 if t is None else len(e.encode_ordinary(t))).astype("int64")

    return count(F.col(column))


@dataclass(frozen=True)
class SourcePlan:
    """What a source has (tokens, blocks), its share of the mixture (weight, target_share as given) and its cap of repeats."""

    source: str
    target_share: float
    max_repeats: int
    tokens: int
    blocks: int
    weight: float


def plan(rows: list[tuple[str, float, int, int]], block_tokens: int, total_tokens: int | None = None) -> tuple[list[SourcePlan], int]:
    """(plans, slots) from (source, target share, cap, tokens). Sources without tokens, share or repeats leave their share to the others.

    Without total_tokens the mixture is as large as the caps allow with every share met; a larger total is refused. The
    schedule may reach a cap some slots earlier, which mixture sees to.
    """
    live = [r for r in rows if r[3] > 0 and r[1] > 0 and r[2] > 0]
    share = sum(r[1] for r in live)
    if not live:
        return [], 0
    plans = [SourcePlan(s, w, cap, n, math.ceil(n / block_tokens), w / share) for s, w, cap, n in sorted(live)]
    # blocks that a source can give, over its weight
    most = min(math.floor(p.blocks * p.max_repeats / p.weight) for p in plans)
    slots = most if total_tokens is None else round(total_tokens / block_tokens)
    if slots > most:
        raise ValueError(f"{total_tokens} tokens are more than the caps on repeats allow: {most * block_tokens}")
    return plans, slots


def running_offset(df: DataFrame, group: str, chunk: str, order: list[str], value: str | None, name: str) -> DataFrame:
    """df with name: the sum of value (or the number) of the rows before, by group and in the order of (chunk, order).

    Only rows of a chunk meet in a task; the sums of chunks, one row each, give the offsets.
    """
    amount = F.lit(1) if value is None else F.col(value)
    sums = df.groupBy(group, chunk).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, chunk, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(offsets, [group, chunk]).withColumn(name, (F.col("_offset") + F.col("_within")).cast("long")).drop("_within", "_offset")


@lru_cache(100_000)
def _step(n: int, epoch: int) -> int:
    """A step coprime to n, so that i -> i * step + shift visits every block once; another one in each repeat."""
    s = max(1, round(n * ((_GOLDEN * (epoch + 1)) % 1)))
    while math.gcd(s, n) != 1:
        s += 1
    return s


def _source_of(edges: list[float]):
    """The number of the source in whose stretch of the cumulative weights a slot's golden-ratio point falls."""
    at = np.array(edges[:-1])

    @F.pandas_udf(T.IntegerType())
    def number(slot: pd.Series) -> pd.Series:
        point = slot.to_numpy() * _GOLDEN
        return pd.Series(np.searchsorted(at, point - np.floor(point), side="right").astype(np.int32))

    return number(F.col("slot"))


@F.pandas_udf(T.LongType())
def _block_of(rank: pd.Series, n: pd.Series) -> pd.Series:
    """The block that a source's slot of this rank takes."""
    return pd.Series([((r % m) * _step(m, r // m) + r // m) % m for r, m in zip(rank.tolist(), n.tolist())], dtype="int64")


def token_blocks(counted: DataFrame, block_tokens: int, chunks: int) -> DataFrame:
    """doc_id, source, block, first_token, n_tokens: the parts of documents (doc_id, source, n_tokens, h) in each source's blocks of block_tokens, in the order of h; only a source's last block may be shorter."""
    placed = counted.where("n_tokens > 0").withColumn("chunk", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * chunks).cast("int"))
    placed = running_offset(placed, "source", "chunk", ["h", "doc_id"], "n_tokens", "start").withColumn("end", F.col("start") + F.col("n_tokens"))
    of = lambda at: F.floor(at / block_tokens).cast("long")
    parts = placed.withColumn("block", F.explode(F.sequence(of(F.col("start")), of(F.col("end") - 1))))
    lo, hi = F.greatest("start", F.col("block") * block_tokens), F.least("end", (F.col("block") + 1) * block_tokens)
    return parts.select("doc_id", "source", "block", "start", (lo - F.col("start")).alias("first_token"), (hi - lo).alias("n_tokens"))


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows, shares).

    rows: slot, place, doc_id, source, repeat_no, first_token (from 0), n_tokens in mixing order (slot, then place); each
    row is the part of a document that stands in the slot's block. shares: source, target_share, max_repeats, tokens,
    mixed_tokens, actual_share, most_used (the most often that any document is used) of every target, also those without
    documents. Documents without text, source or target are no part of the mixture; of rows with one doc_id the one with
    the smallest source and digest of text counts.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    listed = wanted.limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = spark.createDataFrame([(r["source"],) for r in listed], "source string")
    docs = documents.select("doc_id", "source", "text").where("doc_id is not null and text is not null and text != ''").join(F.broadcast(names), "source", "left_semi")
    # texts are counted where they are and never move
    sized = docs.select("doc_id", F.struct("source", F.xxhash64("text").alias("digest"), token_count(spark, "text", vocabulary).alias("n_tokens")).alias("d"))
    counted = materialize(sized.groupBy("doc_id").agg(F.min("d").alias("d")).select("doc_id", "d.source", "d.n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("h")), "tokens")
    have = {r["source"]: r for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}
    plans, slots = plan([(r["source"], r["target_share"] or 0.0, r["max_repeats"] or 0, have[r["source"]]["n"] if r["source"] in have else 0) for r in listed], block_tokens, total_tokens)
    blocks = token_blocks(counted, block_tokens, max(1, math.ceil(max((r["docs"] for r in have.values()), default=1) / CHUNK_ROWS)))

    # slots to sources, ranks to repeats and blocks
    edges = np.cumsum([p.weight for p in plans]).tolist() or [1.0]
    of_source = spark.createDataFrame([(k, p.source, p.blocks, p.max_repeats) for k, p in enumerate(plans)], "source_no int, source string, n_blocks long, cap long")
    schedule = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK_ROWS).alias("chunk")).withColumn("source_no", _source_of(edges)).join(F.broadcast(of_source), "source_no")
    schedule = running_offset(schedule, "source", "chunk", ["slot"], None, "rank").withColumn("repeat_no", F.floor(F.col("rank") / F.col("n_blocks")).cast("int"))
    # the schedule may ask a source for a block more than its cap gives: the mixture ends before that slot, with none left out
    over = schedule.where(F.col("repeat_no") >= F.col("cap")).agg(F.min("slot")).first()[0]
    if over is not None:
        if total_tokens is not None:
            raise ValueError(f"{total_tokens} tokens are more than the caps on repeats allow: {over * block_tokens}")
        schedule = schedule.where(F.col("slot") < over)
    schedule = schedule.select("slot", "source", "repeat_no", _block_of("rank", "n_blocks").alias("block"))
    place = F.row_number().over(Window.partitionBy("slot").orderBy("start", "doc_id"))
    rows = schedule.join(blocks, ["source", "block"]).select("slot", place.alias("place"), "doc_id", "source", (F.col("repeat_no") + 1).alias("repeat_no"), "first_token", "n_tokens")
    return rows, _shares(rows, wanted, {s: r["n"] for s, r in have.items()})


def _shares(rows: DataFrame, wanted: DataFrame, tokens: dict[str, int]) -> DataFrame:
    used = rows.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count_distinct("repeat_no").alias("times")).groupBy("source").agg(F.sum("n").alias("mixed_tokens"), F.max("times").alias("most_used"))
    have = rows.sparkSession.createDataFrame(list(tokens.items()), "source string, tokens long")
    out = wanted.join(have, "source", "left").join(used, "source", "left").na.fill(0, ["tokens", "mixed_tokens", "most_used"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    share = F.when(whole > 0, F.round(F.col("mixed_tokens") / whole, 6)).otherwise(F.lit(0.0))
    return out.select("source", "target_share", "max_repeats", "tokens", "mixed_tokens", share.alias("actual_share"), "most_used")
