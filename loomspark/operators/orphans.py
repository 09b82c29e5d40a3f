"""References to records that do not exist (problem 5), kept as incremental keyed state.

State is a parent index (one row per kind and key), an append-only log of the references seen, and the pending table
of those without a valid target. A step probes the index with the new references; parents that arrive resolve the
pending references of their key, and parents that are deleted reopen those of their key in the log. OrphanStore keeps
the state on disk in buckets of keys: a step reads and rewrites only the buckets of its own keys, so what it costs
follows the batch, not the history. Every step also leaves the monthly change in the number of open references.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark.session import delete_path, list_names, read_text, write_text

REF_COLS = ["table_name", "ref_field", "row_key", "kind", "ref_key", "ref_time"]
PARENT_COLS = ["kind", "ref_key", "parent_added", "parent_deleted"]
KEY = ["kind", "ref_key"]
_SEEN = ["first_added", "last_added", "last_deleted"]
_REF = "table_name string, ref_field string, row_key string, kind string, ref_key long, ref_time timestamp_ntz"
_TIMES = "first_added timestamp_ntz, last_added timestamp_ntz, last_deleted timestamp_ntz"
_SCHEMAS = {
    "parents": f"kind string, ref_key long, {_TIMES}, before struct<{_TIMES.replace(' ', ':').replace(',:', ',')}>, changed boolean",
    "refs": _REF,
    "pending": f"{_REF}, reason string",
    "monthly": "table_name string, ref_field string, period string, opened long, closed long",
}
#: A key is hot if it has more than one in HOT_PARTS of a batch's references (so there are fewer than HOT_PARTS of them) and more than HOT_ROWS.
HOT_PARTS, HOT_ROWS, SALT = 64, 500_000, 32


@dataclass(frozen=True)
class OrphanState:
    """parents: the index. refs: REF_COLS of every reference seen. pending: REF_COLS and reason. monthly: references opened and closed per table, field and period, in parts to be summed."""

    parents: DataFrame
    refs: DataFrame
    pending: DataFrame
    monthly: DataFrame


def empty_state(spark: SparkSession) -> OrphanState:
    return OrphanState(*(spark.createDataFrame([], _SCHEMAS[n]) for n in ("parents", "refs", "pending", "monthly")))


def _index(parents: DataFrame, changes: DataFrame) -> DataFrame:
    """The index with changes merged in, one row per key: times of the first and last arrival and the last deletion, as they are and as they were before."""
    new = changes.where(F.col("ref_key").isNotNull()).select(
        *KEY,
        F.col("parent_added").cast("timestamp_ntz").alias("first_added"),
        F.col("parent_added").cast("timestamp_ntz").alias("last_added"),
        F.when(F.col("parent_deleted").isNotNull(), F.greatest("parent_deleted", "parent_added")).cast("timestamp_ntz").alias("last_deleted"),
        F.lit(False).alias("_old"),
    )
    both = parents.select(*KEY, *_SEEN, F.lit(True).alias("_old")).unionByName(new)
    return both.groupBy(*KEY).agg(
        F.min("first_added").alias("first_added"), F.max("last_added").alias("last_added"), F.max("last_deleted").alias("last_deleted"),
        F.max(F.when(F.col("_old"), F.struct(*_SEEN))).alias("before"), F.max(~F.col("_old")).alias("changed"),
    )


def _deleted(p: str) -> Column:
    """Whether the last thing known of a parent is its deletion; of the same moment the deletion counts."""
    gone, came = F.col(f"{p}last_deleted"), F.col(f"{p}last_added")
    return F.coalesce(gone.isNotNull() & (came.isNull() | (gone >= came)), F.lit(False))


def _events(p: str, known: Column) -> Column:
    """When a reference opens (1) and closes (-1), by what is known of its parent."""
    none, first = F.lit(None).cast("struct<at:timestamp_ntz,d:int>"), F.col(f"{p}first_added")
    event = lambda at, d: F.struct(at.cast("timestamp_ntz").alias("at"), F.lit(d).alias("d"))
    waits = F.coalesce(first.isNull() | (first > F.col("ref_time")), F.lit(False)) | ~known
    return F.array_compact(
        F.array(
            F.when(waits, event(F.col("ref_time"), 1)).otherwise(none),
            F.when(waits & first.isNotNull(), event(first, -1)).otherwise(none),
            F.when(_deleted(p), event(F.greatest("ref_time", first, F.col(f"{p}last_deleted")), 1)).otherwise(none),
        )
    )


def hot_keys(refs: DataFrame) -> list[tuple[str, int]]:
    """Keys with more than one in HOT_PARTS of all references, so fewer than HOT_PARTS of them."""
    least = max((n := refs.count()) // HOT_PARTS, HOT_ROWS)
    return [] if n <= least else [(r["kind"], r["ref_key"]) for r in refs.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > least).collect()]


def _probe(refs: DataFrame, index: DataFrame, hot: list[tuple[str, int]]) -> DataFrame:
    """refs with the index row of their key, if any. Only hot keys are spread, over SALT copies of their one row."""
    index = index.withColumn("_found", F.lit(True))
    if not hot:
        return refs.join(index, KEY, "left")
    is_hot = F.lit(False)
    for kind, key in hot:
        is_hot = is_hot | ((F.col("kind") == kind) & (F.col("ref_key") == key))
    salted = refs.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64("table_name", "row_key"), F.lit(SALT))).otherwise(0).cast("int"))
    copies = index.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [*KEY, "_salt"], "left").drop("_salt")


def step(state: OrphanState | None, new_refs: DataFrame, parent_changes: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> OrphanState:
    """Advance the state by a batch of references and a batch of parent arrivals and deletions.

    new_refs: REF_COLS; a null ref_key refers to nothing and is dropped, repeated rows count once, in any batch.
    parent_changes: PARENT_COLS, in which a row with parent_deleted tells of a deletion (no earlier than that row's
    arrival) and a later arrival brings a deleted parent back; either may be empty. Any split of the same input into
    steps ends in the same state. keep writes a part of the new state ("refs": the new ones only) and gives it back.
    """
    keep = keep or (lambda df, name: df)
    state = state or empty_state(new_refs.sparkSession)
    fresh = new_refs.select(*REF_COLS).where(F.col("ref_key").isNotNull()).withColumn("ref_key", F.col("ref_key").cast("long")).distinct()
    same = [fresh[c].eqNullSafe(state.refs[c]) if c in ("row_key", "ref_time") else fresh[c] == state.refs[c] for c in REF_COLS]
    fresh = keep(fresh.join(state.refs, same, "left_anti"), "refs")
    index = keep(_index(state.parents, parent_changes), "parents")
    moved = index.where("changed")
    # deletions reopen what the log has under their key; other changes matter to pending references only
    lost = _deleted("") & ~_deleted("before.")
    again = state.pending.select(*REF_COLS).join(moved.where(~lost).select(*KEY), KEY, "left_semi").unionByName(state.refs.join(moved.where(lost).select(*KEY), KEY, "left_semi").select(*REF_COLS))
    probed = _probe(fresh.withColumn("_new", F.lit(True)).unionByName(again.withColumn("_new", F.lit(False)).select(*REF_COLS, "_new")), index, hot_keys(fresh))
    reason = F.when(F.col("_found").isNull(), "missing").when(_deleted(""), "deleted").when(F.col("first_added") > F.col("ref_time"), "late")
    known_before = F.col("before").isNotNull()
    undone = F.transform(_events("before.", known_before), lambda e: F.struct(e["at"].alias("at"), e["d"].alias("d"), F.lit(-1).alias("n")))
    done = F.transform(_events("", F.col("_found").isNotNull()), lambda e: F.struct(e["at"].alias("at"), e["d"].alias("d"), F.lit(1).alias("n")))
    changes = F.concat(done, F.when(F.col("_new"), F.slice(undone, 1, 0)).otherwise(undone))
    told = probed.select(*REF_COLS, reason.alias("reason"), changes.alias("changes")).where("reason is not null or size(changes) > 0")
    told = keep(told, "told")
    kept = state.pending.join(moved.select(*KEY), KEY, "left_anti").select(*REF_COLS, "reason")
    pending_now = keep(kept.unionByName(told.where("reason is not null").select(*REF_COLS, "reason")), "pending")
    each = told.select("table_name", "ref_field", F.explode("changes").alias("e"))
    monthly = each.groupBy("table_name", "ref_field", F.date_format("e.at", "yyyy-MM").alias("period")).agg(
        *(F.sum(F.when(F.col("e.d") == d, F.col("e.n")).otherwise(0)).cast("long").alias(name) for d, name in ((1, "opened"), (-1, "closed")))
    )
    return OrphanState(index, state.refs.unionByName(fresh), pending_now, state.monthly.unionByName(keep(monthly, "monthly")))


def pending(state: OrphanState) -> DataFrame:
    """The references without a valid target: table_name, ref_field, row_key, reason, period (month of the reference)."""
    return state.pending.select("table_name", "ref_field", "row_key", "reason", F.date_format("ref_time", "yyyy-MM").alias("period")).distinct()


def counts(state: OrphanState) -> DataFrame:
    """Orphans per table, field, period and reason."""
    return pending(state).groupBy("table_name", "ref_field", "period", "reason").agg(F.count("*").alias("n"))


def snapshots(state: OrphanState) -> DataFrame:
    """Open orphans per table and field at the end of each month that had openings or closings.

    A reference opens when its row arrives before its parent (or the parent is missing), is resolved when the
    parent arrives and reopened when the parent is deleted; a parent that came back counts as never gone. The running
    total takes one row per table, field and month.
    """
    monthly = state.monthly.groupBy("table_name", "ref_field", "period").agg((F.sum("opened") - F.sum("closed")).alias("change"), (F.sum("opened") + F.sum("closed")).alias("n")).where("n > 0")
    w = Window.partitionBy("table_name", "ref_field").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select("table_name", "ref_field", "period", F.col("change").cast("long").alias("change"), F.sum("change").over(w).cast("long").alias("open_orphans"))


class OrphanStore:
    """Orphan state on disk, in buckets of keys, advanced batch by batch.

    A batch writes new versions of the buckets of its keys and only then a manifest that names the version of every
    bucket, so a batch that is tried again starts from the manifest before it. The log of references is appended to;
    versions that neither this manifest nor the one before it names are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def _manifest(self, batch: int) -> dict:
        text = read_text(self.spark, f"{self.path}/manifest-{batch}.json") if batch >= 0 else None
        if text is None and batch >= 0:
            raise ValueError(f"no batch {batch}")
        return json.loads(text) if text else {"parents": {}, "pending": {}, "refs": {}, "monthly": []}

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMAS[name])

    def _state(self, manifest: dict, only: set[int] | None = None) -> OrphanState:
        def paths(name: str) -> list[str]:
            held = {int(b): v if isinstance(v, list) else [v] for b, v in manifest[name].items() if only is None or int(b) in only}
            return [f"{self.path}/v{v}/{name}/bucket={b}" for b, vs in sorted(held.items()) for v in vs]

        return OrphanState(*(self._read(n, paths(n)) for n in ("parents", "refs", "pending")), self._read("monthly", [f"{self.path}/v{v}/monthly" for v in manifest["monthly"]]))

    def advance(self, batch: int, refs: DataFrame, parents: DataFrame) -> OrphanState:
        """The state after batch (0 is the first) of references and parent changes; see step."""
        old = self._manifest(batch - 1)
        # which buckets the batch touches: at most as many numbers as there are buckets
        keys = refs.select(*KEY).unionByName(parents.select(*KEY)).where("ref_key is not null").withColumn("ref_key", F.col("ref_key").cast("long"))
        touched = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}
        wrote: dict[str, list[int]] = {}

        def keep(df: DataFrame, name: str) -> DataFrame:
            at = f"{self.path}/v{batch}/{name}"
            if name in ("told", "monthly"):
                df.write.mode("overwrite").parquet(at)
                return self.spark.read.schema(df.schema).parquet(at)
            df.select("*", self._bucket().alias("bucket")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
            schema = T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])
            back = self.spark.read.schema(schema).parquet(at)
            wrote[name] = sorted(int(d.removeprefix("bucket=")) for d in list_names(self.spark, at) if d.startswith("bucket="))
            return back.drop("bucket")

        step(self._state(old, touched), refs, parents, keep)
        new = {"refs": {b: list(v) for b, v in old["refs"].items()}, "monthly": [v for v in old["monthly"] if v != batch] + [batch]}
        for name in ("parents", "pending"):
            new[name] = {b: v for b, v in old[name].items() if int(b) not in touched} | {str(b): batch for b in wrote[name]}
        for b in wrote["refs"]:
            new["refs"].setdefault(str(b), []).append(batch)
        write_text(self.spark, f"{self.path}/manifest-{batch}.json", json.dumps(new))
        delete_path(self.spark, f"{self.path}/v{batch}/told")
        self._drop_unnamed(old, new, batch)
        return self._state(new)

    def _drop_unnamed(self, old: dict, new: dict, batch: int) -> None:
        before = self._manifest(batch - 2) if batch > 1 else {"parents": {}, "pending": {}}
        for name in ("parents", "pending"):
            for b, v in before[name].items():
                if v not in (old[name].get(b), new[name].get(b)):
                    delete_path(self.spark, f"{self.path}/v{v}/{name}/bucket={b}")

    def read(self, batch: int) -> OrphanState:
        return self._state(self._manifest(batch))
