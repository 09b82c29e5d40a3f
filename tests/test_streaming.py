from datetime import datetime as D

from pyspark.sql import functions as F

from loomspark.operators import orphans
from loomspark.streaming.feeds import OrphanFollower, event_counts

REFS = "table_name string, ref_field string, row_key string, kind string, ref_key long, ref_time timestamp_ntz"
PARENTS = "kind string, ref_key long, parent_added timestamp_ntz, parent_deleted timestamp_ntz"


def test_orphan_follower(spark, tmp_path):
    refs = [("t", "f", str(i), "s", i, D(2021, 3, 1)) for i in range(6)]
    parents = [("s", i, D(2020, 1, 1), D(2022, 1, 1) if i == 2 else None) for i in range(4)]
    f = OrphanFollower(spark, str(tmp_path), 4)
    f.advance(0, spark.createDataFrame(refs[:3], REFS), spark.createDataFrame([], PARENTS))
    f.advance(1, spark.createDataFrame(refs[3:], REFS), spark.createDataFrame(parents[:2], PARENTS))
    f.advance(1, spark.createDataFrame(refs[3:], REFS), spark.createDataFrame(parents[:2], PARENTS))  # retried
    state = f.advance(2, spark.createDataFrame([], REFS), spark.createDataFrame(parents[2:], PARENTS))
    assert {(r["row_key"], r["reason"]) for r in orphans.pending(state).collect()} == {("2", "deleted"), ("4", "missing"), ("5", "missing")}
    # a parent that comes back resolves its references, a deleted one reopens them, and a repeated reference is none
    state = f.advance(3, spark.createDataFrame(refs[:1], REFS), spark.createDataFrame([("s", 2, D(2023, 1, 1), None), ("s", 0, None, D(2023, 2, 1))], PARENTS))
    assert {(r["row_key"], r["reason"]) for r in orphans.pending(state).collect()} == {("0", "deleted"), ("4", "missing"), ("5", "missing")}
    assert {(r["period"], r["open_orphans"]) for r in orphans.snapshots(state).collect()} == {("2021-03", 2), ("2023-02", 3)}
    # a step rewrites the buckets of its keys only
    state = f.advance(4, spark.createDataFrame([], REFS), spark.createDataFrame([("s", 4, D(2020, 1, 1), None)], PARENTS))
    assert {(r["row_key"], r["reason"]) for r in orphans.pending(state).collect()} == {("0", "deleted"), ("5", "missing")}
    assert len(list((tmp_path / "v4" / "parents").glob("bucket=*"))) == 1


def test_event_counts(spark, tmp_path):
    rows = [(D(2024, 1, 1, 0, m), "click", 1.0) for m in range(0, 30, 2)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = event_counts(stream, "10 minutes", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.table("counts").orderBy(F.col("window.start")).collect()] == [5, 5, 5]
