import zipfile

import pytest
from pyspark.sql import functions as F

from loomspark.sources import readers, writers


def test_json_lines_numbers_and_errors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").orderBy("line_no").collect()
    assert [(r["line_no"], r["data"] and r["data"]["a"], r["error"]) for r in rows] == [(1, 1, None), (3, None, "not json"), (4, 2, None)]


def test_fixture_table(spark, tmp_path):
    p = tmp_path / "f.jsonl"
    p.write_text('{"op":"insert","table":"t","key":"1","data":{"id":1,"name":"x"}}\n{"op":"insert","table":"u","key":"1","data":{"id":5}}\n')
    assert readers.fixture_table(spark, str(p), "t", "id int, name string").collect() == [(1, "x")]
    p.write_text('{"op":"delete","table":"t","key":"1","data":{"id":1}}\n')
    with pytest.raises(ValueError):
        readers.fixture_table(spark, str(p), "t", "id int")


def test_html_gb_and_sanitize(spark, tmp_path):
    (tmp_path / "x.files").mkdir()
    (tmp_path / "x.files" / "n.htm").write_bytes(b"no")
    (tmp_path / "p.htm").write_bytes("<html><head><title>t</title></head><body><p onclick='x'>火球术 &amp; 冰</p><script>bad()</script><td colspan='2'>b</td></body>".encode("gb18030"))
    df = readers.html_files(spark, str(tmp_path)).withColumn("t", readers.decode_gb("content"))
    r = df.select(readers.html_paragraphs("t").alias("p"), readers.sanitize_html("t").alias("s")).collect()
    assert len(r) == 1 and r[0]["p"] == ["火球术 & 冰", "b"]
    assert r[0]["s"] == 't<p>火球术 &amp; 冰</p><td colspan="2">b</td>'


def test_rtf_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.rtf", r"{\rtf1{\fonttbl{\f0 Arial;}}First \b line\b0 .\par Caf\'e9 \u8212? end\par}")
    rows = readers.rtf_archive(spark, str(tmp_path / "a.zip")).orderBy("paragraph_no").collect()
    assert [r["paragraph"] for r in rows] == ["First line.", "Café — end"]


def test_pages_headings_names(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"page": 3, "items": [{"text": "a", "x": 1, "y": 2, "width": 3, "height": 4}]}\nx\n')
    items, errors = readers.page_rows(spark, str(tmp_path / "p.jsonl"))
    assert items.collect() == [(3, 0, "a", 1.0, 2.0, 3.0, 4.0)] and errors.count() == 1
    (tmp_path / "h.txt").write_text("== Alpha ==\nbody\n== Beta ==\n")
    assert [(r["line_no"], r["title"]) for r in readers.headed_entries(spark, str(tmp_path / "h.txt"), "^== (.*) ==$").orderBy("line_no").collect()] == [(1, "Alpha"), (3, "Beta")]
    df = spark.createDataFrame([("a\tb\n\n c ",)], "t string")
    assert [r["name"] for r in readers.pasted_names(df, "t").orderBy("pos").collect()] == ["a", "b", "c"]


def test_describe(spark):
    spark.range(1).createOrReplaceTempView("tiny")
    assert readers.describe_tables(spark, ["tiny"]).collect() == [("tiny", "id", "bigint", False)]


def test_writers(spark, tmp_path):
    root = str(tmp_path / "db")
    df = spark.range(10).withColumn("lang", F.when(F.col("id") % 2 == 0, "en").otherwise("zh"))
    assert writers.replace_tables(spark, {"a": df}, root, dry_run=True) == {"a": 10}
    assert writers.replace_tables(spark, {"a": df, "b": df.limit(3)}, root) == {"a": 10, "b": 3}
    assert writers.replace_tables(spark, {"a": df.limit(4)}, root) == {"a": 4}
    assert spark.read.parquet(f"{root}/a").count() == 4 and not (tmp_path / "db" / "b").exists()
    part = str(tmp_path / "part")
    writers.replace_partitions(df, part, ["lang"])
    writers.replace_partitions(df.where("lang = 'zh'").limit(1), part, ["lang"])
    assert spark.read.parquet(part).groupBy("lang").count().orderBy("lang").collect() == [("en", 5), ("zh", 1)]
    writers.write_batches(df, "id", 4, str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").glob("batch=*")) == ["batch=0", "batch=1", "batch=2"]
    writers.write_json_lines(df, str(tmp_path / "j"))
    writers.write_tsv(df, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 10


def test_index_sinks(spark, tmp_path):
    import pytest as p

    from loomspark.operators import search

    docs = spark.createDataFrame([(1, "wall of fire"), (2, "lantern")], "id int, name string")
    root = str(tmp_path / "ix")
    assert writers.replace_search_index(spark, docs, "id", ["name"], docs, root)["documents"] == 2
    assert search.index_usable(spark.read.parquet(f"{root}/state"))
    assert [r["id"] for r in search.candidates(spark.read.parquet(f"{root}/postings"), "id", "Lantern").collect()] == [2]
    with p.raises(ValueError):
        writers.replace_search_index(spark, docs.limit(1), "id", ["name"], docs, root)
    levels = spark.createDataFrame([(1, 5, 2, None), (1, 5, 2, ""), (9, 5, 2, "")], "spell_id int, owner_id int, level int, extra string")
    spells = spark.createDataFrame([(1, 7)], "id int, rulebook_id int")
    assert writers.replace_browse_index(spark, levels, spells, str(tmp_path / "b")) == {"edges": 1}


def test_materialize_and_drop(spark):
    from loomspark.session import drop_materialized, materialize, shared_dir

    drop_materialized(spark)
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and shared_dir(spark) == shared_dir(spark)
    assert drop_materialized(spark) == 1 and drop_materialized(spark) == 0
