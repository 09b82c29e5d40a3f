"""Views, pages and corpus upkeep on small fixtures with nulls, ties, repeats and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators import corpus, editorial, pages, views
from loomspark.sources import readers, writers

ITEMS = "page int, no int, text string, x double, y double, width double, height double, has_eol boolean"


def test_reading_lines(spark):
    rows = [
        (1, 1, "Fire", 0.0, 10.0, 20.0, 9.0, False), (1, 2, " ", 20.0, 50.0, 2.0, 9.0, False), (1, 3, "ball", 30.0, 11.5, 10.0, 8.0, False), (1, 4, ",", 45.0, 11.0, 1.0, 8.0, True),
        (1, 5, "next", 0.0, 11.0, 5.0, 8.0, False), (1, 6, "up", 10.0, 20.0, 5.0, 8.0, False), (1, 7, "(", 20.0, 20.0, 1.0, 8.0, False), (1, 8, "x", 30.0, 20.0, 1.0, 8.0, False), (1, 9, None, 0.0, 0.0, 1.0, 1.0, True), (2, 1, " ", 0.0, 0.0, 1.0, 1.0, None),
    ]
    got = [tuple(r) for r in pages.reading_lines(spark.createDataFrame(rows, ITEMS), ["page"], "no").orderBy("page", "line").collect()]
    assert got == [(1, 0, "Fire ball,", 0.0, 11.5, 9.0), (1, 1, "next", 0.0, 11.0, 8.0), (1, 2, "up (x", 10.0, 20.0, 8.0)]
    assert pages.reading_lines(spark.createDataFrame([], ITEMS), ["page"], "no").count() == 0
    assert [r["text"] for r in pages.clustered_lines(spark.createDataFrame([r for r in rows if r[2] is not None], ITEMS).where("page = 1"), ["page"]).collect()] == ["up (x Firenext ball,"]


def test_heading_entities_and_entries(spark):
    lines = [("d", n, t) for n, t in enumerate(["Fireball", "School of fire", "Level: 3", "It burns-", "well.", "Fireball", "School x", "Level: 1", "Not: a head", "School"])]
    got = pages.heading_entities(spark.createDataFrame(lines, "doc string, no int, text string"), "doc", "no", "text", "^School", "^Level").orderBy("entity_no").collect()
    assert [(r["name"], r["n_lines"], r["body"], r["issue"]) for r in got] == [("Fireball", 5, "School of fire Level: 3 It burns-well.", "duplicate-name"), ("Fireball", 5, "School x Level: 1 Not: a head School", "duplicate-name")]
    rows = [("p", 1, "before", 0.0), ("p", 2, "Sor/Wiz 3 Fire:", 10.0), ("p", 3, "burns a-", 12.0), ("p", 4, "lot", 12.0), ("p", 5, "far", 90.0), ("p", 6, "again", 12.0), ("q", 1, "nothing", 0.0)]
    df = spark.createDataFrame(rows, "page string, no int, text string, x double")
    told = {r["page"]: (r["n_found"], r["text"]) for r in pages.located_entry(df, "page", "no", "text", "x", F.col("text").startswith("Sor"), F.col("text").startswith("Next")).collect()}
    assert told == {"p": (1, "Sor/Wiz 3 Fire: burns alot"), "q": (0, None)}
    blocks = spark.createDataFrame([("p", 1, 2, 3), ("p", 2, 50, 60), ("z", 1, 1, 9)], "page string, block_id int, first int, last int")
    assert {(r["page"], r["block_id"]): (r["text"], r["n_lines"]) for r in pages.block_evidence(df, blocks, "page", "no", "text").collect()} == {("p", 1): ("Sor/Wiz 3 Fire:\nburns a-", 2), ("p", 2): ("", 0), ("z", 1): ("", 0)}


def test_coordinate_table(spark):
    items = [(1, 0.0, 100.0, "Level 1"), (1, 0.0, 90.0, "wolf"), (1, 50.0, 91.0, "grey"), (1, 50.0, 86.0, "hungry"), (1, 0.0, 80.0, "bear"), (1, 50.0, 79.0, "brown"), (1, 0.0, 70.0, "Level 2"), (1, 0.0, 60.0, "dragon"), (1, 500.0, 60.0, "margin")]
    df = spark.createDataFrame(items, "page int, x double, y double, text string")
    cols = spark.createDataFrame([(1, 0, 0.0, 40.0), (1, 1, 40.0, 90.0)], "page int, column_no int, x_min double, x_max double")
    got = sorted(tuple(r) for r in pages.coordinate_table(df, "page", cols, F.col("text").startswith("Level")).collect())
    assert got == [(1, "Level 1", 0, 0, "wolf"), (1, "Level 1", 0, 1, "grey hungry"), (1, "Level 1", 1, 0, "bear"), (1, "Level 1", 1, 1, "brown"), (1, "Level 2", 0, 0, "dragon")]


def test_views(spark):
    members = spark.createDataFrame([(1, "b", "B", True), (2, "a", "A", False), (3, "c", "C", False), (9, "z", "Z", False)], "id int, slug string, name string, prestige boolean")
    used = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "id int")
    names = spark.createDataFrame([(1, "zh", "default", "甲"), (2, "zh", "chm", "乙")], "id int, lang string, variant string, name string")
    got = [tuple(r) for r in views.dimension_list(members, used, names, "zh").orderBy("place").collect()]
    assert got == [(0, 2, "a", "A", False, None), (1, 3, "c", "C", False, None), (2, 1, "b", "B", True, "甲")]
    assert views.dimension_list(members, used, names, "en", include_prestige=False).count() == 2
    assert views.overlay_maps({"x": names}, "en").count() == 0 and views.overlay_maps({"x": names}, "zh", "chm").collect() == [("x", 2, "乙")]
    d = spark.createDataFrame([(1, 5, "Fire", "fire", 1), (1, 6, "see text: odd", "s", 2), (1, 7, "See Text", "s2", 3), (1, 5, "Fire!", "fire", 4)], "spell_id int, id int, name string, slug string, order int")
    assert [tuple(x) for x in views.descriptor_list(d).first()["descriptors"]] == [("Fire!", 5, None, None), ("See text", None, "see-text", None)]
    status = views.content_status(spark.createDataFrame([], "build_id int, generated_at timestamp"), {"m": members}).first()
    assert status["build_id"] is None and status["n_m"] == 4
    assert views.run_sql(spark, "select count(*) as n from {m} where prestige", {"m": members}).first()["n"] == 1
    over = {(r["table_name"], r["column_name"]): (r["column_type"], r["n_rows"], r["sample"]) for r in views.table_overview(spark, {"m": members}, 2).collect()}
    assert over["m", "name"] == ("string", 4, "A, B")


def test_corpus_inventory(spark):
    cand = [(i, n, s, a, c, b) for i, n, s, a, c, b in [(1, "A", "a1", True, False, False), (2, "Known", "k2", False, True, False), (3, "New", "n3", False, True, False), (4, "Known", "k4", False, False, False), (5, "Other", "slug", False, False, False), (6, "B6", "b6", False, False, True), (7, "B7", "b7", False, False, False), (8, "Known (M)", "k8", False, False, False), (9, "C", "c9", False, False, False), (10, "D", "d", None, None, None)]]
    c = spark.createDataFrame(cand, "cand_id int, name string, slug string, is_artifact boolean, is_core boolean, is_blocked boolean")
    app = spark.createDataFrame([(1, 1), (4, 1), (4, 2), (5, 2), (6, 2), (7, 2), (7, None), (8, 2), (9, 2), (10, 2), (10, 2)], "cand_id int, rulebook_id int")
    e = spark.createDataFrame([(1, "known", "slug", 1)], "id int, name string, slug string, rulebook_id int")
    got = {(r["cand_id"], r["rulebook_id"]): f"{r['category']}:{r['reason']}" for r in corpus.corpus_inventory(c, app, e, spark.createDataFrame([(9,), (None,)], "cand_id int")).collect()}
    assert got == {
        (1, None): "manual-review:artifact", (2, None): "duplicate:core-label", (3, None): "deferred:no-known-book", (4, 1): "duplicate:exists", (4, 2): "duplicate:other-book", (5, 2): "duplicate:exists", (6, 2): "manual-review:blocked",
        (7, 2): "manual-review:several-books", (8, 2): "manual-review:name-elsewhere", (9, 2): "mismatch:blockers", (10, 2): "ready:None",
    }


def test_conversion(spark):
    look = spark.createDataFrame([("school", "Fire"), ("descriptor", "Hot"), ("characterclass", "Bard")], "kind string, name string")
    c = spark.createDataFrame([(1, "fire ", None, ["hot", "cold"], {"bard": "3 (x)", "Monk": "1", "Bard ": "high"}), (2, None, " ", None, None)], "cand_id int, school string, subschool string, descriptors array<string>, class_levels map<string,string>")
    got = {r["cand_id"]: ([tuple(x) for x in r["levels"]], r["blockers"], r["notes"]) for r in corpus.conversion_check(c, look).collect()}
    assert got[1] == ([("bard", 3, "x")], ["unresolved descriptor: cold", "unparsed class level: Bard =high"], ["skipped unresolved class: Monk"])
    assert got[2] == ([], ["unresolved school: ", "no resolvable levels"], [])


def test_summaries_and_items(spark):
    cols = "spell_id int, rulebook_abbr string, summary_text string, source_key string, source_kind string, list_owner string"
    rows = [(1, "A", "短。", "k1", "x", None), (1, "A", "短", "k2", "x", None), (2, "A", "a", "k", "x", None), (2, "A", "b", "k9", "x", None), (3, "A", "a", "k", "x", None), (3, "A", "b", "m", "class-list", None), (4, None, "t", "k", "x", None), (5, "A", " ", "k", "x", None), (6, "A", "z", "k", "x", None), (None, "A", "z", "k", "x", None)]
    dec = spark.createDataFrame([(3, "choose", "gone", "b"), (6, "needs_human", None, None)], "spell_id int, decision string, chosen_key string, chosen_text string")
    got = {r["spell_id"]: (r["summary_text"], r["source_key"], r["reason"]) for r in corpus.choose_summaries(spark.createDataFrame(rows, cols), dec).collect()}
    assert got == {1: ("短", "k2", None), 2: (None, None, "unreviewed-variants"), 3: ("b", "m", None), 4: (None, None, "incomplete"), 5: (None, None, "empty"), 6: (None, None, "conflict-needs-human")}
    spells = spark.createDataFrame([(1, "Wall", "A"), (2, "Wall", "B"), (3, "Wall", "B")], "id int, name string, abbr string")
    items = spark.createDataFrame([(1, "A", "wall", "s"), (2, "A", "Wall", "s"), (3, "B", "Wall", "s"), (4, None, "Wall", "s"), (5, "C", "Wall", "s"), (6, "A", None, "s"), (7, "A", "Wall", " "), (8, "A", "Door", "s")], "item_id int, abbr string, name string, summary string")
    told = {r["item_id"]: (r["spell_id"], r["reason"]) for r in corpus.match_items(items, spells, spells).collect()}
    assert told == {1: (1, None), 2: (None, "duplicate"), 3: (None, "ambiguous"), 4: (None, "source-without-book"), 5: (None, "book-not-known"), 6: (None, "missing-name"), 7: (None, "missing-summary"), 8: (None, "no-match")}
    assert {r["item_id"]: r["gap"] for r in corpus.source_gaps(items, spells).collect()} == {4: "unmapped", 5: "not-in-source-book", 6: "not-in-db", 8: "not-in-db"}


def test_reuse_audit_and_patches(spark):
    d = spark.createDataFrame([(1, 5, "reviewed", "accept"), (1, 9, "auto", "accept"), (2, 5, "auto", "reject"), (3, 5, "auto", "accept"), (4, 1, None, None)], "target int, source int, origin string, decision string")
    c = spark.createDataFrame([(1, 5), (1, 9), (2, 5)], "target int, source int")
    assert {(r["target"], r["source"]): r["reason"] for r in corpus.apply_reuse(d, c).collect()} == {(1, 5): "duplicate", (1, 9): None, (2, 5): "not-accepted", (3, 5): "stale", (4, 1): "not-accepted"}
    a = spark.createDataFrame([("x", 1, "accepted"), ("x", 1, None), ("x", 2, "needs_human"), ("y", None, None), (None, 1, None)], "name string, target int, review string")
    assert {tuple(r) for r in corpus.alias_audit(a).collect()} == {("x", 3, 2, "1x2,2x1", "needs_human"), ("y", 1, 0, "", "none")}
    l, r = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("A",), ("B",)], "name string")
    al = spark.createDataFrame([("a", "A"), ("a", "C")], "left_name string, right_name string")
    assert {tuple(x) for x in corpus.bijection_errors(l, r, al).collect()} == {("b", "left-unpaired"), ("B", "right-unpaired"), ("C", "unknown-right"), ("a", "left-twice")}
    patch = spark.createDataFrame([(7, "p", [(1,), (2,)]), (8, "q", []), (9, "r", [(3,)])], "id int, name string, kids array<struct<v:int>>")
    old = spark.createDataFrame([(10,)], "id int")
    out = corpus.insert_patch(patch, {"kids": (old, "parent_id")})
    assert sorted(tuple(x) for x in out["kids"].collect()) == [(11, 7, 1), (12, 7, 2), (13, 9, 3)] and out["parents"].columns == ["id", "name"]
    assert sorted(x["id"] for x in corpus.insert_patch(patch, {"kids": (old.limit(0), "parent_id")})["kids"].collect()) == [1, 2, 3]
    kids = spark.createDataFrame([(1, 2, "Bard", None)], "spell_id int, level int, name string, extra string")
    asked = spark.createDataFrame([(1, 2, "bard", ""), (1, 3, "bard", "")], "spell_id int, level int, name string, extra string")
    assert corpus.verify_children(asked, kids, ["spell_id", "level"], "extra").collect() == [(1, 3, "bard", "")]
    assert {tuple(x) for x in corpus.ordered_union([l, r.unionByName(l)], "name", "name").collect()} == {("a", 0, "a"), ("b", 0, "b"), ("A", 1, "A"), ("B", 1, "B")}
    assert corpus.stacked_rows(spark.createDataFrame([(None, True), (None, None)], "k string, u boolean"), ["k"], "u").collect() == [(None, 2, 1)]


def test_reports_and_artifacts(spark, tmp_path):
    good = {"schema_version": 1, "scope": "full", "sources": [{"path": "a", "sha256": "h"}], "rows": [{"id": 1}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    assert readers.read_artifact(spark, str(tmp_path / "a.json"), ["rows"], 1) == good
    bad = corpus.artifact_errors({"schema_version": 2, "scope": "x", "sources": [{"path": "a", "sha256": "h"}, {"path": "b", "sha256": "h"}], "rows": [{"id": 1}, {"id": 1}, {}]}, ["issues"], 1, {"a": "other"})
    assert bad == ["schema_version is 2, not 1", "unknown scope 'x'", "issues is missing", "1 rows without an id", "id 1 occurs twice", "a has changed", "b is gone"]
    with pytest.raises(ValueError):
        readers.read_artifact(spark, str(tmp_path / "a.json"), ["issues"], 1)
    df = spark.createDataFrame([(2, "b|c"), (1, None)], "k int, v string")
    assert corpus.markdown_table(df, ["k"]) == "| k | v |\n| --- | --- |\n| 1 |  |\n| 2 | b\\|c |"
    assert corpus.markdown_table(df, ["k"], 1).endswith("More than 1 rows.")
    writers.write_report(spark, {"All": (df, ["k"])}, "T", str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text().startswith("# T\n\n## All\n\n| k")
    rows = spark.createDataFrame([(1, "b"), (1, "A"), (2, "c"), (5, "z")], "level int, name string")
    assert sorted(tuple(r) for r in writers.level_columns(rows, [1, 2]).collect()) == [(1, "A", "c"), (2, "b", "")]
    lab = spark.createDataFrame([("Book 1", "x"), ("Book 1", None), (None, "y")], "label string, e string")
    assert {(r["label"], r["n"], r["class"]) for r in editorial.classified_labels(lab, "label", "e", [("num", r"\d")], "other").collect()} == {("Book 1", 2, "num"), (None, 1, "other")}
    p, r = spark.createDataFrame([(1, "a"), (2, "b"), (2, "x")], "b int, k string"), spark.createDataFrame([(1, "a"), (1, "c"), (1, "d"), (3, "e"), (2, "b")], "b int, k string")
    assert {(x["b"], x["n_missing"], x["n_extra"], x["status"]) for x in editorial.reference_report(p, r, "b", "k", 0.5).collect()} == {(1, 2, 0, "below"), (2, 0, 1, "ok"), (3, 1, 0, "missing-book")}


def test_more_readers(spark, tmp_path):
    (tmp_path / "blocks.json").write_text(json.dumps([{"page_idx": 0, "type": "text", "text": "a", "bbox": [1, 2, 3, 4]}, {"page_idx": 0, "type": "table", "text": "b"}, {"page_idx": 1, "type": "text", "text": "c", "bbox": []}, {"type": "text"}]))
    blocks = readers.layout_blocks(spark, str(tmp_path / "blocks.json"))
    assert [(r["page"], r["place"], r["text"], r["x0"]) for r in blocks.orderBy("page", "place").collect()] == [(1, 0, "a", 1.0), (1, 1, "b", None), (2, 0, "c", None)]
    assert {(r["page"], r["n_blocks"], tuple(r["kinds"])) for r in pages.blocks_by_page(blocks).collect()} == {(1, 2, ("text", "table")), (2, 1, ("text",))}
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"token": "t", "name": "N", "rulebook_abbr": "A", "file": "one.jsonl"}]}))
    (tmp_path / "one.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert sorted(tuple(r) for r in readers.manifest_rows(spark, str(tmp_path / "m.json"), "id int").collect()) == [("t", "N", "A", 1), ("t", "N", "A", 2)]
    for name, error in (("../x.jsonl", ValueError), ("gone.jsonl", FileNotFoundError), ("/etc/x", ValueError)):
        (tmp_path / "m2.json").write_text(json.dumps({"sources": [{"file": name}]}))
        with pytest.raises(error):
            readers.manifest_rows(spark, str(tmp_path / "m2.json"), "id int")
    (tmp_path / "t.txt").write_text("a\n\n b\n")
    assert readers.line_counts(spark, str(tmp_path / "t.txt")).collect() == [("t.txt", 3, 1)]
    html = "<html><head><title>x</title></head><body class='a'><p><span style='b'>One</span>&nbsp;two</p><p> <br></p><div><p></p></div><script>x</script></body></html>"
    assert spark.createDataFrame([(html,), (None,)], "h string").select(readers.clean_page("h")).collect() == [("<div><p>One two</p></div>",), (None,)]
    df = spark.range(5)
    assert readers.first_rows(df, "id", 2).count() == 2 and readers.first_rows(df, "id", None).count() == 5
    with pytest.raises(ValueError):
        writers.activate_stage(spark, {"../out": df}, str(tmp_path / "s"))
    assert writers.activate_stage(spark, {"in": df}, str(tmp_path / "s")) == {"in": 5}


def test_verified_members(spark, tmp_path):
    import hashlib
    import zipfile

    data = rb"{\rtf1 Hello\par World}"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.rtf", data)
        z.writestr("b.rtf", data)
    good = hashlib.sha256(data).hexdigest()
    assert [r["paragraph"] for r in readers.verified_members(spark, str(tmp_path / "a.zip"), {"a.rtf": good}).orderBy("paragraph_no").collect()] == ["Hello", "World"]
    with pytest.raises(ValueError):
        readers.verified_members(spark, str(tmp_path / "a.zip"), {"a.rtf": "0", "c.rtf": good})
