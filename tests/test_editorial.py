from pyspark.sql import functions as F

from loomspark.operators import editorial as ed


def test_list_records(spark):
    lines = ["CLERIC SPELLS", "1ST-LEVEL", "Bless: allies gain", "a bonus.", "Cure: heals.", "2ND LEVEL", "Aid: more.", "DRUID SPELLS", "Stray: no level.", "  ", "loose line"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(lines)], "k string, o int, line string")
    got = {(r["owner"], r["level"], r["name"], r["summary"]) for r in ed.list_records(df, ["k"], ["o"], "line").collect()}
    assert got == {("CLERIC", 1, "Bless", "allies gain a bonus."), ("CLERIC", 1, "Cure", "heals."), ("CLERIC", 2, "Aid", "more."), ("DRUID", None, "Stray", "no level. loose line")}
    assert ed.list_records(df.limit(0), ["k"], ["o"], "line").count() == 0


def test_import_collection(spark):
    df = spark.createDataFrame([("c", '[{"spellId": 3}, {"id": "x", "spellId": 7, "used": 2, "levels": [1]}, {"id": "x", "spellId": 8}, {"spellId": -1}, {"id": " "}]'), ("d", "no json"), ("e", None)], "c string, j string")
    got = {(r["c"], r["id"], r["spell_id"], r["used"]) for r in ed.import_collection(df, "j").collect()}
    assert got == {("c", "entry-0", 3, 0), ("c", "x", 7, 2)}


def test_table_cells(spark):
    df = spark.createDataFrame([(1, "h4. One\n|a| b |\n||c||\nh4. Two\ntext\n| d |"), (2, None)], "id int, t string")
    got = {(r["section"], r["row_no"], r["cell_no"], r["cell"]) for r in ed.table_cells(df, "t").collect()}
    assert got == {("One", 1, 1, "a"), ("One", 1, 2, "b"), ("One", 2, 1, "c"), ("Two", 1, 1, "d")}


def test_headings_and_markers(spark):
    rows = [("p", 1, 10.0, "A", 12.0, "Wall of"), ("p", 2, 22.0, "A", 12.0, "Fire"), ("p", 3, 60.0, "A", 12.0, "Ward"), ("p", 4, 70.0, "B", 12.0, "Other"), ("p", 5, 80.0, "B", 9.0, "small")]
    df = spark.createDataFrame(rows, "k string, o int, y double, font string, height double, text string")
    assert {r["heading"] for r in ed.merge_wrapped_headings(df, ["k"], "o").collect()} == {"Wall of Fire", "Ward", "Other", "small"}
    d = ed.detach_between(df, ["k"], ["o"], F.col("o") == 2, F.col("o") == 4)
    assert [r["detached"] for r in d.orderBy("o").collect()] == [False, True, True, False, False]


def test_fan_out_and_families(spark):
    df = spark.createDataFrame([("Ward vs. Chaos/Evil/Law",), ("Plain",)], "n string")
    assert [r["p"] for r in ed.fan_out(df, "n", "p").collect()] == ["Ward vs. Chaos", "Ward vs. Evil", "Ward vs. Law", "Plain"]
    names = spark.createDataFrame([(1, "Cloak"), (2, "Cloak, Greater"), (3, "Cloak IV"), (4, "Bell"), (5, None)], "id int, n string")
    assert {tuple(r) for r in ed.related_variants(names, "id", "n").collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 0), (5, None, 0)}


def test_decisions_and_balance(spark):
    cand = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "k int, t int")
    dec = spark.createDataFrame([(1, "accept", 2), (2, "accept", 1), (3, "no", 1), (4, "accept", 1)], "k int, decision string, priority int")
    assert {(r["k"], r["outcome"]) for r in ed.apply_decisions(cand, dec, "k", "t").collect()} == {(1, "duplicate"), (2, "applied"), (3, "rejected"), (4, "stale")}
    ids = spark.range(4)
    assert ed.set_balance(ids, ids, "id").first()["balanced"] and not ed.set_balance(ids.limit(3), ids, "id").first()["balanced"]
    assert ed.set_balance(ids.limit(0), ids.limit(0), "id").first()["balanced"]


def test_histograms(spark):
    df = spark.createDataFrame([("a", i) for i in range(8)] + [("b", None), (None, 1)], "l string, e int")
    got = {r["l"]: (r["n"], r["examples"]) for r in ed.label_histogram(df, "l", "e").collect()}
    assert got["a"] == (8, [0, 1, 2, 3, 4]) and got["b"] == (1, None)
    assert {tuple(r) for r in ed.zero_filled(df, "l", ["a", "z"]).collect()} == {("a", 8), ("z", 0)}
