"""Small fixtures with nulls, ties, repeats and empty tables, against brute force or known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import mechanics, text
from loomspark.operators import browse, changefeed, filters, layout, normalize, orphans, packed, reconcile, resolve, search


def one(spark, col, schema="a string", *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(col(F.col("a"))).collect()]


FEED = "op string, table_name string, row_key string, data string, seq long, extra string"


def brute_state(rows):
    state, seen = {}, set()
    for op, t, k, _, seq, _ in sorted((r for r in rows if r[4] is not None and r[2] is not None), key=lambda r: r[4]):
        key, op = (t.strip().lower(), k.strip().lower()), op.strip().lower()[0].replace("c", "i").replace("r", "d")
        if (key, seq) in seen:
            continue
        seen.add((key, seq))
        if op == "i":
            state[key] = seq
        elif op == "u" and key in state:
            state[key] = seq
        elif op == "d":
            state.pop(key, None)
    return {(*k, s) for k, s in state.items()}


def test_changefeed_equals_replay(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for seq in range(400):
        op = rng.choice(["insert", "I", "update", "upd", "Delete", "remove", "c"])
        rows.append((op, rng.choice(["T", " t", "u"]), rng.choice(["k:1", "K:1 ", "k:2", "k:3", "k:4"]), '{"a": %d}' % seq, seq, None))
    rows += rng.sample(rows, 60) + [("insert", "t", None, None, 999, None), ("insert", "t", "k:9", None, None, None), ("wat", "t", "k:9", None, 1000, None)]
    rng.shuffle(rows)
    feed = spark.createDataFrame(rows, FEED)
    want = brute_state([r for r in rows if r[0] != "wat"])
    got = changefeed.live_keys(changefeed.split_feed(feed)).select("table_name", "row_key", "last_seq").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert changefeed.rejected_changes(feed).count() == 3
    log = changefeed.ChangeLogTable(spark, str(tmp_path / "log"))
    for i in range(3):
        log.append(spark.createDataFrame(rows[i::3], FEED), str(i))
    log.append(spark.createDataFrame(rows[0::3], FEED), "0")  # a replayed batch changes nothing
    assert {tuple(r) for r in log.read().select("table_name", "row_key", "last_seq").collect()} == want
    log.compact()
    assert {tuple(r) for r in log.read().select("table_name", "row_key", "last_seq").collect()} == want
    # what comes after, of any age, counts as if nothing had been put together
    late = [("delete", "t", "k:1", None, 1000, None), ("insert", "t", "k:7", "{}", 5, None), ("update", "t", "k:7", None, 6, None), ("insert", "t", "k:1", "{}", 999, None)]
    log.append(spark.createDataFrame(late, FEED))
    assert {tuple(r) for r in log.read().select("table_name", "row_key", "last_seq").collect()} == brute_state([r for r in rows + late if r[0] != "wat"])
    assert changefeed.live_keys(changefeed.split_feed(feed.limit(0))).count() == 0
    assert changefeed.ChangeLogTable(spark, str(tmp_path / "none")).read().count() == 0


def test_changefeed_values(spark):
    rows = [("insert", "t", "k", '{"a": 1, "b": "x"}', 1, None), ("update", "t", "k", '{"b": null}', 3, None), ("update", "t", "k", '{"a": 7}', 2, None), ("delete", "t", "j", None, 4, None), ("update", "t", "j", '{"a": 1}', 5, None), ("insert", "t", "z", "{bad", 6, None)]
    got = {(r["row_key"], r["column_name"], r["value"]) for r in changefeed.current_values(changefeed.split_feed(spark.createDataFrame(rows, FEED))).collect()}
    assert got == {("k", "a", "7"), ("k", "b", None)}


def test_changefeed_stream(spark, tmp_path):
    rows = [("insert", "t", f"k{i}", "{}", i, None) for i in range(20)] + [("delete", "t", "k3", None, 30, None)]
    spark.createDataFrame(rows, FEED).repartition(3).write.parquet(str(tmp_path / "in"))
    log = changefeed.ChangeLogTable(spark, str(tmp_path / "log"))
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log.write_stream(stream, str(tmp_path / "cp")).awaitTermination()
    assert log.read().count() == 19


REFS = "table_name string, ref_field string, row_key string, kind string, ref_key long, ref_time timestamp_ntz"
PARENTS = "kind string, ref_key long, parent_added timestamp_ntz, parent_deleted timestamp_ntz"


def test_orphans_any_steps(spark):
    from datetime import datetime as D

    refs = [("t", "f", "1", "s", 10, D(2021, 3, 1)), ("t", "f", "1", "s", 10, D(2021, 3, 1)), ("t", "f", "2", "s", 11, D(2021, 4, 1)), ("t", "f", "3", "s", 12, D(2021, 4, 2)), ("t", "f", "4", "s", 13, D(2021, 4, 3)), ("t", "f", "5", "s", None, D(2021, 4, 3)), ("t", "f", "6", "x", 10, D(2021, 4, 3))]
    parents = [("s", 10, D(2020, 1, 1), None), ("s", 11, D(2022, 1, 1), None), ("s", 12, D(2020, 1, 1), D(2023, 1, 1)), ("s", 12, D(2020, 1, 1), None), ("s", None, D(2020, 1, 1), None)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    want = {("t", "f", "2", "late", "2021-04"), ("t", "f", "3", "deleted", "2021-04"), ("t", "f", "4", "missing", "2021-04"), ("t", "f", "6", "missing", "2021-04")}
    whole = orphans.step(None, df(refs, REFS), df(parents, PARENTS))
    assert {tuple(r) for r in orphans.pending(whole).collect()} == want
    state = orphans.step(None, df(refs[:3], REFS), df(parents[1:2], PARENTS))
    state = orphans.step(state, df(refs[3:], REFS), df(parents[2:], PARENTS))
    state = orphans.step(state, df(refs[:1], REFS), df(parents[:1], PARENTS))
    assert {tuple(r) for r in orphans.pending(state).collect()} == want
    assert orphans.pending(orphans.step(None, df([], REFS), df([], PARENTS))).count() == 0
    assert {(r["period"], r["open_orphans"]) for r in orphans.snapshots(whole).collect()} == {("2021-04", 3), ("2022-01", 2), ("2023-01", 3)}


def test_orphans_of_a_hot_key(spark, monkeypatch):
    """A key with most of the references is spread over copies of its index row, with the same result."""
    from datetime import datetime as D

    refs = [("t", "f", str(i), "s", 1 if i % 4 else i, D(2021, 3, 1)) for i in range(60)]
    parents = [("s", 1, D(2022, 1, 1), None), ("s", 4, D(2020, 1, 1), None)]
    df, pf = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    plain = {tuple(r) for r in orphans.pending(orphans.step(None, df, pf)).collect()}
    monkeypatch.setattr(orphans, "HOT_ROWS", 3)
    assert orphans.hot_keys(df) == [("s", 1)]
    state = orphans.step(None, df, pf)
    assert {tuple(r) for r in orphans.pending(state).collect()} == plain and len(plain) == 59
    assert {(r["period"], r["open_orphans"]) for r in orphans.snapshots(state).collect()} == {("2021-03", 59), ("2022-01", 14)}


def test_packed_parse():
    assert packed.parse('a; "b, c" / \'it\'\'s\' and d (x, y), 9,750 marks\n「e / f」|n/a|;-') == ["a", "b, c", "it's", "d (x, y)", "9,750 marks", "e / f"]
    assert packed.parse('"the ""old"" bell"\t"a \\"b\\" c"') == ['the "old" bell', 'a "b" c']
    assert packed.parse("heron's needle, moth's cup") == ["heron's needle", "moth's cup"]
    assert packed.parse("  ") == packed.parse("n/a") == packed.parse("—") == []
    assert packed.parse("rock and roll and [x; (y, z)]") == ["rock", "roll", "[x; (y, z)]"]
    for live, q in packed.dialects('a, "b; c" and d/e|f\tg'):
        assert packed.decode(packed.encode(live, q)) == (live, q)


def test_packed_unpack(spark):
    words = ["ash", "bone", "clay", "dust", "elm"]
    rng, rows = random.Random(1), []
    for i in range(300):
        sep = rng.choice([", ", "; ", " / ", "|", " and ", "\n"])
        rows.append((i, sep.join(rng.choice(words) for _ in range(rng.randint(1, 4))), "keep"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "n/a", "x"), (903, '"ash, bone"; elm', "x"), (904, "x" * 20000 + ", ash", "x"), (905, "ash,,elm", "x"), (905, "ash,,elm", "x")]
    out = packed.unpack(spark.createDataFrame(rows, "id int, raw string, dialect string").withColumn("vals", F.lit(1))).collect()
    got = sorted((r["id"], r["pos"], r["val"]) for r in out)
    assert got == sorted((i, p, v) for i, raw, _ in rows if raw for p, v in enumerate(packed.parse(raw), 1))
    assert packed.unpack(spark.createDataFrame([], "id int, raw string")).count() == 0


def test_packed_inert_separator(spark):
    """A mark that nearly always stands inside values is learned to be inert."""
    rows = [(i, f"left/right{i % 7} turn") for i in range(60)] + [(100 + i, "left/right3 turn; left/right5 turn") for i in range(20)]
    out = packed.unpack(spark.createDataFrame(rows, "id int, raw string")).where("id >= 100").collect()
    assert {r["pos"] for r in out} <= {1, 2, 3, 4}


def test_packed_all_subsets_of_many_kinds(spark):
    """Three inert and two live kinds of separators in one field."""
    kinds = {k for _, _, k in packed.cut_points("a/b|c+d, e; f")}
    assert {live for live, _ in packed.dialects("a/b|c+d, e; f")} == {frozenset(c) for n in range(6) for c in itertools.combinations(kinds, n)}
    words, held = ["moss", "fern", "reed", "clay", "salt"], ["oak/ash|elm+fir", "tin/lead|zinc+iron", "red/blue|tan+grey"]
    rows = [(i, f'"{held[i % 3]}", {words[i // 3 % 5]}; {words[(i // 3 + 2) % 5]}') for i in range(90)]
    rows += [(100 + k, f"{v}, {words[k]}; {words[k + 1]}") for k, v in enumerate(held)]
    out = packed.unpack(spark.createDataFrame(rows, "id int, raw string")).where("id >= 100").collect()
    assert {tuple(r) for r in out} == {(100 + k, p, v) for k, h in enumerate(held) for p, v in enumerate([h, words[k], words[k + 1]], 1)}


def test_text_functions(spark):
    assert one(spark, text.slug, "a string", " Bigby's Hand! ", "") == ["bigby-s-hand", ""]
    assert one(spark, lambda c: text.slug(c, True), "a string", "Bigby’s Hand") == ["bigbys-hand"]
    assert one(spark, text.name_key, "a string", "Cloak’s  End (M, XP)", None) == ["cloak's end", None]
    assert one(spark, text.compact_key, "a string", "Cloak's End (F)") == ["cloaksend"]
    assert one(spark, text.invert_comma, "a string", "Cloak, Greater", "Cloak") == ["Greater Cloak", "Cloak"]
    assert one(spark, text.strip_html, "a string", "<p>a&nbsp;b</p><p>c &lt; d</p>") == ["a b c < d"]
    assert one(spark, text.escape_html, "a string", 'a<b & "c"') == ["a&lt;b &amp; &quot;c&quot;"]
    assert one(spark, text.tokens, "a string", "It's 3d6, OK?") == [["it's", "3d6", "ok"]]
    assert [tuple(x) for x in one(spark, text.level_parts, "a string", "3 (arcane)", "x", None)] == [(3, "arcane"), (None, None), (None, None)]
    assert [tuple(x) for x in one(spark, text.appearance_parts, "a string", "Big Book 128", "Book")] == [("Big Book", 128), ("Book", None)]
    assert [tuple(x) for x in one(spark, text.list_extra, "a string", "(Air)", "see text", "Air", " ", "a or b")] == [("Air", None, None), (None, "see text", "list.extra.review"), ("Air", None, None), (None, None, None), (None, "a or b", "list.extra.review")]
    assert one(spark, text.bracket_groups, "a string", "a (b (c)) （d） (e", None) == [["b (c)", "d"], []]
    assert one(spark, text.nfkc, "a string", "Ａ①", None) == ["A1", None]
    assert one(spark, text.strip_marks, "a string", "é") == ["e"]
    assert one(spark, text.mostly_english, "a string", "abc", "ab", "火球术abc") == [True, False, False]
    assert one(spark, text.text_issues, "a string", "", "ok.", "<b>x") == [["empty"], [], ["raw-html", "no-terminal"]]
    assert one(spark, text.clean, "a string", "  ", " a ") == [None, "a"]
    assert one(spark, lambda c: text.fold_fullwidth(text.fold_typography(c)), "a string", "１’s：“x”") == ["1's:\"x\""]


def test_orders_and_flags(spark):
    df = spark.createDataFrame([(w,) for w in ["Zebra", "acid", "élan", "Acid", "bolt"]], "a string")
    assert [r["a"] for r in df.orderBy(text.locale_order(F.col("a"))).collect()] == ["acid", "Acid", "bolt", "élan", "Zebra"]
    ten, nine, none = one(spark, text.numeric_order, "a string", "Book 10", "Book 9", None)
    assert nine < ten and none is None
    assert spark.range(1).select(text.true_flags(F.array(F.lit("x"), F.lit("y")), F.array(F.lit(True), F.lit(False)))).first()[0] == {"x": True}


def test_mechanics(spark):
    m = lambda t, *v: [(r["category"], r["amount"], r["unit"], r["normalized_text"], r["coverage"]) for r in one(spark, mechanics.READERS[t], "a string", *v)]
    assert m("casting_time", "1 standard action", "10 minutes", "1 round; see text", None, "see text") == [("standard_action", 1, "action", "1 standard action", "complete"), ("minute", 10, "minute", "10 minutes", "complete"), ("round", 1, "round", None, "partial"), ("empty", None, None, None, "empty"), ("special", None, None, None, "review")]
    assert m("range", "Close (25 ft. + 5 ft./2 levels)", "60 ft.", "1 mile", "Touch or 5 ft.", "Sight")[:4] == [("close", None, None, "Close (25 ft. + 5 ft./2 levels)", "complete"), ("fixed", 60, "ft", "60 ft.", "complete"), ("fixed", 1, "mile", "1 mile", "complete"), ("touch", None, None, None, "partial")]
    assert m("duration", "1 round/level (D)", "Permanent", "Concentration + 2 rounds") == [("timed", 1, "round", "1 round/level (D)", "complete"), ("permanent", None, None, "Permanent", "complete"), ("concentration", None, None, None, "partial")]
    assert m("saving_throw", "Will negates (harmless)", "none", "no save") == [("will", None, None, "Will negates (harmless)", "complete"), ("none", None, None, "None", "complete"), ("none", None, None, None, "partial")]
    assert m("spell_resistance", "Yes (object)", "no; see text", "maybe")[0][3] == "Yes (object)"
    full = lambda t, v: one(spark, mechanics.READERS[t], "a string", v)[0].asDict()
    assert full("duration", "1 round/level (D)") == {"category": "timed", "amount": 1, "unit": "round", "flags": "dismissible,per_level", "normalized_text": "1 round/level (D)", "coverage": "complete", "issue_code": None}
    assert (x := full("duration", "1 round/level or until discharged"))["category"] == "timed" and x["coverage"] == "partial" and x["normalized_text"] is None and x["flags"] == "discharge"
    assert (x := full("target", "One creature/level, no two of which can be more than 30 ft. apart"))["category"] == "creature" and x["coverage"] == "partial"
    assert full("range", "See text")["issue_code"] == "range.review" and full("spell_resistance", None)["coverage"] == "empty"
    assert full("casting_time", "2 full-round action")["normalized_text"] == "2 full-round actions" and full("casting_time", "swift action or 1 immediate action")["category"] == "immediate_action"
    assert full("range", "1 miles")["normalized_text"] == "1 mile" and full("range", "close")["normalized_text"] == "Close (25 ft. + 5 ft./2 levels)" and full("range", "20 feet")["normalized_text"] == "20 ft."
    assert full("saving_throw", "Reflex half (object, harmless)")["flags"] == "allows_save,half,harmless,object,reflex" and full("saving_throw", "no")["normalized_text"] == "None"
    for t in mechanics.TYPES:
        assert all(x == [] for x in one(spark, lambda c: mechanics.display_errors(mechanics.READERS[t](c)), "a string", "1 round", "x", None, "will half", "yes"))


def test_filters(spark):
    assert filters.parse_ids("3, x,1,3,") == [1, 3] and filters.parse_ids(None) == []
    assert filters.clamp(None, 1, 100, 20) == 20 and filters.clamp(500, 1, 100, 20) == 100
    assert filters.known_keys("b, z,a", ["a", "b"]) == ["a", "b"]
    assert filters.long_enough("火") and not filters.long_enough("a")
    rows, facets = spark.createDataFrame([(1,), (2,), (None,)], "id int"), spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (None, "a")], "id int, m string")
    assert [r[0] for r in filters.with_all(rows, facets, "id", "m", ["a", "b"]).collect()] == [1]
    assert filters.with_all(rows, facets, "id", "m", []).count() == 3
    assert rows.where(filters.and_of_ors({"x": []})).count() == 3
    assert {r[0] for r in filters.with_facet(rows, facets, "id", F.col("m") == "a").collect()} == {1, 2}


def test_browse(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    c = spark.createDataFrame([(1, 2), (1, 1), (3, 9)], "id int, v int")
    assert [(r["id"], [x["v"] for x in r["vs"]]) for r in browse.hydrate(p, "id", {"vs": (c, ["v"])}).orderBy("id").collect()] == [(1, [1, 2]), (2, [])]
    t = spark.createDataFrame([(1, "zh", "chm", " "), (1, "zh", "default", "甲"), (2, "zh", "default", None)], "id int, lang string, variant string, name string")
    assert {tuple(r) for r in browse.overlay(p, t, "id", "zh", ["default", "chm"], ["name"]).collect()} == {(1, "甲"), (2, "b")}
    assert [r["id"] for r in browse.in_order([2, 1, 2, 7], p, "id").orderBy("pos").collect()] == [2, 1, 2]
    assert [r["id"] for r in browse.missing_of([7, 2, 7], p, "id").collect()] == [7]
    assert browse.with_total(browse.page(p, [F.col("id")], 2, 1), p).collect() == [(2, "b", 2)]


def test_search(spark):
    assert search.query_tokens("wall of Fire wall") == ["wall", "Fire"]
    docs = spark.createDataFrame([(1, "wall of fire", "x"), (2, "walled", "fire fire"), (3, None, "none"), (4, "aaaa", "")], "id int, name string, body string")
    got = search.bm25(docs, {"name": 12.0, "body": 1.0}, "wall fire").orderBy(F.col("score").desc()).collect()
    assert [r["id"] for r in got] == [1, 2]
    assert search.bm25(docs, {"name": 1.0}, "ab").count() == 0
    assert docs.where("id = 4").select(search.occurrences(F.col("name"), "aa")).first()[0] == 3
    assert search.bm25(docs, {"name": 1.0}, "wall", F.col("id") == 2).count() == 1
    assert search.bm25(docs.limit(0), {"name": 1.0}, "wall").count() == 0
    state = spark.createDataFrame([(1, 5)], "schema_version int, document_count long")
    assert search.index_usable(state) and not search.index_usable(state.limit(0))


def test_resolve(spark):
    names = spark.createDataFrame([("a",), ("x",), ("p",), (None,)], "name string")
    al = spark.createDataFrame([("A", "b"), ("b", "c"), ("p", "q"), ("q", "p"), (None, "z")], "from_name string, to_name string")
    assert {tuple(r) for r in resolve.alias_chain(names, al).collect()} == {("a", "c", 2), ("x", "x", 0), ("p", "q", 1), (None, None, 0)}
    m = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("a", 1)], "name string, id int")
    ns = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert {tuple(r) for r in resolve.classify(m, "name", "id", ns).collect()} == {("a", "resolved", 1, 1), ("b", "ambiguous", 2, None), ("c", "not_found", 0, None)}
    assert {tuple(r) for r in resolve.first_that_matches(ns, "name", "id", [m.where("name = 'b'"), m]).collect()} == {("b", 1), ("b", 2), ("a", 1)}
    look = spark.createDataFrame([("Book", 1), ("BK", 1), ("two", 2), ("TWO", 3)], "key string, target int")
    rows = spark.createDataFrame([(1, " book"), (2, "two"), (3, None)], "id int, label string")
    assert {(r["id"], r["target"], r["rule"]) for r in resolve.resolve_label(rows, F.col("label"), [("all", look)]).collect()} == {(1, 1, "all"), (2, None, None), (3, None, None)}
    pre = resolve.prefix_join(spark.createDataFrame([(1, "Wall of fire"), (2, "Wallow")], "id int, t string"), spark.createDataFrame([("wall",), ("Wall of",)], "h string"), "t", "h")
    assert {(r["id"], r["h"]) for r in pre.collect()} == {(1, "wall"), (1, "Wall of")}
    same = resolve.same_key_links(spark.createDataFrame([("k", 1, None), ("k", 2, None), ("k", 3, "x"), (None, 4, "x")], "k string, id int, t string"), "k", "id", "t")
    assert {tuple(r) for r in same.collect()} == {(1, 1, 2, 1), (2, 1, 2, 1), (3, 1, 2, 0), (4, None, 0, 0)}


def test_text_edits_fold(spark):
    texts = spark.createDataFrame([(1, "One cat. Two dogs. Three cats.", {"area": "two  dogs’ den"}), (2, None, None), (3, "One cat. A bird", {}), (4, "Keep A. Drop A x. Keep A too.", None), (5, "The spell slows them for 1d6 rounds. A slowed creature moves. It rests. The spell then ends.", None)], "id int, t string, f map<string,string>")
    rows = [
        (1, 1, "replace", "Two", "Four", None, None, None), (1, 2, "replace", "dogs' den", "cats' den", None, None, None), (1, 3, "delete", "Three cats.", None, None, None, None), (1, 4, "replace", "zzz", "q", None, None, None), (1, 5, "delete", "zzz", None, None, None, None), (1, 6, "replace", "cat", "cow", None, "last", None),
        (3, 1, "replace_first_sentence", None, "A dog.", None, None, None), (3, 2, "replace_first_sentence", None, "A dog.", None, None, None), (3, 3, "insert_before", "bird", "blue", None, None, "-"), (3, 4, "fly", None, None, None, None, None),
        (4, 1, "delete_sentences", "Drop A", None, 1, None, None), (4, 2, "delete_sentences", "Keep A too", None, 5, None, None),
        (5, 1, "insert_before_sentence_end", "A slowed creature", "(see the slow spell)", None, None, None), (5, 2, "delete_sentences", "A slowed creature", None, 2, None, None),
        (2, 1, "replace_full_body", None, "New.", None, None, None), (2, 2, "replace_full_body", None, " New. ", None, None, None),
    ]
    edits = spark.createDataFrame(rows, "id int, edit_no int, op string, find string, value string, count int, occurrence string, separator string")
    got = {r["id"]: (r["text"], r["fields"], r["statuses"]) for r in reconcile.apply_text_edits(texts, edits, "id", "t", "f").collect()}
    assert got[1] == ("One cow. Four dogs.", {"area": "two cats' den"}, ["applied", "applied", "applied", "target-not-found", "already-present", "applied"])
    assert got[3] == ("A dog. A blue-bird", {}, ["applied", "already-present", "applied", "unknown-op"])
    assert got[4][0] == "Keep A. Keep A too." and got[4][2] == ["applied", "target-not-found"]
    assert got[5][0] == "The spell slows them for 1d6 rounds (see the slow spell). The spell then ends." and got[5][2] == ["applied"] * 2
    assert got[2] == (" New. ", {}, ["applied", "already-present"])
    bare = reconcile.apply_text_edits(texts, edits.select("id", "edit_no", "op", "find", "value").limit(0), "id", "t").collect()
    assert all(r["statuses"] == [] for r in bare) and len(bare) == 5


def test_merge_reviews(spark):
    cols = "id int, category string, evidence_ids string, flags string, fingerprint string, status string"
    prev = spark.createDataFrame([(1, "a", "e", None, "f", "accepted"), (2, "a", "e", "x", "f", "proposed"), (3, "a", "e", "x", "f", "accepted")], cols)
    new = spark.createDataFrame([(1, "a", "e", None, "f", "proposed"), (2, "a", "e", "x", "f", "rejected"), (3, "a", "e", "y", "f", "proposed"), (4, "a", "e", "x", "f", "proposed")], cols)
    status = lambda full: [(r["status"], r["carried"]) for r in reconcile.merge_reviews(prev, new, "id", full).orderBy("id").collect()]
    assert status(False) == [("accepted", True), ("proposed", True), ("proposed", False), ("proposed", False)]
    assert status(True)[1] == ("rejected", False)


def test_search_index(spark, tmp_path):
    docs = spark.createDataFrame([(100, "en", "default", "Wall of Fire", "", "", "", "x"), (2, "en", "default", "Shield", "wall and fire", "", "", ""), (2, "zh", "default", "墙", "", "", "", "none"), (3, "en", "default", "Walled", "", "", "", "")], "spell_id int, lang string, variant string, name string, aliases string, summary string, mechanics string, body string")
    index = search.SearchIndex(spark, str(tmp_path))
    index.write(docs)
    assert [r["spell_id"] for r in index.search("wall fire").orderBy(F.col("score").desc()).collect()] == [100, 2]
    scan = {r["spell_id"]: round(r["score"], 9) for r in search.bm25(docs, search.WEIGHTS, "wall").groupBy("spell_id").agg(F.max("score").alias("score")).collect()}
    assert {r["spell_id"]: round(r["score"], 9) for r in index.search("WALL").collect()} == scan and len(scan) == 3
    assert index.search("wall", eligible=docs.where("spell_id = 2")).count() == 1 and index.search("ab").count() == 0 and index.search("zzz").count() == 0
    index.write(docs.limit(0))
    with pytest.raises(search.IndexUnusable):
        index.search("wall")


def test_search_documents(spark):
    spells = spark.createDataFrame([(1, "Wall", "wall-of-x", "Body", "1 round")], "spell_id int, name string, slug string, description string, casting_time string")
    texts = spark.createDataFrame([(1, "zh", "default", "墙", None), (1, "zh", "default", None, None), (9, "zh", "default", "无", "无")], "spell_id int, lang string, variant string, name string, description_text string")
    sums = spark.createDataFrame([(1, "zh", "b", "two"), (1, "zh", "default", "one"), (1, "zh", "default", "ONE")], "spell_id int, lang string, variant string, summary_text string")
    mech = spark.createDataFrame([(1, 1, "1 round", "1 Round", "round")], "spell_id int, place int, normalized_text string, raw_text string, category string")
    got = {(r["lang"], r["variant"]): (r["name"], r["aliases"], r["summary"], r["mechanics"], r["body"]) for r in search.build_documents(spells, texts, sums, mech, ["casting_time"]).collect()}
    assert got == {("en", "default"): ("Wall", "wall of x\n墙", "", "1 round\nround", "Body"), ("zh", "default"): ("墙", "Wall\nwall of x", "ONE\ntwo", "1 round\nround", ""), ("zh", "b"): ("Wall", "wall of x\n墙", "two\nONE", "1 round\nround", "")}


def test_canonical_strings(spark):
    assert one(spark, text.match_name, "a string", "Cloak,  Greater", "Bolt (M)", None) == ["cloak greater", "bolt", None]
    assert one(spark, text.name_variants, "a string", "A / B 2", "Fire/fire", "Up/Down") == [["A", "B 2", "B"], ["Fire/fire", "Fire", "fire"], ["Up/Down"]]
    assert one(spark, lambda c: text.name_variants(c, F.create_map(F.lit("a"), F.array(F.lit("Z")))), "a string", "A") == [["A", "Z"]]
    assert one(spark, text.school_key, "a string", "Evocation (b, A) [Fire and cold]", "Abjuration", "x [y] z") == ["evocation|a,b|cold,fire", "abjuration||", "x y z"]
    assert one(spark, text.level_key, "a string", "Sor/Wiz 3, Clr 2, Fire 4, junk") == ["cleric 2,fire 4,sor/wiz 3"]
    assert [[tuple(e) for e in x] for x in one(spark, text.level_entries, "a string", "Clr 2, Fire 4", "")] == [[("Cleric", 2, False), ("Fire", 4, True)], []]
    assert one(spark, lambda c: text.tolerant_json(c, "map<string,string>"), "a string", '{"a": 1}', "{bad", None) == [{"a": "1"}, None, None]
    assert one(spark, text.iso_date, "a string", "2021-3-1", "March 1, 2021", "Sep 12 2003", "1999", "2001/7", "soon", None) == ["2021-03-01", "2021-03-01", "2003-09-12", "1999", "2001-07", None, None]
    assert one(spark, lambda c: text.composite_id(c, F.lit(3)), "a string", "x", None) == ["x:3", "-:3"]
    assert one(spark, lambda c: text.stable_json({"b": c, "a": F.lit(1)}), "a string", None) == ['{"a":1,"b":null}']
    big, small = one(spark, text.numeric_order, "a string", "a1234567890123456", "a123456789013")
    assert small < big and one(spark, text.numeric_order, "a string", "a007") == one(spark, text.numeric_order, "a string", "a7")


def test_body_blocks_and_numerals(spark):
    df = spark.createDataFrame([(["a", "\ue000x\ue001y\ue001\ue002 b ", "\ue001p", "q"],), ([],), (None,)], "p array<string>")
    got = [[(b["kind"], b["text"] or b["cells"]) for b in r[0]] for r in df.select(text.body_blocks("p")).collect()]
    assert got == [[("paragraph", "a"), ("table-row", ["x", "y", ""]), ("paragraph", "b"), ("table-row", ["p", "q"])], [], []]
    assert one(spark, text.fold_roman, "a string", "Bell Ⅳ", None) == ["Bell IV", None]
    assert [[tuple(x) for x in r] for r in one(spark, text.appearances, "a string", "Book 12;  ; Other", "")] == [[("Book", 12), ("Other", None)], []]
    assert one(spark, text.unicode_tokens, "a string", "Ab-1 火球") == [["ab", "1", "火球"]]


def test_lookup_ids(spark):
    look = spark.createDataFrame([(" Fire", 1, 1), ("fire", 2, 2), ("ice", 3, 3)], "key string, target int, place int")
    rows = spark.createDataFrame([(1, "FIRE "), (2, "x"), (3, " "), (4, None)], "id int, label string")
    assert [(r["target"], r["error"]) for r in resolve.lookup_ids(rows, "label", look, "place", True).orderBy("id").collect()] == [(2, None), (None, "not-found"), (None, "required"), (None, "required")]
    assert {r["error"] for r in resolve.lookup_ids(rows, "label", look, "place").where("id > 2").collect()} == {None}
    more = spark.createDataFrame([("b", "Z"), ("A", "q")], "from_name string, to_name string")
    chain = spark.createDataFrame([("a", "b")], "from_name string, to_name string")
    assert {tuple(r) for r in resolve.alias_names(spark.createDataFrame([("a",), (None,)], "name string"), chain, more).collect()} == {("a", "a"), ("a", "b"), ("a", "Z"), ("a", "q")}


def test_reconcile_edges(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    assert {tuple(r) for r in reconcile.upsert_plan(a, b, "k", ["v"]).collect()} == {(1, "unchanged"), (2, "unchanged"), (3, "inserted")}
    assert reconcile.first_mismatch(a, b, "k", ["v"]).collect() == [(3, "_row")]
    empty = a.limit(0)
    assert reconcile.token_overlap(a, b, "k", "v").where("k = 2").select("recall", "precision").collect() == [(1.0, 1.0)]
    assert reconcile.membership(empty, empty, "k").count() == 0
    c = spark.createDataFrame([(1, "A  b", False), (1, "a B", False), (2, "x", True), (2, "y", False), (3, "x", False), (3, "y", False), (4, None, True)], "k int, t string, p boolean")
    assert {tuple(r) for r in reconcile.conflicts(c, "k", "t", F.col("p")).collect()} == {(3, 2)}


def test_pivot_counts_every_key_and_category(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 5), (2, 9), (2, None), (None, 5)], "book int, school int")
    books, schools = spark.createDataFrame([(1,), (2,), (3,)], "book int"), spark.createDataFrame([(5,), (1,), (4,), (None,)], "school int")
    out = reconcile.pivot_counts(rows, books, schools, "book", "school", "s")
    assert out.columns == ["book", "s1", "s4", "s5", "other"]
    assert {tuple(r) for r in out.collect()} == {(1, 2, 0, 1, 0), (2, 0, 0, 0, 2), (3, 0, 0, 0, 0), (None, 0, 0, 1, 0)}
    empty = reconcile.pivot_counts(rows, books, schools.limit(0), "book", "school", "s")
    assert {tuple(r) for r in empty.collect()} == {(1, 3), (2, 2), (3, 0), (None, 1)}


def test_pivot_covers_every_spell_and_rulebook(spark):
    from loomspark.plans import records

    d = "/root/testdata/sf0.001"
    out = [r.asDict() for r in records.q_pivot_all_schools(spark, d).collect()]
    assert sum(v for r in out for k, v in r.items() if k != "rulebook_id") == spark.read.parquet(f"{d}/dnd_spell.parquet").count()
    assert len(out) == spark.read.parquet(f"{d}/lookup_entry.parquet").where("kind = 'rulebook'").count()


def test_layout(spark):
    df = spark.createDataFrame([("a", 1, 1.0, "H"), ("a", 2, 1.5, None), ("a", 3, 9.0, "I"), ("b", 1, 0.0, None)], "k string, o int, y double, s string")
    far = F.abs(F.col("y") - F.lag("y").over(layout.ordered(["k"], "o"))) > 2
    assert [r["island"] for r in layout.islands(df, ["k"], ["o"], far).orderBy("k", "o").collect()] == [0, 0, 1, 0]
    assert [r["f"] for r in layout.fill_forward(df, ["k"], ["o"], "s", "f").orderBy("k", "o").collect()] == ["H", "H", "I", None]
    assert {tuple(r) for r in layout.segments(df, ["k"], ["o"], F.col("s").isNotNull()).collect()} == {("a", 1, 1, 2), ("a", 2, 3, 3)}
    assert [r["n"] for r in layout.ahead(df, ["k"], ["o"], F.col("s") == "I", 2, "n").orderBy("k", "o").collect()] == [True, True, False, False]
    assert spark.range(1).select(layout.tolerance_distinct(F.array(F.lit(1.0), F.lit(2.5), F.lit(3.5), F.lit(9.0)), 2.0)).first()[0] == [1.0, 3.5, 9.0]
    lines = spark.createDataFrame([("a", 1, "bro-"), ("a", 2, "ken line"), ("a", 3, "end")], "k string, o int, line string")
    assert layout.join_lines(lines, ["k"], ["o"], "line").collect() == [("a", "broken line end")]


def test_normalize_round_trip(spark):
    cols = {f"{c}_component": i % 2 == 0 for i, c in enumerate(normalize.COMPONENTS)}
    df = spark.createDataFrame([(1, *cols.values()), (2, *[None] * 9)], "id int, " + ", ".join(f"{c} boolean" for c in cols))
    back = {r["spell_id"]: r.asDict() for r in normalize.components_wide(normalize.components(df)).collect()}
    assert {k: v for k, v in back[1].items() if k != "spell_id"} == cols and not any(v for k, v in back[2].items() if k != "spell_id")


def test_orphan_brute_force(spark):
    rng = random.Random(5)
    from datetime import datetime, timedelta

    day = lambda n: datetime(2021, 1, 1) + timedelta(days=n)
    refs = [("t", "f", str(i), "s", rng.randint(0, 30), day(rng.randint(0, 300))) for i in range(300)]
    parents = [("s", k, day(rng.randint(0, 300)), day(400) if rng.random() < 0.2 else None) for k in range(0, 30, 2)]
    by = {p[1]: p for p in parents}
    want = {(r[2], "missing" if r[4] not in by else "deleted" if by[r[4]][3] else "late") for r in refs if r[4] not in by or by[r[4]][3] or by[r[4]][2] > r[5]}
    got = orphans.pending(orphans.step(None, spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))).collect()
    assert {(r["row_key"], r["reason"]) for r in got} == want


def test_bm25_index_is_complete(spark):
    words = ["lantern", "land", "ant", "tern", "lan", "ern"]
    docs = spark.createDataFrame([(i, " ".join(c)) for i, c in enumerate(itertools.permutations(words, 3))], "id int, t string")
    idx = search.postings(docs, "id", ["t"])
    maybe = {r["id"] for r in search.candidates(idx, "id", "LANTERN").collect()}
    assert {r["id"] for r in docs.where("t like '%lantern%'").collect()} <= maybe
