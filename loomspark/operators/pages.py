"""Pages of positioned text put together: reading lines, entities behind headings, tables by coordinates, evidence of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.text import squeeze
from loomspark.operators.layout import ahead, tolerance_distinct

#: A line ends where the next visible item is more than this above or below.
BASELINE = 2.0
#: Items further apart than this have a blank between them.
GAP = 1.0
# Marks before which, and after which, no blank is put.
_NO_BLANK_BEFORE, _NO_BLANK_AFTER = r"^[,.;:!?\])}]", r"[(\[{]$"


def numbered_items(items: DataFrame, page: list[str], order: str) -> DataFrame:
    """items (text, x, y, width, height, has_eol) with line, the number of their line on the page from 0, and _visible.

    A line ends at an item with has_eol, and before a visible item that is off the baseline, which is where the last
    visible item before it stands.
    """
    w = Window.partitionBy(*page).orderBy(order)
    visible = F.trim(F.regexp_replace("text", r"\s+", " ")) != ""
    base = F.last(F.when(visible, F.col("y")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = items.where("text is not null").withColumn("_visible", visible).withColumn("_base", base).withColumn("_eol", F.coalesce(F.lag("has_eol").over(w), F.lit(False)))
    off = F.col("_visible") & F.coalesce(F.abs(F.col("y") - F.col("_base")) > BASELINE, F.lit(False))
    return marked.withColumn("line", F.sum((F.col("_eol") | off).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_base", "_eol")


def joined_items(items: DataFrame, group: list[str], order: str) -> DataFrame:
    """group, text: the items of each group in order as one text, with a blank where two stand apart and no mark forbids it."""
    w = Window.partitionBy(*group).orderBy(order)
    some = items.where("text != ''")
    before, edge = F.lag("text").over(w), F.lag(F.col("x") + F.col("width")).over(w)
    apart = before.isNotNull() & ~before.rlike(r"\s$") & ~F.col("text").rlike(r"^\s") & ~F.col("text").rlike(_NO_BLANK_BEFORE) & ~before.rlike(_NO_BLANK_AFTER) & (F.col("x") - edge > GAP)
    spaced = some.withColumn("_t", F.concat(F.when(F.coalesce(apart, F.lit(False)), " ").otherwise(""), "text"))
    return spaced.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), "").alias("_j")).select(*group, squeeze(F.col("_j")).alias("text"))


def reading_lines(items: DataFrame, page: list[str], order: str) -> DataFrame:
    """page, line (from 0, blank ones left out), text, x, y, height of the lines of each page; see numbered_items and joined_items.

    x is the least of the line's visible items, y and height the greatest.
    """
    rows = numbered_items(items, page, order)
    shape = rows.where("_visible").groupBy(*page, "line").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.max("height").alias("height"))
    out = shape.join(joined_items(rows, [*page, "line"], order), [*page, "line"])
    place = (F.row_number().over(Window.partitionBy(*page).orderBy("line")) - 1).cast("int")
    return out.where("text != ''").select(*page, place.alias("line"), "text", "x", "y", "height")


def clustered_lines(items: DataFrame, page: list[str], tolerance: float = 1.5) -> DataFrame:
    """page, text: all items of a page, those whose y is within tolerance of a line's first one on one line, lines from top to bottom and items from left to right.

    Lines are told from top to bottom, so a line is named by its topmost item.
    """
    tops = items.where("text is not null").groupBy(*page).agg(tolerance_distinct(F.transform(F.collect_set("y"), lambda y: -y), tolerance).alias("_tops"))
    near = F.element_at(F.filter("_tops", lambda t: t <= -F.col("y")), -1)
    rows = items.where("text is not null").join(tops, page).withColumn("_top", near)
    lines = joined_items(rows.withColumn("_o", F.struct("x", "text")), [*page, "_top"], "_o")
    return lines.where("text != ''").groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_top", "text"))), lambda x: x["text"]), " ").alias("text"))


def join_wrapped(lines: Column, drop_hyphen: bool) -> Column:
    """An array of lines as one text. A line that ends in a hyphen runs on: with drop_hyphen only before a small letter, and then the hyphen goes; without, it always stays."""
    parts = F.filter(F.transform(lines, lambda x: squeeze(x)), lambda x: x != "")
    if drop_hyphen:
        step = lambda acc, x: F.when(acc.rlike("[-‐‑]$") & x.rlike(r"^\p{Ll}"), F.concat(acc.substr(F.lit(1), F.length(acc) - 1), x)).when(acc == "", x).otherwise(F.concat(acc, F.lit(" "), x))
    else:
        step = lambda acc, x: F.when((acc == "") | acc.endswith("-"), F.concat(acc, x)).otherwise(F.concat(acc, F.lit(" "), x))
    return F.aggregate(parts, F.lit(""), step)


def heading_entities(lines: DataFrame, document: str, order: str, text: str, next_line: str, field: str, within: int = 4) -> DataFrame:
    """document, entity_no, name, start, n_lines, body, issue: what stands behind each heading of a document.

    A heading is a line of a capital first letter without a colon or full stop whose next line matches next_line and of
    whose next `within` lines one matches field. Lines before the first heading belong to none. issue is no-body where
    only the heading is there, and duplicate-name where the document has the name twice.
    """
    w = Window.partitionBy(document).orderBy(order)
    shape = F.col(text).rlike(r"^\p{Lu}[\p{L}\p{N}’'(),/\- ]+$") & ~F.col(text).rlike(r"[.!?]$") & ~F.col(text).contains(":")
    rows = ahead(lines.withColumn("_next", F.lead(text).over(w)), [document], [order], F.coalesce(F.col(text).rlike(field), F.lit(False)), within, "_field")
    rows = rows.withColumn("_head", F.coalesce(shape & F.col("_next").rlike(next_line) & F.col("_field"), F.lit(False)))
    rows = rows.withColumn("entity_no", F.sum(F.col("_head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).where("entity_no > 0")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct(order, text)))), lambda x: x[text])
    out = rows.groupBy(document, "entity_no").agg(F.max(F.when(F.col("_head"), F.col(text))).alias("name"), F.min(order).alias("start"), F.count("*").alias("n_lines"), join_wrapped(body, False).alias("body"))
    twice = F.count("*").over(Window.partitionBy(document, F.lower("name"))) > 1
    return out.withColumn("issue", F.when(F.col("body") == "", "no-body").when(twice, "duplicate-name"))


def block_evidence(lines: DataFrame, blocks: DataFrame, page: str, order: str, text: str) -> DataFrame:
    """page, block_id, text, n_lines, sha256 of each block (page, block_id, first, last: places of lines, both included); a block without lines has an empty text."""
    hits = blocks.join(lines.select(page, order, text), page, "left").where(F.col(order).isNull() | F.col(order).between(F.col("first"), F.col("last")))
    told = hits.groupBy(page, "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text)))), lambda x: x[text]), "\n").alias("text"), F.count(text).alias("n_lines"))
    out = blocks.select(page, "block_id").join(told, [page, "block_id"], "left").withColumn("text", F.coalesce("text", F.lit(""))).na.fill(0, ["n_lines"])
    return out.withColumn("sha256", F.sha2("text", 256))


def coordinate_table(items: DataFrame, page: str, columns: DataFrame, heading: Column) -> DataFrame:
    """page, section, row_no, column_no, text: the cells of tables laid out by coordinates, y growing upwards.

    columns (page, column_no, x_min, x_max) are the column ranges, half open. heading says which items open a section,
    which goes down to the next heading. The rows of a section are named by the items of its first column; any other
    item belongs to the row whose band, between the middles of neighbouring rows, holds it.
    """
    placed = items.join(columns, page).where((F.col("x") >= F.col("x_min")) & (F.col("x") < F.col("x_max")))
    marked = placed.withColumn("_h", heading)
    heads = marked.where("_h").select(page, F.col("y").alias("_top"), F.col("text").alias("section")).distinct()
    heads = heads.withColumn("_bottom", F.coalesce(F.lead("_top").over(Window.partitionBy(page).orderBy(F.col("_top").desc())), F.lit(float("-inf"))))
    body = marked.where(~F.col("_h")).join(heads, page).where((F.col("y") < F.col("_top")) & (F.col("y") > F.col("_bottom")))
    w = Window.partitionBy(page, "_top").orderBy(F.col("y").desc())
    rows = body.where("column_no = 0").select(page, "_top", "y").distinct()
    above, below = F.lag("y").over(w), F.lead("y").over(w)
    bands = rows.select(page, "_top", (F.row_number().over(w) - 1).alias("row_no"), F.coalesce((above + F.col("y")) / 2, F.lit(float("inf"))).alias("_from"), F.coalesce((below + F.col("y")) / 2, F.lit(float("-inf"))).alias("_to"))
    cells = body.join(bands, [page, "_top"]).where((F.col("y") <= F.col("_from")) & (F.col("y") > F.col("_to")))
    return cells.groupBy(page, "section", "row_no", "column_no").agg(squeeze(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("y"), "x", "text"))), lambda t: t["text"]), " ")).alias("text"))


def located_entry(lines: DataFrame, page: str, order: str, text: str, x: str, starts: Column, entry: Column, most: float = 24.0) -> DataFrame:
    """page, n_found, text: the one line for which starts holds, with the lines that continue it, until one is off to the side by more than most or opens another entry; text is null where no line or several are found."""
    w = Window.partitionBy(page).orderBy(order)
    rows = lines.withColumn("_s", F.coalesce(starts, F.lit(False))).withColumn("_e", F.coalesce(entry, F.lit(False)))
    rows = rows.withColumn("_n", F.sum(F.col("_s").cast("int")).over(Window.partitionBy(page)))
    at = F.last(F.when(F.col("_s"), F.col(x)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = ~F.col("_s") & (F.col("_e") | (F.abs(F.col(x) - F.col("_at")) > most))
    rows = rows.withColumn("_at", at).where("_at is not null or _n = 0").withColumn("_over", F.max(F.coalesce(ends, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = (F.col("_n") == 1) & (F.col("_over") == 0)
    told = rows.groupBy(page).agg(F.max("_n").cast("int").alias("n_found"), F.transform(F.array_sort(F.collect_list(F.when(one, F.struct(order, text)))), lambda t: t[text]).alias("_t"))
    return told.select(page, "n_found", F.when(F.col("n_found") == 1, join_wrapped(F.col("_t"), True)).alias("text"))


def blocks_by_page(blocks: DataFrame) -> DataFrame:
    """page, n_blocks, kinds, texts: layout blocks (page, place, kind, text) grouped by page in their order."""
    packed = blocks.groupBy("page").agg(F.count("*").alias("n_blocks"), F.array_sort(F.collect_list(F.struct("place", "kind", "text"))).alias("_b"))
    return packed.select("page", "n_blocks", F.transform("_b", lambda b: b["kind"]).alias("kinds"), F.transform("_b", lambda b: b["text"]).alias("texts"))


def ranked_neighbours(left: DataFrame, right: DataFrame, page: str, most_h: float, most_v: float) -> DataFrame:
    """page, a_id, b_id, place of the boxes of right (b_id, bx0, by0, bx1, by1) within most_h sideways and most_v up or down of each box of left (a_id, ax0, ...), nearest first by vertical, then horizontal distance, then id; place from 1."""
    gap = lambda a0, a1, b0, b1: F.greatest(F.lit(0.0), F.col(b0) - F.col(a1), F.col(a0) - F.col(b1))
    j = left.join(right, page).withColumn("h", gap("ax0", "ax1", "bx0", "bx1")).withColumn("v", gap("ay0", "ay1", "by0", "by1")).where((F.col("h") <= most_h) & (F.col("v") <= most_v))
    return j.select(page, "a_id", "b_id", F.row_number().over(Window.partitionBy(page, "a_id").orderBy("v", "h", "b_id")).alias("place"))


def following_overlap(left: DataFrame, right: DataFrame, page: str) -> DataFrame:
    """page, a_id, b_id: of each box of left (a_id, a_no, ax0, ax1, ay) the first box of right (b_id, b_no, bx0, bx1, by) that comes later in order, stands no higher and overlaps it sideways."""
    over = F.least("ax1", "bx1") - F.greatest("ax0", "bx0") > 0
    j = left.join(right, page).where(over & (F.col("a_no") < F.col("b_no")) & (F.col("by") >= F.col("ay")))
    return j.groupBy(page, "a_id").agg(F.min_by("b_id", F.struct("b_no", "b_id")).alias("b_id"))


def level_text(entries: DataFrame, known: DataFrame) -> DataFrame:
    """id, text: the level entries (id, place, owner, level, domain) that known (id, owner, level, domain) confirms as 'owner level', others as 'owner ?', in order; Sorcerer/Wizard needs both owners."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z/]", "")
    needs = F.when(F.col("owner") == "Sorcerer/Wizard", F.array(F.lit("Sorcerer"), F.lit("Wizard"))).otherwise(F.array("owner"))
    each = entries.select("*", F.size(needs).alias("_need"), F.explode(needs).alias("_owner")).withColumn("_k", key(F.col("_owner")))
    held = known.select("id", key(F.col("owner")).alias("_k"), "level", "domain").distinct().withColumn("_hit", F.lit(1))
    n = each.join(held, ["id", "_k", "level", "domain"], "left").groupBy("id", "place", "owner", "level", "_need").agg(F.count("_hit").alias("_n"))
    one = F.concat("owner", F.lit(" "), F.when(F.col("_n") == F.col("_need"), F.col("level").cast("string")).otherwise("?"))
    return n.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("t")))), lambda x: x["t"]), ", ").alias("text"))
