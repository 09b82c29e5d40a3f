"""Sources: JSON lines with line numbers, change fixtures, HTML folders, legacy encodings, RTF, page rows, pasted names."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark.session import exists, read_text, safe_child


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1, blank lines counted), line of every line that isn't blank.

    A file's lines are numbered in the order of their splits: _metadata gives each split's place, so no task reads
    more than one split's lines. Within a split the order of the scan is kept.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    counts = raw.groupBy("file", "at").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    within = Window.partitionBy("file", "at").orderBy("seq")
    out = raw.withColumn("k", F.row_number().over(within)).join(offsets, ["file", "at"])
    return out.select("file", (F.col("off") + F.col("k")).cast("long").alias("line_no"), "line").where(F.trim("line") != "")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line_no, data (struct of schema, null where the line is no such object), error (the line, where it isn't)."""
    parsed = F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = numbered_lines(spark, path).withColumn("p", parsed)
    bad = F.col("p").isNull() | F.col("p._corrupt").isNotNull()
    fields = [f.name for f in df.schema["p"].dataType.fields if f.name != "_corrupt"]
    return df.select("line_no", F.when(~bad, F.struct(*[F.col(f"p.{f}").alias(f) for f in fields])).alias("data"), F.when(bad, F.col("line")).alias("error"))


def fixture_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of one table of a file of {"op": "insert", "table", "key", "data"} lines, in columns of schema; other operations are refused."""
    lines = json_lines(spark, path, f"op string, `table` string, `key` string, data struct<{schema}>").where("error is null")
    odd = lines.where("data.op != 'insert'").limit(1).collect()
    if odd:
        raise ValueError(f"line {odd[0]['line_no']}: only insert is accepted")
    return lines.where(F.col("data.table") == name).select("data.data.*")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of .htm and .html files below a folder, folders named *.files left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{htm,html}").load(path)
    return df.where(~F.col("path").rlike(r"\.files/")).select("path", "content")


@F.pandas_udf(T.StringType())
def decode_gb(content: pd.Series) -> pd.Series:
    """Bytes of the GB family as text; bytes that aren't are replaced."""
    return content.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


class _Text(HTMLParser):
    BLOCKS, SKIP = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol"}, {"script", "style", "head", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIP and self.skip > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_paragraphs(html: pd.Series) -> pd.Series:
    """Paragraph texts of HTML, without scripts, styles and head."""

    def paragraphs(x: str | None) -> list[str]:
        p = _Text()
        p.feed(x or "")
        p.close()
        return [t for t in (re.sub(r" +", " ", s).strip() for s in "".join(p.out).split("\n")) if t]

    return html.map(paragraphs)


class _Clean(HTMLParser):
    KEEP = {"p", "br", "b", "i", "em", "strong", "ul", "ol", "li", "table", "thead", "tbody", "tr", "td", "th", "sup", "sub", "h1", "h2", "h3", "h4"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in self.KEEP and not self.skip:
            spans = "".join(f' {k}="{int(v)}"' for k, v in attrs if k in ("colspan", "rowspan") and (v or "").isdigit())
            self.out.append(f"<{tag}{spans}>")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in self.KEEP and tag != "br" and not self.skip:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.replace("<", "&lt;").replace(">", "&gt;"))

    def handle_entityref(self, name):
        self.out.append(f"&{name};")

    def handle_charref(self, name):
        self.out.append(f"&#{name};")


@F.pandas_udf(T.StringType())
def sanitize_html(html: pd.Series) -> pd.Series:
    """HTML with known tags only and no attributes but cell spans."""

    def clean(x: str | None) -> str | None:
        if x is None:
            return None
        p = _Clean()
        p.feed(x)
        p.close()
        return "".join(p.out)

    return html.map(clean)


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\s?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator"}


def rtf_paragraphs(data: bytes) -> list[str]:
    """Paragraph texts of RTF bytes; tables, fonts and other destinations are left out."""
    out, words, stack, skip = [], [], [], False
    for m in _RTF.finditer(data.decode("latin-1")):
        hexa, uni, word, _, mark, brace, text = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif word in _RTF_SKIP or mark == "*":
            skip = True
        elif skip:
            continue
        elif word in ("par", "line", "row", "cell"):
            out.append("".join(words))
            words = []
        elif word == "tab":
            words.append(" ")
        elif word in ("emdash", "endash", "lquote", "rquote", "ldblquote", "rdblquote"):
            words.append({"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}[word])
        elif hexa:
            words.append(bytes([int(hexa, 16)]).decode("cp1252", "replace"))
        elif uni:
            words.append(chr(int(uni) % 65536))
        elif mark:
            words.append({"~": " ", "_": "-", "-": ""}.get(mark, mark))
        elif text:
            words.append(text)
    return [t for t in (re.sub(r"\s+", " ", p).strip() for p in [*out, "".join(words)]) if t]


def rtf_archive(spark: SparkSession, path: str) -> DataFrame:
    """path, member, paragraph_no (from 1), paragraph of the .rtf members of zip archives; one archive is read by one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".rtf")):
                        texts = rtf_paragraphs(z.read(name))
                        yield pd.DataFrame({"path": [p] * len(texts), "member": [name] * len(texts), "paragraph_no": range(1, len(texts) + 1), "paragraph": texts})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, member string, paragraph_no int, paragraph string")


def page_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of positioned page text in JSON lines {"page", "items": [...]}.

    items: page, item_no, text, x, y, width, height. errors: line_no, error of every line that isn't such an object or has
    no page; a reader that must not lose pages refuses a file with any.
    """
    schema = "page int, items array<struct<text string, x double, y double, width double, height double>>"
    df = json_lines(spark, path, schema)
    bad = F.col("error").isNotNull() | F.col("data.page").isNull()
    items = df.where(~bad).select("data.page", F.posexplode("data.items").alias("item_no", "i")).select("page", "item_no", "i.*")
    return items, df.where(bad).select("line_no", F.coalesce("error", F.lit("no page")).alias("error"))


def layout_blocks(spark: SparkSession, path: str) -> DataFrame:
    """page, place (from 0, in the order of the list), kind, text, x0, y0, x1, y1 of a JSON list of layout blocks {page_idx, type, text, bbox}; pages count from 1."""
    schema = "array<struct<page_idx int, type string, text string, bbox array<double>>>"
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)).alias("n", "b"))
    box = [F.try_element_at("b.bbox", F.lit(i + 1)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    rows = whole.where("b.page_idx is not null").select((F.col("b.page_idx") + 1).alias("page"), "n", F.col("b.type").alias("kind"), "b.text", *box)
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy("page").orderBy("n")) - 1).cast("int")).drop("n").select("page", "place", "kind", "text", "x0", "y0", "x1", "y1")


def manifest_rows(spark: SparkSession, manifest: str, schema: str) -> DataFrame:
    """source fields and rows of the files that a JSON manifest {"sources": [{token, name, rulebook_abbr, file}]} names beside it: token, name, rulebook_abbr and the columns of schema.

    The manifest is a list of books and read on the driver; its files are read by the tasks. A file that isn't there is an
    error, and so is a name that leads out of the manifest's folder.
    """
    root = manifest.rsplit("/", 1)[0]
    listed = json.loads(read_text(spark, manifest) or "{}").get("sources", [])
    files = {safe_child(root, m["file"]): m for m in listed}
    if not files:
        return spark.createDataFrame([], f"token string, name string, rulebook_abbr string, {schema}")
    gone = [f for f in files if not exists(spark, f)]
    if gone:
        raise FileNotFoundError(gone[0])
    heads = spark.createDataFrame([(f.rsplit("/", 1)[1], m.get("token"), m.get("name"), m.get("rulebook_abbr")) for f, m in files.items()], "_file string, token string, name string, rulebook_abbr string")
    rows = spark.read.schema(schema).json(list(files)).withColumn("_file", F.col("_metadata.file_name"))
    return heads.join(rows, "_file").drop("_file")


def verified_members(spark: SparkSession, archive: str, manifest: dict[str, str]) -> DataFrame:
    """rtf_archive's paragraphs of the members that manifest (member to SHA-256) names; a member that lacks or differs is an error, others are left out."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    yield pd.DataFrame([(n, hashlib.sha256(z.read(n)).hexdigest()) for n in z.namelist()], columns=["member", "sha256"])

    found = {r["member"]: r["sha256"] for r in spark.read.format("binaryFile").load(archive).select("content").mapInPandas(digests, "member string, sha256 string").collect()}
    wrong = sorted(m for m, h in manifest.items() if found.get(m) != h)
    if wrong:
        raise ValueError(f"not as the manifest says: {wrong}")
    return rtf_archive(spark, archive).where(F.col("member").isin(list(manifest)))


def read_artifact(spark: SparkSession, path: str, required: list[str], schema_version: int, hashes: dict[str, str] | None = None) -> dict:
    """A generated JSON artifact, refused with all that is wrong with it; see corpus.artifact_errors."""
    from loomspark.operators.corpus import artifact_errors

    artifact = json.loads(read_text(spark, path) or "{}")
    errors = artifact_errors(artifact, required, schema_version, {s["path"]: s["sha256"] for s in artifact.get("sources", [])} if hashes is None else hashes)
    if errors:
        raise ValueError("; ".join(errors))
    return artifact


def first_rows(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows in order, for builds that are only looked at; all of them where n is null."""
    return df if n is None else df.orderBy(order).limit(n)


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, n_lines, n_blank of text files."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return rows.groupBy("file").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("value") == "").alias("n_blank"))


class _Page(HTMLParser):
    """Keeps the part of a page that holds its text, without attributes, spans and empty paragraphs."""

    DROP = {"script", "style", "head", "title", "object"}
    UNWRAP = {"span", "font", "html", "body", "a"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.DROP
        if not self.skip and tag not in self.UNWRAP:
            self.out.append(f"<{tag}>")

    def handle_endtag(self, tag):
        if not self.skip and tag not in self.UNWRAP and tag != "br":
            self.out.append(f"</{tag}>")
        self.skip -= tag in self.DROP and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))

    def handle_entityref(self, name):
        if not self.skip:
            self.out.append(" " if name == "nbsp" else f"&{name};")

    def handle_charref(self, name):
        if not self.skip:
            self.out.append(f"&#{name};")


_BLANK_P = re.compile(r"<(p|div)>\s*(?:<br>\s*)*</\1>")


@F.pandas_udf(T.StringType())
def clean_page(html: pd.Series) -> pd.Series:
    """A whole page of HTML as one <div>: no attributes, spans unwrapped, blank paragraphs away; null stays null."""

    def clean(x: str | None) -> str | None:
        if x is None:
            return None
        p = _Page()
        p.feed(x)
        p.close()
        text, before = "".join(p.out).strip(), None
        while text != before:
            before, text = text, _BLANK_P.sub("", text)
        return f"<div>{text}</div>"

    return html.map(clean)


def headed_entries(spark: SparkSession, path: str, heading: str) -> DataFrame:
    """file, line_no, title of lines that match a heading pattern, with the title its first group."""
    lines = numbered_lines(spark, path)
    return lines.where(F.col("line").rlike(heading)).select("file", "line_no", F.trim(F.regexp_extract("line", heading, 1)).alias("title"))


def pasted_names(df: DataFrame, column: str) -> DataFrame:
    """pos, name of the tab- or line-separated names of a text column, blank ones left out."""
    names = F.filter(F.transform(F.split(column, "[\\t\\r\\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(F.posexplode(names).alias("pos", "name"))


def describe_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """table_name, column_name, column_type, nullable of registered tables or views, from the catalog alone."""
    rows = [(t, c.name, c.dataType, c.nullable) for t in names for c in spark.catalog.listColumns(t)]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string, nullable boolean")
