"""Documents from files (S1-S9): id, text, fields map<string,string>, category."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_EXTENSIONS = (".txt", ".md", ".markdown")
MARKDOWN_EXTENSIONS = (".md", ".markdown", ".mdx")


def within(root: str, path: str) -> str:
    """path below root; an error if it leads out of it."""
    if ".." in PurePosixPath(path).parts or PurePosixPath(path).is_absolute():
        raise ValueError(f"{path} is not below {root}")
    return f"{root.rstrip('/')}/{path}"


def files(spark: SparkSession, root: str, extensions: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """id (path below root), text of files with these extensions, in either case; none with a part that begins with a dot."""
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(root, wholetext=True).select(F.url_decode(F.input_file_name()).alias("path"), F.col("value").alias("text"))
    below = F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.rstrip("/").removeprefix("file://")) + "/", "")
    named = rows.select(below.alias("id"), "text")
    fits = F.lit(False)
    for e in extensions:
        fits = fits | F.endswith(F.lower("id"), F.lit(e))
    return named.where(fits & ~F.col("id").rlike(r"(^|/)\."))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def text_directory(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    rows = files(spark, root, TEXT_EXTENSIONS, recursive)
    name = F.regexp_extract("id", r"([^/]+?)(\.[^./]*)?$", 1)
    return rows.select("id", "text", F.create_map(F.lit("title"), name, F.lit("source"), F.col("id")).alias("fields"), F.lit(None).cast("string").alias("category"))


def json_documents(spark: SparkSession, path: str, id: str = "id", text: str = "text", category: str | None = None, others: bool = True) -> DataFrame:
    """An array of objects in a file (S1). Other scalars become fields, arrays of scalars joined by ", "; an object without id or text is an error that names its place."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "o"))
    entry = F.from_json("o", "map<string,string>")
    rows = whole.select("place", entry.alias("m"))

    def needed(key: str) -> Column:
        value = F.try_element_at("m", F.lit(key))
        return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"no {key} in entry "), F.col("place").cast("string"))).cast("string")).otherwise(value)

    fields = F.map_filter("m", lambda k, v: ~k.isin(id, text, *([category] if category else [])) & v.isNotNull() & ~F.startswith(v, F.lit("{")))
    joined = F.transform_values(fields, lambda k, v: F.when(F.startswith(v, F.lit("[")), F.array_join(F.from_json(v, "array<string>"), ", ")).otherwise(v))
    return rows.select(needed(id).alias("id"), needed(text).alias("text"), (joined if others else F.create_map().cast("map<string,string>")).alias("fields"), (F.try_element_at("m", F.lit(category)) if category else F.lit(None).cast("string")).alias("category"))


def markdown(text: Column, id: Column, first_heading: bool = True) -> Column:
    """struct text, fields, category of a Markdown document (S2): front matter of "key: value" lines between "---" lines, quotes off, [a, b] as "a, b"; the title is the front matter's or the first heading."""
    head = F.regexp_extract(text, r"\A---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    body = F.regexp_replace(text, r"\A---[ \t]*\r?\n[\s\S]*?\r?\n---[ \t]*(?:\r?\n|\z)", "")
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[^:\s#][^:]*:"))

    def clean(v: Column) -> Column:
        v = F.trim(v)
        listed = F.regexp_replace(F.regexp_replace(v, r"^\[|\]$", ""), r"""\s*,\s*""", ", ")
        v = F.when(v.rlike(r"^\[.*\]$"), F.regexp_replace(listed, "[\"']", "")).otherwise(v)
        return F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2")

    pairs = F.map_from_entries(F.transform(F.array_distinct(F.transform(lines, lambda x: F.trim(F.substring_index(x, ":", 1)))), lambda k: F.struct(k, clean(F.regexp_extract(F.element_at(F.filter(lines, lambda x: F.trim(F.substring_index(x, ":", 1)) == k), -1), r"^[^:]*:(.*)$", 1)))))
    heading = F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#+ +(\S.*)$", 1)), F.lit(""))
    title = F.coalesce(F.try_element_at(pairs, F.lit("title")), heading if first_heading else F.lit(None).cast("string"))
    extra = F.map_filter(F.create_map(F.lit("title"), title, F.lit("source"), id), lambda k, v: v.isNotNull())
    rest = F.map_filter(pairs, lambda k, v: ~k.isin("title", "source"))
    return F.struct(body.alias("text"), F.map_concat(rest, extra).alias("fields"), F.try_element_at(pairs, F.lit("category")).alias("category"))


def markdown_directory(spark: SparkSession, root: str, recursive: bool = True, first_heading: bool = True) -> DataFrame:
    rows = files(spark, root, MARKDOWN_EXTENSIONS, recursive)
    return rows.select("id", markdown(F.col("text"), F.col("id"), first_heading).alias("m")).select("id", "m.text", "m.fields", "m.category")


def jsonl(spark: SparkSession, path: str, id: str = "_id") -> DataFrame:
    """A corpus or queries as JSON lines: id, text (title before it, if there is one)."""
    rows = spark.read.schema(f"{id} string, title string, text string").json(path)
    return rows.select(F.col(id).alias("id"), F.concat_ws(" ", F.nullif("title", F.lit("")), "text").alias("text"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, grade: tab-separated, # comments."""
    return spark.read.option("sep", "\t").option("comment", "#").schema("query_id string, doc_id string, grade double").csv(path).where("grade IS NOT NULL")


def query_map(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text of a JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("query_id", "text"))


def labelled_directories(spark: SparkSession, root: str) -> DataFrame:
    """id, text, category: the folder that a file lies in is its label."""
    rows = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("id"), "text", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"))


def sparse_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, term, w from lines {"sha256": ..., "vector": {term: weight}}."""
    rows = spark.read.schema("sha256 string, vector map<string,double>").json(path)
    return rows.select(F.col("sha256").alias("id"), F.explode("vector").alias("term", "w"))


def payload(results: DataFrame) -> DataFrame:
    """Results as JSON lines, as a search endpoint would send them."""
    return results.select(F.to_json(F.struct("*")).alias("json"))


def as_text(baseline: DataFrame) -> DataFrame:
    """A golden baseline as lines: query_id | ids in order | scores (S19). baseline: query_id, doc_id, score, rank."""
    each = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d"), F.round("score", 6).alias("s"))))
    rows = baseline.groupBy("query_id").agg(each.alias("r"))
    return rows.select(F.concat_ws(" | ", F.col("query_id").cast("string"), F.array_join(F.transform("r", lambda x: x["d"]), " "), F.array_join(F.transform("r", lambda x: x["s"].cast("string")), " ")).alias("value"))


def from_text(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", r" \| ")
    each = F.posexplode(F.arrays_zip(F.split(parts[1], " ").alias("d"), F.split(parts[2], " ").alias("s"))).alias("i", "x")
    return spark.read.text(path).select(parts[0].alias("query_id"), each).select("query_id", F.col("x.d").alias("doc_id"), F.col("x.s").cast("double").alias("score"), (F.col("i") + 1).alias("rank"))


def write_model(path: str, model: dict) -> None:
    """A small classifier's parameters as JSON, with a version."""
    with open(path, "w") as f:
        json.dump({"format": "sparktext-model", "version": 1, "model": model}, f)


def read_model(path: str) -> dict:
    with open(path) as f:
        found = json.load(f)
    if found.get("format") != "sparktext-model" or found.get("version") != 1:
        raise ValueError(f"{path} is no model of this version")
    return found["model"]
