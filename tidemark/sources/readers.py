"""Corpora and allow-lists from files, as one document shape: doc_id, title, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip_html
from .stores import numbered_lines

#: Names that a record may give its text and id.
TEXT_FIELDS = ("text", "content", "contents", "body", "page_content", "document")
ID_FIELDS = ("_id", "id", "doc_id", "document_id")


# Names of a record's title, and endings of files that hold text or records.
TITLE_FIELDS = ("title", "name", "heading")
KINDS = {".txt": "text", ".md": "text", ".rst": "text", ".html": "html", ".htm": "html", ".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".tsv": "tsv"}


def from_records(rows: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Documents of records by the first id, title and text field that is there and not empty; those with empty text go. fallback: the id of a record without one."""
    filled = lambda n: F.nullif(F.col(n).cast("string"), F.lit(""))
    first = lambda names: F.coalesce(*[filled(n) for n in names if n in rows.columns], F.lit(None).cast("string"))
    own = F.concat(F.lit("line_"), F.monotonically_increasing_id() + 1) if fallback is None else fallback
    out = rows.select(F.coalesce(first(ID_FIELDS), own).alias("doc_id"), F.coalesce(first(TITLE_FIELDS), F.lit("")).alias("title"), first(TEXT_FIELDS).alias("text"))
    return out.filter(F.trim("text") != "")


def read_corpus(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """kind: jsonl, json (a list or one wrapped in documents, items, records or data), csv, tsv, text, html.

    A JSON line without an id is named by its number from 1 in its file. Bytes of text files that are no UTF-8 are read as replacement characters.
    """
    if kind == "jsonl":
        schema = spark.read.json(path, recursiveFileLookup=True).schema
        lines = numbered_lines(spark, path).filter(F.trim("value") != "")
        named = lines.select(F.concat(F.lit("line_"), "line").alias("_line"), F.from_json("value", schema).alias("r")).select("_line", "r.*")
        return from_records(named, F.col("_line"))
    if kind == "json":
        rows = spark.read.json(path, multiLine=True, recursiveFileLookup=True)
        wrapped = [c for c in ("documents", "items", "records", "data") if c in rows.columns]
        return from_records(rows.select(F.inline(wrapped[0])) if wrapped else rows)
    if kind in ("csv", "tsv"):
        return from_records(spark.read.csv(path, header=True, sep="," if kind == "csv" else "\t", multiLine=True, recursiveFileLookup=True))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("told"))
    told = F.col("told")
    body = strip_html(told) if kind == "html" else clean_text(told)
    return rows.select("doc_id", F.lit("").alias("title"), body.alias("text")).filter("text <> ''")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all files under a folder, at any depth, whose endings are known, each read as its kind; others are passed over."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    by_kind: dict = {}
    for r in listed.select("path", ending.alias("ending")).filter(F.col("ending").isin(list(KINDS))).groupBy("ending").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect():  # file names, as a listing gives them
        by_kind.setdefault(KINDS[r["ending"]], []).extend(r["paths"])
    parts = [read_corpus(spark, paths, kind) for kind, paths in sorted(by_kind.items())]
    if not parts:
        raise FileNotFoundError(f"no readable file under {path}")
    return reduce(DataFrame.unionByName, parts)


def allow_list(spark: SparkSession, path: str) -> DataFrame:
    """doc_id of a file with a JSON list, {"document_ids": [...]} or one id per line; trimmed, each once. A file without any is an error."""
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "document_ids array<string>")["document_ids"], F.split("value", r"[\r\n]+"))
    out = text.select(F.explode(listed).alias("doc_id")).select(F.trim("doc_id").alias("doc_id")).filter("doc_id <> ''").distinct()
    if out.isEmpty():
        raise ValueError(f"{path} lists no document")
    return out
