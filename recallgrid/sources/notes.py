"""Readers of note files, query sets and relevance judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRONT_MATTER = r"(?s)^---\n(.*?)\n---\n"


def note_columns(raw: Column, name: Column) -> dict[str, Column]:
    """Title, tags, links and text of a Markdown note with optional front matter."""
    front = F.regexp_extract(raw, FRONT_MATTER, 1)
    title = F.regexp_replace(F.trim(F.regexp_extract(front, r"(?m)^title:(.*)$", 1)), r'^"|"$', "")
    tags = F.regexp_extract_all(F.regexp_extract(front, r"(?m)^tags:(.*)$", 1), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    links = F.transform(F.regexp_extract_all(raw, F.lit(r"\[\[([^\]|]+)"), F.lit(1)), lambda x: F.trim(x))
    return {
        "title": F.when(front.rlike(r"(?m)^title:"), title).otherwise(name),
        "tags": tags,
        "links": links,
        "text": F.regexp_replace(F.regexp_replace(raw, FRONT_MATTER, ""), r"^\s+|\s+$", ""),
    }


def parse_notes(rows: DataFrame, raw: str, name: str) -> DataFrame:
    """``node_id, title, tags, links, text`` of rows that hold whole notes; null notes are left out."""
    return rows.filter(F.col(raw).isNotNull()).select(F.col(name).alias("node_id"), *[c.alias(n) for n, c in note_columns(F.col(raw), F.col(name).cast("string")).items()])


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.md`` files below a folder; a note's id is its file name without the ending."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return parse_notes(files.select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("name")), "value", "name")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("qid string, text string").json(path)


def read_relevant(spark: SparkSession, path: str) -> DataFrame:
    """``qid, node_id`` of the judgements with a grade above 0 in a tab-separated file without header."""
    rows = spark.read.schema("qid string, zero string, node_id string, grade int").csv(path, sep="\t")
    return rows.filter("grade > 0").select("qid", "node_id")
