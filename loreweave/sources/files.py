"""Readers of corpora on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDECAR = "title string, source_html string, source_original string, toc_path array<string>, markdown_path string, platform string, doc_family string, doc_type string, tags array<string>, content string"
QUESTION = "id string, query string, category string, metadata struct<difficulty:string,reviewed:boolean>, expected_chunk_ids array<string>, expected_source_mds array<string>, _corrupt_record string"


def markdown_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, text, modified) of all files below a folder whose name fits the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", decoded(F.col("content")).alias("text"), F.col("modificationTime").alias("modified"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files with the columns of the JSON that has their path but for the ending; without one they are null."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    side = sidecars.select(stem(F.col("path")).alias("stem"), *[c for c in sidecars.columns if c != "path"])
    return files.withColumn("stem", stem(F.col("path"))).join(side, "stem", "left").drop("stem")


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """JSON sidecars below a folder, a file each."""
    rows = spark.read.schema(SIDECAR).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) evaluation questions of a JSON lines file: bad ones don't parse, or lack an id or a query."""
    rows = spark.read.schema(QUESTION).option("mode", "PERMISSIVE").json(path)
    fine = F.col("_corrupt_record").isNull() & (F.coalesce("id", F.lit("")) != "") & (F.coalesce("query", F.lit("")) != "")
    return rows.where(fine).drop("_corrupt_record"), rows.where(~fine)


def toc_rows(tree: DataFrame) -> DataFrame:
    """(href, label, parent_href, child_hrefs) of table-of-contents trees (nodes array<struct<href,label,children>>), as deep as their type goes."""
    level = tree.select(F.explode("nodes").alias("node"), F.lit("").alias("parent_href"))
    out = None
    while True:
        kind = level.schema["node"].dataType
        has = "children" in kind.fieldNames()
        children = F.transform("node.children", lambda x: x["href"]) if has else F.array().cast("array<string>")
        rows = level.select("node.href", "node.label", "parent_href", F.coalesce(children, F.array().cast("array<string>")).alias("child_hrefs"))
        out = rows if out is None else out.unionByName(rows)
        if not has:
            return out
        level = level.select(F.explode("node.children").alias("node"), F.col("node.href").alias("parent_href"))


def inverted_hrefs(rows: DataFrame, map_col: str) -> DataFrame:
    """(href, path) of a column map<path, struct<href>>; of equal hrefs the last path."""
    return rows.select(F.explode(map_col).alias("path", "value")).groupBy("value.href").agg(F.max("path").alias("path"))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")
