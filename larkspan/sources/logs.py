"""The usage log as lines of JSON, batch and streaming; and scans of source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.predicates import source_file
from larkspan.functions.text import file_text_hash, relative_path
from larkspan.operators.usage import COLUMNS


def _clean(rows: DataFrame, as_of: str | None) -> DataFrame:
    """Without malformed lines; a missing time is as_of, where given."""
    good = rows.filter("_corrupt_record IS NULL").drop("_corrupt_record")
    return good if as_of is None else good.withColumn("timestamp", F.coalesce("timestamp", F.lit(as_of).cast("timestamp")))


def _parsed(lines: DataFrame) -> DataFrame:
    """One text column to the log's columns. A line that does not parse, or has a field of a wrong type, is marked, not dropped, so that counts and rows agree."""
    text = lines.filter(F.trim("value") != "")
    schema = COLUMNS + ", _corrupt_record string"
    return text.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")


def read_log(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    return _clean(_parsed(spark.read.text(path)), as_of)


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return _clean(_parsed(spark.readStream.text(path)), None)


def append_log(calls: DataFrame, path: str) -> None:
    """Appends records; nulls are left out."""
    calls.write.mode("append").option("ignoreNullFields", "true").json(path)


def source_tree(spark: SparkSession, root: str, as_of: str) -> DataFrame:
    """(file_path, content_hash, last_modified, last_analyzed) of the source files below root, without generated ones and those under obj."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.cs").load(root)
    path = relative_path(F.regexp_replace("path", "^file:/*", "/"), root)
    kept = files.filter(source_file("path"))
    return kept.select(path.alias("file_path"), file_text_hash(F.decode("content", "UTF-8")).alias("content_hash"), F.col("modificationTime").alias("last_modified"), F.lit(as_of).cast("timestamp").alias("last_analyzed"))


def generated_files(spark: SparkSession, root: str) -> DataFrame:
    """Generated sources under an obj folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.g.cs").load(root)
    return files.filter(F.col("path").contains("/obj/")).select("path")


def solution_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project paths in a solution file: the sixth quoted part of its Project( lines."""
    lines = spark.read.text(path).filter(F.ltrim("value").startswith("Project("))
    return lines.select(F.get(F.split("value", '"'), F.lit(5)).alias("path")).filter(F.col("path").rlike(r"(?i)\.(cs|vb)proj$"))


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """(topic, text) of the Markdown files of a folder, by lower-case stem."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(folder)
    stem = F.lower(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1))
    return files.select(stem.alias("topic"), F.col("value").alias("text"))


def add_missing_files(known: DataFrame, found: DataFrame) -> DataFrame:
    """Paths that are not known yet, letter case ignored, added to those that are."""
    new = found.withColumn("key", F.lower("path")).join(known.select(F.lower("path").alias("key")), "key", "left_anti").dropDuplicates(["key"])
    return known.select("path").unionByName(new.select("path"))


def envelope(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
