"""Symbol search by name, with suggestions, and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.predicates import glob, graph_path, kind_matches, name_matches
from larkspan.functions.text import fuzzy_score, suggestion_label, type_name


def find(symbols: DataFrame, pattern: str, mode: str = "contains", kind: str = "all", most: int = 100) -> DataFrame:
    """The first matches in order of qualified name and id, each with the number of all matches (total)."""
    hits = symbols.filter(name_matches("name", pattern, mode) & kind_matches("kind", kind))
    return page(hits, [F.col("qualified_name"), F.col("id")], most)


def page(rows: DataFrame, order: list[Column], most: int, offset: int = 0) -> DataFrame:
    """A page in that order, and in each row the number of rows before paging."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(most).crossJoin(F.broadcast(total))  # one row


def suggestions(symbols: DataFrame, pattern: str, most: int = 5) -> DataFrame:
    """The nearest names by fuzzy score then name, each once whatever its letter case, with a label that says why."""
    first = Window.partitionBy(F.lower("name")).orderBy("id")
    scored = symbols.select("id", "name", "qualified_name", fuzzy_score(pattern, "name").alias("score")).filter("score IS NOT NULL")
    scored = scored.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    # Names in the order of a dictionary, as a reader expects them.
    return scored.orderBy("score", F.collate("name", "UNICODE"), "name").limit(most).withColumn("label", suggestion_label(pattern, "name"))


def first_per_name(symbols: DataFrame) -> DataFrame:
    """(id, name): the smallest id of each name, letter case ignored."""
    return symbols.filter("name IS NOT NULL").groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("id", "name")).alias("r")).select("r.*")


def callers_page(callers: DataFrame, most: int, offset: int = 0, project: str | None = None, file: str | None = None) -> DataFrame:
    """A page of callers by file, line and id, with the total after filtering and a compact line for each."""
    kept = callers.filter(graph_path("file_path", project) & graph_path("file_path", file, file_only=True))
    return page(kept, [F.col("file_path"), F.col("line"), F.col("id")], most, offset).withColumn("compact", caller_line("qualified_name", "name", "file_path", "line"))


def references_page(references: DataFrame, most: int, project: str | None = None, file: str | None = None) -> DataFrame:
    """The first references by file and line, with the total after filtering and a compact line for each."""
    kept = references.filter(glob("project", project) & glob("file", file))
    return page(kept, [F.col("file"), F.col("line"), F.col("col_no")], most).withColumn("compact", reference_line("file", "line", "preview"))


def caller_line(qualified: str, name: str, file: str, line: str) -> Column:
    owner = type_name(qualified)
    return F.concat(F.when(owner.isNotNull(), F.concat(owner, F.lit("."))).otherwise(F.lit("")), F.col(name), F.lit(" "), F.col(file), F.lit(":"), F.col(line).cast("string"))


def symbol_line(qualified: str, kind: str, file: str, line: str, known: Column) -> Column:
    return F.concat(F.format_string("%s (%s) %s:%d", qualified, kind, file, line), F.when(known, F.lit(" [K]")).otherwise(F.lit("")))


def reference_line(file: str, line: str, preview: str) -> Column:
    return F.concat(F.col(file), F.lit(":"), F.col(line).cast("string"), F.lit(" - "), F.col(preview))


def member_line(kind: str, signature: str) -> Column:
    """The signature; a property's without what stands in braces, and the blanks before."""
    cut = F.rtrim(F.regexp_extract(signature, r"(?s)^([^{]+)", 1))
    return F.when((F.col(kind) == "Property") & F.col(signature).rlike(r"(?s)^[^{]+\{"), cut).otherwise(F.col(signature))


def by_kind(members: DataFrame) -> DataFrame:
    """One row for each type: a map of kind to its sorted members; kinds without members are not in it."""
    kinds = members.groupBy("type_name", "kind").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return kinds.groupBy("type_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "names")))).alias("members"))
