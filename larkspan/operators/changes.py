"""Change detection by content hash, upserts, and refresh as kept plus rebuilt.

stored and current are files (file_path, content_hash, ...), a row for each path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored paths whose hash is gone or differs now. A path stored with two hashes can be listed for each."""
    now = current.select("file_path", F.col("content_hash").alias("now"))
    pairs = stored.select("file_path", "content_hash").distinct().join(now, "file_path", "left")
    return pairs.filter(F.col("now").isNull() | ~F.col("content_hash").eqNullSafe(F.col("now"))).select("file_path")


def needing_analysis(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Current paths that are not stored or whose hash differs; new files are found too."""
    before = stored.select("file_path", F.col("content_hash").alias("before"))
    pairs = current.select("file_path", "content_hash").join(before, "file_path", "left")
    return pairs.filter(~F.col("content_hash").eqNullSafe(F.col("before"))).select("file_path").distinct()


def unchanged(stored: DataFrame, current: DataFrame) -> DataFrame:
    return current.join(stored.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_semi").select("file_path")


def deleted(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored paths that are gone; letter case is ignored."""
    now = current.select(F.lower("file_path").alias("key"))
    return stored.withColumn("key", F.lower("file_path")).join(now, "key", "left_anti").select("file_path").distinct()


def still_there(paths: DataFrame, current: DataFrame) -> DataFrame:
    return paths.join(current.select("file_path"), "file_path", "left_semi")


def staleness(stored: DataFrame, disk: DataFrame, asked: DataFrame) -> DataFrame:
    """(file_path, is_stale): untracked is stale, missing on disk is not, an equal time of change is not, else the hashes decide."""
    s = stored.select("file_path", F.col("content_hash").alias("h1"), F.col("last_modified").alias("m1"), F.lit(True).alias("tracked"))
    d = disk.select("file_path", F.col("content_hash").alias("h2"), F.col("last_modified").alias("m2"), F.lit(True).alias("on_disk"))
    both = asked.join(s, "file_path", "left").join(d, "file_path", "left")
    rule = F.when(F.col("tracked").isNull(), True).when(F.col("on_disk").isNull(), False).when(F.col("m1") == F.col("m2"), False).otherwise(~F.col("h1").eqNullSafe(F.col("h2")))
    return both.select("file_path", rule.alias("is_stale"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source replace those of target with the same keys."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def upsert_hash(target: DataFrame, source: DataFrame) -> DataFrame:
    """New paths are added, of known ones only the hash changes."""
    s = source.select("file_path", F.col("content_hash").alias("new_hash"))
    return target.join(s, "file_path", "full_outer").withColumn("content_hash", F.coalesce("new_hash", "content_hash")).drop("new_hash")


def get_or_create(solutions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted path (path, name) with its solution's id; unknown ones get one by the hash of the path. Letter case and the kind of slash are ignored."""
    key = F.lower(F.regexp_replace("path", r"\\", "/"))
    known = solutions.select(key.alias("key"), "id").groupBy("key").agg(F.min("id").alias("id"))
    asked = wanted.withColumn("key", key).dropDuplicates(["key"])
    return asked.join(known, "key", "left").select("path", "name", F.coalesce("id", F.xxhash64("key")).alias("id"), F.col("id").isNull().alias("created"))


def known_hashes(symbols: DataFrame) -> DataFrame:
    """The first hash (by id) that is not null of each path, letter case ignored."""
    return symbols.filter("file_hash IS NOT NULL").groupBy(F.lower("file_path").alias("file_key")).agg(F.min_by("file_hash", "id").alias("file_hash"))


def refresh(symbols: DataFrame, edges: DataFrame, stale_files: DataFrame, rebuilt_symbols: DataFrame, rebuilt_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols of stale files are replaced by the rebuilt ones, and edges into them are led to the symbol that has the same name in the same solution now.

    stale_files is (solution_id, file_path), rebuilt_edges (solution_id, src_name, dst_name, edge_type). Edges between symbols that stay keep their ids, whatever their
    names; edges out of a stale symbol go, as its file was analysed again; an edge into one goes if no symbol of its solution has the name any more. If several symbols of
    a solution have a name, the smallest id stands for it.
    """
    stale = stale_files.select("solution_id", "file_path").distinct()
    old = symbols.join(stale, ["solution_id", "file_path"], "left_semi").select("id", "solution_id", "qualified_name").distinct()
    kept = symbols.join(stale, ["solution_id", "file_path"], "left_anti").unionByName(rebuilt_symbols)
    ids = kept.filter("qualified_name IS NOT NULL").groupBy("solution_id", "qualified_name").agg(F.min("id").alias("now"))
    staying = edges.join(old.select(F.col("id").alias("src")), "src", "left_anti")
    calm = staying.join(old.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "edge_type")
    into = staying.join(old.withColumnRenamed("id", "dst"), "dst").join(ids, ["solution_id", "qualified_name"]).select("src", F.col("now").alias("dst"), "edge_type")
    end = lambda c: ids.select("solution_id", F.col("qualified_name").alias(f"{c}_name"), F.col("now").alias(c))
    made = rebuilt_edges.join(end("src"), ["solution_id", "src_name"]).join(end("dst"), ["solution_id", "dst_name"]).select("src", "dst", "edge_type")
    return kept, calm.unionByName(into).unionByName(made).distinct()


def latest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """Last write wins: the row of the greatest time for each key."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), F.struct(*rest))).alias("r"))
    return best.select(*key, "r.*")


def first_by_priority(rows: DataFrame, value: str, priority: Column) -> DataFrame:
    """The value of the lowest priority, then of the smallest value."""
    return rows.agg(F.min_by(value, F.struct(priority, F.col(value))).alias(value))
