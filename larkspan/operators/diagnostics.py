"""Diagnostics and places in files: counts, nearest and enclosing places, overlaps, blank lines.

diagnostics has seq (order of arrival), id, severity, title, message, file, line, col_no, project, suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def severity_totals(diagnostics: DataFrame) -> DataFrame:
    kinds = {"errors": "error", "warnings": "warning", "infos": "info"}
    return diagnostics.agg(*[F.count_if(F.lower("severity") == v).alias(k) for k, v in kinds.items()])


def summary(diagnostics: DataFrame, fixable: DataFrame) -> DataFrame:
    """Per id: severity and title of the first, count, suppressed count, and whether a fix is known (fixable has id; letter case ignored)."""
    s = diagnostics.groupBy("id").agg(F.min_by("severity", "seq").alias("severity"), F.min_by("title", "seq").alias("title"), F.count("*").alias("n"), F.count_if(F.col("suppressed").isNotNull()).alias("n_suppressed"))
    known = fixable.select(F.lower("id").alias("key"), F.lit(True).alias("has_fix")).distinct()
    return s.withColumn("key", F.lower("id")).join(known, "key", "left").drop("key").withColumn("has_fix", F.coalesce("has_fix", F.lit(False))).orderBy(F.desc("n"), "id")


def detail(diagnostics: DataFrame, ident: str, most: int, offset: int = 0) -> DataFrame:
    """A page of those with the id, letter case ignored, in order of arrival."""
    return diagnostics.filter(F.lower("id") == ident.lower()).orderBy("seq").offset(offset).limit(most)


def line_of(d: str = "") -> Column:
    """A compact line: file:line:column severity id: message."""
    return F.concat(F.col(d + "file"), F.lit(":"), F.col(d + "line").cast("string"), F.lit(":"), F.col(d + "col_no").cast("string"), F.lit(" "), F.col(d + "severity"), F.lit(" "), F.col(d + "id"), F.lit(": "), F.col(d + "message"))


def summary_line() -> Column:
    """A compact line for a row of summary(): id (severity) [fix]: title (number) (number suppressed)."""
    fix = F.when(F.col("has_fix"), " [fix]").otherwise("")
    hidden = F.when(F.col("n_suppressed") > 0, F.concat(F.lit(" ("), F.col("n_suppressed"), F.lit(" suppressed)"))).otherwise("")
    return F.concat(F.col("id"), F.lit(" ("), F.col("severity"), F.lit(")"), fix, F.lit(": "), F.coalesce("title", F.lit("")), F.lit(" ("), F.col("n"), F.lit(")"), hidden)


def place_line(file: Column) -> Column:
    """A compact line for a diagnostic: file:line Type.Method - message; without a containing type nothing stands for it."""
    inside = F.coalesce("containing_type", F.lit("")) != ""
    owner = F.when(inside, F.concat(F.col("containing_type"), F.lit("."), F.coalesce("containing_method", F.lit("")))).otherwise("")
    return F.concat(file, F.lit(":"), F.col("line"), F.lit(" "), owner, F.lit(" - "), F.coalesce("message", F.lit("")))


def first_per_line(diagnostics: DataFrame) -> DataFrame:
    """The first to arrive of each file and line."""
    rest = [c for c in diagnostics.columns if c not in ("file", "line")]
    return diagnostics.groupBy("file", "line").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("file", "line", "r.*")


def nearest(wanted: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """For each wanted (key, file, at) the diagnostic of its file whose line is nearest, the first to arrive of equals: key, seq, line.

    Both sides are reduced to the distinct lines of a file first, so a file with many diagnostics costs no more than its length. Its lines are then passed in order from
    both sides, so no pair is made but the two that can win.
    """
    d = diagnostics.groupBy("file", "line").agg(F.min("seq").alias("seq"))
    left = wanted.select("file", F.col("at").alias("line")).distinct().withColumn("side", F.lit(1)).withColumn("d", F.lit(None).cast("struct<line:int,seq:bigint>"))
    right = d.select("file", "line", F.lit(0).alias("side"), F.struct(F.col("line").cast("int").alias("line"), F.col("seq").cast("bigint").alias("seq")).alias("d"))
    both = left.unionByName(right)
    up = Window.partitionBy("file").orderBy("line", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("file").orderBy(F.desc("line"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("low", F.last("d", ignorenulls=True).over(up)).withColumn("high", F.last("d", ignorenulls=True).over(down)).filter("side = 1")
    one = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c + ".line") - F.col("line")).alias("gap"), F.col(c + ".seq").alias("seq"), F.col(c + ".line").alias("at")))
    best = F.array_min(F.filter(F.array(one("low"), one("high")), lambda x: x.isNotNull()))
    lines = seen.select("file", F.col("line").alias("at"), best.alias("b")).filter("b IS NOT NULL")
    return wanted.join(lines, ["file", "at"]).select("key", "b.seq", F.col("b.at").alias("line"))


def overlapping(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Spans (file, first, last, ...) that share a place with one of the others of their file.

    The others are merged into disjoint runs; a span meets one of them if and only if the run that starts last before the span's end reaches its start. Equal spans of
    a file are looked at once.
    """
    order = Window.partitionBy("file").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    o = others.select("file", "first", "last").distinct().withColumn("reach", F.max("last").over(order))
    whole = Window.partitionBy("file").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = o.withColumn("run", F.sum(F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach")), 1).otherwise(0)).over(whole))
    runs = o.groupBy("file", "run").agg(F.min("first").alias("first"), F.max("last").alias("end"))
    none = F.lit(None).cast(runs.schema["end"].dataType)
    left = spans.select("file", "first", "last").distinct().select("file", "first", "last", F.col("last").alias("at"), F.lit(1).alias("side"), none.alias("end"))
    right = runs.select("file", "first", none.alias("last"), F.col("first").alias("at"), F.lit(0).alias("side"), "end")
    asof = Window.partitionBy("file").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = left.unionByName(right).withColumn("reach", F.last("end", ignorenulls=True).over(asof)).filter("side = 1 AND reach >= first")
    return spans.join(seen.select("file", "first", "last"), ["file", "first", "last"], "left_semi")


def enclosing(places: DataFrame, spans: DataFrame, bucket: int = 64) -> DataFrame:
    """The smallest span (file, first, last, name) around each place (key, file, at): first <= at < last; ties: the smaller name. Spans are cut into buckets of
    lines, so a place meets only the spans over its own bucket; equal places and equal spans of a file meet once."""
    s = spans.groupBy("file", "first", "last").agg(F.min("name").alias("name"))
    cut = s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor((F.col("last") - 1) / bucket))))
    p = places.select("file", "at").distinct().withColumn("bucket", F.floor(F.col("at") / bucket))
    hits = p.join(cut, ["file", "bucket"]).filter("first <= at AND at < last")
    best = hits.groupBy("file", "at").agg(F.min_by("name", F.struct(F.col("last") - F.col("first"), F.col("name"))).alias("name"))
    return places.join(best, ["file", "at"]).select("key", "name")


def in_span(statements: DataFrame, file: str, first: int, last: int) -> DataFrame:
    """Statements of the file that share a place with the selected span."""
    return statements.filter((F.col("file") == file) & (F.col("first") <= last) & (F.col("last") >= first))


def without_double_blanks(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, text) without those that are blank after a blank one."""
    blank = F.trim("text") == ""
    before = F.lag(blank, 1, False).over(Window.partitionBy("file").orderBy("line_no"))
    return lines.withColumn("drop", blank & before).filter(~F.col("drop")).drop("drop")


def fix_counts(fixes: DataFrame) -> DataFrame:
    """Found, applied, failed, and files touched, of fixes (file, applied)."""
    return fixes.agg(F.count("*").alias("found"), F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("failed"), F.count_distinct(F.when(F.col("applied"), F.col("file"))).alias("files"))


def gathered(*parts: DataFrame) -> DataFrame:
    """The diagnostics of several producers as one bag: nothing is taken out."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_file(diagnostics: DataFrame) -> DataFrame:
    """(file, n, first, last) of the diagnostics of each file: their number and their first and last line; those without a file are left out."""
    return diagnostics.filter("file IS NOT NULL").groupBy("file").agg(F.count("*").alias("n"), F.min("line").alias("first"), F.max("line").alias("last"))


def batch(diagnostics: DataFrame, ident: str, most: int = 100) -> DataFrame:
    """The first `most` diagnostics of the id, in order of arrival: what one batch of fixes takes on."""
    return detail(diagnostics, ident, most)


def change_impact(changes: DataFrame) -> DataFrame:
    """Files affected and text changes of changes (file, n)."""
    return changes.agg(F.count_distinct("file").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("changes"))


def positions(places: DataFrame, line_starts: DataFrame) -> DataFrame:
    """places (key, file, line, col_no) with at, their position in the file: the start of the line (file, line, start) and the column, counted from 1."""
    return places.join(line_starts, ["file", "line"]).select("key", "file", (F.col("start") + F.col("col_no") - 1).alias("at"))


def symbol_at(places: DataFrame, line_starts: DataFrame, spans: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(key, name) of the symbol at each place (key, file, line, col_no), by the first of three ways that gives one.

    A declared span (file, first, last, name) that starts exactly there; the smallest span around the start of the token (file, first, last, name may be null) that covers the
    place; the smallest span around the place itself. Spans with a null name declare nothing. Places outside all spans are left out.
    """
    at = positions(places, line_starts)
    named = spans.filter("name IS NOT NULL")
    exact = at.join(named.groupBy("file", F.col("first").alias("at")).agg(F.min_by("name", F.struct(F.col("last") - F.col("first"), F.col("name"))).alias("name")), ["file", "at"]).select("key", "name", F.lit(0).alias("way"))
    found = exact.unionByName(enclosing(at, named, 4096).withColumn("way", F.lit(2)))
    if tokens is not None:
        starts = enclosing(at, tokens.select("file", "first", "last", F.col("first").cast("string").alias("name")), 4096)
        moved = at.join(starts.withColumnRenamed("name", "start"), "key").select("key", "file", F.col("start").cast("bigint").alias("at"))
        found = found.unionByName(enclosing(moved, named, 4096).withColumn("way", F.lit(1)))
    return found.groupBy("key").agg(F.min_by("name", "way").alias("name"))
