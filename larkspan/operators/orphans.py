"""References to records that do not exist: runs of parent keys and an as-of match.

Sorted integer parent keys are compressed into contiguous runs (first key, last key, whether they live, and the times between which they came). A reference is matched as of its
key, with the run that starts last at or before it: beyond the end of that run the key has no parent, a run of removed keys makes it deleted, and a reference older than
everything in its run came too early. Only references whose time lies among the times of their run are looked up by key. Runs stand in pages, rows of at most 2 ** PAGE keys, so
the parents shrink to a row a page, and the planner sends the pages to the references where they are small; else both are shuffled by page and skewed pages are split.

References are judged row by row, and only those that fail are grouped: the earliest row of a reference is late if any of its rows is.

Names become integer keys by their rank among all names, of parents and references, within a bucket of their hash; a run of ranks then ends only where a name has no parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.plans.lineage import store

PAGE = 6  # bits of a key within its page
BUCKETS = 1 << 16  # of names that are ranked together


def parent_states(parents: DataFrame, key: str = "key") -> DataFrame:
    """A row for each key of parents (key, added_at, removed_at): alive if some row is not removed, since its smallest added_at."""
    alive = F.col("removed_at").isNull()
    return parents.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(alive).alias("alive"), F.min(F.when(alive, F.col("added_at"))).alias("since"))


def key_runs(states: DataFrame) -> DataFrame:
    """(page, first, last, alive, low, high): runs of consecutive keys that all live or all do not, cut at the ends of pages.

    high is the greatest since of the run, low the smallest, null if a key of the run has none.
    """
    paged = states.withColumn("page", F.shiftright("key", PAGE))
    order = Window.partitionBy("page").orderBy("key")
    fresh = (F.try_subtract("key", F.lit(1)) != F.lag("key").over(order)) | (F.col("alive") != F.lag("alive").over(order))
    marked = paged.withColumn("run", F.sum(F.coalesce(fresh, F.lit(True)).cast("long")).over(order))
    low = F.when(F.count("since") == F.count("*"), F.min("since"))
    one = marked.groupBy("page", "run").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.any_value("alive").alias("alive"), low.alias("low"), F.max("since").alias("high"))
    return one.drop("run")


def run_pages(runs: DataFrame) -> DataFrame:
    """(page, runs): the runs of a page in order."""
    return runs.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("first", "last", "alive", "low", "high"))).alias("runs"))


def judged(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """refs (key, at, ...) that the run before them does not clear, with reason: missing, deleted, late, or open where only the key itself can tell."""
    pages = store(run_pages(runs), "pages")  # a table of known size, so that the planner can send it to the references
    key, at = F.col("key"), F.col("at")
    seen = refs.withColumn("page", F.shiftright("key", PAGE)).join(pages, "page", "left")
    # The runs are in order, so what the last one that starts at or before the key says is what stays.
    says = lambda r: F.when(key > r["last"], "missing").when(~r["alive"], "deleted").when(at < r["low"], "late").when(at < r["high"], "open").otherwise("clear")
    reason = F.aggregate("runs", F.lit("missing"), lambda so_far, r: F.when(r["first"] > key, so_far).otherwise(says(r)))
    return seen.select(*refs.columns, F.coalesce(reason, F.lit("missing")).alias("reason")).filter("reason <> 'clear'")


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of refs (key bigint, at timestamp, ...) whose parent is missing, deleted, or was added later, with the reason.

    parents: key, added_at, removed_at. A null key is no reference. reason is missing if no parent has the key, deleted if all that have it have a removed_at, late if the
    smallest added_at of the others is after at; a null at or added_at is never late. Repeated references come out as often as they stand in refs; repeated parents
    count once. Empty parents make every reference missing; empty refs give no row. Other columns of refs are kept (but for page, run, runs, reason, since), of parents not read.
    """
    return by_states(refs, parent_states(parents))


def by_states(refs: DataFrame, states: DataFrame) -> DataFrame:
    """orphans() of the states of the parents (key, alive, since)."""
    found = store(judged(refs.filter("key IS NOT NULL"), key_runs(states)), "judged")
    late = found.filter("reason = 'open'").join(states.select("key", "since"), "key").filter("since > at")
    return found.filter("reason <> 'open'").unionByName(late.select(*refs.columns, F.lit("late").alias("reason")))


def ranked(names: DataFrame) -> DataFrame:
    """names (name, ...), each once, with key: hash bucket and rank of the name in it."""
    bucket = F.pmod(F.xxhash64("name"), F.lit(BUCKETS))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("name")).cast("long")
    return names.withColumn("bucket", bucket).withColumn("key", F.shiftleft("bucket", 32) + rank).drop("bucket")


def _month(at: str) -> Column:
    return F.date_format(at, "yyyy-MM").alias("period")


def edge_orphans(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The orphans among both ends of the edges; an edge (src, dst, edge_type) counts once, at its earliest recorded_at. A null part is empty in the row key."""
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("key")) for c in ("src", "dst")]))
    refs = edges.select("src", "dst", "edge_type", F.col("recorded_at").alias("at"), ends.alias("end")).select("src", "dst", "edge_type", "at", "end.*")
    found = orphans(refs, symbols.select(F.col("id").alias("key"), "added_at", "removed_at"))
    once = found.groupBy("src", "dst", "edge_type", "ref_field", "reason").agg(F.min("at").alias("at"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.concat(text("src"), F.lit("|"), text("dst"), F.lit("|"), text("edge_type"))
    return once.select(F.lit("edges").alias("ref_table"), "ref_field", key.alias("row_key"), "reason", _month("at"))


def name_states(symbols: DataFrame, named: DataFrame) -> DataFrame:
    """(name, alive, since, at) of every name a symbol has, alive null for names only references (name, at) have; at is their earliest time. A symbol stands under its
    qualified name and under what comes before the first parenthesis."""
    both = F.explode(F.array_distinct(F.array(F.col("qualified_name"), F.substring_index("qualified_name", "(", 1))))
    own = symbols.filter("qualified_name IS NOT NULL").select(both.alias("name"), "added_at", "removed_at")
    own = own.select("name", F.col("removed_at").isNull().alias("alive"), F.when(F.col("removed_at").isNull(), F.col("added_at")).alias("since"), F.lit(None).cast("timestamp").alias("at"), F.lit(False).alias("asked"))
    asked = named.select("name", F.lit(None).cast("boolean").alias("alive"), F.lit(None).cast("timestamp").alias("since"), "at", F.lit(True).alias("asked"))
    return own.unionByName(asked).groupBy("name").agg(F.max("alive").alias("alive"), F.min("since").alias("since"), F.min("at").alias("at"), F.max("asked").alias("asked"))


def link_orphans(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """The orphans among the linked names, trimmed; a link (knowledge_id, symbol_name) counts once, at its earliest linked_at. A null part is empty in the row key."""
    name = F.regexp_replace("symbol_name", r"^[ \t]+|[ \t]+$", "")
    refs = links.select("knowledge_id", "symbol_name", name.alias("name"), F.col("linked_at").alias("at")).filter("name IS NOT NULL")
    names = store(ranked(name_states(symbols, refs.select("name", "at"))), "names")
    states = names.filter("alive IS NOT NULL").select("key", "alive", "since")
    # Judged once for each name, at its earliest reference; a name that is late for that one can be there in time for another.
    failed = by_states(names.filter("asked").select("key", "name", "at", F.col("since").alias("known")), states)
    found = refs.join(failed.select("name", "reason", "known"), "name").filter("reason <> 'late' OR at < known")
    once = found.groupBy("knowledge_id", "symbol_name", "reason").agg(F.min("at").alias("at"))
    key = F.concat(F.coalesce(F.col("knowledge_id").cast("string"), F.lit("")), F.lit("|"), F.col("symbol_name"))
    return once.select(F.lit("knowledge_links").alias("ref_table"), F.lit("symbol_name").alias("ref_field"), key.alias("row_key"), "reason", _month("at"))


def orphan_references(symbols: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(ref_table, ref_field, row_key, reason, period) of the orphans among edge ends and linked names; period is the month of the reference, null without a time."""
    return edge_orphans(symbols, edges).unionByName(link_orphans(symbols, links))


def orphan_report(found: DataFrame) -> DataFrame:
    """The number of orphan references per table, field, reason and period."""
    return found.groupBy("ref_table", "ref_field", "reason", "period").agg(F.count("*").alias("n_references"))
