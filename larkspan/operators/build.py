"""Building and refreshing the graph from extracted facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators import changes, graph


def edges_from_occurrences(occurrences: DataFrame, implementations: DataFrame | None = None) -> DataFrame:
    """(src_name, dst_name, edge_type) of occurrences (src_name, dst_name, node, symbol_kind, is_write, is_const), those that make no edge left out; a call of an
    interface member (interface_name, member_name) also leads to each implementation."""
    kind = graph.edge_type_of(F.col("node"), F.col("symbol_kind"), F.col("is_write"), F.col("is_const"))
    e = occurrences.select("src_name", "dst_name", kind.alias("edge_type")).filter("edge_type IS NOT NULL")
    if implementations is not None:
        more = e.join(implementations.withColumnRenamed("interface_name", "dst_name"), "dst_name").filter("edge_type IN ('Calls', 'Accesses')")
        e = e.unionByName(more.select("src_name", F.col("member_name").alias("dst_name"), "edge_type"))
    return e.distinct()


def incremental(solution: int, stored: DataFrame, current: DataFrame, symbols: DataFrame, edges: DataFrame, facts: DataFrame, occurrences: DataFrame, implementations: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, edges, files) after a build of one solution: its files that are new or differ are rebuilt from facts (symbols with file_path) and occurrences (with file_path),
    deleted ones dropped, the rest kept. stored and current are the solution's files; symbols and edges of other solutions stay as they are, even under equal paths and
    names. An empty stored table makes it a full build. Calls from unchanged files stay, by changes.refresh."""
    again = changes.needing_analysis(stored, current)
    gone = changes.deleted(stored, current)
    own = F.lit(solution).cast("long").alias("solution_id")
    touched = again.unionByName(gone).distinct().select(own, "file_path")
    rebuilt = facts.join(again, "file_path", "left_semi").withColumn("solution_id", own).select(*symbols.columns)
    named = edges_from_occurrences(occurrences.join(again, "file_path", "left_semi"), implementations).withColumn("solution_id", own)
    new_symbols, new_edges = changes.refresh(symbols, edges, touched, rebuilt, named)
    return new_symbols, new_edges, current


def upsert_declared(symbols: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared symbols (solution_id, qualified_name, kind, name, file_path, file_hash): one that exists under its solution and name gets the hash and becomes Analyzed, whatever else it
    says; the others are added as Analyzed, with an id by a hash of solution, kind and name. Of repeated declarations the smallest counts."""
    key = ["solution_id", "qualified_name"]
    rest = ["kind", "name", "file_path", "file_hash"]
    one = declared.groupBy(*key).agg(F.min(F.struct(*rest)).alias("d"))
    found = symbols.join(one.select(*key, F.col("d.file_hash").alias("new_hash"), F.lit(True).alias("hit")), key, "left")
    found = found.withColumns({"file_hash": F.when(F.col("hit"), F.col("new_hash")).otherwise(F.col("file_hash")), "status": F.when(F.col("hit"), "Analyzed").otherwise(F.col("status"))}).select(*symbols.columns)
    new = one.join(symbols.select(*key), key, "left_anti").select(*key, "d.*").withColumn("status", F.lit("Analyzed")).withColumn("id", F.xxhash64("solution_id", "kind", "qualified_name"))
    return found.unionByName(new, allowMissingColumns=True).select(*symbols.columns)


def entry_symbols(statements: DataFrame, name: str = "<Main>$", owner: str = "Program") -> DataFrame:
    """The symbol made up for top-level statements (solution_id, file_path, line, col_no): a method for each file that has any, at the place of its first one."""
    first = statements.groupBy("solution_id", "file_path").agg(F.min(F.struct("line", "col_no")).alias("p"))
    made = first.select("solution_id", F.lit("Method").alias("kind"), F.lit(name).alias("name"), F.lit(f"{owner}.{name}").alias("qualified_name"), "file_path", "p.line", "p.col_no", F.lit("Analyzed").alias("status"))
    return made.select(F.xxhash64("solution_id", "file_path", "qualified_name").alias("id"), "*")


def entry_occurrences(occurrences: DataFrame, name: str = "<Main>$", owner: str = "Program") -> DataFrame:
    """occurrences in which what stands outside any member (a null src_name) belongs to the made-up entry symbol."""
    return occurrences.withColumn("src_name", F.coalesce("src_name", F.lit(f"{owner}.{name}")))


def counts(stored: DataFrame, current: DataFrame) -> DataFrame:
    """How many files a build would analyse, keep and drop."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(changes.needing_analysis(stored, current), "analysed")
    return one.crossJoin(F.broadcast(n(changes.unchanged(stored, current), "kept"))).crossJoin(F.broadcast(n(changes.deleted(stored, current), "dropped")))
