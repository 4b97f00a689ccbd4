"""From a name to the symbol it means: tiers of matches, and overloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions.predicates import partial_name
from larkspan.functions.text import parameters


def _result(hits: DataFrame, most: int = 100) -> DataFrame:
    """One row: status found, ambiguous or not_found, the id if found, the number of candidates n, and the names of the first candidates in order; the list is cut, the number is not."""
    one = hits.agg(F.count("*").alias("n"), F.min("id").alias("id"))
    first = hits.select("qualified_name").orderBy("qualified_name").limit(most).agg(F.sort_array(F.collect_list("qualified_name")).alias("candidates"))
    status = F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return one.crossJoin(F.broadcast(first)).select(status.alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"), "n", "candidates")  # a row each


def _best_tier(tiers: list[DataFrame]) -> DataFrame:
    """The rows of the first tier that has any."""
    every = None
    for i, t in enumerate(tiers):
        t = t.select("id", "qualified_name", F.lit(i).alias("tier"))
        every = t if every is None else every.unionByName(t)
    first = every.agg(F.min("tier").alias("tier"))
    return every.join(F.broadcast(first), "tier").select("id", "qualified_name")  # one row


def find_symbol(symbols: DataFrame, solution: int, search: str) -> DataFrame:
    """The symbol a name means: by its qualified name, else by part of it; names with .ctor as constructors."""
    s = symbols.filter(F.col("solution_id") == solution)
    if ".ctor" in search:
        return find_constructor(s, search)
    return _result(_best_tier([s.filter(F.col("qualified_name") == search), s.filter(partial_name("qualified_name", "name", search))]))


def find_constructor(symbols: DataFrame, search: str) -> DataFrame:
    """Ns.Type..ctor or Type.ctor with or without parameters: equal, else of that name with any parameters if none are given, else as part of a name."""
    at = search.index(".ctor")
    owner = search[:at].rstrip(".")
    if not owner:
        return _result(symbols.filter("false"))
    rest = search[at + len(".ctor") :]
    full = f"{owner}.{owner.rsplit('.', 1)[-1]}"
    tiers = [symbols.filter(F.col("qualified_name") == full + rest)]
    if not rest:
        tiers.append(symbols.filter((F.col("name") == ".ctor") & F.col("qualified_name").ilike(f"{full}(%")))
    short = owner.rsplit(".", 1)[-1]
    tiers.append(symbols.filter((F.col("name") == ".ctor") & F.col("qualified_name").ilike(f"%.{short}.{short}{rest}%")))
    return _result(_best_tier(tiers))


def exactly_one(hits: DataFrame) -> DataFrame:
    """The single row, none at all, or an error when the job runs if there are several."""
    n = hits.agg(F.count("*").alias("n"))
    return hits.join(F.broadcast(n), F.lit(True)).filter(F.when(F.col("n") > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.lit(True))).drop("n")


def pick_overload(members: DataFrame, name: str, kind: str | None = None, params: str | None = None) -> DataFrame:
    """Of the members of that name, kind and parameter list (types in full or short, letter case ignored): one, none, or the candidates."""
    hits = members.filter(F.col("name") == name)
    if kind:
        hits = hits.filter(F.lower("kind") == kind.lower())
    if params is not None:
        flat = F.lower(F.regexp_replace(parameters("qualified_name"), r"\s", ""))
        short = F.regexp_replace(flat, r"[\p{L}\p{N}_]+\.", "")
        wanted = "".join(params.lower().split())
        hits = hits.filter((flat == wanted) | (short == wanted))
    return _result(hits)
