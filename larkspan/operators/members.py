"""Types, members and projects: order, inheritance, places for new members, build order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.plans.lineage import checkpoint, drop, store


def in_order(members: DataFrame) -> DataFrame:
    """Constructors first, then by kind and name."""
    return members.orderBy("type_name", F.when(F.col("kind") == "Constructor", 0).otherwise(1), "kind", "name")


def ancestors(bases: DataFrame) -> DataFrame:
    """(type_name, base, level) of every base above a type, the nearest first at level 1; bases is (type_name, base). A cycle ends where it closes.

    Each round joins the chains with themselves and so doubles their reach, until nothing new is reached: the rounds grow with the logarithm of the longest chain.
    """
    have = store(bases.select("type_name", "base", F.lit(1).alias("level")).filter("type_name <> base").distinct(), "bases")
    n = have.count()
    while n:
        further = have.select("type_name", F.col("base").alias("via"), F.col("level").alias("l1")).join(have.select(F.col("type_name").alias("via"), "base", F.col("level").alias("l2")), "via")
        further = further.filter("type_name <> base").select("type_name", "base", (F.col("l1") + F.col("l2")).alias("level"))
        old, have = have, store(have.unionByName(further).groupBy("type_name", "base").agg(F.min("level").alias("level")), "bases")
        before, n = n, have.count()
        drop(old)
        if n == before:
            break
    return have


def with_inherited(members: DataFrame, bases: DataFrame, interfaces: DataFrame | None = None) -> DataFrame:
    """members of each type with those of all its bases (type_name, base) and inherited_from, the base they come from, null for the type's own.

    members: type_name, name, kind, is_virtual, is_abstract, is_override, and others, all of which are kept; a signature tells overloads apart for interfaces. A base's virtual or
    abstract method is left out if the type itself, not one between, overrides a method of that name, whatever its parameters; everything else of a base comes
    out, also what a nearer type hides, and constructors. interfaces (type_name, interface) adds the members of each interface of a type that neither the type nor a
    base of it has by name, kind and signature. Repeated rows count once; a base without members adds nothing. Chains have any length.
    """
    own = members.distinct()
    above = ancestors(bases)
    overridden = own.filter("kind = 'Method' AND is_override").select("type_name", "name").distinct()
    found = above.select("type_name", "base").join(own.withColumnRenamed("type_name", "base"), "base")
    open_method = (F.col("kind") == "Method") & (F.coalesce("is_virtual", F.lit(False)) | F.coalesce("is_abstract", F.lit(False)))
    hit = overridden.withColumn("hit", F.lit(True))
    found = found.join(hit, ["type_name", "name"], "left").filter(~(open_method & F.col("hit").isNotNull())).drop("hit")
    out = own.withColumn("inherited_from", F.lit(None).cast("string")).unionByName(found.withColumnRenamed("base", "inherited_from"))
    if interfaces is not None:
        key = ["type_name", "name", "kind", "signature"]
        wanted = interfaces.select("type_name", F.col("interface").alias("inherited_from")).distinct().join(own.withColumnRenamed("type_name", "inherited_from"), "inherited_from")
        has = own.select(*key).unionByName(above.select("type_name", "base").join(own.withColumnRenamed("type_name", "base"), "base").select(*key)).distinct()
        out = out.unionByName(wanted.join(has, key, "left_anti").select(*out.columns))
    return out


def insert_index(members: DataFrame) -> DataFrame:
    """Per type of members (type_name, kind, pos from 0 without gaps), the place where a new member goes.

    after_fields, after_constructors and after_properties stand behind the last of their kind; without one, properties go where constructors would, constructors where fields would,
    fields to the start. before_methods is the place of the first method, else the end. Fields, constructors and properties go behind their kind, all others to the end.
    """
    after = lambda k: F.max(F.when(F.col("kind") == k, F.col("pos"))) + 1
    start, end = F.lit(0).cast("long"), F.count("*")
    field, ctor, prop = after("Field"), after("Constructor"), after("Property")
    return members.groupBy("type_name").agg(
        start.alias("start"),
        end.alias("end"),
        F.coalesce(field, start).alias("after_fields"),
        F.coalesce(ctor, field, start).alias("after_constructors"),
        F.coalesce(prop, ctor, field, start).alias("after_properties"),
        F.coalesce(F.min(F.when(F.col("kind") == "Method", F.col("pos"))), end).alias("before_methods"),
    )


def insert_at(places: DataFrame, kind: str | None = None, point: str | None = None) -> DataFrame:
    """(type_name, at) of insert_index for a new member of the kind, or at the point start, end, after-fields, after-constructors, after-properties or before-methods (any letter
    case; an unknown point is the end)."""
    points = {p.replace("_", "-"): p for p in ("start", "end", "after_fields", "after_constructors", "after_properties", "before_methods")}
    kinds = {"Field": "after_fields", "Constructor": "after_constructors", "Property": "after_properties"}
    column = points.get(point.lower(), "end") if point else kinds.get(kind or "", "end")
    return places.select("type_name", F.col(column).alias("at"))


def build_order(projects: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(name, level): 0 without dependencies (name, needs), else one more than the highest it needs. Projects on a cycle, or behind one, have a null level.

    A wave at a time: each takes the projects all of whose dependencies are placed, found by counting, not by following paths.
    """
    deps = checkpoint(dependencies.select("name", "needs").distinct().join(projects.select(F.col("name").alias("needs")), "needs", "left_semi"))
    left = checkpoint(projects.select("name").distinct())
    placed, level = None, 0
    while True:
        blocked = deps.join(left.select(F.col("name").alias("needs")), "needs", "left_semi").select("name").distinct()
        now = checkpoint(left.join(blocked, "name", "left_anti").withColumn("level", F.lit(level)))
        if now.isEmpty():
            break
        placed = now if placed is None else placed.unionByName(now)
        left = checkpoint(left.join(now, "name", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if placed is None else placed.unionByName(rest)


def pure_models(members: DataFrame) -> DataFrame:
    """Types (type_name) all of whose members are fields or automatic properties (is_auto)."""
    plain = (F.col("kind") == "Field") | ((F.col("kind") == "Property") & F.col("is_auto"))
    return members.groupBy("type_name").agg(F.every(plain).alias("pure")).filter("pure").select("type_name")


def without_attributes(symbols: DataFrame, attributes: DataFrame) -> DataFrame:
    """Symbols (file_path, line) at whose place no attribute (file_path, line) stands."""
    return symbols.join(attributes.select("file_path", "line"), ["file_path", "line"], "left_anti").select(*symbols.columns)


def add_using(usings: DataFrame, file: str, name: str) -> DataFrame:
    """usings (file, name) with the new one, each once, in order."""
    new = usings.sparkSession.createDataFrame([(file, name)], usings.select("file", "name").schema)
    return usings.select("file", "name").unionByName(new).distinct().orderBy("file", "name")


def known_member(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """candidates (id, qualified_name) with the first member (project, type_name, name) of their type and name, split at the last dot of the whole name."""
    cut = F.regexp_extract("qualified_name", r"^(.*)\.([^.]*)$", 1)
    c = candidates.withColumn("type_name", cut).withColumn("name", F.regexp_extract("qualified_name", r"^(.*)\.([^.]*)$", 2))
    first = members.groupBy("type_name", "name").agg(F.min("project").alias("project"))
    return c.join(first, ["type_name", "name"]).select("id", "project")
