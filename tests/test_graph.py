import pytest
from pyspark.sql import functions as F

from larkspan.operators import graph, members, resolve, search

SYMBOLS = "id long, solution_id long, kind string, name string, qualified_name string, file_path string, line int, status string"


def symbols(spark, names, kind="Method", path="src/A.cs", status="Pending"):
    return spark.createDataFrame([(i, 1, kind, n, f"N.T.{n}()", path, i, status) for i, n in enumerate(names, 1)], SYMBOLS)


def edges(spark, data):
    return spark.createDataFrame([(a, b, t) for a, b, t in data], "src long, dst long, edge_type string")


def reached(spark, e, start, **how):
    return sorted(r["id"] for r in graph.reach(e, spark.range(start, start + 1), **how).collect())


def test_fan_in_and_out(spark):
    s, e = symbols(spark, "ABC"), edges(spark, [(1, 3, "Calls"), (2, 3, "Calls"), (1, 2, "Reads"), (1, 3, "Reads")])
    assert sorted(r["name"] for r in graph.neighbours(s, e, [3]).collect()) == ["A", "A", "B"]
    assert sorted(r["name"] for r in graph.neighbours(s, e, [3], edge_type="Reads").collect()) == ["A"]
    assert sorted(r["name"] for r in graph.neighbours(s, e, [1], callers=False).collect()) == ["B", "C", "C"]


def test_chain_diamond_cycle(spark):
    chain = edges(spark, [(1, 2, "Calls"), (2, 3, "Calls"), (3, 4, "Calls")])
    assert reached(spark, chain, 4) == [1, 2, 3]
    assert reached(spark, chain, 4, max_depth=2) == [2, 3]
    assert reached(spark, chain, 4, max_depth=0) == []
    assert reached(spark, chain, 1, callers=False) == [2, 3, 4]
    assert reached(spark, chain, 4, edge_type="Reads") == []
    diamond = edges(spark, [(1, 2, "Calls"), (1, 3, "Calls"), (2, 4, "Calls"), (3, 4, "Calls")])
    assert reached(spark, diamond, 4) == [1, 2, 3]
    cycle = edges(spark, [(1, 2, "Calls"), (2, 3, "Calls"), (3, 1, "Calls")])
    assert reached(spark, cycle, 3) == [1, 2]


def test_long_chain_survives(spark):
    e = edges(spark, [(i, i + 1, "Calls") for i in range(1, 20)])
    assert reached(spark, e, 20) == list(range(1, 20))


def test_dead_code(spark):
    s = symbols(spark, ["Main", "Used1", "Used2", "Unused1", "Unused2", "Once", "_hidden", "Self"])
    e = edges(spark, [(1, 2, "Calls"), (2, 3, "Calls"), (8, 8, "Calls")])
    assert sorted(r["name"] for r in graph.without_callers(s, e).collect()) == ["Main", "Once", "Unused1", "Unused2", "_hidden"]
    dead = graph.dead_code(s, e)
    assert sorted(r["name"] for r in dead.collect()) == ["Unused1", "Unused2"]
    assert [r["name"] for r in graph.dead_code(s, e, references=spark.range(4, 5)).collect()] == ["Unused2"]
    assert "_hidden" in [r["name"] for r in graph.dead_code(s, e, include_private=True).collect()]
    nested = graph.grouped_members(dead, 1).first()
    assert nested["file_path"] == "src/A.cs" and [m["member"] for m in nested["types"]["T"]] == ["Unused1"]
    outside = symbols(spark, ["X"], path="external")
    assert graph.without_callers(outside, e).count() == 0


def test_statistics(spark):
    s, e = symbols(spark, "ABC"), edges(spark, [(1, 2, "Calls"), (1, 3, "Calls"), (2, 3, "Reads"), (1, 2, "References")])
    got = graph.edge_stats(s, e).first()
    assert (got["total"], got["calls"], got["reads"], got["references"]) == (3, 2, 1, 1)
    got = graph.symbol_stats(s).first()
    assert (got["total"], got["pending"], got["analyzed"]) == (3, 3, 0)


def test_changes_to_the_graph(spark):
    s, e = symbols(spark, "ABC"), edges(spark, [(1, 2, "Calls"), (2, 3, "Calls")])
    assert graph.add_edges(e, edges(spark, [(1, 2, "Calls"), (3, 1, "Reads"), (3, 1, "Reads")])).count() == 3
    s2, e2 = graph.delete_files(s.withColumn("file_path", F.concat(F.lit("f"), "id")), e, spark.createDataFrame([("f2",)], "file_path string"))
    assert s2.count() == 2 and e2.count() == 0
    s3, e3 = graph.delete_solution(s, e, 1)
    assert s3.count() == 0 and e3.count() == 0
    new = symbols(spark, ["D", "D"]).drop("id")
    assert graph.add_symbols(s, new).count() == 4
    assert graph.add_symbols(graph.add_symbols(s, new), new).count() == 4


RESOLVE = [
    ("Method", "LoadItemsAsync", "Shop.Core.CartService.LoadItemsAsync(string, int)"),
    ("Method", "LoadItemsAsync", "Shop.Core.StockService.LoadItemsAsync()"),
    ("Method", "StoreAsync", "Shop.Core.CartService.StoreAsync(Shop.Data.Item)"),
    ("Property", "Name", "Shop.Data.Item.Name"),
    ("Constructor", ".ctor", "Shop.Data.Item.Item(string)"),
    ("Constructor", ".ctor", "Shop.Data.Item.Item(string, int)"),
    ("Constructor", ".ctor", "Shop.Core.StockService.StockService()"),
]


@pytest.mark.parametrize(
    ("wanted", "status", "n"),
    [
        ("Shop.Data.Item.Name", "found", 1),
        ("Name", "found", 1),
        ("storeasync", "found", 1),
        ("CartService.LoadItemsAsync", "found", 1),
        ("LoadItemsAsync", "ambiguous", 2),
        ("Nothing", "not_found", 0),
        ("Shop.Data.Item..ctor(string)", "found", 1),
        ("Shop.Data.Item..ctor", "ambiguous", 2),
        ("StockService..ctor", "found", 1),
        (".ctor", "not_found", 0),
    ],
)
def test_resolution(spark, wanted, status, n):
    s = spark.createDataFrame([(i, 1, k, a, q, "f", 1, "Analyzed") for i, (k, a, q) in enumerate(RESOLVE)], SYMBOLS)
    got = resolve.find_symbol(s, 1, wanted).first()
    assert (got["status"], got["n"]) == (status, n) and len(got["candidates"]) == n and (got["id"] is not None) == (n == 1)


def test_overloads_and_single_rows(spark):
    s = spark.createDataFrame([(i, 1, k, a, q, "f", 1, "Analyzed") for i, (k, a, q) in enumerate(RESOLVE)], SYMBOLS)
    assert resolve.pick_overload(s, ".ctor", params="String,int").first()["status"] == "found"
    assert resolve.pick_overload(s, "StoreAsync", params="Item").first()["status"] == "found"
    assert resolve.pick_overload(s, ".ctor", "constructor").first()["n"] == 3
    assert resolve.exactly_one(s.filter("id = 3")).count() == 1 and resolve.exactly_one(s.filter("id = 99")).count() == 0
    with pytest.raises(Exception, match="more than one row"):
        resolve.exactly_one(s).collect()


def test_suggestions(spark):
    s = symbols(spark, ["GetTypeMembers", "Helper", "GetTypeMembersAsync", "gettypemembers", "Other"])
    got = [(r["name"], r["score"]) for r in search.suggestions(s, "GTM").collect()]
    assert got[0] == ("GetTypeMembers", -3)
    assert [(r["name"], r["score"], r["label"]) for r in search.suggestions(s, "GetTypMembers").collect()] == [("GetTypeMembers", -12, "distance: 1"), ("GetTypeMembersAsync", 6, "subsequence")]
    assert [(r["name"], r["score"]) for r in search.suggestions(s, "Helqer").collect()] == [("Helper", 1)]


def test_build_order_with_a_cycle(spark):
    p = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("y",)], "name string")
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("c", "elsewhere")], "name string, needs string")
    assert {r["name"]: r["level"] for r in members.build_order(p, deps).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}


def test_inherited_members(spark):
    schema = "type_name string, name string, kind string, signature string, is_virtual boolean, is_abstract boolean, is_override boolean"
    m = [("A", "f", "Method", "()", True, False, False), ("A", "f", "Method", "(int)", False, False, False), ("A", "A", "Constructor", "()", None, None, None), ("A", "P", "Property", "", True, False, False), ("B", "g", "Method", "()", False, False, False)]
    m += [("C", "f", "Method", "()", False, False, True), ("C", "P", "Property", "", False, False, True), ("I", "g", "Method", "()", False, True, False), ("I", "h", "Method", "()", False, True, False)]
    b = spark.createDataFrame([("C", "B"), ("B", "A"), ("A", "C")], "type_name string, base string")
    i = spark.createDataFrame([("C", "I")], "type_name string, interface string")
    got = {(r["type_name"], r["name"], r["signature"], r["inherited_from"]) for r in members.with_inherited(spark.createDataFrame(m, schema), b, i).collect()}
    of_c = {x[1:] for x in got if x[0] == "C" and x[3]}
    # Overrides hide open methods of their name only; hidden properties, overloads and constructors come out, and what a base has is no missing interface member.
    assert of_c == {("f", "(int)", "A"), ("A", "()", "A"), ("P", "", "A"), ("g", "()", "B"), ("h", "()", "I")}
    assert ("B", "f", "()", "A") in got and ("A", "g", "()", "B") in got


def test_long_chains(spark):
    bases = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(150)], "type_name string, base string")
    above = members.ancestors(bases)
    assert above.count() == 150 * 151 // 2 and above.filter("type_name = 't0' AND base = 't150'").first()["level"] == 150
    assert members.ancestors(bases.limit(0)).count() == 0


def test_places_for_members(spark):
    m = spark.createDataFrame([("A", k, i) for i, k in enumerate(["Event", "Method", "Field"])] + [("B", "Method", 0), ("B", "Event", 1)], "type_name string, kind string, pos int")
    places = members.insert_index(m)
    at = lambda **how: {r["type_name"]: r["at"] for r in members.insert_at(places, **how).collect()}
    assert at(kind="Field") == at(kind="Constructor") == at(kind="Property") == {"A": 3, "B": 0}
    assert at(kind="Method") == at(kind="Event") == at(point="end") == at(point="nowhere") == {"A": 3, "B": 2}
    assert at(point="Before-Methods") == {"A": 1, "B": 0} and at(point="start", kind="Method") == {"A": 0, "B": 0}


def test_types_without_files_and_usings(spark):
    u = spark.createDataFrame([("a", "System"), ("a", "Zeta")], "file string, name string")
    assert [r["name"] for r in members.add_using(u, "a", "Linq").collect()] == ["Linq", "System", "Zeta"]


def test_members_of_a_name(spark, rows):
    m = [(1, "A"), (2, "A"), (3, "A"), (4, "B"), (5, None), (6, None)]
    calls = edges(spark, [(9, 2, "Calls"), (9, 3, "Calls"), (1, 1, "Calls"), (9, 4, "Calls"), (9, 5, "Calls"), (9, 7, "Calls")])
    got = graph.through_names(calls, spark.createDataFrame(m, "id long, name string"))
    assert rows(got) == [(1, 1, "Calls"), (1, 2, "Calls"), (1, 3, "Calls"), (9, 2, "Calls"), (9, 3, "Calls"), (9, 4, "Calls"), (9, 5, "Calls"), (9, 7, "Calls")]
    pairs = spark.createDataFrame([(a, b) for a, x in m for b, y in m if x and x == y and a < b], "interface_member long, member long")
    assert rows(graph.through_interfaces(calls, pairs)) == rows(got)


def test_result_of_a_common_name_is_not_shuffled(spark):
    # 300 members of a name, of which each of 200 sources calls 30: far more pairs than rows of the input.
    m = spark.range(300).selectExpr("id", "'A' AS name")
    calls = spark.range(6000).selectExpr("1000 + id % 200 AS src", "id DIV 200 * 10 AS dst", "'Calls' AS edge_type")
    got = graph.through_names(calls, m)
    assert got.count() == 200 * 300 and got.distinct().count() == 200 * 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join", 1)[0]  # nothing is made distinct after the join
