import datetime
import json

import pytest
from pyspark.sql import functions as F

from larkspan.functions import predicates as P
from larkspan.functions import text as T
from larkspan import schemas
from larkspan.operators import build, changes, diagnostics, graph, knowledge, orphans, usage
from larkspan.sources import logs
from larkspan.streaming import usage as streams


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.content_hash("a"), a="x") == "2D711642B726B044"
    assert one(spark, T.file_text_hash("a"), a="\ufeffx") == "2D711642B726B044"
    assert one(spark, T.constructor_name("a"), a="Ns.Type..ctor(p)") == "Ns.Type.Type(p)"
    assert one(spark, T.constructor_name("a"), a="..ctor") is None
    assert one(spark, T.type_name("a"), a="A.B.C(D.E)") == "B" and one(spark, T.type_name("a"), a="C") is None
    assert one(spark, T.containing_type("a"), a="A.B.C(D.E)") == "C(D"
    assert one(spark, T.parameters("a"), a="A.B(C(D))") == "C(D)" and one(spark, T.parameters("a"), a="A.B") == ""
    assert one(spark, T.project_name("a"), a="C:\\x\\My.App\\src\\f.cs") == "My.App"
    assert one(spark, T.project_name("a"), a="f.cs") is None and one(spark, T.project_name("a"), a="src/f.cs") == "src"
    assert one(spark, T.relative_path("a", "/Root/x"), a="/root/X/y/z.cs") == "y/z.cs"
    assert one(spark, T.relative_path("a", "/a/repo"), a="/a/repo2/x.cs") == "/a/repo2/x.cs"
    assert one(spark, T.using_name("a"), a=" using System.Linq; ") == "System.Linq"
    assert one(spark, T.shortened("a"), a="x" * 101) == "x" * 100 + "..." and one(spark, T.shortened("a"), a="x" * 100) == "x" * 100
    assert one(spark, T.version_key("a"), a="10.0.1-rc") == [10, 0, 1] and one(spark, T.version_key("a"), a="x") is None
    assert one(spark, T.body_hash("a"), a=" \n ") == "" and one(spark, T.body_hash("a"), a="a  b") == one(spark, T.body_hash("a"), a=" a\nb ")
    assert T.search_terms('a:"b c*" (d)') == ["a", "b", "c", "d"] and T.search_terms("*()") == []


def test_text_edit(spark):
    edit = lambda old, everything=False: one(spark, T.text_edit("t", F.lit(old), F.lit("Z"), everything), t="return a + b;\r\nreturn a;")
    assert tuple(edit("a + b")) == ("replaced", 1, "return Z;\nreturn a;")
    assert edit("return")["status"] == "ambiguous" and edit("return", True)["text"] == "Z a + b;\nZ a;"
    assert edit("nothing")["status"] == "not_found" and edit("")["status"] == "not_found"


@pytest.mark.parametrize(("pattern", "value", "fits"), [("*Service.cs", "src/UserService.cs", True), ("Service", "src/UserService.cs", True), ("x*", "src/x", False), ("", None, True), (None, "", True), ("a", None, False), ("a.c", "abc", False), ("A*C", "a.b.c", True)])
def test_glob(spark, pattern, value, fits):
    assert spark.createDataFrame([(value,)], "v string").filter(P.glob("v", pattern)).count() == int(fits)


def test_other_predicates(spark):
    assert one(spark, P.source_file("p"), p="a/X.G.CS") is False and one(spark, P.source_file("p", False), p="a/obj/X.cs") is True
    assert one(spark, P.wpf_project("p"), p="<UseWPF>true</UseWPF>") is True
    rule = lambda ident, option, on=True, severity="Warning": one(spark, P.suppression(F.lit(ident), F.lit(False), F.lit(option).cast("string"), F.lit(on), F.lit(severity)))
    assert rule("CS1", "Suppress") == rule("CA1", "hidden") == "project settings" and rule("CS1", None, False) is None and rule("CA1", "warn", False) is None
    assert rule("CA1", None, False) == rule("CA1", None, True, "Hidden") == "disabled by default" and rule("CA1", None) is None
    assert P.required({"a": "x"}, "a") == "x" and P.required_int({"a": 2}, "a", 1) == 2
    assert P.optional({}, "a", 5) == 5 and P.optional({"a": 7}, "a", 5) == 7 and P.optional({"a": ["x", ""]}, "a", None, list) == ["x"] and P.optional({"a": 1}, "a", 0.5) == 1
    for bad in ({"a": "x"}, {"a": True}):
        with pytest.raises(ValueError, match="must be int"):
            P.optional(bad, "a", 1)
    for bad in ({}, {"a": " "}):
        with pytest.raises(ValueError, match="required"):
            P.required(bad, "a")
    with pytest.raises(ValueError, match="at least 1"):
        P.required_int({"a": 0}, "a", 1)


def test_file_changes(spark, rows):
    stored = spark.createDataFrame([("Existing", "hash1"), ("Stale", "old_hash"), ("Gone", "h")], "file_path string, content_hash string")
    now = spark.createDataFrame([("Existing", "hash1"), ("Stale", "new_hash"), ("New", "hash3")], "file_path string, content_hash string")
    assert rows(changes.needing_analysis(stored, now)) == [("New",), ("Stale",)]
    assert rows(changes.stale(stored, now)) == [("Gone",), ("Stale",)]
    assert rows(changes.deleted(stored, now)) == [("Gone",)] and rows(changes.unchanged(stored, now)) == [("Existing",)]
    assert rows(changes.upsert_hash(stored, now)) == [("Existing", "hash1"), ("Gone", "h"), ("New", "hash3"), ("Stale", "new_hash")]


def test_refresh_keeps_calls_from_unchanged_files(spark, rows):
    s = spark.createDataFrame([(1, 1, "a", "A"), (2, 1, "b", "B"), (3, 1, "b", "C")], "id long, solution_id long, file_path string, qualified_name string")
    e = spark.createDataFrame([(1, 2, "Calls"), (2, 3, "Calls"), (1, 3, "Calls")], "src long, dst long, edge_type string")
    stale = spark.createDataFrame([(1, "b")], "solution_id long, file_path string")
    again = spark.createDataFrame([(20, 1, "b", "B")], s.schema)
    kept, out = changes.refresh(s, e, stale, again, spark.createDataFrame([(1, "B", "A", "Reads")], "solution_id long, src_name string, dst_name string, edge_type string"))
    assert rows(out) == [(1, 20, "Calls"), (20, 1, "Reads")] and kept.count() == 2


def test_refresh_of_one_solution_leaves_the_others(spark, rows):
    s = spark.createDataFrame([(1, 1, "f", "A"), (2, 1, "g", "B"), (11, 2, "f", "A"), (12, 2, "g", "B"), (13, 2, "h", "B")], "id long, solution_id long, file_path string, qualified_name string")
    e = spark.createDataFrame([(11, 12, "Calls"), (12, 13, "Calls"), (1, 2, "Calls"), (11, 2, "Reads")], "src long, dst long, edge_type string")
    named = "solution_id long, src_name string, dst_name string, edge_type string"
    none = spark.createDataFrame([], named)
    _, out = changes.refresh(s, e, spark.createDataFrame([(1, "zzz")], "solution_id long, file_path string"), s.limit(0), none)
    assert rows(out) == rows(e)
    again = spark.createDataFrame([(20, 1, "g", "B")], s.schema)
    _, out = changes.refresh(s, e, spark.createDataFrame([(1, "g")], "solution_id long, file_path string"), again, spark.createDataFrame([(1, "B", "A", "Calls")], named))
    assert rows(out) == [(1, 20, "Calls"), (11, 12, "Calls"), (11, 20, "Reads"), (12, 13, "Calls"), (20, 1, "Calls")]


def test_solutions_and_states(spark, rows):
    known = spark.createDataFrame([(1, "a/x.sln"), (2, "a\\y.sln")], "id long, path string")
    got = changes.get_or_create(known, spark.createDataFrame([("A\\X.sln", "x"), ("b.sln", "b"), ("A/y.sln", "y")], "path string, name string")).collect()
    assert {(r["name"], r["created"]) for r in got} == {("x", False), ("b", True), ("y", False)}
    states = spark.createDataFrame([("s", "a", 1), ("s", "b", 3), ("s", "c", 2)], "k string, v string, t int")
    assert rows(changes.latest(states, ["k"], "t")) == [("s", "b", 3)]
    assert changes.first_by_priority(states, "v", F.when(F.col("v") == "c", 0).otherwise(1)).first()["v"] == "c"


ENTRIES = "id long, category string, title string, content string, embedding array<float>, confidence double, updated_at timestamp"


def entries(spark):
    t = datetime.datetime(2030, 1, 1)
    return spark.createDataFrame([(1, "gotcha", "cache", "cache cache trap", [1.0, 0.0], 1.0, t), (2, "lesson", "other", "cached value", [0.3, 0.953939], 0.5, t), (3, "lesson", None, None, None, None, None), (4, "x", "plain", "nothing", [0.0, 0.0], 0.1, t), (5, "x", "plain", "nothing", [1.0], 0.1, t)], ENTRIES)


def test_search_layers(spark, rows, tmp_path):
    e = entries(spark)
    assert [r["id"] for r in knowledge.bm25(e, "cache").collect()] == [1, 2]
    index = knowledge.TextIndex.build(e, str(tmp_path / "index"))
    for q in ("cache", "ca pl", "plain nothing value", "zebra", "*"):
        assert rows(index.bm25(q).select("id", F.round("score", 9))) == (rows(knowledge.bm25(e, q).select("id", F.round("score", 9))) if knowledge.search_terms(q) else [])
    assert knowledge.bm25(e, "zebra").count() == 0
    assert [round(r["score"], 6) for r in knowledge.scaled(spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "id long, score double")).orderBy("id").collect()] == [1.0, 0.5, 0.0]
    assert [r["score"] for r in knowledge.scaled(spark.createDataFrame([(1, 3.0)], "id long, score double")).collect()] == [1.0]
    assert [r["id"] for r in knowledge.vector_hits(e, [1.0, 0.0], 0.29).collect()] == [1, 2]
    links = spark.createDataFrame([(1, "A.B"), (2, "A.B.C"), (3, "A.BC"), (3, None)], "knowledge_id long, symbol_name string")
    assert rows(knowledge.link_hits(links, ["A.B"])) == [(1,), (2,)]
    hit = lambda score: spark.createDataFrame([(1, score, 1)], "id long, score double, rank int")
    got = knowledge.fuse([("symbol", 1.0, hit(1.0)), ("fts", 0.7, hit(1.0)), ("vector", 0.8, hit(0.5))]).first()
    assert round(got["score"], 6) == 2.1 and got["sources"] == "symbol+fts+vector"
    assert [r["id"] for r in knowledge.hybrid(e, links, "cache", [1.0, 0.0], ["A.B"]).collect()] == [1, 2]
    full = {r["id"]: (r["symbols"], r["tags"]) for r in knowledge.with_related(e, links, spark.createDataFrame([(1, "t")], "knowledge_id long, tag string")).collect()}
    assert full[1] == (["A.B"], ["t"]) and full[4] == ([], [])


def test_known_symbols(spark, rows):
    s = spark.createDataFrame([(1, "A.B"), (2, "A.B.C"), (3, "A"), (4, "A.BC")], "id long, qualified_name string")
    assert rows(knowledge.known_symbols(s, spark.createDataFrame([("A.B",), (None,)], "symbol_name string"))) == [(1,), (2,), (3,)]


def test_adding_entries(spark):
    e = entries(spark)
    none = spark.createDataFrame([], "knowledge_id long, symbol_name string, link_type string")
    tags = spark.createDataFrame([], "knowledge_id long, tag string")
    schema = "category string, title string, content string, symbols array<string>, tags array<string>, embedding array<float>"
    new = spark.createDataFrame([("Gotcha", "t", "c", ["A"], ["Big"], None)], schema)
    got = knowledge.add_entries(e, none, tags, new, "2030-01-01", P.CATEGORIES)
    assert [x.count() for x in got] == [6, 1, 1] and got[2].first()["tag"] == "big" and got[1].first()["link_type"] == "about"
    bad = spark.createDataFrame([("nope", "t", "c", ["A"], ["Big"], None)], schema)
    with pytest.raises(Exception, match="unknown category"):
        knowledge.add_entries(e, none, tags, bad, "2030-01-01", P.CATEGORIES)[0].collect()


def log_lines():
    base = {"timestamp": "2030-01-01T10:00:00Z", "tool": "Find", "success": True, "durationMs": 1, "inputChars": 1, "outputChars": 2}
    return [base, base | {"durationMs": 2, "outputTokens": 4, "tokensPerSecond": 0.2}, base | {"success": False, "outputTokens": 1, "tokensPerSecond": 0.3}, base | {"tool": "Other", "timestamp": "2029-01-01T00:00:00Z"}]


def test_usage_log(spark, tmp_path):
    text = "\n".join(json.dumps(x) for x in log_lines())
    (tmp_path / "a.jsonl").write_text(text + '\n\n{"broken": \n{"tool": "Find", "durationMs": "many"}\n')
    calls = logs.read_log(spark, str(tmp_path / "a.jsonl"))
    assert calls.count() == len(calls.collect()) == 4
    tools = {r["tool"]: r for r in usage.by_tool(calls).collect()}
    assert tools["Find"]["avg_ms"] == 1 and tools["Find"]["avg_speed"] == 0.2 and tools["Other"]["avg_speed"] is None
    t = usage.totals(calls).first()
    assert (t["total_calls"], t["failed"], t["success_rate"]) == (4, 1, 75.0)
    assert usage.totals(calls.limit(0)).first()["success_rate"] == 0.0
    assert usage.since(calls, "2030-01-01 12:00:00", 3).count() == 3
    assert usage.by_tool(calls, "oth").count() == 1 and "| Find | 3 |" in usage.report(calls)
    logs.append_log(calls, str(tmp_path / "out"))
    assert logs.read_log(spark, str(tmp_path / "out")).count() == 4


def test_stream_equals_batch(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    for i, x in enumerate(log_lines()):
        (tmp_path / "in" / f"{i}.jsonl").write_text(json.dumps(x) + "\nnot json\n")
    stream = streams.run_to_end(streams.stream_by_tool(logs.stream_log(spark, str(tmp_path / "in"))), "calls_by_tool")
    assert rows(stream) == rows(usage.by_tool(logs.read_log(spark, str(tmp_path / "in"))))
    hourly = streams.run_to_end(streams.stream_hourly(logs.stream_log(spark, str(tmp_path / "in"))), "hourly", "complete")
    assert sorted(r["calls"] for r in hourly.collect()) == [1, 3]


def test_tokens(spark):
    key = b"k"
    make = lambda topic, ident, at: f"{topic}|{ident}|{at}|" + streams.signature(key, f"{topic}|{ident}|{at}")
    tokens = [("", "t"), ("a|b", "t"), (make("t", "1", 90)[:-1] + "?", "t"), (make("t", "1", "x"), "t"), (make("t", "1", 10), "t"), (make("u", "1", 90), "t"), (make("t", "2", 90), "t"), (make("T", "1", 90), "t")]
    df = spark.createDataFrame(tokens, "token string, expected_topic string")
    got = {r["token"]: r["result"] for r in streams.validate_tokens(df, spark.createDataFrame([("1",)], "token_id string"), key, 100).collect()}
    assert [got[t] for t, _ in tokens] == ["empty", "format", "signature", "time", "expired", "topic", "unknown", "valid"]
    issued = spark.createDataFrame([("1", "t", datetime.datetime(2030, 1, 1, 0, 0)), ("2", "t", datetime.datetime(2030, 1, 1, 0, 2))], "token_id string, topic string, issued_at timestamp")
    assert [r["token_id"] for r in streams.live_tokens(issued, "2030-01-01 00:02:30").collect()] == ["2"]


def test_tokens_as_keyed_state(spark, tmp_path):
    import time

    (tmp_path / "in").mkdir()
    events = [{"token_id": "1", "topic": "t", "kind": "issue"}, {"token_id": "2", "topic": "u", "kind": "issue"}, {"token_id": "1", "topic": "T", "kind": "check"}, {"token_id": "2", "topic": "x", "kind": "check"}, {"token_id": "3", "topic": None, "kind": "check"}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, events)))
    for k, v in streams.ROCKS.items():
        spark.conf.set(k, v)
    try:
        got = []
        source = spark.readStream.schema("token_id string, topic string, kind string").json(str(tmp_path / "in"))
        q = streams.stream_tokens(source, 600).writeStream.foreachBatch(lambda batch, epoch: got.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="3 seconds").start()
        for _ in range(60):
            if len(got) >= 3 or not q.isActive:
                break
            time.sleep(1)
        q.stop()
        assert sorted(got) == [("1", "T", True), ("2", "x", False), ("3", None, False)]
    finally:
        for k in streams.ROCKS:
            spark.conf.unset(k)


def test_source_tree(spark, rows, tmp_path):
    for name, text in (("a/X.cs", "x"), ("a/obj/Y.cs", "y"), ("a/Z.g.cs", "z"), ("a/obj/W.g.cs", "w"), ("a/n.txt", "n"), ("b/Q.cs", "\ufeffx")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = logs.source_tree(spark, str(tmp_path), "2030-01-01")
    assert rows(files.select("file_path", "content_hash")) == [("a/X.cs", "2D711642B726B044"), ("b/Q.cs", "2D711642B726B044")]
    assert logs.generated_files(spark, str(tmp_path)).count() == 1
    (tmp_path / "s.sln").write_text('Project("{X}") = "A", "a\\A.csproj", "{Y}"\nProject("{X}") = "F", "folder", "{Y}"\nGlobal\n')
    assert rows(logs.solution_projects(spark, str(tmp_path / "s.sln"))) == [("a\\A.csproj",)]
    (tmp_path / "Topic.md").write_text("hello")
    assert rows(logs.topics(spark, str(tmp_path))) == [("topic", "hello")]
    known = spark.createDataFrame([("a",)], "path string")
    assert rows(logs.add_missing_files(known, spark.createDataFrame([("A",), ("b",), ("B",)], "path string")))[0] == ("a",)
    assert json.loads(logs.envelope(known).first()["json"]) == {"path": "a"}


def test_places(spark, rows):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["a", "", " ", "b", ""])], "file string, line_no int, text string")
    assert [r["text"] for r in diagnostics.without_double_blanks(lines).orderBy("line_no").collect()] == ["a", "", "b", ""]
    spans = spark.createDataFrame([("f", 1, 10, "outer"), ("f", 3, 5, "inner"), ("g", 1, 200, "far")], "file string, first int, last int, name string")
    places = spark.createDataFrame([(1, "f", 4), (2, "f", 5), (3, "f", 10), (4, "g", 150)], "key int, file string, at int")
    assert rows(diagnostics.enclosing(places, spans)) == [(1, "inner"), (2, "outer"), (4, "far")]
    assert rows(diagnostics.overlapping(spans, spans.filter("name = 'inner'")).select("name")) == [("inner",), ("outer",)]
    assert diagnostics.in_span(spans, "f", 6, 9).count() == 1


SYMBOLS = "id long, qualified_name string, added_at timestamp, removed_at timestamp, key int, page int"
EDGES = "src long, dst long, edge_type string, recorded_at timestamp, loaded_at timestamp, name int"
LINKS = "knowledge_id long, symbol_name string, link_type string, linked_at timestamp, id int"


def day(n):
    return datetime.datetime(2030, 1, 1) + datetime.timedelta(days=n)


def test_orphans(spark, rows):
    s = [(i, f"N.T.m{i}(int)", day(0), None, 1, 1) for i in range(1, 50)] + [(60, "N.T.gone", day(0), day(1), 1, 1), (61, "N.T.back", day(0), day(1), 1, 1), (61, "N.T.back", day(20), None, 1, 1), (62, "N.T.null", None, None, 1, 1), (None, None, None, None, 1, 1), (-5, "N.T.neg", day(0), None, 1, 1)]
    s += s[:3]
    e = [(1, 2, "Calls", day(5), None, 1), (1, 60, "Calls", day(5), None, 1), (1, 60, "Calls", day(2), None, 1), (1, 61, "Calls", day(5), None, 1), (1, 61, "Reads", day(25), None, 1), (1, 62, "Calls", None, None, 1), (99, 50, None, day(40), None, 1), (None, 4, "Calls", day(1), None, 1), (-5, -6, "Calls", day(1), None, 1), (10**12, 1, "Calls", None, None, 1)]
    links = [(1, " N.T.m1\t", "x", day(1), 1), (1, "N.T.m1(int)", "x", day(1), 1), (1, "n.t.m1", "x", day(40), 1), (1, "N.T.gone", "x", day(1), 1), (2, "N.T.back", "x", day(1), 1), (2, None, "x", day(1), 1), (1, "n.t.m1", "y", day(1), 1)]
    got = orphans.orphan_references(spark.createDataFrame(s, SYMBOLS), spark.createDataFrame(e, EDGES), spark.createDataFrame(links, LINKS))
    assert rows(got) == sorted(
        [
            ("edges", "dst", "1|60|Calls", "deleted", "2030-01"),
            ("edges", "dst", "1|61|Calls", "late", "2030-01"),
            ("edges", "src", "99|50|", "missing", "2030-02"),
            ("edges", "dst", "99|50|", "missing", "2030-02"),
            ("edges", "dst", "-5|-6|Calls", "missing", "2030-01"),
            ("edges", "src", "1000000000000|1|Calls", "missing", None),
            ("knowledge_links", "symbol_name", "1|n.t.m1", "missing", "2030-01"),
            ("knowledge_links", "symbol_name", "1|N.T.gone", "deleted", "2030-01"),
            ("knowledge_links", "symbol_name", "2|N.T.back", "late", "2030-01"),
        ],
        key=repr,
    )


def test_orphans_of_empty_tables(spark, rows):
    none = lambda schema: spark.createDataFrame([], schema)
    assert orphans.orphan_references(none(SYMBOLS), none(EDGES), none(LINKS)).count() == 0
    one_edge = spark.createDataFrame([(1, 1, "Calls", day(0), None, 1)], EDGES)
    assert len(rows(orphans.orphan_references(none(SYMBOLS), one_edge, none(LINKS)))) == 2


def test_runs(spark, rows):
    data = [(i, day(i % 5), None) for i in (1, 2, 3, 7, 8, 63, 64)] + [(9, day(1), day(2)), (10, None, None), (-(2**63), day(0), None), (2**63 - 1, day(0), None)]
    runs = orphans.key_runs(orphans.parent_states(spark.createDataFrame(data, "key long, added_at timestamp, removed_at timestamp")))
    ends = [(-(2**63), -(2**63)), (1, 3), (10, 10), (2**63 - 1, 2**63 - 1), (63, 63), (64, 64), (7, 8), (9, 9)]
    assert rows(runs.select("first", "last")) == sorted(ends, key=repr)


def test_times_do_not_break_runs(spark):
    data = [(i, day(i % 28), day(30) if i % 100 == 7 else None) for i in range(1000) if i % 50]
    runs = orphans.key_runs(orphans.parent_states(spark.createDataFrame(data, "key long, added_at timestamp, removed_at timestamp")))
    assert runs.count() <= 20 + 2 * 10 + 1000 // 64 + 1  # holes, changes of state, pages


def test_ranked_names(spark, rows, monkeypatch):
    monkeypatch.setattr(orphans, "BUCKETS", 2)
    names = spark.createDataFrame([(f"n{i}",) for i in range(50)] + [("",)], "name string")
    got = orphans.ranked(names).collect()
    assert len({r["key"] for r in got}) == 51
    for bucket in (0, 1):
        own = sorted((r["key"], r["name"]) for r in got if r["key"] >> 32 == bucket)
        assert [k & 0xFFFFFFFF for k, _ in own] == list(range(1, len(own) + 1)) and [n for _, n in own] == sorted(n for _, n in own)


def test_orphans_against_brute_force(spark):
    import random

    rng = random.Random(9)
    parents = [(rng.randrange(-40, 300), day(rng.randrange(40)) if rng.random() < 0.95 else None, day(50) if rng.random() < 0.2 else None) for _ in range(260)]
    refs = [(rng.choice([None, 5, rng.randrange(-60, 330)]), day(rng.randrange(40)) if rng.random() < 0.9 else None, i) for i in range(900)]
    by = {}
    for k, added, removed in parents:
        by.setdefault(k, []).append((added, removed))
    expected = []
    for k, at, n in refs:
        if k is None:
            continue
        live = [a for a, r in by.get(k, []) if r is None]
        times = [a for a in live if a is not None]
        reason = "missing" if k not in by else "deleted" if not live else "late" if times and at is not None and min(times) > at else None
        expected += [(n, reason)] if reason else []
    got = orphans.orphans(spark.createDataFrame(refs, "key long, at timestamp, added_at int"), spark.createDataFrame(parents, "key long, added_at timestamp, removed_at timestamp"))
    assert sorted((r["added_at"], r["reason"]) for r in got.collect()) == sorted(expected)


def test_building(spark, rows):
    store = schemas.in_memory(spark)
    facts = spark.createDataFrame([(1, 1, "a", "A"), (2, 1, "b", "B"), (3, 1, "b", "I"), (4, 1, "c", "C")], "id long, solution_id long, file_path string, qualified_name string")
    occ = spark.createDataFrame([("a", "A", "I", "invocation", "Method", False, False), ("b", "B", "C", "identifier", "Field", True, False), ("b", "B", "C", "identifier", "Field", False, True)], schemas.SCHEMAS["occurrences"])
    impl = spark.createDataFrame([("I", "B")], "interface_name string, member_name string")
    none = facts.limit(0)
    now = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, content_hash string")
    empty = now.limit(0)
    e0 = store["edges"].select("src", "dst", "edge_type")
    s1, e1, f1 = build.incremental(1, empty, now, none, e0, facts, occ, impl)
    assert s1.count() == 4 and rows(e1) == [(1, 2, "Calls"), (1, 3, "Calls"), (2, 4, "Writes")]
    later = spark.createDataFrame([("a", "1"), ("b", "2")], now.schema)
    s2, e2, _ = build.incremental(1, f1, later, s1, e1, facts.filter("id <> 3"), occ.filter("false"), impl)
    assert rows(s2.select("id")) == [(1,), (2,)] and rows(e2) == [(1, 2, "Calls")]
    assert tuple(build.counts(now, later).first()) == (1, 1, 1)


def test_store(spark, tmp_path):
    store = schemas.in_memory(spark, knowledge_tags=[(1, "a")])
    store["knowledge_tags"].write.parquet(str(tmp_path / "knowledge_tags.parquet"))
    again = schemas.open_store(spark, str(tmp_path))
    assert again["knowledge_tags"].count() == 1 and again["symbols"].count() == 0 and not schemas.exists(spark, str(tmp_path))


def test_updates(spark, rows):
    s = spark.createDataFrame([(1, 1, "Method", "f", "h", "Pending"), (2, 1, "Field", "g", "h", "Pending")], "id long, solution_id long, kind string, file_path string, file_hash string, status string")
    assert rows(graph.mark_dirty(s, spark.createDataFrame([("f",)], "file_path string")).select("id", "status")) == [(1, "Dirty"), (2, "Pending")]
    assert rows(graph.set_hashes(s, spark.createDataFrame([("g", "n")], "file_path string, new_hash string")).select("id", "file_hash", "status")) == [(1, "h", "Pending"), (2, "n", "Analyzed")]
    assert graph.symbols_where(s, 1, "Method", "Pending").count() == 1 and graph.symbols_where(s, 1).count() == 2
    sol = spark.createDataFrame([(1, None, None)], "id long, last_analyzed timestamp, solution_hash string")
    assert graph.set_analyzed(sol, 1, "2030-01-01", "x").first()["solution_hash"] == "x"


def test_symbol_at_a_place(spark, rows):
    places = spark.createDataFrame([(1, "f", 2, 3)], "key int, file string, line int, col_no int")
    starts = spark.createDataFrame([("f", 1, 0), ("f", 2, 10)], "file string, line int, start int")
    spans = spark.createDataFrame([("f", 0, 100, "type"), ("f", 12, 20, "method"), ("f", 13, 20, "later")], "file string, first int, last int, name string")
    assert rows(diagnostics.symbol_at(places, starts, spans)) == [(1, "method")]
    kinds = spark.createDataFrame([("Type", "INTERFACE", "a"), ("Method", None, "get_x")], "k string, t string, n string")
    assert [r["x"] for r in kinds.select(P.kind_label("k", "t").alias("x")).collect()] == ["Interface", "Method"]
    assert kinds.filter(P.member_matches("k", "n")).count() == 1
