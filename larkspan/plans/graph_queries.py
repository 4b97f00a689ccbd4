"""Queries over symbols and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import predicates as P
from larkspan.functions import text as T
from larkspan.operators import graph, resolve, search
from larkspan.sources.tables import table

HUB, OTHER = 1, 1002  # the most called symbol, and a common one
SQL = """
WITH RECURSIVE sym AS (SELECT DISTINCT id, solution_id, kind, name, qualified_name, file_path, line, col_no, file_hash, status FROM symbols WHERE removed_at IS NULL),
edg AS (SELECT DISTINCT src, dst, edge_type FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL)
"""
OPERATORS: dict = {}


def sym(spark: SparkSession, d: str) -> DataFrame:
    return graph.live_symbols(table(spark, d, "symbols"))


def live(spark: SparkSession, d: str) -> DataFrame:
    return graph.live_rows(table(spark, d, "symbols"))


def edg(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_set(table(spark, d, "edges"))


def _add(name: str, sql: str | None):  # noqa: ANN202
    def register(f):  # noqa: ANN001, ANN202
        OPERATORS[name] = (f, SQL + sql if sql else None)
        return f

    return register


# neighbours
@_add("direct_callers", f"SELECT s.id, name, qualified_name, edge_type FROM edg JOIN sym s ON s.id = src WHERE dst = {HUB}")
def direct_callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(live(spark, d), table(spark, d, "edges"), [HUB]).select("id", "name", "qualified_name", "edge_type")


@_add("direct_callees", f"SELECT s.id, name, qualified_name, edge_type FROM edg JOIN sym s ON s.id = dst WHERE src = {OTHER}")
def direct_callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(live(spark, d), table(spark, d, "edges"), [OTHER], callers=False).select("id", "name", "qualified_name", "edge_type")


@_add("callers_by_edge_type", f"SELECT s.id, name FROM edg JOIN sym s ON s.id = src WHERE dst = {HUB} AND edge_type = 'Calls'")
def callers_by_edge_type(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(live(spark, d), table(spark, d, "edges"), [HUB], edge_type="Calls").select("id", "name")


def _seed(spark: SparkSession, i: int) -> DataFrame:
    return spark.range(i, i + 1)


def _walk(at: str, to: str, seed: int, depth: int | None, where: str = "") -> str:
    if depth is None:
        return f", w AS (SELECT {seed}::BIGINT AS id UNION SELECT {to} FROM w JOIN edg ON {at} = w.id{where}), r AS (SELECT id FROM w WHERE id <> {seed}) "
    return f", w AS (SELECT {seed}::BIGINT AS id, 0 AS depth UNION SELECT {to}, w.depth + 1 FROM w JOIN edg ON {at} = w.id{where} WHERE w.depth < {depth}), r AS (SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING id <> {seed}) "


@_add("recursive_callers_d3", _walk("dst", "src", OTHER, 3) + "SELECT s.id, qualified_name, depth FROM r JOIN sym s USING (id)")
def recursive_callers_d3(spark: SparkSession, d: str) -> DataFrame:
    found = graph.reach(table(spark, d, "edges"), _seed(spark, OTHER), max_depth=3)
    return graph.reached_symbols(live(spark, d), found).select("id", "qualified_name", "depth")


@_add("recursive_callees_d3", _walk("src", "dst", OTHER, 3) + "SELECT s.id, qualified_name, depth FROM r JOIN sym s USING (id)")
def recursive_callees_d3(spark: SparkSession, d: str) -> DataFrame:
    found = graph.reach(table(spark, d, "edges"), _seed(spark, OTHER), callers=False, max_depth=3)
    return graph.reached_symbols(live(spark, d), found).select("id", "qualified_name", "depth")


@_add("recursive_callers_all", _walk("dst", "src", OTHER, None) + "SELECT s.id, qualified_name FROM r JOIN sym s USING (id)")
def recursive_callers_all(spark: SparkSession, d: str) -> DataFrame:
    return graph.reached_symbols(live(spark, d), graph.reach(table(spark, d, "edges"), _seed(spark, OTHER))).select("id", "qualified_name")


@_add("recursive_callers_typed", _walk("dst", "src", OTHER, None, " AND edge_type = 'Calls'") + "SELECT s.id FROM r JOIN sym s USING (id)")
def recursive_callers_typed(spark: SparkSession, d: str) -> DataFrame:
    return graph.reached_symbols(live(spark, d), graph.reach(table(spark, d, "edges"), _seed(spark, OTHER), edge_type="Calls")).select("id")


@_add("transitive_caller_files", _walk("dst", "src", OTHER, None) + "SELECT min(file_path) AS file_path FROM r JOIN sym s USING (id) WHERE file_path <> 'external' GROUP BY lower(file_path)")
def transitive_caller_files(spark: SparkSession, d: str) -> DataFrame:
    return graph.caller_files(live(spark, d), graph.reach(table(spark, d, "edges"), _seed(spark, OTHER)))


@_add("no_caller_symbols", "SELECT id, kind, qualified_name FROM sym WHERE file_path <> 'external' AND NOT EXISTS (SELECT 1 FROM edg WHERE dst = sym.id)")
def no_caller_symbols(spark: SparkSession, d: str) -> DataFrame:
    return graph.without_callers(sym(spark, d), edg(spark, d)).select("id", "kind", "qualified_name")


_DEAD = r""", dead AS (SELECT *, CASE WHEN len(string_split(qualified_name, '.')) > 1 THEN string_split(qualified_name, '.')[-2] ELSE '' END AS type_name FROM sym
WHERE file_path <> 'external' AND kind IN ('Method', 'Property') AND NOT EXISTS (SELECT 1 FROM edg WHERE dst = sym.id)
AND NOT (name IN ('Main', 'RunAsync', 'ConfigureServices', 'Configure', 'Dispose', 'DisposeAsync') OR name LIKE 'On%' OR name LIKE 'get\_%' ESCAPE '\' OR name LIKE 'set\_%' ESCAPE '\'
  OR contains(qualified_name, '.Program.') OR contains(qualified_name, '.Startup.'))
AND NOT regexp_matches(name, '^(_|\p{Ll})') AND NOT contains(lower(file_path), 'test')), kept AS (SELECT * FROM dead WHERE NOT (contains(lower(file_path), 'gen/') OR lower(type_name) LIKE '%factory')) """


def _dead(spark: SparkSession, d: str) -> DataFrame:
    return graph.dead_code(sym(spark, d), edg(spark, d), exclude_types=["Factory"], exclude_files=["gen/"])


@_add("dead_code_candidates", _DEAD + "SELECT id, file_path, type_name, name, kind, line FROM kept")
def dead_code_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _dead(spark, d).select("id", "file_path", "type_name", "name", "kind", "line")


@_add("dead_code_grouped", _DEAD + ", f AS (SELECT * FROM kept ORDER BY file_path, line, id LIMIT 100) SELECT file_path, type_name, count(*) AS n_members, min(line) AS first_line FROM f GROUP BY ALL")
def dead_code_grouped(spark: SparkSession, d: str) -> DataFrame:
    nested = graph.grouped_members(_dead(spark, d), 100)
    flat = nested.select("file_path", F.explode("types").alias("type_name", "members"))
    return flat.select("file_path", "type_name", F.size("members").cast("long").alias("n_members"), F.array_min(F.col("members.line")).alias("first_line"))


# statistics
_SYM_STATS = "count(*) FILTER (WHERE status = 'Analyzed') AS analyzed, count(*) FILTER (WHERE status = 'Pending') AS pending, count(*) FILTER (WHERE status = 'Dirty') AS dirty, count(*) FILTER (WHERE status IN ('Analyzed', 'Pending', 'Dirty'))"
_EDGE_STATS = ", ".join(f"count(*) FILTER (WHERE edge_type = '{k}') AS \"{k.lower()}\"" for k in P.EDGE_TYPES) + ", count(*) FILTER (WHERE edge_type <> 'References')"


@_add("symbol_stats", f"SELECT solution_id, {_SYM_STATS} AS total FROM sym GROUP BY solution_id")
def symbol_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbol_stats(sym(spark, d))


@_add("edge_stats", f"SELECT solution_id, {_EDGE_STATS} AS total FROM edg JOIN sym ON id = src GROUP BY solution_id")
def edge_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_stats(sym(spark, d), edg(spark, d))


@_add("graph_stats", f""", s AS (SELECT solution_id, {_SYM_STATS} AS symbols FROM sym GROUP BY solution_id), e AS (SELECT solution_id, {_EDGE_STATS} AS edges FROM edg JOIN sym ON id = src GROUP BY solution_id)
SELECT s.*, {", ".join(f"coalesce(\"{k}\", 0) AS \"{k}\"" for k in [*(x.lower() for x in P.EDGE_TYPES), "edges"])} FROM s LEFT JOIN e USING (solution_id)""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(sym(spark, d), edg(spark, d))


# filters and lookups
@_add("symbols_by_kind_status", "SELECT id, name FROM sym WHERE solution_id = 1 AND kind = 'Method' AND status = 'Analyzed'")
def symbols_by_kind_status(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbols_where(sym(spark, d), 1, "Method", "Analyzed").select("id", "name")


@_add("symbols_by_ids", "SELECT id, qualified_name FROM sym WHERE id IN (SELECT src FROM edg WHERE edge_type = 'Writes')")
def symbols_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = edg(spark, d).filter("edge_type = 'Writes'").select(F.col("src").alias("id"))
    return graph.by_ids(sym(spark, d), ids).select("id", "qualified_name")


@_add("symbol_ids_for_files", "SELECT id FROM sym WHERE file_path IN (SELECT file_path FROM sym WHERE kind = 'Constructor')")
def symbol_ids_for_files(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d)
    return graph.ids_of_files(s, s.filter("kind = 'Constructor'"))


@_add("file_in_graph", "SELECT count(*) > 0 AS present FROM sym WHERE file_path = 'external'")
def file_in_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.has_file(sym(spark, d), "external")


@_add("symbols_by_file", "SELECT id, line FROM sym WHERE solution_id = 1 AND kind = 'Method' AND file_hash IS NULL")
def symbols_by_file(spark: SparkSession, d: str) -> DataFrame:
    return graph.lookup(sym(spark, d), solution_id=1, kind="Method", file_hash=None).select("id", "line")


@_add("solution_files", "SELECT DISTINCT file_path FROM sym WHERE solution_id = 1 AND file_path <> 'external'")
def solution_files(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_list(sym(spark, d), 1)


@_add("file_symbol_counts", "SELECT file_path, count(*) AS n FROM sym GROUP BY file_path")
def file_symbol_counts(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).groupBy("file_path").agg(F.count("*").alias("n"))


@_add("all_solutions", "SELECT id, path, name, epoch_us(last_analyzed) AS analyzed_us, solution_hash FROM solutions")
def all_solutions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "solutions").select("id", "path", "name", F.unix_micros("last_analyzed").alias("analyzed_us"), "solution_hash")


@_add("all_symbols_project", "SELECT id, file_path FROM sym WHERE file_path ILIKE '%billing%'")
def all_symbols_project(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_project(sym(spark, d), "billing").select("id", "file_path")


@_add("all_edges_project", "SELECT src, dst, edge_type FROM edg WHERE src IN (SELECT id FROM sym WHERE solution_id = 3 AND file_path ILIKE '%src%')")
def all_edges_project(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_of_project(sym(spark, d), edg(spark, d), 3, "src")


# names
_ORDERED = "ORDER BY qualified_name, id LIMIT 100"


def _search(name: str, pattern: str, mode: str, where: str, kind: str = "all") -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return search.find(sym(spark, d), pattern, mode, kind).select("id", "qualified_name", "total")

    _add(name, f", h AS (SELECT * FROM sym WHERE {where}) SELECT id, qualified_name, (SELECT count(*) FROM h) AS total FROM h {_ORDERED}")(f)


_search("search_contains", "offsets", "contains", "contains(lower(name), 'offsets')")
_search("search_prefix", "rank", "prefix", "lower(name) LIKE 'rank%'")
_search("search_suffix", "async", "suffix", "lower(name) LIKE '%async'", "all")
_search("search_exact", "CountOffsets", "exact", "name = 'CountOffsets'")
_search("search_exact_ci", "countoffsets", "exactIgnoreCase", "lower(name) = 'countoffsets'")
_search("search_members", "o", "contains", "contains(lower(name), 'o') AND kind IN ('Method', 'Property', 'Field', 'Constructor', 'Event')", "member")

_TIERS = """, t AS (SELECT id, qualified_name, 0 AS tier FROM sym WHERE solution_id = 1 AND {0} UNION ALL SELECT id, qualified_name, 1 FROM sym WHERE solution_id = 1 AND ({1})),
b AS (SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t))
SELECT CASE count(*) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN count(*) = 1 THEN min(id) END AS id, count(*) AS n, string_agg(qualified_name, ' / ' ORDER BY qualified_name) AS candidates FROM b"""


def _resolve(name: str, wanted: str, exact: str, partial: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        found = resolve.find_symbol(sym(spark, d), 1, wanted)
        return found.select("status", "id", "n", F.when(F.col("n") > 0, F.array_join("candidates", " / ")).alias("candidates"))

    _add(name, _TIERS.format(exact, partial))(f)


_resolve("find_symbol_exact", "Corefold.Runtime.TicketTracker0.StageHeader(Stream)", "qualified_name = 'Corefold.Runtime.TicketTracker0.StageHeader(Stream)'", "false")
_resolve("find_symbol_partial", "VerifyRows", "qualified_name = 'VerifyRows'", "qualified_name ILIKE 'VerifyRows(%' OR qualified_name ILIKE '%.VerifyRows(%' OR qualified_name ILIKE '%.VerifyRows' OR name = 'VerifyRows'")


@_add("find_symbol_ctor", """, t AS (SELECT qualified_name AS q, split_part(qualified_name, '(', 1) AS h FROM sym WHERE name = '.ctor'),
x AS (SELECT DISTINCT q, regexp_replace(h, '\\.[^.]*$', '') || '..ctor' || '(' || regexp_extract(q, '\\((.*)\\)', 1) || ')' AS written FROM t)
SELECT written, q AS qualified_name FROM x""")
def find_symbol_ctor(spark: SparkSession, d: str) -> DataFrame:
    """Every constructor written as ..ctor and rewritten to its own name."""
    q = sym(spark, d).filter("name = '.ctor'")
    owner = F.regexp_replace(F.substring_index("qualified_name", "(", 1), r"\.[^.]*$", "")
    written = F.concat(owner, F.lit("..ctor("), T.parameters("qualified_name"), F.lit(")"))
    return q.select(written.alias("written")).distinct().select("written", T.constructor_name("written").alias("qualified_name"))


@_add("overload_pick", """, h AS (SELECT * FROM sym WHERE name = '.ctor' AND lower(kind) = 'constructor' AND lower(replace(regexp_extract(qualified_name, '\\((.*)\\)', 1), ' ', '')) = 'string,bool')
SELECT CASE count(*) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, count(*) AS n FROM h""")
def overload_pick(spark: SparkSession, d: str) -> DataFrame:
    return resolve.pick_overload(sym(spark, d), ".ctor", "constructor", "string, bool").select("status", "n")


_FUZZY = """, s AS (SELECT id, name, qualified_name, levenshtein('countofsets', lower(name)) AS dist, regexp_matches(lower(name), 'c.*o.*u.*n.*t.*o.*f.*s.*e.*t.*s') AS sub,
 starts_with(lower(array_to_string(regexp_extract_all(name, '(^.|\\p{Lu})', 1), '')), 'countofsets') AS ini, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS n FROM sym),
c AS (SELECT *, CASE WHEN ini AND sub THEN -11 WHEN sub AND dist <= 3 THEN dist - 11 WHEN dist <= 3 THEN dist WHEN sub AND length(name) <= 22 THEN dist END AS score FROM s WHERE n = 1)
SELECT id, name, score, CASE WHEN sub AND dist > 3 THEN 'subsequence' ELSE 'distance: ' || dist END AS label FROM c WHERE score IS NOT NULL ORDER BY score, lower(name), name DESC LIMIT 5"""


@_add("fuzzy_suggestions", _FUZZY)
def fuzzy_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return search.suggestions(sym(spark, d), "CountOfsets").select("id", "name", F.col("score").cast("int").alias("score"), "label")


@_add("projects_from_paths", """, p AS (SELECT DISTINCT list_reverse(string_split(file_path, '/')[1:-2]) AS l FROM sym WHERE file_path <> 'external')
SELECT DISTINCT coalesce(list_filter(l, lambda x: x NOT IN ('src', 'Source', 'source', 'obj', 'bin', 'Debug', 'Release', 'net8.0', 'net10.0') AND (contains(x, '.') OR (length(x) > 2 AND regexp_matches(x, '^\\p{Lu}'))))[1], l[1]) AS project FROM p WHERE len(l) > 0""")
def projects_from_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.projects(sym(spark, d))


@_add("type_name_extract", """SELECT id, CASE WHEN len(string_split(split_part(qualified_name, '(', 1), '.')) > 1 THEN string_split(split_part(qualified_name, '(', 1), '.')[-2] END AS type_name,
 CASE WHEN len(string_split(qualified_name, '.')) > 1 THEN string_split(qualified_name, '.')[-2] ELSE '' END AS containing_type, regexp_extract(qualified_name, '\\((.*)\\)', 1) AS params FROM sym""")
def type_name_extract(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).select("id", T.type_name("qualified_name").alias("type_name"), T.containing_type("qualified_name").alias("containing_type"), T.parameters("qualified_name").alias("params"))


_LINE = "coalesce(CASE WHEN len(string_split(split_part(qualified_name, '(', 1), '.')) > 1 THEN string_split(split_part(qualified_name, '(', 1), '.')[-2] || '.' END, '') || name || ' ' || file_path || ':' || line"


@_add("callers_paged", f", h AS (SELECT DISTINCT s.* FROM edg JOIN sym s ON s.id = src WHERE dst = {HUB} AND contains(lower(file_path), 'src') AND contains(lower(string_split(file_path, '/')[-1]), 'er')) SELECT id, {_LINE} AS compact, (SELECT count(*) FROM h) AS total FROM h ORDER BY file_path, line, id LIMIT 50 OFFSET 20")
def callers_paged(spark: SparkSession, d: str) -> DataFrame:
    callers = graph.neighbours(live(spark, d), table(spark, d, "edges"), [HUB]).drop("edge_type", "target").distinct()
    return search.callers_page(callers, 50, 20, "src*", "er").select("id", "compact", "total")


@_add("symbol_lines", "SELECT id, qualified_name || ' (' || kind || ') ' || file_path || ':' || line AS compact FROM sym")
def symbol_lines(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).select("id", search.symbol_line("qualified_name", "kind", "file_path", "line", F.lit(False)).alias("compact"))


@_add("glob_filter", "SELECT id, file_path FROM sym WHERE regexp_matches(file_path, '^src/.*writer\\.cs$', 'i')")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).filter(P.glob("file_path", "src/*Writer.cs")).select("id", "file_path")


@_add("content_hash", "SELECT doc_id, upper(substr(sha256(text), 1, 16)) AS hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_hash("text").alias("hash"))


@_add("members_by_kind", """, m AS (SELECT CASE WHEN len(string_split(split_part(qualified_name, '(', 1), '.')) > 1 THEN string_split(split_part(qualified_name, '(', 1), '.')[-2] END AS type_name, kind, name FROM sym WHERE solution_id = 1)
SELECT type_name, kind, string_agg(name, ',' ORDER BY name) AS names FROM m WHERE type_name IS NOT NULL GROUP BY ALL""")
def members_by_kind(spark: SparkSession, d: str) -> DataFrame:
    m = sym(spark, d).filter("solution_id = 1").withColumn("type_name", T.type_name("qualified_name")).filter("type_name IS NOT NULL")
    return search.by_kind(m).select("type_name", F.explode("members").alias("kind", "names")).select("type_name", "kind", F.array_join("names", ",").alias("names"))


# changes to the graph
@_add("edge_insert_ignore", "SELECT src, dst, edge_type FROM edg UNION SELECT dst, src, 'Calls' FROM edg")
def edge_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    e = edg(spark, d)
    return graph.add_edges(e, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("Calls").alias("edge_type")))


@_add("delete_cascade", ", g AS (SELECT id FROM sym WHERE file_path LIKE 'gen/%') SELECT src, dst, edge_type FROM edg WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d)
    return graph.delete_files(s, edg(spark, d), s.filter("file_path LIKE 'gen/%'").select("file_path").distinct())[1]


@_add("delete_solution", "SELECT src, dst, edge_type FROM edg WHERE src NOT IN (SELECT id FROM sym WHERE solution_id = 1) AND dst NOT IN (SELECT id FROM sym WHERE solution_id = 1)")
def delete_solution(spark: SparkSession, d: str) -> DataFrame:
    return graph.delete_solution(sym(spark, d), edg(spark, d), 1)[1]


@_add("mark_dirty", "SELECT id, CASE WHEN file_path LIKE 'gen/%' THEN 'Dirty' ELSE status END AS status FROM sym")
def mark_dirty(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d)
    return graph.mark_dirty(s, s.filter("file_path LIKE 'gen/%'")).select("id", "status")


_IMPL = ", i AS (SELECT a.id AS im, b.id AS m FROM sym a JOIN sym b ON a.name = b.name AND a.id < b.id AND a.kind = 'Method' AND b.kind = 'Method')"


@_add("interface_expansion", _IMPL + " SELECT src, dst, edge_type FROM edg WHERE edge_type = 'Calls' UNION SELECT src, m, edge_type FROM edg JOIN i ON dst = im WHERE edge_type = 'Calls'")
def interface_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Methods of one name stand for an interface member (the smallest id) and what implements it."""
    return graph.through_names(edg(spark, d).filter("edge_type = 'Calls'"), sym(spark, d).filter("kind = 'Method'").select("id", "name"))


@_add("pending_targets", """SELECT DISTINCT solution_id + 1 AS solution_id, 'Method' AS kind, qualified_name, 'Pending' AS status FROM sym s
WHERE file_path <> 'external' AND NOT EXISTS (SELECT 1 FROM sym t WHERE t.solution_id = s.solution_id + 1 AND t.qualified_name = s.qualified_name)""")
def pending_targets(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d)
    return graph.pending_targets(s, s.withColumn("solution_id", F.col("solution_id") + 1)).select("solution_id", "kind", "qualified_name", "status")


@_add("edge_rules", """, o AS (SELECT e.src, e.dst, t.kind AS k, CASE WHEN e.edge_type = 'Calls' THEN 'invocation' WHEN e.edge_type = 'References' THEN 'identifier' ELSE 'memberAccess' END AS node, e.edge_type = 'Writes' AS w FROM edg e JOIN sym t ON t.id = e.dst)
SELECT src, dst, CASE node WHEN 'invocation' THEN 'Calls' WHEN 'memberAccess' THEN CASE WHEN k = 'Property' THEN 'Accesses' WHEN k = 'Field' THEN CASE WHEN w THEN 'Writes' ELSE 'Reads' END END
 ELSE CASE WHEN k = 'Field' THEN CASE WHEN w THEN 'Writes' ELSE 'Reads' END WHEN k = 'Property' THEN CASE WHEN w THEN 'Writes' ELSE 'Accesses' END WHEN k = 'Method' THEN 'References' END END AS made FROM o""")
def edge_rules(spark: SparkSession, d: str) -> DataFrame:
    e = edg(spark, d).join(sym(spark, d).select(F.col("id").alias("dst"), F.col("kind")), "dst")
    node = F.when(F.col("edge_type") == "Calls", "invocation").when(F.col("edge_type") == "References", "identifier").otherwise("memberAccess")
    return e.select("src", "dst", graph.edge_type_of(node, F.col("kind"), F.col("edge_type") == "Writes", F.lit(False)).alias("made"))


@_add("name_duplicates", ", r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS n FROM sym) SELECT id, name FROM r WHERE n = 1 AND name IS NOT NULL")
def name_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return search.first_per_name(sym(spark, d))
