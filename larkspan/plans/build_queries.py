"""Queries over builds and refreshes of the graph, texts, files and tokens."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan import schemas
from larkspan.functions import predicates as P
from larkspan.functions import text as T
from larkspan.operators import build, changes, graph, knowledge, members, search
from larkspan.plans.graph_queries import SQL as GRAPH
from larkspan.plans.graph_queries import edg, sym
from larkspan.plans.record_queries import _entries, _links, _tags
from larkspan.sources import logs
from larkspan.sources.tables import table
from larkspan.streaming import usage as streams

OPERATORS: dict = {}
MOVED = 100_000_000  # what a symbol's id grows by when it is built again


def _add(name: str, sql: str | None):  # noqa: ANN202
    def register(f):  # noqa: ANN001, ANN202
        OPERATORS[name] = (f, sql)
        return f

    return register


# refresh: some files of three solutions that share names; of their symbols a fifth is gone after the new analysis
_REFRESH = """, st AS (SELECT DISTINCT solution_id, file_path FROM sym WHERE solution_id <= 3 AND file_path <> 'external' AND id % 4 = 0),
old AS (SELECT * FROM sym s WHERE EXISTS (SELECT 1 FROM st WHERE st.solution_id = s.solution_id AND st.file_path = s.file_path)),
kept AS (SELECT id, solution_id, qualified_name FROM sym WHERE id NOT IN (SELECT id FROM old) UNION ALL SELECT id + 100000000, solution_id, qualified_name FROM old WHERE id % 5 <> 0),
ids AS (SELECT solution_id, qualified_name, min(id) AS id FROM kept GROUP BY ALL),
facts AS (SELECT o.solution_id, o.qualified_name AS f, t.qualified_name AS t, edge_type FROM edg JOIN old o ON o.id = src JOIN sym t ON t.id = dst AND t.solution_id = o.solution_id),
fresh AS (SELECT src, dst, edge_type FROM edg WHERE src NOT IN (SELECT id FROM old) AND dst NOT IN (SELECT id FROM old)
 UNION SELECT src, ids.id, edge_type FROM edg JOIN old o ON o.id = dst JOIN ids ON ids.solution_id = o.solution_id AND ids.qualified_name = o.qualified_name WHERE src NOT IN (SELECT id FROM old)
 UNION SELECT a.id, b.id, edge_type FROM facts x JOIN ids a ON a.solution_id = x.solution_id AND a.qualified_name = x.f JOIN ids b ON b.solution_id = x.solution_id AND b.qualified_name = x.t)
"""


def _refreshed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s, e = sym(spark, d), edg(spark, d)
    stale = s.filter("solution_id <= 3 AND file_path <> 'external' AND id % 4 = 0").select("solution_id", "file_path").distinct()
    old = s.join(stale, ["solution_id", "file_path"], "left_semi").select(*s.columns)
    again = old.filter("id % 5 <> 0").withColumn("id", F.col("id") + MOVED)
    end = lambda df, c: df.select(F.col("id").alias(c), F.col("qualified_name").alias(f"{c}_name"), "solution_id")
    named = e.join(end(old, "src"), "src").join(end(s, "dst"), ["dst", "solution_id"]).select("solution_id", "src_name", "dst_name", "edge_type")
    return changes.refresh(s, e, stale, again, named)


@_add("refresh_edges", GRAPH + _REFRESH + "SELECT src, dst, edge_type FROM fresh")
def refresh_edges(spark: SparkSession, d: str) -> DataFrame:
    return _refreshed(spark, d)[1]


@_add("refresh_symbols", GRAPH + _REFRESH + "SELECT id, solution_id, qualified_name FROM kept")
def refresh_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _refreshed(spark, d)[0].select("id", "solution_id", "qualified_name")


# a build of solution 1: some of its files differ, some are gone; what is in the others is not analysed again
_BUILD = """, fl AS (SELECT DISTINCT file_path FROM sym WHERE solution_id = 1 AND file_path <> 'external'), gone AS (SELECT file_path FROM fl WHERE length(file_path) % 7 = 0), diff AS (SELECT file_path FROM fl WHERE length(file_path) % 7 <> 0 AND length(file_path) % 3 = 0),
old AS (SELECT * FROM sym WHERE solution_id = 1 AND file_path IN (SELECT file_path FROM gone UNION SELECT file_path FROM diff)),
kept AS (SELECT id, solution_id, qualified_name FROM sym WHERE id NOT IN (SELECT id FROM old) UNION ALL SELECT id + 100000000, solution_id, qualified_name FROM old WHERE file_path IN (SELECT file_path FROM diff)),
ids AS (SELECT solution_id, qualified_name, min(id) AS id FROM kept GROUP BY ALL),
occ AS (SELECT o.qualified_name AS f, t.qualified_name AS t, t.kind AS k, edge_type = 'Writes' AS w FROM edg JOIN old o ON o.id = src JOIN sym t ON t.id = dst WHERE o.file_path IN (SELECT file_path FROM diff)),
made AS (SELECT f, t, CASE WHEN k = 'Field' THEN CASE WHEN w THEN 'Writes' ELSE 'Reads' END WHEN k = 'Property' THEN CASE WHEN w THEN 'Writes' ELSE 'Accesses' END WHEN k = 'Method' THEN 'References' END AS edge_type FROM occ)
SELECT src, dst, edge_type FROM edg WHERE src NOT IN (SELECT id FROM old) AND dst NOT IN (SELECT id FROM old)
 UNION SELECT src, ids.id, edge_type FROM edg JOIN old o ON o.id = dst JOIN ids ON ids.solution_id = 1 AND ids.qualified_name = o.qualified_name WHERE src NOT IN (SELECT id FROM old)
 UNION SELECT a.id, b.id, edge_type FROM made JOIN ids a ON a.solution_id = 1 AND a.qualified_name = f JOIN ids b ON b.solution_id = 1 AND b.qualified_name = t WHERE edge_type IS NOT NULL"""


@_add("incremental_build", GRAPH + _BUILD)
def incremental_build(spark: SparkSession, d: str) -> DataFrame:
    s, e = sym(spark, d), edg(spark, d)
    size = F.length("file_path")
    files = graph.file_list(s, 1)
    stored = files.select("file_path", F.lit("h").alias("content_hash"))
    current = files.filter(size % 7 != 0).select("file_path", F.when(size % 3 == 0, "changed").otherwise("h").alias("content_hash"))
    facts = s.filter("solution_id = 1").withColumn("id", F.col("id") + MOVED)
    at = s.filter("solution_id = 1").select(F.col("id").alias("src"), F.col("qualified_name").alias("src_name"), "file_path")
    to = s.select(F.col("id").alias("dst"), F.col("qualified_name").alias("dst_name"), F.col("kind").alias("symbol_kind"))
    occurrences = e.join(at, "src").join(to, "dst").select("file_path", "src_name", "dst_name", F.lit("identifier").alias("node"), "symbol_kind", (F.col("edge_type") == "Writes").alias("is_write"), F.lit(False).alias("is_const"))
    return build.incremental(1, stored, current, s, e, facts, occurrences)[1]


@_add("declared_upsert", GRAPH + """, dec AS (SELECT DISTINCT solution_id, qualified_name FROM sym WHERE id % 3 = 0 AND qualified_name IS NOT NULL AND solution_id IS NOT NULL)
SELECT s.qualified_name, s.solution_id, CASE WHEN dec.qualified_name IS NULL THEN file_hash ELSE 'new' END AS file_hash, CASE WHEN dec.qualified_name IS NULL THEN status ELSE 'Analyzed' END AS status FROM sym s LEFT JOIN dec ON dec.solution_id = s.solution_id AND dec.qualified_name = s.qualified_name
UNION ALL SELECT DISTINCT qualified_name || '!', solution_id, 'new', 'Analyzed' FROM dec WHERE length(qualified_name) % 2 = 0""")
def declared_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d)
    known = s.filter("id % 3 = 0 AND qualified_name IS NOT NULL AND solution_id IS NOT NULL").withColumn("file_hash", F.lit("new"))
    unknown = known.filter("length(qualified_name) % 2 = 0").withColumn("qualified_name", F.concat("qualified_name", F.lit("!")))
    return build.upsert_declared(s, known.unionByName(unknown)).select("qualified_name", "solution_id", "file_hash", "status")


@_add("entry_symbols", GRAPH + "SELECT solution_id, file_path, min(line * 1000::BIGINT + col_no) AS place, 'Program.<Main>$' AS qualified_name FROM sym WHERE kind = 'Field' GROUP BY ALL")
def entry_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Fields stand for top-level statements."""
    made = build.entry_symbols(sym(spark, d).filter("kind = 'Field'"))
    return made.select("solution_id", "file_path", (F.col("line") * F.lit(1000).cast("long") + F.col("col_no")).alias("place"), "qualified_name")


@_add("set_hashes", GRAPH + "SELECT id, CASE WHEN file_path LIKE 'src/%' THEN upper(substr(sha256(file_path), 1, 16)) ELSE file_hash END AS file_hash, CASE WHEN file_path LIKE 'src/%' THEN 'Analyzed' ELSE status END AS status FROM sym")
def set_hashes(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d)
    hashes = s.filter("file_path LIKE 'src/%'").select("file_path", T.content_hash("file_path").alias("new_hash")).distinct()
    return graph.set_hashes(s, hashes).select("id", "file_hash", "status")


@_add("set_analyzed", "SELECT id, epoch_us(CASE WHEN id = 2 THEN TIMESTAMPTZ '2030-01-01 00:00:00+00' ELSE last_analyzed END) AS analyzed_us, CASE WHEN id = 2 THEN 'h' ELSE solution_hash END AS solution_hash FROM solutions")
def set_analyzed(spark: SparkSession, d: str) -> DataFrame:
    return graph.set_analyzed(table(spark, d, "solutions"), 2, "2030-01-01", "h").select("id", F.unix_micros("last_analyzed").alias("analyzed_us"), "solution_hash")


@_add("symbols_added", GRAPH + "SELECT solution_id, kind, qualified_name FROM sym UNION ALL SELECT DISTINCT solution_id, 'Event', qualified_name FROM sym WHERE kind = 'Method'")
def symbols_added(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d)
    return graph.add_symbols(s, s.filter("kind = 'Method'").withColumn("kind", F.lit("Event"))).select("solution_id", "kind", "qualified_name")


@_add("get_or_create_solutions", """WITH w AS (SELECT upper(replace(path, '/', chr(92))) AS path, name FROM solutions UNION ALL SELECT 'new/' || path, name FROM solutions),
k AS (SELECT lower(replace(path, chr(92), '/')) AS key, min(id) AS id FROM solutions GROUP BY ALL) SELECT name, k.id IS NULL AS created, k.id AS known FROM (SELECT DISTINCT ON (lower(replace(path, chr(92), '/'))) * FROM w WHERE path IS NOT NULL) w LEFT JOIN k ON k.key = lower(replace(w.path, chr(92), '/'))""")
def get_or_create_solutions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "solutions").filter("path IS NOT NULL")
    wanted = s.select(F.upper(F.replace("path", F.lit("/"), F.lit("\\"))).alias("path"), "name").unionByName(s.select(F.concat(F.lit("new/"), "path").alias("path"), "name"))
    return changes.get_or_create(s, wanted).select("name", "created", F.when(~F.col("created"), F.col("id")).alias("known"))


@_add("build_counts", """WITH c AS (SELECT doc_id, 'f/' || doc_id AS p FROM documents) SELECT count(*) FILTER (WHERE doc_id % 11 = 0 OR doc_id % 7 = 0) AS analysed, count(*) FILTER (WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0) AS kept, (SELECT count(*) FROM c WHERE doc_id % 13 = 0) AS dropped FROM c""")
def build_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of the documents as files every eleventh is new and every seventh differs; every thirteenth was also stored under a path that is gone."""
    key = F.col("doc_id")
    now = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f/"), key).alias("file_path"), F.lit("h").alias("content_hash"))
    before = now.filter(key % 11 != 0).withColumn("content_hash", F.when(key % 7 == 0, "old").otherwise("h"))
    gone = now.filter(key % 13 == 0).withColumn("file_path", F.concat(F.lit("gone/"), "file_path"))
    return build.counts(before.unionByName(gone), now)


@_add("files_added", GRAPH + ", k AS (SELECT DISTINCT file_path AS p FROM sym WHERE id % 2 = 0 AND file_path IS NOT NULL) SELECT lower(p) AS path FROM k UNION ALL SELECT DISTINCT lower(file_path) FROM sym WHERE file_path IS NOT NULL AND lower(file_path) NOT IN (SELECT lower(p) FROM k)")
def files_added(spark: SparkSession, d: str) -> DataFrame:
    """Paths of half the symbols, with those of the others, in capitals, where they are missing."""
    s = sym(spark, d).filter("file_path IS NOT NULL")
    known = s.filter("id % 2 = 0").select(F.col("file_path").alias("path")).distinct()
    return logs.add_missing_files(known, s.select(F.upper("file_path").alias("path"))).select(F.lower("path").alias("path"))


@_add("store_counts", """SELECT 'solutions' AS name, count(*) AS n FROM solutions UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'knowledge_entries', count(*) FROM knowledge_entries
UNION ALL SELECT 'knowledge_links', count(*) FROM knowledge_links UNION ALL SELECT 'knowledge_tags', count(*) FROM knowledge_tags UNION ALL SELECT unnest(['files', 'tool_calls', 'diagnostics', 'references', 'members', 'projects', 'occurrences']), 0""")
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    """The rows of every relation of a store opened from the folder; what the folder lacks is empty."""
    out = None
    for name, rows in schemas.open_store(spark, d).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# texts
@_add("param_signature", GRAPH + "SELECT id, lower(replace(regexp_extract(qualified_name, '\\((.*)\\)', 1), ' ', '')) AS params FROM sym WHERE contains(qualified_name, '(')")
def param_signature(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).filter("qualified_name LIKE '%(%'").select("id", F.lower(F.replace(T.parameters("qualified_name"), F.lit(" "), F.lit(""))).alias("params"))


@_add("body_hashes", r"SELECT doc_id, CASE WHEN b = '' THEN '' ELSE sha256(b) END AS hash FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS b FROM documents)")
def body_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.body_hash("text").alias("hash"))


@_add("file_text_hashes", "SELECT doc_id, upper(substr(sha256(text), 1, 16)) AS hash FROM documents")
def file_text_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Texts that begin with a byte-order mark hash like those without it."""
    own = table(spark, d, "documents").filter("NOT coalesce(startswith(text, '\ufeff'), false)")
    every = table(spark, d, "documents").filter("coalesce(startswith(text, '\ufeff'), false)").select("doc_id", T.content_hash("text").alias("hash"))
    return own.select("doc_id", T.file_text_hash(F.concat(F.lit("\ufeff"), "text")).alias("hash")).unionByName(every)


@_add("relative_paths", GRAPH + "SELECT id, CASE WHEN starts_with(lower(file_path), 'src/') THEN substr(file_path, 5) ELSE file_path END AS path FROM sym")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).select("id", T.relative_path("file_path", "SRC/").alias("path"))


@_add("short_titles", "SELECT DISTINCT id, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS short FROM knowledge_entries")
def short_titles(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("id", T.shortened("content").alias("short"))


@_add("using_names", "SELECT p_partkey, 'P' || p_partkey || '.' || p_size AS name FROM part")
def using_names(spark: SparkSession, d: str) -> DataFrame:
    directive = F.concat(F.lit("  using P"), "p_partkey", F.lit("."), "p_size", F.lit(" ; "))
    return table(spark, d, "part").select("p_partkey", T.using_name(directive).alias("name"))


@_add("grouped_numbers", "SELECT o_orderkey, format('{:,}', floor(o_totalprice)::BIGINT) AS n FROM orders")
def grouped_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.grouped_number(F.floor("o_totalprice")).alias("n"))


_SIGNED = """, k AS (SELECT id, name, CASE id % 6 WHEN 0 THEN 'Method' WHEN 1 THEN 'Constructor' WHEN 2 THEN 'Property' WHEN 3 THEN 'Event' WHEN 4 THEN 'Field' ELSE 'Class' END AS kind, coalesce(line, 0) % 3 AS n FROM sym),
g AS (SELECT id, kind, CASE kind WHEN 'Method' THEN 'int ' || name || '(' || repeat('T x, ', (n - 1)::INT) || CASE WHEN n > 0 THEN 'T x' ELSE '' END || ')' WHEN 'Constructor' THEN name || '(' || repeat('T x, ', (n - 1)::INT) || CASE WHEN n > 0 THEN 'T x' ELSE '' END || ')'
 WHEN 'Property' THEN 'int ' || name || ' { get; set; }' WHEN 'Event' THEN 'event int ' || name WHEN 'Field' THEN 'int ' || name ELSE 'class ' || name || CASE WHEN n > 0 THEN '<' || repeat('x, ', (n - 1)::INT) || 'x>' ELSE '' END END AS signature FROM k WHERE name IS NOT NULL)
"""


@_add("member_signatures", GRAPH + _SIGNED + "SELECT id, signature, CASE WHEN kind = 'Property' THEN rtrim(split_part(signature, '{', 1)) ELSE signature END AS compact FROM g")
def member_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Members of every kind with up to two parameters, in full and compact."""
    kinds = F.array(*[F.lit(k) for k in ("Method", "Constructor", "Property", "Event", "Field", "Class")])
    one = F.struct(F.lit("T").alias("type"), F.lit("x").alias("name"))
    s = sym(spark, d).filter("name IS NOT NULL").withColumn("kind", F.get(kinds, (F.col("id") % 6).cast("int"))).withColumn("params", F.array_repeat(one, (F.coalesce("line", F.lit(0)) % 3).cast("int")))
    signed = s.select("id", "kind", T.signature(F.col("kind"), F.lit("int"), F.col("name"), F.col("params"), F.array(F.lit("get"), F.lit("set"))).alias("signature"))
    return signed.select("id", "signature", search.member_line("kind", "signature").alias("compact"))


@_add("plain_symbols", GRAPH + "SELECT id FROM sym s WHERE NOT EXISTS (SELECT 1 FROM sym a WHERE a.id % 5 = 0 AND a.file_path = s.file_path AND a.line = s.line)")
def plain_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols without an attribute, where every fifth has one."""
    s = sym(spark, d)
    return members.without_attributes(s, s.filter("id % 5 = 0")).select("id")


@_add("kind_labels", GRAPH + "SELECT id, CASE WHEN id % 3 = 0 OR kind = 'Type' THEN 'Interface' ELSE kind END AS label FROM sym")
def kind_labels(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("id") % 3 == 0, "Type").otherwise(F.col("kind"))
    return sym(spark, d).select("id", P.kind_label(kind, F.lit("interface")).alias("label"))


# predicates
@_add("source_files", GRAPH + "SELECT id FROM sym WHERE NOT (lower(file_path) LIKE '%.g.cs' OR lower(file_path) LIKE '%.designer.cs' OR contains(lower(file_path), '/obj/'))")
def source_files(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).filter(P.source_file("file_path")).select("id")


@_add("generated_files", GRAPH + "SELECT id, coalesce(regexp_matches(file_path, '(\\.g|\\.g\\.i|\\.designer)\\.cs$', 'i'), false) AS made FROM sym")
def generated_files(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).select("id", P.generated_file("file_path").alias("made"))


@_add("files_matching", GRAPH + "SELECT id FROM sym WHERE contains(lower(file_path), 'writer')")
def files_matching(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).filter(P.file_matches("file_path", "Writer")).select("id")


@_add("window_projects", "WITH t AS (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN '<UseWPF>true</UseWPF>' WHEN 1 THEN 'PresentationCore' WHEN 2 THEN 'A.xaml' ELSE '<UseWPF>false</UseWPF>' END) AS t FROM documents) SELECT doc_id FROM t WHERE contains(t, 'presentationcore') OR contains(t, 'presentationframework') OR contains(t, '.xaml') OR contains(t, '<usewpf>true</usewpf>')")
def window_projects(spark: SparkSession, d: str) -> DataFrame:
    """Every document with something appended that is a mark or is not."""
    kind = F.col("doc_id") % 5
    end = F.when(kind == 0, "<UseWPF>true</UseWPF>").when(kind == 1, "PresentationCore").when(kind == 2, "A.xaml").otherwise("<UseWPF>false</UseWPF>")
    return table(spark, d, "documents").filter(P.wpf_project(F.concat("text", end))).select("doc_id")


@_add("member_kinds", GRAPH + "SELECT id FROM sym WHERE lower(kind) = 'method' AND NOT regexp_matches(name, '^(get_|set_|add_|remove_|<)')")
def member_kinds(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).filter(P.member_matches("kind", "name", "method")).select("id")


@_add("known_members", GRAPH + """, c AS (SELECT id, regexp_extract(qualified_name, '^(.*)\\.([^.]*)$', 1) AS t, regexp_extract(qualified_name, '^(.*)\\.([^.]*)$', 2) AS n FROM sym), m AS (SELECT t, n, min('p' || id) AS project FROM c WHERE id % 2 = 0 GROUP BY ALL) SELECT c.id, project FROM c JOIN m USING (t, n)""")
def known_members(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d).select("id", "qualified_name")
    part = lambda i: F.regexp_extract("qualified_name", r"^(.*)\.([^.]*)$", i)
    m = s.filter("id % 2 = 0").select(part(1).alias("type_name"), part(2).alias("name"), F.concat(F.lit("p"), "id").alias("project"))
    return members.known_member(s, m)


# knowledge from text
class _Embedder(knowledge.HashingEmbedder):
    pass


@_add("knowledge_add", """WITH n AS (SELECT DISTINCT ON (id) id, title, content FROM knowledge_entries WHERE title IS NOT NULL AND content IS NOT NULL) SELECT count(DISTINCT (title, content)) AS entries, count(DISTINCT (title, content)) FILTER (WHERE title || content <> '') AS embedded FROM n""")
def knowledge_add(spark: SparkSession, d: str) -> DataFrame:
    """Every entry's text added to an empty store, with vectors of a hashing embedder."""
    e = _entries(spark, d).filter("title IS NOT NULL AND content IS NOT NULL")
    empty = F.array().cast("array<string>")
    new = e.select(F.lit("lesson").alias("category"), "title", "content", empty.alias("symbols"), empty.alias("tags"))
    none = table(spark, d, "knowledge_entries").limit(0)
    made = knowledge.add_entries(none, _links(spark, d).limit(0), _tags(spark, d).limit(0), new, "2030-01-01", P.CATEGORIES, _Embedder(64))[0]
    return made.agg(F.count("*").alias("entries"), F.count_if((F.size("embedding") == 64) & (F.concat("title", "content") != "")).alias("embedded"))


@_add("knowledge_search_text", None)
def knowledge_search_text(spark: SparkSession, d: str) -> DataFrame:
    """Search by a query text among vectors that the same embedder made of the entries."""
    e = knowledge.embedded(_entries(spark, d).select("id", "title", "content"), F.concat_ws("\n", "title", "content"), _Embedder(64))
    return knowledge.similarity_search(e, "overload tracing of callers", _Embedder(64), 0.2).select("id", F.round("score", 4).alias("score"))


# tokens
KEY = b"larkspan"


@_add("tokens_valid", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'signature' WHEN user_id % 100 > 60 THEN 'expired' WHEN event_type = 'click' THEN 'topic' WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'valid' END AS result FROM events")
def tokens_valid(spark: SparkSession, d: str) -> DataFrame:
    """Tokens issued up to 100 seconds ago, signed here; every seventh is spoilt and every third not registered."""
    e = table(spark, d, "events").select("event_id", "event_type", F.concat_ws("|", "event_type", "event_id", 1000 - F.col("user_id") % 100).alias("payload"))
    signed = F.concat("payload", F.lit("|"), streams.sign(KEY, "payload"))
    tokens = e.select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(signed, F.lit("x"))).otherwise(signed).alias("token"), F.when(F.col("event_type") == "click", "other").otherwise(F.col("event_type")).alias("expected_topic"))
    known = e.filter("event_id % 3 <> 0").select(F.col("event_id").cast("string").alias("token_id"))
    got = streams.validate_tokens(tokens, known, KEY, 1000)
    return got.select(F.get(F.split("token", "[|]"), F.lit(1)).cast("long").alias("event_id"), "result")


@_add("tokens_live", "SELECT event_id FROM events WHERE ts + INTERVAL 1 MINUTE >= TIMESTAMP '2024-01-15 00:00:00'")
def tokens_live(spark: SparkSession, d: str) -> DataFrame:
    issued = table(spark, d, "events").select("event_id", F.col("ts").alias("issued_at"))
    return streams.live_tokens(issued, str(datetime.datetime(2024, 1, 15))).select("event_id")


@_add("envelopes", "SELECT count(*) AS n FROM region")
def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON texts that hold what the rows hold."""
    r = table(spark, d, "region")
    back = logs.envelope(r).select(F.from_json("json", r.schema).alias("r")).select("r.*")
    return back.join(r, list(r.columns), "left_semi").agg(F.count("*").alias("n"))
