"""Queries over files, knowledge, the usage log, diagnostics and members.

Tables that the data folder lacks are projected from those it has; the projections stand once in SQL (for the oracle) and once as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import predicates as P
from larkspan.functions import text as T
from larkspan.operators import changes, diagnostics, knowledge, members, search, usage
from larkspan.plans.graph_queries import SQL as GRAPH
from larkspan.plans.graph_queries import sym
from larkspan.plans.lineage import new_path
from larkspan.sources import logs
from larkspan.sources.tables import table
from larkspan.streaming import usage as streams

OPERATORS: dict = {}


def _add(name: str, sql: str | None):  # noqa: ANN202
    def register(f):  # noqa: ANN001, ANN202
        OPERATORS[name] = (f, sql)
        return f

    return register


# files: the documents are the current state; of the stored one, every eleventh is missing, every seventh differs, and some are gone since
def _current(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.format_string("f/%d.txt", "doc_id").alias("file_path"), T.content_hash("text").alias("content_hash"), "doc_id")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    c = _current(spark, d).filter("doc_id % 11 <> 0")
    changed = c.withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "0").otherwise(F.col("content_hash")))
    ghosts = c.filter("doc_id % 13 = 0").withColumn("file_path", F.concat(F.lit("gone/"), "file_path"))
    return changed.unionByName(ghosts)


_FILES = """WITH c AS (SELECT 'f/' || doc_id || '.txt' AS file_path, upper(substr(sha256(text), 1, 16)) AS h, doc_id FROM documents),
s AS (SELECT file_path, CASE WHEN doc_id % 7 = 0 THEN '0' ELSE h END AS h, doc_id FROM c WHERE doc_id % 11 <> 0 UNION ALL SELECT 'gone/' || file_path, h, doc_id FROM c WHERE doc_id % 11 <> 0 AND doc_id % 13 = 0)
"""


@_add("stale_files", _FILES + "SELECT s.file_path FROM s LEFT JOIN c USING (file_path) WHERE c.h IS NULL OR s.h IS DISTINCT FROM c.h")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    return changes.stale(_stored(spark, d), _current(spark, d))


@_add("files_needing_analysis", _FILES + "SELECT c.file_path FROM c LEFT JOIN s USING (file_path) WHERE c.h IS DISTINCT FROM s.h")
def files_needing_analysis(spark: SparkSession, d: str) -> DataFrame:
    return changes.needing_analysis(_stored(spark, d), _current(spark, d))


@_add("deleted_files", _FILES + "SELECT file_path FROM s WHERE lower(file_path) NOT IN (SELECT lower(file_path) FROM c)")
def deleted_files(spark: SparkSession, d: str) -> DataFrame:
    return changes.deleted(_stored(spark, d), _current(spark, d))


@_add("unchanged_files", _FILES + "SELECT c.file_path FROM c JOIN s ON s.file_path = c.file_path AND s.h = c.h")
def unchanged_files(spark: SparkSession, d: str) -> DataFrame:
    return changes.unchanged(_stored(spark, d), _current(spark, d))


@_add("stale_still_there", _FILES + "SELECT s.file_path FROM s JOIN c USING (file_path) WHERE c.h IS NULL OR s.h IS DISTINCT FROM c.h")
def stale_still_there(spark: SparkSession, d: str) -> DataFrame:
    return changes.still_there(changes.stale(_stored(spark, d), _current(spark, d)), _current(spark, d))


@_add("file_upsert", _FILES + "SELECT file_path, h AS content_hash FROM c UNION ALL SELECT file_path, h FROM s WHERE file_path NOT IN (SELECT file_path FROM c)")
def file_upsert(spark: SparkSession, d: str) -> DataFrame:
    return changes.upsert(_stored(spark, d), _current(spark, d), ["file_path"]).select("file_path", "content_hash")


@_add("file_hash_upsert", _FILES + "SELECT file_path, coalesce(c.h, s.h) AS content_hash FROM s FULL JOIN c USING (file_path)")
def file_hash_upsert(spark: SparkSession, d: str) -> DataFrame:
    return changes.upsert_hash(_stored(spark, d), _current(spark, d)).select("file_path", "content_hash")


@_add("file_staleness", _FILES + "SELECT c.file_path, CASE WHEN s.file_path IS NULL THEN true WHEN c.doc_id % 5 = 0 THEN false ELSE s.h IS DISTINCT FROM c.h END AS is_stale FROM c LEFT JOIN s USING (file_path)")
def file_staleness(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit("2030-01-01").cast("timestamp")
    stored = _stored(spark, d).withColumn("last_modified", at)
    disk = _current(spark, d).withColumn("last_modified", F.when(F.col("doc_id") % 5 == 0, at).otherwise(at + F.expr("INTERVAL 1 DAY")))
    return changes.staleness(stored, disk, _current(spark, d).select("file_path"))


@_add("known_hashes", GRAPH + "SELECT lower(file_path) AS file_key, arg_min(file_hash, id) AS file_hash FROM sym WHERE file_hash IS NOT NULL GROUP BY ALL")
def known_hashes(spark: SparkSession, d: str) -> DataFrame:
    return changes.known_hashes(sym(spark, d))


@_add("last_symbol_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_symbol_state(spark: SparkSession, d: str) -> DataFrame:
    return changes.latest(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@_add("version_pick", "SELECT p_type, max(p_size * 100 + p_partkey % 10) AS best FROM part GROUP BY p_type")
def version_pick(spark: SparkSession, d: str) -> DataFrame:
    """The latest of versions size.n.0-x per type, by its numbers."""
    p = table(spark, d, "part").withColumn("version", F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 10, F.lit(".0-x")))
    best = p.groupBy("p_type").agg(F.max(T.version_key("version")).alias("v"))
    return best.select("p_type", (F.col("v")[0] * 100 + F.col("v")[1]).cast("long").alias("best"))


# knowledge
def _entries(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.one_per_id(table(spark, d, "knowledge_entries"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_links")


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_tags")


QUERY = "overload tracing"
_ENT = "WITH ent AS (SELECT DISTINCT ON (id) * FROM knowledge_entries), "
_BM25 = """tok AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', title, content)), '([\\p{L}\\p{N}]+)', 1) AS w FROM ent),
f AS (SELECT id, len(w) AS l, len(list_filter(w, lambda x: starts_with(x, 'overload'))) AS f0, len(list_filter(w, lambda x: starts_with(x, 'tracing'))) AS f1 FROM tok),
k AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE f0 > 0) AS n0, count(*) FILTER (WHERE f1 > 0) AS n1 FROM f),
b AS (SELECT id, CASE WHEN f0 > 0 THEN greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m)) ELSE 0 END
 + CASE WHEN f1 > 0 THEN greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / m)) ELSE 0 END AS score FROM f, k WHERE f0 > 0 OR f1 > 0 ORDER BY score DESC, id LIMIT 20),
"""
_QUERY_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_VECTOR = f"""v AS (SELECT id, embedding::DOUBLE[] AS e FROM ent WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
vec AS (SELECT id, list_cosine_similarity(e, {_QUERY_VECTOR}::DOUBLE[]) AS score FROM v WHERE list_cosine_similarity(e, {_QUERY_VECTOR}::DOUBLE[]) > 0.2 ORDER BY score DESC, id LIMIT 20),
"""


@_add("fts_bm25_top20", _ENT + _BM25 + "z AS (SELECT 1) SELECT id, round(score, 4) AS score FROM b")
def fts_bm25_top20(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.bm25(_entries(spark, d), QUERY).select("id", F.round("score", 4).alias("score"))


@_add("fts_minmax", _ENT + _BM25 + "z AS (SELECT min(score) AS lo, max(score) AS hi FROM b) SELECT id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 4) AS score FROM b, z")
def fts_minmax(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.scaled(knowledge.bm25(_entries(spark, d), QUERY)).select("id", F.round("score", 4).alias("score"))


@_add("fts_indexed_top20", _ENT + _BM25 + "z AS (SELECT 1) SELECT id, round(score, 4) AS score FROM b")
def fts_indexed_top20(spark: SparkSession, d: str) -> DataFrame:
    """The same from an index in the shared folder, which a store would keep."""
    index = knowledge.TextIndex.build(_entries(spark, d), new_path(spark, "index"))
    return index.bm25(QUERY).select("id", F.round("score", 4).alias("score"))


@_add("vector_top20", _ENT + _VECTOR + "z AS (SELECT 1) SELECT id, round(score, 4) AS score FROM vec")
def vector_top20(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.vector_hits(_entries(spark, d), _QUERY_VECTOR, 0.2).select("id", F.round("score", 4).alias("score"))


_NAMES = ["Corefold.Runtime", "Tarnwick.Claims"]
_LINKED = "(" + " OR ".join(f"symbol_name = '{n}' OR symbol_name ILIKE '{n}.%'" for n in _NAMES) + ")"


@_add("link_hits", f"SELECT DISTINCT knowledge_id AS id FROM knowledge_links WHERE {_LINKED}")
def link_hits(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.link_hits(_links(spark, d), _NAMES)


@_add(
    "hybrid_search",
    _ENT
    + _BM25
    + _VECTOR
    + f"""lay AS (SELECT id, 1.0::DOUBLE AS score, 0 AS layer, 'symbol' AS source, row_number() OVER (ORDER BY confidence DESC NULLS LAST, id) AS rank FROM ent WHERE id IN (SELECT knowledge_id FROM knowledge_links WHERE {_LINKED})
 UNION ALL SELECT id, 0.7 * CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END, 1, 'fts', row_number() OVER (ORDER BY score DESC, id) FROM b
 UNION ALL SELECT id, 0.8 * score, 2, 'vector', row_number() OVER (ORDER BY score DESC, id) FROM vec)
SELECT id, round(sum(score), 4) AS score, string_agg(source, '+' ORDER BY layer) AS sources FROM lay GROUP BY id ORDER BY sum(score) DESC, min(layer), min(rank), id LIMIT 10""",
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.hybrid(_entries(spark, d), _links(spark, d), QUERY, _QUERY_VECTOR, _NAMES, floor=0.2).select("id", F.round("score", 4).alias("score"), "sources")


@_add("knowledge_list", _ENT + "z AS (SELECT 1) SELECT id, category, title FROM ent WHERE category = 'gotcha' ORDER BY updated_at DESC NULLS LAST, id LIMIT 100 OFFSET 10")
def knowledge_list(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.listing(_entries(spark, d), _tags(spark, d), category="gotcha", offset=10).select("id", "category", "title")


@_add("knowledge_by_tag", _ENT + "z AS (SELECT 1) SELECT id, title FROM ent WHERE id IN (SELECT knowledge_id FROM knowledge_tags WHERE tag = 'async') ORDER BY updated_at DESC NULLS LAST, id LIMIT 100")
def knowledge_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.listing(_entries(spark, d), _tags(spark, d), tag="async").select("id", "title")


@_add(
    "knowledge_get",
    _ENT
    + """l AS (SELECT knowledge_id AS id, string_agg(DISTINCT symbol_name, ',' ORDER BY symbol_name) AS symbols FROM knowledge_links GROUP BY ALL), t AS (SELECT knowledge_id AS id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM knowledge_tags GROUP BY ALL)
SELECT id, coalesce(symbols, '') AS symbols, coalesce(tags, '') AS tags FROM ent LEFT JOIN l USING (id) LEFT JOIN t USING (id)""",
)
def knowledge_get(spark: SparkSession, d: str) -> DataFrame:
    full = knowledge.with_related(_entries(spark, d).select("id"), _links(spark, d), _tags(spark, d))
    return full.select("id", F.array_join("symbols", ",").alias("symbols"), F.array_join("tags", ",").alias("tags"))


@_add("knowledge_flag", GRAPH + ", l AS (SELECT DISTINCT symbol_name AS n FROM knowledge_links WHERE symbol_name IS NOT NULL) SELECT id FROM sym WHERE EXISTS (SELECT 1 FROM l WHERE n = qualified_name OR starts_with(qualified_name, n || '.') OR starts_with(n, qualified_name || '.'))")
def knowledge_flag(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.known_symbols(sym(spark, d), _links(spark, d))


@_add("knowledge_count", "SELECT count(DISTINCT id) AS n FROM knowledge_entries")
def knowledge_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_entries").agg(F.count_distinct("id").alias("n"))


@_add("knowledge_delete", "SELECT DISTINCT knowledge_id, tag FROM knowledge_tags WHERE knowledge_id <> 4")
def knowledge_delete(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.delete_entry(_entries(spark, d), _links(spark, d), _tags(spark, d), 4)[2].distinct()


@_add("valid_categories", _ENT + "z AS (SELECT 1) SELECT id, coalesce(lower(category) IN ('gotcha', 'pattern', 'architecture', 'debugging', 'performance', 'security', 'testing', 'workaround', 'lesson', 'error-resolution', 'convention', 'instruction'), false) AS valid FROM ent")
def valid_categories(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("id", F.coalesce(P.valid_category("category", list(P.CATEGORIES)), F.lit(False)).alias("valid"))


@_add("vector_codec", "WITH v AS (SELECT id, any_value(embedding) AS v FROM knowledge_entries WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 GROUP BY id), p AS (SELECT id, generate_subscripts(v, 1) AS place, unnest(v) AS value FROM v) SELECT id, place, CASE WHEN NOT isnan(value) THEN value::DOUBLE END AS value FROM p")
def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors to bytes and back; what is not a number, which equals nothing, comes out as null."""
    e = _entries(spark, d).filter("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)").select("id", "embedding").withColumn("raw", knowledge.encode_vector("embedding"))
    parts = e.select("id", F.posexplode(knowledge.decode_vector("raw")).alias("place", "value"))
    return parts.select("id", (F.col("place") + 1).cast("long").alias("place"), F.when(~F.isnan("value"), F.col("value").cast("double")).alias("value"))


# usage log: the events
def calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events")
    return e.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("success"), F.floor("value").cast("long").alias("durationMs"), k.alias("inputChars"), (k * 2).alias("outputChars"), F.when(k % 3 != 0, k).alias("inputTokens"), F.when(k % 2 == 0, k * 3).alias("outputTokens"), F.when(k % 5 != 0, k / 4).alias("tokensPerSecond"))


_CALLS = """WITH k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
calls AS (SELECT ts, event_type AS tool, event_type <> 'error' AS success, CAST(floor(value) AS BIGINT) AS ms, k AS ic, k * 2 AS oc, CASE WHEN k % 3 <> 0 THEN k END AS it, CASE WHEN k % 2 = 0 THEN k * 3 END AS ot, CASE WHEN k % 5 <> 0 THEN k / 4 END AS tps FROM k)
"""
_TOTALS = "SELECT count(*) AS total_calls, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed, coalesce(sum(ms), 0)::BIGINT AS total_ms, coalesce(sum(ic), 0)::BIGINT AS input_chars, coalesce(sum(oc), 0)::BIGINT AS output_chars, CASE WHEN count(*) > 0 THEN round_even(count(*) FILTER (WHERE success) * 100.0::DOUBLE / count(*), 1) ELSE 0 END AS success_rate FROM calls"
_BY_TOOL = "SELECT tool, count(*) AS calls, count(*) FILTER (WHERE success) * 100.0::DOUBLE / count(*) AS success_rate, trunc(avg(ms))::BIGINT AS avg_ms, sum(ms)::BIGINT AS total_ms, sum(coalesce(it, 0)) FILTER (WHERE ot IS NOT NULL)::BIGINT AS input_tokens, sum(ot)::BIGINT AS output_tokens, round_even(avg(coalesce(tps, 0)) FILTER (WHERE ot IS NOT NULL), 1) AS avg_speed FROM calls"


@_add("usage_totals", _CALLS + _TOTALS)
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return usage.totals(calls(spark, d))


@_add("usage_by_tool", _CALLS + _BY_TOOL + " GROUP BY tool")
def usage_by_tool(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_tool(calls(spark, d))


@_add("usage_tool_filter", _CALLS + _BY_TOOL + " WHERE contains(lower(tool), 'r') GROUP BY tool")
def usage_tool_filter(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_tool(calls(spark, d), "R")


@_add("usage_last_hours", _CALLS + _TOTALS + " WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 48 HOUR")
def usage_last_hours(spark: SparkSession, d: str) -> DataFrame:
    return usage.totals(usage.since(calls(spark, d), "2024-01-30 00:00:00", 48))


@_add("usage_tokens", _CALLS + "SELECT count(*) AS calls, coalesce(sum(coalesce(it, 0)), 0)::BIGINT AS input_tokens, coalesce(sum(ot), 0)::BIGINT AS output_tokens, round_even(avg(coalesce(tps, 0)), 1) AS avg_speed FROM calls WHERE ot IS NOT NULL")
def usage_tokens(spark: SparkSession, d: str) -> DataFrame:
    return usage.token_figures(calls(spark, d))


def _log(spark: SparkSession, d: str) -> str:
    """The calls as a log of JSON lines, with a blank and a broken line, in the shared folder."""
    path = new_path(spark, "log")
    logs.append_log(calls(spark, d), path)
    spark.createDataFrame([("",), ('{"tool": ',)], "value string").coalesce(1).write.mode("append").text(path)
    return path


@_add("log_by_tool", _CALLS + _BY_TOOL + " GROUP BY tool")
def log_by_tool(spark: SparkSession, d: str) -> DataFrame:
    """The figures per tool of a log written and read as JSON lines."""
    return usage.by_tool(logs.read_log(spark, _log(spark, d)))


@_add("log_stream_hourly", _CALLS + "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, tool, count(*) AS calls, count(*) FILTER (WHERE NOT success) AS failed FROM calls GROUP BY ALL")
def log_stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly figures of a stream over the log."""
    hourly = streams.run_to_end(streams.stream_hourly(logs.stream_log(spark, _log(spark, d))), "hourly")
    return hourly.select(F.unix_micros("hour").alias("hour_us"), "tool", "calls", "failed")


@_add("usage_report", None)
def usage_report(spark: SparkSession, d: str) -> DataFrame:
    """The report's text, a row for each line."""
    lines = usage.report(calls(spark, d), "R").splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, text string")


@_add("usage_stream_totals", _CALLS + _BY_TOOL + " GROUP BY tool")
def usage_stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """The same figures from a stream over the file."""
    e = table(spark, d, "events")
    source = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    k = F.get_json_object("props", "$.k").cast("int")
    c = source.select(F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("success"), F.floor("value").cast("long").alias("durationMs"), F.when(k % 3 != 0, k).alias("inputTokens"), F.when(k % 2 == 0, k * 3).alias("outputTokens"), F.when(k % 5 != 0, k / 4).alias("tokensPerSecond"))
    return streams.run_to_end(streams.stream_by_tool(c), "usage_stream")


# diagnostics: the events
def diags(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    sev = F.when(k % 3 == 0, "Error").when(k % 3 == 1, "Warning").otherwise("Info")
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.upper("event_type").alias("id"), sev.alias("severity"), F.concat(F.col("event_type"), F.lit("-"), k).alias("title"), F.lit("m").alias("message"), F.format_string("f%d.cs", F.col("user_id")).alias("file"), k.alias("line"), (k % 7).alias("col_no"), F.when(k % 10 == 0, "pragma").alias("suppressed"), F.col("user_id"))


_DIAGS = """WITH k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
dg AS (SELECT event_id AS seq, upper(event_type) AS id, CASE k % 3 WHEN 0 THEN 'Error' WHEN 1 THEN 'Warning' ELSE 'Info' END AS severity, event_type || '-' || k AS title, 'f' || user_id || '.cs' AS file, k AS line, k % 7 AS col_no, CASE WHEN k % 10 = 0 THEN 'pragma' END AS suppressed, user_id FROM k)
"""


@_add("diagnostics_totals", _DIAGS + "SELECT count(*) FILTER (WHERE severity = 'Error') AS errors, count(*) FILTER (WHERE severity = 'Warning') AS warnings, count(*) FILTER (WHERE severity = 'Info') AS infos FROM dg")
def diagnostics_totals(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.severity_totals(diags(spark, d))


@_add("diagnostics_summary", _DIAGS + "SELECT id, arg_min(severity, seq) AS severity, arg_min(title, seq) AS title, count(*) AS n, count(suppressed) AS n_suppressed, id IN ('CLICK', 'VIEW') AS has_fix FROM dg GROUP BY id")
def diagnostics_summary(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.summary(diags(spark, d), spark.createDataFrame([("click",), ("View",)], "id string"))


@_add("diagnostics_summary_lines", _DIAGS + """, s AS (SELECT id, arg_min(severity, seq) AS severity, arg_min(title, seq) AS title, count(*) AS n, count(suppressed) AS k FROM dg GROUP BY id)
SELECT id || ' (' || severity || ')' || CASE WHEN id = 'CLICK' THEN ' [fix]' ELSE '' END || ': ' || title || ' (' || n || ')' || CASE WHEN k > 0 THEN ' (' || k || ' suppressed)' ELSE '' END AS line FROM s""")
def diagnostics_summary_lines(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("Click",)], "id string")
    return diagnostics.summary(diags(spark, d), known).select(diagnostics.summary_line().alias("line"))


@_add("diagnostics_place_lines", _DIAGS + "SELECT seq, file || ':' || line || ' ' || CASE WHEN line % 2 = 0 THEN 'T' || line || '.' || CASE WHEN line % 4 = 0 THEN 'M' ELSE '' END ELSE '' END || ' - ' || title AS text FROM dg")
def diagnostics_place_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    g = diags(spark, d).withColumns({"containing_type": F.when(line % 2 == 0, F.concat(F.lit("T"), line)), "containing_method": F.when(line % 4 == 0, "M"), "message": F.col("title")})
    return g.select("seq", diagnostics.place_line(F.col("file")).alias("text"))


@_add("diagnostics_detail", _DIAGS + "SELECT seq, file || ':' || line || ':' || col_no || ' ' || severity || ' ' || id || ': m' AS compact FROM dg WHERE lower(id) = 'click' AND severity = 'Error' ORDER BY seq LIMIT 100 OFFSET 20")
def diagnostics_detail(spark: SparkSession, d: str) -> DataFrame:
    kept = diags(spark, d).filter(P.severity_matches("severity", "error"))
    return diagnostics.detail(kept, "click", 100, 20).select("seq", diagnostics.line_of().alias("compact"))


# Every option there is, no option, ids of both families, rules that are on, off and hidden.
@_add(
    "diagnostics_suppression",
    _DIAGS
    + """, x AS (SELECT seq, CASE WHEN line % 2 = 0 THEN 'CA' ELSE 'CS' END || line AS rule, line % 10 = 0 AS in_source, CASE line % 7 WHEN 0 THEN 'Suppress' WHEN 1 THEN 'Hidden' WHEN 2 THEN 'Warn' WHEN 3 THEN 'Error' END AS opt,
 line % 9 <> 0 AS enabled, CASE WHEN line % 8 = 0 THEN 'Hidden' ELSE 'Warning' END AS sev FROM dg)
SELECT seq, CASE WHEN in_source THEN 'pragma/attribute' WHEN opt IN ('Suppress', 'Hidden') THEN 'project settings' WHEN rule LIKE 'CA%' AND opt IS NULL AND (sev = 'Hidden' OR NOT enabled) THEN 'disabled by default' END AS reason FROM x""",
)
def diagnostics_suppression(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    rule = F.concat(F.when(line % 2 == 0, "CA").otherwise("CS"), line)
    option = F.when(line % 7 == 0, "Suppress").when(line % 7 == 1, "Hidden").when(line % 7 == 2, "Warn").when(line % 7 == 3, "Error")
    return diags(spark, d).select("seq", P.suppression(rule, line % 10 == 0, option, line % 9 != 0, F.when(line % 8 == 0, "Hidden").otherwise("Warning")).alias("reason"))


@_add("diagnostics_by_file", _DIAGS + "SELECT file, count(*) AS n, min(line) AS first, max(line) AS last FROM (SELECT * FROM dg WHERE id = 'CLICK' UNION ALL SELECT * FROM dg WHERE severity = 'Error') GROUP BY file")
def diagnostics_by_file(spark: SparkSession, d: str) -> DataFrame:
    g = diags(spark, d)
    return diagnostics.by_file(diagnostics.gathered(g.filter("id = 'CLICK'"), g.filter("severity = 'Error'")))


@_add("diagnostics_batch", _DIAGS + "SELECT seq, file, line FROM dg WHERE id = 'VIEW' ORDER BY seq LIMIT 100")
def diagnostics_batch(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.batch(diags(spark, d), "view").select("seq", "file", "line")


@_add(
    "symbol_at_place",
    _DIAGS
    + """, s AS (SELECT DISTINCT file, line * 100 AS f, line * 100 + 40 + seq % 3 * 100 AS l, title AS name FROM dg WHERE seq % 2 = 1), p AS (SELECT seq AS key, file, line * 100 + seq % 45 AS x, (line * 100 + seq % 45) // 10 * 10 AS tok FROM dg WHERE seq % 2 = 0),
j AS (SELECT key, name, 0 AS way, l - f AS len FROM p JOIN s ON s.file = p.file AND f = x UNION ALL SELECT key, name, 1, l - f FROM p JOIN s ON s.file = p.file AND f <= tok AND tok < l UNION ALL SELECT key, name, 2, l - f FROM p JOIN s ON s.file = p.file AND f <= x AND x < l),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY way, len, name) AS n FROM j) SELECT key, name FROM r WHERE n = 1""",
)
def symbol_at_place(spark: SparkSession, d: str) -> DataFrame:
    """Lines of 100 characters, in which every tenth begins a token."""
    g = diags(spark, d)
    spans = g.filter("seq % 2 = 1").select("file", (F.col("line") * 100).alias("first"), (F.col("line") * 100 + 40 + F.col("seq") % 3 * 100).alias("last"), F.col("title").alias("name")).distinct()
    places = g.filter("seq % 2 = 0").select(F.col("seq").alias("key"), "file", "line", (F.col("seq") % 45 + 1).alias("col_no"))
    starts = g.select("file", "line", (F.col("line") * 100).alias("start")).distinct()
    tokens = starts.select("file", F.explode(F.sequence("start", F.col("start") + 90, F.lit(10))).alias("first")).select("file", "first", (F.col("first") + 10).alias("last"))
    return diagnostics.symbol_at(places, starts, spans, tokens)


@_add("diagnostics_dedup", _DIAGS + "SELECT file, line, min(seq) AS seq, arg_min(id, seq) AS id FROM dg GROUP BY file, line")
def diagnostics_dedup(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.first_per_line(diags(spark, d)).select("file", "line", "seq", "id")


@_add(
    "nearest_diagnostic",
    _DIAGS
    + """, w AS (SELECT user_id AS key, file, min(line) + 3 AS x FROM dg WHERE seq % 2 = 0 GROUP BY ALL), j AS (SELECT key, seq, line, row_number() OVER (PARTITION BY key ORDER BY abs(line - x), seq) AS n FROM w JOIN dg USING (file) WHERE seq % 2 = 1)
SELECT key, seq, line FROM j WHERE n = 1""",
)
def nearest_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    g = diags(spark, d)
    wanted = g.filter("seq % 2 = 0").groupBy(F.col("user_id").alias("key"), "file").agg((F.min("line") + 3).alias("at"))
    return diagnostics.nearest(wanted, g.filter("seq % 2 = 1"))


@_add("location_tolerance", _DIAGS + "SELECT seq FROM dg WHERE line = 20 AND abs(col_no - 8) <= 5")
def location_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return diags(spark, d).filter(P.near_location("line", "col_no", 20, 8)).select("seq")


@_add("using_span_overlap", _DIAGS + ", a AS (SELECT seq, file, line AS f, line + 2 AS l FROM dg WHERE seq % 2 = 0), b AS (SELECT file, line AS f, line + 1 AS l FROM dg WHERE seq % 2 = 1 AND id = 'CLICK') SELECT seq FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.file = a.file AND a.f <= b.l AND b.f <= a.l)")
def using_span_overlap(spark: SparkSession, d: str) -> DataFrame:
    g = diags(spark, d)
    a = g.filter("seq % 2 = 0").select("seq", "file", F.col("line").alias("first"), (F.col("line") + 2).alias("last"))
    b = g.filter("seq % 2 = 1 AND id = 'CLICK'").select("file", F.col("line").alias("first"), (F.col("line") + 1).alias("last"))
    return diagnostics.overlapping(a, b).select("seq")


@_add(
    "enclosing_span",
    _DIAGS
    + """, p AS (SELECT seq AS key, file, line AS x FROM dg WHERE seq % 2 = 0), s AS (SELECT DISTINCT file, line - col_no AS f, line + 5 AS l, title AS name FROM dg WHERE seq % 2 = 1), j AS (SELECT key, name, row_number() OVER (PARTITION BY key ORDER BY l - f, name) AS n FROM p JOIN s ON p.file = s.file AND f <= x AND x < l)
SELECT key, name FROM j WHERE n = 1""",
)
def enclosing_span(spark: SparkSession, d: str) -> DataFrame:
    g = diags(spark, d)
    places = g.filter("seq % 2 = 0").select(F.col("seq").alias("key"), "file", F.col("line").alias("at"))
    spans = g.filter("seq % 2 = 1").select("file", (F.col("line") - F.col("col_no")).alias("first"), (F.col("line") + 5).alias("last"), F.col("title").alias("name")).distinct()
    return diagnostics.enclosing(places, spans)


@_add(
    "collapse_blank_lines",
    """WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
b AS (SELECT *, trim(t, ' ') = '' AND coalesce(lag(trim(t, ' ') = '') OVER (PARTITION BY doc_id ORDER BY n), false) AS gone FROM l) SELECT doc_id, count(*) FILTER (WHERE NOT gone) AS n_lines FROM b GROUP BY doc_id""",
)
def collapse_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return diagnostics.without_double_blanks(lines).groupBy(F.col("file").alias("doc_id")).agg(F.count("*").alias("n_lines"))


@_add("batch_fix_counts", _DIAGS + "SELECT count(*) AS found, count(*) FILTER (WHERE line % 2 = 0) AS applied, count(*) FILTER (WHERE line % 2 <> 0) AS failed, count(DISTINCT file) FILTER (WHERE line % 2 = 0) AS files FROM dg")
def batch_fix_counts(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.fix_counts(diags(spark, d).select("file", (F.col("line") % 2 == 0).alias("applied")))


@_add("rename_impact", "SELECT count(DISTINCT l_suppkey) AS files, sum(l_linenumber)::BIGINT AS changes FROM lineitem WHERE l_partkey < 50")
def rename_impact(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.change_impact(table(spark, d, "lineitem").filter("l_partkey < 50").select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").cast("long").alias("n")))


@_add("references_paged", "WITH r AS (SELECT 's' || l_suppkey || '/a.cs' AS file, l_linenumber AS line, l_orderkey AS c FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT * FROM r WHERE regexp_matches(file, '^s1.*\\.cs$', 'i')) SELECT file || ':' || line || ' - ' || c AS compact, (SELECT count(*) FROM h) AS total FROM h ORDER BY file, line, c LIMIT 100")
def references_paged(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("s"), F.col("l_suppkey"), F.lit("/a.cs")).alias("file"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("col_no"), F.lit("p").alias("project"), F.col("l_orderkey").cast("string").alias("preview"))
    return search.references_page(r, 100, file="s1*.cs").select("compact", "total")


@_add("text_edit_count_replace", "SELECT doc_id, (length(t) - length(replace(t, 'the ', ''))) // 4 AS n, CASE WHEN contains(t, 'the ') THEN 'replaced' ELSE 'not_found' END AS status, upper(substr(sha256(replace(t, 'the ', 'a ')), 1, 16)) AS hash FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents WHERE text IS NOT NULL)")
def text_edit_count_replace(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", T.text_edit("text", F.lit("the "), F.lit("a "), True).alias("e"))
    return t.select("doc_id", F.col("e.n").cast("long").alias("n"), "e.status", T.content_hash("e.text").alias("hash"))


# members
_MEMBERS = GRAPH + ", m AS (SELECT CASE WHEN len(string_split(split_part(qualified_name, '(', 1), '.')) > 1 THEN string_split(split_part(qualified_name, '(', 1), '.')[-2] END AS type_name, name, kind, line, id FROM sym) "


def _members(spark: SparkSession, d: str) -> DataFrame:
    return sym(spark, d).select(T.type_name("qualified_name").alias("type_name"), "name", "kind", "line", "id")


@_add("members_sorted", _MEMBERS + "SELECT type_name, name, kind, id, row_number() OVER (PARTITION BY type_name ORDER BY CASE WHEN kind = 'Constructor' THEN 0 ELSE 1 END, kind, name, id) AS place FROM m WHERE type_name IS NOT NULL")
def members_sorted(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("type_name").orderBy(F.when(F.col("kind") == "Constructor", 0).otherwise(1), "kind", "name", "id")
    return _members(spark, d).filter("type_name IS NOT NULL").select("type_name", "name", "kind", "id", F.row_number().over(w).cast("long").alias("place"))


@_add(
    "members_inherited",
    """WITH RECURSIVE mem AS (SELECT DISTINCT 'n' || s_nationkey AS t, 'm' || (s_suppkey % 20) AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'Property' ELSE 'Method' END AS kind, '(' || (s_suppkey % 2) || ')' AS sig,
 s_suppkey % 3 = 0 AS v, s_suppkey % 7 = 0 AS a, s_suppkey % 4 = 1 AS o FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)),
base AS (SELECT 'n' || n_nationkey AS t, 'n' || (n_nationkey // 2) AS b FROM nation WHERE n_nationkey > 0), up AS (SELECT t, b FROM base UNION SELECT up.t, base.b FROM up JOIN base ON base.t = up.b),
itf AS (SELECT 'n' || n_nationkey AS t, 'n' || ((n_nationkey + 11) % 25) AS i FROM nation WHERE n_nationkey % 3 = 0),
has AS (SELECT t, name, kind, sig FROM mem UNION SELECT up.t, name, kind, sig FROM up JOIN mem ON mem.t = up.b)
SELECT t AS type_name, name, kind, sig AS signature, NULL::VARCHAR AS inherited_from FROM mem
UNION ALL SELECT up.t, m.name, m.kind, m.sig, up.b FROM up JOIN mem m ON m.t = up.b WHERE NOT (m.kind = 'Method' AND (m.v OR m.a) AND EXISTS (SELECT 1 FROM mem d WHERE d.t = up.t AND d.name = m.name AND d.kind = 'Method' AND d.o))
UNION ALL SELECT itf.t, m.name, m.kind, m.sig, itf.i FROM itf JOIN mem m ON m.t = itf.i WHERE NOT EXISTS (SELECT 1 FROM has h WHERE h.t = itf.t AND h.name = m.name AND h.kind = m.kind AND h.sig = m.sig)""",
)
def members_inherited(spark: SparkSession, d: str) -> DataFrame:
    n, s = table(spark, d, "nation"), F.col("s_suppkey")
    type_name = lambda e: F.concat(F.lit("n"), F.expr(e))
    m = table(spark, d, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_semi").select(
        type_name("s_nationkey").alias("type_name"), F.concat(F.lit("m"), s % 20).alias("name"), F.when(s % 5 == 0, "Property").otherwise("Method").alias("kind"), F.concat(F.lit("("), s % 2, F.lit(")")).alias("signature"),
        (s % 3 == 0).alias("is_virtual"), (s % 7 == 0).alias("is_abstract"), (s % 4 == 1).alias("is_override"),
    )
    bases = n.filter("n_nationkey > 0").select(type_name("n_nationkey").alias("type_name"), type_name("n_nationkey DIV 2").alias("base"))
    interfaces = n.filter("n_nationkey % 3 = 0").select(type_name("n_nationkey").alias("type_name"), type_name("(n_nationkey + 11) % 25").alias("interface"))
    return members.with_inherited(m, bases, interfaces).select("type_name", "name", "kind", "signature", "inherited_from")


@_add(
    "build_order",
    """WITH RECURSIVE p AS (SELECT n_nationkey AS k FROM nation), dep AS (SELECT k, k // 2 AS x FROM p WHERE k > 0 UNION SELECT k, k // 3 FROM p WHERE k > 0),
l AS (SELECT k, 0 AS lv FROM p UNION SELECT dep.k, lv + 1 FROM l JOIN dep ON dep.x = l.k) SELECT 'n' || k AS name, max(lv) AS level FROM l GROUP BY k""",
)
def build_order(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    named = lambda e: F.concat(F.lit("n"), F.expr(e))
    deps = n.filter("n_nationkey > 0").select(named("n_nationkey").alias("name"), F.explode(F.array(named("n_nationkey DIV 2"), named("n_nationkey DIV 3"))).alias("needs"))
    return members.build_order(n.select(named("n_nationkey").alias("name")), deps)


@_add("insert_positions", _MEMBERS + """, q AS (SELECT type_name, CASE WHEN id % 7 = 0 THEN 'Event' ELSE kind END AS kind, row_number() OVER (PARTITION BY type_name ORDER BY line, id) - 1 AS pos FROM m WHERE type_name IS NOT NULL),
x AS (SELECT type_name, max(pos) FILTER (WHERE kind = 'Field') + 1 AS f, max(pos) FILTER (WHERE kind = 'Constructor') + 1 AS c, max(pos) FILTER (WHERE kind = 'Property') + 1 AS p, min(pos) FILTER (WHERE kind = 'Method') AS m1, count(*) AS e FROM q GROUP BY type_name)
SELECT type_name, 0::BIGINT AS "start", e AS "end", coalesce(f, 0) AS after_fields, coalesce(c, f, 0) AS after_constructors, coalesce(p, c, f, 0) AS after_properties, coalesce(m1, e) AS before_methods FROM x""")
def insert_positions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("type_name").orderBy("line", "id")
    m = _members(spark, d).filter("type_name IS NOT NULL").withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    return members.insert_index(m.withColumn("kind", F.when(F.col("id") % 7 == 0, "Event").otherwise(F.col("kind"))))


@_add("pure_model_types", _MEMBERS + "SELECT type_name FROM m WHERE type_name IS NOT NULL AND kind IN ('Field', 'Property', 'Event') GROUP BY type_name HAVING bool_and(kind = 'Field' OR (kind = 'Property' AND line % 2 = 0))")
def pure_model_types(spark: SparkSession, d: str) -> DataFrame:
    return members.pure_models(_members(spark, d).filter("type_name IS NOT NULL AND kind IN ('Field', 'Property', 'Event')").withColumn("is_auto", F.col("line") % 2 == 0))
