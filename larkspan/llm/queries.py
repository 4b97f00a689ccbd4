"""The queries of the operators in this subpackage, each over whole tables with production parameters, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import canonical, cooccurrence, frequencies, leakage, mixture, near_duplicates, neighbours
from larkspan.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(table(spark, d, "knowledge_entries"), "id", ["title", "content"], k=3, threshold=0.6, least_words=20)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.expanded(*_notes(spark, d))


def p1_note_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.note_groups(*_notes(spark, d))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "knowledge_tags").select(F.lit("tag").alias("field_name"), F.col("knowledge_id").alias("record"), F.col("tag").alias("value"))
    entries = table(spark, d, "knowledge_entries").select(F.lit("category").alias("field_name"), F.col("id").alias("record"), F.col("category").alias("value"))
    counts = frequencies.frequencies(tags.unionByName(entries))
    return frequencies.marked(counts, table(spark, d, "knowledge_entries").agg(F.count_distinct("id").alias("n_all")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter("mark IS NOT NULL").select("field_name", "term", "mark")


def p3_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("field_name", "term", "n_rows", "n_records", F.coalesce("mark", F.lit("usable")).alias("mark"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lists = neighbours.nearest(table(spark, d, "knowledge_entries"), "id", "embedding", "embedding_model", k=10, floor=0.85)
    return neighbours.similar_pairs(lists, 0.85)


def p4_top10(spark: SparkSession, d: str) -> DataFrame:
    lists = neighbours.nearest(table(spark, d, "knowledge_entries"), "id", "embedding", "embedding_model", k=10, queries="id % 20 = 0")
    return lists.select("id", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def _tags(spark: SparkSession, d: str, min_count: int, significance: bool = False) -> DataFrame:
    return cooccurrence.together(table(spark, d, "knowledge_tags"), "knowledge_id", frequencies.term("tag"), min_count, significance=significance)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("n_a", "n_b", "n_ab", "n_records")}  # whole numbers, and no product overflows
    found = _tags(spark, d, 5).withColumns(wide).filter("n_ab * n_records >= n_a * n_b * 3")
    return found.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p5_tag_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d, 1).select("item_a", "item_b", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"))


def p5_surprising(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d, 1, True).filter("significant")


def _leaks(spark: SparkSession, d: str, edits: int = 0) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage", min_words=12, edits=edits)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p6_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 12 words of a passage in which up to two characters were changed, added or lost."""
    return _leaks(spark, d, 2)


def p6_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_leaks(spark, d), table(spark, d, "eval_items"), "item_id")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vocabulary = spark.conf.get("larkspan.tokenizer", mixture.TOKENIZER)
    return mixture.mixture(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"), tokenizer=vocabulary)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.same_looking(table(spark, d, "documents"), "doc_id", "text").select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alike_classes(table(spark, d, "documents"), "doc_id", "text")


def p8_consistent_texts(spark: SparkSession, d: str) -> DataFrame:
    return canonical.consistent_texts(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("form").alias("text"))


def queries() -> dict[str, Query]:
    every = (p1_found, p1_note_groups, p3_found, p3_term_frequencies, p4_found, p4_top10, p5_found, p5_tag_pairs, p5_surprising, p6_found, p6_edited, p6_leaked_items, p7_mixture, p7_shares, p8_found, p8_classes, p8_consistent_texts)
    return {f.__name__: f for f in every}


_PAIRS = """
WITH e AS (SELECT DISTINCT id, regexp_extract_all(coalesce(title, '') || chr(10) || coalesce(content, ''), '[A-Za-z0-9]+') AS w FROM knowledge_entries),
g AS (SELECT DISTINCT id, lower(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM e WHERE len(w) >= 20)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c * 10 >= 6 * (x.n + y.n - c)
"""

_TERMS = """
WITH v AS (SELECT DISTINCT 'tag' AS field_name, knowledge_id AS record, tag AS value FROM knowledge_tags
  UNION ALL SELECT DISTINCT 'category', id, category FROM knowledge_entries),
t AS (SELECT field_name, lower(trim(value, ' ' || chr(9))) AS term, count(*) AS n_rows, count(DISTINCT record) AS n_records
  FROM v WHERE lower(trim(value, ' ' || chr(9))) <> '' GROUP BY ALL),
m AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records > 0.1 * (SELECT count(DISTINCT id) FROM knowledge_entries) THEN 'common' ELSE 'usable' END AS mark FROM t)
"""

_VECTORS = """
WITH u AS (SELECT DISTINCT id, embedding_model AS m, embedding::DOUBLE[] AS v FROM knowledge_entries
  WHERE embedding_model IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
"""

_BASKETS = """
WITH t AS (SELECT DISTINCT knowledge_id AS r, lower(trim(tag, ' ' || chr(9))) AS i FROM knowledge_tags WHERE lower(trim(tag, ' ' || chr(9))) <> '' AND knowledge_id IS NOT NULL),
c AS (SELECT i, count(*) AS n FROM t GROUP BY i), z AS (SELECT count(DISTINCT r) AS n FROM t),
p AS (SELECT x.i AS a, y.i AS b, count(*) AS n_ab FROM t x JOIN t y ON x.r = y.r AND x.i < y.i GROUP BY ALL)
"""


_GROUPS = """
WITH RECURSIVE e AS (SELECT DISTINCT id, list_transform(regexp_extract_all(coalesce(title, '') || chr(10) || coalesce(content, ''), '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM knowledge_entries),
k AS (SELECT id, min(id) OVER (PARTITION BY w) AS class_id, w FROM e WHERE len(w) >= 20), c AS (SELECT id, w FROM k WHERE id = class_id),
g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM c)), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL), l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c * 10 >= 6 * (x.n + y.n - c)),
s AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT id, id AS top FROM c UNION SELECT s.b, r.top FROM r JOIN s ON s.a = r.id), m AS (SELECT id, min(top) AS group_id FROM r GROUP BY id)
SELECT k.id, class_id, count(*) OVER (PARTITION BY class_id) AS n_copies, (SELECT count(*) FROM s WHERE s.a = class_id) AS n_links, group_id FROM k JOIN m ON m.id = class_id
"""


def _forms(query: str) -> str:
    """SQL over f(doc_id, text, form) and i(item_id, form): every character is looked up in the table of forms, and the result is composed."""
    made = [(p, f) for p in range(0x110000) if not 0xD800 <= p < 0xE000 and (f := canonical.form(chr(p))) != chr(p)]
    codes, forms = ", ".join(str(p) for p, _ in made), ", ".join("'" + f.replace("'", "''") + "'" for _, f in made)
    per = "SELECT {1}, nfc_normalize(coalesce(string_agg(coalesce(m.f, c), '' ORDER BY n), '')) AS form FROM (SELECT {1}, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS n FROM {0}) LEFT JOIN m ON m.p = unicode(c) GROUP BY {1}"
    docs, items = per.format("d", "doc_id"), per.format("q", "item_id")
    return f"""WITH m AS (SELECT unnest([{codes}]) AS p, unnest([{forms}]) AS f), d AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL), q AS (SELECT item_id, any_value(passage) AS t FROM eval_items WHERE passage IS NOT NULL GROUP BY item_id),
f AS (SELECT doc_id, t AS text, coalesce(form, '') AS form FROM d LEFT JOIN ({docs}) USING (doc_id)), i AS ({items}) {query}"""


_LEAKS = """, dw AS (SELECT doc_id, list_filter(string_split_regex(lower(form), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM f), iw AS (SELECT item_id, list_filter(string_split_regex(lower(form), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM i),
ds AS (SELECT DISTINCT doc_id, list_slice(w, k, k + 11) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM dw)), si AS (SELECT DISTINCT item_id, list_slice(w, k, k + 11) AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM iw)),
x AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN si USING (s)) """


def oracle_sql() -> dict[str, str]:
    return {
        "p1_note_groups": _GROUPS,
        "p6_found": _forms(_LEAKS + "SELECT doc_id, item_id FROM x"),
        "p6_leaked_items": _forms(_LEAKS + "SELECT e.item_id, count(x.doc_id) AS n_documents FROM (SELECT DISTINCT item_id FROM eval_items) e LEFT JOIN x USING (item_id) GROUP BY e.item_id"),
        "p8_found": _forms("SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"),
        "p8_classes": _forms("SELECT min(doc_id) AS class_id, count(*) AS n_documents, count(DISTINCT text) AS n_texts FROM f GROUP BY form HAVING count(DISTINCT text) > 1"),
        "p8_consistent_texts": _forms("SELECT doc_id, form AS text FROM f UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL"),
        "p1_found": _PAIRS,
        "p3_found": _TERMS + "SELECT field_name, term, mark FROM m WHERE mark <> 'usable'",
        "p3_term_frequencies": _TERMS + "SELECT * FROM m",
        "p4_found": _VECTORS
        + """s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b ON a.m = b.m AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM s)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE n <= 10 AND sim >= 0.85""",
        "p4_top10": _VECTORS
        + """s AS (SELECT a.id AS id, b.id AS neighbour, list_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b ON a.m = b.m AND a.id <> b.id WHERE a.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS n FROM s)
SELECT id, neighbour, n AS rank, round(sim, 6) AS similarity FROM r WHERE n <= 10""",
        "p5_found": _BASKETS + "SELECT a AS tag_a, b AS tag_b FROM p, z, c x, c y WHERE x.i = a AND y.i = b AND n_ab >= 5 AND n_ab * z.n >= 3 * x.n * y.n",
        "p5_tag_pairs": _BASKETS + "SELECT a AS item_a, b AS item_b, x.n AS n_a, y.n AS n_b, n_ab, round(n_ab * z.n::DOUBLE / (x.n * y.n), 6) AS lift FROM p, z, c x, c y WHERE x.i = a AND y.i = b",
    }
