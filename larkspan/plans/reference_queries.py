"""Queries over references that do not resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.operators import orphans
from larkspan.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "symbols"), table(spark, d, "edges"), table(spark, d, "knowledge_links"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, d))


_ORPHANS = """
WITH e AS (SELECT src, dst, edge_type, min(recorded_at) AS t FROM edges GROUP BY ALL),
l AS (SELECT knowledge_id, symbol_name, min(linked_at) AS t FROM knowledge_links GROUP BY ALL),
s AS (SELECT id::VARCHAR AS k, removed_at IS NULL AS alive, added_at FROM symbols WHERE id IS NOT NULL),
n AS (SELECT qualified_name AS k, removed_at IS NULL AS alive, added_at FROM symbols
  UNION ALL SELECT split_part(qualified_name, '(', 1), removed_at IS NULL, added_at FROM symbols WHERE contains(qualified_name, '(')),
p AS (SELECT 'id' AS kind, k, bool_or(alive) AS alive, min(added_at) FILTER (WHERE alive) AS since FROM s GROUP BY k
  UNION ALL SELECT 'name', k, bool_or(alive), min(added_at) FILTER (WHERE alive) FROM n WHERE k IS NOT NULL GROUP BY k),
keyed AS (SELECT *, coalesce(src::VARCHAR, '') || '|' || coalesce(dst::VARCHAR, '') || '|' || coalesce(edge_type, '') AS row_key FROM e),
r AS (SELECT 'edges' AS ref_table, 'src' AS ref_field, row_key, 'id' AS kind, src::VARCHAR AS k, t FROM keyed
  UNION ALL SELECT 'edges', 'dst', row_key, 'id', dst::VARCHAR, t FROM keyed
  UNION ALL SELECT 'knowledge_links', 'symbol_name', knowledge_id || '|' || symbol_name, 'name', trim(symbol_name, ' ' || chr(9)), t FROM l),
f AS (SELECT ref_table, ref_field, row_key, CASE WHEN p.k IS NULL THEN 'missing' WHEN NOT alive THEN 'deleted' WHEN since > t THEN 'late' END AS reason, strftime(t, '%Y-%m') AS period
  FROM r LEFT JOIN p USING (kind, k) WHERE r.k IS NOT NULL)
"""

OPERATORS = {
    "p2_found": (p2_found, _ORPHANS + "SELECT * FROM f WHERE reason IS NOT NULL"),
    "p2_report": (p2_report, _ORPHANS + "SELECT ref_table, ref_field, reason, period, count(*) AS n_references FROM f WHERE reason IS NOT NULL GROUP BY ALL"),
}
