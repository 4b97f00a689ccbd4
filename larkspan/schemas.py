"""Schemas of the relations, and a store that is opened from a folder or made in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.operators.usage import COLUMNS
from larkspan.plans import lineage
from larkspan.sources.tables import table

SCHEMAS = {
    "solutions": "id bigint, path string, name string, last_analyzed timestamp, solution_hash string",
    "symbols": "id bigint, solution_id bigint, kind string, name string, qualified_name string, file_path string, line int, col_no int, file_hash string, status string, added_at timestamp, removed_at timestamp",
    "edges": "src bigint, dst bigint, edge_type string, recorded_at timestamp, loaded_at timestamp",
    "files": "id bigint, solution_id bigint, file_path string, last_modified timestamp, content_hash string, last_analyzed timestamp",
    "knowledge_entries": "id bigint, category string, title string, content string, embedding array<float>, embedding_model string, confidence double, created_at timestamp, updated_at timestamp",
    "knowledge_links": "knowledge_id bigint, symbol_name string, link_type string, linked_at timestamp",
    "knowledge_tags": "knowledge_id bigint, tag string",
    "tool_calls": COLUMNS,
    "diagnostics": "seq bigint, id string, severity string, title string, message string, file string, line int, col_no int, project string, containing_type string, containing_method string, suppressed string",
    "references": "file string, line int, col_no int, end_line int, end_column int, project string, preview string",
    "members": "type_name string, name string, kind string, signature string, accessibility string, is_static boolean, is_abstract boolean, is_virtual boolean, is_override boolean, inherited_from string",
    "projects": "name string, path string, language string, dependencies array<string>",
    "occurrences": "file_path string, src_name string, dst_name string, node string, symbol_kind string, is_write boolean, is_const boolean",
}


def in_memory(spark: SparkSession, **rows: list) -> dict[str, DataFrame]:
    """Every relation, empty but for the rows given."""
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder of any file system holds a store."""
    return lineage.exists(spark, f"{folder.rstrip('/')}/symbols.parquet")


def open_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The relations that the folder has, the others empty."""
    out = in_memory(spark)
    for name in out:
        try:
            out[name] = table(spark, folder, name)
        except Exception as e:  # noqa: BLE001 - only a missing table is an empty one
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out
