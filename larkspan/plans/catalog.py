"""All queries of the library outside llm: name -> (query, SQL or None)."""

from __future__ import annotations

from larkspan.plans import build_queries, graph_queries, record_queries, reference_queries

OPERATORS: dict = {**graph_queries.OPERATORS, **record_queries.OPERATORS, **build_queries.OPERATORS, **reference_queries.OPERATORS}


def queries() -> dict:
    return {name: q for name, (q, _) in OPERATORS.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in OPERATORS.items() if sql}
