"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import evaluation_queries, generator_queries, output_queries, record_queries, relational_queries, scalar_queries

_PARTS = (scalar_queries, relational_queries, evaluation_queries, output_queries, record_queries, generator_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
