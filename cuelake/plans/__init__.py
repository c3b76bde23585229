"""Registered queries over transcripts and media, each with the same query in DuckDB's SQL."""

from .transcripts import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
