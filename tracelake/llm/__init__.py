"""Operators for large training-data pipelines; nothing else in the library imports this subpackage."""

from tracelake.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
