"""Registered queries over the library's operators, and their DuckDB SQL."""

from urlsieve.plans import data_queries, experiment_queries, history_queries, url_queries  # noqa: F401
from urlsieve.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
