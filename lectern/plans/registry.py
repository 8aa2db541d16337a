"""Registered queries and the SQL that says the same."""

from . import files, oracle, queries

QUERIES = queries.QUERIES | files.QUERIES
ORACLE = oracle.ORACLE | files.ORACLE

__all__ = ["ORACLE", "QUERIES"]
