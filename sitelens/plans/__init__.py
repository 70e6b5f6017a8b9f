"""Queries that apply the operators to tables, each with the SQL that gives the same rows."""

from sitelens.plans import columns, contracts, documents, pages, protocols, rendered, runs
from sitelens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "columns", "contracts", "documents", "pages", "protocols", "rendered", "runs"]
