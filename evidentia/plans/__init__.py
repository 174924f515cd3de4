"""Queries over the driver's tables, each with its SQL equivalent where SQL can express it."""

from . import context, corpus, evidence, files, functions, retrieval, rules, sources
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "context", "corpus", "evidence", "files", "functions", "retrieval", "rules", "sources"]
