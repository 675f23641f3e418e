"""Every registered query of the memory engine with its oracle."""

from __future__ import annotations

from . import export_queries, graph_queries, incremental_queries, inspection_queries, memory_queries, order_queries, review_queries, table_queries  # noqa: F401
from .base import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def flagship(spark, sf_dir):
    """Seven memory components and the total reward of every record."""
    return QUERIES[memory_queries.FLAGSHIP](spark, sf_dir)
