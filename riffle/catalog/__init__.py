"""Registered queries with the SQL that checks them."""

from riffle.catalog import (  # noqa: F401
    aggregates, expressions, filters, jobs, joins, models, network, ranking, scores, sql_functions, streams, tables, text,
)
from riffle.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
