"""Registered queries, one module per group of operators."""

from queries import apply, catalog, columns, feeds, monitor, registry, routing, scalars, streaming  # noqa: F401
from queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
