"""All queries over the driver's tables with their DuckDB oracle."""

from __future__ import annotations

from lodestar.plans import aggregates, flights, geography, graphs, joins, projections, scores, states, tracking, views, windows  # noqa: F401  they register on import
from lodestar.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
