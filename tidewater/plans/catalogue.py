"""Every registered query of the engine with its DuckDB twin."""

from __future__ import annotations

from tidewater.plans import archive, context, details, evidence, graph, knowledge, ledgers, network, reports, resolution, retrieval, scalars, sketches, timeline, upkeep  # noqa: F401  register on import
from tidewater.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
