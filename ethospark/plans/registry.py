"""All registered queries by name, with their DuckDB equivalents."""

from __future__ import annotations

from ethospark.plans import archive, budgets, datasets, decisions, gates, intervals, marts, metrics, passes, rasters, rerank, sequences, smoothing, streams, summaries, transfer  # noqa: F401
from ethospark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
