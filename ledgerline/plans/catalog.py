"""All registered queries of the core engine, by name, with their SQL."""

from __future__ import annotations

from ledgerline.plans import aggregates, clusters, detectors, filters, forecasts, relations, sources, windows  # noqa: F401
from ledgerline.plans.registry import QUERIES, SQL

FLAGSHIP = "panel_forecast_comparison"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
