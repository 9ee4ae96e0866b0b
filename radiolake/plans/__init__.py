"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib

MODULES = ["kpi_queries", "explore_queries", "counter_queries", "signalling_queries", "event_queries", "forecast_queries", "streaming_queries", "insight_queries"]


def load_queries():
    for m in MODULES:
        importlib.import_module(f"radiolake.plans.{m}")
    from radiolake.plans import registry

    return dict(registry.QUERIES), dict(registry.SQL)
