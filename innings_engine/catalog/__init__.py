"""Catalogue of runnable queries, each with its independent SQL where SQL can express it."""
from __future__ import annotations

import importlib

MODULES = ["log_queries", "history_queries", "normalize_queries", "over_queries", "metric_queries", "delivery_queries", "model_queries", "ml_stream_queries", "serving_queries"]


def load():
    """(queries, sql texts) of every catalogue module."""
    from . import base_sql, registry  # noqa: F401
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.SQL
