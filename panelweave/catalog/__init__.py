"""Registered queries with their DuckDB counterparts."""

from importlib import import_module

MODULES = ("source_queries", "filter_queries", "join_queries", "aggregate_queries", "window_queries",
           "ordering_queries", "text_queries", "feature_queries", "trade_queries", "stream_queries")


def load() -> None:
    """Import every catalog module so that its queries register."""
    for name in MODULES:
        import_module(f"panelweave.catalog.{name}")
