"""Registered queries, the colour views derived from the test tables, and their oracle SQL."""

from importlib import import_module

QUERY_MODULES = ["queries_color", "queries_design", "queries_extract", "queries_lut", "queries_catalogue", "queries_streams"]


def load_all() -> None:
    """Import every query module once; importing registers its queries."""
    for name in QUERY_MODULES:
        import_module(f"{__name__}.{name}")
