"""Runnable queries over the benchmark tables."""

from importlib import import_module

FAMILIES = ("risk_queries", "series_queries", "property_queries", "register_queries", "resolution_queries", "market_queries")


def load_catalog():
    """All registered queries by name."""
    for family in FAMILIES:
        import_module(f"rentlens.plans.{family}")
    from rentlens.plans.catalog import CATALOG
    return dict(CATALOG)
