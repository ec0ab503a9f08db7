"""Named queries over the given tables."""

import importlib

MODULES = ["layout_queries", "tree_queries", "finding_queries", "admission_queries", "source_queries", "store_queries"]


def load_queries() -> None:
    """Import every query module once, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"quire.plans.{name}")
