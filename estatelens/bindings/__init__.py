"""The operators bound to a relational test schema, with the same question in SQL."""

from importlib import import_module

MODULES = ("profiling", "serving", "audits", "streams", "changes", "whole", "synthetic", "renames")


def all_queries():
    """The registry after every binding module has registered its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
