"""All registered queries, gathered from the catalogue modules."""

from __future__ import annotations


def all_queries():
    from . import catalog, catalog_ops, catalog_streams  # noqa: F401  (register on import)
    return dict(catalog.REGISTRY)
