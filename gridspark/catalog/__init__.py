"""Registered queries: each a Spark plan plus, where possible, reference SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("plans", "soil", "climate", "grids", "statistics", "models")


def load():
    """Name -> query, after importing every catalog module."""
    for module in MODULES:
        import_module(f"gridspark.catalog.{module}")
    from gridspark.catalog.registry import REGISTRY

    return REGISTRY
