"""Registered queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

from .registry import REGISTRY, Entry

MODULES = [
    "soft_label_queries",
    "space_queries",
    "text_queries",
    "model_queries",
    "graph_queries",
    "selection_queries",
    "source_queries",
]


def all_queries() -> dict[str, Entry]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return dict(REGISTRY)
