"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

from areascreen.catalog import registry

#: Catalog modules, in the order in which their queries are listed.
MODULES = ["access", "scalars", "spatial", "decide", "entities", "network", "relations", "storage"]


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"areascreen.catalog.{name}")
    return registry.QUERIES, registry.ORACLES
