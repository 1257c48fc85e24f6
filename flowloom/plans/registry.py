"""The modules whose QUERIES and SQL make up the engine's query set."""

from __future__ import annotations

from types import ModuleType

from flowloom.plans import catalog, graphs, models, outliers, process, relations, training


def modules() -> list[ModuleType]:
    return [process, graphs, relations, models, catalog, outliers, training]
