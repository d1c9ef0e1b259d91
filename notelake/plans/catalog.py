"""All queries of the core library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from notelake.plans import graph, ingest, quality, registry, search, storage, streams

MODULES = (ingest, storage, search, graph, quality, streams)


def queries() -> dict[str, Callable]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
