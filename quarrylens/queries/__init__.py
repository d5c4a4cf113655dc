"""Registered queries of the library's own operators with the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ["flagship", "tables", "filtering", "grouping", "ranking", "charting", "comparing", "mapping", "pipelines"]


def _load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"quarrylens.queries.{name}")
        for key, (run, sql) in module.QUERIES.items():
            queries[key] = run
            if sql is not None:
                oracles[key] = sql
    return queries, oracles


QUERIES, ORACLES = _load()
