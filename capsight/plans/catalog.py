"""All registered queries: key -> Spark plan, key -> oracle SQL."""

from __future__ import annotations

import importlib

from capsight.plans.base import REGISTRY

_MODULES = ["q_time", "q_groups", "q_dist", "q_rules", "q_ingest"]
_loaded = False


def _load():
    global _loaded
    if not _loaded:
        for m in _MODULES:
            importlib.import_module(f"capsight.plans.{m}")
        _loaded = True


def queries():
    _load()
    return {k: q.build for k, q in REGISTRY.items()}


def oracle_sql():
    _load()
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}
