"""All registered queries and their DuckDB oracles, merged from the
per-area registries."""

from __future__ import annotations

from windrift import registry_drift, registry_jobs, registry_prep


def all_queries() -> dict:
    out = {}
    for mod in _modules():
        out.update(mod.QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for mod in _modules():
        out.update(mod.ORACLE)
    return out


def _modules():
    mods = [registry_prep, registry_drift, registry_jobs]
    return mods
