"""The registered queries and their SQL."""

from __future__ import annotations

from . import cache, evidence, geometry, records, sequences, silhouettes, stateful, tracks, vectors

_MODULES = (vectors, geometry, sequences, tracks, records, evidence, cache, silhouettes, stateful)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
