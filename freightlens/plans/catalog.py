"""All registered queries (name -> (spark, sf_dir) -> DataFrame) and their
DuckDB twins (name -> SQL).  Keys without a twin are rows-only checks."""

from __future__ import annotations

import importlib

_MODULES = ["q_core", "q_kpis", "q_profile", "q_gps", "q_rules", "q_ml", "q_models", "q_stream", "q_sinks"]


def _load():
    queries, sql = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(f"{__package__}.{name}")
        queries.update(mod.Q)
        sql.update(mod.SQL)
    return queries, sql


def queries() -> dict:
    return _load()[0]


def oracle_sql() -> dict:
    return _load()[1]
