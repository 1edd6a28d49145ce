"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus the DuckDB
oracle SQL for names that have an exact SQL form."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
