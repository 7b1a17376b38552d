"""Named queries and the SQL that states the same result."""

from __future__ import annotations

from gridloom.plans.views import with_views

QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with its reference SQL."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return keep


def load_all() -> None:
    from gridloom.plans import (  # noqa: F401
        analytics, cells, grids, headlines, masks, packed, panels, places, quality, queries, raster, reducers, regions,
        streams,

    )


def oracles() -> dict[str, str]:
    """Complete SQL per query, with the views it reads."""
    return {name: with_views(sql) for name, sql in _SQL.items()}
