"""All registered queries and their SQL."""

from __future__ import annotations

from hoopspark.registry import court, feeds, learned, lineup, outlook, play, series  # noqa: F401  (each import registers its queries)
from hoopspark.registry.core import query


def queries() -> dict:
    return dict(query.queries)


def oracle_sql() -> dict:
    return dict(query.oracle)
