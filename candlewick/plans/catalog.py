"""Collects every registered query."""

from __future__ import annotations

from functools import wraps

from candlewick.plans import (  # noqa: F401  (importing registers)
    model_queries,
    pattern_queries,
    series_queries,
    stream_queries,
    text_queries,
)
from candlewick.plans.registry import ORACLES, QUERIES, Query
from candlewick.session import configure


def _configured(fn: Query) -> Query:
    @wraps(fn)
    def run(spark, root):
        return fn(configure(spark), root)

    return run


def queries() -> dict[str, Query]:
    return {name: _configured(fn) for name, fn in QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
