"""Registered queries: a callable over the views and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from .views import Views, oracle


class Query(NamedTuple):
    run: Callable[[Views], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, body: str | None = None, *views: str):
    """Register the decorated function as ``name`` with the oracle ``body`` over ``views``."""

    def register(run: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, oracle(body, *views) if body else None)
        return run

    return register
