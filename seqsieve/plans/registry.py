"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqsieve.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, oracle: str | None = None):
    """Register f(view, ...) as a query over the named views; oracle is SQL over the same views."""

    def keep(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return keep
