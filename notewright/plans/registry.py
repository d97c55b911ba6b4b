"""Registry of queries and of the SQL they are checked against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notewright.plans.views import with_views
from notewright.session import ship_package
from notewright.sources.corpus import TestdataCorpus

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(corpus) -> DataFrame`` under ``key``; ``sql`` may use the views of ``views.py``."""

    def register(fn):
        if key in _QUERIES:
            raise ValueError(f"duplicate query {key}")

        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(TestdataCorpus(spark, folder))

        _QUERIES[key] = run
        if sql is not None:
            _ORACLES[key] = with_views(sql)
        return fn

    return register


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Import every plan module and return (queries, oracles)."""
    from notewright.plans import (  # noqa: F401
        catalog_plans,
        coverage_plans,
        decode_plans,
        encode_plans,
        genre_plans,
        join_plans,
        report_plans,
        scalar_plans,
        sequence_plans,
        source_plans,
        statistics_plans,
        vocabulary_plans,
        window_plans,
    )

    return dict(_QUERIES), dict(_ORACLES)
