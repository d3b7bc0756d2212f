"""Queries of the bar engine, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir); without SQL it is compared in the tests only."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


from barspark.catalog import bars, evaluation, joins, known, models, outcomes, research, setups, signals, strategies, stream, trades  # noqa: E402, F401
from barspark.catalog.bars import flagship  # noqa: E402, F401
