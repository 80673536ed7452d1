"""Registration of a query and its SQL twin under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.plans.fixtures import WITH, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, plain: bool = False):
    """Register ``f(views)``; ``sql`` follows the views' common table expressions unless ``plain``."""

    def wrap(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql if plain else WITH + sql
        return f

    return wrap
