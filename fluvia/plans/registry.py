"""Names of the queries and the SQL texts they are compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluvia.sources.tables import sql_over

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("evapotranspiration", "fields", "points", "wells", "spatial", "network", "raster", "models", "parsing", "reaches", "shapes")


def query(views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with SQL over the named views where SQL expresses it."""

    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql_over(views, sql)
        return function

    return register


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"fluvia.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The water-year partition of evapotranspiration."""
    _load()
    return _QUERIES["et_partition_water_year"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
