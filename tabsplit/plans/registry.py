"""All queries of the engine by name, each with the DuckDB text that must give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabsplit.plans import billing, changes, measuring, parsing, photos, scanning, storing
from tabsplit.shared import ship

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (billing, parsing, storing, changes, measuring, scanning, photos)


def importable(query: Query) -> Query:
    """The query with Python workers able to import this package, wherever the driver was started."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ship(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: importable(q) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importable(billing.settle_bill)(spark, sf_dir)
