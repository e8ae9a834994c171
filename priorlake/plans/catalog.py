"""All registered queries, wrapped so that dates and times read as UTC."""
from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from priorlake.plans import base

MODULES = ["flagship", "facts", "temporal", "scalars", "evaluation", "ledger", "models"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"priorlake.plans.{name}")


def _in_utc(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: _in_utc(fn) for n, fn in base.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(base.SQL)
