"""Queries by inventory id: the Spark plan and, where SQL can say it, the same question in SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotweave import rules as R
from plotweave.plans.fixtures import frame, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = [
    "text_queries", "geometry_queries", "filter_queries", "check_queries", "spatial_queries", "linking_queries",
    "compare_queries", "metric_queries", "store_queries", "streaming_queries",
]


class Tables:
    """Attribute access to the views: ``t.det``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)


def query(name: str, views: str = "det", sql: str | None = None):
    """Register ``fn(tables)``; ``views`` are the views the SQL reads."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, *views.split())
        return fn

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"plotweave.plans.{m}")


def sql_list(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in R.spellings(names)) + ")"


def sql_case(table: dict, key: str = "cls", default="NULL") -> str:
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    rows = " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in R.with_spellings(table).items())
    return f"CASE {key} {rows} ELSE {default} END"
