"""Registered queries: each applies an operator to the given tables; most have SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ("keys", "filters", "groups", "joins", "windows", "dates", "files", "plans")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (tables) -> DataFrame, where tables(name) reads one of the given tables."""

    def register(build: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return register


def load() -> tuple[dict, dict]:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES, SQL
