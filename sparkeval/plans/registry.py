"""Named queries: each is (spark, sf_dir) -> DataFrame, optionally paired with an
ANSI-SQL oracle that DuckDB runs on the same parquet tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import ASCII_LOWER, ASCII_PUNCTUATION, ASCII_UPPER
from ..session import TABLES, register_tables, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a fixture projection written in the common SQL subset of Spark and DuckDB."""
    named = set(re.findall(r"\w+", text))
    register_tables(spark, sf_dir, [t for t in TABLES if t in named])
    return spark.sql(text)


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# DuckDB spelling of janitor_normalize (same delete rule as Spark's translate).
def duck_janitor(expr: str) -> str:
    return f"translate({expr}, {sql_str(ASCII_UPPER + ASCII_PUNCTUATION)}, {sql_str(ASCII_LOWER)})"
