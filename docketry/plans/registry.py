"""Registered queries by name, and the SQL that they are held against where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.plans.model import SQL, Collection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, model: bool = False):
    """Register a function of (collection) under its name; `model` puts the model's tables before the SQL."""

    def add(f: Callable[[Collection], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Collection(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = f"WITH {SQL} {sql}" if model else sql
        return f

    return add
