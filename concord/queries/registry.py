"""Queries get their doubles rounded, as their SQL does."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .surrogates import rounded

Query = Callable[[SparkSession, str], DataFrame]


def wrapped(queries: dict[str, Query]) -> dict[str, Query]:
    def one(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        return run

    return {name: one(f) for name, f in queries.items()}
