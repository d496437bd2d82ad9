"""Registers queries together with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def registry(context: Callable[[SparkSession, str], object]):
    """(queries, oracles, decorator): the decorated function gets context(spark, sf_dir)."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(name: str, oracle: str | None = None):
        def add(f):
            queries[name] = lambda spark, sf_dir: f(context(spark, sf_dir))
            if oracle:
                oracles[name] = oracle
            return f

        return add

    return queries, oracles, query
