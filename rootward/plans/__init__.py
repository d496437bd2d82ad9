"""The registered queries, by area, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from rootward.plans import analytics, evaluation, models, preparation, scoring, storage, tracing

AREAS = (preparation, tracing, evaluation, analytics, scoring, models, storage)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reduce(lambda a, m: a | m.QUERIES, AREAS, {})


def oracles() -> dict[str, str]:
    return reduce(lambda a, m: a | m.ORACLES, AREAS, {})
