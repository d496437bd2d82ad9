"""Logistic models of many groups at once, by Newton steps over grouped sums.

A step is one pass over the rows: tasks add up gradients and Hessians of every group they meet,
Spark adds what the tasks give, and the driver solves a system per group, as wide as a model has
features. So neither the number of groups nor that of the rows costs further passes. The number of
steps is fixed, which any engine can repeat.

A model is a row of a table: the group, n, intercept, b_<feature>, and where features were scaled
mean_<feature> and std_<feature>. Scores are SQL expressions over that table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootward.functions.tables import written

#: Newton steps, the weight of half the squared coefficients beside the mean loss, and the least curvature of a row.
STEPS, RIDGE, LEAST_CURVATURE = 8, 1e-3, 1e-6


def _sums(rows: DataFrame, by: str, features: list[str], models: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """By group: the sum of weights, the gradient and the upper triangle of the Hessian at the models' coefficients."""
    k = len(features) + 1
    upper = np.triu_indices(k)
    schema = pa.schema([("group", pa.string()), ("place", pa.int32()), ("value", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in parts:
            group = b.column("group").to_numpy(zero_copy_only=False)
            y, w = b.column("y").to_numpy(zero_copy_only=False), b.column("w").to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(len(y)), *(b.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(k - 1))])
            for name in set(group) & models.keys():
                own = group == name
                xs, ws = x[own], w[own]
                p = 1 / (1 + np.exp(-np.clip(xs @ models[name], -700, 700)))
                curve = ws * np.maximum(p * (1 - p), LEAST_CURVATURE)
                sums = np.concatenate(([ws.sum()], xs.T @ (ws * (p - y[own])), ((xs * curve[:, None]).T @ xs)[upper]))
                totals[name] = totals.get(name, 0) + sums
        for name, sums in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(sums)), pa.array(range(len(sums)), pa.int32()), pa.array(sums)], schema=schema)

    found = rows.mapInArrow(run, "group string, place int, value double").groupBy("group", "place").agg(F.sum("value").alias("value"))
    totals: dict[str, np.ndarray] = {}
    for r in found.collect():
        totals.setdefault(r.group, np.zeros(1 + k + len(upper[0])))[r.place] = r.value
    return totals


def _stepped(sums: np.ndarray, beta: np.ndarray, ridge: float) -> np.ndarray:
    k = len(beta)
    upper = np.triu_indices(k)
    hessian = np.zeros((k, k))
    hessian[upper] = sums[1 + k :] / sums[0]
    hessian = hessian + np.triu(hessian, 1).T
    free = np.array([0.0] + [1.0] * (k - 1))  # the intercept is not held back
    gradient = sums[1 : 1 + k] / sums[0] + ridge * free * beta
    return beta - np.linalg.solve(hessian + np.diag(ridge * free), gradient)


def fit(rows: DataFrame, by: str, features: list[str], steps: int = STEPS, ridge: float = RIDGE, hold: dict[str, float] | None = None, weight: Column | None = None) -> DataFrame:
    """by, n, intercept, b_<feature> of every group that has both labels y (0 and 1).

    Minimises the weighted mean of the log losses and half the ridge times the squared
    coefficients; hold multiplies the ridge of a group. Nulls count 0; rows without a label or group are left out."""
    xs = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)]
    slim = rows.where(F.col("y").isNotNull() & F.col(by).isNotNull())
    slim = written(slim.select(F.col(by).cast("string").alias("group"), F.col("y").cast("double").alias("y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), *xs), "model-rows")
    counts = {r.group: r.n for r in slim.groupBy("group").agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high")).where("low < high").collect()}
    models = {g: np.zeros(len(features) + 1) for g in counts}
    for _ in range(steps if models else 0):
        sums = _sums(slim, "group", features, models)
        models = {g: _stepped(sums[g], beta, ridge * (hold or {}).get(g, 1.0)) for g, beta in models.items()}
    listed = [(g, counts[g], *map(float, models[g])) for g in sorted(models)]
    return rows.sparkSession.createDataFrame(listed, f"`{by}` string, n long, intercept double" + "".join(f", `b_{f}` double" for f in features))


def scaled(rows: DataFrame, by: str, features: list[str], train: Column) -> tuple[DataFrame, DataFrame]:
    """rows with each feature less its mean over its spread, both of the training rows of the group, and
    the table of mean_<feature> and std_<feature> (a row per group; 1 for a feature that does not vary)."""
    take = []
    for f in features:
        x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        take += [F.avg(x).alias(f"mean_{f}"), F.stddev_pop(x).alias(f"_std_{f}")]
    stats = rows.where(train).groupBy(by).agg(*take)
    stats = stats.select(by, *[F.col(f"mean_{f}") for f in features], *[F.when(F.col(f"_std_{f}") > 1e-12, F.col(f"_std_{f}")).otherwise(1.0).alias(f"std_{f}") for f in features])
    stats = written(stats, "feature-scales")
    moved = [((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.col(f"mean_{f}")) / F.col(f"std_{f}")).alias(f) for f in features]
    kept = [c for c in rows.columns if c not in features]
    return rows.join(F.broadcast(stats), by).select(*kept, *moved), stats


def probability(features: list[str], scales: bool = False) -> Column:
    """The score of a row beside its model."""
    z = F.col("intercept")
    for f in features:
        x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        z = z + F.col(f"b_{f}") * ((x - F.col(f"mean_{f}")) / F.col(f"std_{f}") if scales else x)
    return 1 / (1 + F.exp(-z))
