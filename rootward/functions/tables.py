"""Helpers for plans that iterate: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder on a local
    master; on a cluster, where executors would not see that, an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frontier_loop(
    seeds: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], hops: int, every: int = 3, enough: int | None = None
) -> DataFrame:
    """Breadth-first expansion: rows of `seeds` and what `step` reaches, with the hop of first sight.

    Each round joins the newest rows only, leaves out what is known (anti-join) and keeps
    one row per key. Rounds end with an empty frontier, after `hops`, or with the one that has
    found `enough` rows beside the seeds. Every round's frontier is written; the union of all is
    read, so the plan stays flat."""
    known = written(seeds.select(*key).distinct().withColumn("hop", F.lit(0)), "frontier")
    newest, n = known, 0
    for hop in range(1, hops + 1):
        found = step(newest).select(*key).distinct().join(known.select(*key), key, "left_anti")
        newest = written(found.withColumn("hop", F.lit(hop)), "frontier")
        if newest.isEmpty():
            break
        known = known.unionByName(newest)
        if enough is not None and (n := n + newest.count()) >= enough:
            break
        if hop % every == 0:
            known = written(known, "visited")
    return known


def first_rows(rows: DataFrame, order: list[Column | str], n: int, per_range: int = 1_000_000) -> DataFrame:
    """The first n rows in an order that tells all rows apart.

    Rows are dealt out by ranges of the order and counted; whole ranges are taken up to that which
    holds the n-th row, and of that one its first rows. No task holds more than a range."""
    total = rows.count()
    if total <= n:
        return rows
    if n <= 0:
        return rows.limit(0)
    spark = rows.sparkSession
    keys = [f"_order{i}" for i in range(len(order))]
    marked = rows.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in zip(keys, order, strict=True)])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // per_range + 1)
    ranged = written(marked.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    before = 0
    for r in sorted(ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()):  # a row per range
        if before + r.n >= n:
            break
        before += r.n
    last = ranged.where(F.col("_range") == r["_range"]).withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)))
    return ranged.where(F.col("_range") < r["_range"]).select(*rows.columns).unionByName(last.where(F.col("_at") <= n - before).select(*rows.columns))


def running_sums(rows: DataFrame, by: list[str], part: str, order: list, value: str, name: str, also_count: str | None = None) -> DataFrame:
    """rows with `name`, the sum of `value` up to and with each row within `by`, along `part` and
    then `order`; also_count names a column for the row's number, from 1.

    Parts are summed up by themselves and the sums of the parts before added, so that a large
    group of `by` is many tasks. `part` ascends along the order wanted."""
    one = F.lit(1).cast("long")
    sizes = rows.groupBy(*by, part).agg(F.sum(value).alias("_sum"), F.sum(one).alias("_rows"))
    upto = Window.partitionBy(*by).orderBy(part)
    before = sizes.select(*by, part, (F.sum("_sum").over(upto) - F.col("_sum")).alias("_before"), (F.sum("_rows").over(upto) - F.col("_rows")).alias("_rows_before"))
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_in", F.sum(value).over(inside)).withColumn("_at", F.sum(one).over(inside)).join(before, [*by, part])
    extra = [(F.col("_rows_before") + F.col("_at")).alias(also_count)] if also_count else []
    return found.select(*rows.columns, (F.col("_before") + F.col("_in")).alias(name), *extra)


def seeded_order(number: Column, seed: int) -> Column:
    """A reproducible pseudo-random sort key of a whole number, the same in any SQL engine."""
    return F.pmod(number * F.lit(2654435761).cast("long") + F.lit(seed).cast("long") * 40503, F.lit(2147483648).cast("long"))
