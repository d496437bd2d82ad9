"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over
global row numbers.

Rows are numbered 0 to n - 1 by (bucket, doc_id, size, CRC-32), the bucket being a hash
of the last three, so the numbers do not depend on files, partitions or executors and
no task orders all rows. The permutation works on pairs (left, right) of digits to the
base a = ceil(sqrt(n)); numbers it throws to n or beyond walk on until they fall below
n. With p the permuted number of a row, its shard is p mod shards and its slot p div
shards: counts differ by one at most, slots have no gap, and both ways can be computed
(`row_number_of`).

Defined results: a null text has size 1 and the CRC-32 of no bytes; rows equal in
doc_id, size and CRC-32 are interchangeable and take consecutive numbers; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootward.llm.common import utf8_size

SHARDS, ROUNDS, SEED, BUCKETS = 8, 6, 20_240_229, 4096
#: Steps of the walk. The domain has under 2 * sqrt(n) + 2 numbers too many, under 3 in 4
#: of them for the smallest n, so a longer walk does not occur; if one did, the job stops.
WALK = 96
#: Rows of one group of equal rows that are numbered at once.
RUN = 100_000


def _keys(seed: int, rounds: int) -> list[int]:
    return [xxhash.xxh64_intdigest(f"{seed}:{i}".encode()) >> 1 for i in range(rounds)]


def base_of(n: int) -> int:
    return max(1, math.isqrt(max(n - 1, 0)) + 1)


def permuted(number: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The place of a row number in the shuffled order of n rows."""
    base = F.lit(base_of(n)).cast("long")
    keys = F.array(*[F.lit(k).cast("long") for k in _keys(seed, rounds)])

    def once(x: Column) -> Column:
        def mix(s: Column, key: Column) -> Column:
            right = s["right"]
            return F.struct(right.alias("left"), ((s["left"] + F.pmod(F.xxhash64(right, key), base)) % base).alias("right"))

        start = F.struct(F.floor(x / base).cast("long").alias("left"), (x % base).alias("right"))
        return F.aggregate(keys, start, mix, lambda s: s["left"] * base + s["right"])

    top = F.lit(n).cast("long")
    last = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(number), lambda p, _: F.when(p < top, p).otherwise(once(p)))
    return F.when(last < top, last).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def row_number_of(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED, rounds: int = ROUNDS) -> int:
    """The row number that stands in a slot of a shard: the permutation backwards."""
    base, p = base_of(n), slot * shards + shard
    while True:
        left, right = divmod(p, base)
        for key in reversed(_keys(seed, rounds)):
            inner = xxhash.xxh64_intdigest(left.to_bytes(8, "little"), 42)
            signed = (h := xxhash.xxh64_intdigest(key.to_bytes(8, "little"), inner)) - (h >> 63 << 64)
            left, right = (right - signed % base) % base, left
        p = left * base + right
        if p < n:
            return p


def numbered(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32 and row_number, 0 to n - 1, of every row."""
    columns = ["doc_id", "size", "text_crc32"]
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (utf8_size(F.col("text")) + 1).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    bucket = F.pmod(F.xxhash64(*columns), F.lit(buckets))
    groups = slim.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("bucket", bucket)
    # One row per bucket, so `buckets` rows at most: that bounds the one-partition window and the broadcast.
    sizes = groups.groupBy("bucket").agg(F.sum("n").alias("rows"))
    before = sizes.selectExpr("bucket", "sum(rows) OVER (ORDER BY bucket) - rows AS before")
    ordered = groups.selectExpr("*", "sum(n) OVER (PARTITION BY bucket ORDER BY doc_id, size, text_crc32) - n AS inside")
    placed = ordered.join(F.broadcast(before), "bucket").selectExpr(*columns, "n", "before + inside AS first")
    runs = placed.selectExpr("*", f"explode(sequence(0L, (n - 1) div {RUN})) AS run")
    return runs.selectExpr(*columns, f"explode(sequence(first + run * {RUN}, first + least(n, (run + 1) * {RUN}) - 1)) AS row_number")


def shards_of(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row."""
    n = docs.count()
    rows = numbered(docs).withColumn("place", permuted(F.col("row_number"), n, seed))
    return rows.select(
        "doc_id", "size", "text_crc32", "row_number",
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"),
    )
