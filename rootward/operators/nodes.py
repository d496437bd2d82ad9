"""Node tables: labels, splits, snapshots, times, samples and ids.

Nodes have node_type, id, num (a whole number of their own), time (null: unknown) and
label columns. Ties break by id."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootward.functions.tables import first_rows, frontier_loop, seeded_order


def clean_labels(nodes: DataFrame, classes: DataFrame, key: str = "id") -> DataFrame:
    """y and labelled: class 1 is illicit, 2 licit, 3 or none is unlabelled."""
    known = F.coalesce("class", F.lit(3))
    found = nodes.join(classes.select(key, "class"), key, "left")
    return found.select(*nodes.columns, F.when(known == 1, 1).otherwise(0).alias("y"), known.isin(1, 2).alias("labelled"))


def raw_labels(nodes: DataFrame, classes: DataFrame, key: str = "id") -> DataFrame:
    """y: 1 for class 1, 0 for all others, nothing left out."""
    found = nodes.join(classes.select(key, "class"), key, "left")
    return found.select(*nodes.columns, F.when(F.col("class") == 1, 1).otherwise(0).alias("y"))


def _numbered(rows: DataFrame, by: list[str], order: list[Column], buckets: int = 256) -> DataFrame:
    """rows with rn (1, 2, ...) within `by` along `order`, and n (rows of the group), without
    a task per group: the first sort key, a number under 2**31, deals rows into ranges."""
    ranged = rows.withColumn("_range", F.floor(order[0] / (2**31 // buckets)).cast("int"))
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_rows"))
    upto = Window.partitionBy(*by).orderBy("_range")
    before = sizes.select(*by, "_range", (F.sum("_rows").over(upto) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy(*by)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), [*by, "_range"]).withColumn("rn", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def stratified_split(nodes: DataFrame, seed: int = 42, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """split of labelled nodes per class: int(n * train), int(n * val), the rest is test.

    Shares are taken as decimals: 0.7 of 90 is 63, which floats bring below 63."""
    ordered = _numbered(nodes.where("labelled"), ["y"], [seeded_order(F.col("num"), seed), F.col("id")])
    first, second = (F.floor(F.col("n") * F.lit(Decimal(str(share)))) for share in (train, val))
    split = F.when(F.col("rn") <= first, "train").when(F.col("rn") <= first + second, "val").otherwise("test")
    return ordered.select(*nodes.columns, split.alias("split"))


def split_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("split", "y").agg(F.count("*").alias("n"))


def latest_snapshot(rows: DataFrame, key: str, time: str | None, position: str) -> DataFrame:
    """One row per key: the latest time, an unknown time counting as latest, then the later row.

    An aggregate, which combines before the shuffle, so a key with many rows is no task of its own."""
    order = ([F.col(time).isNull().alias("unknown"), F.col(time).alias("time")] if time else []) + [F.col(position).alias("position")]
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return best.select("row.*")


def connected(addr_tx: DataFrame, tx_addr: DataFrame, addr_addr: DataFrame | None = None) -> DataFrame:
    """id of wallets at either end of a transaction, on request of wallet links as well."""
    parts = [addr_tx.select(F.col("src").alias("id")), tx_addr.select(F.col("dst").alias("id"))]
    if addr_addr is not None:
        parts += [addr_addr.select(F.col("src").alias("id")), addr_addr.select(F.col("dst").alias("id"))]
    return reduce(DataFrame.union, parts).distinct()


def standardise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores over all rows: what is no finite number counts as 0, no spread as 1."""
    finite = {c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c).cast("double")) for c in columns}
    filled = rows.withColumns(finite)
    stats = filled.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]).first()
    z = {c: (F.col(c) - F.lit(stats[f"_m_{c}"] or 0.0)) / F.lit(stats[f"_s_{c}"] or 1.0) for c in columns}
    return filled.withColumns(z)


def tx_time(txs: DataFrame) -> DataFrame:
    return txs.select("id", F.when(F.col("time") >= 0, F.col("time")).alias("time"))


def funding_time(tx_addr: DataFrame, txs: DataFrame) -> DataFrame:
    """Earliest known time of the transactions that pay a wallet."""
    times = txs.where("time >= 0").select(F.col("id").alias("src"), "time")
    return tx_addr.join(times, "src").groupBy(F.col("dst").alias("id")).agg(F.min("time").alias("time"))


def labelled_neighbourhood(txs: DataFrame, tx_tx: DataFrame) -> DataFrame:
    """ids of labelled transactions and of those that share a transaction link with one."""
    own = txs.where("labelled").select("id")
    after = tx_tx.join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    before = tx_tx.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return own.union(after).union(before).distinct().join(txs.select("id"), "id", "left_semi")


#: Which ends of each edge table are transactions.
TX_ENDS = {"addr_tx": ("dst",), "tx_addr": ("src",), "tx_tx": ("src", "dst"), "addr_addr": ()}


def restricted_tables(tables: dict[str, DataFrame], kept: DataFrame) -> dict[str, DataFrame]:
    """The edge tables without edges of transactions that are not kept."""
    found = {}
    for name, ends in TX_ENDS.items():
        found[name] = reduce(lambda t, end: t.join(kept.select(F.col("id").alias(end)), end, "left_semi"), ends, tables[name]).select("src", "dst")
    return found


def wallet_subgraph(addr_tx: DataFrame, tx_addr: DataFrame, addr_addr: DataFrame, txs: DataFrame, hops: int = 2) -> DataFrame:
    """Wallets of labelled transactions, then up to hops - 1 wallet links further; id, hop."""
    own = txs.where("labelled").select("id")
    start = (
        addr_tx.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        .union(tx_addr.join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")))
    )
    both = addr_addr.select("src", "dst").union(addr_addr.select(F.col("dst"), F.col("src")))
    step = lambda new: new.join(both, new.id == both.src).select(F.col("dst").alias("id"))
    return frontier_loop(start, step, ["id"], hops - 1).select("id", (F.col("hop") + 1).alias("hop"))


def global_ids(nodes: DataFrame) -> DataFrame:
    """Dense ids: types by name, within a type by num. Sizes are added up over ranges of a thousand
    numbers and over ranges of a thousand such ranges; one task adds up the latter."""
    bucket = F.floor(F.col("num") / 1000).cast("long")
    ranged = nodes.select("node_type", "id", "num", bucket.alias("_bucket"), F.floor(bucket / 1000).cast("long").alias("_shelf"))
    sizes = ranged.groupBy("node_type", "_shelf", "_bucket").agg(F.count("*").alias("_rows"))
    shelves = sizes.groupBy("node_type", "_shelf").agg(F.sum("_rows").alias("_shelf_rows"))
    above = shelves.select("node_type", "_shelf", (F.sum("_shelf_rows").over(Window.orderBy("node_type", "_shelf")) - F.col("_shelf_rows")).alias("_above"))
    on_shelf = F.sum("_rows").over(Window.partitionBy("node_type", "_shelf").orderBy("_bucket")) - F.col("_rows")
    before = sizes.select("node_type", "_shelf", "_bucket", on_shelf.alias("_on_shelf")).join(above, ["node_type", "_shelf"]).select("node_type", "_bucket", (F.col("_above") + F.col("_on_shelf")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("node_type", "_bucket").orderBy("num", "id")) - 1
    return ranged.withColumn("_in", inside).join(before, ["node_type", "_bucket"]).select("node_type", "id", (F.col("_before") + F.col("_in")).alias("global_id"))


def decode_ids(rows: DataFrame, ids: DataFrame, column: str = "global_id") -> DataFrame:
    """rows with node_type and id of the global id in `column`; unknown ids give null."""
    return rows.join(ids.select(F.col("global_id").alias(column), "node_type", "id"), column, "left")


def node_times(nodes: DataFrame) -> DataFrame:
    return nodes.where("time >= 0").select("node_type", "id", "time")


def dataset_stats(groups: dict[str, DataFrame]) -> DataFrame:
    """scope, class, n, percent for each named table with a class column."""
    counts = [df.groupBy(F.coalesce("class", F.lit(3)).alias("class")).agg(F.count("*").alias("n")).withColumn("scope", F.lit(name)) for name, df in groups.items()]
    every = reduce(DataFrame.unionByName, counts)
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("scope")), 6)
    return every.select("scope", "class", "n", share.alias("percent"))


def class_weights(nodes: DataFrame) -> DataFrame:
    """weight of class 1 against 1.0 of class 0: negatives over positives; null if balanced or one is missing."""
    counts = nodes.agg(F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("neg"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"))
    fit = (F.col("neg") > 0) & (F.col("pos") > 0) & (F.col("neg") != F.col("pos"))
    return counts.select("neg", "pos", F.when(fit, F.round(F.col("neg") / F.col("pos"), 6)).alias("weight"))


def subsample_graph(nodes: DataFrame, edges: DataFrame, target_type: str, max_target: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """All positives of a type, negatives up to max_target, their neighbours; induced edges."""
    own = nodes.where(F.col("node_type") == target_type)
    positive = own.where("y = 1")
    room = max(0, max_target - positive.count())
    negative = first_rows(own.where("y = 0"), [seeded_order(F.col("num"), seed), "id"], room)
    kept = positive.select("id").union(negative.select("id"))
    near = (
        edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        .union(edges.join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))).distinct()
    )
    others = nodes.where(F.col("node_type") != target_type).join(near, "id", "left_semi").select("id")
    ids = kept.union(others).distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside


def proportional_sample(nodes: DataFrame, limit: int) -> DataFrame:
    """Up to `limit` nodes: per type its share, rounded down, by num; what is left goes to the
    largest types. The shares are worked out on the table of type counts (a row per type)."""
    counts = {r.node_type: r.n for r in nodes.groupBy("node_type").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    take = {t: min(n, limit * n // total) for t, n in counts.items()} if total else {}
    left = min(limit, total) - sum(take.values())
    for t in sorted(counts, key=lambda t: (-counts[t], t)):
        more = min(left, counts[t] - take[t])
        take[t], left = take[t] + more, left - more
    parts = [first_rows(nodes.where(F.col("node_type") == t), ["num", "id"], k) for t, k in sorted(take.items())]
    return reduce(DataFrame.unionByName, parts) if parts else nodes.limit(0)


VARIANTS = {"transaction": ("transaction",), "wallet": ("wallet",), "joint": ("transaction", "wallet")}


def labelled_targets(nodes: DataFrame, variant: str, seed: int = 42) -> DataFrame:
    """Supervised rows of a variant: the labelled nodes of its types, each type split by itself."""
    parts = [stratified_split(nodes.where(F.col("node_type") == t), seed) for t in VARIANTS[variant]]
    return reduce(DataFrame.unionByName, parts)
