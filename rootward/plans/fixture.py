"""The typed causal graph over the driver tables, once as DataFrames and once as SQL.

Orders are transactions (t...), customers are wallets (w...). A wallet sends its orders,
an order pays the wallet its first part points to, orders of a customer follow one
another, and wallets are linked by a rule. CTES holds the same definitions for the
oracle queries; its parts are named as the DataFrames are."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootward.functions.tables import written
from rootward.operators import edges as E
from rootward.operators import nodes as N

WALLET_BASE = 10_000_000
NUM = f"(CASE WHEN {{0}} LIKE 't%' THEN CAST(substr({{0}}, 2) AS BIGINT) ELSE {WALLET_BASE} + CAST(substr({{0}}, 2) AS BIGINT) END)"
CE = f"(((({NUM.format('src')} * 7919 + {NUM.format('dst')} * 104729) % 2001) - 1000) / CAST(1000 AS DOUBLE))"
SCORE = "(((num * 48271 + 11) % 1000) / CAST(1000 AS DOUBLE))"


@dataclass
class Graph:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n_customers(self) -> int:
        return self.table("customer").count()

    @cached_property
    def tx(self) -> DataFrame:
        return self.table("orders").select(
            F.concat(F.lit("t"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("num"),
            (F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) / 50) + 1).cast("int").alias("time"),
            F.col("o_totalprice").alias("amount"), "o_custkey", "o_orderdate",
            F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), 2).otherwise(3).alias("class"),
        )

    @cached_property
    def wallets(self) -> DataFrame:
        k = F.col("c_custkey") % 10
        return self.table("customer").select(
            F.concat(F.lit("w"), "c_custkey").alias("id"), (F.col("c_custkey") + WALLET_BASE).alias("num"), "c_acctbal",
            F.when(k == 0, 1).when(k <= 5, 2).otherwise(3).alias("class"),
        )

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"))
        lines = self.table("lineitem").where("l_linenumber = 1").join(orders, "l_orderkey", "left_semi")
        follow = F.lag("id").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "num"))
        k = F.col("c_custkey")
        return {
            "addr_tx": self.tx.select(F.concat(F.lit("w"), "o_custkey").alias("src"), F.col("id").alias("dst")),
            "tx_addr": lines.select(F.concat(F.lit("t"), "l_orderkey").alias("src"), F.concat(F.lit("w"), F.col("l_partkey") % self.n_customers).alias("dst")).distinct(),
            "tx_tx": self.tx.select(follow.alias("src"), F.col("id").alias("dst")).where("src IS NOT NULL"),
            "addr_addr": self.table("customer").select(F.concat(F.lit("w"), k).alias("src"), F.concat(F.lit("w"), (k * 7 + 3) % self.n_customers).alias("dst")),
        }

    @cached_property
    def nodes(self) -> DataFrame:
        funded = N.funding_time(self.tables["tx_addr"], self.tx)
        wallets = self.wallets.join(funded, "id", "left").select(F.lit("wallet").alias("node_type"), "id", "num", "time", "class")
        txs = self.tx.select(F.lit("transaction").alias("node_type"), "id", "num", "time", "class")
        both = txs.unionByName(wallets)
        # Written, as edges meet them at both ends and funding times are an aggregate.
        return written(both.select("*", F.when(F.col("class") == 1, 1).otherwise(0).alias("y"), F.col("class").isin(1, 2).alias("labelled")), "nodes")

    @cached_property
    def timed(self) -> DataFrame:
        return E.timed_edges(self.tables, self.nodes)

    @cached_property
    def edges(self) -> DataFrame:
        return self.timed.drop("src_time", "dst_time")

    @cached_property
    def causal(self) -> DataFrame:
        """Written once per graph: traces, effects and scans all read it."""
        return written(E.causal_edges(self.timed, self.nodes), "causal")

    @cached_property
    def effects(self) -> DataFrame:
        return self.causal.withColumn("ce", F.expr(CE))

    @cached_property
    def targets(self) -> DataFrame:
        """Illicit transactions."""
        return self.tx.where("class = 1").select(F.col("id").alias("target"))


CTES = {
    "nc": "SELECT count(*) AS nc FROM customer",
    "tx": """SELECT 't' || o_orderkey AS id, o_orderkey AS num,
        CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 50.0) AS INTEGER) + 1 AS time,
        o_totalprice AS amount, o_custkey, o_orderdate,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 2 ELSE 3 END AS class FROM orders""",
    "wallets": f"""SELECT 'w' || c_custkey AS id, c_custkey + {WALLET_BASE} AS num, c_acctbal,
        CASE WHEN c_custkey % 10 = 0 THEN 1 WHEN c_custkey % 10 <= 5 THEN 2 ELSE 3 END AS class FROM customer""",
    "addr_tx": "SELECT 'w' || o_custkey AS src, id AS dst FROM tx",
    "tx_addr": """SELECT DISTINCT 't' || l_orderkey AS src, 'w' || (l_partkey % nc) AS dst FROM lineitem, nc
        WHERE l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "tx_tx": "SELECT * FROM (SELECT lag(id) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, num) AS src, id AS dst FROM tx) WHERE src IS NOT NULL",
    "addr_addr": "SELECT 'w' || c_custkey AS src, 'w' || ((c_custkey * 7 + 3) % nc) AS dst FROM customer, nc",
    "funded": "SELECT dst AS id, min(time) AS time FROM tx_addr JOIN tx ON tx.id = src WHERE time >= 0 GROUP BY dst",
    "nodes": """SELECT *, CASE WHEN class = 1 THEN 1 ELSE 0 END AS y, class IN (1, 2) AS labelled FROM (
        SELECT 'transaction' AS node_type, id, num, time, class FROM tx UNION ALL
        SELECT 'wallet', w.id, w.num, f.time, w.class FROM wallets w LEFT JOIN funded f ON f.id = w.id)""",
    "edges": """SELECT 'wallet' AS src_type, src, 'sends' AS rel, 'transaction' AS dst_type, dst, 'wallet__to__transaction' AS edge_type FROM addr_tx
            WHERE src IN (SELECT id FROM wallets) AND dst IN (SELECT id FROM tx)
        UNION ALL SELECT 'transaction', src, 'pays', 'wallet', dst, 'transaction__to__wallet' FROM tx_addr WHERE src IN (SELECT id FROM tx) AND dst IN (SELECT id FROM wallets)
        UNION ALL SELECT 'transaction', src, 'flows_to', 'transaction', dst, 'transaction__to__transaction' FROM tx_tx WHERE src IN (SELECT id FROM tx) AND dst IN (SELECT id FROM tx)
        UNION ALL SELECT 'wallet', src, 'connects', 'wallet', dst, 'wallet__to__wallet' FROM addr_addr WHERE src IN (SELECT id FROM wallets) AND dst IN (SELECT id FROM wallets)""",
    "timed": "SELECT e.*, a.time AS src_time, b.time AS dst_time FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst",
    "causal": """SELECT src, dst, min(edge_type) AS edge_type FROM timed WHERE edge_type <> 'wallet__to__wallet'
        AND NOT coalesce(src_time > dst_time, FALSE) GROUP BY src, dst""",
    "effects": f"SELECT *, {CE} AS ce FROM causal",
    "targets": "SELECT id AS target FROM tx WHERE class = 1",
}


def sql(query: str, **more: str) -> str:
    """query behind the common tables; more adds tables of its own, in order."""
    parts = CTES | more
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n" + query


def keyed(text: str, **tables: str) -> str:
    """text with recursive tables that hold one row per key, the latest: name="columns | key columns"."""
    for name, spec in tables.items():
        columns, key = spec.split(" | ")
        text = text.replace(f"\n{name} AS (", f"\n{name}({columns}) USING KEY ({key}) AS (")
    return text
