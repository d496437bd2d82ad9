"""Queries over sources and sinks (A): tables are written to the shared folder and read again."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.functions.registry import registry
from rootward.functions.tables import shared_dir
from rootward.operators import chains as K
from rootward.plans.analytics import _REC, Traced
from rootward.plans.fixture import Graph, sql
from rootward.plans.shares import ATTACHED, BASE
from rootward.sources import tables as S

QUERIES, ORACLES, query = registry(lambda spark, sf_dir: Traced(Graph(spark, sf_dir)))
_graph, _graph_oracles, graph_query = registry(Graph)


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_files(g: Graph) -> str:
    """The fixture as a graph directory of CSV files."""
    path = folder(g.spark, "graph")
    t = g.tables
    tables = {
        "txs_features": g.tx.select(F.col("id").alias("txId"), F.col("time").alias(" Time step "), F.col("amount").alias("Local_feature_1"), F.col("num").alias("Aggregate_feature_1"), F.col("amount").alias("fees")),
        "txs_classes": g.tx.select(F.col("id").alias("txId"), "class"), "txs_edgelist": t["tx_tx"].toDF("txId1", "txId2"),
        "wallets_features": g.wallets.select(F.col("id").alias("address"), "c_acctbal"), "wallets_classes": g.wallets.select(F.col("id").alias("address"), "class"),
        "AddrTx_edgelist": t["addr_tx"].toDF("input_address", "txId"), "TxAddr_edgelist": t["tx_addr"].toDF("txId", "output_address"), "AddrAddr_edgelist": t["addr_addr"].toDF("input_address", "output_address"),
    }
    for name, df in tables.items():
        df.write.csv(f"{path}/{name}.csv", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@graph_query("a1_load_graph_tables", sql("SELECT 'txs' AS name, id AS a, CAST(time AS VARCHAR) AS b FROM tx UNION ALL SELECT 'classes', id, CAST(class AS VARCHAR) FROM wallets UNION ALL SELECT 'sends', src, dst FROM addr_tx UNION ALL SELECT 'pays', src, dst FROM tx_addr UNION ALL SELECT 'flows', src, dst FROM tx_tx UNION ALL SELECT 'links', src, dst FROM addr_addr"))
def _(g: Graph) -> DataFrame:
    t = S.load_graph_tables(g.spark, as_files(g))
    parts = {"txs": "txs_features", "classes": "wallets_classes", "sends": "AddrTx_edgelist", "pays": "TxAddr_edgelist", "flows": "txs_edgelist", "links": "AddrAddr_edgelist"}
    return reduce(DataFrame.union, [t[file].select(F.lit(name).alias("name"), *[F.col(c).alias(x) for c, x in zip(t[file].columns[:2], "ab")]) for name, file in parts.items()])


@graph_query("a2_feature_columns", sql("SELECT id, round(amount, 2) AS local_feature, round(amount, 2) AS fees FROM tx"))
def _(g: Graph) -> DataFrame:
    df = S.load_graph_tables(g.spark, as_files(g))["txs_features"]
    kept = S.feature_columns(df, "transaction")
    return df.select(F.col("txId").alias("id"), *[F.round(F.col(c).cast("double"), 2).alias("local_feature" if S.is_anonymous(c) else c) for c in kept])


@query("a3_read_chains_json", sql("SELECT target, pos, id, node_type, fraud, ce, round(phi_asym, 9) + 0.0 AS phi_asym FROM attached", **ATTACHED))
def _(t: Traced) -> DataFrame:
    path = folder(t.g.spark, "chains-json")
    S.write_chains_json(t.records, path)
    rows = S.read_chains_json(t.g.spark, path).select("target", F.explode("nodes").alias("n"))
    return rows.select("target", "n.pos", "n.id", "n.node_type", "n.fraud", "n.ce", (F.round("n.phi_asym", 9) + 0.0).alias("phi_asym"))


@query("a3_read_chains_document", sql("SELECT target, pos, id, node_type, fraud, ce FROM cn", **BASE))
def _(t: Traced) -> DataFrame:
    """Documents of the chains of one depth and few targets each, one per line."""
    path = folder(t.g.spark, "chain-documents")
    few = F.pmod(F.xxhash64("target_txid"), F.lit(64))
    documents = S._as_stored(t.records).groupBy("depth", few).agg(F.struct(F.lit("graph").alias("dataset"), F.count("*").alias("n_chains")).alias("meta"), F.collect_list(F.struct(*S.HEAD_FIELDS, "nodes")).alias("chains"))
    documents.select("meta", "chains").write.json(path)
    rows = S.read_chains_document(t.g.spark, path, multi_line=False).select("target", F.explode("nodes").alias("n"))
    return rows.select("target", "n.pos", "n.id", "n.node_type", "n.fraud", "n.ce")


@query("a4_read_chains_csv", sql("SELECT target, pos, id, node_type, pos IN (0, depth) AND CASE WHEN pos = 0 THEN id IN (SELECT id FROM tx WHERE class = 1) ELSE fraud END AS fraud, round(ce, 3) AS ce, (SELECT count(DISTINCT id) FROM cn) - 1 AS last_id FROM cn", **BASE))
def _(t: Traced) -> DataFrame:
    path = folder(t.g.spark, "chains-csv")
    S.write_chains_csv(K.chains_to_rows(t.records), path)
    rows = S.read_chains_csv(t.g.spark, path).withColumn("ce", F.round("ce", 3))
    return rows.drop("global_id").join(rows.agg(F.max("global_id").alias("last_id")), F.lit(True))  # one row


@query("a5_write_chains_json", sql("SELECT 'fixture' AS dataset, count(*) AS n_chains, count(*) AS n_true_positive, count(*) FILTER (root_is_fraud) AS n_fraud_root, round(avg(depth), 2) AS mean_depth FROM rec", **BASE, rec=_REC))
def _(t: Traced) -> DataFrame:
    path = folder(t.g.spark, "chains-json")
    S.write_chains_json(t.records, path, "fixture")
    return t.g.spark.read.json(f"{path}/meta").select(*S.META_FIELDS)


_DAG = "SELECT n.id, node_type AS type, time, node_type || '#' || (row_number() OVER (PARTITION BY node_type ORDER BY num) - 1) AS label, class = 1 AS fraud, class = 1 AND node_type = 'transaction' AS is_seed FROM nodes n"
_INSIDE = "SELECT * FROM dag WHERE id IN (SELECT src FROM causal UNION SELECT dst FROM causal)"


def exported(g: Graph) -> str:
    path = folder(g.spark, "dag")
    S.write_dag_export(g.nodes, g.causal, g.tx.where("class = 1").select("id"), path)
    return path


@graph_query("a7_write_dag_export", sql("SELECT 'node' AS part, id AS a, type AS b, label AS c, time, fraud, is_seed FROM inside UNION ALL SELECT 'link', src, dst, edge_type, NULL, NULL, NULL FROM causal", dag=_DAG, inside=_INSIDE))
def _(g: Graph) -> DataFrame:
    """Nodes and links as read back from the files."""
    path = exported(g)
    nodes = g.spark.read.schema("id string, type string, time int, label string, fraud boolean, is_seed boolean").json(f"{path}/nodes")
    links = g.spark.read.schema("source string, target string, etype string").json(f"{path}/links")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("time", "int"), ("fraud", "boolean"), ("is_seed", "boolean"))]
    return nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("type").alias("b"), F.col("label").alias("c"), "time", "fraud", "is_seed").unionByName(
        links.select(F.lit("link").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("etype").alias("c"), *none)
    )


@graph_query("a7_dag_meta", sql("SELECT count(*) AS n_nodes, (SELECT count(*) FROM causal) AS n_links, count(*) FILTER (fraud) AS n_fraud, count(*) FILTER (is_seed) AS n_seed, count(*) FILTER (time >= 0) AS n_timed, min(time) AS time_min, max(time) AS time_max, count(*) FILTER (type = 'transaction') AS transactions, count(*) FILTER (type = 'wallet') AS wallets FROM inside", dag=_DAG, inside=_INSIDE))
def _(g: Graph) -> DataFrame:
    schema = "n_nodes long, n_links long, n_fraud long, n_seed long, n_timed long, time_min int, time_max int, node_types map<string, long>"
    meta = g.spark.read.schema(schema).json(f"{exported(g)}/meta")
    return meta.select("*", F.col("node_types")["transaction"].alias("transactions"), F.col("node_types")["wallet"].alias("wallets")).drop("node_types")


def logs(g: Graph) -> str:
    """A run log per nation, from figures of its customers' orders."""
    path = folder(g.spark, "logs")
    customers = g.table("customer").select("c_custkey", "c_nationkey")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    rows = g.tx.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        share(F.col("class") == 1).alias("urgent"), share(F.col("class") == 2).alias("usual"), share(F.col("amount") > 150000).alias("large"), F.count("*").alias("n"), F.round(F.avg("time"), 4).alias("time")
    )
    number = lambda c: F.format_string("%.4f", c)
    lines = [
        F.lit("== run =="), F.concat(F.lit("  · wallet      fraud_f1="), number("urgent"), F.lit("  pred_rate="), number("usual"), F.lit("  thr=0.310")), F.concat(F.lit("  · transaction fraud_f1="), number("large"), F.lit("  pred_rate="), number("urgent"), F.lit("  thr=0.500")),
        F.concat(F.lit("Headline F1-score (fraud class) = "), number("usual")), F.concat(F.lit("  Root Cause Precision True Pos            : "), number("large")), F.concat(F.lit("  Root Cause Precision                     : "), number("urgent")),
        F.concat(F.lit("  Mean Tracing Depth                       : "), number("time")), F.lit("[Metric C — GT = strict]"), F.concat(F.lit("  Explanation Accuracy                     : "), number("usual")),
        F.concat(F.lit("  Explanation Recall                       : "), number("urgent")), F.lit("[Metric C — GT = extended]"), F.concat(F.lit("  Explanation Accuracy                     : "), number("large")),
        F.concat(F.lit("WALLCLOCK_SECONDS="), F.col("n").cast("string")), F.lit("no label: 1.5"),
    ]
    rows.select(F.concat(F.lit("eval_nation"), F.col("c_nationkey").cast("string")).alias("run"), F.concat_ws("\n", *lines).alias("value")).repartition("run").write.partitionBy("run").text(path)
    return path


_LOG = "SELECT c_nationkey AS k, round(avg(CASE WHEN class = 1 THEN 1.0 ELSE 0.0 END), 4) AS urgent, round(avg(CASE WHEN class = 2 THEN 1.0 ELSE 0.0 END), 4) AS usual, round(avg(CASE WHEN amount > 150000 THEN 1.0 ELSE 0.0 END), 4) AS large, CAST(count(*) AS DOUBLE) AS n, round(avg(time), 4) AS time FROM tx JOIN customer ON c_custkey = o_custkey GROUP BY 1"
_LONG = [(None, "wallet_F1", "urgent"), (None, "wallet_rate", "usual"), (None, "wallet_thr", "0.31"), (None, "transaction_F1", "large"), (None, "transaction_rate", "urgent"), (None, "transaction_thr", "0.5"), (None, "pooled", "usual"), (None, "RCP_TP", "large"), (None, "RCP", "urgent"), (None, "MTD", "time"), (None, "sec", "n"), ("strict", "EA", "usual"), ("strict", "ER", "urgent"), ("extended", "EA", "large")]


@graph_query("a8_read_run_metrics", sql("SELECT block, metric, count(*) AS n, round(sum(value), 3) AS total FROM (" + " UNION ALL ".join(f"SELECT {'NULL' if b is None else repr(b)} AS block, '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM l" for b, m, v in _LONG) + ") GROUP BY block, metric", l=_LOG))
def _(g: Graph) -> DataFrame:
    return S.read_run_metrics(g.spark, logs(g)).groupBy("block", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@graph_query("a9_run_summary", sql("SELECT urgent AS wallet_f1, usual AS pooled, large AS rcp_tp, time AS mtd, n AS sec, usual AS ea_strict, urgent AS er_strict, large AS ea_extended, CAST(NULL AS DOUBLE) AS er_extended FROM l", l=_LOG))
def _(g: Graph) -> DataFrame:
    wide = S.run_summary(S.read_run_metrics(g.spark, logs(g)), ["wallet_F1", "pooled", "RCP_TP", "MTD", "sec"], ["strict", "extended"])
    return wide.select(*[F.col(c).alias(c.lower()) for c in ("wallet_F1", "pooled", "RCP_TP", "MTD", "sec", "EA_strict", "ER_strict", "EA_extended", "ER_extended")])


QUERIES |= _graph
ORACLES |= _graph_oracles
