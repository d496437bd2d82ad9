"""Queries over node and edge preparation (B, C), each with its oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.functions.registry import registry
from rootward.operators import edges as E
from rootward.operators import nodes as N
from rootward.plans.fixture import SCORE, Graph, keyed, sql

QUERIES, ORACLES, query = registry(Graph)


@query("b1_clean_labels", sql("SELECT node_type, id, y, labelled FROM nodes"))
def _(g: Graph) -> DataFrame:
    found = N.clean_labels(g.nodes.select("node_type", "id"), g.tx.select("id", "class").union(g.wallets.select("id", "class")))
    return found.select("node_type", "id", "y", "labelled")


@query("b2_raw_labels", sql("SELECT node_type, id, y FROM nodes"))
def _(g: Graph) -> DataFrame:
    return N.raw_labels(g.nodes.select("node_type", "id"), g.tx.select("id", "class").union(g.wallets.select("id", "class")))


_ORDER = "(num * 2654435761 + 42 * 40503) % 2147483648"
_SPLIT = f"""SELECT node_type, id, y, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_ORDER}, id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM nodes WHERE labelled AND node_type = 'transaction')"""


def split(g: Graph) -> DataFrame:
    return N.stratified_split(g.nodes.where("node_type = 'transaction'"))


@query("b3_stratified_split", sql(_SPLIT))
def _(g: Graph) -> DataFrame:
    return split(g).select("node_type", "id", "y", "split")


@query("b4_split_counts", sql("SELECT split, y, count(*) AS n FROM s GROUP BY split, y", s=_SPLIT))
def _(g: Graph) -> DataFrame:
    return N.split_counts(split(g))


def snapshots(g: Graph) -> DataFrame:
    """Cumulative order count and amount of a wallet at each of its time steps."""
    steps = g.tx.groupBy("o_custkey", "time").agg(F.count("*").alias("k"), F.sum("amount").alias("a"))
    upto = "OVER (PARTITION BY o_custkey ORDER BY time)"
    return steps.selectExpr("concat('w', o_custkey) AS id", "o_custkey", "time", f"sum(k) {upto} AS n_orders", f"round(sum(a) {upto}, 2) AS amount", f"1000 * min(time) {upto} AS first_received_block", "1000 * time + o_custkey % 997 AS last_block")


SNAPSHOTS = """SELECT 'w' || o_custkey AS id, o_custkey, time, CAST(sum(k) OVER w AS BIGINT) AS n_orders, round(sum(a) OVER w, 2) AS amount,
    1000 * min(time) OVER w AS first_received_block, 1000 * time + o_custkey % 997 AS last_block
    FROM (SELECT o_custkey, time, count(*) AS k, sum(amount) AS a FROM tx GROUP BY ALL) WINDOW w AS (PARTITION BY o_custkey ORDER BY time)"""
LATEST = "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time DESC) AS rn FROM snapshots) WHERE rn = 1"


@query("b5_latest_snapshot", sql("SELECT id, time, n_orders, first_received_block, last_block FROM latest", snapshots=SNAPSHOTS, latest=LATEST))
def _(g: Graph) -> DataFrame:
    return N.latest_snapshot(snapshots(g), "id", "time", "n_orders").select("id", "time", "n_orders", "first_received_block", "last_block")


@query("b6_connected_wallets", sql("SELECT src AS id FROM addr_tx UNION SELECT dst FROM tx_addr UNION SELECT src FROM addr_addr UNION SELECT dst FROM addr_addr"))
def _(g: Graph) -> DataFrame:
    t = g.tables
    return N.connected(t["addr_tx"], t["tx_addr"], t["addr_addr"])


@query("b7_standardise", sql("SELECT id, round((amount - avg(amount) OVER ()) / stddev_pop(amount) OVER (), 4) AS amount, round((time - avg(time) OVER ()) / stddev_pop(time) OVER (), 4) AS time FROM tx"))
def _(g: Graph) -> DataFrame:
    z = N.standardise(g.tx.select("id", "amount", F.col("time").cast("double").alias("time")), ["amount", "time"])
    return z.select("id", F.round("amount", 4).alias("amount"), F.round("time", 4).alias("time"))


@query("b8_tx_time", sql("SELECT id, CASE WHEN time >= 0 THEN time END AS time FROM tx"))
def _(g: Graph) -> DataFrame:
    return N.tx_time(g.tx)


@query("b9_funding_time", sql("SELECT id, time FROM funded"))
def _(g: Graph) -> DataFrame:
    return N.funding_time(g.tables["tx_addr"], g.tx)


_LAB = "SELECT id FROM tx WHERE class IN (1, 2)"


_KEPT = "SELECT id FROM lab UNION SELECT dst FROM tx_tx WHERE src IN (SELECT id FROM lab) UNION SELECT src FROM tx_tx WHERE dst IN (SELECT id FROM lab)"


@query("b10_labelled_neighbourhood", sql("SELECT id FROM kept", lab=_LAB, kept=_KEPT))
def _(g: Graph) -> DataFrame:
    return N.labelled_neighbourhood(g.nodes.where("node_type = 'transaction'"), g.tables["tx_tx"])


@query(
    "b10_restricted_tables",
    sql(
        "SELECT 'addr_tx' AS name, src, dst FROM addr_tx WHERE dst IN (SELECT id FROM kept) UNION ALL SELECT 'tx_addr', src, dst FROM tx_addr WHERE src IN (SELECT id FROM kept) UNION ALL SELECT 'tx_tx', src, dst FROM tx_tx WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept) UNION ALL SELECT 'addr_addr', src, dst FROM addr_addr",
        lab=_LAB, kept=_KEPT,
    ),
)
def _(g: Graph) -> DataFrame:
    kept = N.labelled_neighbourhood(g.nodes.where("node_type = 'transaction'"), g.tables["tx_tx"])
    parts = [t.select(F.lit(name).alias("name"), "src", "dst") for name, t in N.restricted_tables(g.tables, kept).items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "b11_seed_wallet_subgraph",
    sql(
        "SELECT id, min(hop) AS hop FROM (SELECT id, 1 AS hop FROM one UNION ALL SELECT id, 2 FROM two UNION ALL SELECT id, 3 FROM three) GROUP BY id",
        linked="SELECT src, dst FROM addr_addr UNION ALL SELECT dst, src FROM addr_addr",
        one="SELECT src AS id FROM addr_tx JOIN tx ON tx.id = dst WHERE class = 1 UNION SELECT dst FROM tx_addr JOIN tx ON tx.id = src WHERE class = 1",
        two="SELECT DISTINCT dst AS id FROM linked JOIN one ON one.id = src",
        three="SELECT DISTINCT dst AS id FROM linked JOIN two ON two.id = src",
    ),
)
def _(g: Graph) -> DataFrame:
    t = g.tables
    illicit = g.nodes.where("node_type = 'transaction'").withColumn("labelled", F.col("class") == 1)
    return N.wallet_subgraph(t["addr_tx"], t["tx_addr"], t["addr_addr"], illicit, hops=3)


@query("b12_global_ids", sql("SELECT node_type, id, row_number() OVER (ORDER BY node_type, num) - 1 AS global_id FROM nodes"))
def _(g: Graph) -> DataFrame:
    return N.global_ids(g.nodes)


@query("b12_decode_ids", sql("SELECT k AS global_id, node_type, id FROM (SELECT row_number() OVER (ORDER BY node_type, num) - 1 AS k, node_type, id FROM nodes)"))
def _(g: Graph) -> DataFrame:
    ids = N.global_ids(g.nodes)
    return N.decode_ids(ids.select("global_id"), ids)


@query("b13_node_timestamps", sql("SELECT node_type, id, time FROM nodes WHERE time >= 0"))
def _(g: Graph) -> DataFrame:
    return N.node_times(g.nodes)


@query(
    "b14_dataset_stats",
    sql(
        "SELECT scope, class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY scope), 6) AS percent FROM every GROUP BY scope, class",
        joined="SELECT src AS id FROM addr_tx UNION SELECT dst FROM tx_addr",
        every="SELECT 'transaction' AS scope, class FROM tx UNION ALL SELECT 'wallet', class FROM wallets UNION ALL SELECT 'connected', class FROM wallets WHERE id IN (SELECT id FROM joined) UNION ALL SELECT 'joint', class FROM nodes",
    ),
)
def _(g: Graph) -> DataFrame:
    t = g.tables
    linked = g.wallets.join(N.connected(t["addr_tx"], t["tx_addr"]), "id", "left_semi")
    return N.dataset_stats({"transaction": g.tx, "wallet": g.wallets, "connected": linked, "joint": g.nodes})


@query("b15_class_weight", sql("SELECT CAST(sum(1 - y) AS BIGINT) AS neg, CAST(sum(y) AS BIGINT) AS pos, round(sum(1 - y) / sum(y), 6) AS weight FROM s WHERE split = 'train'", s=_SPLIT))
def _(g: Graph) -> DataFrame:
    return N.class_weights(split(g).where("split = 'train'"))


_MAX = 5000


@query(
    "b16_subsample_graph",
    sql(
        "SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)",
        pos="SELECT id FROM nodes WHERE node_type = 'transaction' AND y = 1",
        neg=f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {_ORDER}, id) AS rn FROM nodes WHERE node_type = 'transaction' AND y = 0) WHERE rn <= {_MAX} - (SELECT count(*) FROM pos)",
        kept="SELECT id FROM pos UNION ALL SELECT id FROM neg",
        ids="SELECT id FROM kept UNION SELECT n.id FROM nodes n WHERE node_type <> 'transaction' AND (n.id IN (SELECT dst FROM edges WHERE src IN (SELECT id FROM kept)) OR n.id IN (SELECT src FROM edges WHERE dst IN (SELECT id FROM kept)))",
    ),
)
def _(g: Graph) -> DataFrame:
    return N.subsample_graph(g.nodes, g.edges, "transaction", _MAX)[1].select("src", "dst", "edge_type")


@query(
    "b17_proportional_sample",
    sql(
        "SELECT node_type, id FROM (SELECT n.*, row_number() OVER (PARTITION BY n.node_type ORDER BY num) AS rn, take FROM nodes n JOIN shares s ON s.node_type = n.node_type) WHERE rn <= take",
        counts="SELECT node_type, count(*) AS n, sum(count(*)) OVER () AS total FROM nodes GROUP BY node_type",
        base="SELECT *, least(n, 1000 * n // total) AS t, row_number() OVER (ORDER BY n DESC, node_type) AS rn FROM counts",
        shares="SELECT node_type, t + least(n - t, greatest(0, least(1000, total) - (SELECT sum(t) FROM base) - coalesce(sum(n - t) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM base",
    ),
)
def _(g: Graph) -> DataFrame:
    return N.proportional_sample(g.nodes, 1000).select("node_type", "id")


@query("c1_build_edges", sql("SELECT * FROM edges"))
def _(g: Graph) -> DataFrame:
    return g.edges


@query("c2_causal_edges", sql("SELECT src, dst, edge_type FROM causal"))
def _(g: Graph) -> DataFrame:
    return g.causal


@query(
    "c2_causal_audit",
    sql(
        "SELECT count(*) FILTER (edge_type = 'wallet__to__wallet') AS blocked, count(*) FILTER (edge_type <> 'wallet__to__wallet' AND coalesce(src_time > dst_time, FALSE)) AS rejected, count(*) FILTER (edge_type <> 'wallet__to__wallet' AND NOT coalesce(src_time > dst_time, FALSE)) AS kept FROM timed"
    ),
)
def _(g: Graph) -> DataFrame:
    return E.causal_audit(g.edges, g.nodes)


@query("c3_edge_type_filter", sql("SELECT src, dst, edge_type FROM edges WHERE edge_type IN ('transaction__to__wallet', 'wallet__to__transaction')"))
def _(g: Graph) -> DataFrame:
    return E.edge_type_filter(g.edges, keep=("transaction__to__wallet", "wallet__to__transaction")).select("src", "dst", "edge_type")


@query(
    "c4_parents_children_sources",
    sql("SELECT n.id, coalesce(p.k, 0) AS n_parents, coalesce(c.k, 0) AS n_children, p.k IS NULL AS is_source FROM nodes n LEFT JOIN (SELECT dst, count(DISTINCT src) AS k FROM causal GROUP BY dst) p ON p.dst = n.id LEFT JOIN (SELECT src, count(DISTINCT dst) AS k FROM causal GROUP BY src) c ON c.src = n.id"),
)
def _(g: Graph) -> DataFrame:
    free = E.sources(g.nodes, g.causal).withColumn("_free", F.lit(True))
    every = g.nodes.select("id").join(E.parents(g.causal), "id", "left").join(E.children(g.causal), "id", "left").join(free, "id", "left")
    return every.select("id", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("_free", F.lit(False)).alias("is_source"))


#: Levels by taking off nodes without parents: rows of a round are those that it touches, `recurring` holds all.
LEVELS = """SELECT n.id, coalesce(k, 0) AS rest, CASE WHEN coalesce(k, 0) = 0 THEN 0 END AS level FROM nodes n LEFT JOIN (SELECT dst, count(*) AS k FROM causal GROUP BY dst) d ON d.dst = n.id
    UNION SELECT r.id, r.rest - t.k, CASE WHEN r.rest = t.k THEN t.level + 1 END FROM (SELECT c.dst, count(*) AS k, max(l.level) AS level FROM levels l JOIN causal c ON c.src = l.id WHERE l.rest = 0 GROUP BY c.dst) t JOIN recurring.levels r ON r.id = t.dst"""


@query("c5_topological_level", keyed(sql("SELECT id, CAST(level AS INTEGER) AS level FROM levels", levels=LEVELS), levels="id, rest, level | id"))
def _(g: Graph) -> DataFrame:
    return E.topological_levels(g.nodes, g.causal)


@query(
    "c6_edge_direction",
    sql(
        "SELECT CASE WHEN ab THEN a WHEN ba THEN b WHEN pos_a > pos_b THEN a ELSE b END AS src, CASE WHEN ab THEN b WHEN ba THEN a WHEN pos_a > pos_b THEN b ELSE a END AS dst FROM dirs",
        pairs="SELECT a.id AS a, CAST(a.num % 7 AS INTEGER) AS pos_a, 'w' || ((a.num * 3) % nc) AS b, CAST(a.num % 5 AS INTEGER) AS pos_b FROM tx a, nc UNION SELECT dst, 0, src, 1 FROM tx_tx",
        known="SELECT DISTINCT src, dst FROM edges",
        dirs="SELECT p.*, k1.src IS NOT NULL AS ab, k2.src IS NOT NULL AS ba FROM pairs p LEFT JOIN known k1 ON k1.src = a AND k1.dst = b LEFT JOIN known k2 ON k2.src = b AND k2.dst = a",
    ),
)
def _(g: Graph) -> DataFrame:
    made = g.tx.select(F.col("id").alias("a"), (F.col("num") % 7).cast("int").alias("pos_a"), F.concat(F.lit("w"), F.col("num") * 3 % g.n_customers).alias("b"), (F.col("num") % 5).cast("int").alias("pos_b"))
    flows = g.tables["tx_tx"].select(F.col("dst").alias("a"), F.lit(0).alias("pos_a"), F.col("src").alias("b"), F.lit(1).alias("pos_b"))
    return E.edge_direction(made.union(flows).distinct(), g.edges)


@query(
    "c7_negative_edges",
    sql(
        "SELECT src, dst, 1 AS label FROM tx_addr UNION ALL SELECT x.id, y.id, 0 FROM (SELECT (a.i * 7919 + b.i * 104729 + 42 * 40503) % (SELECT count(*) FROM a) AS p, (a.i * 15485863 + b.i * 32452843 + 42 * 40503) % (SELECT count(*) FROM b) AS q FROM tx_addr e JOIN a ON a.id = e.src JOIN b ON b.id = e.dst) d JOIN a x ON x.i = d.p JOIN b y ON y.i = d.q",
        a="SELECT id, row_number() OVER (ORDER BY num) - 1 AS i FROM tx", b="SELECT id, row_number() OVER (ORDER BY num) - 1 AS i FROM wallets",
    ),
)
def _(g: Graph) -> DataFrame:
    return E.negative_edges(g.tables["tx_addr"], g.tx, g.wallets)


INDEGREE = "SELECT n.id, n.node_type, coalesce(k, 0) AS indegree FROM nodes n LEFT JOIN (SELECT dst, count(*) AS k FROM edges WHERE rel IN ('sends', 'pays') GROUP BY dst) d ON d.dst = n.id"


@query("c8_indegree_thresholds", sql("SELECT node_type, quantile_cont(indegree, 0.95) AS threshold, sum(indegree)::BIGINT AS total FROM indeg GROUP BY node_type", indeg=INDEGREE))
def _(g: Graph) -> DataFrame:
    degrees = E.indegree(g.nodes, g.tables)
    return E.indegree_thresholds(degrees).join(degrees.groupBy("node_type").agg(F.sum("indegree").alias("total")), "node_type")


SCORES = f"SELECT node_type, id, y, {SCORE} AS score FROM nodes WHERE labelled"
