"""Chain nodes of the greedy traces and their shares of responsibility, for scoring and analytics, with the SQL of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.functions.tables import written
from rootward.operators import attribution as A
from rootward.operators import chains as K
from rootward.plans.fixture import Graph
from rootward.plans.tracing import GREEDY, greedy

CN = {
    "cn0": "SELECT target, depth, UNNEST(chain) AS id, UNNEST(range(0, len(chain))) AS pos FROM chains",
    "cn": """SELECT c.target, CAST(c.pos AS INTEGER) AS pos, CAST(c.depth AS INTEGER) AS depth, c.id, n.node_type, n.time, n.class = 1 AS fraud, e.ce
        FROM (SELECT *, lag(id) OVER (PARTITION BY target ORDER BY pos) AS child FROM cn0) c JOIN nodes n ON n.id = c.id LEFT JOIN effects e ON e.src = c.id AND e.dst = c.child""",
}
BASE = GREEDY | CN

PHI = "SELECT dst AS target, src AS parent, ce / count(*) OVER (PARTITION BY dst) AS phi FROM effects"
ASYM = """SELECT target, parent, (v - coalesce(lag(v) OVER (PARTITION BY target ORDER BY position), 0.5)) / count(*) OVER (PARTITION BY target) AS phi FROM (
    SELECT dst AS target, src AS parent, row_number() OVER w AS position, 1 / (1 + exp(-sum(ce) OVER w)) AS v FROM effects e JOIN nodes n ON n.id = e.src WINDOW w AS (PARTITION BY dst ORDER BY n.time NULLS LAST, src ROWS UNBOUNDED PRECEDING))"""
ATTACHED = BASE | {
    "phi": PHI, "asym": ASYM,
    "lagged": "SELECT *, lag(id) OVER w AS c1, lag(node_type) OVER w AS t1, lag(id, 2) OVER w AS c2, lag(node_type, 2) OVER w AS t2 FROM cn WINDOW w AS (PARTITION BY target ORDER BY pos)",
    "attached": "SELECT l.target, l.pos, l.depth, l.id, l.node_type, l.time, l.fraud, l.ce, CASE WHEN pos > 0 THEN coalesce(p.phi, 0) END AS phi_add, CASE WHEN pos > 0 AND (t1 = 'transaction' OR t2 = 'transaction') THEN coalesce(a.phi, 0) END AS phi_asym FROM lagged l LEFT JOIN phi p ON p.target = c1 AND p.parent = l.id LEFT JOIN asym a ON a.target = CASE WHEN t1 = 'transaction' THEN c1 WHEN t2 = 'transaction' THEN c2 END AND a.parent = l.id",
}
#: The node of the largest |phi_asym| of each chain, the first among equals.
PIVOTS = "SELECT target, id AS pivot, pos, node_type FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(abs(phi_asym), 12) DESC, pos) AS rn FROM attached WHERE abs(phi_asym) > 0) WHERE rn = 1"


def asymmetric(g: Graph, own: DataFrame | None = None) -> DataFrame:
    """Known times order causes before effects, so they stand for the level here. own: edges with effects, if not all."""
    own = g.effects if own is None else own
    return A.phi_asymmetric(A.logistic_prefixes(own, own, g.nodes.select("id", F.col("time").alias("level"))))


def chain_nodes(g: Graph, chains: DataFrame | None = None) -> DataFrame:
    return written(K.chain_nodes(greedy(g) if chains is None else chains, g.nodes, g.effects), "chain-nodes")


def attached(cn: DataFrame, g: Graph) -> DataFrame:
    """cn with phi_add and phi_asym."""
    return A.attach_phi(cn, A.phi_additive(g.causal, g.effects), asymmetric(g), "transaction")
