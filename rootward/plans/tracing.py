"""Queries over effects and tracing (D6, E9, E10, F), each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.functions.registry import registry
from rootward.operators import attribution as A
from rootward.operators import trace as T
from rootward.plans.fixture import SCORE, Graph, keyed, sql

QUERIES, ORACLES, query = registry(Graph)

#: Hops of all traces; threshold of the greedy ones and of those that look for paths and roots.
HOPS, THRESHOLD, PATH_THRESHOLD = 20, 0.1, 0.0001
#: What the oracle of a greedy trace needs; {score} ranks, {tier} comes before it.
BEST = "SELECT node, parent, score FROM (SELECT dst AS node, src AS parent, {score} AS score, row_number() OVER (PARTITION BY dst ORDER BY {tier}, {score} DESC, src) AS rn FROM effects {join}) WHERE rn = 1 AND score >= 0.1"
WALK = """SELECT target, target AS cur, [target] AS chain FROM targets UNION ALL
    SELECT w.target, b.parent, list_append(w.chain, b.parent) FROM walk w JOIN best b ON b.node = w.cur WHERE NOT list_contains(w.chain, b.parent) AND len(w.chain) <= 20"""
LAST = "SELECT target, chain, len(chain) - 1 AS depth, chain[len(chain)] AS root FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY len(chain) DESC) AS rn FROM walk) WHERE rn = 1"
GREEDY = {"best": BEST.format(score="abs(ce)", tier="0", join=""), "walk": WALK, "chains": LAST}
SHOWN = "SELECT target, array_to_string(chain, '|') AS chain, CAST(depth AS INTEGER) AS depth, root FROM chains"


def shown(chains: DataFrame) -> DataFrame:
    return chains.select("target", F.concat_ws("|", "chain").alias("chain"), "depth", "root")


def greedy(g: Graph) -> DataFrame:
    return T.trace_greedy(g.targets, g.effects, HOPS, THRESHOLD)


@query("f1_greedy", sql(SHOWN, **GREEDY))
def _(g: Graph) -> DataFrame:
    return shown(greedy(g))


@query("f2_greedy_signed", sql(SHOWN, **(GREEDY | {"best": BEST.format(score="ce", tier="0", join="")})))
def _(g: Graph) -> DataFrame:
    return shown(T.trace_greedy(g.targets, g.effects, HOPS, THRESHOLD, signed=True))


_TIER1 = "CASE WHEN abs(ce) >= 0.1 AND src LIKE 'w%' THEN 1 ELSE 3 END"


@query("f3_prefer_types", sql(SHOWN, **(GREEDY | {"best": BEST.format(score="abs(ce)", tier=_TIER1, join="")})))
def _(g: Graph) -> DataFrame:
    return shown(T.trace_greedy(g.targets, g.effects, HOPS, THRESHOLD, preferred=g.nodes.where("node_type = 'wallet'")))


#: Wallets of a high balance as the wanted kind, so that looking ahead makes a difference.
_RARE = "SELECT id FROM wallets WHERE c_acctbal > 9400"
_REACH = "SELECT id FROM rare UNION SELECT dst FROM effects WHERE src IN (SELECT id FROM rare) UNION SELECT dst FROM effects WHERE src IN (SELECT dst FROM effects WHERE src IN (SELECT id FROM rare))"
_TIER2 = "CASE WHEN abs(ce) >= 0.1 AND src IN (SELECT id FROM rare) THEN 1 WHEN abs(ce) >= 0.1 AND src IN (SELECT id FROM reach) THEN 2 ELSE 3 END"


def rare(g: Graph) -> DataFrame:
    return g.wallets.where("c_acctbal > 9400").select("id")


@query("d6_lookahead_reach", sql("SELECT id FROM reach", rare=_RARE, reach=_REACH))
def _(g: Graph) -> DataFrame:
    return T.reachable(g.effects, rare(g), 2)


@query("f4_lookahead", sql(SHOWN, rare=_RARE, reach=_REACH, **(GREEDY | {"best": BEST.format(score="abs(ce)", tier=_TIER2, join="")})))
def _(g: Graph) -> DataFrame:
    return shown(T.trace_greedy(g.targets, g.effects, HOPS, THRESHOLD, preferred=rare(g), ahead=T.reachable(g.effects, rare(g), 2)))


#: Scores of the caller for transactions (|phi|, tiers by balance); wallets go by |ce|, as the score does not speak of them.
_CUSTOM = {
    "targets": "SELECT id AS target FROM tx WHERE class = 1 UNION ALL SELECT id FROM wallets WHERE class = 1", "rare": _RARE,
    "scored": "SELECT dst AS node, src AS parent, abs(ce) / count(*) OVER (PARTITION BY dst) AS score, abs(ce) AS plain FROM effects",
    "best": """SELECT node, parent, TRUE AS own FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY CASE WHEN score >= 0.1 AND parent IN (SELECT id FROM rare) THEN 1 ELSE 3 END, score DESC, parent) AS rn FROM scored) WHERE rn = 1 AND score >= 0.1
        UNION ALL SELECT node, parent, FALSE FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY CASE WHEN plain >= 0.1 AND parent IN (SELECT id FROM rare) THEN 1 ELSE 3 END, plain DESC, parent) AS rn FROM scored) WHERE rn = 1 AND plain >= 0.1""",
    "walk": WALK.replace("b.node = w.cur", "b.node = w.cur AND b.own = (w.target LIKE 't%')"), "chains": LAST,
}


@query("f5_custom_ranking", sql(SHOWN, **_CUSTOM))
def _(g: Graph) -> DataFrame:
    # |phi| of each parent as the caller's score, the same for every flagged transaction that comes to the node.
    phi = A.phi_additive(g.causal, g.effects).select(F.col("target").alias("child"), "parent", F.abs("phi").alias("score"))
    every = g.targets.union(g.wallets.where("class = 1").select("id"))
    return shown(T.trace_by_type(every, g.nodes, "transaction", phi, g.effects, HOPS, THRESHOLD, preferred=rare(g)))


_STRONG = f"SELECT dst AS cur, src AS parent, abs(ce) AS w FROM effects WHERE abs(ce) >= {PATH_THRESHOLD}"
_LEAVES = "SELECT DISTINCT src AS id FROM effects WHERE src NOT IN (SELECT s.cur FROM strong s)"
#: The chain of each chosen end (target, cur), back along the pointers of a table with one row per target and node.
_BACK = """SELECT target, cur, [cur] AS chain FROM chosen UNION ALL
    SELECT b.target, p.via, list_prepend(p.via, b.chain) FROM back b JOIN {0} p ON p.target = b.target AND p.cur = b.cur WHERE p.via IS NOT NULL"""
_ENDED = "SELECT t.target, coalesce(chain, [t.target]) AS chain, coalesce(len(chain), 1) - 1 AS depth, coalesce(chain[len(chain)], t.target) AS root FROM targets t LEFT JOIN (SELECT * FROM back WHERE cur = target) e ON e.target = t.target"
_BESTPATH = {
    "strong": _STRONG,
    "paths": f"""SELECT target, target AS cur, CAST(NULL AS VARCHAR) AS via, CAST(0 AS DOUBLE) AS total, 0 AS hop FROM targets
        UNION SELECT n.target, n.cur, n.via, n.total, n.hop FROM (SELECT target, cur, arg_min(via, (total, via)) AS via, min(total) AS total, min(hop) AS hop FROM (
            SELECT p.target, e.parent AS cur, p.cur AS via, round(p.total - ln(e.w), 12) AS total, p.hop + 1 AS hop FROM paths p JOIN strong e ON e.cur = p.cur WHERE p.hop < {HOPS}) GROUP BY target, cur) n
        LEFT JOIN recurring.paths r ON r.target = n.target AND r.cur = n.cur WHERE r.total IS NULL OR n.total < r.total - 1e-12""",
    "leaves": _LEAVES,
    "chosen": "SELECT target, cur FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN cur IN (SELECT id FROM leaves) THEN 0 ELSE 2 END + CASE WHEN cur LIKE 'w%' THEN 0 ELSE 1 END, round(total, 9), cur) AS rn FROM paths WHERE cur <> target) WHERE rn = 1",
    "back": _BACK.format("paths"), "chains": _ENDED,
}
BESTPATH = keyed(sql(SHOWN, **_BESTPATH), paths="target, cur, via, total, hop | target, cur")


@query("f8_best_path", BESTPATH)
def _(g: Graph) -> DataFrame:
    return shown(T.trace_best_path(g.targets, g.effects, HOPS, PATH_THRESHOLD, preferred=g.wallets))


@query("f9_dijkstra", BESTPATH)
def _(g: Graph) -> DataFrame:
    return shown(T.trace(g.targets, g.effects, "dijkstra", max_hops=HOPS, threshold=PATH_THRESHOLD, preferred=g.wallets))


_SUMPATH = {
    "strong": _STRONG,
    "paths": f"""SELECT target, target AS cur, [target] AS chain, CAST(0 AS DOUBLE) AS total, 0 AS hop FROM targets
        UNION SELECT n.target, n.cur, n.chain, n.total, n.hop FROM (SELECT target, cur, arg_min(chain, (total, chain)) AS chain, min(total) AS total, min(hop) AS hop FROM (
            SELECT p.target, e.parent AS cur, list_append(p.chain, e.parent) AS chain, round(p.total - e.w, 9) AS total, p.hop + 1 AS hop FROM paths p JOIN strong e ON e.cur = p.cur WHERE p.hop < {HOPS} AND NOT list_contains(p.chain, e.parent)) GROUP BY target, cur) n
        LEFT JOIN recurring.paths r ON r.target = n.target AND r.cur = n.cur WHERE r.total IS NULL OR n.total < r.total - 1e-12""",
    "leaves": _LEAVES,
    "ends": "SELECT target, chain FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN cur IN (SELECT id FROM leaves) THEN 0 ELSE 2 END, total, cur, chain) AS rn FROM paths WHERE cur <> target) WHERE rn = 1",
    "chains": "SELECT t.target, coalesce(chain, [t.target]) AS chain, coalesce(len(chain), 1) - 1 AS depth, coalesce(chain[len(chain)], t.target) AS root FROM targets t LEFT JOIN ends e ON e.target = t.target",
}


@query("f8_best_path_sum", keyed(sql(SHOWN, **_SUMPATH), paths="target, cur, chain, total, hop | target, cur"))
def _(g: Graph) -> DataFrame:
    return shown(T.trace_best_path(g.targets, g.effects, HOPS, PATH_THRESHOLD, objective="sum"))


_BEAM = {
    "strong": _STRONG,
    "beams": f"""SELECT target, target AS cur, [target] AS chain, CAST(0 AS DOUBLE) AS score, CAST(1 AS BIGINT) AS rn, 0 AS hop FROM targets UNION ALL
        SELECT target, parent, chain, score, rn, hop FROM (SELECT b.target, e.parent, list_append(b.chain, e.parent) AS chain, round(b.score + e.w, 9) AS score, b.hop + 1 AS hop,
            row_number() OVER (PARTITION BY b.target ORDER BY round(b.score + e.w, 9) DESC, list_append(b.chain, e.parent)) AS rn
            FROM beams b JOIN strong e ON e.cur = b.cur WHERE NOT list_contains(b.chain, e.parent) AND b.hop < {HOPS}) WHERE rn <= {{k}}""",
    "complete": f"SELECT * FROM beams b WHERE hop = {HOPS} OR NOT EXISTS (SELECT 1 FROM strong e WHERE e.cur = b.cur AND NOT list_contains(b.chain, e.parent))",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, chain) AS rank FROM complete",
}


@query("f6_top_k_paths", sql("SELECT target, CAST(rank AS INTEGER) AS rank, array_to_string(chain, '|') AS chain, score FROM ranked WHERE rank <= 3", **(_BEAM | {"beams": _BEAM["beams"].format(k=3)})))
def _(g: Graph) -> DataFrame:
    found = T.trace_topk(g.targets, g.effects, 3, HOPS, PATH_THRESHOLD)
    return found.select("target", "rank", F.concat_ws("|", "chain").alias("chain"), "score")


@query("f7_beam", sql("SELECT target, array_to_string(chain, '|') AS chain, CAST(len(chain) - 1 AS INTEGER) AS depth, chain[len(chain)] AS root FROM ranked WHERE rank = 1", **(_BEAM | {"beams": _BEAM["beams"].format(k=3)})))
def _(g: Graph) -> DataFrame:
    return shown(T.trace(g.targets, g.effects, "beam", max_hops=HOPS, threshold=PATH_THRESHOLD))


_BFS = {
    "strong": _STRONG, "leaves": _LEAVES,
    "reached": f"""SELECT target, target AS cur, CAST(NULL AS VARCHAR) AS via, 0 AS hop FROM targets
        UNION SELECT n.target, n.cur, n.via, n.hop FROM (SELECT p.target, e.src AS cur, min(p.cur) AS via, min(p.hop) + 1 AS hop FROM reached p JOIN effects e ON e.dst = p.cur WHERE p.hop < {HOPS} GROUP BY p.target, e.src) n
        WHERE NOT EXISTS (SELECT 1 FROM recurring.reached r WHERE r.target = n.target AND r.cur = n.cur)""",
    "chosen": "SELECT target, cur FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN cur IN (SELECT id FROM leaves) THEN hop ELSE 1000 - hop END, cur) AS rn FROM reached WHERE hop > 0) WHERE rn = 1",
    "back": _BACK.format("reached"), "chains": _ENDED,
}


@query("f10_bfs", keyed(sql(SHOWN, **_BFS), reached="target, cur, via, hop | target, cur"))
def _(g: Graph) -> DataFrame:
    return shown(T.trace_bfs(g.targets, g.effects, HOPS, PATH_THRESHOLD))


_DFS = f"""SELECT target, target AS cur, [target] AS chain, CAST(1 AS BIGINT) AS k FROM targets UNION ALL
    SELECT target, parent, chain, k FROM (SELECT w.target, e.parent, list_append(w.chain, e.parent) AS chain, row_number() OVER (PARTITION BY w.target ORDER BY e.w DESC, e.parent) AS k
        FROM walk w JOIN strong e ON e.cur = w.cur WHERE NOT list_contains(w.chain, e.parent) AND len(w.chain) <= {HOPS}) WHERE k = 1"""


@query("f11_dfs", sql(SHOWN, strong=_STRONG, walk=_DFS, chains=LAST))
def _(g: Graph) -> DataFrame:
    return shown(T.trace_dfs(g.targets, g.effects, HOPS, PATH_THRESHOLD))


_PAIRS = "SELECT target, UNNEST(range(1, len(chain))) AS pos, chain FROM chains"
PAIRS = {"idx": _PAIRS, "pairs": "SELECT target, pos, chain[pos] AS child, chain[pos + 1] AS parent FROM idx"}


@query("f14_score_chain", sql("SELECT c.target, CAST(c.depth AS INTEGER) AS depth, round(coalesce(sum(abs(e.ce)), 0), 6) AS score FROM chains c LEFT JOIN pairs p ON p.target = c.target LEFT JOIN effects e ON e.src = p.parent AND e.dst = p.child GROUP BY c.target, c.depth", **GREEDY, **PAIRS))
def _(g: Graph) -> DataFrame:
    return T.score_chains(greedy(g), g.effects)


@query(
    "f15_trace_targets",
    sql(
        "SELECT id AS target, node_type, score FROM w ORDER BY node_type, num LIMIT 2000",
        w=f"SELECT *, {SCORE} AS score FROM nodes WHERE id IN (SELECT src FROM causal UNION SELECT dst FROM causal) AND {SCORE} > CASE WHEN node_type = 'wallet' THEN 0.85 ELSE 0.5 END",
    ),
)
def _(g: Graph) -> DataFrame:
    inside = g.causal.select(F.col("src").alias("id")).union(g.causal.select("dst")).distinct()
    return T.select_targets(g.nodes.withColumn("score", F.expr(SCORE)), inside, "transaction", {"wallet": 0.85}, 2000)


@query("e9_ce_distribution", sql("SELECT edge_type, count(*) AS n, round(avg(ce), 6) AS mean, round(stddev_pop(ce), 6) AS std, min(ce) AS min_ce, max(ce) AS max_ce, round(100.0 * count(*) FILTER (ce > 0.1) / count(*), 6) AS above FROM effects GROUP BY edge_type"))
def _(g: Graph) -> DataFrame:
    return g.effects.groupBy("edge_type").agg(
        F.count("*").alias("n"), F.round(F.avg("ce"), 6).alias("mean"), F.round(F.stddev_pop("ce"), 6).alias("std"),
        F.min("ce").alias("min_ce"), F.max("ce").alias("max_ce"), F.round(100.0 * F.sum(F.when(F.col("ce") > 0.1, 1).otherwise(0)) / F.count("*"), 6).alias("above"),
    )


@query("e10_hybrid_effect", sql("SELECT src, dst, round(abs(phi) * ce + ce, 9) AS ce FROM (SELECT *, ce / count(*) OVER (PARTITION BY dst) AS phi FROM effects)"))
def _(g: Graph) -> DataFrame:
    phi = A.phi_additive(g.causal, g.effects).select(F.col("parent").alias("src"), F.col("target").alias("dst"), "phi")
    return A.hybrid_effect(g.effects, phi).select("src", "dst", F.round("ce", 9).alias("ce"))
