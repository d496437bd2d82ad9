"""Queries over chain records, chain analytics and typology (K, L, D7, A6), each with its oracle."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.functions.registry import registry
from rootward.functions.tables import written
from rootward.operators import attribution as A
from rootward.operators import chains as K
from rootward.operators import edges as E
from rootward.operators import nodes as N
from rootward.operators import typology as L
from rootward.plans.fixture import Graph, sql
from rootward.plans.preparation import INDEGREE, LATEST, SNAPSHOTS, snapshots
from rootward.plans.shares import ATTACHED, BASE, PIVOTS, attached
from rootward.plans.tracing import greedy

class Traced:
    """The chains of all targets and their exploded form, without and with shares."""

    def __init__(self, g: Graph):
        self.g, self.chains = g, written(greedy(g), "chains")
        self.cn = written(K.chain_nodes(self.chains, g.nodes, g.effects), "chain-nodes")

    @cached_property
    def phi_cn(self) -> DataFrame:
        return written(attached(self.cn, self.g), "chain-shares")

    @property
    def records(self) -> DataFrame:
        return K.chain_records(self.phi_cn, self.g.tx.where("class = 1"))

    @cached_property
    def heads(self) -> DataFrame:
        """target, depth, root, root_is_fraud, is_true_positive of each chain."""
        fraud = self.g.nodes.where("class = 1").select("id")
        flags = self.chains.join(fraud.toDF("root").withColumn("_f", F.lit(True)), "root", "left").join(fraud.toDF("target").withColumn("_t", F.lit(True)), "target", "left")
        return flags.select("target", "depth", "root", F.coalesce("_f", F.lit(False)).alias("root_is_fraud"), F.coalesce("_t", F.lit(False)).alias("is_true_positive"))

    @property
    def pivots(self) -> DataFrame:
        return A.chain_pivot(self.phi_cn.withColumn("phi_asym", F.round("phi_asym", 12)))

    @property
    def picked(self) -> DataFrame:
        """The chains with an illicit root."""
        return self.heads.where("root_is_fraud").select("target")


QUERIES, ORACLES, query = registry(lambda spark, sf_dir: Traced(Graph(spark, sf_dir)))
#: The chains that a view is asked for.
PICKED = {"picked": "SELECT target FROM chains JOIN nodes n ON n.id = root WHERE n.class = 1", "own": "SELECT DISTINCT id FROM cn WHERE target IN (SELECT target FROM picked)"}


@query("k1_chain_records", sql("SELECT target, pos, depth, id, node_type, time, fraud, ce, round(phi_add, 9) + 0.0 AS phi_add, round(phi_asym, 9) + 0.0 AS phi_asym FROM attached", **ATTACHED))
def _(t: Traced) -> DataFrame:
    rows = t.records.select("target", "depth", F.explode("nodes").alias("n")).select("target", "depth", "n.pos", "n.id", "n.node_type", "n.time", "n.fraud", "n.ce", "n.phi_add", "n.phi_asym")
    return rows.withColumns({c: F.round(c, 9) + 0.0 for c in ("phi_add", "phi_asym")})


_REC = "SELECT c.target, CAST(c.depth AS INTEGER) AS depth, c.root, n.node_type AS root_type, n.class = 1 AS root_is_fraud FROM chains c JOIN nodes n ON n.id = c.root"


@query("k2_rank_chains", sql("SELECT target, depth, root FROM rec ORDER BY root_is_fraud DESC, depth DESC, target LIMIT 100", **BASE, rec=_REC))
def _(t: Traced) -> DataFrame:
    return K.rank_chains(t.records, 100).select("target", "depth", "root")


_LINKS = "SELECT parent, child, count(*) AS multiplicity, any_value(ce) AS ce FROM (SELECT id AS parent, lag(id) OVER (PARTITION BY target ORDER BY pos) AS child, ce FROM cn) WHERE child IS NOT NULL GROUP BY parent, child"


@query("k3_merged_nodes", sql("SELECT c.id, bool_or(pos = 0) AS is_target, bool_or(pos = depth) AS is_root, any_value(node_type) AS node_type, any_value(time) AS time, bool_or(fraud) AS fraud, round(coalesce(max(abs(phi_asym)), 0), 9) AS phi_asym, CAST(coalesce(any_value(d.k), 0) AS BIGINT) AS degree FROM attached c LEFT JOIN (SELECT id, sum(multiplicity) AS k FROM (SELECT parent AS id, multiplicity FROM links UNION ALL SELECT child, multiplicity FROM links) GROUP BY id) d ON d.id = c.id GROUP BY c.id", **ATTACHED, links=_LINKS))
def _(t: Traced) -> DataFrame:
    return K.merged_nodes(t.phi_cn).withColumn("phi_asym", F.round("phi_asym", 9))


@query("k4_merged_links", sql("SELECT parent, child, ce, multiplicity FROM links", **BASE, links=_LINKS))
def _(t: Traced) -> DataFrame:
    return K.merged_links(t.cn)


@query("k5_time_bounds", sql("SELECT coalesce(min(time), 0) AS min_time, coalesce(max(time), 0) AS max_time FROM cn WHERE time >= 0", **BASE))
def _(t: Traced) -> DataFrame:
    return K.time_bounds(t.cn)


@query("k6_top_roots", sql("SELECT c.root, n, CAST(rank AS INTEGER) AS rank, target FROM chains c JOIN (SELECT root, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, root) AS rank FROM chains GROUP BY root HAVING count(*) >= 2) r ON r.root = c.root WHERE rank <= 15", **BASE))
def _(t: Traced) -> DataFrame:
    return K.top_roots(t.chains)


@query(
    "k7_chain_stats",
    sql(
        "SELECT count(*) AS n, count(p.node_type) AS n_phi, round(count(*) FILTER (p.node_type = 'wallet') / count(p.node_type), 6) AS pivot_wallet, round(count(*) FILTER (p.pos >= 2) / count(p.node_type), 6) AS pivot_far, round(count(*) FILTER (r.root_type = 'wallet') / count(*), 6) AS root_wallet, round(avg(depth), 6) AS mean_depth, (SELECT max(k) FROM (SELECT count(*) AS k FROM chains GROUP BY root)) AS max_fan_in FROM rec r LEFT JOIN pivots p ON p.target = r.target",
        **ATTACHED, rec=_REC, pivots=PIVOTS,
    ),
)
def _(t: Traced) -> DataFrame:
    return K.chain_stats(t.chains, t.g.nodes, t.pivots)


@query("k8_chain_search", sql("SELECT target, root, root_type FROM rec WHERE root_is_fraud AND (contains(lower(target), '12') OR contains(lower(root), '12') OR contains(root_type, '12')) AND target IN (SELECT target FROM attached WHERE phi_asym IS NOT NULL)", **ATTACHED, rec=_REC))
def _(t: Traced) -> DataFrame:
    return K.search_chains(t.records, "12", fraud_only=True, only_phi=True).select("target", "root", "root_type")


@query("k8_phi_coverage", sql("SELECT count(*) AS n, count(*) FILTER (p) AS n_phi, CAST(round(100.0 * count(*) FILTER (p) / count(*)) AS INTEGER) AS percent FROM (SELECT target, bool_or(phi_asym IS NOT NULL) AS p FROM attached GROUP BY target)", **ATTACHED))
def _(t: Traced) -> DataFrame:
    return K.phi_coverage(t.records)


_EVERY = "SELECT src, dst, 0 AS r, 'wallet' AS st, 'transaction' AS dt FROM addr_tx UNION ALL SELECT src, dst, 1, 'transaction', 'wallet' FROM tx_addr UNION ALL SELECT src, dst, 2, 'transaction', 'transaction' FROM tx_tx UNION ALL SELECT src, dst, 3, 'wallet', 'wallet' FROM addr_addr WHERE src <> dst"
_NEAR = "SELECT src AS id, dst AS near, dt AS type, r FROM every UNION ALL SELECT dst, src, st, r FROM every"
_CAP = 250
_SEEN = BASE | PICKED | {
    "links": _LINKS,
    "around": "SELECT child AS id FROM links WHERE parent IN (SELECT id FROM own) AND child NOT IN (SELECT id FROM own) UNION SELECT parent FROM links WHERE child IN (SELECT id FROM own) AND parent NOT IN (SELECT id FROM own)",
    "seen": f"SELECT id, FALSE AS boundary FROM own UNION ALL SELECT id, TRUE FROM (SELECT id FROM around ORDER BY id LIMIT {_CAP})",
    "own_links": "SELECT DISTINCT parent, child FROM (SELECT id AS parent, lag(id) OVER (PARTITION BY target ORDER BY pos) AS child FROM cn WHERE target IN (SELECT target FROM picked)) WHERE child IS NOT NULL",
}


@query("k9_visible_subgraph", sql(f"SELECT s.id, n.node_type, boundary, (SELECT count(*) FROM around) > {_CAP} AS truncated FROM seen s JOIN nodes n ON n.id = s.id", **_SEEN))
def _(t: Traced) -> DataFrame:
    return K.visible_subgraph(t.cn, t.picked, _CAP)[0]


@query(
    "k9_visible_links",
    sql(
        "SELECT 'around' AS view, l.parent, l.child, l.ce FROM links l JOIN seen a ON a.id = l.parent JOIN seen b ON b.id = l.child WHERE NOT (a.boundary AND b.boundary) UNION ALL SELECT 'wallets', l.parent, l.child, l.ce FROM links l WHERE parent LIKE 'w%' AND child LIKE 'w%' AND (parent, child) IN (SELECT (parent, child) FROM own_links) UNION ALL SELECT 'all', parent, child, ce FROM links",
        **_SEEN,
    ),
)
def _(t: Traced) -> DataFrame:
    views = {
        "around": K.visible_subgraph(t.cn, t.picked, _CAP), "wallets": K.visible_subgraph(t.cn, t.picked, types=("wallet",), neighbours=False),
        "all": K.visible_subgraph(t.cn, t.picked, everything=True),
    }
    return reduce(DataFrame.unionByName, [links.select(F.lit(name).alias("view"), "parent", "child", "ce") for name, (_, links) in views.items()])


_VIEW = BASE | PICKED | {
    "every": _EVERY, "nears": _NEAR,
    "listed": "SELECT id AS of, near, type FROM (SELECT id, near, type, row_number() OVER (PARTITION BY id ORDER BY r, near) AS rn FROM (SELECT id, near, type, min(r) AS r FROM nears WHERE id IN (SELECT id FROM own) GROUP BY id, near, type)) WHERE rn <= 30 AND near NOT IN (SELECT id FROM own)",
}


@query("k10_neighbour_view", sql("SELECT n.id, node_type, TRUE AS in_chain FROM own JOIN nodes n ON n.id = own.id UNION ALL SELECT DISTINCT near, type, FALSE FROM listed", **_VIEW))
def _(t: Traced) -> DataFrame:
    return K.neighbour_view(t.cn, t.picked, K.neighbour_overlay(K.chain_sets(t.cn, t.picked)[0], t.g.tables))[0]


@query("k10_view_links", sql("SELECT 'wallets' AS view, of AS a, near AS b FROM listed WHERE of LIKE 'w%' AND type = 'wallet' UNION ALL SELECT 'wallets', parent, child FROM own_links WHERE parent LIKE 'w%' AND child LIKE 'w%' UNION ALL SELECT 'union', l.parent, l.child FROM links l JOIN seen a ON a.id = l.parent JOIN seen b ON b.id = l.child WHERE NOT (a.boundary AND b.boundary)", **(_VIEW | _SEEN)))
def _(t: Traced) -> DataFrame:
    """Wallets only, and the view without an overlay."""
    overlay = K.neighbour_overlay(K.chain_sets(t.cn, t.picked)[0], t.g.tables)
    wallets, union = K.neighbour_view(t.cn, t.picked, overlay, ("wallet",))[1], K.neighbour_view(t.cn, t.picked, None, cap=_CAP)[1]
    return wallets.select(F.lit("wallets").alias("view"), "a", "b").unionByName(union.select(F.lit("union").alias("view"), "a", "b"))


@query("k11_responsibility_rows", sql("SELECT c.target, depth - c.pos AS step, id, c.node_type, c.time, round(phi_asym, 9) + 0.0 AS phi_asym, c.pos = depth AS is_root, c.pos = 0 AS is_target, coalesce(p.pivot = c.id, FALSE) AS is_pivot, ce FROM attached c LEFT JOIN pivots p ON p.target = c.target AND p.pivot = c.id", **ATTACHED, pivots=PIVOTS))
def _(t: Traced) -> DataFrame:
    return K.responsibility(t.phi_cn, t.pivots).withColumn("phi_asym", F.round("phi_asym", 9) + 0.0)


@query("k12_chain_sets", sql("SELECT id AS a, CAST(NULL AS VARCHAR) AS b FROM own UNION ALL SELECT parent, child FROM own_links", **_SEEN))
def _(t: Traced) -> DataFrame:
    """Node ids (b null) and links of the chosen chains."""
    ids, links = K.chain_sets(t.cn, t.picked)
    return ids.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).union(links)


@query("k13_depth_buckets", sql("SELECT substr(root, 1, 1) AS variant, CAST(least(depth, 10) AS INTEGER) AS bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY substr(root, 1, 1)), 6) AS percent FROM chains GROUP BY 1, 2", **BASE))
def _(t: Traced) -> DataFrame:
    return K.depth_buckets(t.chains, F.substring("root", 1, 1))


_BY_TIME = "SELECT c.*, CASE WHEN n.time <= 20 THEN 'early' ELSE 'late' END AS variant FROM chains c JOIN nodes n ON n.id = c.target"


@query("k13_variant_stats", sql("SELECT variant, count(*) AS n, round(avg(depth), 6) AS mean_depth, count(*) FILTER (root LIKE 'w%') AS wallet_roots, count(*) FILTER (root LIKE 't%') AS transaction_roots FROM v GROUP BY variant", **BASE, v=_BY_TIME))
def _(t: Traced) -> DataFrame:
    timed = t.chains.join(t.g.nodes.select(F.col("id").alias("target"), "time"), "target")
    return K.variant_stats(timed, F.when(F.col("time") <= 20, "early").otherwise("late"), t.g.nodes)


_OVERLAY = BASE | {
    "every": _EVERY, "nears": _NEAR, "distinct_near": "SELECT id, near, type, min(r) AS r FROM nears WHERE id IN (SELECT id FROM cn) GROUP BY id, near, type",
    "overlay": "SELECT o.id, degree, n_near, near FROM (SELECT id, count(*) AS degree FROM nears WHERE id IN (SELECT id FROM cn) GROUP BY id) o JOIN (SELECT id, count(*) AS n_near FROM distinct_near GROUP BY id) k ON k.id = o.id JOIN (SELECT id, string_agg(near || ':' || type, '|' ORDER BY rn) AS near FROM (SELECT id, near, type, row_number() OVER (PARTITION BY id ORDER BY r, near) AS rn FROM distinct_near) WHERE rn <= 30 GROUP BY id) l ON l.id = o.id",
}


@query("d7_chain_neighbour_overlay", sql("SELECT * FROM overlay", **_OVERLAY))
def _(t: Traced) -> DataFrame:
    near = F.concat_ws("|", F.transform("near", lambda x: F.concat(x["id"], F.lit(":"), x["node_type"])))
    return K.neighbour_overlay(t.cn.select("id"), t.g.tables).select("id", "degree", "n_near", near.alias("near"))


@query("d7_overlay_meta", sql("SELECT (SELECT count(DISTINCT id) FROM cn) AS n_nodes, count(*) AS n_with_neighbours, CAST(sum(least(n_near, 30)) AS BIGINT) AS n_listed, count(*) FILTER (n_near > 30) AS n_truncated FROM overlay", **_OVERLAY))
def _(t: Traced) -> DataFrame:
    ids = t.cn.select("id")
    return K.overlay_meta(ids, K.neighbour_overlay(ids, t.g.tables))


_ROWS = "SELECT target AS target_txid, CAST(max(depth) AS INTEGER) AS depth, CAST(count(*) AS INTEGER) AS n_nodes, arg_max(node_type, pos) AS root_type, arg_max(id, pos) AS root_real_id, arg_max(fraud, pos) AS root_is_fraud, bool_or(pos = 0 AND id IN (SELECT id FROM nodes WHERE class = 1)) AS is_true_positive, string_agg(id, '|' ORDER BY pos) AS chain_real_ids, string_agg(node_type, '|' ORDER BY pos) AS chain_types, string_agg(CASE WHEN pos = 0 THEN '' ELSE printf('%g', ce) END, '|' ORDER BY pos) AS chain_ce, string_agg(CASE WHEN pos = 0 OR {0} IS NULL THEN '' ELSE 'x' END, '|' ORDER BY pos) AS phi_shape FROM attached GROUP BY target"


@query("a6_write_chains_csv", sql(_ROWS.format("phi_asym"), **ATTACHED))
def _(t: Traced) -> DataFrame:
    """All columns; of the shares, which cells are filled (their digits are tested by themselves)."""
    return K.chains_to_rows(t.records).withColumn("phi_shape", F.regexp_replace("chain_phi_asym", r"[^|]+", "x")).drop("chain_phi_add", "chain_phi_asym")


@query("l1_alternation", sql("SELECT target, coalesce(bool_and(d), TRUE) AS alternates FROM (SELECT target, node_type <> lag(node_type) OVER (PARTITION BY target ORDER BY pos DESC) AS d FROM cn) GROUP BY target", **BASE))
def _(t: Traced) -> DataFrame:
    return L.alternation(t.cn)


_MONO = "SELECT c.target, count(*) FILTER (time >= 0) AS n_known, count(*) FILTER (time IS NULL OR time < 0) AS n_unknown, any_value(m.monotone) AS monotone FROM cn c LEFT JOIN (SELECT target, bool_and(up) AS monotone FROM (SELECT target, time >= lag(time) OVER (PARTITION BY target ORDER BY pos DESC) AS up FROM cn WHERE time >= 0) GROUP BY target) m ON m.target = c.target GROUP BY c.target"


@query("l2_time_monotone", sql("SELECT * FROM mono", **BASE, mono=_MONO))
def _(t: Traced) -> DataFrame:
    return L.time_monotone(t.cn)


AMOUNTS = "SELECT target, pos, c.id, amount, row_number() OVER (PARTITION BY target ORDER BY pos DESC) AS seq FROM cn c LEFT JOIN tx ON tx.id = c.id WHERE node_type = 'transaction'"


@query("l3_amount_sequence", sql("SELECT target, id, amount, CAST(seq AS INTEGER) AS seq FROM amounts", **BASE, amounts=AMOUNTS))
def _(t: Traced) -> DataFrame:
    return L.amounts(t.cn, t.g.tx).select("target", "id", "amount", "seq")


TREND = """SELECT target, CASE WHEN count(*) >= 3 AND stddev_pop(y) > 0 THEN corr(x, y) END AS rho, avg(d) AS decreasing, count(*) AS n_amounts FROM (
    SELECT target, CAST(seq AS DOUBLE) AS x, rank() OVER (PARTITION BY target ORDER BY amount) + (count(*) OVER (PARTITION BY target, amount) - 1) / 2.0 AS y,
    CASE WHEN amount < lag(amount) OVER (PARTITION BY target ORDER BY pos DESC) THEN 1.0 WHEN lag(amount) OVER (PARTITION BY target ORDER BY pos DESC) IS NOT NULL THEN 0.0 END AS d FROM amounts WHERE amount IS NOT NULL) GROUP BY target"""


@query("l4_amount_trend", sql("SELECT target, round(rho, 6) + 0.0 AS rho, round(decreasing, 6) AS decreasing, n_amounts FROM trend", **BASE, amounts=AMOUNTS, trend=TREND))
def _(t: Traced) -> DataFrame:
    return L.amount_trend(L.amounts(t.cn, t.g.tx)).select("target", (F.round("rho", 6) + 0.0).alias("rho"), F.round("decreasing", 6).alias("decreasing"), "n_amounts")


_ALT = "SELECT target, coalesce(bool_and(d), TRUE) AS alternates FROM (SELECT target, node_type <> lag(node_type) OVER (PARTITION BY target ORDER BY pos DESC) AS d FROM cn) GROUP BY target"
PEEL = """SELECT target, fit AS peel_struct, fit AND low AS peel_rho, fit AND falls AS peel_share, fit AND (low OR falls) AS peel_hit, round(greatest(-coalesce(rho, 0), 0, coalesce(decreasing, 0)), 6) + 0.0 AS peel_strength FROM (
    SELECT c.target, depth >= 4 AND alternates AND coalesce(monotone, FALSE) AS fit, coalesce(round(rho, 9) < -0.5, FALSE) AS low, coalesce(round(decreasing, 9) > 0.7, FALSE) AS falls, rho, decreasing
    FROM chains c JOIN alt a ON a.target = c.target JOIN mono m ON m.target = c.target LEFT JOIN trend r ON r.target = c.target)"""
PEELED = BASE | {"amounts": AMOUNTS, "trend": TREND, "alt": _ALT, "mono": _MONO, "peel": PEEL}


@query("l5_peeling", sql("SELECT * FROM peel", **PEELED))
def _(t: Traced) -> DataFrame:
    return L.scan_peeling(t.chains, t.cn, t.g.tx)


_FEEDS = "SELECT dst, f.time FROM addr_tx JOIN funded f ON f.id = src UNION ALL SELECT dst, tx.time FROM tx_addr JOIN tx ON tx.id = src"
UP = "SELECT dst AS id, count(*) AS n_times, min(time) AS min_time, max(time) AS max_time FROM ({0}) WHERE dst IN (SELECT id FROM cn) GROUP BY dst"


def upstream(t: Traced, **more: bool) -> DataFrame:
    return L.upstream_times(t.cn.select("id"), t.g.tables, t.g.tx, N.funding_time(t.g.tables["tx_addr"], t.g.tx), **more)


@query("l6_upstream_times", sql("SELECT * FROM up", **BASE, up=UP.format(_FEEDS)))
def _(t: Traced) -> DataFrame:
    return upstream(t)


@query("l6_upstream_times_all", sql("SELECT * FROM up", **BASE, up=UP.format(_FEEDS + " UNION ALL SELECT dst, tx.time FROM tx_tx JOIN tx ON tx.id = src UNION ALL SELECT dst, f.time FROM addr_addr JOIN funded f ON f.id = src")))
def _(t: Traced) -> DataFrame:
    return upstream(t, tx_tx=True, addr_addr=True)


FANIN = """SELECT target, bool_or(hit) AS fanin_hit, count(*) FILTER (hit) AS fanin_hubs, arg_min(id, place) FILTER (hub) AS fanin_node, arg_min(indegree, place) FILTER (hub) AS fanin_degree, arg_min(coalesce(n_times, 0), place) FILTER (hub) AS fanin_times, arg_min(struct_pack(v := spread), place) FILTER (hub) AS best FROM (
    SELECT *, (CASE WHEN hit THEN 0 ELSE 1 END, CASE WHEN hit THEN -CAST(indegree AS DOUBLE) ELSE -indegree / threshold END, id) AS place FROM (
    SELECT DISTINCT c.target, c.id, i.indegree, threshold, n_times, max_time - min_time AS spread, threshold > 0 AND i.indegree >= threshold AS hub, coalesce(threshold > 0 AND i.indegree >= threshold AND n_times >= 2 AND max_time - min_time <= 3, FALSE) AS hit FROM cn c JOIN indeg i ON i.id = c.id
    JOIN (SELECT node_type, quantile_cont(indegree, 0.95) AS threshold FROM indeg GROUP BY node_type) q ON q.node_type = i.node_type LEFT JOIN up u ON u.id = c.id)) GROUP BY target"""
FANNED = {"indeg": INDEGREE, "up": UP.format(_FEEDS), "fanin": FANIN}


def fanin(t: Traced) -> DataFrame:
    degrees = written(E.indegree(t.g.nodes, t.g.tables), "indegrees")  # for the thresholds and for the chains
    return L.scan_fanin(t.cn, degrees, E.indegree_thresholds(degrees), upstream(t))


@query("l7_fan_in", sql("SELECT target, fanin_hit, fanin_hubs, fanin_node, fanin_degree, fanin_times, best.v AS fanin_range FROM fanin", **BASE, **FANNED))
def _(t: Traced) -> DataFrame:
    return fanin(t)


GAPS = {"snapshots": SNAPSHOTS, "latest": LATEST, "gaps": "SELECT id, last_block - first_received_block AS gap FROM latest"}


def latest(t: Traced) -> DataFrame:
    return N.latest_snapshot(snapshots(t.g), "id", "time", "n_orders")


@query("l8_lifespan_gap", sql("SELECT * FROM gaps", **GAPS))
def _(t: Traced) -> DataFrame:
    return L.lifespan_gap(latest(t))


PASS = GAPS | {
    "cutoff": "SELECT quantile_cont(gap, 0.25) AS q FROM gaps WHERE id IN (SELECT id FROM wallets WHERE class = 1)",
    "passing": "SELECT c.target, count(g.id) > 0 AS pass_hit, count(g.id) AS n_pass, coalesce(string_agg(g.id, ';' ORDER BY g.id), '') AS pass_ids FROM (SELECT DISTINCT target, id, node_type FROM cn) c LEFT JOIN (SELECT id FROM gaps, cutoff WHERE gap < q) g ON g.id = c.id AND c.node_type = 'wallet' GROUP BY c.target",
}


def passing(t: Traced) -> DataFrame:
    gaps = written(L.lifespan_gap(latest(t)), "gaps")  # for the cut and for the chains
    cut = gaps.join(t.g.wallets.where("class = 1").select("id"), "id", "left_semi").agg(F.percentile("gap", F.lit(0.25))).first()[0]
    return L.scan_passthrough(t.cn, gaps, cut)


@query("l9_pass_through", sql("SELECT * FROM passing", **BASE, **PASS))
def _(t: Traced) -> DataFrame:
    return passing(t)


SCAN = PEELED | FANNED | PASS | {"scan": "SELECT c.target, CAST(c.depth AS INTEGER) AS depth, c.root, n.class = 1 AS root_is_fraud, c.target IN (SELECT id FROM tx WHERE class = 1) AS is_true_positive, peel_struct, peel_rho, peel_share, peel_hit, peel_strength, fanin_hit, pass_hit, round(c.depth * peel_strength * CAST(peel_hit AS INTEGER), 6) + 0.0 AS peel_score FROM chains c JOIN nodes n ON n.id = c.root JOIN peel p ON p.target = c.target JOIN fanin f ON f.target = c.target JOIN passing s ON s.target = c.target"}


def scan(t: Traced) -> DataFrame:
    return written(L.scan_table(t.heads, L.scan_peeling(t.chains, t.cn, t.g.tx), fanin(t), passing(t)), "scan")


@query("l10_scan_table", sql("SELECT * FROM scan", **SCAN))
def _(t: Traced) -> DataFrame:
    return scan(t)


@query("l11_signature_summary", sql(" UNION ALL ".join(f"SELECT '{n}' AS signature, count(*) FILTER ({c}) AS n, round(100.0 * count(*) FILTER ({c}) / count(*), 6) AS percent, count(*) FILTER ({c} AND is_true_positive) AS n_true, round(100.0 * count(*) FILTER ({c} AND is_true_positive) / count(*) FILTER (is_true_positive), 6) AS percent_true FROM scan" for n, c in L.SIGNATURES.items()), **SCAN))
def _(t: Traced) -> DataFrame:
    return L.signature_summary(scan(t))


@query("l12_signature_overlap", sql("SELECT a.b AS peel_hit, x.b AS fanin_hit, y.b AS pass_hit, (SELECT count(*) FROM scan s WHERE s.peel_hit = a.b AND s.fanin_hit = x.b AND s.pass_hit = y.b) AS n FROM flags a, flags x, flags y", **SCAN, flags="SELECT TRUE AS b UNION ALL SELECT FALSE"))
def _(t: Traced) -> DataFrame:
    return L.signature_overlap(scan(t))


@query("l13_top_peeling", sql("SELECT target, depth, peel_score FROM scan WHERE peel_hit ORDER BY is_true_positive DESC, peel_score DESC, target LIMIT 20", **SCAN))
def _(t: Traced) -> DataFrame:
    return L.top_peeling(scan(t), 20).select("target", "depth", "peel_score")


@query("l14_hop_detail", sql("SELECT target, pos, c.id, node_type, c.time, fraud, ce, amount, gap FROM cn c LEFT JOIN tx ON tx.id = c.id LEFT JOIN gaps g ON g.id = c.id", **BASE, **GAPS))
def _(t: Traced) -> DataFrame:
    return L.hop_detail(t.cn, t.g.tx, L.lifespan_gap(latest(t)))


@query("l15_wallet_profile", sql(" UNION ALL ".join(f"SELECT {end} AS id, '{relation}' AS relation, {'dst' if end == 'src' else 'src'} AS other FROM {name} WHERE {end} IN (SELECT id FROM cn WHERE node_type = 'wallet')" for relation, name, end in L.PROFILE), **BASE))
def _(t: Traced) -> DataFrame:
    return L.wallet_profile(t.cn.where("node_type = 'wallet'").select("id"), t.g.tables)


#: Pairs of chains with wallets as roots: the first chain of each node beside all others there, and
#: chains whose targets' numbers are near each other.
WINDOW = 50
_NUMBER = "CAST(substr({0}, 2) AS BIGINT)"
_PAIRS = f"""SELECT DISTINCT f.a, c.target AS b FROM cn c JOIN (SELECT id, min(target) AS a FROM cn WHERE target IN (SELECT target FROM chains WHERE root LIKE 'w%') GROUP BY id) f ON f.id = c.id
    WHERE c.target <> f.a AND c.target IN (SELECT target FROM chains WHERE root LIKE 'w%')
    UNION SELECT x.target, y.target FROM chains x JOIN chains y ON {_NUMBER.format('y.target')} > {_NUMBER.format('x.target')} AND {_NUMBER.format('y.target')} <= {_NUMBER.format('x.target')} + {WINDOW} WHERE x.root LIKE 'w%' AND y.root LIKE 'w%'"""


def pairs(t: Traced) -> DataFrame:
    rooted = t.chains.where("root LIKE 'w%'").select("target")
    meeting = L.meeting_pairs(t.cn.join(rooted, "target", "left_semi"))
    return written(meeting.union(L.near_pairs(rooted, F.expr(_NUMBER.format("target")), WINDOW)).distinct(), "chain-pairs")


_LINKED = BASE | {
    "pr": _PAIRS, "w": "SELECT DISTINCT target, id FROM cn WHERE node_type = 'wallet'", "rooted": "SELECT a, b, x.root AS ra, y.root AS rb FROM pr JOIN chains x ON x.target = a JOIN chains y ON y.target = b",
    "near": "SELECT src AS k, dst AS x FROM addr_addr UNION SELECT dst, src FROM addr_addr", "inputs": "SELECT DISTINCT c.target, s.src AS x FROM cn c JOIN addr_tx s ON s.dst = c.id WHERE c.node_type = 'transaction'",
}
_SHARED = "(SELECT count(*) FROM (SELECT DISTINCT {1} FROM {0} WHERE {2} = ra) p JOIN (SELECT DISTINCT {1} FROM {0} WHERE {2} = rb) q USING ({1}))"


@query(
    "l16_pair_links",
    sql(
        f"""SELECT a, b, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM addr_addr WHERE (src = ra AND dst = rb) OR (src = rb AND dst = ra))) AS direct_links,
        {_SHARED.format("near", "x", "k")} AS shared_neighbours, {_SHARED.format("addr_tx", "dst", "src")} AS co_spent, {_SHARED.format("tx_addr", "src", "dst")} AS shared_funders,
        (SELECT count(*) FROM inputs p JOIN inputs q ON q.x = p.x WHERE p.target = a AND q.target = b AND p.x <> ra AND p.x <> rb) AS shared_inputs,
        (SELECT count(*) FROM w p JOIN w q ON p.id = q.id WHERE p.target = a AND q.target = b) AS shared_wallets,
        (SELECT count(*) FROM (SELECT DISTINCT l.src, l.dst FROM addr_addr l WHERE (l.src IN (SELECT id FROM w WHERE target = a) AND l.dst IN (SELECT id FROM w WHERE target = b)) OR (l.src IN (SELECT id FROM w WHERE target = b) AND l.dst IN (SELECT id FROM w WHERE target = a)))) AS cross_links FROM rooted""",
        **_LINKED,
    ),
)
def _(t: Traced) -> DataFrame:
    return L.pair_links(pairs(t), t.cn, t.g.tables)


@query("l17_block_window", sql("SELECT target, min(first_received_block) FILTER (first_received_block <> 0) AS first_block, max(last_block) AS last_block, count(*) FILTER (first_received_block = 0) AS n_never FROM (SELECT DISTINCT target, id FROM cn WHERE node_type = 'wallet') c JOIN latest l ON l.id = c.id GROUP BY target", **BASE, **GAPS))
def _(t: Traced) -> DataFrame:
    return L.block_window(t.cn, latest(t))


@query("l18_pair_distance", sql("SELECT a, b, min(abs(x.k - y.k)) AS min_distance, any_value(p.t) AS a_times, any_value(q.t) AS b_times FROM pr JOIN ks x ON x.target = a JOIN ks y ON y.target = b JOIN ts p ON p.target = a JOIN ts q ON q.target = b GROUP BY a, b", **BASE, pr=_PAIRS, ks="SELECT DISTINCT target, CAST(substr(id, 2) AS BIGINT) AS k FROM cn WHERE node_type = 'transaction'", ts="SELECT target, string_agg(time, '|' ORDER BY time) AS t FROM (SELECT DISTINCT target, time FROM cn WHERE time >= 0) GROUP BY target"))
def _(t: Traced) -> DataFrame:
    found = L.pair_distance(pairs(t), t.cn, F.expr("CAST(substr(id, 2) AS BIGINT)"))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in ("a_times", "b_times")})


_FEATURES = ["c_acctbal", "n_orders", "amount", "first_received_block", "last_block"]
_ROOT_ROWS = {
    **GAPS, "rows": "SELECT w.id, w.num, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in _FEATURES) + " FROM wallets w LEFT JOIN latest l ON l.id = w.id",
    "vec": "SELECT id, row_number() OVER (ORDER BY num) - 1 AS i, [" + ", ".join(_FEATURES) + "] AS v FROM rows",
    "drawn": "SELECT (range * 7919 + 42 * 13) % (SELECT count(*) FROM vec) AS i, (range * 104729 + 42 * 7) % (SELECT count(*) FROM vec) AS j FROM range(2000)",
    "base": "SELECT list_cosine_similarity(x.v, y.v) AS c FROM drawn d JOIN vec x ON x.i = d.i JOIN vec y ON y.i = d.j WHERE d.i <> d.j AND list_sum(list_transform(x.v, lambda e: e * e)) > 0 AND list_sum(list_transform(y.v, lambda e: e * e)) > 0",
    "known": "SELECT quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.95) AS p95, count(*) AS n FROM base",
    "observed": "SELECT DISTINCT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS cosine, " + " || ".join(f"CASE WHEN x.v[{i + 1}] <> y.v[{i + 1}] THEN '{c}|' ELSE '' END" for i, c in enumerate(_FEATURES)) + " AS differing FROM pr JOIN chains p ON p.target = pr.a JOIN chains q ON q.target = pr.b JOIN vec x ON x.id = p.root JOIN vec y ON y.id = q.root WHERE p.root <> q.root",
}


@query("l19_root_cosine", sql("SELECT a, b, round(cosine, 5) AS cosine, round(100.0 * (SELECT count(*) FROM base WHERE round(c, 9) < round(o.cosine, 9)) / n, 1) AS percentile, differing, round(median, 5) AS median, round(p95, 5) AS p95 FROM observed o, known", **BASE, pr=_PAIRS, **_ROOT_ROWS))
def _(t: Traced) -> DataFrame:
    """Different roots of pairs of chains, by the features of their latest snapshots."""
    roots = pairs(t).join(t.chains.select(F.col("target").alias("a"), F.col("root").alias("ra")), "a").join(t.chains.select(F.col("target").alias("b"), F.col("root").alias("rb")), "b")
    roots = roots.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    rows = t.g.wallets.join(latest(t).select("id", *_FEATURES[1:]), "id", "left").select("id", "num", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _FEATURES])
    found = L.cosine_baseline(roots, rows, _FEATURES)
    listed = F.when(F.size("differing") > 0, F.concat(F.array_join("differing", "|"), F.lit("|"))).otherwise("")
    return found.select("a", "b", F.round("cosine", 5).alias("cosine"), F.round("percentile", 1).alias("percentile"), listed.alias("differing"), F.round("median", 5).alias("median"), F.round("p95", 5).alias("p95"))


@query("l20_phi_summary", sql("SELECT target, round(sum(abs(phi_asym)), 9) AS phi_total, arg_max(id, (round(abs(phi_asym), 12), pos)) AS top_node, round(arg_max(phi_asym, (round(abs(phi_asym), 12), pos)), 9) + 0.0 AS top_phi, round(max(abs(phi_asym)) / coalesce(nullif(sum(abs(phi_asym)), 0), 1), 6) AS top_share FROM attached WHERE phi_asym IS NOT NULL GROUP BY target", **ATTACHED))
def _(t: Traced) -> DataFrame:
    found = L.phi_summary(t.phi_cn)
    return found.select("target", F.round("phi_total", 9).alias("phi_total"), "top_node", (F.round("top_phi", 9) + 0.0).alias("top_phi"), F.round("top_share", 6).alias("top_share"))


DOSSIER = "SELECT target, seq, amount, lag(amount) OVER w - amount AS fall, amount / lag(amount) OVER w AS ratio FROM amounts WHERE amount IS NOT NULL WINDOW w AS (PARTITION BY target ORDER BY pos DESC)"
CVS = "SELECT target, CASE WHEN count(fall) >= 2 AND avg(fall) > 0 THEN stddev_pop(fall) / avg(fall) END AS cv FROM doss GROUP BY target"


@query("l20_case_dossier", sql("SELECT d.target, CAST(seq AS INTEGER) AS seq, round(fall, 2) AS fall, round(ratio, 6) AS ratio, round(cv, 4) AS cv FROM doss d JOIN cvs c ON c.target = d.target", **BASE, amounts=AMOUNTS, doss=DOSSIER, cvs=CVS))
def _(t: Traced) -> DataFrame:
    found = L.dossier(L.amounts(t.cn, t.g.tx))
    return found.select("target", "seq", F.round("fall", 2).alias("fall"), F.round("ratio", 6).alias("ratio"), F.round("cv", 4).alias("cv"))


@query("l21_hit_statistics", sql("SELECT depth, count(*) AS n, round(avg(CASE WHEN root IN (SELECT id FROM nodes WHERE class = 1) THEN 1.0 ELSE 0.0 END), 6) AS fraud_root, count(*) FILTER (cv < 0.3) AS steady, count(*) FILTER (fanin_hit AND pass_hit) AS all_three FROM scan s LEFT JOIN cvs c ON c.target = s.target WHERE peel_hit GROUP BY depth", **SCAN, doss=DOSSIER, cvs=CVS))
def _(t: Traced) -> DataFrame:
    cvs = L.dossier(L.amounts(t.cn, t.g.tx)).groupBy("target").agg(F.first("cv").alias("cv"))
    return L.hit_statistics(scan(t), t.g.nodes.where("class = 1"), cvs)
