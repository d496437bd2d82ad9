"""Queries over detection, tracing and explanation metrics (I, J, D5), each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.functions.registry import registry
from rootward.operators import metrics as M
from rootward.plans.fixture import SCORE, Graph, sql
from rootward.plans.preparation import _SPLIT, split
from rootward.plans.tracing import GREEDY, greedy

QUERIES, ORACLES, query = registry(Graph)

SCORED = f"SELECT node_type, id, num, y, {SCORE} AS score, CASE num % 3 WHEN 0 THEN 'val' ELSE 'test' END AS split FROM nodes WHERE labelled"
PRED = "SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM scored"
_CONF = "CAST(count(*) FILTER (y = 1 AND pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND pred = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND pred = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND pred = 0) AS DOUBLE) AS tn"
_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
_F0 = "coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)"
_MACRO = f"(({_F1} + {_F0}) / 2)"
_REPORT = f"round({_MACRO}, 6) AS f1_macro, round({_F1}, 6) AS fraud_f1, round(0.5 * {_MACRO} + 0.5 * {_F1}, 6) AS weighted_f1, round(tp / (tp + fn), 6) AS recall, round((tp + fp) / (tp + fp + fn + tn), 6) AS pred_rate, CAST(tp + fp + fn + tn AS BIGINT) AS n"


def scored(g: Graph) -> DataFrame:
    rows = g.nodes.where("labelled").withColumn("score", F.expr(SCORE))
    return rows.select("node_type", "id", "num", "y", "score", F.when(F.col("num") % 3 == 0, "val").otherwise("test").alias("split"))


@query("i1_f1_macro", sql(f"SELECT round({_MACRO}, 6) AS f1_macro FROM c", scored=SCORED, pred=PRED, c=f"SELECT {_CONF} FROM pred"))
def _(g: Graph) -> DataFrame:
    return M.detection_report(M.predict(scored(g), 0.5)).select("f1_macro")


@query("i2_fraud_f1", sql(f"SELECT node_type, round({_F1}, 6) AS fraud_f1 FROM c", scored=SCORED, pred=PRED, c=f"SELECT node_type, {_CONF} FROM pred GROUP BY node_type"))
def _(g: Graph) -> DataFrame:
    return M.detection_report(M.predict(scored(g), 0.5), ["node_type"]).select("node_type", "fraud_f1")


_AUC = "SELECT {by} round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY node_type ORDER BY score) + (count(*) OVER (PARTITION BY node_type, score) - 1) / 2.0 AS r FROM scored) {group}"


@query("i3_auc", sql(_AUC.format(by="node_type,", group="GROUP BY node_type"), scored=SCORED))
def _(g: Graph) -> DataFrame:
    return M.auc(scored(g), ["node_type"])


_ONE = "SELECT c AS class, CASE WHEN class = c THEN 1 ELSE 0 END AS y, ((num * (48271 + c * 1000) + 11) % 1000) / CAST(1000 AS DOUBLE) AS score FROM nodes, (VALUES (1), (2), (3)) k(c)"


@query(
    "i3_auc_one_vs_rest",
    sql(
        "SELECT round(avg(auc), 6) AS auc, count(*) AS n_classes FROM (SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS r FROM one) GROUP BY class HAVING count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0)",
        one=_ONE,
    ),
)
def _(g: Graph) -> DataFrame:
    scores = F.array(*[F.expr(f"((num * {48271 + c * 1000} + 11) % 1000) / CAST(1000 AS DOUBLE)") for c in (1, 2, 3)])
    return M.auc_one_vs_rest(g.nodes.select(F.col("class").alias("y"), scores.alias("scores")), [1, 2, 3])


@query("i4_detection_report", sql(f"SELECT node_type, {_REPORT} FROM c", scored=SCORED, pred=PRED, c=f"SELECT node_type, {_CONF} FROM pred GROUP BY node_type"))
def _(g: Graph) -> DataFrame:
    return M.detection_report(M.predict(scored(g), 0.5), ["node_type"])


_SWEEP = {
    "scored": SCORED,
    "grid": "SELECT CAST(range AS DOUBLE) * 5 / 100 AS cut FROM range(1, 20)",
    "swept": f"SELECT node_type, split, cut, {_CONF} FROM (SELECT s.*, g.cut, CASE WHEN score > g.cut THEN 1 ELSE 0 END AS pred FROM scored s, grid g) GROUP BY ALL",
}


@query("i5_threshold_sweep", sql(f"SELECT node_type, cut, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS fraud_f1 FROM swept GROUP BY node_type, cut", **_SWEEP))
def _(g: Graph) -> DataFrame:
    return M.threshold_sweep(scored(g), ["node_type"]).select("node_type", "cut", "fraud_f1")


@query("i5_best_threshold", sql(f"SELECT node_type, cut, f AS value FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY f DESC, CASE WHEN cut = 0.5 THEN -1 ELSE cut END) AS rn FROM (SELECT node_type, cut, round({_F1}, 9) AS f FROM swept WHERE split = 'val')) WHERE rn = 1", **_SWEEP))
def _(g: Graph) -> DataFrame:
    return M.best_threshold(scored(g).where("split = 'val'"), "fraud_f1", ["node_type"])


@query("i6_apply_threshold", sql("SELECT id, CASE WHEN score > 0.35 THEN 1 ELSE 0 END AS pred FROM scored", scored=SCORED))
def _(g: Graph) -> DataFrame:
    return M.predict(scored(g), 0.35).select("id", "pred")


_CUTS = f"SELECT node_type, cut FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY round({_F1}, 9) DESC, CASE WHEN cut = 0.5 THEN -1 ELSE cut END) AS rn FROM swept WHERE split = 'val') WHERE rn = 1"


@query(
    "i7_pooled_eval",
    sql(
        f"SELECT node_type, {_REPORT}, cut FROM (SELECT r.*, k.cut FROM (SELECT node_type, {_CONF} FROM pred GROUP BY GROUPING SETS ((node_type), ())) r LEFT JOIN cuts k ON k.node_type = r.node_type)",
        **_SWEEP, cuts=_CUTS, pred="SELECT s.*, CASE WHEN score > coalesce(cut, 0.5) THEN 1 ELSE 0 END AS pred FROM scored s LEFT JOIN cuts c ON c.node_type = s.node_type WHERE split = 'test'",
    ),
)
def _(g: Graph) -> DataFrame:
    return M.pooled_eval(scored(g))


@query("i8_weighted_f1", sql(f"SELECT round(0.5 * {_MACRO} + 0.5 * {_F1}, 6) AS weighted_f1 FROM c", scored=SCORED, pred=PRED, c=f"SELECT {_CONF} FROM pred"))
def _(g: Graph) -> DataFrame:
    return M.detection_report(M.predict(scored(g), 0.5)).select("weighted_f1")


FRAUD = {"split_rows": _SPLIT, "fraud": "SELECT id FROM split_rows WHERE split = 'test' AND y = 1 UNION SELECT id FROM wallets WHERE class = 1"}
NODES_OF = "SELECT target, depth, UNNEST(chain) AS id, UNNEST(range(0, len(chain))) AS pos FROM chains"


def fraud(g: Graph) -> DataFrame:
    return M.fraud_set(g.nodes, split(g).where("split = 'test' AND y = 1"))


@query("j5_fraud_set", sql("SELECT id FROM fraud", **FRAUD))
def _(g: Graph) -> DataFrame:
    return fraud(g)


_PER = "SELECT target, max(f) FILTER (pos = depth) AS root, avg(f) AS valid, coalesce(max(f) FILTER (pos > 0), 0) AS hit, max(depth) AS depth FROM (SELECT *, CASE WHEN id IN (SELECT id FROM fraud) THEN 1 ELSE 0 END AS f FROM cn) GROUP BY target"
_CHAIN = GREEDY | FRAUD | {"cn": NODES_OF, "per": _PER}


def _metric(name: str, column: str, inner: str) -> None:
    @query(name, sql(f"SELECT round(avg({inner}), 6) AS {column}, count(*) AS n FROM per", **_CHAIN))
    def _(g: Graph) -> DataFrame:
        return M.chain_metrics(greedy(g), fraud(g)).select(column, "n")


_metric("j1_root_precision", "root_precision", "root")
_metric("j2_chain_validity", "chain_validity", "valid")
_metric("j3_hit_rate", "hit_rate", "hit")
_metric("j4_mean_depth", "mean_depth", "depth")


@query("j6_true_positive_precision", sql("SELECT round(avg(CASE WHEN root IN (SELECT id FROM fraud) THEN 1 ELSE 0 END), 6) AS root_precision, count(*) AS n FROM chains WHERE target IN (SELECT id FROM split_rows WHERE split = 'test')", **_CHAIN))
def _(g: Graph) -> DataFrame:
    return M.root_precision(greedy(g), fraud(g), split(g).where("split = 'test'"))


@query(
    "j7_labelled_only_precision",
    sql(
        "SELECT count(*) AS n, round(avg(CASE WHEN l THEN 1.0 ELSE 0.0 END), 6) AS judged, round(avg(CASE WHEN l THEN CASE WHEN f THEN 1.0 ELSE 0.0 END END), 6) AS precision_judged, round(avg(CASE WHEN c THEN 1.0 ELSE 0.0 END), 6) AS precision_all_fraud FROM (SELECT n.labelled AS l, n.class = 1 AS c, root IN (SELECT id FROM fraud) AS f FROM chains JOIN nodes n ON n.id = root)",
        **_CHAIN,
    ),
)
def _(g: Graph) -> DataFrame:
    return M.judged_precision(greedy(g), g.nodes, fraud(g))


STRICT = "SELECT DISTINCT dst AS target, src AS node FROM addr_tx WHERE dst IN (SELECT id FROM tx WHERE class = 1) AND src IN (SELECT id FROM wallets)"
_UND = "SELECT src, dst FROM addr_addr WHERE src <> dst UNION SELECT dst, src FROM addr_addr WHERE src <> dst"
_HITS = """SELECT DISTINCT seed, id FROM (SELECT s.node AS seed, a.dst AS id FROM (SELECT DISTINCT node FROM strict) s JOIN und a ON a.src = s.node
    UNION SELECT s.node, b.dst FROM (SELECT DISTINCT node FROM strict) s JOIN und a ON a.src = s.node JOIN und b ON b.src = a.dst) WHERE id <> seed AND id IN (SELECT id FROM wallets WHERE class = 1)"""
TRUTH = {"strict": STRICT, "und": _UND, "hits": _HITS, "truth": "SELECT target, node FROM strict UNION SELECT target, id FROM strict JOIN hits ON seed = node"}


def strict(g: Graph) -> DataFrame:
    return M.ground_truth_strict(g.tables["addr_tx"], g.tx.where("class = 1"), g.wallets)


def truth(g: Graph) -> DataFrame:
    return M.ground_truth_extended(strict(g), g.tables["addr_addr"], g.wallets.where("class = 1"), 2)


@query("j8_lfpn_strict", sql("SELECT target, node FROM strict", strict=STRICT))
def _(g: Graph) -> DataFrame:
    return strict(g)


@query("d5_khop_hits", sql("SELECT seed, id FROM hits", **TRUTH))
def _(g: Graph) -> DataFrame:
    return M.khop_hits(g.tables["addr_addr"], strict(g).select(F.col("node").alias("id")), g.wallets.where("class = 1"), 2)


@query("j9_lfpn_extended", sql("SELECT target, node FROM truth", **TRUTH))
def _(g: Graph) -> DataFrame:
    return truth(g)


@query("j10_gt_stats", sql("SELECT count(*) AS covered, min(k) AS min_size, max(m) AS median_size, round(avg(k), 6) AS mean_size, max(k) AS max_size FROM (SELECT k, CASE WHEN row_number() OVER (ORDER BY k) = count(*) OVER () // 2 + 1 THEN k END AS m FROM (SELECT target, count(*) AS k FROM truth GROUP BY target))", **TRUTH))
def _(g: Graph) -> DataFrame:
    return M.ground_truth_stats(truth(g))


_EXPLAIN = GREEDY | TRUTH | {
    "p": "SELECT DISTINCT target, id AS node FROM (SELECT target, UNNEST(chain) AS id FROM chains)",
    "per": "SELECT coalesce(p.target, t.target) AS target, CAST(count(p.node) AS DOUBLE) AS p, CAST(count(t.node) AS DOUBLE) AS g, CAST(count(CASE WHEN p.node = t.node THEN 1 END) AS DOUBLE) AS b FROM p FULL JOIN truth t ON p.target = t.target AND p.node = t.node GROUP BY 1",
}


def _explained(name: str, columns: dict[str, str]) -> None:
    @query(name, sql("SELECT " + ", ".join(f"round(avg({v}), 6) AS {k}" for k, v in columns.items()) + " FROM per", **_EXPLAIN))
    def _(g: Graph) -> DataFrame:
        own = greedy(g).select("target", F.explode("chain").alias("node"))
        return M.explanation_metrics(own, truth(g)).select(*columns)


_explained("j11_explanation_accuracy", {"accuracy": "CASE WHEN p > 0 THEN b / p END"})
_explained("j12_explanation_recall", {"recall": "CASE WHEN g > 0 THEN b / g END"})
_explained("j13_gt_match", {"exact_match": "CASE WHEN b = p AND b = g THEN 1.0 ELSE 0.0 END", "subset_match": "CASE WHEN g > 0 AND b = g THEN 1.0 ELSE 0.0 END"})
_explained("j14_subset_feasible", {"subset_feasible": "CASE WHEN g > 0 AND p > 0 THEN CASE WHEN g <= p THEN 1.0 ELSE 0.0 END END"})


@query("j14_shown_match", sql("SELECT CASE WHEN avg(CASE WHEN g > 0 AND p > 0 THEN CASE WHEN g <= p THEN 1.0 ELSE 0.0 END END) >= 0.5 THEN round(avg(CASE WHEN g > 0 AND b = g THEN 1.0 ELSE 0.0 END), 6) END AS subset_match_shown FROM per", **_EXPLAIN))
def _(g: Graph) -> DataFrame:
    return M.explanation_metrics(greedy(g).select("target", F.explode("chain").alias("node")), truth(g)).select("subset_match_shown")


@query("j15_depth_histogram", sql("SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n FROM chains GROUP BY depth", **GREEDY))
def _(g: Graph) -> DataFrame:
    return M.depth_histogram(greedy(g))


@query("j16_root_type_breakdown", sql("SELECT node_type, count(*) AS n, round(avg(CASE WHEN root IN (SELECT id FROM fraud) THEN 1.0 ELSE 0.0 END), 6) AS fraud_share FROM chains JOIN nodes ON id = root GROUP BY node_type", **_CHAIN))
def _(g: Graph) -> DataFrame:
    return M.root_types(greedy(g), g.nodes, fraud(g))


@query("j17_stuck_analysis", sql("SELECT count(*) AS n, count(*) FILTER (best IS NULL) AS no_parents, count(best) AS weak, round(avg(best), 6) AS mean_best, round(quantile_cont(best, 0.5), 6) AS median_best, min(best) AS min_best, max(best) AS max_best FROM chains c LEFT JOIN (SELECT dst, max(ce) AS best FROM effects GROUP BY dst) e ON e.dst = c.target WHERE depth = 0", **GREEDY))
def _(g: Graph) -> DataFrame:
    return M.stuck_analysis(greedy(g), g.effects)
