"""Queries over fitted models (E4, H2, H4): SQL repeats the Newton steps and what is scored by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.functions.registry import registry
from rootward.functions.tables import written
from rootward.operators import effects as X
from rootward.operators.logistic import LEAST_CURVATURE, RIDGE, STEPS
from rootward.plans.evaluation import _CONF, _MACRO, _REPORT
from rootward.plans.fixture import Graph, sql
from rootward.plans.preparation import _SPLIT, split
from rootward.plans.scoring import _LAYER, FEATS, FEATURES, ROWS, features

QUERIES, ORACLES, query = registry(Graph)


def newton(rows: str, k: int) -> dict[str, str]:
    """Tables up to `fitted` (g, b0, b1, ...) of what `rows` (g, y, w, ridge, x1, x2, ...) are fitted by:
    sums of a step, then elimination and back substitution of its system, step after step."""
    names, pairs = range(k + 1), [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    x = lambda i: f"x{i}" if i else "1"
    both = f"SELECT g FROM {rows} GROUP BY g HAVING min(y) < max(y)"
    tables = {"fit0": f"SELECT g, {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in names)} FROM ({both})"}
    for step in range(STEPS):
        z = " + ".join(f"f.b{i}{f' * r.x{i}' if i else ''}" for i in names)
        each = f"SELECT r.*, {', '.join(f'f.b{i}' for i in names)}, 1 / (1 + exp(-({z}))) AS p FROM {rows} r JOIN fit{step} f ON f.g = r.g"
        held = lambda i: f" + any_value(ridge) * any_value(b{i})" if i else ""
        sums = [f"sum(w * (p - y) * {x(i)}) / sum(w){held(i)} AS v{i}" for i in names]
        sums += [f"sum(w * greatest(p * (1 - p), {LEAST_CURVATURE}) * {x(i)} * {x(j)}) / sum(w){' + any_value(ridge)' if i == j and i else ''} AS h{i}_{j}" for i, j in pairs]
        tables[f"sums{step}"] = f"SELECT g, {', '.join(f'any_value(b{i}) AS b{i}' for i in names)}, {', '.join(sums)} FROM ({each}) GROUP BY g"
        # Columns of one round of elimination are made from those of the round before.
        system, h, v = f"sums{step}", lambda i, j: f"h{min(i, j)}_{max(i, j)}", lambda i: f"v{i}"
        for c in range(k):
            rest = [f"{h(i, j)} - {h(c, i)} * {h(c, j)} / {h(c, c)} AS {h(i, j)}" for i, j in pairs if i > c] + [f"{v(i)} - {h(c, i)} * {v(c)} / {h(c, c)} AS {v(i)}" for i in names if i > c]
            kept = [h(i, j) for i, j in pairs if i <= c] + [v(i) for i in names if i <= c]
            system = f"(SELECT g, {', '.join([f'b{i}' for i in names] + kept + rest)} FROM {system})"
        moves = reduce(lambda done, i: [*done, f"({v(i)}{''.join(f' - {h(i, j)} * d{j}' for j in names if j > i)}) / {h(i, i)} AS d{i}"], reversed(names), [])
        tables[f"fit{step + 1}"] = f"SELECT g, {', '.join(f'b{i} - d{i} AS b{i}' for i in names)} FROM (SELECT *, {', '.join(moves)} FROM {system})"
    return tables | {"fitted": f"SELECT * FROM fit{STEPS}"}


_EDGE_ROWS = {
    "r": ROWS, "feats": FEATS, "counts": "SELECT edge_type AS t, count(*) AS n FROM r JOIN feats ON id = src GROUP BY edge_type",
    "weights": "SELECT t, (1 / sqrt(n)) / avg(1 / sqrt(n)) OVER () AS weight FROM counts",
    "rows": f"SELECT edge_type AS g, CAST(y AS DOUBLE) AS y, 1 AS w, {RIDGE} / weight AS ridge, f_amount AS x1, f_count AS x2 FROM r JOIN feats ON id = src JOIN weights ON t = edge_type",
}


@query("e4_train_edge_models", sql("SELECT g AS edge_type, n, round(b0, 7) AS intercept, round(b1, 7) AS b_f_amount, round(b2, 7) AS b_f_count FROM fitted JOIN counts ON t = g", **_EDGE_ROWS, **newton("rows", 2)))
def _(g: Graph) -> DataFrame:
    rows = X.edge_training_rows(g.causal, g.nodes).join(features(g).select(F.col("id").alias("src"), *FEATURES), "src")
    found = X.fit_edge_models(rows, FEATURES, mode="sqrt")
    return found.select("edge_type", "n", *[F.round(c, 7).alias(c) for c in ("intercept", "b_f_amount", "b_f_count")])


def _detectors(rows: str, k: int) -> dict[str, str]:
    """Tables from `rows` (g, id, y, split, x1, x2, ...): scales, models, cuts and predictions `told`."""
    xs = range(1, k + 1)
    spread = lambda i: f"CASE WHEN stddev_pop(x{i}) > 1e-12 THEN stddev_pop(x{i}) ELSE 1 END AS s{i}"
    z = " + ".join(["b0", *(f"b{i} * ((x{i} - m{i}) / s{i})" for i in xs)])
    return {
        "all_rows": rows,
        "scales": f"SELECT g, {', '.join(f'avg(x{i}) AS m{i}, {spread(i)}' for i in xs)}, sum(1 - y) / sum(y) AS pos FROM all_rows WHERE split = 'train' GROUP BY g",
        "rows": f"SELECT a.g, CAST(y AS DOUBLE) AS y, CASE WHEN y = 1 THEN pos ELSE 1 END AS w, {RIDGE} AS ridge, {', '.join(f'(x{i} - m{i}) / s{i} AS x{i}' for i in xs)} FROM all_rows a JOIN scales s ON s.g = a.g WHERE split = 'train'",
        **newton("rows", k),
        "scored": f"SELECT a.g, id, y, split, round(1 / (1 + exp(-({z}))), 9) AS score FROM all_rows a JOIN scales s ON s.g = a.g JOIN fitted f ON f.g = a.g",
        "grid": "SELECT CAST(range AS DOUBLE) * 5 / 100 AS cut FROM range(1, 20)",
        "swept": f"SELECT g, cut, {_CONF} FROM (SELECT s.*, cut, CASE WHEN score > cut THEN 1 ELSE 0 END AS pred FROM scored s, grid WHERE split = 'val') GROUP BY g, cut",
        "cuts": f"SELECT g, cut FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round({_MACRO}, 9) DESC, CASE WHEN cut = 0.5 THEN -1 ELSE cut END) AS rn FROM swept) WHERE rn = 1",
        "told": "SELECT s.*, cut, CASE WHEN score > cut THEN 1 ELSE 0 END AS pred FROM scored s JOIN cuts c ON c.g = s.g",
    }


_LAYERS = {"feats": FEATS, "one": _LAYER.format("feats"), "two": _LAYER.format("one"), "parts": _SPLIT}
_JOINED = "SELECT 'graph' AS g, p.id, p.y, p.split, f.f_amount AS x1, f.f_count AS x2, t.f_amount AS x3, t.f_count AS x4 FROM parts p JOIN feats f ON f.id = p.id JOIN two t ON t.id = p.id"


@query("h2_node_classifier", sql("SELECT id, y, split, round(score + 2e-10, 6) AS score, pred FROM told", **_LAYERS, **_detectors(_JOINED, 4)))
def _(g: Graph) -> DataFrame:
    """A node's own features beside those that two rounds over the graph leave it with. Scores have nine
    digits, which may end in 5 at the seventh; the small sum keeps rounding alike in any engine."""
    own = features(g)
    near = X.neighbour_features(own, g.causal, FEATURES, 2).select("id", *[F.col(f).alias(f"near_{f}") for f in FEATURES])
    rows = split(g).select(F.lit("graph").alias("variant"), "id", "y", "split").join(own, "id").join(near, "id")
    rows, used = written(rows, "detector-rows"), [*FEATURES, *(f"near_{f}" for f in FEATURES)]
    return X.detect(X.fit_detectors(rows, used), rows, used).select("id", "y", "split", F.round(F.col("score") + 2e-10, 6).alias("score"), "pred")


_VARIANTS = " UNION ALL ".join(f"SELECT '{name}' AS g, p.id, p.y, p.split, f_amount AS x1, f_count AS x2 FROM parts p JOIN {name} f ON f.id = p.id" for name in ("feats", "one", "two"))


@query(
    "h4_model_selection",
    sql(
        "SELECT g AS variant, cut, f1_macro, fraud_f1, weighted_f1, recall, pred_rate, n, row_number() OVER (ORDER BY weighted_f1 DESC, g) = 1 AS chosen FROM reports",
        **_LAYERS, **_detectors(_VARIANTS, 2), reports=f"SELECT g, cut, {_REPORT} FROM (SELECT g, any_value(cut) AS cut, {_CONF} FROM told WHERE split = 'val' GROUP BY g)",
    ),
)
def _(g: Graph) -> DataFrame:
    """Detectors of features after no, one and two rounds over the graph; the best blend of both F1 on the val split."""
    now = written(features(g), "features")
    variants, labels = {"feats": now}, written(split(g).select("id", "y", "split"), "labels")
    for name in ("one", "two"):
        now = variants[name] = X.neighbour_features(now, g.causal, FEATURES, 1)
    rows = reduce(DataFrame.unionByName, [labels.join(x.select("id", *FEATURES), "id").withColumn("variant", F.lit(name)) for name, x in variants.items()])
    rows = written(rows, "detector-rows")
    models = X.fit_detectors(rows, FEATURES)
    report = X.select_model(rows, FEATURES, models=models)[1]
    return report.join(models.select("variant", "cut"), "variant").select("variant", "cut", "f1_macro", "fraud_f1", "weighted_f1", "recall", "pred_rate", "n", "chosen")
