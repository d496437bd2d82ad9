"""Edge scores: training rows, balance, models, and causal effects against three baselines.

The effect of u on v is p(u) - p0, with p a model of the edge type on u's features and p0
its value at a baseline: the zero vector, the mean of u's type, or the mean prediction over
u's type. Models are logistic: tables with a row per edge type or variant (`logistic`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootward.functions.tables import written
from rootward.operators import logistic
from rootward.operators.metrics import best_threshold, detection_report


def edge_training_rows(edges: DataFrame, nodes: DataFrame, mode: str = "wallets", target_type: str = "transaction") -> DataFrame:
    """src, dst, edge_type, y of the edges that a label supervises.

    mode `types`: the label of the effect, whatever its type, of labelled nodes only. mode
    `wallets`, in this order: edges from wallets to transactions take the label of the source
    wallet, other edges into wallets that of the wallet; in both, edges without a label go and
    do not fall to the next rule. All others take the label of an effect of the target type, for
    which an unlabelled node counts as 0, and edges into other types go. mode `target`: the last
    rule for all edges, as where wallets have no labels; edges that touch the wallet rules go."""
    if mode not in ("types", "wallets", "target"):
        raise ValueError("the mode is types, wallets or target")
    ends = nodes.select("id", "node_type", "y", F.coalesce("labelled", F.lit(False)).alias("labelled"))
    rows = edges.select("src", "dst", "edge_type").join(ends.toDF("src", "_st", "_sy", "_sl"), "src").join(ends.toDF("dst", "_dt", "_dy", "_dl"), "dst")
    of_effect = F.when(F.col("_dl"), F.col("_dy"))
    by_wallet = (F.col("_st") == "wallet") & (F.col("_dt") == "transaction")
    last = F.when(F.col("_dt") == target_type, F.col("_dy"))
    none = F.lit(None).cast("int")
    y = {
        "types": of_effect,
        "wallets": F.when(by_wallet, F.when(F.col("_sl"), F.col("_sy"))).when(F.col("_dt") == "wallet", of_effect).otherwise(last),
        "target": F.when(by_wallet | (F.col("_dt") == "wallet"), none).otherwise(last),
    }[mode]
    return rows.select("src", "dst", "edge_type", y.alias("y")).where("y IN (0, 1)")


def supervision_counts(rows: DataFrame, edge_types: list[str]) -> DataFrame:
    """edge_type, n labelled rows, types without any included."""
    every = rows.sparkSession.createDataFrame([(t,) for t in edge_types], "edge_type string")
    return every.join(rows.groupBy("edge_type").agg(F.count("*").alias("n")), "edge_type", "left").select("edge_type", F.coalesce("n", F.lit(0)).alias("n"))


def edge_balance(counts: DataFrame, mode: str = "sqrt") -> DataFrame:
    """edge_type, weight: none 1; uniform 1; sqrt and inverse scaled to mean 1."""
    if mode in ("none", "uniform"):
        return counts.select("edge_type", F.lit(1.0).alias("weight"))
    raw = counts.where("n > 0").withColumn("_w", 1 / (F.sqrt("n") if mode == "sqrt" else F.col("n")))
    return raw.select("edge_type", (F.col("_w") / F.avg("_w").over(Window.partitionBy())).alias("weight"))


def fit_edge_models(rows: DataFrame, features: list[str], steps: int = logistic.STEPS, mode: str = "none") -> DataFrame:
    """edge_type, n, intercept and coefficients: a logistic regression per edge type with both labels,
    all of them fitted at once.

    mode balances edge types as in `edge_balance`. Types share no coefficients, so what a type's
    weight moves is how much regularisation takes from it: the ridge is divided by the weight."""
    counts = rows.groupBy("edge_type").agg(F.count("*").alias("n"))
    hold = {r.edge_type: 1 / r.weight for r in edge_balance(counts, mode).collect()}
    return logistic.fit(rows, "edge_type", features, steps, hold=hold)


def score_edges(edges: DataFrame, nodes: DataFrame, models: DataFrame, features: list[str], baseline: str = "zero") -> DataFrame:
    """src, dst, edge_type, ce. Predictions are made once per source and edge type; edges with an
    end that has no features get none."""
    known = nodes.select(F.col("id").alias("src"), F.col("node_type").alias("src_type"), *features)
    kinds = edges.select("edge_type", F.substring_index("edge_type", "__to__", 1).alias("src_type")).distinct()
    own = F.broadcast(kinds.join(models, "edge_type"))  # a row per edge type
    if baseline == "zero":
        null = own.select("edge_type", "src_type", (1 / (1 + F.exp(-F.col("intercept")))).alias("p0"))
    elif baseline == "type_mean":
        means = known.groupBy("src_type").agg(*[F.avg(f).alias(f) for f in features])
        null = own.join(means, "src_type").select("edge_type", "src_type", logistic.probability(features).alias("p0"))
    else:
        null = known.join(own, "src_type").select("edge_type", "src_type", logistic.probability(features).alias("p")).groupBy("edge_type", "src_type").agg(F.avg("p").alias("p0"))
    used = edges.select("src", "edge_type").distinct()
    predicted = used.join(known, "src").join(own, ["edge_type", "src_type"]).select("src", "edge_type", "src_type", logistic.probability(features).alias("p"))
    effect = predicted.join(F.broadcast(null), ["edge_type", "src_type"]).select("src", "edge_type", (F.col("p") - F.col("p0")).alias("ce"))
    ends = edges.select("src", "dst", "edge_type").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return ends.join(effect, ["src", "edge_type"]).select("src", "dst", "edge_type", "ce")


def effect_coverage(edges: DataFrame, nodes: DataFrame, models: DataFrame) -> DataFrame:
    """n edges, those with an end that has no features, those of a type without a model."""
    ids = nodes.select("id").distinct()
    a = ids.select(F.col("id").alias("src")).withColumn("_a", F.lit(True))
    b = ids.select(F.col("id").alias("dst")).withColumn("_b", F.lit(True))
    rows = edges.join(a, "src", "left").join(b, "dst", "left").join(F.broadcast(models.select("edge_type").withColumn("_m", F.lit(True))), "edge_type", "left")
    return rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("no_features"), F.count(F.when(F.col("_m").isNull(), 1)).alias("no_model"))


def relation_features(nodes: DataFrame, edges: DataFrame, features: list[str], exclude: tuple[str, ...] = (), how: str = "mean") -> DataFrame:
    """Per node and relation the mean or sum of the features of what leads to it, and its own."""
    usable = nodes.where(~F.col("node_type").isin(*exclude)) if exclude else nodes
    vectors = usable.select(F.col("id").alias("src"), *features)
    into = edges.join(vectors, "src").join(usable.select(F.col("id").alias("dst")), "dst", "left_semi")
    take = {"mean": F.avg, "sum": F.sum}[how]
    means = into.groupBy("dst", "edge_type").agg(*[take(f).alias(f"near_{f}") for f in features], F.count("*").alias("n_near"))
    return means.withColumnRenamed("dst", "id").join(nodes.select("id", "node_type", *features), "id")


def neighbour_features(nodes: DataFrame, edges: DataFrame, features: list[str], layers: int = 2, how: str = "mean", exclude: tuple[str, ...] = ()) -> DataFrame:
    """id, node_type and the features after `layers` rounds: in each, a node with incoming neighbours
    takes half its own vector and half the mean over relations of what each relation brings (the
    mean or sum of its neighbours); others, and nodes of excluded types, which do not send
    either, keep theirs. The vectors of a round are written."""
    now = nodes.select("id", "node_type", *features)
    for _ in range(layers):
        brought = relation_features(now, edges, features, exclude, how)
        mean = brought.groupBy("id").agg(*[F.avg(f"near_{f}").alias(f"_{f}") for f in features])
        now = now.join(mean, "id", "left").select("id", "node_type", *[F.coalesce((F.col(f) + F.col(f"_{f}")) / 2, F.col(f)).alias(f) for f in features])
        now = written(now, "vectors")
    return now


def fit_detectors(rows: DataFrame, features: list[str], by: str = "variant", steps: int = logistic.STEPS) -> DataFrame:
    """The model table of weighted logistic detectors of y, one per variant, all fitted at once.

    rows: by, y, split (train, val, others) and features. Features are scaled by what the training
    rows say, positives weigh negatives over positives, and `cut` is the one of best macro F1 on the val
    rows (0.5 without any). A variant without both labels among its training rows has no model."""
    train = F.col("split") == "train"
    moved, stats = logistic.scaled(rows, by, features, train)
    moved = moved.where(train)
    counts = moved.groupBy(by).agg(F.sum(F.when(F.col("y") == 1, 1.0).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col("y") == 0, 1.0).otherwise(0.0)).alias("_q"))
    moved = moved.join(F.broadcast(written(counts, "label-counts")), by)  # a row per variant
    models = logistic.fit(moved, by, features, steps, weight=F.when(F.col("y") == 1, F.col("_q") / F.col("_p")).otherwise(1.0))
    models = models.join(F.broadcast(stats), by).withColumn("cut", F.lit(0.5))
    cuts = best_threshold(detect(models, rows.where("split = 'val'"), features, by), "f1_macro", [by]).select(by, F.col("cut").alias("_cut"))
    return written(models.join(cuts, by, "left").withColumn("cut", F.coalesce("_cut", "cut")).drop("_cut"), "detectors")


def detect(models: DataFrame, rows: DataFrame, features: list[str], by: str = "variant") -> DataFrame:
    """rows with score, the probability of class 1, and pred, whether it is above the cut of the variant."""
    own = F.broadcast(models.drop("n"))  # a row per variant
    found = rows.join(own, by).withColumn("score", F.round(logistic.probability(features, scales=True), 9))
    return found.select(*rows.columns, "score", (F.col("score") > F.col("cut")).cast("int").alias("pred"))


def select_model(rows: DataFrame, features: list[str], metric: str = "weighted_f1", by: str = "variant", models: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(model, report): of the models (fitted here if none are given) the model of the variant that is best on the val split by f1_macro, fraud_f1 or
    weighted_f1, the first by name among equals; report has a row per variant with its metrics and `chosen`."""
    if metric not in ("f1_macro", "fraud_f1", "weighted_f1"):
        raise ValueError("the metric is f1_macro, fraud_f1 or weighted_f1")
    models = fit_detectors(rows, features, by) if models is None else models
    found = written(detection_report(detect(models, rows.where("split = 'val'"), features, by), [by]), "model-reports")
    best = F.broadcast(found.agg(F.min(F.struct((-F.col(metric)).alias("m"), F.col(by))).alias("b")).select(F.col(f"b.{by}").alias("_best")))
    report = found.join(best).withColumn("chosen", F.col(by) == F.col("_best")).drop("_best")
    return models.join(best, F.col(by) == F.col("_best")).drop("_best"), report
