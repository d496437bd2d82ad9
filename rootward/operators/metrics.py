"""Detection, tracing and explanation metrics as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootward.functions.tables import frontier_loop

GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def predict(rows: DataFrame, cut: float | Column) -> DataFrame:
    return rows.withColumn("pred", (F.col("score") > cut).cast("int"))


def confusion() -> list[Column]:
    """tp, fp, fn, tn of class 1 from y and pred."""
    y, p = F.col("y"), F.col("pred")
    return [_count((y == 1) & (p == 1)).alias("tp"), _count((y == 0) & (p == 1)).alias("fp"), _count((y == 1) & (p == 0)).alias("fn"), _count((y == 0) & (p == 0)).alias("tn")]


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2.0 * tp + fp + fn)


def f1_macro_of() -> Column:
    """Mean F1 over the classes that occur in truth or prediction."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one, zero = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    return ratio(f1_of(tp, fp, fn) * one + f1_of(tn, fn, fp) * zero, (one + zero).cast("double"))


def detection_report(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """f1_macro, fraud_f1, weighted_f1, recall, pred_rate, n, overall or by columns."""
    counts = rows.groupBy(*(by or [])).agg(*confusion())
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    macro, fraud = f1_macro_of(), f1_of(tp, fp, fn)
    return counts.select(
        *(by or []), F.round(macro, 6).alias("f1_macro"), F.round(fraud, 6).alias("fraud_f1"), F.round(0.5 * macro + 0.5 * fraud, 6).alias("weighted_f1"),
        F.round(ratio(1.0 * tp, tp + fn), 6).alias("recall"), F.round(ratio(1.0 * (tp + fp), n), 6).alias("pred_rate"), n.alias("n"),
    )


def auc(rows: DataFrame, by: list[str] | None = None, ranges: int = 1000) -> DataFrame:
    """Area under the ROC curve, ties averaged, 0 where a class is missing.

    Scores (0 to 1) are counted per value first; values are ranked within ranges of the score
    and the ranges' sizes added, so no task orders all of them."""
    by = by or []
    values = rows.groupBy(*by, "score").agg(_count(F.col("y") == 1).alias("p"), _count(F.col("y") == 0).alias("q"))
    values = values.withColumn("_range", F.floor(F.col("score") * ranges).cast("int"))
    sizes = values.groupBy(*by, "_range").agg(F.sum("q").alias("_q"))
    before = sizes.select(*by, "_range", (F.sum("_q").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_q")).alias("_before"))
    inside = F.sum("q").over(Window.partitionBy(*by, "_range").orderBy("score")) - F.col("q")
    placed = values.withColumn("_in", inside).join(F.broadcast(before), [*by, "_range"])
    wins = F.sum(F.col("p") * (F.col("_before") + F.col("_in") + F.col("q") / 2.0))
    return placed.groupBy(*by).agg(wins.alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q")).select(*by, F.round(ratio(F.col("w"), F.col("p") * F.col("q")), 6).alias("auc"))


def auc_one_vs_rest(rows: DataFrame, classes: list[int]) -> DataFrame:
    """Mean area over classes, each against all others; rows: y (a class) and scores (an array, one per
    class of the list). A class that no row, or every row, has is left out; 0 if none is left."""
    each = rows.select("y", F.posexplode("scores").alias("at", "score")).withColumn("class", F.get(F.array(*[F.lit(c) for c in classes]), F.col("at")))
    each = each.select("class", (F.col("y") == F.col("class")).cast("int").alias("y"), "score")
    usable = each.groupBy("class").agg(F.min("y").alias("low"), F.max("y").alias("high")).where("low < high").select("class")
    return auc(each, ["class"]).join(usable, "class", "left_semi").agg(F.round(F.coalesce(F.avg("auc"), F.lit(0.0)), 6).alias("auc"), F.count("*").alias("n_classes"))


def threshold_sweep(rows: DataFrame, by: list[str] | None = None, grid: tuple[float, ...] = GRID) -> DataFrame:
    """cut, fraud_f1 and f1_macro for each cut of the grid (and 0.5): a row of it per cut, counted at once."""
    cuts = sorted({0.5, *grid})
    spread = rows.select(*(by or []), "y", "score", F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut"))
    counts = spread.withColumn("pred", (F.col("score") > F.col("cut")).cast("int")).groupBy(*(by or []), "cut").agg(*confusion())
    return counts.select(*(by or []), "cut", F.round(f1_of(F.col("tp"), F.col("fp"), F.col("fn")), 9).alias("fraud_f1"), F.round(f1_macro_of(), 9).alias("f1_macro"))


def best_threshold(rows: DataFrame, objective: str = "f1_macro", by: list[str] | None = None, grid: tuple[float, ...] = GRID) -> DataFrame:
    """The cut of the largest objective; 0.5 unless another is strictly better, then the smallest."""
    if objective not in ("f1_macro", "fraud_f1"):
        raise ValueError("the objective is f1_macro or fraud_f1")
    swept = threshold_sweep(rows, by, grid)
    first = F.when(F.col("cut") == 0.5, -1.0).otherwise(F.col("cut"))
    best = F.min(F.struct((-F.col(objective)).alias("o"), first.alias("f"), F.col("cut").alias("cut"))).alias("b")
    return swept.groupBy(*(by or [])).agg(best).select(*(by or []), F.col("b.cut").alias("cut"), (-F.col("b.o")).alias("value"))


def pooled_eval(rows: DataFrame, objective: str = "fraud_f1", tune: str = "val", test: str = "test") -> DataFrame:
    """Each type cut at its own best value on its tuning rows (0.5 without any), then one report
    per type and one over all (node_type null)."""
    cuts = best_threshold(rows.where(F.col("split") == tune), objective, ["node_type"]).select("node_type", F.col("cut").alias("_cut"))
    cut = rows.where(F.col("split") == test).join(F.broadcast(cuts), "node_type", "left")
    cut = predict(cut, F.coalesce("_cut", F.lit(0.5)))
    both = detection_report(cut, ["node_type"]).unionByName(detection_report(cut).withColumn("node_type", F.lit(None).cast("string")))
    return both.join(F.broadcast(cuts), "node_type", "left").withColumnRenamed("_cut", "cut")


def fraud_set(nodes: DataFrame, test_targets: DataFrame, all_tx: bool = False) -> DataFrame:
    """ids: illicit test targets and illicit wallets, on request all illicit transactions."""
    illicit = nodes.where("class = 1")
    parts = [test_targets.select("id"), illicit.where("node_type = 'wallet'").select("id")]
    if all_tx:
        parts.append(illicit.where("node_type = 'transaction'").select("id"))
    return reduce(DataFrame.union, parts).distinct()


def chain_metrics(chains: DataFrame, fraud: DataFrame) -> DataFrame:
    """root_precision, chain_validity, hit_rate, mean_depth and n over all chains."""
    marked = fraud.select("id").distinct().withColumn("_f", F.lit(1))
    nodes = chains.select("target", "depth", F.posexplode("chain").alias("pos", "id")).join(marked, "id", "left").withColumn("_f", F.coalesce("_f", F.lit(0)))
    per = nodes.groupBy("target").agg(
        F.max(F.when(F.col("pos") == F.col("depth"), F.col("_f"))).alias("root"), F.avg("_f").alias("valid"),
        F.coalesce(F.max(F.when(F.col("pos") > 0, F.col("_f"))), F.lit(0)).alias("hit"), F.max("depth").alias("depth"),
    )
    mean = lambda c: F.round(F.avg(c), 6)
    return per.agg(mean("root").alias("root_precision"), mean("valid").alias("chain_validity"), mean("hit").alias("hit_rate"), mean("depth").alias("mean_depth"), F.count("*").alias("n"))


def root_precision(chains: DataFrame, fraud: DataFrame, only: DataFrame | None = None, column: str = "target") -> DataFrame:
    """Share of chains with a root in the fraud set and their number, on request of those whose `column` is in `only`."""
    kept = chains if only is None else chains.join(only.select(F.col("id").alias(column)).distinct(), column, "left_semi")
    marked = fraud.select(F.col("id").alias("root")).distinct().withColumn("_f", F.lit(1))
    found = kept.join(marked, "root", "left")
    return found.agg(F.round(F.avg(F.coalesce("_f", F.lit(0))), 6).alias("root_precision"), F.count("*").alias("n"))


def judged_precision(chains: DataFrame, nodes: DataFrame, fraud: DataFrame) -> DataFrame:
    """n chains, share with a labelled root (`judged`), root precision of those, and root precision of all
    chains against all illicit nodes instead of `fraud`."""
    kinds = nodes.select(F.col("id").alias("root"), F.coalesce("labelled", F.lit(False)).alias("_l"), (F.col("class") == 1).cast("int").alias("_all"))
    marked = fraud.select(F.col("id").alias("root")).distinct().withColumn("_f", F.lit(1))
    found = chains.join(kinds, "root", "left").join(marked, "root", "left")
    known, hit = F.coalesce("_l", F.lit(False)), F.coalesce("_f", F.lit(0))
    return found.agg(
        F.count("*").alias("n"), F.round(F.avg(known.cast("int")), 6).alias("judged"), F.round(F.avg(F.when(known, hit)), 6).alias("precision_judged"),
        F.round(F.avg(F.coalesce("_all", F.lit(0))), 6).alias("precision_all_fraud"),
    )


def ground_truth_strict(addr_tx: DataFrame, illicit: DataFrame, wallets: DataFrame) -> DataFrame:
    """target, node: illicit transactions and their direct input wallets."""
    rows = addr_tx.select(F.col("dst").alias("target"), F.col("src").alias("node"))
    return rows.join(illicit.select(F.col("id").alias("target")), "target", "left_semi").join(wallets.select(F.col("id").alias("node")), "node", "left_semi").select("target", "node").distinct()


def khop_hits(edges: DataFrame, seeds: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """seed, id: hits within k undirected hops of each seed, the seed left out. The last hop meets
    the hits only, which spares its frontier."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    own = hits.select("id").distinct()
    start = seeds.select(F.col("id").alias("seed"), "id").distinct()
    step = lambda new: new.join(both, new.id == both.src).select("seed", F.col("dst").alias("id"))
    near = frontier_loop(start, step, ["seed", "id"], k - 1)
    last = step(near.where(F.col("hop") == k - 1)).join(own, "id", "left_semi").select("seed", "id")
    inner = near.join(own, "id", "left_semi").select("seed", "id")
    return inner.union(last).where("seed <> id").distinct()


def ground_truth_extended(strict: DataFrame, addr_addr: DataFrame, illicit_wallets: DataFrame, k: int) -> DataFrame:
    """strict and the illicit wallets within k wallet links of a direct wallet."""
    hits = khop_hits(addr_addr, strict.select(F.col("node").alias("id")), illicit_wallets, k)
    more = strict.join(hits, strict.node == hits.seed).select("target", F.col("id").alias("node"))
    return strict.union(more).distinct()


def ground_truth_stats(truth: DataFrame) -> DataFrame:
    """covered targets; size of their sets: min, upper median, mean, max."""
    sizes = truth.groupBy("target").agg(F.countDistinct("node").alias("size"))
    by_size = sizes.groupBy("size").agg(F.count("*").alias("n"))  # as many rows as there are sizes
    run = by_size.select("size", "n", F.sum("n").over(Window.orderBy("size")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("size")))
    return run.agg(F.sum("n").alias("covered"), F.min("size").alias("min_size"), median.alias("median_size"), F.round(F.sum(F.col("size") * F.col("n")) / F.sum("n"), 6).alias("mean_size"), F.max("size").alias("max_size"))


def explanation_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Over targets of both tables (target, node): accuracy |p and g| / |p|, recall |p and g| / |g|,
    exact and subset match, share of pairs in which a subset match could be (`subset_feasible`).
    subset_match_shown is subset_match, null where that share is under one half."""
    p, g = predicted.select("target", "node").distinct().withColumn("_p", F.lit(1)), truth.select("target", "node").distinct().withColumn("_g", F.lit(1))
    every = p.join(g, ["target", "node"], "full").groupBy("target").agg(F.count("_p").alias("p"), F.count("_g").alias("g"), _count(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("both"))
    mean = lambda c: F.round(F.avg(c), 6)
    found = every.agg(
        mean(F.when(F.col("p") > 0, F.col("both") / F.col("p"))).alias("accuracy"), mean(F.when(F.col("g") > 0, F.col("both") / F.col("g"))).alias("recall"),
        mean(((F.col("both") == F.col("p")) & (F.col("both") == F.col("g"))).cast("double")).alias("exact_match"),
        mean(((F.col("g") > 0) & (F.col("both") == F.col("g"))).cast("double")).alias("subset_match"),
        mean(F.when((F.col("g") > 0) & (F.col("p") > 0), (F.col("g") <= F.col("p")).cast("double"))).alias("subset_feasible"),
    )
    return found.withColumn("subset_match_shown", F.when(F.col("subset_feasible") >= 0.5, F.col("subset_match")))


def depth_histogram(chains: DataFrame) -> DataFrame:
    return chains.groupBy("depth").agg(F.count("*").alias("n"))


def root_types(chains: DataFrame, nodes: DataFrame, fraud: DataFrame) -> DataFrame:
    kinds = nodes.select(F.col("id").alias("root"), "node_type")
    marked = fraud.select(F.col("id").alias("root")).distinct().withColumn("_f", F.lit(1.0))
    found = chains.join(kinds, "root", "left").join(marked, "root", "left")
    return found.groupBy("node_type").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("_f", F.lit(0.0))), 6).alias("fraud_share"))


def stuck_analysis(chains: DataFrame, effects: DataFrame) -> DataFrame:
    """Of chains of depth 0: those without a parent, those with weak effects only, their best signed ce."""
    best = effects.groupBy(F.col("dst").alias("target")).agg(F.max("ce").alias("best"))
    rows = chains.where("depth = 0").select("target").join(best, "target", "left")
    return rows.agg(
        F.count("*").alias("n"), _count(F.col("best").isNull()).alias("no_parents"), _count(F.col("best").isNotNull()).alias("weak"),
        F.round(F.avg("best"), 6).alias("mean_best"), F.round(F.percentile("best", F.lit(0.5)), 6).alias("median_best"), F.min("best").alias("min_best"), F.max("best").alias("max_best"),
    )
