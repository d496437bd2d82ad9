"""Responsibility of parents and of chain nodes: additive, asymmetric and symmetric shares.

A coalition value is a table: for G2 and for sampled orders of G3 `prefixes` with the value of
each prefix of a target's parents, for G3 the value of every subset. Missing effects count 0."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootward.functions.tables import running_sums, written


#: Whole units of an effect and of a marginal, for sums that do not depend on order: effects of a node
#: may add up to 2**27, and a marginal is below 1.
EFFECT_UNITS, SHARE_UNITS = float(2**36), float(2**50)


def n_parents(edges: DataFrame) -> DataFrame:
    """dst, n: counted by an aggregate and joined back, so that a hub's edges need not be one task."""
    return edges.groupBy("dst").agg(F.count("*").alias("n"))


def phi_additive(edges: DataFrame, effects: DataFrame) -> DataFrame:
    """target, parent, phi: ce over the number of parents."""
    known = effects.select("src", "dst", "ce")
    rows = edges.select("src", "dst").distinct().join(known, ["src", "dst"], "left")
    rows = rows.join(n_parents(edges.select("src", "dst").distinct()), "dst")
    return rows.select(F.col("dst").alias("target"), F.col("src").alias("parent"), (F.coalesce("ce", F.lit(0.0)) / F.col("n")).alias("phi"))


def hybrid_effect(effects: DataFrame, phi: DataFrame) -> DataFrame:
    """|phi| * ce + ce; phi is 1 where none is given."""
    found = effects.join(phi.select("src", "dst", "phi"), ["src", "dst"], "left")
    return found.withColumn("ce", F.abs(F.coalesce("phi", F.lit(1.0))) * F.col("ce") + F.col("ce")).drop("phi")


def phi_asymmetric(prefixes: DataFrame, normalise: bool = True) -> DataFrame:
    """From target, parent, position (1, 2, ... in causal order), v (value of the prefix that ends
    there) and v_empty: the marginal of each parent, over the number of parents if asked."""
    before = prefixes.select("target", (F.col("position") + 1).alias("position"), F.col("v").alias("_v"))
    rows = prefixes.join(before, ["target", "position"], "left").select("target", "parent", (F.col("v") - F.coalesce("_v", F.col("v_empty"))).alias("phi"))
    if not normalise:
        return rows
    n = prefixes.groupBy("target").agg(F.count("*").alias("_n"))
    return rows.join(n, "target").select("target", "parent", (F.col("phi") / F.col("_n")).alias("phi"))


def logistic_prefixes(edges: DataFrame, effects: DataFrame, order: DataFrame) -> DataFrame:
    """Prefix values under a logistic readout of the sum of effects: no model run per prefix.
    order: id, level; parents without a level come last, ties by id. Sums run within a level and
    the levels' sums are added, so that the parents of a hub are as many tasks as they have levels."""
    rows = edges.select("src", "dst").distinct().join(effects.select("src", "dst", "ce"), ["src", "dst"], "left")
    rows = rows.join(order.select(F.col("id").alias("src"), "level"), "src", "left")
    rows = rows.select("src", "dst", F.coalesce("ce", F.lit(0.0)).alias("ce"), F.coalesce("level", F.lit(2**31 - 1)).alias("level"))
    summed = running_sums(rows, ["dst"], "level", ["src"], "ce", "total", "position")
    return summed.select(F.col("dst").alias("target"), F.col("src").alias("parent"), "position", (1 / (1 + F.exp(-F.col("total")))).alias("v"), F.lit(0.5).alias("v_empty"))


def parent_topk(effects: DataFrame, k: int = 8) -> DataFrame:
    """The k strongest parents of each node; Spark keeps k of a node in every partition before the shuffle."""
    by = Window.partitionBy("dst").orderBy(F.desc(F.abs("ce")), "src")
    return effects.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= k).drop("_rn")


def phi_symmetric(effects: DataFrame, n_perm: int = 64, seed: int = 0, numbers: tuple[Column, Column] | None = None) -> DataFrame:
    """Shapley values of all parents under the logistic readout: exact while n! <= n_perm, else the
    mean over n_perm orders by an arithmetic key.

    numbers: whole numbers of src and dst for the key; hashes of the ids if not given. To cap
    the parents first, use `parent_topk` on the effects."""
    most = max(n for n in range(1, 21) if n == 1 or math.factorial(n) <= n_perm)
    n = effects.groupBy("dst").agg(F.count("*").alias("n"))
    known = effects.withColumn("ce", F.coalesce("ce", F.lit(0.0))).join(n, "dst")
    src, dst = numbers or (F.xxhash64("src"), F.xxhash64("dst"))
    return _exact(known.where(F.col("n") <= most), most).unionByName(_sampled(known.where(F.col("n") > most), n_perm, seed, src, dst))


def _exact(rows: DataFrame, most: int) -> DataFrame:
    """target, parent, phi by subset weights, for targets of at most `most` parents (column n).

    The subsets of the places are the same for all targets (2**most of them, most small), so each
    parent row meets only those without its own place; sums of effects come from one array."""
    group = Window.partitionBy("dst")
    rows = rows.withColumn("place", F.row_number().over(group.orderBy(F.desc(F.abs("ce")), "src")) - 1)
    rows = rows.withColumn("ces", F.transform(F.array_sort(F.collect_list(F.struct("place", "ce")).over(group)), lambda x: x["ce"]))
    subsets = [s for size in range(most) for s in combinations(range(most), size)]
    listed = F.array(*[F.array(*[F.lit(i) for i in s]).cast("array<int>") for s in subsets])
    usable = F.filter(listed, lambda s: F.forall(s, lambda i: (i < F.col("n")) & (i != F.col("place"))))
    factorial = F.array(*[F.lit(float(math.factorial(i))) for i in range(most + 1)])

    def term(s):
        total = F.aggregate(s, F.lit(0.0), lambda a, i: a + F.get("ces", i))
        weight = F.get(factorial, F.size(s)) * F.get(factorial, F.col("n").cast("int") - F.size(s) - 1) / F.get(factorial, F.col("n").cast("int"))
        return weight * (1 / (1 + F.exp(-(total + F.col("ce")))) - 1 / (1 + F.exp(-total)))

    return rows.select(F.col("dst").alias("target"), F.col("src").alias("parent"), F.aggregate(F.transform(usable, term), F.lit(0.0), lambda a, b: a + b).alias("phi"))


def _sampled(rows: DataFrame, n_perm: int, seed: int, src: Column, dst: Column) -> DataFrame:
    """target, parent, phi: mean marginal over n_perm orders. The multiplier of the key differs by
    order and the key is squared once, since shifts alone would only rotate one order. Effects and
    marginals are added as whole numbers, so that the order in which rows arrive changes nothing."""
    prime = F.lit(2147483647).cast("long")
    rows = rows.select("src", "dst", "ce", F.pmod(src, prime).alias("_a"), F.pmod(dst, prime).alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_perm - 1).cast("long"))).alias("perm"))
    factor = F.pmod((F.col("perm") + 1 + F.lit(n_perm * seed).cast("long")) * F.lit(1103515245).cast("long") + 12345, prime)
    rows = rows.withColumn("_h", F.pmod(F.col("_a") * factor + F.col("_b"), prime))
    rows = rows.withColumn("_h", F.pmod(F.pmod(F.col("_h") * F.col("_h"), prime) * 48271 + F.col("_h"), prime))
    rows = rows.withColumn("_part", F.floor(F.col("_h") / 2**24).cast("int"))  # 128 parts of an order
    rows = rows.select("src", "dst", F.round(F.col("ce") * EFFECT_UNITS).cast("long").alias("ce"), "perm", "_h", "_part")
    total = running_sums(rows, ["dst", "perm"], "_part", ["_h", "src"], "ce", "_total")
    upto, before = F.col("_total") / EFFECT_UNITS, (F.col("_total") - F.col("ce")) / EFFECT_UNITS
    rows = total.select("src", "dst", F.round((_sigmoid(upto) - _sigmoid(before)) * SHARE_UNITS).cast("long").alias("m"))
    return rows.groupBy(F.col("dst").alias("target"), F.col("src").alias("parent")).agg((F.sum("m") / F.lit(SHARE_UNITS * n_perm)).alias("phi"))


def phi_of_coalitions(values: DataFrame) -> DataFrame:
    """target, parent, phi: Shapley values from a table of coalition values of any origin.

    values: target, members (array of parents, empty for none), v, with all subsets of the
    parents of a target. Each set meets the set without one of its members by an equi-join."""
    rows = values.select("target", F.array_sort(F.array_distinct("members")).alias("members"), "v").dropDuplicates(["target", "members"])
    n = rows.groupBy("target").agg(F.max(F.size("members")).alias("n"))
    rows = rows.join(n, "target")
    less = rows.select("target", F.col("members").alias("rest"), F.col("v").alias("v_rest"))
    wider = rows.where("size(members) > 0").select("target", "members", "v", "n", F.explode("members").alias("parent"))
    wider = wider.withColumn("rest", F.array_remove("members", F.col("parent")))
    k = F.size("rest")
    weight = F.factorial(k) * F.factorial((F.col("n") - k - 1).cast("int")) / F.factorial(F.col("n").cast("int"))
    return wider.join(less, ["target", "rest"]).groupBy("target", "parent").agg(F.sum(weight * (F.col("v") - F.col("v_rest"))).alias("phi"))


def phi_of_orders(prefixes: DataFrame) -> DataFrame:
    """target, parent, phi: mean marginal over given orders. prefixes: target, perm, parent, position,
    v (of the prefix that ends there) and v_empty, of whatever origin."""
    before = prefixes.select("target", "perm", (F.col("position") + 1).alias("position"), F.col("v").alias("_v"))
    rows = prefixes.join(before, ["target", "perm", "position"], "left")
    return rows.groupBy("target", "parent").agg(F.avg(F.col("v") - F.coalesce("_v", F.col("v_empty"))).alias("phi"))


def edge_scores(effects: DataFrame, phi: DataFrame) -> DataFrame:
    """Per target of phi (target, parent, phi): |phi_src| ce into the target, |phi_src| |phi_dst| ce elsewhere."""
    own = phi.select("target", "parent", "phi")
    into = own.join(effects, (effects.dst == own.target) & (effects.src == own.parent)).select("target", "src", "dst", (F.abs("phi") * F.col("ce")).alias("score"))
    a, b = own.toDF("target", "src", "_ps"), own.toDF("target", "dst", "_pd")
    among = a.join(effects, "src").join(b, ["target", "dst"]).where("dst <> target").select("target", "src", "dst", (F.abs("_ps") * F.abs("_pd") * F.col("ce")).alias("score"))
    return into.unionByName(among)


def attach_phi(chain_nodes: DataFrame, phi_add: DataFrame, phi_asym: DataFrame, readout: str) -> DataFrame:
    """phi_add against the child; phi_asym against the rolling readout: the child if it has the
    readout type, else the node before it if that has it, else none. Missing parents count 0."""
    by = Window.partitionBy("target").orderBy("pos")
    rows = chain_nodes.select(
        "*", F.lag("id", 1).over(by).alias("_child"), F.lag("node_type", 1).over(by).alias("_child_type"),
        F.lag("id", 2).over(by).alias("_before"), F.lag("node_type", 2).over(by).alias("_before_type"),
    )
    read = F.when(F.col("_child_type") == readout, F.col("_child")).when(F.col("_before_type") == readout, F.col("_before"))
    rows = rows.withColumn("_read", read)
    add = phi_add.select(F.col("target").alias("_child"), F.col("parent").alias("id"), F.col("phi").alias("_add"))
    asym = phi_asym.select(F.col("target").alias("_read"), F.col("parent").alias("id"), F.col("phi").alias("_asym"))
    rows = rows.join(add, ["_child", "id"], "left").join(asym, ["_read", "id"], "left")
    return rows.select(
        *chain_nodes.columns, F.when(F.col("pos") > 0, F.coalesce("_add", F.lit(0.0))).alias("phi_add"),
        F.when((F.col("pos") > 0) & F.col("_read").isNotNull(), F.coalesce("_asym", F.lit(0.0))).alias("phi_asym"),
    )


def chain_pivot(chain_nodes: DataFrame) -> DataFrame:
    """The node of the largest |phi_asym| over 0 of each chain, the first among equals."""
    rows = chain_nodes.where(F.abs("phi_asym") > 0)
    best = F.max_by(F.struct("id", "pos", "node_type"), F.struct(F.abs("phi_asym"), -F.col("pos")))
    return rows.groupBy("target").agg(best.alias("b")).select("target", F.col("b.id").alias("pivot"), F.col("b.pos").alias("pos"), F.col("b.node_type").alias("node_type"))


def phi_drift(edges: DataFrame, plain: DataFrame, noisy: DataFrame, phi: DataFrame | None = None) -> DataFrame:
    """By sigma: mean and spread of |change of phi| over parents and draws. plain: id, p (the model's
    value of a cause); noisy: id, sigma, draw, p. The baseline cancels out of the change.

    With phi (target, parent, phi), also the mean change at the pivot of each target, the parent of
    the largest |phi|, absolute (`pivot`) and over |phi| (`pivot_relative`)."""
    pairs = edges.select("src", "dst").distinct()
    own = pairs.join(n_parents(pairs), "dst")
    change = noisy.join(plain.select("id", F.col("p").alias("_p")), "id").select(F.col("id").alias("src"), "sigma", "draw", (F.col("p") - F.col("_p")).alias("d"))
    drift = own.join(change, "src").select("src", "dst", "sigma", (F.abs("d") / F.col("n")).alias("drift"))
    means = [F.avg("drift").alias("mean"), F.stddev_pop("drift").alias("std"), F.count("*").alias("n")]
    if phi is None:
        return drift.groupBy("sigma").agg(*means)
    pivot = phi.groupBy(F.col("target").alias("dst")).agg(F.min_by(F.struct("parent", "phi"), F.struct(-F.abs("phi"), F.col("parent"))).alias("b")).select("dst", F.col("b.parent").alias("src"), F.abs("b.phi").alias("_size"))
    drift = drift.join(pivot, ["dst", "src"], "left")
    at_pivot = F.when(F.col("_size").isNotNull(), F.col("drift"))
    return drift.groupBy("sigma").agg(*means, F.avg(at_pivot).alias("pivot"), F.avg(at_pivot / (F.col("_size") + 1e-8)).alias("pivot_relative"))


def explained_sets(chains: dict[str, DataFrame]) -> DataFrame:
    """mode, target, node: the chains of each explainer, as sets."""
    parts = [found.select(F.lit(mode).alias("mode"), "target", F.explode("chain").alias("node")).distinct() for mode, found in chains.items()]
    return reduce(DataFrame.unionByName, parts)


def _weighted(weights: dict[str, float]):
    return sum(F.lit(w) * F.col(c) for c, w in weights.items())


def _sigmoid(x):
    return 1 / (1 + F.exp(-x))


#: A readout: weights of the features of a node itself, of its parents, of their parents, and so on.
Layers = list[dict[str, float]]


def _fed_by(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src <> dst").distinct()


def all_messages(edges: DataFrame, features: DataFrame, layers: Layers) -> list[DataFrame]:
    """id, m for the layers 1, 2, ...: the weighted features of a node at that layer and the mean of
    what its parents give it from the next one.

    The readout is logistic in the target's features and in means over its parents, their parents
    and so on, so linear inside; a node gives one number however wide what feeds it is, and a round
    per layer over all edges works out all of them."""
    pairs, found = _fed_by(edges), []
    for weights in reversed(layers[1:]):
        own = features.select("id", _weighted(weights).alias("m"))
        if found:
            fed = pairs.join(found[0].toDF("src", "_m"), "src").groupBy(F.col("dst").alias("id")).agg(F.avg("_m").alias("_m"))
            own = own.join(fed, "id", "left").select("id", (F.col("m") + F.coalesce("_m", F.lit(0.0))).alias("m"))
        found.insert(0, written(own, "messages"))
    return found


def messages(edges: DataFrame, features: DataFrame, layers: Layers) -> DataFrame:
    """id, m of layer 1: what a node gives those it feeds."""
    return all_messages(edges, features, layers)[0]


def first_hits(starts: DataFrame, edges: DataFrame, features: DataFrame, hops: int) -> DataFrame:
    """start, id, hop, share: what part of the mean that a node takes over paths of `hop` edges comes from the
    start, paths that meet it before left out; the start itself at hop 0."""
    pairs = _fed_by(edges).join(features.select(F.col("id").alias("src")), "src", "left_semi")
    pairs = written(pairs.join(n_parents(pairs), "dst"), "weighted-edges")
    newest = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("hop"), F.lit(1.0).alias("share")).distinct()
    found = newest
    for hop in range(1, hops + 1):
        step = newest.join(pairs, F.col("id") == F.col("src")).where("dst <> start").groupBy("start", "dst").agg(F.sum(F.col("share") / F.col("n")).alias("share"))
        newest = written(step.select("start", F.col("dst").alias("id"), F.lit(hop).alias("hop"), "share"), "first-hits")
        found = found.unionByName(newest)
    return found


def coalition_values(coalitions: DataFrame, edges: DataFrame, features: DataFrame, layers: Layers, intercept: float, readouts: DataFrame | None = None) -> DataFrame:
    """target, coalition, p: the readout where only the parents of the coalition feed the target; with
    readouts (target, readout), target, readout, coalition, p: read at another node.

    coalitions: target, coalition, parent, one row per kept edge (parent null: the empty set). A parent
    without features is left out, a readout without features has no row, repeated rows count once.

    The edges that are cut are cut wherever the target is met. What a coalition changes in what the
    target takes at a layer is worked out from the last layer to the first; it reaches a readout, and
    by way of a cycle the target's own parents, by the share of the paths between. A readout further
    off than the layers go, or off all paths, keeps its value for any coalition."""
    depth = len(layers)
    given = reduce(lambda a, b: a.join(b, "id"), [m.toDF("id", f"m{k}") for k, m in enumerate(all_messages(edges, features, layers), 1)])
    given = written(given, "layer-messages")
    sets = coalitions.select("target", "coalition", "parent").distinct()
    asked = sets.select("target").distinct()
    others = readouts.select("target", "readout").distinct() if readouts is not None else asked.select("target", F.col("target").alias("readout"))
    hits = first_hits(asked.withColumnRenamed("target", "start"), edges, features, max(0, depth - (2 if readouts is not None else 3)))
    taken = [F.coalesce(F.avg(f"m{k}"), F.lit(0.0)).alias(f"m{k}") for k in range(1, depth)]
    back = range(1, max(1, depth - 2))
    near = hits.where((F.col("hop") > 0) & (F.col("hop") < depth - 2)).groupBy(F.col("start").alias("target"), F.col("id").alias("parent")).agg(F.max("hop").alias("_any"), *[F.sum(F.when(F.col("hop") == k, F.col("share"))).alias(f"_c{k}") for k in back])
    kept = sets.join(given.withColumnRenamed("id", "parent"), "parent", "left").join(near, ["target", "parent"], "left")
    # A parent without features is no part of the means.
    part = [F.coalesce(F.avg(F.when(F.col("m1").isNotNull(), F.coalesce(f"_c{k}", F.lit(0.0)))), F.lit(0.0)).alias(f"c{k}") for k in back]
    kept = kept.groupBy("target", "coalition").agg(*taken, *part)
    whole = _fed_by(edges).join(asked.withColumnRenamed("target", "dst"), "dst", "left_semi").join(given.withColumnRenamed("id", "src"), "src")
    whole = whole.groupBy(F.col("dst").alias("target")).agg(*[F.avg(f"m{k}").alias(f"all{k}") for k in range(1, depth)])
    rows = kept.join(whole, "target", "left")
    for layer in range(depth - 2, -1, -1):
        change = F.col(f"m{layer + 1}") - F.coalesce(f"all{layer + 1}", F.lit(0.0))
        for k in range(1, depth - 2 - layer):
            change = change + F.col(f"c{k}") * F.col(f"d{layer + 1 + k}")
        rows = rows.withColumn(f"d{layer}", change)
    changes = F.array(*[F.col(f"d{k}") for k in range(depth - 1)])
    inside = _inside(others.select(F.col("readout").alias("target")).distinct(), edges, features, layers, intercept).select(F.col("target").alias("readout"), "z")
    # The share of a target without features is none, as it feeds nobody.
    reach = hits.where((F.col("hop") == 0) | (F.col("hop") < depth - 1)).select(F.col("start").alias("target"), F.col("id").alias("readout"), "hop", "share")
    moved = others.join(reach, ["target", "readout"]).join(rows.select("target", "coalition", changes.alias("_d")), "target")
    moved = moved.groupBy("target", "readout", "coalition").agg(F.sum(F.col("share") * F.get("_d", F.col("hop"))).alias("_moved"))
    found = others.join(rows.select("target", "coalition"), "target").join(inside, "readout").join(moved, ["target", "readout", "coalition"], "left")
    found = found.select("target", "readout", "coalition", _sigmoid(F.col("z") + F.coalesce("_moved", F.lit(0.0))).alias("p"))
    return found if readouts is not None else found.drop("readout")


def _inside(targets: DataFrame, edges: DataFrame, features: DataFrame, layers: Layers, intercept: float) -> DataFrame:
    """target, n (parents with features), z: the inside of the readout with all parents."""
    given = messages(edges, features, layers).toDF("src", "_near")
    fed = edges.select("src", F.col("dst").alias("target")).where("src <> target").distinct().join(targets.select("target").distinct(), "target", "left_semi").join(given, "src")
    fed = fed.groupBy("target").agg(F.count("*").alias("n"), F.avg("_near").alias("_near"))
    base = features.select(F.col("id").alias("target"), (F.lit(intercept) + _weighted(layers[0])).alias("_own"))
    rows = targets.select("target").distinct().join(base, "target").join(fed, "target", "left")
    return rows.select("target", F.coalesce("n", F.lit(0)).alias("n"), (F.col("_own") + F.coalesce("_near", F.lit(0.0))).alias("z"))


def readout(targets: DataFrame, edges: DataFrame, features: DataFrame, layers: Layers, intercept: float) -> DataFrame:
    """target, n (parents with features), p: the readout with all parents."""
    return _inside(targets, edges, features, layers, intercept).select("target", "n", _sigmoid(F.col("z")).alias("p"))


def shares(targets: DataFrame, edges: DataFrame, features: DataFrame, layers: int) -> DataFrame:
    """target, id, hop, share: what part of the mean of each layer is a node's, over all paths of that length.

    The receptive field of each target: a node within `layers` hops has a row per number of hops."""
    known = features.select("id")
    pairs = edges.select("src", "dst").where("src <> dst").distinct().join(known.toDF("src"), "src", "left_semi")
    pairs = written(pairs.join(n_parents(pairs), "dst"), "weighted-edges")
    newest = targets.select("target", F.col("target").alias("id"), F.lit(0).alias("hop"), F.lit(1.0).alias("share")).distinct()
    found = newest
    for hop in range(1, layers + 1):
        step = newest.join(pairs, F.col("id") == F.col("dst")).groupBy("target", "src").agg(F.sum(F.col("share") / F.col("n")).alias("share"))
        newest = written(step.select("target", F.col("src").alias("id"), F.lit(hop).alias("hop"), "share"), "shares")
        found = found.unionByName(newest)
    return found


def _slopes(field: DataFrame, features: DataFrame, layers: Layers) -> DataFrame:
    """target, id, feature, part: what a feature of a node adds to the readout's inside, over all layers."""
    weights = F.array(*[F.array(*[F.lit(layer.get(c, 0.0)) for layer in layers]) for c in layers[0]])
    each = field.select("target", "id", "hop", "share", F.posexplode(weights).alias("_f", "_w"))
    each = each.groupBy("target", "id", "_f").agg(F.sum(F.col("share") * F.get("_w", F.col("hop"))).alias("slope"))
    values = features.select("id", F.posexplode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("x")) for c in layers[0]])).alias("_f", "v"))
    return each.join(values, ["id", "_f"]).select("target", "id", "v.feature", (F.col("slope") * F.col("v.x")).alias("part"))


def feature_effects(
    pairs: DataFrame, edges: DataFrame, features: DataFrame, layers: Layers, intercept: float, shortlist: int = 20, top: int = 12
) -> DataFrame:
    """target, pivot, feature, value, saliency, method: what setting one feature of the pivot to 0
    takes from the readout of the target, at any number of hops that the readout has layers for.
    The `shortlist` features of the largest saliency are tried, the `top` of the largest |value|
    kept; where every |value| is below 1e-5, saliency is the value (`saliency_fallback`). No rows
    if the pivot neither is nor feeds the target."""
    pairs = pairs.select("target", "pivot").distinct()
    scored = readout(pairs, edges, features, layers, intercept)
    field = shares(pairs, edges, features, len(layers) - 1).join(pairs.withColumnRenamed("pivot", "id"), ["target", "id"], "left_semi")
    rows = _slopes(field, features, layers).join(scored, "target").withColumnRenamed("id", "pivot")
    rows = rows.select("target", "pivot", "feature", "part", "p", (F.col("p") * (1 - F.col("p")) * F.col("part")).alias("saliency"), (F.col("p") - _sigmoid(F.ln(F.col("p") / (1 - F.col("p"))) - F.col("part"))).alias("value"))
    # A pair has a row per feature, so its windows are as small as the list of features.
    pair = Window.partitionBy("target", "pivot")
    rows = rows.withColumn("_rn", F.row_number().over(pair.orderBy(F.desc(F.abs("saliency")), "feature"))).where(F.col("_rn") <= shortlist)
    weak = F.max(F.abs("value")).over(pair) < 1e-5
    rows = rows.withColumn("method", F.when(weak, "saliency_fallback").otherwise("effect")).withColumn("value", F.when(weak, F.col("saliency")).otherwise(F.col("value")))
    rows = rows.withColumn("_rn", F.row_number().over(pair.orderBy(F.desc(F.abs("value")), "feature"))).where(F.col("_rn") <= top)
    return rows.select("target", "pivot", "feature", "value", "saliency", "method")


def saliency(targets: DataFrame, edges: DataFrame, features: DataFrame, layers: Layers, intercept: float) -> DataFrame:
    """target, id, saliency: length of features times gradient over the receptive field, in closed
    form, as the readout is logistic. Other nodes would have 0 and get no row."""
    scored = readout(targets, edges, features, layers, intercept)
    parts = _slopes(shares(targets, edges, features, len(layers) - 1), features, layers)
    sizes = parts.groupBy("target", "id").agg(F.sqrt(F.sum(F.col("part") * F.col("part"))).alias("size"))
    return sizes.join(scored, "target").select("target", "id", (F.col("p") * (1 - F.col("p")) * F.col("size")).alias("saliency"))


def explained_parents(targets: DataFrame, phis: dict[str, DataFrame]) -> DataFrame:
    """target, explainer, parent, phi: a row for every parent of a target and each explainer of `phis` (target, parent, phi)."""
    wanted = targets.select("target").distinct()
    parts = [phi.join(wanted, "target", "left_semi").select("target", F.lit(name).alias("explainer"), "parent", "phi") for name, phi in phis.items()]
    return reduce(DataFrame.unionByName, parts)


def explain_targets(targets: DataFrame, scored: DataFrame, phis: dict[str, DataFrame], chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, parents) of a set of nodes.

    parents: target, explainer, parent, phi, a row for every parent of a target and each explainer of
    `phis` (target, parent, phi). summary: for each target and ranked chain p and n of the readout,
    the chain with its score, and by explainer the sum of |phi| over all parents (`sum_<explainer>`,
    0 without parents)."""
    wanted = targets.select("target").distinct()
    parents = written(explained_parents(targets, phis), "explained-parents")
    sums = parents.groupBy("target").agg(*[F.sum(F.when(F.col("explainer") == name, F.abs("phi"))).alias(f"sum_{name}") for name in phis])
    told = scored.join(wanted, "target", "left_semi").join(sums, "target", "left").na.fill(0.0, [f"sum_{name}" for name in phis])
    return told.join(chains.select("target", "rank", "chain", "score"), "target"), parents
