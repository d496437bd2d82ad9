"""Chain records and analytics over them.

Chain nodes are the exploded form: target, pos (0 is the target), depth, id, node_type,
time, fraud, ce (against the node before, null at the target) and, where shares were
attached, phi_add and phi_asym. Chosen chains are a table of their targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootward.operators.trace import chain_pairs


def chain_nodes(chains: DataFrame, nodes: DataFrame, effects: DataFrame) -> DataFrame:
    """One row per chain node, decoded; ce is 0 where an edge has none."""
    rows = chains.select("target", "depth", F.posexplode("chain").alias("pos", "id"))
    known = nodes.select("id", "node_type", "time", (F.col("class") == 1).alias("fraud"))
    pairs = chain_pairs(chains).join(effects.select(F.col("src").alias("parent"), F.col("dst").alias("child"), "ce"), ["parent", "child"], "left")
    pairs = pairs.select("target", "pos", F.coalesce("ce", F.lit(0.0)).alias("ce"))
    found = rows.join(known, "id", "left").join(pairs, ["target", "pos"], "left")
    return found.select("target", "pos", "depth", "id", "node_type", "time", F.coalesce("fraud", F.lit(False)).alias("fraud"), "ce")


def chain_records(cn: DataFrame, illicit: DataFrame) -> DataFrame:
    """One row per chain with its nodes as an array of structs, in order."""
    phi = [F.col(c) if c in cn.columns else F.lit(None).cast("double").alias(c) for c in ("phi_add", "phi_asym")]
    node = F.struct("pos", "id", "node_type", "time", "fraud", (F.col("pos") == 0).alias("is_target"), "ce", *phi)
    rows = cn.groupBy("target").agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.max("depth").alias("depth"))
    last = F.element_at("nodes", -1)
    rows = rows.join(illicit.select(F.col("id").alias("target")).distinct().withColumn("_t", F.lit(True)), "target", "left")
    return rows.select("target", "depth", last["node_type"].alias("root_type"), last["id"].alias("root"), last["fraud"].alias("root_is_fraud"), F.coalesce("_t", F.lit(False)).alias("is_true_positive"), "nodes")


def rank_chains(records: DataFrame, n: int) -> DataFrame:
    return records.orderBy(F.desc("is_true_positive"), F.desc("root_is_fraud"), F.desc("depth"), "target").limit(n)


def merged_links(cn: DataFrame) -> DataFrame:
    """parent, child, ce of the first chain, multiplicity."""
    by = Window.partitionBy("target").orderBy("pos")
    pairs = cn.select("target", F.col("id").alias("parent"), F.lag("id").over(by).alias("child"), F.coalesce("ce", F.lit(0.0)).alias("ce")).where("child IS NOT NULL")
    return pairs.groupBy("parent", "child").agg(F.min_by("ce", "target").alias("ce"), F.count("*").alias("multiplicity"))


def merged_nodes(cn: DataFrame) -> DataFrame:
    """One row per node over all chains: ever a target, ever a root, largest |phi_asym| (0 without
    any), weighted degree; attributes from its first sight, by target and place."""
    links = merged_links(cn)
    degree = links.select(F.col("parent").alias("id"), "multiplicity").unionAll(links.select(F.col("child").alias("id"), "multiplicity")).groupBy("id").agg(F.sum("multiplicity").alias("degree"))
    first = F.min_by(F.struct("node_type", "time", "fraud"), F.struct("target", "pos")).alias("first")
    phi = F.max(F.abs("phi_asym")) if "phi_asym" in cn.columns else F.lit(None).cast("double")
    rows = cn.groupBy("id").agg(F.max(F.col("pos") == 0).alias("is_target"), F.max(F.col("pos") == F.col("depth")).alias("is_root"), first, F.coalesce(phi, F.lit(0.0)).alias("phi_asym"))
    return rows.join(degree, "id", "left").select("id", "is_target", "is_root", "first.*", "phi_asym", F.coalesce("degree", F.lit(0)).alias("degree"))


def time_bounds(cn: DataFrame) -> DataFrame:
    known = F.when(F.col("time") >= 0, F.col("time"))
    return cn.agg(F.coalesce(F.min(known), F.lit(0)).alias("min_time"), F.coalesce(F.max(known), F.lit(0)).alias("max_time"))


def top_roots(chains: DataFrame, k: int = 15) -> DataFrame:
    """Roots shared by two chains or more, the most shared first, and a row per chain of each:
    root, n, rank, target. The chains of a root are rows, not a list, since there may be any number."""
    counts = chains.groupBy("root").agg(F.count("*").alias("n")).where("n >= 2")
    best = counts.orderBy(F.desc("n"), "root").limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "root")))  # k rows
    return chains.select("root", "target").join(F.broadcast(ranked), "root").select("root", "n", "rank", "target")


def chain_stats(chains: DataFrame, nodes: DataFrame, pivots: DataFrame) -> DataFrame:
    """One row; pivots as of `chain_pivot`, so chains without a share have none."""
    kinds = nodes.select(F.col("id").alias("root"), F.col("node_type").alias("root_type"))
    fan = chains.groupBy("root").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_fan_in"))
    own = chains.join(kinds, "root", "left").join(pivots.select("target", F.col("node_type").alias("pivot_type"), F.col("pos").alias("pivot_pos")), "target", "left")
    share = lambda c, of: F.round(F.sum(F.when(c, 1).otherwise(0)) / of, 6)
    got = F.count("pivot_type")
    stats = own.agg(
        F.count("*").alias("n"), got.alias("n_phi"), share(F.col("pivot_type") == "wallet", got).alias("pivot_wallet"), share(F.col("pivot_pos") >= 2, got).alias("pivot_far"),
        share(F.col("root_type") == "wallet", F.count("*")).alias("root_wallet"), F.round(F.avg("depth"), 6).alias("mean_depth"),
    )
    return stats.join(F.broadcast(fan), F.lit(True))  # one row each


def has_phi() -> Column:
    return F.exists("nodes", lambda n: n["phi_asym"].isNotNull())


def search_chains(records: DataFrame, text: str, fraud_only: bool = False, only_phi: bool = False) -> DataFrame:
    """Chains whose target, root or root type holds the text in any case; an empty text matches all."""
    wanted = text.strip().lower()
    found = records.where(reduce(Column.__or__, [F.lower(c).contains(wanted) for c in ("target", "root", "root_type")]))
    found = found.where("root_is_fraud") if fraud_only else found
    return found.where(has_phi()) if only_phi else found


def phi_coverage(records: DataFrame) -> DataFrame:
    """n, n_phi (chains with a share) and percent, rounded to whole numbers."""
    rows = records.agg(F.count("*").alias("n"), F.count(F.when(has_phi(), 1)).alias("n_phi"))
    return rows.select("n", "n_phi", F.when(F.col("n") > 0, F.round(100.0 * F.col("n_phi") / F.col("n"))).otherwise(0.0).cast("int").alias("percent"))


def chain_sets(cn: DataFrame, picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct node ids, and distinct links (parent, child), of the chosen chains."""
    own = cn.join(picked.select("target").distinct(), "target", "left_semi")
    return own.select("id").distinct(), merged_links(own).select("parent", "child")


def _of_types(nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*types)) if types else nodes


def visible_subgraph(cn: DataFrame, picked: DataFrame, cap: int = 250, types: tuple[str, ...] = (), neighbours: bool = True, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node_type, boundary, truncated) and links (parent, child, ce) of the graph that all
    chains make, around the chosen ones: their nodes and, on request, up to cap nodes one link away,
    by id; or everything. Only nodes of the types given, if any; of links among those kept the
    chosen chains' own, and with neighbours all that touch a chosen chain."""
    merged = merged_links(cn)
    kinds = merged_nodes(cn).select("id", "node_type")
    ids, own = chain_sets(cn, picked)
    inside = ids.withColumn("boundary", F.lit(False))
    truncated = False
    if everything:
        inside = kinds.select("id").join(ids.withColumn("_own", F.lit(True)), "id", "left").select("id", F.col("_own").isNull().alias("boundary"))
    elif neighbours:
        ends = lambda c: ids.select(F.col("id").alias(c))
        near = merged.join(ends("parent"), "parent", "left_semi").select(F.col("child").alias("id")).union(merged.join(ends("child"), "child", "left_semi").select(F.col("parent").alias("id")))
        around = near.distinct().join(ids, "id", "left_anti")
        truncated = around.count() > cap
        inside = inside.unionByName(around.orderBy("id").limit(cap).withColumn("boundary", F.lit(True)))
    nodes = _of_types(inside.join(kinds, "id"), types).select("id", "node_type", "boundary", F.lit(truncated).alias("truncated"))
    end = lambda c: nodes.select(F.col("id").alias(c), F.col("boundary").alias(f"_{c}"))
    links = merged.join(end("parent"), "parent").join(end("child"), "child").join(own.withColumn("_own", F.lit(True)), ["parent", "child"], "left")
    touches = F.col("_own").isNotNull() | F.lit(everything) | (F.lit(neighbours) & ~(F.col("_parent") & F.col("_child")))
    return nodes, links.where(touches).select("parent", "child", "ce")


def responsibility(cn: DataFrame, pivots: DataFrame) -> DataFrame:
    """From the root to the target, with is_root, is_target, is_pivot, effect and share."""
    rows = cn.join(pivots.select("target", F.col("pivot").alias("id")).withColumn("_p", F.lit(True)), ["target", "id"], "left")
    return rows.select("target", (F.col("depth") - F.col("pos")).alias("step"), "id", "node_type", "time", "phi_asym", (F.col("pos") == F.col("depth")).alias("is_root"), (F.col("pos") == 0).alias("is_target"), F.coalesce("_p", F.lit(False)).alias("is_pivot"), "ce")


def depth_buckets(chains: DataFrame, variant: Column) -> DataFrame:
    """Per variant: chains and percent at each depth, 10 standing for 10 and more."""
    rows = chains.groupBy(variant.alias("variant"), F.least("depth", F.lit(10)).alias("bucket")).agg(F.count("*").alias("n"))
    return rows.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("variant")), 6))


def variant_stats(chains: DataFrame, variant: Column, nodes: DataFrame) -> DataFrame:
    """Per variant: chains, mean depth, and roots of each type."""
    kinds = nodes.select(F.col("id").alias("root"), "node_type")
    rows = chains.join(kinds, "root", "left").groupBy(variant.alias("variant"))
    count = lambda kind: F.count(F.when(F.col("node_type") == kind, 1)).alias(f"{kind}_roots")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("depth"), 6).alias("mean_depth"), count("wallet"), count("transaction"))


#: Ends of the edge tables in the order in which their neighbours are listed.
OVERLAY = (("addr_tx", "wallet", "transaction"), ("tx_addr", "transaction", "wallet"), ("tx_tx", "transaction", "transaction"), ("addr_addr", "wallet", "wallet"))


def neighbour_overlay(ids: DataFrame, tables: dict[str, DataFrame], cap: int = 30) -> DataFrame:
    """id, degree (edges with repeats, self-loops left out), n_near (distinct neighbours) and `near`,
    up to cap of them with their types, by relation, then id. Nodes without any have no row."""
    parts = []
    for rank, (name, src_type, dst_type) in enumerate(OVERLAY):
        t = tables[name].where("src <> dst")
        parts += [t.select(F.col("src").alias("id"), F.col("dst").alias("near"), F.lit(dst_type).alias("type"), F.lit(rank).alias("rank")), t.select(F.col("dst").alias("id"), F.col("src").alias("near"), F.lit(src_type).alias("type"), F.lit(rank).alias("rank"))]
    every = reduce(DataFrame.unionAll, parts).join(ids.select("id").distinct(), "id", "left_semi")
    degree = every.groupBy("id").agg(F.count("*").alias("degree"))
    distinct = every.groupBy("id", "near", "type").agg(F.min("rank").alias("rank"))
    by = Window.partitionBy("id").orderBy("rank", "near")
    first = distinct.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= cap)
    listed = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "near", "type"))), lambda x: F.struct(x["near"].alias("id"), x["type"].alias("node_type"))).alias("near"))
    return degree.join(distinct.groupBy("id").agg(F.count("*").alias("n_near")), "id").join(listed, "id")


def overlay_meta(ids: DataFrame, overlay: DataFrame, cap: int = 30) -> DataFrame:
    """n_nodes asked for, n_with_neighbours, n_listed neighbours and n_truncated nodes."""
    counts = overlay.agg(F.count("*").alias("n_with_neighbours"), F.coalesce(F.sum(F.size("near")), F.lit(0)).alias("n_listed"), F.count(F.when(F.col("n_near") > cap, 1)).alias("n_truncated"))
    return ids.select("id").distinct().agg(F.count("*").alias("n_nodes")).join(counts, F.lit(True))  # one row each


def chains_to_rows(records: DataFrame) -> DataFrame:
    """The flat form: packed ids, types, effects and shares, six significant digits, the target's
    cell and unknown values empty. Columns of shares are there only if any chain has one."""
    def packed(key: str) -> Column:
        cell = lambda n: F.when((n["pos"] == 0) | n[key].isNull(), F.lit("")).otherwise(six_digits(n[key]))
        return F.concat_ws("|", F.transform("nodes", cell))

    def any_with(key: str) -> Column:
        return F.max(F.exists("nodes", lambda n: (n["pos"] > 0) & n[key].isNotNull())).alias(key)

    known = records.agg(any_with("phi_add"), any_with("phi_asym")).first()
    shares = [packed(c).alias(f"chain_{c}") for c in ("phi_add", "phi_asym") if known[c]]
    return records.select(
        F.col("target").alias("target_txid"), "depth", "root_type", F.col("root").alias("root_real_id"), "root_is_fraud", "is_true_positive", F.size("nodes").alias("n_nodes"),
        F.concat_ws("|", F.transform("nodes", lambda n: n["id"])).alias("chain_real_ids"), F.concat_ws("|", F.transform("nodes", lambda n: n["node_type"])).alias("chain_types"),
        packed("ce").alias("chain_ce"), *shares,
    )


def six_digits(x: Column) -> Column:
    """A number of at most six significant digits without trailing zeros, magnitudes 1e-4 to 1e6."""
    places = F.least(F.greatest(5 - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-4)))), F.lit(0)), F.lit(9)).cast("int")
    text = F.when(x == 0, "0").otherwise(F.format_string("%.9f", F.round(x * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places)))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def neighbour_view(cn: DataFrame, picked: DataFrame, overlay: DataFrame | None, types: tuple[str, ...] = (), cap: int = 250) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node_type, in_chain) and links (a, b): the chosen chains and the neighbours that the
    overlay lists for their nodes, each linked to the node it is listed for; without an overlay
    what `visible_subgraph` shows around them."""
    if overlay is None:
        nodes, links = visible_subgraph(cn, picked, cap, types)
        return nodes.select("id", "node_type", (~F.col("boundary")).alias("in_chain")), links.select(F.col("parent").alias("a"), F.col("child").alias("b"))
    nodes, links = visible_subgraph(cn, picked, cap, types, neighbours=False)
    own = nodes.select("id", "node_type")
    listed = overlay.join(own.select("id"), "id", "left_semi").select(F.col("id").alias("of"), F.explode("near").alias("x")).select("of", "x.id", "x.node_type")
    more = _of_types(listed, types).join(own.select("id"), "id", "left_anti")
    every = own.withColumn("in_chain", F.lit(True)).unionByName(more.select("id", "node_type").distinct().withColumn("in_chain", F.lit(False)))
    return every, links.select(F.col("parent").alias("a"), F.col("child").alias("b")).unionByName(more.select(F.col("of").alias("a"), F.col("id").alias("b")).distinct())
