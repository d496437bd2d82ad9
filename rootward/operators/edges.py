"""Edge tables: relations, the time rule, filters, levels, degrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.functions.tables import written
from rootward.operators.nodes import global_ids

RELATIONS = {"addr_tx": ("wallet", "sends", "transaction"), "tx_addr": ("transaction", "pays", "wallet"), "tx_tx": ("transaction", "flows_to", "transaction"), "addr_addr": ("wallet", "connects", "wallet")}
BLOCKED = ("wallet__to__wallet", "address__to__address")


def timed_edges(tables: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """src_type, src, rel, dst_type, dst, edge_type, src_time, dst_time; edges with an unknown end go.

    One join per end tells both whether the end is known and its time."""
    parts = []
    for name, (a, rel, b) in RELATIONS.items():
        parts.append(tables[name].select(F.lit(a).alias("src_type"), "src", F.lit(rel).alias("rel"), F.lit(b).alias("dst_type"), "dst", F.lit(f"{a}__to__{b}").alias("edge_type")))
    every = reduce(DataFrame.unionByName, parts)
    known = F.when(F.col("time") >= 0, F.col("time"))
    ends = lambda c: nodes.select(F.col("node_type").alias(f"{c}_type"), F.col("id").alias(c), known.alias(f"{c}_time"))
    return every.join(ends("src"), ["src_type", "src"]).join(ends("dst"), ["dst_type", "dst"]).select(*every.columns, "src_time", "dst_time")


def build_edges(tables: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """src_type, src, rel, dst_type, dst, edge_type; edges with an unknown end go."""
    return timed_edges(tables, nodes).drop("src_time", "dst_time")


def edge_type_filter(edges: DataFrame, drop: tuple[str, ...] | None = BLOCKED, keep: tuple[str, ...] = ()) -> DataFrame:
    found = edges.where(~F.col("edge_type").isin(*drop)) if drop else edges
    return found.where(F.col("edge_type").isin(*keep)) if keep else found


def _timed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    if {"src_time", "dst_time"} <= set(edges.columns):
        return edges
    times = nodes.select("id", F.when(F.col("time") >= 0, F.col("time")).alias("time"))
    found = edges.join(times.select(F.col("id").alias("src"), F.col("time").alias("src_time")), "src")
    return found.join(times.select(F.col("id").alias("dst"), F.col("time").alias("dst_time")), "dst")


def causal_edges(edges: DataFrame, nodes: DataFrame, blocked: tuple[str, ...] | None = BLOCKED) -> DataFrame:
    """One row per (src, dst): both ends known, type not blocked, no cause later than its effect.

    Edges that carry the times of their ends (`timed_edges`) are not joined to nodes again."""
    late = (F.col("src_time") > F.col("dst_time")) & F.col("src_time").isNotNull() & F.col("dst_time").isNotNull()
    kept = _timed(edge_type_filter(edges, blocked), nodes).where(~F.coalesce(late, F.lit(False)))
    return kept.groupBy("src", "dst").agg(F.min("edge_type").alias("edge_type"))


def causal_audit(edges: DataFrame, nodes: DataFrame, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """blocked, rejected and kept rows."""
    is_blocked = F.col("edge_type").isin(*blocked)
    late = F.coalesce(F.col("src_time") > F.col("dst_time"), F.lit(False))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return _timed(edges, nodes).agg(count(is_blocked).alias("blocked"), count(~is_blocked & late).alias("rejected"), count(~is_blocked & ~late).alias("kept"))


def parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n_parents"))


def children(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n_children"))


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def _without_shortcuts(pairs: DataFrame, few: int = 8) -> DataFrame:
    """pairs without those that a path of two edges stands beside, the middle one having `few` parents at most
    and the smaller id of the two parents.

    Levels stay, and what has one parent besides an ancestor of it has that parent only. Of parents on
    a cycle each has a path over another; as a parent goes only for one with a smaller id, one of them is
    left, so that nodes behind a cycle stay there. The bound keeps the paths of two edges to `few` times the
    edges; pairs that bound and order leave in are only more work."""
    middle = pairs.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") <= few).select(F.col("dst").alias("b"))
    into = pairs.where("src > dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(middle, "b", "left_semi")
    two = into.join(pairs.select(F.col("src").alias("b"), F.col("dst").alias("c")).where("b <> c"), "b").where("a <> c").select(F.col("a").alias("src"), F.col("c").alias("dst")).distinct()
    return pairs.join(two, ["src", "dst"], "left_anti")


def _heads(single: DataFrame, n: int) -> DataFrame:
    """id, head, up: how many single parents above each node the first node is that has none or several;
    nodes without such a head, which are on or behind a cycle of single parents, have no row.

    single: id, parent. Pointers double, so a run of length L takes log2(L) rounds."""
    ways = written(single.select("id", F.col("parent").alias("at"), F.lit(1).alias("up")), "single-parents")
    ended = ways.limit(0)
    going = ways
    for _ in range(n.bit_length() + 1):
        beyond = ways.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("up").alias("_up"))
        step = written(going.join(beyond, "at", "left"), "doubled")
        stopped = step.where("_at IS NULL").select("id", "at", "up")
        ended = ended.unionByName(stopped)
        going = step.where("_at IS NOT NULL").select("id", F.col("_at").alias("at"), (F.col("up") + F.col("_up")).alias("up"))
        if going.isEmpty():
            break
        ways = going.unionByName(ended)
    return ended.select("id", F.col("at").alias("head"), "up")


def topological_levels(nodes: DataFrame, edges: DataFrame, every: int = 6) -> DataFrame:
    """id, level: 0 without parents, else one more than the highest parent; null on or behind a cycle.

    Edges beside a path of two go, runs of nodes with one parent are contracted to offsets from
    their heads by pointer doubling, and rounds are made between the heads. A round meets the edges of
    the heads that became free in the last one only. What it takes from in-degrees is added to a list,
    which is summed up for the nodes that it touches, and as a whole every few rounds. Rounds end
    when no head becomes free, however many there are."""
    ids = nodes.select("id").distinct()
    pairs = written(_without_shortcuts(written(edges.select("src", "dst").distinct(), "pairs")), "pairs")
    degrees = written(pairs.groupBy("dst").agg(F.count("*").alias("n")), "degrees")
    single = pairs.join(degrees.where("n = 1").select("dst"), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    runs = written(_heads(single, degrees.count()), "runs")
    # A parent within a run stands for its head; one without a head is kept, and never free.
    far = runs.select(F.col("id").alias("src"), "head", "up")
    bound = pairs.join(degrees.where("n > 1").select("dst"), "dst", "left_semi").join(far, "src", "left")
    bound = bound.select(F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("up", F.lit(0)) + 1).alias("rise"))
    bound = written(bound.groupBy("src", "dst").agg(F.max("rise").alias("rise")), "contracted")
    left = written(bound.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).withColumn("level", F.lit(0)), "degrees")
    # Ends of edges that are no nodes can hold levels up or down as well.
    every_id = written(ids.union(pairs.select("src")).union(pairs.select("dst")).distinct(), "ids")
    free = written(every_id.join(degrees.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("level")), "level")
    done, turn = free, 0
    while not free.isEmpty():
        turn += 1
        taken = bound.join(free.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg((-F.count("*")).alias("n"), F.max(F.col("level") + F.col("rise")).alias("level"))
        taken = written(taken, "taken")
        left = left.unionByName(taken)
        rest = left.join(taken.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("n").alias("n"), F.max("level").alias("level"))
        free = written(rest.where("n = 0").select("id", "level"), "level")
        done = done.unionByName(free)
        if turn % every == 0:
            left = written(left.groupBy("id").agg(F.sum("n").alias("n"), F.max("level").alias("level")).where("n > 0"), "degrees")
            done = written(done, "levels")
    inner = runs.join(done.withColumnRenamed("id", "head"), "head").select("id", (F.col("level") + F.col("up")).alias("level"))
    return ids.join(done.unionByName(inner), "id", "left")


def edge_direction(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, pos_a, b, pos_b): the direction of a known edge, else from the higher position down."""
    known = edges.select("src", "dst").distinct().withColumn("_hit", F.lit(True))
    found = pairs.join(known.toDF("a", "b", "_ab"), ["a", "b"], "left").join(known.toDF("b", "a", "_ba"), ["a", "b"], "left")
    forward = F.when(F.col("_ab"), True).when(F.col("_ba"), False).otherwise(F.col("pos_a") > F.col("pos_b"))
    return found.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("dst"))


def negative_edges(edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, seed: int = 42) -> DataFrame:
    """Edges labelled 1 and as many pairs of their ends' types labelled 0, drawn by an arithmetic key
    of the edge's own numbers; a drawn pair may be an edge."""
    numbered = lambda df: global_ids(df.select(F.lit("").alias("node_type"), "id", "num").distinct()).select("id", F.col("global_id").alias("i"))
    a, b = written(numbered(src_nodes), "src-numbers"), written(numbered(dst_nodes), "dst-numbers")
    n_a, n_b = a.count(), b.count()
    own = edges.join(a.toDF("src", "_i"), "src").join(b.toDF("dst", "_j"), "dst")
    draw = lambda p, q, n: F.pmod(F.col("_i") * F.lit(p).cast("long") + F.col("_j") * F.lit(q).cast("long") + F.lit(seed).cast("long") * 40503, F.lit(max(1, n)).cast("long"))
    drawn = own.select(draw(7919, 104729, n_a).alias("_a"), draw(15485863, 32452843, n_b).alias("_b"))
    wrong = drawn.join(a.toDF("src", "_a"), "_a").join(b.toDF("dst", "_b"), "_b").select("src", "dst", F.lit(0).alias("label"))
    return edges.select("src", "dst", F.lit(1).alias("label")).unionByName(wrong)


def indegree(nodes: DataFrame, tables: dict[str, DataFrame], all_edges: bool = False) -> DataFrame:
    """id, node_type, indegree by multiplicity, nodes without any included."""
    into = [tables["addr_tx"].select(F.col("dst").alias("id")), tables["tx_addr"].select(F.col("dst").alias("id"))]
    if all_edges:
        into += [tables["tx_tx"].select(F.col("dst").alias("id")), tables["addr_addr"].select(F.col("dst").alias("id"))]
    counts = reduce(DataFrame.unionAll, into).groupBy("id").agg(F.count("*").alias("n"))
    return nodes.select("id", "node_type").join(counts, "id", "left").select("id", "node_type", F.coalesce("n", F.lit(0)).alias("indegree"))


def indegree_thresholds(degrees: DataFrame, q: float = 0.95) -> DataFrame:
    return degrees.groupBy("node_type").agg(F.percentile("indegree", F.lit(q)).alias("threshold"))
