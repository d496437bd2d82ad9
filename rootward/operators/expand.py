"""Bounded graph expansion and receptive fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootward.functions.tables import first_rows, frontier_loop, written
from rootward.operators.edges import BLOCKED, causal_audit, causal_edges, edge_type_filter
from rootward.operators.nodes import proportional_sample


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def _expanded(edges: DataFrame, seeds: DataFrame, hops: int, room: int) -> DataFrame:
    """id, hop: the seeds and the first `room` others by hop, then id. No hop is made after that which fills the room."""
    pairs = both_ways(edges)
    if not room:
        hops = 0
    found = frontier_loop(seeds.select("id"), lambda new: new.join(pairs, new.id == pairs.src).select(F.col("dst").alias("id")), ["id"], hops, enough=room)
    return found.where("hop = 0").unionByName(first_rows(found.where("hop > 0"), ["hop", "id"], room))


def expand(edges: DataFrame, seeds: DataFrame, hops: int, limit: int, blocked: tuple[str, ...] | None = BLOCKED) -> DataFrame:
    """id, hop within `hops` of the seeds over unblocked edges, either way. All seeds stay; the
    others fill up to `limit` by hop, then id."""
    room = max(0, limit - seeds.select("id").distinct().count())
    return _expanded(edge_type_filter(edges, blocked), seeds, hops, room)


def expand_rare(edges: DataFrame, seeds: DataFrame, hops: int, limit: int, rare: tuple[str, ...], reserve: int, rare_hops: int, blocked: tuple[str, ...] | None = BLOCKED) -> DataFrame:
    """A first expansion that leaves `reserve` places, then from all it found along rare edge types only."""
    n_seeds = seeds.select("id").distinct().count()
    main = expand(edges, seeds, hops, max(n_seeds, limit - reserve), blocked)
    main = written(main, "main-expansion")
    more = _expanded(edges.where(F.col("edge_type").isin(*rare)), main, rare_hops, max(0, limit - main.count())).where("hop > 0")
    return main.unionByName(more.select("id", (F.col("hop") + hops).alias("hop")))


def causal_subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None, hops: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes kept (expanded from seeds, or sampled by type without any), the causal edges among
    them, and one row of counts: n_nodes, n_timed, and edges blocked, rejected by time and kept."""
    ids = written(expand(edges, seeds, hops, limit).select("id") if seeds is not None else proportional_sample(nodes, limit).select("id"), "kept-ids")
    kept = nodes.join(ids, "id", "left_semi")
    inside = induced(edges, ids)
    counts = kept.agg(F.count("*").alias("n_nodes"), F.count(F.when(F.col("time") >= 0, 1)).alias("n_timed"))
    return kept, causal_edges(inside, kept), counts.join(causal_audit(inside, kept), F.lit(True))  # one row each


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def receptive_field(edges: DataFrame, targets: DataFrame, layers: int) -> DataFrame:
    """target, id, hop: incoming neighbourhood of each target over all relations, for all targets at once."""
    back = edges.select("src", "dst").distinct()
    start = targets.select("target", F.col("target").alias("id"))
    return frontier_loop(start, lambda new: new.join(back, new.id == back.dst).select("target", F.col("src").alias("id")), ["target", "id"], layers)


def induced_edges(field: DataFrame, edges: DataFrame) -> DataFrame:
    """target and the edges with both ends in the target's field."""
    ends = field.select("target", "id")
    return edges.join(ends.withColumnRenamed("id", "dst"), "dst").join(ends.withColumnRenamed("id", "src"), ["target", "src"], "left_semi")
