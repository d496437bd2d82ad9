"""Traces of small random graphs against plain walks, one target and one edge at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rootward.functions.tables import first_rows
from rootward.operators import edges as E
from rootward.operators import trace as T

NODES = [f"{kind}{i:02d}" for i in range(9) for kind in ("acc", "pay")]


def random_graph(seed, cycles=False):
    """src, dst, ce with distinct strengths; without cycles causes come before effects in NODES."""
    r = random.Random(seed)
    pairs = [(a, b) for i, a in enumerate(NODES) for b in NODES[i + 1 :] if r.random() < 0.16]
    if cycles:
        pairs += [(b, a) for a, b in r.sample(pairs, 4)]
    strengths = r.sample(range(1, 1000), len(pairs))
    return [(a, b, s / 1000 * r.choice((1, -1))) for (a, b), s in zip(pairs, strengths)]


def parents_of(rows):
    found = {}
    for a, b, ce in rows:
        found.setdefault(b, {})[a] = abs(ce)
    return found


def greedy(rows, target, hops, threshold, tier=lambda p, score: 0):
    up, chain = parents_of(rows), [target]
    while len(chain) <= hops and up.get(chain[-1]):
        best = min(up[chain[-1]].items(), key=lambda x: (tier(*x), -x[1], x[0]))
        if best[1] < threshold or best[0] in chain:
            break
        chain.append(best[0])
    return chain


def deepest_first(rows, target, hops, threshold):
    up, chain = parents_of(rows), [target]
    while len(chain) <= hops:
        open_ = [(-w, p) for p, w in up.get(chain[-1], {}).items() if w >= threshold and p not in chain]
        if not open_:
            break
        chain.append(min(open_)[1])
    return chain


def dead(rows, node, threshold):
    return all(w < threshold for w in parents_of(rows).get(node, {}).values())


def simple_paths(rows, target, hops, threshold):
    up, todo = parents_of(rows), [[target]]
    while todo:
        path = todo.pop()
        yield path
        if len(path) <= hops:
            todo += [[*path, p] for p, w in up.get(path[-1], {}).items() if w >= threshold and p not in path]


def cheapest(rows, target, hops, threshold, wanted):
    """The best end, by the least -ln product of any path to it."""
    up, least = parents_of(rows), {}
    for path in simple_paths(rows, target, hops, threshold):
        cost = sum(-math.log(up[b][a]) for b, a in zip(path, path[1:]))
        if cost < least.get(path[-1], (math.inf,))[0] - 1e-9:
            least[path[-1]] = (cost, path)
    ends = [((not dead(rows, n, threshold)) * 2 + (n not in wanted), round(c, 9), n, path) for n, (c, path) in least.items() if n != target]
    return min(ends)[3] if ends else [target]


def fewest_hops(rows, target, hops, threshold):
    up, level, seen, hop = parents_of(rows), {target}, {target}, 0
    last = target
    while level and hop < hops:
        level, hop = {p for n in level for p in up.get(n, {})} - seen, hop + 1
        seen |= level
        ends = [n for n in level if dead(rows, n, threshold)]
        if ends:
            return hop, min(ends)
        if level:
            last = (hop, min(level))
    return last if last != target else (0, target)


def beams(rows, target, k, hops, threshold):
    up, now, done = parents_of(rows), [(0.0, [target])], []
    for _ in range(hops):
        wider = []
        for score, chain in now:
            more = [(round(score + w, 9), [*chain, p]) for p, w in up.get(chain[-1], {}).items() if w >= threshold and p not in chain]
            wider += more
            done += [] if more else [(score, chain)]
        now = sorted(wider, key=lambda x: (-x[0], x[1]))[:k]
    return sorted(done + now, key=lambda x: (-x[0], x[1]))[:k]


def effects(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, ce double")


def one(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def targets(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "target string")


def chains(df):
    return {r.target: r.chain for r in df.collect()}


ENDS = [*NODES[8:], "unknown"]


@pytest.mark.parametrize("seed, cycles, hops, threshold", [(1, False, 20, 0.0001), (2, True, 20, 0.2), (3, False, 3, 0.3)])
def test_every_algorithm_by_plain_walks(spark, seed, cycles, hops, threshold):
    rows = random_graph(seed, cycles)
    e, t = effects(spark, rows), targets(spark, ENDS)
    assert chains(T.trace_greedy(t, e, hops, threshold)) == {x: greedy(rows, x, hops, threshold) for x in ENDS}
    assert chains(T.trace_dfs(t, e, hops, threshold)) == {x: deepest_first(rows, x, hops, threshold) for x in ENDS}
    wanted = {n for n in NODES if n.startswith("acc")}
    tier = lambda p, score: 0 if score >= threshold and p in wanted else 1
    assert chains(T.trace_greedy(t, e, hops, threshold, preferred=one(spark, wanted))) == {x: greedy(rows, x, hops, threshold, tier) for x in ENDS}
    found = chains(T.trace_bfs(t, e, hops, threshold))
    assert {x: (len(c) - 1, c[-1]) for x, c in found.items()} == {x: fewest_hops(rows, x, hops, threshold) for x in ENDS}
    assert all(b in parents_of(rows)[a] for c in found.values() for a, b in zip(c, c[1:]))
    want = {(x, k + 1): (s, c) for x in ENDS for k, (s, c) in enumerate(beams(rows, x, 3, hops, threshold))}
    got = {(r.target, r["rank"]): (r.score, r.chain) for r in T.trace_topk(t, e, 3, hops, threshold).collect()}
    assert got == want
    if hops > 3:  # the cap does not bind, so the relaxation has the cheapest of all paths
        best = {x: cheapest(rows, x, hops, threshold, wanted) for x in ENDS}
        assert chains(T.trace_best_path(t, e, hops, threshold, preferred=one(spark, wanted))) == best
        assert chains(T.trace(t, e, "dijkstra", max_hops=hops, threshold=threshold, preferred=one(spark, wanted))) == best


def test_caps_of_best_path_and_sums(spark):
    rows = [("m", "z", 0.5), ("k", "m", 0.9), ("h", "k", 0.8), ("h", "z", 0.1), ("z", "h", 0.7)]
    e, t = effects(spark, rows), targets(spark, ["z"])
    assert chains(T.trace_best_path(t, e, 20, 0.01)) == {"z": ["z", "m"]}  # all on a loop: no dead leaf, the cheapest node
    assert chains(T.trace_best_path(t, e, 20, 0.01, objective="sum")) == {"z": ["z", "m", "k", "h"]}
    assert chains(T.trace_best_path(t, e, 2, 0.01, objective="sum")) == {"z": ["z", "m", "k"]}
    with pytest.raises(ValueError):
        T.trace_best_path(t, e, 0)


def test_best_sums_by_nodes(spark, monkeypatch):
    """As by a row for each node that a target reaches, equal sums included; and without such rows."""
    r = random.Random(5)
    rows = [(a, b, r.choice((0.1, 0.2, -0.3))) for a, b, _ in random_graph(4)]
    e, t, wanted = effects(spark, rows), targets(spark, ENDS), one(spark, NODES[::3])
    for more in (None, wanted):
        reached = T._with_ends(t, T._heaviest_reached(t, T._strong(e, 0.0001), e, 20, 0.0001, more))
        assert chains(T.trace_best_path(t, e, 20, 0.0001, objective="sum", preferred=more)) == chains(reached)
    assert chains(T.trace_best_path(t, e, 2, 0.15, objective="sum")) == chains(T._with_ends(t, T._heaviest_reached(t, T._strong(e, 0.15), e, 2, 0.15, None)))
    n, plain = [], T.written
    monkeypatch.setattr(T, "written", lambda df, name: n.append((found := plain(df, name)).count()) or found)
    line = effects(spark, [(f"n{i}", f"n{i + 1}", 0.5) for i in range(20)])
    found = chains(T.trace_best_path(targets(spark, [f"n{i}" for i in range(21)]), line, 20, 0.0001, objective="sum"))
    assert found == {f"n{i}": [f"n{k}" for k in range(i, -1, -1)] for i in range(21)}
    assert sum(n) < 700


def test_equal_products_of_a_best_path(spark):
    """0.02 * 0.65 is 0.013: of equal costs the fewer hops are kept, though rounded logarithms add up to a unit less."""
    rows = [("e", "t", 0.013), ("a", "t", 0.02), ("e", "a", 0.65), ("t", "s", 0.5), ("f", "s", 0.001)]
    assert chains(T.trace_best_path(targets(spark, ["t", "s", "a"]), effects(spark, rows), 20, 0.0001)) == {"t": ["t", "e"], "s": ["s", "t", "e"], "a": ["a", "e"]}


def test_lookahead_leaves_a_dead_end(spark):
    """The strongest parent leads nowhere; a weaker one has the wanted kind two steps up."""
    rows = [("hub", "loss", 0.3), *[(f"stub{i}", "hub", 0.2 + i / 100) for i in range(5)], ("way", "hub", 0.05), ("relay", "way", 0.04), ("origin", "relay", 0.03)]
    e, wanted = effects(spark, rows), one(spark, ["origin"])
    t = targets(spark, ["loss"])
    by_depth = {0: ["loss", "hub", "stub4"], 1: ["loss", "hub", "stub4"], 2: ["loss", "hub", "way", "relay", "origin"]}
    for depth, want in by_depth.items():
        assert chains(T.trace_greedy(t, e, preferred=wanted, ahead=T.reachable(e, wanted, depth))) == {"loss": want}


def test_scores_of_the_caller(spark):
    rows = [("b", "a", 0.9), ("c", "a", 0.2), ("d", "c", 0.5), ("x", "w", 0.4)]
    e = effects(spark, rows)
    scores = spark.createDataFrame([("a", "a", "b", 0.1), ("a", "a", "c", 0.7), ("a", "c", "d", 0.05)], "target string, child string, parent string, score double")
    assert chains(T.trace_scored(targets(spark, ["a"]), scores)) == {"a": ["a", "c", "d"]}
    assert chains(T.trace_scored(targets(spark, ["a"]), scores, threshold=0.5)) == {"a": ["a", "c"]}
    assert chains(T.trace_scored(targets(spark, ["a"]), scores.withColumn("score", F.lit(0.01)), threshold=0.5)) == {"a": ["a"]}
    assert chains(T.trace_scored(targets(spark, ["a"]), scores, preferred=one(spark, ["b"]))) == {"a": ["a", "b"]}
    nodes = spark.createDataFrame([("a", "pay"), ("w", "acc")], "id string, node_type string")
    assert chains(T.trace_by_type(targets(spark, ["a", "w"]), nodes, "pay", scores, e)) == {"a": ["a", "c", "d"], "w": ["w", "x"]}
    seen = spark.createDataFrame([("a", "c", 0.3)], "target string, id string, score double")
    assert chains(T.trace_by_node_scores(targets(spark, ["a", "z"]), e, seen)) == {"a": ["a", "c", "d"], "z": ["z"]}


def test_scores_that_hold_for_all_targets(spark):
    rows = [("b", "a", 0.9), ("c", "a", 0.2), ("c", "b", 0.3), ("d", "c", 0.5), ("a", "d", 0.4)]
    scores = spark.createDataFrame([(child, parent, score) for parent, child, score in rows], "child string, parent string, score double")
    each = scores.crossJoin(targets(spark, ["a", "c", "x"]))
    for more in ({}, {"threshold": 0.45}, {"preferred": one(spark, ["c"])}, {"preferred": one(spark, ["d"]), "ahead": one(spark, ["c", "d"])}):
        want = chains(T.trace_scored(targets(spark, ["a", "c", "x"]), each, **more))
        assert chains(T.trace_scored(targets(spark, ["a", "c", "x"]), scores, **more)) == want and len(want) == 3


@pytest.mark.parametrize("least", [0, -2])
def test_node_scores_by_plain_walks(spark, least):
    """Scores of some nodes for some targets, with and without scores below 0, which put a parent behind unscored ones."""
    r = random.Random(30 + least)
    rows = random_graph(31, True)
    scored = {(t, n): r.randint(least, 3) / 2 for t in NODES for n in NODES if r.random() < 0.4}
    up = {b: sorted({a for a, c, _ in rows if c == b}) for _, b, _ in rows}
    want = {}
    for t in NODES:
        chain = [t]
        for _ in range(6):
            best = min(up.get(chain[-1], []), key=lambda p: (-scored.get((t, p), 0), p), default=None)
            if best is None or best in chain:
                break
            chain.append(best)
        want[t] = chain
    scores = spark.createDataFrame([(t, n, s) for (t, n), s in scored.items()], "target string, id string, score double")
    assert chains(T.trace_by_node_scores(targets(spark, NODES), effects(spark, rows), scores, 6)) == want


def test_scores_of_ended_traces_are_left_behind(spark, monkeypatch):
    n, plain = [], T.written
    monkeypatch.setattr(T, "written", lambda df, name: n.append((name, (found := plain(df, name)).count())) or found)
    edges = spark.createDataFrame([*[(f"n{i}", f"n{i + 1}") for i in range(8)], ("o", "n8"), ("n5", "n8"), ("a", "b")], "src string, dst string")
    scores = spark.createDataFrame([("n8", "o", 0.1), ("n8", "n5", 0.4), ("n8", "n8", 0.9), *[("b", f"x{i}", 1.0) for i in range(9)]], "target string, id string, score double")
    found = chains(T.trace_by_node_scores(targets(spark, ["n8", "b"]), edges, scores, 20))
    assert found == {"n8": ["n8", "n5", "n4", "n3", "n2", "n1", "n0"], "b": ["b", "a"]}
    assert [k for name, k in n if name == "node-scores"] == [12, 3, 3]


def test_levels_of_a_deep_path_and_behind_cycles(spark):
    path = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("n000", "n030"), ("n005", "n005"), ("x", "y"), ("y", "x"), ("y", "z"), ("n001", "z")]
    ids = sorted({n for p in path for n in p} | {"alone"})
    found = {r.id: r.level for r in E.topological_levels(one(spark, ids), spark.createDataFrame(path, "src string, dst string")).collect()}
    want = {n: None for n in ids} | {f"n{i:03d}": i for i in range(5)} | {"alone": 0}  # n005 is on a loop of its own
    assert found == want


def levels_by_walk(ids, pairs):
    """Levels by removing nodes one at a time; null for what never gets free."""
    ends = {x for p in pairs for x in p} | set(ids)
    left = {i: {a for a, b in pairs if b == i} for i in ends}
    found, free = {}, [i for i in ends if not left[i]]
    for i in free:
        found[i] = 0
    while free:
        i = free.pop()
        for b in {b for a, b in pairs if a == i}:
            left[b].discard(i)
            if not left[b]:
                found[b] = 1 + max(found[a] for a, c in pairs if c == b)
                free.append(b)
    return {i: found.get(i) for i in ids}


@pytest.mark.parametrize("seed", range(4))
def test_levels_by_contraction(spark, seed):
    """Runs, shortcuts beside them, loops of one and of several nodes, and what lies behind."""
    r = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(60)]
    pairs = [(ids[i - 1], ids[i]) for i in range(1, 40)] + [(ids[0], ids[i]) for i in range(2, 30)]
    pairs += [(r.choice(ids[:40]), r.choice(ids[40:])) for _ in range(25)] + [(a, b) for a, b in ((r.choice(ids), r.choice(ids)) for _ in range(10)) if a < b or seed > 1]
    pairs += [("n58", "n59"), ("n59", "n58"), ("gone", "n41")][: seed + 1]
    edges = spark.createDataFrame([*pairs, pairs[0]], "src string, dst string").repartition(3)
    found = {x.id: x.level for x in E.topological_levels(one(spark, ids), edges).collect()}
    assert found == levels_by_walk(ids, pairs)


def test_levels_of_a_very_long_path(spark):
    """A customer with many orders in a row, each sent by the customer: a few rounds."""
    n = 3000
    path = spark.range(1, n).select(F.concat(F.lit("t"), (F.col("id") - 1)).alias("src"), F.concat(F.lit("t"), "id").alias("dst"))
    sent = spark.range(n).select(F.lit("w").alias("src"), F.concat(F.lit("t"), "id").alias("dst"))
    nodes = spark.range(n).select(F.concat(F.lit("t"), "id").alias("id"))
    found = E.topological_levels(nodes, path.union(sent)).agg(F.min(F.col("level") - F.substring("id", 2, 9).cast("int")), F.max(F.col("level") - F.substring("id", 2, 9).cast("int")), F.count("*")).first()
    assert tuple(found) == (1, 1, n)


def test_first_rows_of_any_order(spark):
    r = random.Random(22)
    rows = [(r.choice([None, 1, 2, 3]), f"{r.randrange(1000):03}{k}", k) for k in range(400)]
    df = spark.createDataFrame(rows, "hop int, id string, place int").repartition(5)
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for n in (0, 1, 57, 399, 400, 900):
        found = first_rows(df, ["hop", F.col("id")], n, 50)
        assert found.columns == df.columns and {x.place for x in found.collect()} == {k for *_, k in ordered[:n]}
    assert first_rows(df.limit(0), ["id"], 3).count() == 0
