import math
import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from rootward.operators import attribution as A
from rootward.operators import chains as C
from rootward.operators import edges as E
from rootward.operators import effects as X
from rootward.operators import logistic
from rootward.operators import metrics as M
from rootward.operators import nodes as N
from rootward.operators import trace as T
from rootward.operators import typology as L
from rootward.plans import scoring
from rootward.sources import tables as S


def test_latest_snapshot(spark):
    r = random.Random(1)
    rows = [(r.choice("pqrs"), r.choice((None, 2, 4, 6, 8)), r.randrange(100), i) for i in range(40)]
    df = spark.createDataFrame(rows, "address string, step int, value int, place int").repartition(3)
    want = {}
    for key, step, value, place in rows:
        rank = (math.inf if step is None else step, place)
        if rank >= want.get(key, ((-1, -1),))[0]:
            want[key] = (rank, (step, value))
    assert {x.address: (x.step, x.value) for x in N.latest_snapshot(df, "address", "step", "place").collect()} == {k: v[1] for k, v in want.items()}
    last = {k: v for k, _, v, _ in rows}
    assert {x.address: x.value for x in N.latest_snapshot(df, "address", None, "place").collect()} == last


def test_time_rule(spark):
    r = random.Random(2)
    times = {f"n{i}": r.choice((None, -1, 1, 2, 3)) for i in range(12)}
    pairs = sorted({(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(60)})
    nodes = spark.createDataFrame([(i, "k", t) for i, t in times.items()], "id string, node_type string, time int")
    edges = spark.createDataFrame([(a, b, r.choice(("t", "wallet__to__wallet"))) for a, b in pairs], "src string, dst string, edge_type string")
    known = lambda n: times[n] if times[n] is not None and times[n] >= 0 else None
    inside = [x for x in edges.collect() if x.src in times and x.dst in times]
    late = lambda x: None not in (known(x.src), known(x.dst)) and known(x.src) > known(x.dst)
    free = [x for x in inside if x.edge_type == "t"]
    assert {(x.src, x.dst) for x in E.causal_edges(edges, nodes).collect()} == {(x.src, x.dst) for x in free if not late(x)}
    audit = E.causal_audit(edges, nodes).first()
    assert (audit.blocked, audit.rejected, audit.kept) == (len(inside) - len(free), sum(map(late, free)), len(free) - sum(map(late, free)))


def test_levels_behind_a_cycle_are_null(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "e")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    assert {r.id: r.level for r in E.topological_levels(nodes, edges).collect()} == {"a": None, "b": None, "c": None, "d": 0, "e": 1}


def test_levels_behind_a_cycle_of_parents_are_null(spark):
    """Each parent of c has a path to it over the other one."""
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("b", "c"), ("c", "e"), ("d", "f"), ("f", "g"), ("d", "g")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    assert {r.id: r.level for r in E.topological_levels(nodes, edges).collect()} == {"a": None, "b": None, "c": None, "d": 0, "e": None, "f": 1, "g": 2}


def test_global_ids_follow_type_and_number(spark):
    nodes = spark.createDataFrame([("transaction", f"t{i}", i) for i in range(3)] + [("actor", f"a{i}", i) for i in range(2)], "node_type string, id string, num long")
    assert {r.id: r.global_id for r in N.global_ids(nodes).collect()} == {"a0": 0, "a1": 1, "t0": 2, "t1": 3, "t2": 4}


def test_split_sizes(spark):
    nodes = spark.range(40).selectExpr("concat('n', id) AS id", "id AS num", "CAST(id % 2 AS INT) AS y", "true AS labelled")
    counts = {(r.split, r.y): r.n for r in N.split_counts(N.stratified_split(nodes)).collect()}
    assert counts == {(s, y): n for s, n in (("train", 14), ("val", 3), ("test", 3)) for y in (0, 1)}


def test_split_sizes_by_decimal_shares(spark):
    nodes = spark.range(90 + 170).selectExpr("concat('n', id) AS id", "id AS num", "CAST(id < 90 AS INT) AS y", "true AS labelled")
    counts = {(r.split, r.y): r.n for r in N.split_counts(N.stratified_split(nodes)).collect()}
    assert counts == {("train", 1): 63, ("val", 1): 13, ("test", 1): 14, ("train", 0): 119, ("val", 0): 25, ("test", 0): 26}


def test_shapley_values_of_given_tables(spark):
    """Any table of coalition values: the mean marginal over all orders."""
    r = random.Random(3)
    players = {"x": ["a", "b", "c"], "y": ["d"], "z": ["a", "e"]}
    v = {(t, s): r.random() for t, own in players.items() for k in range(len(own) + 1) for s in combinations(own, k)}
    values = spark.createDataFrame([(t, list(s), x) for (t, s), x in v.items()], "target string, members array<string>, v double")
    want, orders = {}, []
    for t, own in players.items():
        every = list(permutations(own))
        for k, order in enumerate(every):
            for i, p in enumerate(order):
                before, upto = tuple(sorted(order[:i])), tuple(sorted(order[: i + 1]))
                want[t, p] = want.get((t, p), 0) + (v[t, upto] - v[t, before]) / len(every)
                orders.append((t, k, p, i + 1, v[t, upto], v[t, ()]))
    given = lambda df: {(x.target, x.parent): x.phi for x in df.collect()}
    assert given(A.phi_of_coalitions(values)) == pytest.approx(want)
    prefixes = spark.createDataFrame(orders, "target string, perm int, parent string, position int, v double, v_empty double")
    assert given(A.phi_of_orders(prefixes)) == pytest.approx(want)
    one = prefixes.where("perm = 0").drop("perm")
    first = {(t, p): x - (0 if i > 1 else e) - (0 if i == 1 else v[t, tuple(sorted(list(permutations(players[t]))[0][: i - 1]))]) for t, k, p, i, x, e in orders if k == 0}
    assert given(A.phi_asymmetric(one, normalise=False)) == pytest.approx(first)
    assert given(A.phi_asymmetric(one)) == pytest.approx({(t, p): x / len(players[t]) for (t, p), x in first.items()})


def test_prefixes_of_a_hub_in_parts(spark):
    r = random.Random(5)
    rows = [(f"p{i:02d}", "hub", r.uniform(-1, 1), r.choice((None, 1, 1, 2, 3))) for i in range(30)]
    effects = spark.createDataFrame([x[:3] for x in rows], "src string, dst string, ce double")
    order = spark.createDataFrame([(x[0], x[3]) for x in rows], "id string, level int")
    got = sorted((x.position, x.parent, round(x.v, 12)) for x in A.logistic_prefixes(effects, effects, order).collect())
    total, want = 0.0, []
    for i, x in enumerate(sorted(rows, key=lambda x: (x[3] is None, x[3] or 0, x[0]))):
        total += x[2]
        want.append((i + 1, x[0], round(1 / (1 + math.exp(-total)), 12)))
    assert [w[:2] for w in want] == [g[:2] for g in got] and [w[2] for w in want] == pytest.approx([g[2] for g in got])


def test_shapley_values_of_all_parents(spark):
    ces = {"a": [0.9, -0.4, 0.3, 0.2], "b": [(i * 37 % 41 - 18) / 20 for i in range(30)] + [0.25, 0.25, 0.0]}
    effects = spark.createDataFrame([(f"{d}{i}", d, c) for d, row in ces.items() for i, c in enumerate(row)], "src string, dst string, ce double")
    phi = {(r.target, r.parent): r.phi for r in A.phi_symmetric(effects).collect()}
    assert set(phi) == {(d, f"{d}{i}") for d, row in ces.items() for i in range(len(row))}
    v = lambda x: 1 / (1 + math.exp(-x))
    orders = list(permutations(range(4)))
    for i in range(4):
        marginals = [v(sum(ces["a"][j] for j in o[: o.index(i) + 1])) - v(sum(ces["a"][j] for j in o[: o.index(i)])) for o in orders]
        assert abs(phi["a", f"a{i}"] - sum(marginals) / len(orders)) < 1e-12
    # Sampled: the shares add up, have the sign of the effect, a null parent has none, and more orders bring equal parents together.
    assert abs(sum(x for (d, _), x in phi.items() if d == "b") - (v(sum(ces["b"])) - 0.5)) < 1e-9
    assert all(phi["b", f"b{i}"] * c > 0 for i, c in enumerate(ces["b"]) if c) and phi["b", "b32"] == 0
    more = {r.parent: r.phi for r in A.phi_symmetric(effects.where("dst = 'b'"), 2000, 1).collect()}
    assert abs(more["b30"] / more["b31"] - 1) < 0.05
    assert all(r.phi == phi[r.target, r.parent] for r in A.phi_symmetric(effects).collect())


def test_metrics(spark):
    r = random.Random(7)
    pairs = [(r.randrange(2), r.randrange(2)) for _ in range(40)]
    tp, fp, fn, tn = (pairs.count(x) for x in ((1, 1), (0, 1), (1, 0), (0, 0)))
    report = M.detection_report(spark.createDataFrame(pairs, "y int, pred int")).first()
    one, zero = 2 * tp / (2 * tp + fp + fn), 2 * tn / (2 * tn + fp + fn)
    assert (report.fraud_f1, report.f1_macro, report.recall) == pytest.approx((one, (one + zero) / 2, tp / (tp + fn)), abs=1e-6)
    assert M.auc(spark.createDataFrame([(1, 0.4), (1, 0.6)], "y int, score double")).first().auc == 0.0
    scored = [(r.randrange(3), [round(r.random(), 1) for _ in range(4)]) for _ in range(60)]
    areas = []
    for c in range(3):  # the fourth class has no row
        a, b = [s[c] for y, s in scored if y == c], [s[c] for y, s in scored if y != c]
        areas.append(sum((x > z) + (x == z) / 2 for x in a for z in b) / len(a) / len(b))
    found = M.auc_one_vs_rest(spark.createDataFrame(scored, "y int, scores array<double>"), [0, 1, 2, 3]).first()
    assert found.n_classes == 3 and found.auc == pytest.approx(sum(areas) / 3, abs=1e-5)
    sets = lambda: {t: {r.choice("klmno") for _ in range(r.randint(0, 4))} for t in "uvwxyz"}
    p, g = sets(), sets()
    table = lambda of: spark.createDataFrame([(t, n) for t, own in of.items() for n in own], "target string, node string")
    both = [(p[t], g[t]) for t in p if p[t] or g[t]]
    mean = lambda xs: sum(xs) / len(xs)
    got = M.explanation_metrics(table(p), table(g)).first()
    assert got.accuracy == pytest.approx(mean([len(a & b) / len(a) for a, b in both if a]), abs=1e-6)
    assert got.recall == pytest.approx(mean([len(a & b) / len(b) for a, b in both if b]), abs=1e-6)
    assert got.exact_match == pytest.approx(mean([a == b for a, b in both]), abs=1e-6) and got.subset_match == pytest.approx(mean([bool(b) and b <= a for a, b in both]), abs=1e-6)
    feasible = mean([len(b) <= len(a) for a, b in both if a and b])
    assert got.subset_feasible == pytest.approx(feasible, abs=1e-6) and got.subset_match_shown == (got.subset_match if feasible >= 0.5 else None)
    sizes = sorted(len(x) for x in g.values() if x)
    assert M.ground_truth_stats(table(g)).first().median_size == sizes[len(sizes) // 2]


def test_label_rules(spark):
    nodes = [("w1", "wallet", 1, True), ("w2", "wallet", 0, True), ("w3", "wallet", 0, False), ("t1", "transaction", 1, True), ("t2", "transaction", 0, False), ("h", "host", 1, True)]
    pairs = [("w1", "t1"), ("w3", "t1"), ("w2", "t2"), ("t1", "w2"), ("t1", "w3"), ("t1", "t2"), ("t2", "t1"), ("t1", "h"), ("h", "w1"), ("t1", "gone")]
    df = spark.createDataFrame(nodes, "id string, node_type string, y int, labelled boolean")
    edges = spark.createDataFrame([(a, b, "e") for a, b in pairs], "src string, dst string, edge_type string")
    found = {mode: {(x.src, x.dst): x.y for x in X.edge_training_rows(edges, df, mode).collect()} for mode in ("wallets", "types", "target")}
    assert found["wallets"] == {("w1", "t1"): 1, ("w2", "t2"): 0, ("t1", "w2"): 0, ("t1", "t2"): 0, ("t2", "t1"): 1, ("h", "w1"): 1}
    assert found["types"] == {("w1", "t1"): 1, ("w3", "t1"): 1, ("t1", "w2"): 0, ("t2", "t1"): 1, ("t1", "h"): 1, ("h", "w1"): 1}
    assert found["target"] == {("t1", "t2"): 0, ("t2", "t1"): 1}
    with pytest.raises(ValueError):
        X.edge_training_rows(edges, df, "other")


def test_edge_models_and_model_selection(spark):
    r = random.Random(9)
    rows = [(f"s{i}", "rare" if i % 10 == 0 else "often", float(x), int(x + r.gauss(0, 0.3) > 0.5)) for i, x in ((i, r.random()) for i in range(600))]
    df = spark.createDataFrame(rows, "src string, edge_type string, f double, y int")
    plain, balanced = ({m.edge_type: m for m in X.fit_edge_models(df, ["f"], mode=mode).collect()} for mode in ("none", "inverse"))
    assert set(plain) == {"rare", "often"} and all(m.b_f > 1 for m in plain.values())
    assert balanced["rare"].b_f > plain["rare"].b_f and balanced["often"].b_f < plain["often"].b_f  # a heavier type is held back less
    noise = [(i, v, x if v == "told" else r.random(), y, ("train", "train", "val")[i % 3]) for i, (_, _, x, y) in enumerate(rows) for v in ("told", "blind")]
    nodes = spark.createDataFrame(noise, "id int, variant string, f double, y int, split string")
    models = X.fit_detectors(nodes, ["f"])
    model, report = X.select_model(nodes, ["f"], "f1_macro", models=models)
    assert {x.variant: x.chosen for x in report.collect()} == {"told": True, "blind": False} and [m.variant for m in model.collect()] == ["told"]
    scored = X.detect(model, nodes, ["f"]).collect()
    assert {x.variant for x in scored} == {"told"} and sum(x.pred == x.y for x in scored) / len(scored) > 0.7  # the noise allows about 0.77
    one = models.where("variant = 'told'").first()
    for x in scored:
        assert abs(x.score - 1 / (1 + math.exp(-(one.intercept + one.b_f * (x.f - one.mean_f) / one.std_f)))) < 1e-8 and x.pred == int(x.score > one.cut)


def test_newton_steps_reach_the_optimum_of_every_group(spark):
    """Coefficients against a plain search; a group of one label has no model, nulls count 0."""
    r = random.Random(10)
    rows = [(g, r.gauss(0, 1), r.choice([None, 0.5, 2.0]), r.randint(1, 3)) for g in "ab" for _ in range(200)]
    rows = [(g, int(x * (1 if g == "a" else -2) + (z or 0) + r.gauss(0, 1) > 0), x, z, float(w)) for g, x, z, w in rows]
    rows += [("c", 1, 0.3, 0.1, 1.0), ("c", 1, 0.4, 0.1, 1.0), ("a", None, 9.0, 9.0, 1.0), (None, 1, 9.0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y int, `x` double, z double, w double").repartition(3)
    found = {m.g: m for m in logistic.fit(df, "g", ["x", "z"], hold={"b": 10.0}, weight=F.col("w")).collect()}
    assert set(found) == {"a", "b"} and found["a"].n == 200

    def loss(g, b0, b1, b2):
        own = [x for x in rows if x[0] == g and x[1] is not None]
        total = sum(w * math.log1p(math.exp(-(2 * y - 1) * (b0 + b1 * x + b2 * (z or 0)))) for _, y, x, z, w in own) / sum(x[4] for x in own)
        return total + logistic.RIDGE * (10 if g == "b" else 1) / 2 * (b1 * b1 + b2 * b2)

    for g, m in found.items():
        best = (m.intercept, m.b_x, m.b_z)
        for k in range(3):
            for d in (-1e-3, 1e-3):
                moved = [b + d * (i == k) for i, b in enumerate(best)]
                assert loss(g, *moved) > loss(g, *best)
    assert logistic.fit(df.where("g = 'c'"), "g", ["x", "z"]).count() == 0


def test_layers_of_neighbour_features(spark):
    nodes = [("a", "k", 1.0), ("b", "k", 3.0), ("c", "k", 5.0), ("d", "left out", 9.0), ("e", "k", 2.0)]
    pairs = [("a", "b", "x"), ("c", "b", "y"), ("e", "b", "x"), ("b", "c", "x"), ("d", "a", "x"), ("a", "d", "x")]
    df, edges = spark.createDataFrame(nodes, "id string, node_type string, f double"), spark.createDataFrame(pairs, "src string, dst string, edge_type string")
    for how in ("mean", "sum"):
        now = {i: f for i, _, f in nodes}
        for _ in range(3):
            new = dict(now)
            for i, kind, _ in nodes:
                brought = {}
                for s, t, rel in pairs:
                    if t == i and "d" not in (s, t):
                        brought.setdefault(rel, []).append(now[s])
                if brought:
                    per = [sum(v) / (len(v) if how == "mean" else 1) for v in brought.values()]
                    new[i] = (now[i] + sum(per) / len(per)) / 2
            now = new
        got = {x.id: x.f for x in X.neighbour_features(df, edges, ["f"], 3, how, ("left out",)).collect()}
        assert got == pytest.approx(now)


def test_pooled_cuts(spark):
    rows = [("tx", y, p, s) for s in ("val", "test") for p, y in ((0.9, 1), (0.9, 1), (0.1, 0), (0.1, 0))]
    rows += [("wallet", y, p, s) for s in ("val", "test") for p, y in [(0.9, 1)] * 5 + [(0.6, 0)] * 5]
    found = M.pooled_eval(spark.createDataFrame(rows, "node_type string, y int, score double, split string"))
    assert [r.fraud_f1 for r in found.where("node_type IS NULL").collect()] == [1.0]


def test_six_digits(spark):
    from rootward.operators.chains import six_digits

    df = spark.createDataFrame([(0.5,), (0.83,), (-0.123456789,), (0.0,), (1.0,), (12.0,)], "x double").select(six_digits(F.col("x")).alias("s"))
    assert [r.s for r in df.collect()] == ["0.5", "0.83", "-0.123457", "0", "1", "12"]


CHAINS = [
    ("pay1", 2, "wallet", "acc9", True, True, [("pay1", "transaction", 0.0, None, None), ("acc4", "wallet", 0.25, 0.125, -0.5), ("acc9", "wallet", -0.333333333, 0.0, None)]),
    ("pay2", 0, "transaction", "pay2", False, False, [("pay2", "transaction", 0.0, None, None)]),
]


def records(spark, chains=CHAINS):
    rows = [(t, d, k, root, f, tp, [(i, n[0], n[1], 7, False, i == 0, None if i == 0 else n[2], n[3], n[4]) for i, n in enumerate(own)]) for t, d, k, root, f, tp, own in chains]
    node = "struct<pos:int,id:string,node_type:string,time:int,fraud:boolean,is_target:boolean,ce:double,phi_add:double,phi_asym:double>"
    return spark.createDataFrame(rows, f"target string, depth int, root_type string, root string, root_is_fraud boolean, is_true_positive boolean, nodes array<{node}>")


def test_chain_files_go_round(spark, tmp_path):
    own = records(spark)
    S.write_chains_json(own, f"{tmp_path}/json", "mine")
    plain = lambda df: sorted((x.asDict(recursive=True) for x in df.collect()), key=lambda x: x["target"])
    assert plain(S.read_chains_json(spark, f"{tmp_path}/json")) == plain(own)
    meta = spark.read.json(f"{tmp_path}/json/meta").first()
    assert (meta.dataset, meta.n_chains, meta.n_true_positive, meta.n_fraud_root, meta.mean_depth) == ("mine", 2, 1, 1, 1.0)
    lines = [x for f in (tmp_path / "json" / "chains").glob("*.json") for x in f.read_text().splitlines()]
    (tmp_path / "one.json").write_text('{"meta": {"dataset": "x", "n_chains": 2},\n "chains": [' + ",\n".join(lines) + "]}")
    assert plain(S.read_chains_document(spark, f"{tmp_path}/one.json")) == plain(own)
    for bad in ('{"meta": {}}', '{"chains": [{"depth": 0, "nodes": []}]}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="chain"):
            S.read_chains_document(spark, f"{tmp_path}/bad.json").collect()


def test_packed_chain_rows(spark, tmp_path):
    rows = {x.target_txid: x for x in C.chains_to_rows(records(spark)).collect()}
    assert rows["pay1"].chain_real_ids == "pay1|acc4|acc9" and rows["pay1"].chain_ce == "|0.25|-0.333333" and rows["pay1"].n_nodes == 3
    assert rows["pay1"].chain_phi_add == "|0.125|0" and rows["pay1"].chain_phi_asym == "|-0.5|" and rows["pay2"].chain_ce == ""
    bare = C.chains_to_rows(records(spark, CHAINS[1:]))
    assert tuple(bare.columns) == S.CSV_COLUMNS
    S.write_chains_csv(bare.limit(0), f"{tmp_path}/none")
    assert [x for f in (tmp_path / "none").glob("*.csv") for x in f.read_text().splitlines()] == [",".join(S.CSV_COLUMNS)]
    with pytest.raises(ValueError, match="no chain"):
        S.read_chains_csv(spark, f"{tmp_path}/none")
    head = ",".join(S.CSV_COLUMNS)
    (tmp_path / "chains.csv").write_text(head + "\npay1,2,wallet,acc9,True,false,3,pay1| acc4 |acc9,transaction|wallet|wallet,|0.5|much\nshort,1\npay3,1,wallet,acc4,true,true,2,pay3|acc4,wallet,|1\npay2,0,transaction,pay2,false,true,1,pay2,transaction,\n")
    got = sorted((x.target, x.pos, x.id, x.global_id, x.fraud, x.ce) for x in S.read_chains_csv(spark, f"{tmp_path}/chains.csv").collect())
    assert got == [("pay1", 0, "pay1", 0, False, None), ("pay1", 1, "acc4", 1, False, 0.5), ("pay1", 2, "acc9", 2, True, None), ("pay2", 0, "pay2", 3, True, None)]
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        S.read_chains_csv(spark, f"{tmp_path}/other.csv")


def test_run_logs(spark, tmp_path):
    (tmp_path / "eval_one.log").write_text("""start
  · wallet      fraud_f1=0.7000  pred_rate=0.0123  thr=0.310
  Root Cause Precision True Pos            : 0.2500
  Root Cause Precision                     : 0.5000
  Root Cause Precision                     : 0.9000
[Metric C — GT = strict]
  Explanation Accuracy                     : 0.1000
[Metric C - GT = wide ]
  Explanation Accuracy                     : 0.2000
  Explanation Recall                       : 0.3000
WALLCLOCK_SECONDS=12
""")
    (tmp_path / "two.log").write_text("nothing\nAuc: 0.75\nOdd: 3\n")
    found = S.read_run_metrics(spark, str(tmp_path))
    got = {(x.run, x.block, x.metric): x.value for x in found.collect()}
    assert got == {
        ("one", None, "wallet_F1"): 0.7, ("one", None, "wallet_rate"): 0.0123, ("one", None, "wallet_thr"): 0.31, ("one", None, "RCP_TP"): 0.25, ("one", None, "RCP"): 0.5,
        ("one", None, "sec"): 12.0, ("one", "strict", "EA"): 0.1, ("one", "wide", "EA"): 0.2, ("one", "wide", "ER"): 0.3, ("two", None, "AUC"): 0.75,
    }
    rows = S.run_summary(found, ["AUC", "RCP_TP"], ["strict", "wide"]).collect()
    assert [(x.run, x.AUC, x.RCP_TP, x.EA_wide, x.ER_strict) for x in rows] == [("one", None, 0.25, 0.2, None), ("two", 0.75, None, None, None)]


def test_a_long_log_is_read_in_ranges(spark, tmp_path):
    """Marks hold for the lines of later ranges; a label counts where it comes first in the file."""
    lines, want = ["Auc: 0.5"], {(None, "AUC"): [0.5]}
    for k in range(6):
        lines += [f"[Metric C - GT = mode{k}]", *("nothing to say here" for _ in range(200)), f"  Explanation Accuracy : 0.{k}", "  Explanation Accuracy : 0.99", f"Auc: 0.{k}", f"· kind{k} fraud_f1=0.{k} pred_rate=x thr=-1"]
        want |= {(f"mode{k}", "EA"): [k / 10], (None, f"kind{k}_F1"): [k / 10], (None, f"kind{k}_thr"): [-1.0]}
    (tmp_path / "eval_long.v2.log").write_text("\n".join(lines))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        found = S.read_run_metrics(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    assert {x.run for x in found} == {"long.v2"} and len(found) == len(want)
    assert {(x.block, x.metric): [x.value] for x in found} == want


def test_pairs_of_chains(spark):
    r = random.Random(15)
    rows = sorted({(f"t{r.randrange(60)}", r.choice("pqrs")) for _ in range(60)})
    cn = spark.createDataFrame([*rows, rows[0]], "target string, id string")
    want = set()
    for node in "pqrs":
        own = sorted(t for t, i in rows if i == node)
        want |= {(own[0], t) for t in own[1:]}
    assert sorted((x.a, x.b) for x in L.meeting_pairs(cn).collect()) == sorted(want)
    numbers = sorted({int(t[1:]) for t, _ in rows})
    for window in (1, 4, 100):
        found = L.near_pairs(cn, F.expr("substr(target, 2)"), window).collect()
        assert sorted((x.a, x.b) for x in found) == sorted((f"t{i}", f"t{j}") for i in numbers for j in numbers if 0 < j - i <= window)


def test_shares_that_floats_tell_apart_are_equal(spark):
    rows = [("t", "a", 0, None), ("t", "b", 1, 0.3), ("t", "c", 2, -(0.1 + 0.2)), ("t", "d", 3, 0.3), ("t", "e", 4, 0.1)]
    cn = spark.createDataFrame(rows, "target string, id string, pos int, phi_asym double")
    found = L.phi_summary(cn).first()
    assert (found.top_node, found.top_phi, round(found.phi_total, 9), round(found.top_share, 6)) == ("d", 0.3, 1.0, 0.3)


def test_missing_column_is_named(spark, tmp_path):
    spark.createDataFrame([(1,)], "txId int").write.csv(f"{tmp_path}/txs_features.csv", header=True)
    try:
        S.load_graph_tables(spark, str(tmp_path))
        raise AssertionError("no error")
    except ValueError as e:
        assert "Time step" in str(e)


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_readouts_away_from_the_intervention(spark, depth):
    """Cut edges of a node, read at others and through cycles, against a walk with the edges gone."""
    r = random.Random(depth)
    ids = [f"n{i}" for i in range(9)]
    pairs = sorted({(r.choice(ids), r.choice(ids)) for _ in range(26)} | {("gone", "n1"), ("n1", "n2"), ("n2", "n1"), ("n3", "n1")})
    x = {i: (r.uniform(-1, 1), r.uniform(-1, 1)) for i in ids}
    layers = [{"x": r.uniform(-1, 1), "y": r.uniform(-1, 1)} for _ in range(depth)]

    def p(node, cut, kept):
        def mean(v, layer):
            own = layers[layer]["x"] * x[v][0] + layers[layer]["y"] * x[v][1]
            fed = [a for a, b in pairs if b == v and a != v and a in x and (v != cut or a in kept)] if layer + 1 < depth else []
            return own + (sum(mean(a, layer + 1) for a in fed) / len(fed) if fed else 0)

        return 1 / (1 + math.exp(-(0.25 + mean(node, 0))))

    cuts = ["n1", "n2", "n5"]
    parents = {c: [a for a, b in pairs if b == c and a != c] for c in cuts}
    rows = [(c, "none", None) for c in cuts] + [(c, a, a) for c in cuts for a in parents[c]] + [(c, "all", a) for c in cuts for a in parents[c]]
    sets = spark.createDataFrame(rows, "target string, coalition string, parent string")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    features = spark.createDataFrame([(i, *v) for i, v in x.items()], "id string, x double, y double")
    readouts = spark.createDataFrame([(c, i) for c in cuts for i in [*ids, "unknown"]], "target string, readout string")
    found = A.coalition_values(sets, edges, features, layers, 0.25, readouts).collect()
    members = {(c, k): {a for t, n, a in rows if t == c and n == k} for c, k, _ in rows}
    assert len(found) == len(members) * len(ids)
    for v in found:
        assert v.p == pytest.approx(p(v.readout, v.target, members[v.target, v.coalition]))
    own = {(v.target, v.coalition): v.p for v in A.coalition_values(sets, edges, features, layers, 0.25).collect()}
    assert own == pytest.approx({(v.target, v.coalition): v.p for v in found if v.readout == v.target})


def test_interventions(spark):
    """A readout of three layers against a walk through plain dictionaries."""
    pairs = [("w2", "t0"), ("w3", "t0"), ("w3", "t0"), ("w4", "t1"), ("t5", "w2"), ("t6", "w2"), ("t6", "w3"), ("t7", "t6")]
    x = {"t0": (1.0, 0.5), "t1": (0.0, 0.0), "w2": (2.0, -1.0), "w3": (-1.0, 0.25), "w4": (0.0, 0.0), "t5": (0.5, 1.0), "t6": (-2.0, 0.75), "t7": (9.0, 9.0)}
    edges = spark.createDataFrame(pairs, "src string, dst string")
    features = spark.createDataFrame([(i, *v) for i, v in x.items()], "id string, x double, y double")
    layers, bias = [{"x": 1.0, "y": -0.5}, {"x": 2.0, "y": 0.5}, {"x": -1.0, "y": 0.25}], 0.5

    def p(z):
        return 1 / (1 + math.exp(-z))

    def inside(target, changed=x, only=None):
        def mean(node, layer):
            own = layers[layer]["x"] * changed[node][0] + layers[layer]["y"] * changed[node][1]
            fed = sorted({a for a, b in pairs if b == node and (node != target or only is None or a in only)}) if layer + 1 < len(layers) else []
            return own + (sum(mean(a, layer + 1) for a in fed) / len(fed) if fed else 0)

        return bias + mean(target, 0)

    sets = spark.createDataFrame([("t0", "none", None), ("t0", "w2", "w2"), ("t0", "w2", "w2"), ("t0", "all", "w2"), ("t0", "all", "w3")], "target string, coalition string, parent string")
    got = {r.coalition: r.p for r in A.coalition_values(sets, edges, features, layers, bias).collect()}
    assert got == pytest.approx({"none": p(inside("t0", only=())), "w2": p(inside("t0", only=("w2",))), "all": p(inside("t0"))})
    asked = spark.createDataFrame([("t0", "w2"), ("t0", "t0"), ("t0", "t6"), ("t0", "t7"), ("t0", "w4"), ("t1", "w4"), ("t9", "w4")], "target string, pivot string")
    got = {(r.target, r.pivot, r.feature): r for r in A.feature_effects(asked, edges, features, layers, bias).collect()}
    assert {k[:2] for k in got} == {("t0", "w2"), ("t0", "t0"), ("t0", "t6"), ("t1", "w4")}  # t7 is three hops away, w4 does not feed t0, t9 is unknown
    for pivot in ("t0", "w2", "t6"):
        for place, feature in enumerate(("x", "y")):
            without = x | {pivot: tuple(0.0 if k == place else v for k, v in enumerate(x[pivot]))}
            assert got["t0", pivot, feature].value == pytest.approx(p(inside("t0")) - p(inside("t0", without)))
    assert got["t1", "w4", "x"].method == "saliency_fallback"
    targets = spark.createDataFrame([("t0",)], "target string")
    found = {r.id: r.saliency for r in A.saliency(targets, edges, features, layers, bias).collect()}
    assert set(found) == {"t0", "w2", "w3", "t5", "t6"}
    for node, value in found.items():
        parts = [inside("t0") - inside("t0", x | {node: tuple(0.0 if k == place else v for k, v in enumerate(x[node]))}) for place in (0, 1)]
        assert value == pytest.approx(p(inside("t0")) * (1 - p(inside("t0"))) * math.hypot(*parts))
    scored = A.readout(targets, edges, features, layers, bias)
    assert scored.first().p == pytest.approx(p(inside("t0"))) and scored.first().n == 2
    phi = spark.createDataFrame([("t0", "w2", 0.25), ("t0", "w3", -0.5)], "target string, parent string, phi double")
    chains = spark.createDataFrame([("t0", 1, ["t0", "w3"], 0.5)], "target string, rank int, chain array<string>, score double")
    summary, parents = A.explain_targets(targets, scored, {"one": phi, "two": phi.where("phi > 0")}, chains)
    row = summary.first()
    assert row.sum_one == 0.75 and row.sum_two == 0.25 and row.chain == ["t0", "w3"] and row.n == 2
    assert {(x.explainer, x.parent, x.phi) for x in parents.collect()} == {("one", "w2", 0.25), ("one", "w3", -0.5), ("two", "w2", 0.25)}
    summary, parents = A.explain_targets(targets, scored, {"one": phi.limit(0)}, chains)
    assert summary.first().sum_one == 0 and parents.count() == 0
    assert A.feature_effects(asked.limit(0), edges, features, layers, bias).count() == 0


def test_parents_of_targets_are_explained_without_traces(spark, monkeypatch):
    """Nothing but the edges into targets tells the shares, so no chain is looked for."""
    monkeypatch.setattr(T, "trace_topk", None)
    found = scoring.QUERIES["f16_explained_parents"](spark, "/root/testdata/sf0.001")
    assert {r.explainer for r in found.select("explainer").distinct().collect()} == {"add", "asym", "sym"}
