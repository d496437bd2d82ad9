"""Laundering patterns along chains: peeling, fan-in, pass-through; their summaries.

Flow order is root first, so descending pos. Works on chain nodes (see chains.py)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rootward.functions.tables import written
from rootward.operators.nodes import global_ids


def flow() -> WindowSpec:
    """The nodes of a chain, root first."""
    return Window.partitionBy("target").orderBy(F.desc("pos"))


def alternation(cn: DataFrame) -> DataFrame:
    """target, alternates: adjacent types differ; true for a single node."""
    rows = cn.select("target", (F.col("node_type") != F.lag("node_type").over(flow())).alias("d"))
    return rows.groupBy("target").agg(F.coalesce(F.bool_and("d"), F.lit(True)).alias("alternates"))


def time_monotone(cn: DataFrame) -> DataFrame:
    """target, monotone (null under two known times), n_known, n_unknown."""
    counts = cn.groupBy("target").agg(F.count(F.when(F.col("time") >= 0, 1)).alias("n_known"), F.count(F.when(F.coalesce(F.col("time") < 0, F.lit(True)), 1)).alias("n_unknown"))
    known = cn.where("time >= 0").select("target", (F.col("time") >= F.lag("time").over(flow())).alias("up"))
    return counts.join(known.groupBy("target").agg(F.bool_and("up").alias("monotone")), "target", "left")


def amounts(cn: DataFrame, txs: DataFrame, column: str = "amount") -> DataFrame:
    """target, seq, amount of the transactions of each chain in flow order, and how many have none."""
    rows = cn.where("node_type = 'transaction'").join(txs.select("id", F.col(column).alias("amount")), "id", "left")
    return rows.select("target", "pos", "id", "amount", F.row_number().over(flow()).alias("seq"))


def amount_trend(found: DataFrame) -> DataFrame:
    """target, rho (Spearman of amount and place, from three points that are not all equal),
    decreasing (share of strict decreases, from two points), n_amounts, n_missing."""
    known = found.where("amount IS NOT NULL")
    by, ties = Window.partitionBy("target").orderBy("amount"), Window.partitionBy("target", "amount")
    rows = known.select(
        "target", F.row_number().over(flow()).cast("double").alias("x"), (F.rank().over(by) + (F.count("*").over(ties) - 1) / 2.0).alias("y"),
        (F.col("amount") < F.lag("amount").over(flow())).cast("double").alias("d"),
    )
    fit = (F.count("*") >= 3) & (F.stddev_pop("y") > 0)
    trend = rows.groupBy("target").agg(F.when(fit, F.corr("x", "y")).alias("rho"), F.avg("d").alias("decreasing"), F.count("*").alias("n_amounts"))
    missing = found.groupBy("target").agg(F.count(F.when(F.col("amount").isNull(), 1)).alias("n_missing"))
    return missing.join(trend, "target", "left").withColumn("n_amounts", F.coalesce("n_amounts", F.lit(0)))


def scan_peeling(chains: DataFrame, cn: DataFrame, txs: DataFrame) -> DataFrame:
    """target, peel_struct (long, alternating, ordered in time), peel_rho and peel_share (its amounts
    fall by rank, or at most hops), peel_hit (either), peel_strength."""
    rows = chains.select("target", "depth").join(alternation(cn), "target").join(time_monotone(cn), "target").join(amount_trend(amounts(cn, txs)), "target", "left")
    rho, share = F.round(F.col("rho"), 9), F.round(F.col("decreasing"), 9)
    fit = (F.col("depth") >= 4) & F.col("alternates") & F.coalesce("monotone", F.lit(False))
    by_rho, by_share = fit & F.coalesce(rho < -0.5, F.lit(False)), fit & F.coalesce(share > 0.7, F.lit(False))
    strength = F.greatest(F.greatest(-F.coalesce(rho, F.lit(0.0)), F.lit(0.0)), F.coalesce(share, F.lit(0.0)))
    return rows.select("target", fit.alias("peel_struct"), by_rho.alias("peel_rho"), by_share.alias("peel_share"), (by_rho | by_share).alias("peel_hit"), (F.round(strength, 6) + 0.0).alias("peel_strength"))


def upstream_times(ids: DataFrame, tables: dict[str, DataFrame], txs: DataFrame, funded: DataFrame, tx_tx: bool = False, addr_addr: bool = False) -> DataFrame:
    """id, n_times, min_time, max_time of what feeds each node: funding of inputs, times of payers,
    on request times of the transactions before and funding of linked wallets."""
    times = txs.where("time >= 0").select("id", "time").unionByName(funded.select("id", "time"))
    names = ["addr_tx", "tx_addr"] + ["tx_tx"] * tx_tx + ["addr_addr"] * addr_addr
    into = reduce(DataFrame.unionByName, [tables[n].select("src", "dst") for n in names]).join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    rows = into.join(times.withColumnRenamed("id", "src"), "src")
    return rows.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_times"), F.min("time").alias("min_time"), F.max("time").alias("max_time"))


def scan_fanin(cn: DataFrame, degrees: DataFrame, thresholds: DataFrame, upstream: DataFrame, spread: int = 3, known: int = 2) -> DataFrame:
    """target, fanin_hit, fanin_hubs (hits of the chain) and, of the hit with the highest in-degree or
    else the hub with the highest in-degree over its threshold: fanin_node, fanin_degree,
    fanin_times, fanin_range. Hubs reach their type's threshold; hits are fed close in time."""
    rows = cn.select("target", "id").distinct().join(degrees, "id").join(F.broadcast(thresholds), "node_type").join(upstream, "id", "left")
    rows = rows.withColumn("_range", F.col("max_time") - F.col("min_time")).withColumn("_n", F.coalesce("n_times", F.lit(0)))
    hub = (F.col("threshold") > 0) & (F.col("indegree") >= F.col("threshold"))
    hit = F.coalesce(hub & (F.col("_n") >= known) & (F.col("_range") <= spread), F.lit(False))
    place = F.struct((~hit).alias("no_hit"), F.when(hit, -F.col("indegree").cast("double")).otherwise(-F.col("indegree") / F.col("threshold")).alias("d"), F.col("id").alias("id"))
    best = F.min_by(F.when(hub, F.struct("id", "indegree", "_n", "_range")), F.when(hub, place)).alias("b")
    found = rows.groupBy("target").agg(F.max(hit).alias("fanin_hit"), F.count(F.when(hit, 1)).alias("fanin_hubs"), best)
    return found.select("target", "fanin_hit", "fanin_hubs", F.col("b.id").alias("fanin_node"), F.col("b.indegree").alias("fanin_degree"), F.col("b._n").alias("fanin_times"), F.col("b._range").alias("fanin_range"))


def lifespan_gap(latest: DataFrame) -> DataFrame:
    return latest.select("id", (F.col("last_block") - F.col("first_received_block")).alias("gap"))


def scan_passthrough(cn: DataFrame, gaps: DataFrame, threshold: float) -> DataFrame:
    """target, pass_hit, n_pass, pass_ids (joined by ;): chain wallets that lived shorter than the threshold."""
    rows = cn.where("node_type = 'wallet'").select("target", "id").distinct().join(gaps, "id").where(F.col("gap") < threshold)
    found = rows.groupBy("target").agg(F.count("*").alias("n_pass"), F.concat_ws(";", F.array_sort(F.collect_list("id"))).alias("pass_ids"))
    every = cn.select("target").distinct().join(found, "target", "left")
    return every.select("target", F.col("n_pass").isNotNull().alias("pass_hit"), F.coalesce("n_pass", F.lit(0)).alias("n_pass"), F.coalesce("pass_ids", F.lit("")).alias("pass_ids"))


def scan_table(records: DataFrame, peel: DataFrame, fanin: DataFrame, passing: DataFrame) -> DataFrame:
    """records: target, depth, root, root_is_fraud, is_true_positive."""
    rows = records.select("target", "depth", "root", "root_is_fraud", "is_true_positive").join(peel, "target").join(fanin.select("target", "fanin_hit"), "target").join(passing.select("target", "pass_hit"), "target")
    score = F.col("depth") * F.col("peel_strength") * F.col("peel_hit").cast("int")
    return rows.withColumn("peel_score", F.round(score, 6) + 0.0)


SIGNATURES = {"peeling_structure": "peel_struct", "peeling_rank": "peel_rho", "peeling_share": "peel_share", "peeling": "peel_hit", "fanin": "fanin_hit", "passthrough": "pass_hit"}


def signature_summary(scan: DataFrame) -> DataFrame:
    """signature, n and percent over all chains, n_true and percent_true over true positives (0 of none is 0)."""
    parts = []
    for name, column in SIGNATURES.items():
        parts += [F.count(F.when(F.expr(column), 1)).alias(name), F.count(F.when(F.expr(f"{column} AND is_true_positive"), 1)).alias(f"{name}_true")]
    counts = scan.agg(*parts, F.count("*").alias("total"), F.count(F.when(F.col("is_true_positive"), 1)).alias("total_true"))
    listed = ", ".join(f"'{n}', {n}, {n}_true" for n in SIGNATURES)
    percent = lambda n, of: F.round(F.when(F.col(of) > 0, 100.0 * F.col(n) / F.col(of)).otherwise(0.0), 6)
    rows = counts.selectExpr("total", "total_true", f"stack({len(SIGNATURES)}, {listed}) AS (signature, n, n_true)")
    return rows.select("signature", "n", percent("n", "total").alias("percent"), "n_true", percent("n_true", "total_true").alias("percent_true"))


def signature_overlap(scan: DataFrame) -> DataFrame:
    """n of each of the eight combinations, those without any included."""
    spark = scan.sparkSession
    flags = ["peel_hit", "fanin_hit", "pass_hit"]
    every = spark.range(8).selectExpr(*[f"(id >> {i}) & 1 = 1 AS {f}" for i, f in enumerate(flags)])
    return F.broadcast(every).join(scan.groupBy(*flags).agg(F.count("*").alias("n")), flags, "left").select(*flags, F.coalesce("n", F.lit(0)).alias("n"))


def top_peeling(scan: DataFrame, n: int) -> DataFrame:
    """Hits, true positives first, then by score."""
    return scan.where("peel_hit").orderBy(F.desc("is_true_positive"), F.desc("peel_score"), "target").limit(n)


def hop_detail(cn: DataFrame, txs: DataFrame, gaps: DataFrame) -> DataFrame:
    return cn.join(txs.select("id", "amount"), "id", "left").join(gaps, "id", "left").select("target", "pos", "id", "node_type", "time", "fraud", "ce", "amount", "gap")


#: What a wallet has, by the edge table and the end at which it stands.
PROFILE = (("sent_to", "addr_tx", "src"), ("received_from", "tx_addr", "dst"), ("linked_to", "addr_addr", "src"), ("linked_from", "addr_addr", "dst"))


def wallet_profile(addresses: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """id, relation, other: a row per transaction that each address sent to or received from and per
    wallet it is linked to or from. Rows, not lists, since an address may have any number."""
    own = addresses.select("id").distinct()
    parts = []
    for relation, name, end in PROFILE:
        other = "dst" if end == "src" else "src"
        parts.append(tables[name].select(F.col(end).alias("id"), F.lit(relation).alias("relation"), F.col(other).alias("other")).join(own, "id", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def meeting_pairs(cn: DataFrame) -> DataFrame:
    """a, b: of every node on several chains its first chain (by target) beside each of the others.

    The first one stands for the node, so chains that meet are linked by way of it, and a node
    that many chains pass gives as many pairs, not their square."""
    own = cn.select("id", "target").distinct()
    first = own.groupBy("id").agg(F.min("target").alias("a"))
    return own.join(first, "id").where("a <> target").select("a", F.col("target").alias("b")).distinct()


def near_pairs(rows: DataFrame, number: Column, window: int) -> DataFrame:
    """a, b: all pairs of targets whose whole numbers differ by 1 to `window`, the smaller number first.

    Pairs meet in buckets as wide as the window, of its number and the one before. Where numbers
    are unique, a target has `window` partners on either side at most."""
    numbered = rows.select("target", number.cast("long").alias("k")).distinct()
    bucket = F.floor(F.col("k") / window)
    one = numbered.select(F.col("target").alias("a"), F.col("k").alias("ka"), bucket.alias("bucket"))
    two = numbered.select(F.col("target").alias("b"), F.col("k").alias("kb"), F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
    return one.join(two, "bucket").where((F.col("kb") > F.col("ka")) & (F.col("kb") <= F.col("ka") + window)).select("a", "b")


def pair_links(pairs: DataFrame, cn: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """For pairs (a, b) of chains, how many: direct edges between their roots; wallets linked to both
    roots; transactions that both roots sent to, or were paid by; input wallets of transactions of
    both chains, roots left out; wallets on both chains; edges between wallets of both."""
    roots = cn.where("pos = depth").select("target", F.col("id").alias("root"))
    both = pairs.select("a", "b").distinct().join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b")
    wallets = cn.where("node_type = 'wallet'").select("target", "id").distinct()
    txs = cn.where("node_type = 'transaction'").select("target", "id").distinct()
    links, sends, pays = tables["addr_addr"].select("src", "dst"), tables["addr_tx"].select("src", "dst").distinct(), tables["tx_addr"].select("src", "dst").distinct()
    near = links.union(links.select("dst", "src")).distinct()

    def shared(name: str, of: DataFrame) -> DataFrame:
        """of: key, x; how many x the keys of both roots have."""
        hits = both.join(of.toDF("ra", "x"), "ra").join(of.toDF("rb", "x"), ["rb", "x"])
        return hits.groupBy("a", "b").agg(F.count("*").alias(name))

    def common(name: str, of: DataFrame, without_roots: bool = False) -> DataFrame:
        """of: target, x; how many x both chains have."""
        hits = both.join(of.toDF("a", "x"), "a").join(of.toDF("b", "x"), ["b", "x"])
        hits = hits.where("x <> ra AND x <> rb") if without_roots else hits
        return hits.groupBy("a", "b").agg(F.count("*").alias(name))

    def between(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
        """a, b: (a, b, x) of both sides; edges from one to the other, with repeats."""
        go = a.join(links.withColumnRenamed("src", "x"), "x").withColumnRenamed("x", "from").join(b.withColumnRenamed("x", "dst"), ["a", "b", "dst"]).select("a", "b", "from", "dst")
        back = b.join(links.withColumnRenamed("src", "x"), "x").withColumnRenamed("x", "from").join(a.withColumnRenamed("x", "dst"), ["a", "b", "dst"]).select("a", "b", "from", "dst")
        return go.union(back).distinct().groupBy("a", "b").agg(F.count("*").alias(name))

    inputs = txs.withColumnRenamed("id", "dst").join(sends, "dst").select("target", "src").distinct()
    sides = [pairs.select("a", "b").distinct().join(wallets.toDF(side, "x"), side).select("a", "b", "x") for side in ("a", "b")]
    parts = [
        between("direct_links", both.select("a", "b", F.col("ra").alias("x")), both.select("a", "b", F.col("rb").alias("x"))), shared("shared_neighbours", near), shared("co_spent", sends),
        shared("shared_funders", pays.select("dst", "src")), common("shared_inputs", inputs, True), common("shared_wallets", wallets), between("cross_links", *sides),
    ]
    return reduce(lambda out, part: out.join(part, ["a", "b"], "left"), parts, both.select("a", "b")).na.fill(0)


def block_window(cn: DataFrame, latest: DataFrame) -> DataFrame:
    """target, first_block (0, never received, left out), last_block, n_never."""
    rows = cn.where("node_type = 'wallet'").select("target", "id").distinct().join(latest.select("id", "first_received_block", "last_block"), "id")
    first = F.min(F.when(F.col("first_received_block") != 0, F.col("first_received_block")))
    return rows.groupBy("target").agg(first.alias("first_block"), F.max("last_block").alias("last_block"), F.count(F.when(F.col("first_received_block") == 0, 1)).alias("n_never"))


def chain_times(cn: DataFrame) -> DataFrame:
    """target, times: the distinct known time steps of a chain, ascending."""
    return cn.groupBy("target").agg(F.array_sort(F.collect_set(F.when(F.col("time") >= 0, F.col("time")))).alias("times"))


def pair_distance(pairs: DataFrame, cn: DataFrame, number: Column) -> DataFrame:
    """a, b, min_distance (of transaction numbers of both chains), a_times, b_times.

    The nearest numbers of two chains stand beside each other when both are sorted together, so
    that no pairs of transactions are made."""
    own = cn.where("node_type = 'transaction'").select("target", number.alias("k")).distinct()
    sides = [pairs.select("a", "b").distinct().join(own.withColumnRenamed("target", side), side).select("a", "b", "k", F.lit(side).alias("side")) for side in ("a", "b")]
    by = Window.partitionBy("a", "b").orderBy("k", "side")  # the transactions of two chains
    last = {side: F.last(F.when(F.col("side") == side, F.col("k")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)) for side in ("a", "b")}
    rows = sides[0].unionByName(sides[1]).select("a", "b", (F.col("k") - F.when(F.col("side") == "a", last["b"]).otherwise(last["a"])).alias("d"))
    found = rows.groupBy("a", "b").agg(F.min("d").alias("min_distance"))
    times = chain_times(cn)
    return found.join(times.toDF("a", "a_times"), "a").join(times.toDF("b", "b_times"), "b").select("a", "b", "min_distance", "a_times", "b_times")


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays of one length; null where a norm is 0."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> CAST(p AS DOUBLE) * q), 0D, (s, v) -> s + v)"
    return F.expr(f"{dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0D)")


def cosine_baseline(pairs: DataFrame, rows: DataFrame, columns: list[str], n: int = 2000, seed: int = 42) -> DataFrame:
    """For pairs (a, b) of ids: cosine of their feature rows, the percentage of the baseline below it,
    `differing` (columns whose values differ), and of the baseline median and p95.

    Cosines have nine digits, so that equal ones count as equal. Baseline: n pairs of rows by an arithmetic key of their dense numbers, pairs of one row and
    those without a cosine left out."""
    vectors = rows.select("id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("v"))
    numbered = written(global_ids(rows.select(F.lit("").alias("node_type"), "id", "num")).select("id", F.col("global_id").alias("i")).join(vectors, "id"), "vectors")
    total = numbered.count()
    pick = lambda p, q: F.pmod(F.col("id") * F.lit(p).cast("long") + F.lit(seed * q).cast("long"), F.lit(max(1, total)).cast("long"))
    drawn = rows.sparkSession.range(n).select(pick(7919, 13).alias("i"), pick(104729, 7).alias("j")).where("i <> j")
    base = drawn.join(numbered.select("i", F.col("v").alias("x")), "i").join(numbered.select(F.col("i").alias("j"), F.col("v").alias("y")), "j").select(F.round(cosine("x", "y"), 9).alias("c")).where("c IS NOT NULL")
    base = base.agg(F.array_sort(F.collect_list("c")).alias("sorted"), F.percentile("c", F.lit(0.5)).alias("median"), F.percentile("c", F.lit(0.95)).alias("p95"))  # n numbers
    both = pairs.join(vectors.toDF("a", "x"), "a").join(vectors.toDF("b", "y"), "b")
    names = F.array(*[F.lit(c) for c in columns])
    both = both.select("a", "b", F.round(cosine("x", "y"), 9).alias("cosine"), F.filter(names, lambda c, i: F.get("x", i) != F.get("y", i)).alias("differing"))
    found = both.join(F.broadcast(base), F.lit(True))  # one row
    below = F.size(F.filter("sorted", lambda c: c < F.col("cosine")))
    return found.select("a", "b", "cosine", F.when(F.col("cosine").isNotNull(), 100.0 * below / F.size("sorted")).alias("percentile"), "differing", "median", "p95")


def phi_summary(cn: DataFrame) -> DataFrame:
    """target, phi_total (of |phi_asym|), top_node, top_phi and top_share of each chain with shares, the first among equals
    (to twelve digits, as shares are differences of floats) in flow order."""
    rows = cn.where("phi_asym IS NOT NULL").withColumn("_size", F.abs("phi_asym"))
    top = F.max_by(F.struct("id", "phi_asym"), F.struct(F.round("_size", 12), F.col("pos"))).alias("b")
    found = rows.groupBy("target").agg(F.sum("_size").alias("phi_total"), F.max("_size").alias("_most"), top)
    share = F.when(F.col("phi_total") > 0, F.col("_most") / F.col("phi_total")).otherwise(F.col("_most"))
    return found.select("target", "phi_total", F.col("b.id").alias("top_node"), F.col("b.phi_asym").alias("top_phi"), share.alias("top_share"))


def dossier(found: DataFrame) -> DataFrame:
    """Adjacent falls of amount: target, seq, amount, fall, ratio; cv of the positive falls of the chain."""
    rows = found.where("amount IS NOT NULL")
    before = F.lag("amount").over(flow())
    rows = rows.select("target", "seq", "amount", (before - F.col("amount")).alias("fall"), (F.col("amount") / before).alias("ratio"))
    whole = Window.partitionBy("target")
    fit = (F.count("fall").over(whole) >= 2) & (F.avg("fall").over(whole) > 0)
    return rows.withColumn("cv", F.when(fit, F.stddev_pop("fall").over(whole) / F.avg("fall").over(whole)))


def hit_statistics(scan: DataFrame, fraud: DataFrame, cvs: DataFrame) -> DataFrame:
    """Among peeling hits, by depth: n, share of fraud roots, steady peels, all three signatures."""
    rows = scan.where("peel_hit").join(fraud.select(F.col("id").alias("root")).distinct().withColumn("_f", F.lit(1.0)), "root", "left").join(cvs, "target", "left")
    return rows.groupBy("depth").agg(
        F.count("*").alias("n"), F.round(F.avg(F.coalesce("_f", F.lit(0.0))), 6).alias("fraud_root"),
        F.count(F.when(F.col("cv") < 0.3, 1)).alias("steady"), F.count(F.when(F.col("fanin_hit") & F.col("pass_hit"), 1)).alias("all_three"),
    )
