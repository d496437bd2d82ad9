"""The eight graph tables, chain files and graph exports, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootward.functions.tables import running_sums, written
from rootward.operators.nodes import global_ids

#: The tables of a graph directory and the columns that each must have.
GRAPH_TABLES = {
    "txs_features": ("txId", "Time step"),
    "txs_classes": ("txId", "class"),
    "txs_edgelist": ("txId1", "txId2"),
    "wallets_features": ("address",),
    "wallets_classes": ("address", "class"),
    "AddrTx_edgelist": ("input_address", "txId"),
    "TxAddr_edgelist": ("txId", "output_address"),
    "AddrAddr_edgelist": ("input_address", "output_address"),
}
#: Prefixes of feature columns that are kept or have no known meaning.
LOCAL, AGGREGATE = "Local_feature_", "Aggregate_feature_"
#: Names in chain files, in order, and those that packed rows of shares add.
NODE_FIELDS = {"pos": "int", "type": "string", "real_id": "string", "time": "int", "fraud": "boolean", "is_target": "boolean", "ce": "double", "phi_add": "double", "phi_asym": "double"}
HEAD_FIELDS = {"target_txid": "string", "depth": "int", "root_type": "string", "root_real_id": "string", "root_is_fraud": "boolean", "is_true_positive": "boolean"}
CSV_COLUMNS = ("target_txid", "depth", "root_type", "root_real_id", "root_is_fraud", "is_true_positive", "n_nodes", "chain_real_ids", "chain_types", "chain_ce")
SHARE_COLUMNS = ("chain_phi_add", "chain_phi_asym")
META_FIELDS = {"dataset": "string", "n_chains": "long", "n_true_positive": "long", "n_fraud_root": "long", "mean_depth": "double"}
#: What this library calls them.
OWN_NAMES = {"target_txid": "target", "root_real_id": "root", "type": "node_type", "real_id": "id"}
_struct = lambda fields: "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"
CHAIN = _struct(HEAD_FIELDS | {"nodes": f"array<{_struct(NODE_FIELDS)}>"})
#: Labels of run logs and the short names of their metrics; labels of the blocks per ground truth.
LOG_LABELS = {
    "Auc": "AUC", "Root Cause Precision True Pos": "RCP_TP", "Root Cause Precision": "RCP", "Root Cause Hit Rate": "Hit", "Chain Validity": "ChainVal",
    "Mean Tracing Depth": "MTD", "Num Traced": "nTraced", "Num True Pos Traced": "nTP", "Phi Stability Std": "phiStd",
}
BLOCK_LABELS = {"Explanation Accuracy": "EA", "Explanation Recall": "ER", "Gt Match Accuracy": "GT"}
#: Names before `=`, names in the lines of a node type, and how lines of types and of blocks begin.
ASSIGNED_LABELS = {"Headline F1-score (fraud class)": "pooled", "WALLCLOCK_SECONDS": "sec"}
TYPE_FIELDS = {"fraud_f1": "F1", "pred_rate": "rate", "thr": "thr"}
TYPE_START, BLOCK_START, BLOCK_NAME = "·", "[Metric C", "GT"


def load_graph_tables(spark: SparkSession, path: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """All tables by name, blanks around column names dropped; a missing file or column is an error."""
    found = {}
    for name, required in GRAPH_TABLES.items():
        file = f"{path}/{name}.{fmt}"
        df = spark.read.csv(file, header=True) if fmt == "csv" else spark.read.format(fmt).load(file)
        df = df.toDF(*[c.strip() for c in df.columns])
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"{file}: no column {', '.join(missing)}")
        found[name] = df
    return found


def feature_columns(df: DataFrame, node_type: str, per_address: bool = False) -> list[str]:
    """Kept feature names: local ones and statistics of transactions, without aggregates; all of
    wallets but the address (and the time step, unless rows are per address and step)."""
    drop = {"txId", "Time step"} if node_type == "transaction" else {"address"} | (set() if per_address else {"Time step"})
    return [c for c in df.columns if c not in drop and not c.startswith(AGGREGATE)]


def is_anonymous(name: str) -> bool:
    return name.startswith((LOCAL, AGGREGATE))


def _as_stored(records: DataFrame) -> DataFrame:
    """Chain records under the names of chain files."""
    node = lambda n: F.struct(*[n[OWN_NAMES.get(k, k)].alias(k) for k in NODE_FIELDS])
    return records.select(*[F.col(OWN_NAMES.get(k, k)).alias(k) for k in HEAD_FIELDS], F.transform("nodes", node).alias("nodes"))


def _as_records(rows: DataFrame) -> DataFrame:
    """Chain files' rows under this library's names; one without its target or its nodes is an error."""
    ok = F.col("target_txid").isNotNull() & (F.size("nodes") == F.col("depth") + 1)
    checked = rows.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("a chain record lacks its target or nodes")).isNull())
    node = lambda n: F.struct(*[n[k].alias(OWN_NAMES.get(k, k)) for k in NODE_FIELDS])
    return checked.select(*[F.col(k).alias(OWN_NAMES.get(k, k)) for k in HEAD_FIELDS], F.transform("nodes", node).alias("nodes"))


def write_chains_json(records: DataFrame, path: str, dataset: str = "graph") -> DataFrame:
    """Chains as JSON lines, and the meta row beside them, which is returned."""
    _as_stored(records).write.mode("overwrite").json(f"{path}/chains")
    meta = chain_meta(records, dataset)
    meta.write.mode("overwrite").json(f"{path}/meta")
    return meta


def chain_meta(records: DataFrame, dataset: str = "graph") -> DataFrame:
    count = lambda c: F.count(F.when(F.col(c), 1))
    return records.agg(F.lit(dataset).alias("dataset"), F.count("*").alias("n_chains"), count("is_true_positive").alias("n_true_positive"), count("root_is_fraud").alias("n_fraud_root"), F.coalesce(F.round(F.avg("depth"), 2), F.lit(0.0)).alias("mean_depth"))


def read_chains_json(spark: SparkSession, path: str) -> DataFrame:
    """The chains of a folder that `write_chains_json` wrote."""
    fields = ", ".join(f"{k} {v}" for k, v in HEAD_FIELDS.items())
    return _as_records(spark.read.schema(f"{fields}, nodes array<{_struct(NODE_FIELDS)}>").json(f"{path}/chains"))


def read_chains_document(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The chains of `{meta, chains}` documents: a document per file or, without multi_line, per line.
    A document without `chains` is an error."""
    rows = spark.read.schema(f"meta {_struct(META_FIELDS)}, chains array<{CHAIN}>").json(path, multiLine=multi_line)
    # In the list itself, since Spark drops rows without a list before any other test of them.
    none = F.raise_error(F.lit("a chain document has no chains")).cast(f"array<{CHAIN}>")
    return _as_records(rows.select(F.explode(F.when(F.col("chains").isNull(), none).otherwise(F.col("chains"))).alias("c")).select("c.*"))


def write_chains_csv(rows: DataFrame, path: str) -> None:
    """A header even where there are no rows; columns of shares where the rows have them."""
    columns = [*CSV_COLUMNS, *[c for c in SHARE_COLUMNS if c in rows.columns]]
    own = rows.select(*columns)
    (own.coalesce(1) if own.isEmpty() else own).write.mode("overwrite").csv(path, header=True, emptyValue="")


def read_chains_csv(spark: SparkSession, path: str) -> DataFrame:
    """target, pos, id, global_id, node_type, fraud, ce of packed rows.

    The header must begin with the ten names in order. Rows with fewer cells go, and so do rows
    whose ids and types differ in number. A target's mark is is_true_positive, a root's
    root_is_fraud, all others are unknown and false; effects that are no numbers are null. global_id
    numbers ids from 0 in the order in which they are first seen. No row left is an error."""
    header = [c.strip() for c in spark.read.csv(path, header=True).columns]
    if tuple(header[: len(CSV_COLUMNS)]) != CSV_COLUMNS:
        raise ValueError(f"{path}: the header is {', '.join(header)}, not {', '.join(CSV_COLUMNS)}")
    schema = ", ".join(f"`{c}` string" for c in header) + ", _short string"
    raw = spark.read.option("columnPruning", False).csv(path, header=True, schema=schema, enforceSchema=True, columnNameOfCorruptRecord="_short").where("_short IS NULL")
    split = raw.select("target_txid", "root_is_fraud", "is_true_positive", *[F.split(F.coalesce(c, F.lit("")), r"\|").alias(c) for c in CSV_COLUMNS[7:]], F.monotonically_increasing_id().alias("line"))
    kept = split.where(F.size("chain_real_ids") == F.size("chain_types"))
    yes = lambda c: F.lower(F.trim(c)) == "true"
    cells = kept.select(F.trim("target_txid").alias("target"), yes("root_is_fraud").alias("_r"), yes("is_true_positive").alias("_t"), "line", F.size("chain_real_ids").alias("n"), F.posexplode(F.arrays_zip("chain_real_ids", "chain_types", "chain_ce")).alias("pos", "x")).where(F.col("pos") < F.col("n"))
    fraud = F.when(F.col("pos") == 0, F.col("_t")).when(F.col("pos") == F.col("n") - 1, F.col("_r")).otherwise(False)
    cells = written(cells.select("target", "pos", F.trim("x.chain_real_ids").alias("id"), F.trim("x.chain_types").alias("node_type"), fraud.alias("fraud"), F.trim("x.chain_ce").try_cast("double").alias("ce"), "line"), "chain-cells")
    if cells.isEmpty():
        raise ValueError(f"{path}: no chain can be read")
    # Lines are numbered by partition and place, so partitions are the parts of the order.
    first = cells.groupBy("id").agg(F.min(F.struct("line", "pos")).alias("f")).select("id", "f.line", "f.pos", F.floor(F.col("f.line") / 2**33).alias("part"), F.lit(1).cast("long").alias("one"))
    numbered = running_sums(first, [], "part", ["line", "pos", "id"], "one", "rank").select("id", (F.col("rank") - 1).alias("global_id"))
    return cells.drop("line").join(numbered, "id").select("target", "pos", "id", "global_id", "node_type", "fraud", "ce")


def dag_tables(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, dataset: str = "graph") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, nodes, links) of a causal graph: its nodes with type, time, label (type and number
    within the type), fraud and seed mark; one row of counts, with those by type as a map."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    marks = seeds.select("id").distinct().withColumn("is_seed", F.lit(True))
    numbers = global_ids(nodes)
    offsets = numbers.groupBy("node_type").agg(F.min("global_id").alias("_offset"))
    local = numbers.join(F.broadcast(offsets), "node_type").select("id", F.concat("node_type", F.lit("#"), (F.col("global_id") - F.col("_offset")).cast("string")).alias("label"))  # a row per type
    own = nodes.join(ids, "id", "left_semi").join(marks, "id", "left").join(local, "id")
    own = own.select("id", F.col("node_type").alias("type"), "time", "label", (F.col("class") == 1).alias("fraud"), F.coalesce("is_seed", F.lit(False)).alias("is_seed"))
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("etype"))
    count = lambda c: F.count(F.when(c, 1))
    by_type = own.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("node_types"))  # a row per type
    meta = own.agg(F.lit(dataset).alias("dataset"), F.count("*").alias("n_nodes"), count(F.col("fraud")).alias("n_fraud"), count(F.col("is_seed")).alias("n_seed"), count(F.col("time") >= 0).alias("n_timed"), F.min("time").alias("time_min"), F.max("time").alias("time_max"))
    return meta.join(links.agg(F.count("*").alias("n_links")), F.lit(True)).join(by_type, F.lit(True)), own, links  # one row each


def write_dag_export(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, path: str, dataset: str = "graph") -> None:
    """meta, nodes and links as JSON lines in folders of these names."""
    for name, df in zip(("meta", "nodes", "links"), dag_tables(nodes, edges, seeds, dataset), strict=True):
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """file, run, block, metric, value of run logs, a log per file; run is the file's name without `eval_` and ending.

    Lines `label: number` by known labels, the first of each; a metric per type of the
    classification lines; the headline; seconds; and, with the block's ground truth as `block`, the
    explanation metrics between its mark and the next one. Unknown lines give nothing.

    Logs are read by lines, a long one by several tasks, which keep the lines that say something. A
    line's place is the range of the file and the number within it, so the mark that a line stands
    under is found within its range or is the last one of the ranges before."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("line"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text")
    )
    found = written(lines.select("file", "range", "line", _said(F.col("text")).alias("said"), _mark(F.col("text")).alias("mark")).where("mark IS NOT NULL OR size(said) > 0"), "log-lines")
    place = F.struct("range", "line")
    marks = found.where("mark IS NOT NULL").groupBy("file", "range").agg(F.max(F.struct(place.alias("at"), F.col("mark").alias("block"))).alias("last"))
    # A row per range that holds a mark.
    ranges = found.select("file", "range").distinct().join(marks, ["file", "range"], "left")
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "range", F.last("last", ignorenulls=True).over(earlier).alias("_before"))
    here = Window.partitionBy("file", "range").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("mark").isNotNull(), F.struct(place.alias("at"), F.col("mark").alias("block")))
    rows = found.withColumn("_own", F.last(own, ignorenulls=True).over(here)).join(ranges, ["file", "range"])
    rows = rows.select("file", place.alias("place"), F.coalesce("_own", "_before").alias("under"), F.explode("said").alias("m"))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    rows = rows.select("file", F.regexp_replace(name, "^eval_", "").alias("run"), "place", "under", "m.*")
    # Explanation metrics count within their block, once in each; lines of types all count, others once in a file.
    inside = F.col("kind") == "block"
    once = F.when(inside, F.struct(F.col("under.at.range"), F.col("under.at.line"))).when(F.col("kind") == "type", F.struct(F.col("place.range"), F.col("place.line")))
    rows = rows.where(~inside | F.col("under").isNotNull()).withColumn("once", once).withColumn("block", F.when(inside, F.col("under.block")))
    first = rows.groupBy("file", "run", "block", "metric", "once").agg(F.min_by("number", "place").alias("value"))
    return first.select("file", "run", "block", "metric", "value")


def _said(text: Column) -> Column:
    """(kind, metric, number) of what a line, blanks made single, says."""
    known = lambda labels: F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    number = lambda value: value.try_cast("double")
    row = lambda kind, metric, value: F.struct(F.lit(kind).alias("kind"), metric.alias("metric"), number(value).alias("number"))
    label, behind = F.trim(F.substring_index(text, ":", 1)), F.trim(F.substring_index(text, ":", -1))
    plain = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))) == 1
    rows = [F.when(plain, row("line", F.try_element_at(known(LOG_LABELS), label), behind)), F.when(plain, row("block", F.try_element_at(known(BLOCK_LABELS), label), behind))]
    value = F.trim(F.substring_index(text, "=", -1))
    for name, metric in ASSIGNED_LABELS.items():
        rows.append(F.when(F.endswith(F.trim(F.substring_index(text, "=", 1)), F.lit(name)), row("line", F.lit(metric), value)))
    words = F.split(text, " ")
    fields = F.transform(F.filter(words, lambda w: F.contains(w, F.lit("="))), lambda w: F.struct(F.substring_index(w, "=", 1).alias("name"), F.substring_index(w, "=", -1).alias("value")))
    named = lambda name: F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))["value"]
    of_type = F.startswith(text, F.lit(TYPE_START + " "))
    for name, metric in TYPE_FIELDS.items():
        rows.append(F.when(of_type, row("type", F.concat(F.get(words, F.lit(1)), F.lit(f"_{metric}")), named(name))))
    return F.filter(F.array(*rows), lambda r: r.isNotNull() & r["metric"].isNotNull() & r["number"].isNotNull())


def _mark(text: Column) -> Column:
    """The ground truth that a line marks the block of."""
    head, name = F.substring_index(text, "=", 1), F.trim(F.substring_index(F.substring_index(text, "=", -1), "]", 1))
    return F.when(F.startswith(text, F.lit(BLOCK_START)) & F.endswith(F.trim(head), F.lit(BLOCK_NAME)) & F.contains(text, F.lit("]")), name)


def run_summary(metrics: DataFrame, names: list[str], modes: list[str], order_by: str = "RCP_TP") -> DataFrame:
    """A row per log: a column per metric, and per explanation metric and mode (EA_strict, ...); the
    best of order_by first, runs without it last."""
    columns = [*names, *[f"{short}_{mode}" for mode in modes for short in BLOCK_LABELS.values()]]
    key = F.when(F.col("block").isNull(), F.col("metric")).otherwise(F.concat("metric", F.lit("_"), "block"))
    wide = metrics.withColumn("_key", key).groupBy("file", "run").pivot("_key", columns).agg(F.first("value"))
    return wide.orderBy(F.desc_nulls_last(order_by), "run", "file")
