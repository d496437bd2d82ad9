"""What the operators of this subpackage share: the shared folder, written tables,
batch sizes for Arrow and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows of a file, of tables that `sized` deals out.
FILE_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the session names none and its master is local (tests, a single machine)
    is a temporary folder taken and set; a cluster without one is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and host of the file system that Spark takes it to be on, for tasks that open files themselves."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, of about `rows` short rows, to be written in files of FILE_ROWS rows, however many partitions
    the session shuffles into.

    On a local file system a file makes its executor start two processes (chmod of the file and of
    its checksum), and each counts as a second executor of the same size until it runs chmod."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches of long texts small enough for an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def texts(batch: pa.RecordBatch, column: str | int = "text") -> list[str]:
    """The strings of a column, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def batches(schema: pa.Schema, parts: Iterable[list]) -> Iterator[pa.RecordBatch]:
    for columns in parts:
        yield pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )


def unused(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores behind it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small_or_shuffled(rows: DataFrame, limit: int) -> DataFrame:
    """rows, to be sent to all tasks only if they are counted to be `limit` at most; else the
    join that they are for shuffles both sides."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def connected_components(links: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node reachable.

    Alternating large-star and small-star rounds, until the edges are stars: no node has nodes on
    both sides or two below it, which a large-star sees on its way and marks. So no round is made,
    and nothing is joined, only to see that nothing changes. Every round writes its edges to
    the shared folder, in files by their number (rows: about how many links there are, where
    that is known). A hub only ever meets its own minimum (aggregated before the
    shuffle) in an equi-join that adaptive execution may split. Nulls and self-links
    are left out; an empty input gives an empty result."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = written(edges if rows is None else sized(edges, rows), "links")
    rows = edges.count()  # rounds do not add any
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # m: the smallest of a node and its neighbours; several: it has two different ones below it, told by one row.
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("below"))
        least = least.select("u", F.least("u", "m").alias("m"), F.coalesce(F.col("below") > F.col("m"), F.lit(False)).alias("several"))
        above = F.col("v") > F.col("u")
        large = both.join(least, "u").where(above | F.col("several") & (F.col("v") == F.col("m")))
        large = large.select(F.when(above, F.col("v")).alias("u"), F.when(above, F.col("m")).alias("v"), (~above | (F.col("m") < F.col("u"))).alias("changed"))
        # Rows may repeat here: there are no more than edges, and the small-star drops repeats.
        large = written(sized(large, rows), "large-star")
        if large.where("changed").isEmpty():
            break
        moving = large.where("u IS NOT NULL").select("u", "v")
        least = moving.groupBy("u").agg(F.min("v").alias("m"))
        moved = moving.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(sized(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), rows), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
