"""Tables kept in the shared folder, numbering a sorted table, and connected components by falling labels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset, one of this machine's in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/quire"
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder: cuts the lineage and survives a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/quire-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan, or what is mapped from one, dealt evenly over the cores if it has fewer partitions than there are cores; else df.

    For work that costs far more a byte than a shuffle: a small table in one file would leave all but one core idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with name, value worked out once a row however often it is used: as the optimizer doesn't copy it into filters and columns above."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def dropped(df: DataFrame) -> None:
    """Deletes a table of cut() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with name, each row's number from 1 in an order that must be total.

    Rows are sorted by ranges, counted in each, and numbered inside: no task sees more than its range.
    """
    place = {"__part": F.spark_partition_id(), "__n": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(place))
    ahead = F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("__part").count().select("__part", ahead.alias("__ahead"))  # a row a partition
    return placed.join(F.broadcast(parts), "__part").withColumn(name, F.col("__ahead") + F.col("__n") + 1).drop("__part", "__n", "__ahead")


def connected(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node: the smallest node that edges (a, b) reach, the node itself without any.

    Each round takes the smallest label of the neighbours and then the label's own label, so a path halves; a round's
    labels are a table in the shared folder, which the next but one replaces.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    both = cut(both)
    labels = cut(nodes.select(F.col(node).alias("x")).distinct().withColumn("c", F.col("x")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("c").alias("d")), "y").groupBy("x").agg(F.min("d").alias("d"))
        lower = labels.join(near, "x", "left").select("x", F.col("c").alias("old"), F.least("c", "d").alias("c"))
        up = lower.select(F.col("x").alias("c"), F.col("c").alias("top"))
        after = cut(lower.join(up, "c", "left").select("x", "old", F.least("c", "top").alias("c")))
        dropped(labels)
        if not after.where("c <> old").limit(1).count():
            dropped(both)
            return after.select(F.col("x").alias(node), F.col("c").alias("component"))
        labels = after.select("x", "c")
