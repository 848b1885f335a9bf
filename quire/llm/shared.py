"""Storage and id helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few longs up to this count (20 MB or so as a hash table) may be broadcast; above it Spark shuffles instead.
BROADCAST_ROWS = 250_000

#: Bytes of an Arrow batch, about; a longer row is a batch of its own.
BATCH, ARROW_LIMIT = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

#: A key with more rows than HOT_ROWS, and than the HOT_KEYS-th part of all, is hot: so there are HOT_KEYS hot keys at most.
HOT_ROWS, HOT_KEYS = 1000, 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Unset, it is one of this machine's where driver and tasks are one process; on a cluster that would lose data, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/quire"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, upper and lower case being one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame, *without: str) -> list[Column]:
    """df's columns whatever their names, but for those named."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in without]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that tasks hand to Python by BATCH bytes, unless the session has a limit of its own.

    A task holds a batch in the JVM, where its buffers double while they fill, and in Python, beside what is made of it;
    Spark's own limit, 64 MB, is a large part of a small executor. The plans made from here on keep to it.
    """
    if spark.conf.get(ARROW_LIMIT, None) is None:
        spark.conf.set(ARROW_LIMIT, str(BATCH))


def from_rows(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    """A few rows of the driver as a DataFrame, handed over as an Arrow table.

    Lists go through an RDD, for which every executor starts Python workers beside those of Arrow functions and keeps both.
    """
    cells = [[r[k] for r in rows] for k in range(len(kinds))]
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), cells)}))


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    spark = tables[0].sparkSession
    for path in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        drop_path(spark, path)
    # Lets the context cleaner find shuffles that only dropped plans refer to, so disks don't fill up in long loops.
    spark.sparkContext._jvm.System.gc()


def only_ids(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """df's rows whose key is in ids; ids is broadcast only if it has BROADCAST_ROWS rows at most."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, on, "left_semi")


def hot_keys(rows: DataFrame, on: str, least: int = HOT_ROWS) -> list:
    """The keys of rows, null left out, that are so common that a shuffle by them would be uneven: HOT_KEYS at most."""
    counts = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("__times"))
    return [r[0] for r in counts.where(F.col("__times") > max(least, rows.count() // HOT_KEYS)).select(on).collect()]


def spread_join(rows: DataFrame, table: DataFrame, on: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """rows joined (inner, left or left_semi) to table, which has one row a key, without one key's rows meeting in a task.

    Rows of hot keys stay where they are and meet the table's rows of those keys, HOT_KEYS at most, by broadcast;
    all others are shuffled, whatever their number. rows are read twice, and once more to find the hot keys if not given.
    """
    hot = hot_keys(rows, on) if hot is None else hot
    nulls = rows.where(F.col(on).isNull()) if how == "left" else None  # else they would meet in one task
    rows = rows.where(F.col(on).isNotNull()) if how == "left" else rows
    out = rows.join(table, on, how)
    if hot:
        common = F.col(on).isin(hot)
        out = rows.where(~common).join(table, on, how).unionByName(rows.where(common).join(F.broadcast(table.where(common)), on, how))
    return out.unionByName(nulls, allowMissingColumns=True) if nulls is not None else out


def hot_parts(rows: DataFrame, on: str, least: int = HOT_ROWS) -> list[tuple]:
    """(key, parts) of the keys that hot_keys() finds: how many parts each has to be cut into to be hot no more."""
    counts = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("__times"))
    total = rows.count()
    if total <= least:
        return []
    limit = max(least, total // HOT_KEYS)
    return [(r[0], -(-r[1] // limit)) for r in counts.where(F.col("__times") > limit).collect()]


def salted_join(rows: DataFrame, table: DataFrame, on: str, hot: list[tuple] | None = None) -> DataFrame:
    """The inner join of rows and table, both with any number of rows a key, without one key's rows meeting in a task.

    A hot key's rows are spread by a hash of their columns over as many parts as hot_parts() says, and the table's rows
    of that key are repeated for each part. So the repeated rows are fewer than the join's result, and only the hot
    keys themselves, HOT_KEYS at most, are broadcast. rows are read once more to find the hot keys if not given.
    """
    hot = hot_parts(rows, on) if hot is None else hot
    if not hot:
        return rows.join(table, on)
    kind = rows.schema[on].dataType.simpleString()
    keys = pa.array([k for k, _ in hot])
    parts = F.broadcast(from_rows(rows.sparkSession, hot, {on: keys.type, "__parts": pa.int32()}).withColumn(on, F.col(f"`{on}`").cast(kind)))
    salt = F.coalesce(F.pmod(F.xxhash64(*columns(rows)), F.col("__parts")), F.lit(0)).cast("int")
    left = rows.join(parts, on, "left").withColumn("__salt", salt).drop("__parts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))
    right = table.join(parts, on, "left").withColumn("__salt", each).drop("__parts")
    return left.join(right, [on, "__salt"]).drop("__salt")


#: Edges that a task joins into components at once, about 20 MB.
TASK_EDGES = 500_000


def _stars(edges: DataFrame, tasks: int) -> DataFrame:
    """(node, other): in each of the tasks, every node beside the smallest node that the task's edges (node, other) join it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        x, y = (np.concatenate(c) for c in zip(*held))
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y = at[: len(x)], at[len(x) :]
        top = np.arange(len(nodes))
        while True:  # labels fall along edges, then along themselves
            before = top.copy()
            low = np.minimum(top[x], top[y])
            np.minimum.at(top, top[x], low)
            np.minimum.at(top, top[y], low)
            while (top[top] != top).any():
                top = top[top]
            if (before == top).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[top])], names=["node", "other"])

    return edges.coalesce(tasks).mapInArrow(run, "node long, other long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list of longs: (node, component), component being the smallest node reachable.

    Tasks of up to TASK_EDGES edges first join what their own edges join, which leaves a star for each of their
    components. If that took more than one task, labels start as the smaller end of any star's edge and fall to the
    smallest neighbour's label; after each round every label is replaced by its own label (pointer jumping), so long
    paths shrink by half. Only nodes with an edge come back. Self loops and repeated edges are allowed; an edge with a
    null end is ignored. An empty list gives no rows.
    """
    given = stored(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where(F.col("node").isNotNull() & F.col("other").isNotNull()), "given")
    tasks = -(-given.count() // TASK_EDGES)
    stars = stored(_stars(given, max(1, tasks)), "stars")
    drop_stored(given)
    if tasks <= 1:
        return stars.withColumnRenamed("other", "component")
    both = stored(
        stars
        .withColumn("way", F.explode(F.array(F.lit(True), F.lit(False))))
        .select(F.when(F.col("way"), F.col("node")).otherwise(F.col("other")).alias("node"), F.when(F.col("way"), F.col("other")).otherwise(F.col("node")).alias("other"))
        .distinct(),
        "edges",
    )
    drop_stored(stars)
    hubs = hot_keys(both, "other")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    while True:
        near = (
            spread_join(both, labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other", hot=hubs)
            .groupBy("node")
            .agg(F.min("c").alias("c"))
        )
        lower = stored(labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component")), "lower")
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = spread_join(lower, up, "component", "left").select("node", "old", F.least("component", "top").alias("component"))
        after = stored(jumped, "labels")
        drop_stored(labels)
        drop_stored(lower)
        moved = after.where(F.col("old") != F.col("component")).limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            drop_stored(both)
            return labels
