"""Nearest dense vectors by cosine: exactly in blocks, or behind an inverted file of coarse cells.

Vectors are packed into blocks, a matrix a row, so a comparison of two blocks is one product and what Spark moves and joins
are blocks. Each pair of blocks gives the best k of each query only. The exact form sets the blocks of a stated query set
against all blocks. The inverted file sorts vectors into cells by their nearest centroid; a query looks into the cells
nearest to it. Centroids are fitted on a bounded sample, every row is assigned, and the number of cells to look into is
chosen so that for sampled queries TARGET of the exact neighbours lie in them.

Cells of any size are split: a cell's blocks are dealt to as many parts as its size asks for, and a query block goes to each.

Cases: a null vector, or one with null or non-finite components, is left out, as query and as neighbour; a zero vector's
norm counts as 1, so its cosines are 0; vectors of different lengths are never compared, and those of another length than
the index's first are kept in cell -1, where queries of such lengths look; rows of one key are not each other's
neighbours; ties to nine places go to the smaller key; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.components import cut

BLOCK, QUERY_BLOCK = 2048, 256  # vectors in a block
CELLS, PER_CELL = 4096, 64  # cells at most; vectors of the sample for each
SAMPLE_BYTES = 64 << 20  # of the vectors that centroids are fitted on, and of the centroids
ROUNDS, CHECKED, TARGET = 10, 200, 0.97  # of fitting; queries that choose the number of probes; their neighbours found
PART_BLOCKS = 8  # of a cell that one part joins


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the rows whose vector is all finite numbers."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(key).alias("key"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def _units(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, their vectors scaled to length 1) of each length of vector."""
    at = np.asarray(vectors.offsets).astype(np.int64)
    flat, size = vectors.values.to_numpy(zero_copy_only=False), np.diff(at)
    for n in np.unique(size):
        place = np.flatnonzero(size == n)
        m = flat[at[place][:, None] + np.arange(n)]
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        yield place, m / np.where(norm > 0, norm, 1.0)


def packed(rows: DataFrame, most: int) -> DataFrame:
    """(cell, size, ids, m): rows (cell, key, v) in blocks of up to `most` unit vectors of one cell and length."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def block(which: tuple[int, int]) -> pa.RecordBatch:
            ids, ms = zip(*held.pop(which))
            ids, m = pa.concat_arrays(ids), np.concatenate(ms)
            return pa.RecordBatch.from_arrays([pa.array([which[0]], pa.int32()), pa.array([which[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([m.tobytes()], pa.binary())], names=["cell", "size", "ids", "m"])

        for batch in batches:
            cells = batch.column(0).to_numpy()
            for place, m in _units(batch.column(2)):
                for c in np.unique(cells[place]):
                    own = np.flatnonzero(cells[place] == c)
                    for i in range(0, len(own), most):
                        which, part = (int(c), m.shape[1]), own[i : i + most]
                        if sum(len(x[0]) for x in held.get(which, ())) + len(part) > most:
                            yield block(which)
                        held.setdefault(which, []).append((batch.column(1).take(pa.array(place[part])), m[part]))
            for which in [w for w in held if w[0] != cells[-1]]:  # rows come sorted by cell
                yield block(which)
        for which in list(held):
            yield block(which)

    return rows.select("cell", "key", "v").mapInArrow(run, f"cell int, size int, ids array<{kind}>, m binary")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(qid, key, cosine, cell): for each pair of blocks (q_ids, q_m, ids, m, size, cell) each query's best k of the block, itself left out."""
    q, v = (pairs.schema[c].dataType.elementType.simpleString() for c in ("q_ids", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(len(batch)):
                qs, keys = batch.column(0)[j].values, batch.column(2)[j].values
                size, cell = batch.column(4)[j].as_py(), batch.column(5)[j].as_py()
                a, b = (np.frombuffer(batch.column(c)[j].as_buffer(), float).reshape(-1, size) for c in (1, 3))
                near = np.round(a @ b.T, 9)
                names = keys.to_numpy(zero_copy_only=False)
                near[qs.to_numpy(zero_copy_only=False)[:, None] == names[None, :]] = -np.inf
                turn = np.argsort(np.argsort(names, kind="stable"), kind="stable")  # a key's place among the block's
                rows, cols = [], []
                for i, row in enumerate(near):
                    least = -np.partition(-row, k - 1)[k - 1] if len(row) > k else -np.inf
                    found = np.flatnonzero((row >= least) & (row > -np.inf))
                    cols.append(found[np.lexsort((turn[found], -row[found]))][:k])
                    rows.append(np.full(len(cols[-1]), i))
                r, c = np.concatenate(rows), np.concatenate(cols)
                yield pa.RecordBatch.from_arrays([qs.take(pa.array(r)), keys.take(pa.array(c)), pa.array(near[r, c]), pa.array(np.full(len(r), cell), pa.int32())], names=["qid", "key", "cosine", "cell"])

    return pairs.select("q_ids", "q_m", "ids", "m", "size", "cell").mapInArrow(run, f"qid {q}, key {v}, cosine double, cell int")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("cosine"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _query_blocks(asked: DataFrame) -> DataFrame:
    """Blocks of asked (cell, key, v), named for a join."""
    return packed(asked, QUERY_BLOCK).select(F.col("cell").alias("q_cell"), F.col("size").alias("q_size"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))


def exact_top(queries: DataFrame, rows: DataFrame, k: int = 10, key: str = "key", vector: str = "v") -> DataFrame:
    """(qid, rank, key, cosine): each query's k nearest rows but itself. queries and rows have the columns key and vector."""
    blocks = packed(valid(rows, key, vector).withColumn("cell", F.lit(0)), BLOCK)
    found = _against_all(valid(queries, key, vector), blocks, k)
    return _ranked(found, k).select("qid", "rank", "key", "cosine")


def _against_all(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """_best() of every query block against every block: the stated query set against all rows."""
    q = _query_blocks(asked.withColumn("cell", F.lit(0)))
    return _best(blocks.crossJoin(q).where(F.abs(F.col("size") - F.col("q_size")) < 1), k)  # no equality, which would deal all blocks out by their few sizes


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of the sample's unit vectors, by repeated assignment; a cell that runs empty takes the vector worst served."""
    rng = np.random.default_rng(5)
    centre = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near, served = np.empty(len(sample), np.int64), np.empty(len(sample))
        for i in range(0, len(sample), 4096):
            s = sample[i : i + 4096] @ centre.T
            near[i : i + 4096], served[i : i + 4096] = s.argmax(1), s.max(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=cells) == 0)
        total[empty] = sample[np.argsort(served, kind="stable")[: len(empty)]]
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        centre = np.where(norm > 0, total / np.where(norm > 0, norm, 1.0), centre)
    return centre


def _nearest_cells(rows: DataFrame, centre: np.ndarray, probes: int) -> DataFrame:
    """(cell, key, v): each row once for each of its `probes` nearest cells; in cell -1 if its length isn't that of centroids."""
    shared = rows.sparkSession.sparkContext.broadcast(centre)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                vectors = pa.concat_arrays([part.column(1)])
                for place, m in _units(vectors):
                    if m.shape[1] != c.shape[1]:
                        cell, owner = np.full(len(place), -1), place
                    else:
                        s = m @ c.T
                        best = np.argsort(-s, axis=1, kind="stable")[:, :probes] if probes > 1 else s.argmax(1)[:, None]
                        cell, owner = best.ravel(), np.repeat(place, best.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), part.column(0).take(pa.array(owner)), vectors.take(pa.array(owner))], names=["cell", "key", "v"])

    return rows.select("key", "v").mapInArrow(run, f"cell int, key {kind}, v array<double>")


@dataclass
class InvertedFile:
    """Blocks of vectors by cell, the cells' centroids, and how many cells a query looks into."""

    blocks: DataFrame
    centroids: np.ndarray
    probes: int

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "key", vector: str = "v", k: int = 10, target: float = TARGET, cells: int | None = None) -> InvertedFile:
        """The index of all rows, written to path; probes such that `target` of the k nearest of CHECKED rows lie in their cells."""
        spark, given = rows.sparkSession, valid(rows, key, vector)
        first = given.select(F.size("v")).first()
        if first is None:
            given.select(F.lit(0).alias("cell"), F.lit(0).alias("size"), F.array("key").alias("ids"), F.lit(b"").alias("m")).where("false").write.mode("overwrite").parquet(f"{path}/blocks")
            spark.createDataFrame([], "cell int, probes int, v array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
            return cls.load(spark, path)
        width, n = first[0], given.count()
        most = SAMPLE_BYTES // (8 * width)
        cells = min(cells or int(n**0.5) + 1, CELLS, most, n)
        order = F.xxhash64(F.col("key").cast("string"), "v")
        sample = np.array([r.v for r in given.where(F.size("v") == width).orderBy(order).limit(min(most, cells * PER_CELL)).select("v").collect()])  # SAMPLE_BYTES at most
        norm = np.sqrt((sample * sample).sum(1, keepdims=True))
        centre = fitted(sample / np.where(norm > 0, norm, 1.0), min(cells, len(sample)))
        placed = _nearest_cells(given, centre, 1)
        placed = placed.repartitionByRange("cell", F.xxhash64("v")).sortWithinPartitions("cell")
        packed(placed, BLOCK).write.mode("overwrite").parquet(f"{path}/blocks")
        blocks = spark.read.parquet(f"{path}/blocks")
        probes = cls._probes(given.where(F.size("v") == width).orderBy(order).limit(CHECKED), blocks, centre, k, target)
        spark.createDataFrame([(i, probes, c.tolist()) for i, c in enumerate(centre)], "cell int, probes int, v array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        return cls.load(spark, path)

    @staticmethod
    def _probes(asked: DataFrame, blocks: DataFrame, centre: np.ndarray, k: int, target: float) -> int:
        """How many cells of the sampled queries hold `target` of their k exact neighbours."""
        asked = cut(asked)
        exact = _ranked(_against_all(asked, blocks, k), k).select("qid", "cell").collect()  # CHECKED * k rows
        vectors = {r.key: np.array(r.v) for r in asked.collect()}
        place = {}
        for q, v in vectors.items():
            place[q] = np.argsort(np.argsort(-(centre @ v), kind="stable"), kind="stable")
        ranks = sorted(int(place[r.qid][r.cell]) + 1 for r in exact if r.cell >= 0)
        return ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)] if ranks else 1

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedFile:
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect())  # CELLS rows at most
        return cls(spark.read.parquet(f"{path}/blocks"), np.array([r.v for r in rows]), rows[0].probes if rows else 1)

    def search(self, queries: DataFrame, k: int = 10, key: str = "key", vector: str = "v", probes: int | None = None) -> DataFrame:
        """(qid, rank, key, cosine): each query's k nearest rows, but itself, in the cells that it looks into."""
        asked = valid(queries, key, vector)
        if not len(self.centroids):
            return asked.select(F.col("key").alias("qid"), F.lit(0).alias("rank"), F.col("key"), F.lit(0.0).alias("cosine")).where("false")
        looked = _nearest_cells(asked, self.centroids, min(probes or self.probes, len(self.centroids)))
        q = _query_blocks(looked.repartitionByRange("cell", F.xxhash64("v")).sortWithinPartitions("cell"))
        parts = self.blocks.groupBy("cell").agg(F.ceil(F.count("*") / PART_BLOCKS).cast("int").alias("parts"))  # a row a cell
        held = self.blocks.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("m"), "parts").cast("int"))
        q = q.join(F.broadcast(parts.withColumnRenamed("cell", "q_cell")), "q_cell").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        pairs = held.join(q, (F.col("cell") == F.col("q_cell")) & (F.col("part") == F.col("q_part")) & (F.col("size") == F.col("q_size")))
        return _ranked(_best(pairs, k), k).select("qid", "rank", "key", "cosine")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's (qid, key) that found has; 1 of none."""
    hit = exact.select("qid", "key").join(found.select("qid", "key", F.lit(1).alias("hit")), ["qid", "key"], "left")
    return float(hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0])
