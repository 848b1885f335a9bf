"""Embedding near-dedup by NN-descent.

Equal embeddings become one class first. A neighbour graph over the classes starts from a forest of random projections
(vectors sorted by their side of random planes, neighbouring runs compared; so many trees that START of the pairs at
the threshold should meet in one) and is refined by neighbours-of-neighbours joins: each vector is a pivot that compares
the vectors on its list, and those on whose list it is, with each other, if at least one of the two is new there; every
vector keeps its k nearest. A pivot that very many vectors have on their lists compares 2 k of them a round; the others
stay new for a later one. Rounds end when they give hardly any new links.

A vector whose list holds only links is saturated: it may have more. Its list is enlarged to its component, in which
its links are counted in bounded squares of vectors; no pair of a large group becomes a row, as the runs and joins give
beyond the lists only a forest of the links they see. Components of up to SQUARE vectors are counted that way throughout.

The audit draws further trees that the graph has not seen. Their links are found independently of it, so the share of
them that lies inside the graph's components tells its recall; a link that a tree is less likely to show weighs more.
This needs no comparison with all vectors, and sees the more links the more there are, however rare among vectors. Below
RECALL the audit's trees join the graph, k is doubled if lists are saturated, and it is refined and audited by new trees
again; there is no other end. The last audit's links join the result, too.

Cases: embeddings that are null, empty, zero, or hold null or non-finite components link with nothing, as do those of
another length; a null vec_id links with nothing, its component is null and it isn't kept; of several embeddings under
one vec_id the smallest counts, so each vec_id gives one row; ties in a list go to the smaller id; an empty table gives no rows;
further columns are ignored. Where no tree shows any link the audit has nothing to judge by and gives None.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.groups import column, groups
from quire.llm.shared import components, drop_stored, spread_join, stored

log = logging.getLogger(__name__)

THRESHOLD = 0.9
K, LEAF, START, STILL = 12, 64, 0.95, 0.01
TOGETHER = 4  # trees that are planted at once
SQUARE, RECALL, SEED = 1024, 0.99, 11


def _valid(e: Column) -> Column:
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: F.coalesce(x != 0, F.lit(False)))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of length 1, in double precision, of vectors of one length."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(raw: list[bytes]) -> Iterator[np.ndarray]:
    size = np.array([len(r) for r in raw])
    for s in np.unique(size):
        yield np.flatnonzero(size == s)


def _pairs(v: np.ndarray, u: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(s)], names=["v", "u", "s"])


PAIR = "v long, u long, s double"


def _bits(n: int) -> int:
    return max(1, min(24, math.ceil(math.log2(max(2, n / LEAF)))))


def _meets(s: float, n: int) -> float:
    """The chance, about, that a tree compares two of n vectors of cosine s."""
    return (1 - math.acos(min(1.0, s)) / math.pi) ** _bits(n)


def _forest_of(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph that a symmetric boolean matrix gives."""
    top = np.arange(len(links))
    a, b = np.nonzero(np.triu(links, 1))
    kept = []
    for k, (i, j) in enumerate(zip(a, b)):
        if top[i] != top[j]:
            top[top == top[j]] = top[i]
            kept.append(k)
    return a[kept], b[kept]


def _near(s: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """The wanted pairs and, where links are left out, a forest of the links, both ways."""
    a, b = np.nonzero(wanted)
    links = s >= THRESHOLD
    if (links & ~wanted).any():
        x, y = _forest_of(links)
        a, b = np.concatenate([a, x, y]), np.concatenate([b, y, x])
    return _pairs(ids[a], ids[b], s[a, b])


def _forest(vectors: DataFrame, n: int, k: int, kind: str, trees: range) -> DataFrame:
    """Each vector's k nearest in its run of LEAF vectors, in the order of each tree."""
    bits = _bits(n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for at in _by_length(raw):
                x = _unit([raw[i] for i in at], kind)
                for tree in trees:
                    planes = np.random.default_rng(SEED + tree).standard_normal((bits + 1, x.shape[1]))
                    side = x @ planes.T
                    code = ((side[:, :bits] > 0) * (1 << np.arange(bits)[::-1])).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree)), pa.array(code), pa.array(side[:, bits]), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["tree", "code", "side", "id", "vec"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), LEAF):
                run = batch.slice(i, LEAF)
                raw, ids = run.column(4).to_pylist(), run.column(3).to_numpy()
                for at in _by_length(raw):
                    x = _unit([raw[j] for j in at], kind)
                    own = ids[at]
                    s = x @ x.T
                    s[own[:, None] == own[None, :]] = -2
                    keep = min(k, len(at) - 1)
                    if keep < 1:
                        continue
                    wanted = np.zeros(s.shape, bool)
                    np.put_along_axis(wanted, np.argpartition(-s, keep - 1, 1)[:, :keep], True, 1)
                    yield _near(s, wanted & (s > -2), own)

    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, n * len(trees) // 100_000)
    placed = vectors.select("id", "vec").mapInArrow(place, "tree long, code long, side double, id long, vec binary")
    return placed.repartitionByRange(parts, "tree", "code", "side").sortWithinPartitions("tree", "code", "side").mapInArrow(near, PAIR)


def _lists(pairs: DataFrame, old: DataFrame | None, k: int, waiting: DataFrame | None = None) -> DataFrame:
    """(id, u array, s array, fresh array, kth): each vector's k nearest of old and new pairs; fresh are new ones and those of waiting (v, u).

    All steps group by v or finer, so one shuffle by v serves them all.
    """
    rows = pairs.select("v", "u", "s", F.lit(1).alias("kind"))
    if old is not None:
        rows = rows.unionByName(old.select(F.col("id").alias("v"), F.explode(F.arrays_zip("u", "s")).alias("e")).select("v", "e.u", "e.s", F.lit(0).alias("kind")))
    if waiting is not None:
        rows = rows.unionByName(waiting.select("v", "u", F.lit(None).cast("double").alias("s"), F.lit(2).alias("kind")))
    fresh = (F.min("kind") == 1) | ((F.min("kind") == 0) & (F.max("kind") == 2))
    rows = rows.repartition("v").groupBy("v", "u").agg(F.max("s").alias("s"), fresh.alias("fresh")).where("s is not null")
    turn = F.row_number().over(W.partitionBy("v").orderBy(F.desc("s"), "u"))
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= k).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("turn", "u", "s", "fresh"))).alias("e"))
    return rows.select(F.col("v").alias("id"), F.col("e.u").alias("u"), F.col("e.s").alias("s"), F.col("e.fresh").alias("fresh"), F.when(F.size("e") < k, F.lit(-1.0)).otherwise(F.element_at("e", -1)["s"]).alias("kth"))


def _pivots(lists: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((p, u, fresh): the vectors that each pivot compares, 2 k at most, fresh ones first; (v, u): entries that had to wait)."""
    e = lists.select("id", F.explode(F.arrays_zip("u", "fresh")).alias("e")).select(F.col("id").alias("p"), "e.u", "e.fresh")
    both = e.unionByName(e.select(F.col("u").alias("p"), F.col("p").alias("u"), "fresh")).repartition("p").groupBy("p", "u").agg(F.max("fresh").alias("fresh"))
    each = W.partitionBy("p")
    place = F.row_number().over(each.orderBy(F.col("fresh").desc(), F.xxhash64("p", "u")))
    both = both.withColumn("place", place).withColumn("some", F.max("fresh").over(each)).where("some and (fresh or place <= %d)" % (2 * k))
    both = stored(both.select("p", "u", "fresh", "place"), "pivots")
    wait = both.where(F.col("place") > 2 * k).select(F.col("p").alias("v"), "u")
    return both.where(F.col("place") <= 2 * k).select("p", "u", "fresh"), wait.unionByName(wait.select(F.col("u").alias("v"), F.col("v").alias("u")))


def _join(vectors: DataFrame, lists: DataFrame, pivots: DataFrame, kind: str) -> DataFrame:
    """New pairs (v, u, s): the vectors of each pivot compared, if one of the two is fresh there and either takes the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 1):
            ids, fresh, kth = column(t, "u"), column(t, "fresh"), column(t, "kth")
            raw = t.column("vec").to_pylist()
            if len(ids) < 2 or not fresh.any():
                continue
            for at in _by_length(raw):
                x = _unit([raw[i] for i in at], kind)
                s = x @ x.T
                s[~(fresh[at][:, None] | fresh[at][None, :])] = -2
                np.fill_diagonal(s, -2)
                found = _near(s, s > kth[at][:, None], ids[at])
                if len(found):
                    yield found

    carried = vectors.select(F.col("id").alias("u"), "vec").join(lists.select(F.col("id").alias("u"), "kth"), "u", "left").withColumn("kth", F.coalesce("kth", F.lit(-1.0)))
    rows = pivots.join(carried, "u").select("p", "u", "fresh", "kth", "vec")
    return rows.repartition("p").sortWithinPartitions("p").mapInArrow(run, PAIR)


class Graph:
    """The neighbour graph: lists of the k nearest found, and links as (a, b) that join its components."""

    def __init__(self, vectors: DataFrame, n: int, kind: str):
        self.vectors, self.n, self.kind, self.k = vectors, n, kind, K
        self.lists: DataFrame | None = None
        self.links: DataFrame | None = None
        self.trees = self.turns = 0

    def plant(self, trees: int) -> DataFrame:
        """The pairs of further trees, stored."""
        pairs = stored(_forest(self.vectors, self.n, self.k, self.kind, range(self.trees, self.trees + trees)), "pairs")
        self.trees += trees
        return pairs

    def add(self, pairs: DataFrame, waiting: DataFrame | None = None) -> float:
        """Takes in pairs and drops them; the share of new links among those on lists."""
        links = stored(pairs.where((F.col("s") >= THRESHOLD) & (F.col("v") < F.col("u"))).select(F.col("v").alias("a"), F.col("u").alias("b")), "links")
        self.links = links if self.links is None else self.links.unionByName(links)
        after = stored(_lists(pairs, self.lists, self.k, waiting), "lists")
        drop_stored(pairs)
        if self.lists is not None:
            drop_stored(self.lists)
        self.lists = after
        is_link = lambda e: e["s"] >= THRESHOLD
        held = F.filter(F.arrays_zip("s", "fresh"), is_link)
        got = after.agg(F.sum(F.size(F.filter(held, lambda e: e["fresh"]))).alias("new"), F.sum(F.size(held)).alias("all")).first()
        return got.new / got["all"] if got["all"] else 0.0

    def refine(self) -> None:
        """Joins neighbours of neighbours until a round gives few new links."""
        while True:
            pivots, waiting = _pivots(self.lists, self.k)
            pairs = stored(_join(self.vectors, self.lists, pivots, self.kind), "pairs")
            self.turns += 1
            new = self.add(pairs, waiting)
            drop_stored(pivots)
            if new <= STILL:
                return

    def audit(self, pairs: DataFrame, comps: DataFrame) -> tuple[float | None, int]:
        """(the share of links in pairs, which the graph has not seen, that lie inside comps, None if there is no link; the number that doesn't)."""
        known = comps.select(F.col("node"), "component")
        weight = F.pow(1 - F.acos(F.least(F.lit(1.0), "s")) / math.pi, F.lit(-float(_bits(self.n))))  # 1 / _meets()
        links = pairs.where((F.col("s") >= THRESHOLD) & (F.col("v") < F.col("u"))).groupBy("v", "u").agg(F.max("s").alias("s")).withColumn("weight", weight)
        links = links.join(known.select(F.col("node").alias("v"), F.col("component").alias("x")), "v", "left").join(known.select(F.col("node").alias("u"), F.col("component").alias("y")), "u", "left")
        met = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
        got = links.agg(F.sum("weight").alias("all"), F.sum(F.when(met, F.col("weight")).otherwise(0.0)).alias("met"), F.count_if(~met).alias("missed")).first()
        return (got.met / got["all"] if got["all"] else None), got.missed

    def saturated(self) -> bool:
        """Whether a list holds links only."""
        return self.lists.where((F.size("s") >= self.k) & (F.col("kth") >= THRESHOLD)).limit(1).count() > 0

    def components(self) -> DataFrame:
        return components(self.links)


def _graph(vectors: DataFrame, n: int, kind: str) -> tuple[Graph, DataFrame, float | None]:
    """(the graph, its components, the recall of its last audit)."""
    graph = Graph(vectors, n, kind)
    trees = max(2, math.ceil(math.log(1 - START) / math.log(1 - min(0.9, _meets(THRESHOLD, n)))))
    while graph.trees < trees:
        graph.add(graph.plant(min(TOGETHER, trees - graph.trees)))
    while True:
        graph.refine()
        comps = graph.components()
        unseen = graph.plant(TOGETHER)
        recall, missed = graph.audit(unseen, comps)
        log.info("NN-descent: k %d, %d trees, %d joins, audited recall %s", graph.k, graph.trees - TOGETHER, graph.turns, recall)
        graph.add(unseen)
        if not missed:
            return graph, comps, recall
        drop_stored(comps)
        if recall >= RECALL:
            return graph, graph.components(), recall
        if graph.saturated():
            graph.k *= 2


def _count_inside(vectors: DataFrame, comps: DataFrame, lists: DataFrame, k: int, kind: str) -> DataFrame:
    """(id, links): the weight of a class's links inside its component, for saturated classes and those of small components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            ids, w, side, need = (column(t, c) for c in ("id", "w", "side", "need"))
            raw = t.column("vec").to_pylist()
            total = np.zeros(len(ids), np.int64)
            for at in _by_length(raw):
                x = _unit([raw[i] for i in at], kind)
                left = np.flatnonzero((side[at] != 1) & need[at])
                right = np.flatnonzero(side[at] != 0)
                for i in range(0, len(left), 512):
                    rows = left[i : i + 512]
                    linked = x[rows] @ x[right].T >= THRESHOLD
                    linked &= ids[at][rows][:, None] != ids[at][right][None, :]
                    total[at[rows]] += linked @ w[at][right]
            took = (side != 1) & need
            yield pa.RecordBatch.from_arrays([pa.array(ids[took]), pa.array(total[took])], names=["id", "links"])

    sizes = comps.groupBy("component").agg(F.count("*").alias("m"))
    full = lists.select(F.col("id"), ((F.size("s") >= k) & (F.element_at("s", -1) >= THRESHOLD)).alias("full"))
    rows = spread_join(comps.withColumnRenamed("node", "id"), sizes, "component").join(full, "id", "left").where("m > 2").join(vectors, "id")
    rows = rows.withColumn("need", F.coalesce("full", F.lit(False)) | (F.col("m") <= SQUARE)).withColumn("n", F.ceil(F.col("m") / SQUARE).cast("int"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    keep = ["need", "w", "vec"]
    one = rows.where("n = 1").select("component", F.lit(0).alias("x"), F.lit(0).alias("y"), "id", F.lit(2).alias("side"), *keep)
    many = rows.where("n > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    left = many.where("need").select("component", F.col("blk").alias("x"), F.col("o").alias("y"), "id", F.lit(0).alias("side"), *keep)
    right = many.select("component", F.col("o").alias("x"), F.col("blk").alias("y"), "id", F.lit(1).alias("side"), *keep)
    rows = one.unionByName(left).unionByName(right).repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    return rows.mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def link(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector, by cosine >= THRESHOLD."""
    return audited(embeddings)[0]


def audited(embeddings: DataFrame) -> tuple[DataFrame, float | None]:
    """(the rows of link(), the recall of the last audit)."""
    double = "double" in embeddings.schema["embedding"].dataType.simpleString()
    kind = "<f8" if double else "<f4"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    valid = rows.where(F.col("vec_id").isNotNull() & _valid(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    same = F.concat_ws(":", F.xxhash64("embedding"), F.xxhash64(F.lit(SEED), "embedding"))  # 128 bits stand for a vector
    valid = stored(valid.withColumn("same", same), "valid")
    classes = stored(valid.groupBy("same").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("embedding").alias("embedding")), "classes")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column(2)
            flat, at = np.ascontiguousarray(np.asarray(e.values), kind).view(np.uint8), np.asarray(e.offsets).astype(np.int64) * (8 if double else 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["id", "w", "vec"])

    vectors = stored(classes.select("id", "w", "embedding").mapInArrow(pack, "id long, w long, vec binary"), "vectors")
    graph, comps, recall = _graph(vectors, vectors.count(), kind)
    listed = graph.lists.select("id", F.explode(F.arrays_zip("u", "s")).alias("e")).where(F.col("e.s") >= THRESHOLD).select("id", F.col("e.u").alias("u"))
    seen = listed.join(vectors.select(F.col("id").alias("u"), "w"), "u").groupBy("id").agg(F.sum("w").alias("links"))
    inside = _count_inside(vectors, comps, graph.lists, graph.k, kind).withColumnRenamed("links", "inside")
    counted = seen.join(inside, "id", "full").select("id", F.coalesce("inside", "links").alias("links"))
    result = vectors.select("id", "w").join(counted, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    result = stored(result.select("id", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "result")
    many = classes.where("w > 1").select("same", F.col("id").alias("rep"))
    member = stored(spread_join(valid.select("vec_id", "same"), many, "same", "left").select("vec_id", F.coalesce("rep", "vec_id").alias("id")), "member")
    linked = spread_join(member, result, "id").select("vec_id", "n_links", "component_id")
    plain = rows.where(F.col("vec_id").isNotNull()).select("vec_id").distinct()
    out = plain.join(linked, "vec_id", "left").unionByName(rows.where(F.col("vec_id").isNull()).select("vec_id"), allowMissingColumns=True)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")), recall
