"""Exact n-gram Jaccard join: a size-aware heavy-light join over shingle sets.

Two sets link when den * |intersection| >= num * |union|. Equal sets become one class first. A set gets keys such that
any two classes that link share a key:

- Light (small) sets enumerate subsets of a fixed size. Sets of k and k2 >= k shingles that link have at least
  c(k2) = ceil(num * k2 / den) in common, so both emit all their c(k2)-subsets.
- Heavy (large) sets are put into inverted lists that are then scanned. A list for each single shingle would hold a
  common passage's every document, so lists are kept for blocks of shingles: sizes fall into buckets in whose span two
  sets that link differ in at most d shingles; the bucket deals shingles by hash into P = d + 1 + e blocks, of which
  at least e + 1 agree. The few sets with more than e empty blocks also share a list of their own.
- The boundary is the size at which enumerating costs more than listing, both counted in keys and comparisons.

Lists are scanned in bounded squares of members: a parity sketch per set, of one to two bits a shingle, gives a lower
bound of the difference, so pairs that can't link fall out without their sets. As components are wanted, a square gives only a
spanning forest of what remains; the forest's pairs are verified on the sets, and lists whose members are not yet one
component are scanned again without the refuted pairs, until none has an untested pair left. So no link between
components is missed, and no list, however common its block, is turned into all its pairs.

Shingles are compared by 64-bit hashes (see words.py).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.groups import column, groups
from quire.llm.shared import BROADCAST_ROWS, HOT_ROWS, columns, components, drop_stored, free, hot_keys, only_ids, small_batches, spread_join, stored
from quire.llm.words import mixed, pieces, shingles, words

SKETCH_BITS = 512  # at least; sketches of different sizes are compared in the smaller's
SQUARE = 2048  # members of a list that are compared with as many others at once, about
SAMPLE, PARTS = 16, 64  # one of so many documents shows which keys are common; those are counted in so many parts
AGAIN = 16  # partners a member may get in each later scan of a square


class Scheme:
    """Which keys sets of each size get, for links at num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        light = 1
        while self.subset_cost(light + 1, 10**6) <= self.list_cost(light + 1):
            light += 1
        self.light = light
        self.starts = [light + 1]

    def common(self, k: int) -> int:
        return -(-self.num * k // self.den)

    def subset_sizes(self, k: int, light: int) -> list[int]:
        out, k2 = [], k
        while k2 <= light and self.common(k2) <= k:
            out.append(self.common(k2))
            k2 += 1
        return sorted(set(out))

    def subset_cost(self, k: int, light: int) -> float:
        return sum(math.comb(k, m) for m in self.subset_sizes(k, light))

    def list_cost(self, k: int) -> float:
        return self._blocks(k, -(-k * self.den // self.num) - 1)[2]

    def _blocks(self, low: int, high: int) -> tuple[int, int, float]:
        """(blocks, empty blocks allowed, cost) for sizes low to high, by the cheapest number of spare blocks."""
        d = 2 * high * (self.den - self.num) // (self.den + self.num)
        best = (d + 2, 1, float("inf"))
        for e in range(1, 60):
            p = d + 1 + e
            if p > low:
                break
            mean = p * math.exp(-low / p)
            term = below = math.exp(-mean)
            for i in range(1, e + 1):
                term *= mean / i
                below += term
            tail = max(0.0, 1 - below)
            best = min(best, (p, e, 2 * p + 3e5 * tail**2), key=lambda x: x[2])
            if tail < 1e-6:
                break
        return best

    def bucket(self, k: int) -> int:
        """The bucket of size k; -1 for light sizes."""
        while self.starts[-1] <= k:
            self.starts.append(-(-self.starts[-1] * self.den // self.num))
        return int(np.searchsorted(self.starts, k, "right")) - 1

    @lru_cache(None)  # noqa: B019
    def blocks(self, bucket: int) -> tuple[int, int]:
        while len(self.starts) < bucket + 2:
            self.bucket(self.starts[-1])
        return self._blocks(self.starts[bucket], self.starts[bucket + 1] - 1)[:2]

    def keys(self, sets: np.ndarray) -> np.ndarray:
        """The keys of one set, given as distinct hashes."""
        k = len(sets)
        out = []
        own = self.bucket(k)
        if own < 0:
            for m in self.subset_sizes(k, self.light):
                drop = k - m
                total = mixed(sets).sum(dtype=np.uint64)
                gone = mixed(sets)
                for combo in combinations(range(k), drop):
                    out.append(np.uint64((int(total) - sum(int(gone[i]) for i in combo) + m * 0x51ED270B) & 2**64 - 1))
        for bucket in [own, own + 1] if own >= 0 else [0] * (self.common(self.starts[0]) <= k):
            p, e = self.blocks(bucket)
            part = (mixed(sets + np.uint64(bucket)) >> np.uint64(32)).astype(np.int64) % p
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(part[order]) > 0))
            sums = np.add.reduceat(mixed(sets)[order], at)
            out.append(mixed(sums + (part[order][at] + 1 + 100_003 * (bucket + 1)).astype(np.uint64)))
            if p - len(at) > e:
                out.append(mixed(np.array([7 + bucket], np.uint64)))
        return np.unique(np.concatenate([np.atleast_1d(x) for x in out])) if out else np.empty(0, np.uint64)

    def most_apart(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
        """The largest symmetric difference at which sets of sizes a and b link."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def _sketch(sets: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of shingles has it."""
    size = max(SKETCH_BITS, 1 << (max(1, len(sets) * 3 // 2) - 1).bit_length())
    at = ((sets >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(bool)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as a matrix of 64-bit words, all folded to the smallest's size."""
    size = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, size // 8), 0) for x in sketches])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, h1, h2, sketch, keys) of every row; h1 and h2 stand for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(num, den)
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                h, row, _, _ = words(data, at)
                s, cut = shingles(h, row, j - i, width)
                each = [s[a:b] for a, b in zip(cut[:-1], cut[1:])]
                keys = [scheme.keys(x) if len(x) else np.empty(0, np.uint64) for x in each]
                sums = np.array([[mixed(x).sum(dtype=np.uint64), mixed(x + np.uint64(1)).sum(dtype=np.uint64)] for x in each], np.uint64).reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.uint64), *keys])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(cut).astype(np.int64)), _signed(sums[:, 0].copy()), _signed(sums[:, 1].copy()), pa.array([_sketch(x) for x in each], pa.binary()), pa.ListArray.from_arrays(offsets, _signed(flat))],
                    names=["doc_id", "n", "h1", "h2", "sketch", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch binary, keys array<long>")


def _scan(rows: DataFrame, num: int, den: int, first: bool) -> DataFrame:
    """Candidate pairs (a, b), a < b, of squares: rows (list, x, y, side, doc, n, c, sketch, no)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(num, den)
        for t in groups(batches, 3):
            doc, n, c, side = (column(t, k) for k in ("doc", "n", "c", "side"))
            if len(doc) < 2 or not first and c.min() == c.max():
                continue
            bits = _folded(t.column("sketch").to_pylist())
            refuted = t.column("no").to_pylist()
            label = np.unique(c, return_inverse=True)[1]
            right = np.arange(len(doc)) if (side == 0).all() else np.flatnonzero(side == 1)
            left = right if (side == 0).all() else np.flatnonzero(side == 0)
            found: list[tuple[int, int]] = []
            for i in left:
                js = right[(doc[right] != doc[i]) & (label[right] != label[i])]
                apart = np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64)
                low, high = np.minimum(n[js], n[i]), np.maximum(n[js], n[i])
                ok = (apart <= scheme.most_apart(n[js], n[i])) & (den * low >= num * high)
                js, apart = js[ok], apart[ok]
                if refuted[i]:
                    fresh = ~np.isin(doc[js], refuted[i])
                    js, apart = js[fresh], apart[fresh]
                if not len(js):
                    continue
                js = js[np.argsort(apart, kind="stable")]
                if first:  # one partner in each other part of the forest
                    js = js[np.sort(np.unique(label[js], return_index=True)[1])]
                    for j in js:
                        label[label == label[j]] = label[i]
                else:
                    js = js[:AGAIN]
                found += [(doc[i], doc[j]) for j in js]
            if found:
                pair = np.sort(np.array(found, np.int64), 1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return rows.repartition("list", "x", "y").sortWithinPartitions("list", "x", "y").select("list", "x", "y", "side", "doc", "n", "c", "sketch", "no").mapInArrow(run, "a long, b long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs with ok: whether the sets (doc, set) link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):  # views: sets are many times as large as pairs
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("s")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long, ok boolean")


def _exact(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                h, row, _, _ = words(data, at)
                s, cut = shingles(h, row, j - i, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["doc", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc long, set binary")


def join(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id.

    Cases: a null or empty text, or one without words, has n_shingles 0 and is its own component; so is a row whose
    doc_id is null, with component_id null. A text with fewer than width words has one shingle, its whole sequence.
    Rows that share a doc_id are one node, in the component of all their texts. Ties don't arise: component_id is the
    smallest doc_id. An empty table gives no rows; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    sets = stored(_sets(docs, width, num, den), "sets")
    real = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = stored(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    many = classes.where("members > 1").select("h1", "h2", "rep")
    few = many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    chosen = real.join(F.broadcast(many) if few else many, ["h1", "h2"], "left").where("rep is null or rep = doc_id").drop("rep")
    sample = real.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("key"))
    common = F.col("key").isin(hot_keys(sample, "key", HOT_ROWS // SAMPLE))  # only tells which keys are counted in parts
    part = F.when(common, F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(PARTS))).otherwise(0)
    by_key = W.partitionBy("key", part)
    keyed = chosen.select(F.col("doc_id").alias("doc"), F.explode("keys").alias("key"))
    keyed = keyed.select("doc", "key", F.count("*").over(by_key).alias("size"), F.bit_xor(F.xxhash64("doc")).over(by_key).alias("who"))
    keyed = stored(keyed.where(common | (F.col("size") > 1)), "keyed")
    totals = keyed.where(common).groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc")).alias("who"))
    whole = keyed.where(common).select("doc", "key").join(F.broadcast(totals), "key").where(F.col("size") > 1)  # HOT_KEYS rows at most
    lists = keyed.where(~common).unionByName(whole).select("doc", "size", F.xxhash64("size", "who").alias("list")).distinct()  # lists of the same members are one
    lists = stored(lists, "lists")
    drop_stored(keyed)
    popular = hot_keys(lists, "list")
    in_lists = stored(lists.select("doc").distinct(), "listed")
    known = stored(only_ids(chosen.select(F.col("doc_id").alias("doc"), "n", "sketch"), in_lists, "doc").dropDuplicates(["doc", "n", "sketch"]), "members")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    comps = None
    tested = None
    squares = F.ceil(F.col("size") / SQUARE).cast("int")
    while True:
        member = known.withColumn("c", F.col("doc")) if comps is None else known.join(comps.select(F.col("node").alias("doc"), "component"), "doc", "left").select("doc", "n", "sketch", F.coalesce("component", "doc").alias("c"))
        live = lists
        if comps is None:
            member = member.withColumn("no", F.array().cast("array<long>"))
        else:
            no = tested.where(~F.col("ok")).select(F.col("a").alias("doc"), F.col("b").alias("o")).union(tested.where(~F.col("ok")).select("b", "a")).groupBy("doc").agg(F.collect_set("o").alias("no"))
            member = stored(member.join(no, "doc", "left").withColumn("no", F.coalesce("no", F.array().cast("array<long>"))), "members")
            torn = lists.join(member.select("doc", "c"), "doc").groupBy("list").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("list")
            live = spread_join(lists, torn, "list", "left_semi", popular)
        rows = live.join(member, "doc").withColumn("blk", F.pmod(F.xxhash64("doc", "list"), squares).cast("int"))
        if comps is None:  # the squares on the diagonal
            rows = rows.select("list", F.col("blk").alias("x"), F.col("blk").alias("y"), F.lit(0).alias("side"), "doc", "n", "c", "sketch", "no")
        else:  # every square: a member stands at the side of its block with each block
            other = F.explode(F.sequence(F.lit(0), squares - 1))
            rows = rows.withColumn("o", other).select("list", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), F.when(F.col("blk") > F.col("o"), 1).otherwise(0).alias("side"), "doc", "n", "c", "sketch", "no")
        pairs = stored(_scan(rows, num, den, comps is None), "candidates")
        ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        exact = stored(_exact(only_ids(plain, ends, "doc_id"), width), "exact")
        fresh = stored(_verify(pairs, exact, num, den), "pairs")
        drop_stored(exact)
        drop_stored(pairs)
        found = fresh.agg(F.count("*").alias("n"), F.count_if("ok").alias("good")).first()
        if comps is not None:
            drop_stored(member)
        if not found.n and comps is not None:  # not after the first scan, which leaves the squares off the diagonal out
            drop_stored(fresh)
            break
        tested = fresh if tested is None else tested.union(fresh)
        comps = components(tested.where("ok").select("a", "b")) if found.good or comps is None else comps
    for t in (lists, known, in_lists):
        drop_stored(t)
    out = sets.select("doc_id", "n", "h1", "h2").join(many, ["h1", "h2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.col("rep")))
    if comps is not None:
        out = out.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each group: the one whose doc_id is its component's; of rows that repeat its id, the first by text.

    A row without doc_id stays.
    """
    n, key = free(docs, "n"), free(docs, "key")
    kept = stored(join(docs, width, num, den).where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(n)), "kept")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    once = only_ids(keyed, kept.where(F.col(n) == 1).select(key), key).unionByName(keyed.where(F.col(key).isNull()))
    twice = kept.where(F.col(n) > 1).select(key)
    if twice.limit(1).count():
        first = W.partitionBy(key).orderBy("text")
        again = only_ids(keyed, twice, key).withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n)
        once = once.unionByName(again)
    return once.select(columns(docs))
