"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over token positions: it hashes the tokens at some offsets and ignores those between, so a
substituted token at an ignored offset doesn't spoil the hash. The hashes of the benchmark's seeds are joined with those
of the documents at every position; where two meet, document and item are aligned on that diagonal and the overlap
around the hit is verified: the best run of at least min(MIN_WORDS, item's words) aligned tokens of which SHARE agree,
both its ends among them.

The masks lose nothing: every such run has a hit. A run of 26 tokens or more can be halved into two of 13 or more, one
of which has the share as well, so runs of 13 to 25 tokens at any ends are all there is to cover; and a run of 14, or
16 to 19, or 21 to 24 holds one of 13, 15 or 20 with as many substitutions at most. The test enumerates all places of 2
substitutions in 13 tokens, 3 in 15, 4 in 20 and 5 in 25, and for shorter items all places inside them.

Tokens are words with A-Z lowered and ASCII punctuation at their ends left out. Runs of fewer than MIN_WORDS tokens of
longer items find nothing. An item of few words stands in ordinary text by chance: `shortest` leaves such items out.

Documents' hashes first pass a sieve, a bit for each value of some of a benchmark hash's bits; it has 128 bits for each
benchmark seed, up to SIEVE, so it is a broadcast of bounded size whatever the benchmark's. What passes is shuffled and
joined with the benchmark's seeds. Hits are pairs of numbers; for each the document's tokens on the diagonal, as many as
the item has, are joined with the item's. Nothing of the benchmark goes through the driver but the sieve.

Common phrases: equal texts are one text, and items of the same tokens one item, until the end. Of hits in a row on one
diagonal only the first is joined: seeds carry the one before them (0 if none), and where that meets, too, its own rows
tell the diagonal. A seed, item or text of many rows is cut into parts, each of which meets all rows of the other side; a text's hits are dealt into blocks of
HITS. What remains grows with the pairs of different texts and different items that share a seed.

Cases: null or empty texts and items match nothing; repeated documents are reported each; items of the same tokens are
reported once, by their smallest item_id (null if none has one) and their number, and same_items() lists them; an
empty table gives no rows; an item's best overlap with a document is reported once, the leftmost of ties; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import BROADCAST_ROWS, columns, drop_stored, free, hot_parts, only_ids, salted_join, small_batches, stored
from quire.llm.words import mixed, pieces, words

#: For overlaps of MIN_WORDS tokens or more, and for whole items of fewer words; found by greedy cover.
MASKS = ("111011", "11111")
SHORT_MASKS = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("10111", "11011", "11101"),
    6: ("111101", "111011", "110111", "101111"),
    7: ("11111", "111011", "110111"),
    8: ("111111", "1111011", "1101111"),
    9: ("1111111", "11111011", "11101111", "11011111"),
    10: ("1111101", "11100111", "1101010011", "10110111", "1100101011"),
    11: ("1111011", "110010111", "1101100101", "111111"),
    12: ("11111011", "110101111", "11101100011", "111001111"),
}
MIN_WORDS, SHARE, SHORTEST = 13, 0.8, 1
SIEVE = 28  # the binary logarithm of the sieve's largest size: 32 MB
HITS = 10_000  # hits of a text that are worked on at once

_MULT = (np.random.default_rng(99).integers(0, 2**62, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_TRIM = np.zeros(256, bool)
_TRIM[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of texts, end punctuation left out; a word of punctuation only is no token."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space, trim, here = (data == 32) | ((data >= 9) & (data <= 13)), _TRIM[data], np.arange(n)
    edge = np.zeros(n + 1, bool)  # where a word may start, or the one before end
    edge[at] = True
    edge[:-1] |= space
    edge[1:] |= space
    solid = ~space & ~trim
    start = np.maximum.accumulate(np.where(edge[:-1], here, 0))
    end = np.minimum.accumulate(np.where(edge[1:], here, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, here, -1))
    after = np.minimum.accumulate(np.where(solid, here, n)[::-1])[::-1]
    blank = data.copy()
    blank[trim & ((before < start) | (after > end))] = 32
    h, row, _, _ = words(blank, at)
    return h, row


def masks(n: int) -> tuple[str, ...]:
    """The masks for an item of n words."""
    return MASKS if n >= MIN_WORDS else SHORT_MASKS.get(n, ())


def _seeded(h: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every position that has room for it."""
    n = max(len(h) - len(mask) + 1, 0)
    total = np.full(n, int(mask, 2), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            total += h[k : k + n] * _MULT[k]
    return mixed(total)


def verify(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(first token, end token, agreeing) of the longest good overlap of two aligned runs of tokens, or None."""
    if len(doc) < least:
        return None
    same = doc == item
    gain = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - SHARE, -SHARE))])
    # The longest run with agreeing ends and a sum of at least 0: the first such start whose gain is not above the end's.
    floor = np.minimum.accumulate(np.where(np.append(same, False), gain, np.inf))
    start = np.searchsorted(-floor, -(gain + 1e-9), "left")
    length = np.where(np.append(False, same), np.arange(len(gain)) - start, 0)
    e = int(np.argmax(length))
    s = int(start[e])
    return (s, e, int(same[s:e].sum())) if e - s >= least else None


def _read_items(benchmark: DataFrame, shortest: int) -> DataFrame:
    """(item_id, n, h): the items' token hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                h, row = tokens(data, at)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(cut)), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["item_id", "n", "h"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    return rows.mapInArrow(run, "item_id long, n long, h binary").where(F.col("n") >= max(1, shortest))


def _before(seeds: np.ndarray) -> np.ndarray:
    """The seed before each, 0 for the first."""
    return np.concatenate([np.zeros(min(1, len(seeds)), np.uint64), seeds[:-1]])


def _items(benchmark: DataFrame, shortest: int) -> DataFrame:
    """(row, item_id, n_items, n, h): the different items, row being a number of their own."""
    made = _read_items(benchmark, shortest).groupBy("h", "n").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    return stored(made.select(F.monotonically_increasing_id().alias("row"), "item_id", "n_items", "n", "h"), "items")


def same_items(benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(item_id, same_as): every item that find() looks for, beside the one that stands for all of its tokens."""
    made = _read_items(benchmark, shortest)
    return made.join(made.groupBy("h").agg(F.min("item_id").alias("same_as")), "h").select("item_id", "same_as")


def _item_seeds(items: DataFrame) -> DataFrame:
    """(key, before, row, n, offset) of every seed of the items, n being the item's number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, h in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for m in masks(n):
                    f = _seeded(np.frombuffer(h, "<u8"), m)
                    yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(_before(f).view(np.int64)), pa.array(np.full(len(f), row)), pa.array(np.full(len(f), n)), pa.array(np.arange(len(f)))], names=["key", "before", "row", "n", "offset"])

    return stored(items.select("row", "n", "h").mapInArrow(run, "key long, before long, row long, n long, offset long"), "seeds")


def _sieve(seeds: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, the sieve as bytes): a bit for each value of the first bits of seeds' keys."""
    bits = min(SIEVE, max(16, (128 * seeds.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((cell >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (cell & np.uint64(63))).view(np.int64))], names=["word", "mark"])

    marks = seeds.select("key").mapInArrow(run, "word long, mark long").groupBy("word").agg(F.bit_or("mark").alias("mark"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in marks.toLocalIterator():  # 2 ** (SIEVE - 6) rows at most
        out[r.word] = r.mark
    return bits, out


def _candidates(texts: DataFrame, used: list[str], bits: int, sieve: np.ndarray) -> DataFrame:
    """(key, previous, text, at): the seeds of texts (text_key, text) that pass the sieve, and those before them."""
    shipped = texts.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, _, data, at in pieces(batch.column(1)):
                h, row = tokens(data, at)
                first = np.searchsorted(row, row)
                for mask in used:
                    s = _seeded(h, mask)
                    cell = (s >> np.uint64(64 - bits)).astype(np.int64)
                    p = np.flatnonzero((table[cell >> 6] >> (cell & 63)) & 1)
                    p = p[row[p] == row[p + len(mask) - 1]]
                    if len(p):
                        previous = np.where(p > first[p], _before(s)[p], np.uint64(0))
                        yield pa.RecordBatch.from_arrays([pa.array(s[p].view(np.int64)), pa.array(previous.view(np.int64)), pa.array(keys[i + row[p]]), pa.array(p - first[p])], names=["key", "previous", "text", "at"])

    return stored(texts.mapInArrow(run, "key long, previous long, text long, at long"), "candidates")


def _aligned(texts: DataFrame) -> DataFrame:
    """(text, row, begin, offset, doc): for each hit of texts (text_key, text, hits) the document's tokens on its diagonal.

    begin is the first of them in the document, offset its place in the item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hits = batch.column(0).to_numpy(), batch.column(2)
            cut = np.asarray(hits.offsets).astype(np.int64)
            item, diagonal, size = (hits.values.field(k).to_numpy() for k in range(3))
            for i, j, data, at in pieces(batch.column(1)):
                h, row = tokens(data, at)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                for d in range(i, j):
                    own = h[ends[d - i] : ends[d - i + 1]]
                    x = slice(cut[d], cut[d + 1])
                    begin, end = np.maximum(diagonal[x], 0), np.minimum(diagonal[x] + size[x], len(own))
                    runs = pa.array([own[a:b].tobytes() for a, b in zip(begin, end)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), keys[d])), pa.array(item[x]), pa.array(begin), pa.array(begin - diagonal[x]), runs], names=["text", "row", "begin", "offset", "doc"])

    return texts.mapInArrow(run, "text long, row long, begin long, offset long, doc binary")


def _verified(pairs: DataFrame) -> DataFrame:
    """(text, row, item_id, n_items, first_token, end_token, n_same) of the pairs (text, row, item_id, n_items, begin, offset, doc, h, n) that overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for k, (begin, offset, doc, h, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4, 9)))):
                doc, item = np.frombuffer(doc, "<u8"), np.frombuffer(h, "<u8")
                got = verify(doc, item[offset : offset + len(doc)], min(MIN_WORDS, n))
                if got:
                    keep.append(k)
                    out.append((begin + got[0], begin + got[1], got[2]))
            chosen = batch.take(pa.array(keep, pa.int64()))
            ends = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*chosen.columns[:4], *ends], names=["text", "row", "item_id", "n_items", "first_token", "end_token", "n_same"])

    return pairs.select("text", "row", "item_id", "n_items", "begin", "offset", "doc", "h", "n").mapInArrow(run, "text long, row long, item_id long, n_items long, first_token long, end_token long, n_same long")


def _listed(hits: DataFrame, total: int) -> DataFrame:
    """(text, hits) of hits (text, row, diagonal, n): the hits of a text in blocks of about HITS."""
    block = F.lit(0)
    if total > HITS:  # else no text has more
        many = hits.groupBy("text").agg(F.count("*").alias("blocks")).where(F.col("blocks") > HITS).withColumn("blocks", F.ceil(F.col("blocks") / HITS))
        few = many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        hits = hits.join(F.broadcast(many) if few else many, "text", "left")
        block = F.coalesce(F.pmod(F.xxhash64("row", "diagonal"), F.col("blocks")), F.lit(0))
    return hits.groupBy("text", block.alias("block")).agg(F.collect_list(F.struct("row", "diagonal", "n")).alias("hits")).select("text", "hits")


def find(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, n_items, first_token, end_token (exclusive), n_same: the best overlap of each contaminated document with each different item; items of `shortest` tokens or more count."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark, shortest)
    seeds = _item_seeds(items)
    sizes = [r.n for r in items.select(F.least("n", F.lit(MIN_WORDS)).alias("n")).distinct().collect()]  # MIN_WORDS rows at most
    used = sorted({m for n in sizes for m in masks(n)})
    found = _candidates(rows.select("text_key", "text"), used, *_sieve(seeds))
    first = (F.col("previous") != F.col("before")) | (F.col("before") == 0)
    hits = stored(salted_join(found, seeds, "key").where(first).select("text", "row", (F.col("at") - F.col("offset")).alias("diagonal"), "n").distinct(), "hits")
    many = hits.count()
    listed = stored(_listed(hits, many).withColumnRenamed("text", "text_key"), "listed")
    few = listed.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10 and many <= BROADCAST_ROWS
    one = only_ids(rows, listed.select("text_key").distinct(), "text_key").groupBy("text_key").agg(F.first("text").alias("text"))
    texts = one.join(F.broadcast(listed) if few else listed, "text_key").select("text_key", "text", "hits")
    if many > 10 * HITS:  # far more work than the texts' bytes tell
        texts = texts.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, many // (10 * HITS)))
    aligned = _aligned(texts)
    pairs = _verified(salted_join(aligned, items, "row", hot_parts(hits, "row")))
    best = pairs.groupBy("text", "row").agg(F.max(F.struct((F.col("end_token") - F.col("first_token")).alias("n"), (-F.col("first_token")).alias("at"), "n_same", "item_id", "n_items")).alias("b"))
    best = stored(best.select(F.col("text").alias("text_key"), "b.item_id", "b.n_items", (-F.col("b.at")).alias("first_token"), (F.col("b.n") - F.col("b.at")).alias("end_token"), "b.n_same"), "leaks")
    drop_stored(items, seeds, found, hits, listed)
    ids = rows.select("doc_id", "text_key")
    out = ids.join(F.broadcast(best), "text_key") if best.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else salted_join(ids, best, "text_key")
    return out.select("doc_id", "item_id", "n_items", "first_token", "end_token", "n_same")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark passage. A row without doc_id is judged by its own text."""
    key = free(docs, "key")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    found = stored(find(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(found) if few else found, key, "left_anti").select(columns(docs))
