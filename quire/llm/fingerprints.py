"""Document fingerprints: digests of improbable byte windows in chained Bloom filters.

A feature is a window of WINDOW bytes of a text, at every byte. Windows of rare entropy tell texts apart, those of common
entropy stand everywhere: the entropies of all windows of all documents are counted, and an entropy's rank is its place
from the rarest to the most common. Sliding over NEAR windows at once, the one of lowest rank (of equals the first) gets a
point, and windows with POINTS are selected. A feature sets HASHES bits of a Bloom filter of BITS bits; after FEATURES
features the next filter of the chain begins, so a digest grows with its text and no filter fills up.

Two digests are compared by the bits that filters have in common beyond what chance gives, as a share of the most that they
could have: each filter of the digest with fewer bits by its best partner in the other, weighed by its bits. The bits
that chance gives, and three standard deviations on top, count as nothing. 1 is likeness of equal digests, 0 of strangers.

A text of up to ALL windows needs no selection and keeps all of them. Texts under 2 * WINDOW bytes add windows of SMALL
bytes, so short texts are comparable too; a text shorter than that is one feature itself.

Ranks are a row for each of LEVELS entropies, collected on the driver; digests of another corpus are comparable if they
are given the same ranks. Documents meet their neighbours by a range sort of doc_id: a task reads its rows in order, each
beside the next, and only the last row of a task is completed by the next task's first, from a table with two rows a task.

Cases: a null text is empty; an empty text's fingerprint is empty, like an empty one (1) and unlike others (0); a null
doc_id is the last; equal ids are ordered by their texts' hashes, repeated rows stand side by side; one document is its own
next; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.shared import stored
from quire.llm.words import mixed

WINDOW, SMALL = 32, 8  # bytes of a feature, and of the further ones of short texts
NEAR, POINTS = 64, 16  # windows looked at together, and how often the rarest of them a selected one is
BITS, HASHES, FEATURES, ALL = 1024, 5, 80, 160  # of a filter; windows of a text that needs no selection
LEVELS = 1000  # entropies told apart
PIECE = 1 << 18  # bytes of texts worked on at once; a longer text is worked on alone
TEXT_PER_TASK = 32 << 20  # characters that a task sorts, about

_PLACE = np.random.default_rng(20250711).integers(0, 2**63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
#: c * log2(c) in fixed point: sums of it are exact, so equal windows have equal entropies wherever they stand.
_POINT = 1 << 16
_TERM = np.array([0] + [round(c * np.log2(c) * _POINT) for c in range(1, WINDOW + 1)], np.int32)
_STEP = np.diff(_TERM)  # what one more of a byte that stands c times adds


def _equal_near(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the WINDOW - 1 bytes before, and of those after, each byte are the same."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = np.empty(n, np.int32 if n < 1 << 23 else np.int64)
    np.add(data[order].astype(key.dtype) << (23 if n < 1 << 23 else 40), order, out=key, casting="unsafe")
    before, after = np.zeros(n, np.int8), np.zeros(n, np.int8)  # in order of bytes, then places
    at = None  # of those that still have a k-th byte; while most have, all are looked at
    for k in range(1, min(WINDOW, n)):
        if at is None:
            near = key[k:] - key[:-k] < WINDOW
            before[k:] += near
            after[:-k] += near
            if np.count_nonzero(near) * 8 < n:
                at = np.flatnonzero(near) + k
        else:
            at = at[at >= k]
            at = at[key[at] - key[at - k] < WINDOW]
            before[at] += 1
            after[at - k] += 1
            if not len(at):
                break
    left, right = np.empty(n, np.int8), np.empty(n, np.int8)
    left[order], right[order] = before, after
    return left, right


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy, from 0 to LEVELS, of each window of data: of len(data) - WINDOW + 1 of them.

    From one window to the next a byte leaves and one comes in; what that changes hangs on how often these bytes stand
    among the others. Equal bytes nearer than WINDOW are found in the places sorted by byte.
    """
    if len(data) < WINDOW:
        return np.empty(0, np.int16)
    left, right = _equal_near(data)
    total = _STEP[left[WINDOW - 1 :]]
    total[0] = _STEP[left[:WINDOW]].sum()
    total[1:] -= _STEP[right[: len(data) - WINDOW]]
    np.cumsum(total, out=total)
    most = int(_TERM[WINDOW])
    return ((most - total) * (LEVELS / most)).astype(np.int16)


def hashes_at(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of size bytes that begins at `at`."""
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h += (data[at + k].astype(np.uint64) + np.uint64(1)) * _PLACE[k]
    return mixed(h ^ np.uint64(size))


def points(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each window is the rarest, and first, of NEAR neighbours in its text; text k has windows at[k] to at[k + 1]."""
    n = len(rank)
    key = (rank.astype(np.int64) << 32) + np.arange(n)
    blocks = np.concatenate([key, np.full(-n % NEAR, np.iinfo(np.int64).max)]).reshape(-1, NEAR)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    inside = np.zeros(n + 1, np.int32)  # of the neighbours that begin there, all are of one text
    size = np.diff(at)
    full = size >= NEAR
    np.add.at(inside, at[:-1][full], 1)
    np.add.at(inside, at[:-1][full] + size[full] - NEAR + 1, -1)
    begins = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    best = np.minimum(back[begins], ahead[begins + NEAR - 1]) & 0xFFFFFFFF
    return np.bincount(best, minlength=n)


def chain(features: np.ndarray) -> bytes:
    """The filters of features, one after the other."""
    if not len(features):
        return b""
    count = -(-len(features) // FEATURES)
    bits = np.zeros(count * BITS, bool)
    base = np.arange(len(features)) // FEATURES * BITS
    for k in range(HASHES):
        bits[base + (features >> np.uint64(12 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with PIECE bytes at most, or one text."""
    i = 0
    while i < len(sizes):
        j, total = i + 1, sizes[i]
        while j < len(sizes) and total + sizes[j] <= PIECE:
            total += sizes[j]
            j += 1
        yield i, j
        i = j


def _starts(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def levels(texts: list[bytes]) -> list[np.ndarray]:
    """The entropies of each text's windows."""
    out = []
    for i, j in _pieces([len(t) for t in texts]):
        found = entropy_levels(np.frombuffer(b"".join(texts[i:j]), np.uint8))
        at = _starts([len(t) for t in texts[i:j]])
        out += [found[a : max(a, b - WINDOW + 1)].copy() for a, b in zip(at[:-1], at[1:])]
    return out


def digests(texts: list[bytes], found: list[np.ndarray], ranks: np.ndarray) -> list[bytes]:
    """The fingerprint of each text, found being levels() of them."""
    out: list[bytes] = []
    for i, j in _pieces([len(t) for t in texts]):
        out += _digests(texts[i:j], found[i:j], ranks)
    return out


def _digests(texts: list[bytes], found: list[np.ndarray], ranks: np.ndarray) -> list[bytes]:
    data, start = np.frombuffer(b"".join(texts), np.uint8), _starts([len(t) for t in texts])
    at = _starts([len(x) for x in found])
    rank = ranks[np.concatenate(found)]
    few = np.repeat(np.diff(at) <= ALL, np.diff(at))
    chosen = np.flatnonzero(few | (points(rank, at) >= POINTS))
    owner = np.searchsorted(at, chosen, "right") - 1
    hashed = hashes_at(data, chosen - at[owner] + start[owner], WINDOW)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, text in enumerate(texts):
        features = hashed[cut[k] : cut[k + 1]]
        if 0 < len(text) < 2 * WINDOW:
            size = min(SMALL, len(text))
            features = np.concatenate([features, hashes_at(np.frombuffer(text, np.uint8), np.arange(len(text) - size + 1), size)])
        out.append(chain(features))
    return out


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    return digests(texts, levels(texts), ranks)


def _spliced(head: list[bytes], head_levels: list[np.ndarray], tail: list[bytes], tail_levels: list[np.ndarray]) -> list[np.ndarray]:
    """levels() of head + tail from those of texts that begin with head, and with tail: only windows over the seam are new."""
    near = [h[len(h) - min(len(h), WINDOW - 1) :] + t[: WINDOW - 1] for h, t in zip(head, tail)]
    return [np.concatenate([x[: max(0, len(h) - WINDOW + 1)], s, y[: max(0, len(t) - WINDOW + 1)]]) for h, x, s, t, y in zip(head, head_levels, levels(near), tail, tail_levels)]


def likeness(a: bytes, b: bytes) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(d, np.uint64).reshape(-1, BITS // 64) for d in (a, b))
    nx, ny = np.bitwise_count(x).sum(1).astype(float), np.bitwise_count(y).sum(1).astype(float)
    if (nx.sum(), a) > (ny.sum(), b):
        x, y, nx, ny = y, x, ny, nx
    total = 0.0
    for row, n in zip(x, nx):
        same = np.bitwise_count(row & y).sum(1).astype(float)
        chance = n * ny / BITS
        spread = np.sqrt(chance * (1 - n / BITS) * (1 - ny / BITS) * BITS / (BITS - 1))
        most, least = np.minimum(n, ny), chance + 3 * spread
        score = np.where(most > least, (same - least) / np.maximum(most - least, 1e-9), same == most)
        total += n * min(1.0, max(0.0, float(score.max())))
    return total / float(nx.sum())


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each entropy, 0 for the rarest, by the number of windows of all texts that have it; of equals the lower entropy first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for i in range(0, len(batch), 64):
                for found in levels(batch.column(0).slice(i, 64).cast(pa.large_binary()).to_pylist()):
                    seen += np.bincount(found, minlength=LEVELS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32()), pa.array(seen[seen > 0])], names=["level", "n"])

    counts = np.zeros(LEVELS + 1, np.int64)
    found = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    for level, n in found.collect():  # LEVELS + 1 rows at most
        counts[level] = n
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    return ranks


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in ROW.split(", ")]


class Read:
    """Texts in order with what their neighbours need: bytes, entropies and fingerprints."""

    def __init__(self, ids: list, texts: list[str], ranks: np.ndarray):
        self.ids, self.texts, self.raw = ids, texts, [t.encode() for t in texts]
        self.levels = levels(self.raw)
        self.digests = digests(self.raw, self.levels, ranks)

    def __getitem__(self, part: slice) -> Read:
        out = Read.__new__(Read)
        for name, held in vars(self).items():
            setattr(out, name, held[part])
        return out

    def __add__(self, more: Read) -> Read:
        out = Read.__new__(Read)
        for name, held in vars(self).items():
            setattr(out, name, held + getattr(more, name))
        return out


def beside(own: Read, following: Read, ranks: np.ndarray) -> list[pa.Array]:
    """The columns of ROW of texts and the ones that follow each: an edited text ends in the beginning of what follows.

    floor(n / 3) of a text's n characters are replaced by as many of the next text, or by all it has.
    """
    third = [len(t) // 3 for t in own.texts]
    head = [t[: len(t) - n].encode() for t, n in zip(own.texts, third)]
    tail = [t[:n].encode() for t, n in zip(following.texts, third)]
    changed = [h + t for h, t in zip(head, tail)]
    other = digests(changed, _spliced(head, own.levels, tail, following.levels), ranks)
    return [
        pa.array(own.ids, pa.int64()), pa.array([len(t) for t in own.texts], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
        pa.array(own.digests, pa.binary()), pa.array(other, pa.binary()),
        pa.array([likeness(a, b) for a, b in zip(own.digests, other)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own.digests, following.digests)], pa.float64()),
    ]


def _edge(ids: list, text: str, part: int, edge: int) -> pa.RecordBatch:
    """A task's first (1) or last (2) text, for the row that no task can complete alone."""
    cols = [pa.array(ids, pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()))]
    return pa.RecordBatch.from_arrays([*cols, pa.array([part], pa.int32()), pa.array([edge], pa.int32()), pa.array([text], pa.string())], names=[*_NAMES, "part", "edge", "edge_text"])


def compare_next(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """For each document, by descending doc_id: its fingerprint, that of its text edited with the next one, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next; after the last document the first is next.
    """
    spark = docs.sparkSession
    ranks = rarity(docs) if ranks is None else ranks
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(max(spark.sparkContext.defaultParallelism, -(-chars // TEXT_PER_TASK)), *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, 0
        for batch in batches:
            for i in range(0, len(batch), 64):
                piece = batch.slice(i, 64)
                now = Read(piece.column(0).to_pylist(), piece.column(1).to_pylist(), ranks)
                if last is None:
                    part = piece.column(2)[0].as_py()
                    yield _edge(now.ids[:1], now.texts[0], part, 1)
                both = now if last is None else last + now
                last = both[-1:]
                n = len(both.ids) - 1
                if n:
                    yield pa.RecordBatch.from_arrays([*beside(both[:-1], both[1:], ranks), pa.array([part] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())], names=[*_NAMES, "part", "edge", "edge_text"])
        if last is not None:
            yield _edge(last.ids, last.texts[0], part, 2)

    out = stored(ranged.mapInArrow(run, f"{ROW}, part int, edge int, edge_text string"), "fingerprints")
    first = out.where("edge = 1").select(F.col("part").alias("next"), F.col("edge_text").alias("following"))
    ends = out.where("edge = 2").select("part", "doc_id", "edge_text")
    turn = ends.select("part").withColumn("next", F.lead("part").over(W.orderBy("part")))  # a row a task
    turn = turn.crossJoin(F.broadcast(ends.agg(F.min("part").alias("lowest")))).select("part", F.coalesce("next", "lowest").alias("next"))
    pairs = ends.join(turn, "part").join(first, "next").select("doc_id", "edge_text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 16):
                ids, texts, following = (c.to_pylist() for c in batch.slice(i, 16).columns)
                yield pa.RecordBatch.from_arrays(beside(Read(ids, texts, ranks), Read(ids, following, ranks), ranks), names=_NAMES)

    whole = out.where("edge = 0").select(*_NAMES).unionByName(pairs.mapInArrow(finish, ROW))
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def digest(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the fingerprint (hex) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d.hex() for d in fingerprints(part.column(1).cast(pa.large_binary()).to_pylist(), ranks)], pa.string())], names=[key, "fingerprint"])

    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, fingerprint string")
