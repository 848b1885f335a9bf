"""Exact removal of repeated byte strings, by prefix doubling over sampled suffixes.

A byte is removed if a LENGTH-byte string that covers it also starts somewhere else. Ranking every suffix of the corpus
would sort each byte several times, so suffixes are sampled by content: in every LENGTH-byte window the GRAM-byte
piece with the smallest hash (leftmost of ties) is the window's anchor. Equal windows have equal anchors at equal
offsets, so only windows with the same anchor and offset have to be ranked against each other, and neighbouring windows
share their anchor.

Ranks then grow as in prefix doubling. A position's rank is the fingerprint of the string that stands there; rounds
rank longer and longer strings, and a position leaves as soon as its rank is unique, or when the string has passed the
threshold. In a round windows are ranked in cells of neighbouring offsets from their anchor: by the string that all the
cell's windows have in common (a cell with a unique one has no repeated window) and by the string that they cover
together (a cell that repeats it is repeated as a whole). Only cells that repeat the first but not the second go on,
with one witness of each whole cell that shares their common string, in smaller cells with longer common strings, down
to single windows, whose two strings are the window itself. Spark ranks by sorting the pairs of fingerprint and position
by ranges: a rank is unique if neither neighbour in the order has it. Positions are part of the order, so a string that
occurs a million times lies over as many tasks as its rows fill; only the rows at the ends of ranges, two a task, are
compared on the driver.

Fingerprints are polynomial hashes of 64 bits; that two different strings of the same cell get one is taken as
impossible (a chance of 1e-3 or so for the whole of a corpus of 1e8 candidate cells).

Cases: a null or empty text has no bytes; texts shorter than LENGTH keep everything; repeated rows, also of the same
doc_id, repeat each other; a null doc_id is carried through; texts of any length are read whole; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import drop_stored, hot_keys, spread_join, stored
from quire.llm.words import buffers, mixed, pieces, powers

LENGTH, GRAM = 400, 17  # LENGTH - GRAM + 1 = 384 offsets
CELLS = (128, 16, 1)
SEGMENT = 1 << 23  # windows of one text that are anchored at once

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(4242).integers(0, 2**64, 256, dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _INVERSE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _table(name: str, make, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        _tables[name] = make(n)
    return _tables[name]


def _smallest(x: np.ndarray, k: int) -> np.ndarray:
    """The minimum of every k neighbouring values."""
    n = len(x)
    full = np.full(-(-n // k) * k, 2**64 - 1, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, k)
    head = np.minimum.accumulate(rows, 1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[: n - k + 1], head[k - 1 : n])


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Rows (anchor, first window, last window, text): runs of windows with one anchor. Positions are in data."""
    out = []
    texts = np.diff(at) >= length
    if len(data) < length or not texts.any():
        return np.empty((0, 4), np.int64)
    for begin in range(0, len(data) - length + 1, SEGMENT):
        part = np.ascontiguousarray(data[begin : begin + SEGMENT + length - 1])
        n = len(part) - GRAM + 1
        w = [np.ndarray((n,), "<u8", part.data, k, (1,)) for k in (0, GRAM - 8)]
        h = mixed(w[0] * np.uint64(0xD6E8FEB86659FD93) + part[8 : 8 + n].astype(np.uint64)) + w[1] * np.uint64(0xA0761D6478BD642F)
        h = (mixed(h) >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
        a = (_smallest(h, length - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64) + begin
        p = np.arange(begin, begin + len(a))
        text = np.searchsorted(at, p, "right") - 1
        fits = p + length <= at[text + 1]
        a, p, text = a[fits], p[fits], text[fits]
        if len(p):
            cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1]) | (p[1:] != p[:-1] + 1)]))
            out.append(np.stack([a[cut], p[cut], p[np.append(cut[1:], len(p)) - 1], text[cut]], 1))
    if not out:
        return np.empty((0, 4), np.int64)
    runs = np.concatenate(out)
    # A run that a segment's end has cut is one run, or its cells would repeat themselves.
    first = np.append(True, (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 3] != runs[:-1, 3]) | (runs[1:, 1] != runs[:-1, 2] + 1))
    last = np.append(first[1:], True)
    return np.stack([runs[first, 0], runs[first, 1], runs[last, 2], runs[first, 3]], 1)


def cells(data: np.ndarray, at: np.ndarray, runs: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(runs by cell, core fingerprint, span fingerprint, whether the span lies inside its text)."""
    a, lo, hi, text = runs.T
    first, last = (a - hi) // size, (a - lo) // size
    n = last - first + 1
    of = np.repeat(np.arange(len(runs)), n)
    c = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
    a, text = a[of], text[of]
    r1 = c * size
    r2 = r1 + size - 1
    lo, hi = np.maximum(lo[of], a - r2), np.minimum(hi[of], a - r1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _table("powers", powers, len(data))[: len(data)], dtype=np.uint64)])
    back = _table("inverse", _inverse_powers, len(data))

    def printed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * back[start]
        return mixed(h ^ mixed((c * 1_000_003 + (end - start)).astype(np.uint64)))

    core = printed(a - r1, a - r2 + length)
    inside = (a - r2 >= at[text]) & (a - r1 + length <= at[text + 1])
    span = printed(np.where(inside, a - r2, a - r1), np.where(inside, a - r1, a - r2) + length)
    return np.stack([a, lo, hi, text], 1), core, span, inside


ROW = "key long, a int, lo int, hi int, core long, span long"


def _batch(key: np.ndarray, at: np.ndarray, data: np.ndarray, runs: np.ndarray, size: int, length: int) -> pa.RecordBatch:
    got, core, span, inside = cells(data, at, runs, size, length)
    base = at[got[:, 3]]
    columns = [pa.array(key[got[:, 3]]), *(pa.array((got[:, k] - base).astype(np.int32)) for k in range(3)), pa.array(core.view(np.int64)), pa.array(span.view(np.int64), mask=~inside)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "a", "lo", "hi", "core", "span"])


def _first_round(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for i, j, data, at in pieces(batch.column(1)):
                runs = anchors(data, at, length)
                if len(runs):
                    yield _batch(key[i:j], at, data, runs, CELLS[0], length)

    return texts.mapInArrow(run, ROW)


def _next_round(texts: DataFrame, size: int, length: int) -> DataFrame:
    """texts: (key, text, open array<struct<a, lo, hi>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            todo = batch.column(2)
            cut = np.asarray(todo.offsets).astype(np.int64)
            a, lo, hi = (todo.values.field(k).to_numpy().astype(np.int64) for k in range(3))
            for i, j, data, at in pieces(batch.column(1)):
                text = np.repeat(np.arange(j - i), np.diff(cut[i : j + 1]))
                x, y = cut[i], cut[j]
                if x < y:
                    yield _batch(key[i:j], at, data, np.stack([a[x:y] + at[text], lo[x:y] + at[text], hi[x:y] + at[text], text], 1), size, length)

    return texts.mapInArrow(run, ROW)


RANKED = ROW + ", repeated boolean, whole boolean, end boolean"


def _ranked(rows: DataFrame) -> DataFrame:
    """The rows whose core another row has, with whole: whether another row has their span, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = held = None

        def mark(batch: pa.RecordBatch, after: pa.RecordBatch | None) -> pa.RecordBatch:
            marks = []
            for k in (4, 5):
                v, null = batch.column(k).fill_null(0).to_numpy(), np.asarray(batch.column(k).is_null())
                same = (v[1:] == v[:-1]) & ~null[1:] & ~null[:-1]
                ends = [x is not None and bool(v[i] == x.column(k)[j].as_py()) and not null[i] for x, i, j in ((before, 0, -1), (after, -1, 0))]
                marks.append(np.append(ends[0], same) | np.append(same, ends[1]))
            end = np.zeros(len(batch), bool)
            end[-1] = after is None
            end[0] |= before is None
            keep = np.flatnonzero(marks[0] | end)
            return pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in (*batch.columns, *map(pa.array, marks), pa.array(end))], names=[*batch.schema.names, "repeated", "whole", "end"])

        for batch in batches:
            if len(batch):
                if held is not None:
                    yield mark(held, batch)
                    before = held
                held = batch
        if held is not None:
            yield mark(held, None)

    order = ["core", "span", "key", "a", "lo"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "a", "lo", "hi", "core", "span")
    marked = stored(sorted_.mapInArrow(run, RANKED), "ranked")
    ends = marked.where("end").select("core", "span", "repeated", "whole").collect()  # two rows a task
    cores, spans = Counter(r.core for r in ends), Counter(r.span for r in ends if r.span is not None)
    again = [list({r[k] for r in ends if not r[2 + k] and met.get(r[k], 0) > 1}) for k, met in enumerate((cores, spans))]
    out = marked.select("key", "a", "lo", "hi", "core", "span", (F.col("repeated") | F.col("core").isin(again[0])).alias("repeated"), (F.col("whole") | F.coalesce(F.col("span").isin(again[1]), F.lit(False))).alias("whole"))
    return out.where("repeated").drop("repeated")


def repeats(docs: DataFrame, length: int = LENGTH, hot: list | None = None) -> DataFrame:
    """(key, starts array<struct<lo, hi>>): runs of repeated windows' starts by text, key being xxhash64(text).

    hot holds the keys of texts that very many rows have.
    """
    texts = docs.select(F.xxhash64(F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= length)
    hot = hot_keys(texts, "key") if hot is None else hot
    found = []
    rows = stored(_first_round(texts, length), "cells")
    for k, size in enumerate(CELLS):
        judged = _ranked(rows)
        drop_stored(rows)
        found.append(stored(judged.where("whole").select("key", "lo", "hi").distinct(), "repeats"))
        if size == 1:
            drop_stored(judged)
            break
        rest = stored(judged.where("not whole").select("core", "key", "a", "lo", "hi").distinct(), "rest")
        # A cell that is repeated as a whole stays a witness for those that share only its common string: one cell of each string.
        first = F.floor((F.col("w.a") - F.col("w.hi")) / size).cast("int") * size
        witness = judged.where("whole").groupBy("core", "span").agg(F.min(F.struct("key", "a", "lo", "hi")).alias("w"))
        witness = witness.join(rest.select("core").distinct(), "core", "left_semi")
        witness = witness.select("w.key", "w.a", (F.col("w.a") - first - (size - 1)).alias("lo"), (F.col("w.a") - first).alias("hi"))
        open_ = rest.select("key", "a", "lo", "hi").unionByName(witness).distinct().groupBy("key").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("open"))
        open_ = stored(open_, "open")
        drop_stored(judged)
        drop_stored(rest)
        again = spread_join(texts, open_, "key", hot=hot).select("key", "text", "open")
        rows = stored(_next_round(again, CELLS[k + 1], length), "cells")
        drop_stored(open_)
    starts = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    starts = stored(starts, "starts")
    for t in found:
        drop_stored(t)
    return starts


def remove(docs: DataFrame, length: int = LENGTH, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with text also kept, the remaining bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text")).alias("key"))
    hot = hot_keys(rows, "key")
    rows = spread_join(rows, repeats(docs, length, hot), "key", "left", hot).select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            lists = batch.column(2)
            cut = np.asarray(lists.offsets).astype(np.int64)
            lo, hi = (lists.values.field(k).to_numpy().astype(np.int64) for k in range(2))
            none = np.asarray(lists.is_null())
            n, removed, spans, digest, kept = np.diff(at), [], [], [], []
            for i in range(len(batch)):
                own = data[at[i] : at[i + 1]]
                gone = 0
                if cut[i] < cut[i + 1] and not none[i]:
                    order = np.argsort(lo[cut[i] : cut[i + 1]], kind="stable")
                    a, b = lo[cut[i] : cut[i + 1]][order], np.maximum.accumulate(hi[cut[i] : cut[i + 1]][order]) + length
                    new = np.append(True, a[1:] > b[:-1])
                    a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                    keep = np.ones(len(own), bool)
                    for x, y in zip(a, b):
                        keep[x:y] = False
                    gone, own = int((b - a).sum()), own[keep]
                    spans.append(len(a))
                else:
                    spans.append(0)
                removed.append(gone)
                raw = own.tobytes()
                digest.append(hashlib.sha256(raw).hexdigest())
                if text:
                    kept.append(raw)
            columns = [batch.column(0), pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * text, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * text)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text)
