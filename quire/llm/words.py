"""Vectorized words, word hashes and shingle sets of whole texts, over Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lowered. Hashes are 64-bit: two different
words or shingles share one with a chance of about 5e-20, which the callers treat as equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 17  # bytes of text that are worked on at once; a longer text is worked on alone
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_PLACE = (_rng.integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    """0x9E3779B97F4A7C15 to the powers 0 to n - 1, modulo 2**64."""
    out = np.full(max(n, 1), 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; a null has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    if texts.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        texts = texts.cast(pa.large_string())
    kind = np.int64 if texts.type in (pa.large_string(), pa.large_binary()) else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and at[-1] else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about CHUNK bytes."""
    data, at = buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word; row is the text's position in at, start and end are byte offsets."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] |= solid[heads]
    start = np.flatnonzero(first)
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64), start, start
    kept = np.flatnonzero(solid)
    word = np.cumsum(first)[kept] - 1
    place = kept - start[word]
    begin = np.searchsorted(kept, start)
    end = kept[np.append(begin[1:], len(kept)) - 1] + 1
    h = np.add.reduceat(_BYTE[data[kept]] * powers(int(place.max()) + 1)[place], begin)
    return mixed(h + (end - start).astype(np.uint64)), np.searchsorted(at, start, "right") - 1, start, end


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of words of each text."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] |= solid[heads]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[at])


def shingles(h: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other, and the n + 1 offsets.

    A text with fewer words than width has one shingle, its whole sequence; a text without words has none.
    """
    n = np.bincount(row, minlength=rows)
    base = np.concatenate([[0], np.cumsum(n)])
    total = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        total += h[k : k + len(total)] * _PLACE[k]
    ok = row[: len(total)] == row[width - 1 :] if len(total) else np.zeros(0, bool)
    total, owner = mixed(total[ok]), row[: len(ok)][ok]
    cut = np.searchsorted(owner, np.arange(rows + 1))
    out, size = [], np.zeros(rows, np.int64)
    for i in range(rows):
        if n[i] >= width:
            s = np.unique(total[cut[i] : cut[i + 1]])
        elif n[i]:
            s = mixed(np.array([sum(int(x) * int(p) for x, p in zip(h[base[i] : base[i + 1]], _PLACE)) + int(n[i]) & 2**64 - 1], np.uint64))
        else:
            continue
        out.append(s)
        size[i] = len(s)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(size)])
