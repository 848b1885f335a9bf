"""Periodic runs of words: every maximal stretch that repeats itself with a smallest period, and texts without the repeats.

By the runs theorem every run shows as a longest Lyndon word, under the order of words or under the reverse one: that
word is one period of it, and extending it as long as words a period apart agree gives the run. The longest Lyndon
words of all places come from a stack scanned from right to left, whose comparisons are those of two suffixes: their
longest common extension is found by doubling and halving steps over a rolling hash, and the words behind it decide.

A text is first cut into zones that can hold a run of the wanted kind. Four words in a row of such a run also stand
elsewhere in it, no further than a quarter of the zone away; places without such a twin split zones, until nothing
changes. What the cut leaves out can't be in a run that counts, so it changes time alone: ordinary prose has no zone.

Words are numbered exactly, not by hashes. Extensions go by a hash modulo 2**61 - 1; every run is then verified word by
word (its period, and that neither neighbour goes on with it), and one that fails has the zone read again with
another base. A text is worked on in one task, in time about linear in its words, times the logarithm of a run's length.

Cases: a null or empty text, or one of white space, has no words and no run; repeated rows are worked on each; ids may be
null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMES, LEAST = 4, 6  # a run that counts has TIMES periods and LEAST words at least
GRAM = 4  # words in a row of which a zone's places have a twin; LEAST - GRAM is 1 at least
WORD_BREAK = r"[\x20\x09-\x0D]+"
PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51, 0x0E6546B64C2B2AE3, 0x1C3A5F9D4B1E8E27)  # of the rolling hash, one after the other
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

Run = tuple[int, int, int]  # start, length, period


def zones(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts of ids outside of which no run that counts has a word."""
    n = len(ids) - GRAM + 1
    if len(ids) < LEAST:
        return []
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams += ids[k : k + n].astype(np.uint64) * _MIX[k]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    gap = np.where(same, np.diff(order), n)
    twin = np.full(n, n)  # how far the nearest equal gram is
    twin[order[1:]] = gap
    twin[order[:-1]] = np.minimum(twin[order[:-1]], gap)
    on = twin < n
    while True:  # zones shrink until all their places have twins near enough
        edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
        start, end = edges[::2], edges[1::2]
        words = end - start + GRAM - 1
        fine = words >= LEAST
        start, end, words = start[fine], end[fine], words[fine]
        reach = np.zeros(n + 1, np.int64)  # for each place of a zone the longest period that the zone allows
        np.add.at(reach, start, words // TIMES)
        np.add.at(reach, end, -(words // TIMES))
        after = on & (twin <= np.cumsum(reach)[:-1])
        if (after == on).all():
            return [(int(a), int(b) + GRAM - 1) for a, b in zip(start, end)]
        on = after


class Extensions:
    """Longest common extensions of places of a sequence of numbers, to the right and to the left."""

    def __init__(self, ids: list[int], base: int):
        self.ids, self.power, self.sums = ids, [1], [0]
        p, h = 1, 0
        for x in ids:
            p = p * base % PRIME
            h = (h * base + x + 1) % PRIME
            self.power.append(p)
            self.sums.append(h)

    def right(self, i: int, j: int) -> int:
        """How many words from i and from j on are the same; i < j."""
        ids, n = self.ids, len(self.ids)
        most, got = n - j, 0
        while got < GRAM:
            if got == most or ids[i + got] != ids[j + got]:
                return got
            got += 1
        sums, power, step = self.sums, self.power, GRAM
        a, b = sums[i], sums[j]
        low, high = got, most + 1  # low words agree; high do not
        while low + step < high:  # doubling
            m = low + step
            p = power[m]
            if (sums[i + m] - sums[j + m] - (a - b) * p) % PRIME:
                high = m
                break
            low, step = m, 2 * step
        while high - low > 1:  # halving
            m = (low + high) // 2
            if (sums[i + m] - sums[j + m] - (a - b) * power[m]) % PRIME:
                high = m
            else:
                low = m
        return low

    def left(self, i: int, j: int) -> int:
        """How many words before i and before j are the same; i < j."""
        sums, power, low, high, step = self.sums, self.power, 0, i + 1, 1
        a, b = sums[i], sums[j]
        while low + step < high:
            m = low + step
            if (a - b - (sums[i - m] - sums[j - m]) * power[m]) % PRIME:
                high = m
                break
            low, step = m, 2 * step
        while high - low > 1:
            m = (low + high) // 2
            if (a - b - (sums[i - m] - sums[j - m]) * power[m]) % PRIME:
                high = m
            else:
                low = m
        return low


def lyndon_runs(ids: list[int], base: int = BASES[0]) -> set[Run]:
    """The runs with TIMES periods and LEAST words: a stack of Lyndon words, from right to left, under both orders."""
    n, ext, found = len(ids), Extensions(ids, base), set()
    right, left = ext.right, ext.left
    for up in (True, False):
        stack = [n]  # the starts of the Lyndon words to the right, the nearest last; the end is below every suffix
        reach = [0] * (n + 1)  # how far the suffix agrees with that where its longest Lyndon word ends
        for i in range(n - 1, -1, -1):
            x = ids[i]
            while True:
                j = stack[-1]
                if j == n:
                    same = 0
                    break
                y = ids[j]
                if x != y:
                    same = 0
                    if (x < y) is up:
                        stack.pop()  # the suffix at j is greater: the word from i takes its word in
                        continue
                    break
                same = right(i, j)
                if j + same < n and (ids[i + same] < ids[j + same]) is up:
                    stack.pop()
                    continue
                break
            stack.append(i)
            reach[i] = same
            period = j - i
            # The first period that is a Lyndon word has fewer than a period before it, so all but two agree after it.
            if same >= (TIMES - 2) * period and period * TIMES <= n:
                back = left(i, j) if i else 0
                length = back + period + same
                if length >= max(LEAST, TIMES * period):
                    found.add((i - back, length, period))
    return found


def holds(ids: np.ndarray, run: Run) -> bool:
    """Whether run, word by word, has its period and ends where that ends."""
    start, length, p = run
    end = start + length
    inside = (ids[start : end - p] == ids[start + p : end]).all()
    return bool(inside and (start == 0 or ids[start - 1] != ids[start + p - 1]) and (end == len(ids) or ids[end] != ids[end - p]))


def runs_of(words: list) -> list[Run]:
    """The runs of a sequence of words, by start, then period."""
    if len(words) < LEAST:
        return []
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    out = []
    for a, b in zones(ids):
        part = ids[a:b]
        for base in BASES:
            found = lyndon_runs(part.tolist(), base)
            if all(holds(part, r) for r in found):
                break
        else:
            raise ArithmeticError("no base of the rolling hash tells these words apart")
        out += [(a + s, length, p) for s, length, p in found]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: those that no run has after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:-1] == 0


def repeated(text: Column, start: Column, period: Column) -> Column:
    """text's words, joined by a space, with all from number start on replaced by the period words from there, over and over."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    rest = F.size(words) - start
    again = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil(rest / period).cast("int")))
    return F.array_join(F.concat(F.slice(words, F.lit(1), start), F.slice(again, F.lit(1), rest)), " ")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs, best and collapsed of each row.

    runs has start, length and period by start, then period; best is the run with most periods (of equals the first, then
    the shortest period) or null; collapsed are the words that stay, joined by a space.
    """
    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))
    names = ("start", "length", "period")
    one = pa.struct([(x, pa.int64()) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                counts, runs, best, left = [], [], [], []
                for t in part.column(1).cast(pa.large_binary()).to_pylist():
                    words = (t or b"").split()  # of bytes: at the space and 0x09 to 0x0D alone
                    found = runs_of(words)
                    counts.append(len(words))
                    runs.append([dict(zip(names, r)) for r in found])
                    best.append(dict(zip(names, max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])))) if found else None)
                    left.append(b" ".join([w for w, k in zip(words, kept(len(words), found)) if k] if found else words))
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(one)), pa.array(best, one), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "n_words", "runs", "best", "collapsed"])

    struct = "struct<start:long,length:long,period:long>"
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_words long, runs array<{struct}>, best {struct}, collapsed string")
