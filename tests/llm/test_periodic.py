"""Periodic runs against their definition, tried for every period, and the query on odd and on given tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every stretch with a smallest period q and max(6, 4 * q) words that no neighbour extends."""
    n, out, covered = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(6, 4 * q) and not any(q % p == 0 and (s <= start and start + length <= s + k) for s, k, p in covered):
                out.append((start, length, q))
                covered.add((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def sequences(rng):
    """Sequences rich in runs: few letters, nested periods, Fibonacci words, runs at both ends and beside each other."""
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    yield from (list(b[:k]) for k in (0, 1, 5, 6, 7, 8, 9, 100, 400))
    yield from (list("a" * k) for k in (5, 6, 7, 100))
    for _ in range(120):
        out = []
        while len(out) < rng.randint(1, 160):
            unit = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.3:
                unit = unit * rng.randint(2, 5) + [rng.choice("abc")]
            out += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
        yield out
    yield from ([rng.choice("ab") for _ in range(300)] for _ in range(20))


def test_runs_by_their_definition():
    for words in sequences(random.Random(61)):
        want = brute_runs(words)
        assert periodic.runs_of(words) == want, "".join(words)
        ids = [ord(w) for w in words]
        assert sorted(periodic.lyndon_runs(ids), key=lambda r: (r[0], r[2])) == want  # without zones
        assert all(periodic.holds(np.array(ids), r) for r in want)


def test_extensions():
    rng = random.Random(62)
    ids = ([1, 2, 1] * 60 + [rng.randint(1, 2) for _ in range(100)]) * 2
    ext = periodic.Extensions(ids, periodic.BASES[0])
    for _ in range(2000):
        i, j = sorted(rng.sample(range(len(ids)), 2))
        same = next((k for k in range(len(ids) - j) if ids[i + k] != ids[j + k]), len(ids) - j)
        back = next((k for k in range(i) if ids[i - 1 - k] != ids[j - 1 - k]), i)
        assert ext.right(i, j) == same and ext.left(i, j) == back


def test_a_poor_hash_is_noticed(monkeypatch):
    words = [str(k * k % 7) for k in range(40)] * 5 + ["x"]
    monkeypatch.setattr(periodic, "BASES", (0, periodic.BASES[0]))  # base 0 sees the last word alone
    assert periodic.runs_of(words) == brute_runs(words)
    monkeypatch.setattr(periodic, "holds", lambda ids, run: False)
    with pytest.raises(ArithmeticError):
        periodic.runs_of(words)


def test_zones_leave_prose_out():
    rng = random.Random(63)
    prose = [str(rng.randint(0, 300)) for _ in range(3000)]
    line = ["the", "same", "long", "line", "of", "words", "again"]
    ids = lambda words: np.unique(words, return_inverse=True)[1]
    assert periodic.zones(ids(prose[:1000] + line + prose[1000:2000] + line + prose[2000:])) == []
    (a, b), *rest = periodic.zones(ids(prose[:500] + line * 6 + prose[500:]))
    assert not rest and a == 500 and 540 <= b <= 546


def query(spark, folder, rows):
    from quire.llm import queries

    schema = "doc_id long, text string, runs int, `Start` int, best string, __text string, n int, g long"
    spark.createDataFrame([(i, t, 1, 2, "b", "t", 3, 4) for i, t in rows], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(folder))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(64)
    planted = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 10 == 0][:40]
    rows = [(k, " ".join(rng.choice("river Bridge walk x home é".split(" ")) for _ in range(rng.randint(0, 90)))) for k in planted + list(range(50))]
    rows += [(None, None), (None, "a a a a a a a"), (60, None), (61, ""), (62, " \t\n "), (63, "A a A a A a A a\x0bb"), (64, "x\x00y " * 9), (65, "w " * 5000), (65, "w " * 5000), (66, "long " + "y" * 100_000)]
    rows += [(67, " ".join(f"w{k % 700}" for k in range(4000)))]
    want = sorted((brute_row(*r) for r in rows), key=str)
    assert query(spark, tmp_path, rows) == want and sum(r[1] > 0 for r in want) > 30


def test_query_on_an_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_query_on_given_documents(spark):
    from quire.llm import queries

    sf = "/root/testdata/sf0.001"
    want = sorted((brute_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=str)
    assert sorted(map(tuple, queries.op12_periodic_runs(spark, sf).collect()), key=str) == want and any(r[1] for r in want)


def test_long_runs_take_time_in_proportion():
    import time

    began = time.time()
    assert periodic.runs_of(["a"] * 100_000) == [(0, 100_000, 1)]
    assert periodic.runs_of([str(k % 9973) for k in range(100_000)]) == [(0, 100_000, 9973)]
    assert time.time() - began < 20
