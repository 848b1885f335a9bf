"""Fingerprints against their definition window by window, and what likeness tells."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import fingerprints as P


def level(window):
    term = lambda c: round(c * math.log2(c) * 65536)
    most = term(P.WINDOW)
    return (most - sum(map(term, Counter(window).values()))) * P.LEVELS // most


def brute_levels(text):
    return [level(text[i : i + P.WINDOW]) for i in range(len(text) - P.WINDOW + 1)]


def brute_ranks(texts):
    seen = Counter(x for t in texts for x in brute_levels(t))
    turn = sorted(range(P.LEVELS + 1), key=lambda x: (seen[x], x))
    return {x: k for k, x in enumerate(turn)}


def hashed(window):
    return int(P.hashes_at(np.frombuffer(window, np.uint8), np.zeros(1, int), len(window))[0])


def brute_digest(text, ranks):
    n = len(text) - P.WINDOW + 1
    if n <= P.ALL:
        chosen = list(range(max(n, 0)))
    else:
        rank, got = [ranks[x] for x in brute_levels(text)], Counter()
        for i in range(n - P.NEAR + 1):
            got[min(range(i, i + P.NEAR), key=lambda k: (rank[k], k))] += 1
        chosen = [k for k in range(n) if got[k] >= P.POINTS]
    windows = [text[k : k + P.WINDOW] for k in chosen]
    if 0 < len(text) < 2 * P.WINDOW:
        size = min(P.SMALL, len(text))
        windows += [text[k : k + size] for k in range(len(text) - size + 1)]
    filters = []
    for k, w in enumerate(windows):
        if k % P.FEATURES == 0:
            filters.append(["0"] * P.BITS)
        for j in range(P.HASHES):
            filters[-1][(hashed(w) >> 12 * j) % P.BITS] = "1"
    return "".join(f"{int(''.join(f), 2):0{P.BITS // 4}x}" for f in filters)


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    width = P.BITS // 4
    x, y = ([int(d[i : i + width], 16) for i in range(0, len(d), width)] for d in (a, b))
    if (sum(v.bit_count() for v in x), a) > (sum(v.bit_count() for v in y), b):
        x, y = y, x
    total = 0.0
    for v in x:
        best = 0.0
        for w in y:
            n, m, same = v.bit_count(), w.bit_count(), (v & w).bit_count()
            chance = n * m / P.BITS
            least = chance + 3 * math.sqrt(chance * (1 - n / P.BITS) * (1 - m / P.BITS) * P.BITS / (P.BITS - 1))
            best = max(best, (same - least) / (min(n, m) - least) if min(n, m) > least else float(same == min(n, m)))
        total += v.bit_count() * min(best, 1.0)
    return total / sum(v.bit_count() for v in x)


def prose(rng, n):
    words = "river bridge walk home slowly people under old stone light window garden summer paper letter answer été Größe 北京".split()
    return " ".join(rng.choice(words) + (rng.choice(",.;") if rng.random() < 0.1 else "") for _ in range(n))


def texts_of_every_kind(rng):
    texts = [prose(rng, rng.randint(0, 400)) for _ in range(40)] + ["", "a", "abcdefg", "abcdefgh", "x" * 31, "x" * 32, "y" * 63, "z" * 64, "ab" * 500, "-" * 3000, "\x00\x01" * 100]
    return texts + [prose(rng, 400)[:k] for k in (60, 95, 96, 97, P.ALL + P.WINDOW - 1, P.ALL + P.WINDOW, P.ALL + P.WINDOW + 1)]


def test_entropies_and_digests_by_definition(monkeypatch):
    texts = [t.encode() for t in texts_of_every_kind(random.Random(71))]
    ranks = brute_ranks(texts)
    table = np.array([ranks[x] for x in range(P.LEVELS + 1)])
    for piece in (P.PIECE, 700, 1):
        monkeypatch.setattr(P, "PIECE", piece)
        found = P.levels(texts)
        assert [x.tolist() for x in found] == [brute_levels(t) for t in texts]
        assert [d.hex() for d in P.digests(texts, found, table)] == [brute_digest(t, ranks) for t in texts]


def test_spliced_entropies():
    rng = random.Random(72)
    texts = [t.encode() for t in texts_of_every_kind(rng)]
    head, tail = [t[: rng.randint(0, len(t))] for t in texts], [t[: rng.randint(0, len(t))] for t in texts[::-1]]
    got = P._spliced(head, P.levels(texts), tail, P.levels(texts[::-1]))
    assert [x.tolist() for x in got] == [brute_levels(h + t) for h, t in zip(head, tail)]


def test_likeness_by_definition_and_as_expected():
    rng = random.Random(73)
    texts = [prose(rng, rng.randint(100, 600)).encode() for _ in range(30)]
    known = brute_ranks(texts)
    ranks = np.array([known[x] for x in range(P.LEVELS + 1)])
    digests = P.fingerprints(texts + [t[: 2 * len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:])], ranks)
    for a in digests[:8] + digests[30:38]:
        for b in digests:
            assert P.likeness(a, b) == pytest.approx(brute_likeness(a.hex(), b.hex())) and P.likeness(a, b) == P.likeness(b, a)
    edited = [P.likeness(a, b) for a, b in zip(digests, digests[30:])]
    others = [P.likeness(a, b) for k, a in enumerate(digests[:30]) for b in digests[k + 1 : 30]]
    assert min(edited) > 0.35 and sum(edited) / len(edited) > 0.5 and sum(others) / len(others) < 0.06
    assert P.likeness(b"", b"") == 1.0 and P.likeness(digests[0], b"") == 0.0


def brute_rows(rows):
    """The query's rows of (doc_id, text): near by the definition of likeness."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, -(rows[k][0] or 0)))
    texts = [rows[k][1] or "" for k in order]
    ranks = brute_ranks([t.encode() for t in texts])
    digest = [brute_digest(t.encode(), ranks) for t in texts]
    out = []
    for k, t in enumerate(texts):
        following, third = texts[(k + 1) % len(texts)], len(t) // 3
        changed = (t[: len(t) - third] + following[:third]).encode()
        other = brute_digest(changed, ranks)
        near = brute_likeness(digest[k], other), brute_likeness(digest[k], digest[(k + 1) % len(texts)])
        out.append((rows[order[k]][0], len(t), hashlib.sha256(changed).hexdigest(), digest[k], other, *(round(x, 9) for x in near)))
    return sorted(out, key=str)


def query(spark, folder, rows, parts=3):
    from quire.llm import queries

    schema = "doc_id long, text string, part string, edge int, edge_text string, fingerprint int, `a.b` int, n_chars int"
    spark.createDataFrame([(i, t, "p", 1, "e", 2, 3, 4) for i, t in rows], schema).repartition(parts).write.parquet(f"{folder}/documents.parquet")
    got = queries.op13_fingerprints(spark, str(folder))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got.collect()), key=str)


def test_query_on_odd_rows(spark, tmp_path):
    texts = texts_of_every_kind(random.Random(74))
    rows = [(3 * k, t) for k, t in enumerate(texts)] + [(10**6, None), (-5, prose(random.Random(75), 30_000)), (None, "text without an id"), (7, texts[0]), (8, texts[0]), (10, texts[0])]
    assert query(spark, tmp_path, rows) == brute_rows(rows)


def test_repeated_ids_and_rows_stand_side_by_side(spark, tmp_path):
    text = prose(random.Random(76), 60)
    rows = [(1, text)] * 5 + [(2, "other " + text)]
    assert query(spark, tmp_path, rows) == brute_rows(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, tmp_path, n):
    rows = [(k, f"text {k} of a tiny table that goes on for a while, {k}") for k in range(n)]
    assert query(spark, tmp_path, rows) == (brute_rows(rows) if n else [])


def test_every_row_alone_in_its_task(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(P, "TEXT_PER_TASK", 1)
    rows = [(k, prose(random.Random(k), 20)) for k in range(12)]
    assert query(spark, tmp_path, rows) == brute_rows(rows)


def test_ranks_count_all_windows_and_digests_alone_agree(spark):
    texts = texts_of_every_kind(random.Random(77))
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string").repartition(3)
    want = brute_ranks([t.encode() for t in texts])
    ranks = P.rarity(df)
    assert ranks.tolist() == [want[x] for x in range(P.LEVELS + 1)]
    got = {r.doc_id: r.fingerprint for r in P.digest(df, ranks).collect()}
    assert got == {k: brute_digest(t.encode(), want) for k, t in enumerate(texts)} | {99: ""}


def test_given_documents(spark):
    from quire.llm import queries

    got = {r.doc_id: r for r in queries.op13_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, following = texts[i], texts[order[(k + 1) % len(order)]]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 3] + following[: len(t) // 3]).encode()).hexdigest()
    by_text = {}
    assert all(by_text.setdefault(texts[i], got[i].fingerprint) == got[i].fingerprint for i in texts) and len(by_text) < len(texts)
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited > 0.3 for r in long) > 0.97 * len(long) and sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)
