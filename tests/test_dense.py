"""Dense nearest neighbours against numpy, and the inverted file's recall."""

import numpy as np
import pytest

from quire.operators import dense


def brute(queries, rows, k):
    """(qid, rank, key, cosine) by the definition; rows: key -> vector or None."""
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
    out = []
    for q in queries:
        if not ok(rows[q]):
            continue
        a, found = np.array(rows[q], float), []
        for key, v in rows.items():
            if key != q and ok(v) and len(v) == len(a):
                b = np.array(v, float)
                found.append((-round(float(a @ b / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1))), 9), key))
        out += [(q, n + 1, key, -c + 0.0) for n, (c, key) in enumerate(sorted(found)[:k])]
    return sorted(out)


def clustered(n, width=16, groups=12, seed=81):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, width))
    return {k: (centre[k % groups] + 0.4 * rng.normal(size=width)).tolist() for k in range(n)}


def frame(spark, rows):
    return spark.createDataFrame([(k, v, k % 3, "x") for k, v in rows.items()], "key long, v array<double>, cell int, `a.b` string").repartition(5)


def rows_of(df):
    return sorted((r.qid, r.rank, r.key, round(r.cosine, 9) + 0.0) for r in df.collect())


ODD = {10_000: None, 10_001: [], 10_002: [0.0] * 16, 10_003: [float("nan")] * 16, 10_004: [1.0] + [None] * 15, 10_005: [1.0, 2.0], 10_006: [2.0, 4.0], 10_007: [float("inf")] * 16}


@pytest.mark.parametrize("block", [2048, 7])
def test_exact_top(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "BLOCK", block)
    monkeypatch.setattr(dense, "QUERY_BLOCK", block)
    rows = clustered(150) | ODD | {20_000 + k: [1.0] * 16 for k in range(30)}  # copies: ties by key
    asked = [k for k in rows if k % 5 == 0 or k >= 10_000]
    df = frame(spark, rows)
    assert rows_of(dense.exact_top(df.where(df.key.isin(asked)), df, 4)) == brute(asked, rows, 4)


def test_inverted_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 32)
    monkeypatch.setattr(dense, "PART_BLOCKS", 2)
    rows = clustered(1500) | ODD | {20_000 + k: [1.0] * 16 for k in range(400)}  # a cell of many blocks
    df = frame(spark, rows)
    index = dense.InvertedFile.build(df, f"file://{tmp_path}/i", k=5)
    asked = df.where("key % 20 = 0 or key >= 10000 and key < 20001")
    exact = dense.exact_top(asked, df, 5)
    found = index.search(asked, 5)
    assert 0.95 <= dense.recall(found, exact) <= 1 and index.probes < len(index.centroids) / 2
    every = index.search(asked, 5, probes=len(index.centroids))
    assert rows_of(every) == rows_of(exact)  # looking everywhere is the exact form: every row is in the index once
    again = dense.InvertedFile.load(spark, f"file://{tmp_path}/i")
    assert again.probes == index.probes and rows_of(again.search(asked, 5)) == rows_of(found)
    few = dense.recall(index.search(asked, 5, probes=1), exact)
    assert few < 1


def test_more_probes_where_cells_tell_less(spark, tmp_path):
    rng = np.random.default_rng(82)
    rows = {k: rng.normal(size=32).tolist() for k in range(800)}
    df = frame(spark, rows)
    index = dense.InvertedFile.build(df, f"file://{tmp_path}/i")
    asked = df.where("key % 20 = 0")
    assert dense.recall(index.search(asked), dense.exact_top(asked, df)) >= 0.9


def test_empty_tables(spark, tmp_path):
    df = frame(spark, {1: [1.0, 2.0]})
    none = df.where("key < 0")
    index = dense.InvertedFile.build(none, f"file://{tmp_path}/i")
    assert index.search(df).count() == 0 and dense.exact_top(df, none).count() == 0 and dense.exact_top(none, df).count() == 0
    one = dense.InvertedFile.build(df, f"file://{tmp_path}/j")
    assert one.search(df).count() == 0 and one.search(none).count() == 0 and dense.recall(one.search(df), dense.exact_top(df, df)) == 1


def test_query_recall(spark):
    from quire.plans import nearest

    sf = "/root/testdata/sf0.01"
    found, exact = nearest.inverted_file_neighbours(spark, sf), nearest.dense_neighbours(spark, sf)
    assert dense.recall(found, exact) >= 0.9 and found.select("qid").distinct().count() == exact.select("qid").distinct().count()
