"""NN-descent: no link lost among rare pairs, and audits that see what is lost."""

import collections

import numpy as np
import pytest

from quire.llm import neardup


def planted(rng, n, pairs, size=32, noise=0.3):
    x = rng.standard_normal((n, size))
    for k in range(pairs):
        x[n - 1 - k] = x[k] + noise * rng.standard_normal(size)
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(n) * 3, x.astype("f4"))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def degrees(rows):
    x = np.array([v for _, v in rows], "f4").astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    return {i: int(d) for (i, _), d in zip(rows, links.sum(1))}


def test_rare_pairs_are_found(spark):
    rows = planted(np.random.default_rng(21), 4000, 150)
    want = degrees(rows)
    got, recall = neardup.audited(frame(spark, rows))
    got = {r.vec_id: r.n_links for r in got.collect()}
    assert sum(want.values()) > 200
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.99 * sum(want.values()) and recall >= neardup.RECALL


def test_a_poor_graph_fails_its_audit(spark, monkeypatch):
    rows = planted(np.random.default_rng(22), 3000, 150)
    heard = []
    audit = neardup.Graph.audit
    monkeypatch.setattr(neardup, "START", 0.3)
    monkeypatch.setattr(neardup, "TOGETHER", 3)
    monkeypatch.setattr(neardup.Graph, "refine", lambda self: None)  # trees alone
    monkeypatch.setattr(neardup.Graph, "audit", lambda self, *a: heard.append(audit(self, *a)) or heard[-1])
    got, recall = neardup.audited(frame(spark, rows))
    assert heard[0][0] < 0.99 and heard[0][1] > 0 and len(heard) > 1 and recall == heard[-1][0] >= 0.99
    want = degrees(rows)
    assert sum(r.n_links for r in got.collect()) >= 0.97 * sum(want.values())


def test_an_audit_without_links_says_so(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(np.random.default_rng(23).standard_normal((300, 32)))]
    got, recall = neardup.audited(frame(spark, rows))
    assert recall is None and {r.n_links for r in got.collect()} == {0}


def test_groups_larger_than_a_square(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SQUARE", 20)
    rng = np.random.default_rng(24)
    center = rng.standard_normal(16)
    rows = [(k, (center + 0.13 * rng.standard_normal(16)).astype("f4").tolist()) for k in range(150)] + [(1000 + k, v.astype("f4").tolist()) for k, v in enumerate(rng.standard_normal((100, 16)))]
    want = degrees(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.link(frame(spark, rows)).collect()}
    assert sum(abs(got[i][0] - want[i]) for i in want) <= 0.01 * sum(want.values())
    assert collections.Counter(c for _, c in got.values()).most_common(1)[0][1] >= 149


def test_lists_keep_the_nearest_and_what_waits(spark):
    pairs = spark.createDataFrame([(1, u, 1.0 - u / 100) for u in range(2, 12)], neardup.PAIR)
    lists = neardup._lists(pairs, None, 4)
    row = lists.where("id = 1").first()
    assert row.u == [2, 3, 4, 5] and all(row.fresh) and row.kth == pytest.approx(0.95)
    waiting = spark.createDataFrame([(1, 3)], "v long, u long")
    again = neardup._lists(spark.createDataFrame([(1, 50, 0.975)], neardup.PAIR), lists, 4, waiting).where("id = 1").first()
    assert list(zip(again.u, again.fresh)) == [(2, False), (50, True), (3, True), (4, False)]


def test_pivots_let_no_fresh_entry_go(spark):
    lists = spark.createDataFrame([(k, [0], [0.5], [True], -1.0) for k in range(1, 30)], "id long, u array<long>, s array<double>, fresh array<boolean>, kth double")
    pivots, waiting = neardup._pivots(lists, 3)
    chosen = {r.u for r in pivots.where("p = 0").collect()}
    waits = {(r.v, r.u) for r in waiting.collect()}
    assert len(chosen) == 6 and {u for v, u in waits if v == 0} == set(range(1, 30)) - chosen
