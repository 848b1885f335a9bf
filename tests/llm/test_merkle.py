"""The Merkle manifest against a tree built in plain Python, and what its proofs detect."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(hashes):
    """(the root, for each leaf the siblings and slots level by level)."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i : i + 8] for i in range(0, len(hashes), 8)]
        for k, p in enumerate(at):
            run, slot = runs[p // 8], p % 8
            paths[k].append((slot, run[:slot], run[slot + 1 :]))
            at[k] = p // 8
        hashes = [H(*r) for r in runs]
    return hashes[0], paths


def brute(rows):
    """The query's rows for rows (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = own, *grown([leaf_of(r) for r in own])
    root, tops = grown([trees[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            steps = path + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf_of((*r[:4], r[4].translate(str.maketrans(merkle.UPPER, merkle.LOWER)))) if bad and r[4] is not None else leaf_of(r)
            for _, before, after in steps:
                fold = H(*before, fold, *after)
            out.append((r[0], leaf_of(r), subroot, root, H(*(x for _, b, a in steps for x in b + a)), fold, fold == root))
    return out


ODD = "doc_id long, source string, lang string, n_chars long, text string, hash string, Pos int, grp string, `a.b` int, steps int, __row long"


def query(spark, tmp_path, rows):
    from quire.llm import queries

    spark.createDataFrame([(*r, "h", 1, "g", 2, 3, 4) for r in rows], ODD).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


def rows_of_every_kind():
    rows = [(k, "ab"[k % 2], "en", 3, f"Text {k} É") for k in range(1, 600)]  # 599: four levels, the last runs with one node
    rows += [(k, None, None, None, None) for k in range(700, 709)] + [(800, "s", "", 0, ""), (801, "s", "zz", 1, "lone"), (802, "s", "É", 1, "x"), (803, "s", "É", 1, "Y")]
    rows += [(5, "a", "en", 3, "another text of the same id"), (7, "b", "en", 3, "Text 7 É"), (7, "b", "en", 3, "Text 7 É"), (None, "s", "en", 1, "No id"), (None, None, None, None, None), (-3, "s", "en", 1, "Negative")]
    return rows


def test_query_against_a_plain_tree(spark, tmp_path):
    rows = rows_of_every_kind()
    want = sorted(brute(rows), key=str)
    assert query(spark, tmp_path, rows) == want and {True, False} == {r[-1] for r in want}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_sizes_of_trees(spark, tmp_path, n):
    rows = [(k, "s", "en", 1, f"A{k}") for k in range(n)]
    assert query(spark, tmp_path, rows) == sorted(brute(rows), key=str) if n else query(spark, tmp_path, rows) == []


def test_many_groups_take_the_join_that_spreads(spark, monkeypatch):
    rows = [(k, "s", f"l{k % 40}" if k > 1500 else "hot", 1, f"A{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    want = sorted(((r[0], r[1], r[2], r[3], r[4]) for r in brute(rows)), key=str)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 10)
    got = merkle.verify(merkle.manifest(df)).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=str) == want and all(r.verified for r in got)


def test_preimages_hold_a_slot_for_each_child_and_prove_the_leaf(spark):
    df = spark.range(100).select(F.col("id").alias("n"), F.lit("g").alias("kind"), F.concat(F.lit("v"), "id").alias("v"))
    proofs = merkle.manifest(df, by="kind", key="n", fields=("n", "v"), tampered={"v": F.when(F.col("n") % 10 == 0, "changed").otherwise(F.col("v"))})
    for r in proofs.collect():
        now = r.leaf
        for slot, preimage in r.steps:
            assert len(preimage) % 64 == 0 and preimage[64 * slot : 64 * slot + 64] == now
            now = H(preimage)
        assert now == r.root and (r.changed is not None) == (r.n % 10 == 0)
    assert {r.n for r in merkle.verify(proofs, "n").collect() if not r.verified} == set(range(0, 100, 10))


def test_order_of_input_does_not_matter(spark):
    rows = rows_of_every_kind()
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert len({merkle.manifest(d).select("root").first()[0] for d in (df, df.repartition(7), df.orderBy(F.desc("text")))}) == 1
