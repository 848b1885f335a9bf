"""The pruned nearest neighbours by sparse cosine against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import integrate, vectors


def postings(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").repartition(4)
    tf = vectors.counts(rows, "ord", F.split("text", " "))
    return vectors.tfidf(tf, vectors.vocabulary(tf, len(texts), "ord", None), "ord").cache()


def texts_of(n, seed):
    """Common words everywhere, rare words in groups of a dozen, some repeated texts, some of common words only."""
    rng, made = random.Random(seed), []
    for i in range(n):
        common = [f"c{int(rng.random() ** 3 * 20)}" for _ in range(12)]
        rare = [] if i % 9 == 0 else [f"g{i // 12}x{rng.randrange(6)}" for _ in range(5)]
        made.append(" ".join(common + rare))
    return made + made[:15] + ["lonely"]


@pytest.mark.parametrize("k, probed", [(10, vectors.PROBED), (3, 200), (2, 0)])
def test_top_cosine_is_that_of_all_pairs(spark, k, probed):
    unit = postings(spark, texts_of(240, k))
    left, right = unit.withColumnRenamed("ord", "a"), unit.withColumnRenamed("ord", "b")
    want = vectors.top_neighbours(vectors.cosine_pairs(left, right, "a", "b").where("a <> b"), "a", "b", k)
    rows = lambda df: {(r.a, r["rank"]): (r.b, round(r.cosine, 8)) for r in df.collect()}
    got = rows(vectors.top_cosine(left, right, "a", "b", k, probed))
    assert got == rows(want) and len(got) > 200 * k


def test_pairs_that_share_common_words_only_are_not_read(spark):
    counts = []
    for n in (240, 960):
        unit = postings(spark, texts_of(n, 1))
        left, right = unit.withColumnRenamed("ord", "a"), unit.withColumnRenamed("ord", "b")
        pairs, _ = vectors.promising_pairs(vectors.bounded_terms(left, right, "a"), right, "a", "b", 3, 200)
        rare = {i for i in range(n) if i % 9}
        counts.append(sum(1 for r in pairs.collect() if r.a in rare))
        assert counts[-1] < vectors.cosine_pairs(left, right, "a", "b").count() / 4
    assert counts[1] < 6 * counts[0]  # all pairs grow 16-fold


def test_empty_tables(spark):
    none = spark.createDataFrame([], "a long, term string, w double")
    assert vectors.top_cosine(none, none.withColumnRenamed("a", "b"), "a", "b").count() == 0


def test_blocks_give_the_nearest_of_all_pairs(spark):
    texts = texts_of(240, 7)
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    tf = vectors.gram_counts(rows, "ord", "text")
    unit = vectors.tfidf(tf, vectors.vocabulary(tf, len(texts), "ord", 300), "ord")
    want = vectors.top_neighbours(vectors.cosine_pairs(unit.withColumnRenamed("ord", "a"), unit.withColumnRenamed("ord", "b"), "a", "b"), "a", "b", 5)
    terms = vectors.frequent(vectors.term_totals(rows, "text"), len(texts), 300)
    got = vectors.top_in_blocks(rows, "ord", "text", terms, 5, size=50)
    pairs = lambda df: {(r.a, r.b): round(r.cosine, 8) for r in df.collect()}
    assert pairs(got) == pairs(want) and len(pairs(want)) == 5 * (len(texts) - 1)  # one has none of the terms


def test_copies_are_compared_once_and_still_have_their_own_neighbours(spark):
    """40 texts of 30 copies each: no task multiplies more than the 40, ties and copies come as in all pairs."""
    nodes = spark.createDataFrame([(i, f"part {i % 40} of {i % 7 if i < 40 else (i % 40) % 7}", "") for i in range(1200)] + [(1200, None, None)], "ord long, name string, definition string")
    compared = []
    blocks = vectors.top_in_blocks
    vectors.top_in_blocks = lambda docs, *a, **b: compared.append(docs.count()) or blocks(docs, *a, **b)
    try:
        got = {(r.a, r.b): round(r.cosine, 8) for r in integrate.neighbour_pairs(nodes).collect()}
    finally:
        vectors.top_in_blocks = blocks
    texts = nodes.select("ord", F.concat("name", F.lit("。"), "definition").alias("text"))
    tf = vectors.gram_counts(texts, "ord", "text")
    unit = vectors.tfidf(tf, vectors.vocabulary(tf, 1201, "ord"), "ord")
    every = vectors.cosine_pairs(unit.withColumnRenamed("ord", "a"), unit.withColumnRenamed("ord", "b"), "a", "b").where("a <> b")
    want = {(r.a, r.b): round(r.cosine, 8) for r in vectors.top_neighbours(every, "a", "b").where("a < b").collect()}
    assert got == want and compared == [41]


def test_two_blocks_meet_once_in_few_tasks_however_finely_files_are_split(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    rows = spark.createDataFrame(list(enumerate(texts_of(240, 3))), "ord long, text string")
    terms = vectors.frequent(vectors.term_totals(rows, "text"), 256, 300)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        packs = vectors.cut(vectors.packed(rows.repartition(12), "ord", "text", terms, 64).withColumn("block", F.monotonically_increasing_id()))
        pairs = vectors.block_pairs(packs, 3)
        assert packs.rdd.getNumPartitions() > 12 and pairs.rdd.getNumPartitions() == 9
        got = [frozenset(x) for x in pairs.select("block", "block_b").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    blocks = [r.block for r in packs.select("block").collect()]
    assert len(blocks) == 12 and len(got) == len(set(got)) == 12 * 13 // 2
    most = packs.select(F.max((F.octet_length("codes") + F.octet_length("tf")) / (F.octet_length("n") / 8))).first()[0]
    assert most <= 4 * 300  # four bytes a term of a text, once twelve


def test_single_precision_does_not_tell_near_ties_apart_by_itself(spark):
    """Cosines that differ by 1e-8 and less, in blocks that a side has several of."""
    texts = ["aa " * (400 + i) + "bb " * 300 for i in range(130)] + ["aa bb"] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    unit = vectors.tfidf(vectors.gram_counts(rows, "ord", "text"), vectors.vocabulary(vectors.gram_counts(rows, "ord", "text"), len(texts), "ord", None), "ord")
    want = vectors.top_neighbours(vectors.cosine_pairs(unit.withColumnRenamed("ord", "a"), unit.withColumnRenamed("ord", "b"), "a", "b"), "a", "b", 4)
    got = vectors.top_in_blocks(rows, "ord", "text", vectors.frequent(vectors.term_totals(rows, "text"), len(texts)), 4, size=8)
    pairs = lambda df: {(r.a, r.b): round(r.cosine, 9) for r in df.collect()}
    assert pairs(got) == pairs(want) and len(pairs(want)) == 4 * len(texts)


def test_like_texts_share_blocks_and_all_pairs_are_still_compared(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SORTED", 1)
    rng = random.Random(5)
    words = [["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)] for letters in ("abcde", "klmno", "vwxyz")]
    texts = [*(" ".join(rng.choice(words[i % 3]) for _ in range(rng.choice((3, 40)))) for i in range(300)), None, "", "ae ae", "ae ae"]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    terms = vectors.frequent(vectors.term_totals(rows, "text"), len(texts), 500)
    unit = vectors.tfidf(vectors.gram_counts(rows, "ord", "text"), spark.createDataFrame(terms, "term string, idf double"), "ord").cache()
    every = vectors.cosine_pairs(unit.withColumnRenamed("ord", "a"), unit.withColumnRenamed("ord", "b"), "a", "b")
    want = {(r.a, r.b): round(r.cosine, 8) for r in vectors.top_neighbours(every, "a", "b", 6).collect()}
    got = {(r.a, r.b): round(r.cosine, 8) for r in vectors.top_in_blocks(rows, "ord", "text", terms, 6, size=20).collect()}
    assert got == want and len(want) > 1500

    packs = vectors.packed(vectors.alike(rows, "ord", "text", len(texts), 16), "ord", "text", terms, 96, 6).collect()
    blocks = [np.frombuffer(r.ids, np.int64).tolist() for r in packs]
    assert sorted(sum(blocks, [])) == [i for i, t in enumerate(texts) if t] and max(map(len, blocks)) < 60
    assert np.mean([len({i % 3 for i in b if i < 300}) for b in blocks]) < 1.7  # kinds in a block; about three if texts are dealt out at random
    last = {}
    for (a, _), cosine in want.items():
        last[a] = min(cosine, last.get(a, 1.0))
    least = [(i, x) for b, r in zip(blocks, packs) for i, x in zip(b, np.frombuffer(r.least, float))]
    assert all(x <= last[i] + 1e-7 for i, x in least) and np.mean([x > 0.1 for _, x in least]) > 0.7  # told before any two blocks meet
