"""Dictionary segmentation: against every way to cut a run, given cuts, and in retrieval."""

import math
import random

from pyspark.sql import functions as F

from quire import schemas
from quire.functions.segmenter import cheapest_path, word_tokens
from quire.operators.rag import Index

WORDS = {"动作": 50, "电位": 40, "动作电位": 30, "细胞": 80, "细胞膜": 20, "膜": 10, "的": 500, "形成": 60, "研究": 90, "研究生": 30, "生命": 60, "起源": 30}


def ways(run):
    if not run:
        yield []
    for j in range(1, len(run) + 1):
        for rest in ways(run[j:]):
            yield [run[:j], *rest]


def test_path_is_the_cheapest_of_all():
    total = math.log(sum(WORDS.values()))
    cost, rng = {w: total - math.log(n) for w, n in WORDS.items()}, random.Random(3)
    price = lambda way: sum(cost.get(w, total if len(w) == 1 else math.inf) for w in way)
    for _ in range(200):
        run = "".join(rng.choice("动作电位细胞膜的形成研究生命起源水") for _ in range(rng.randrange(1, 10)))
        got = cheapest_path(run, cost, 4, total)
        assert "".join(got) == run and abs(price(got) - min(map(price, ways(run)))) < 1e-9


def test_words_of_texts(spark):
    texts = ["动作电位的形成", "研究生命的起源", "细胞膜ATP酶2x", "", None, "水水水"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    cuts = lambda words: [r.t for r in rows.select("i", words(F.col("text")).alias("t")).orderBy("i").collect()]
    assert cuts(word_tokens(spark, WORDS))[:2] == [["动作电位"], ["生命", "起源"]]  # stop words are left out
    assert cuts(word_tokens(spark, WORDS, stop=())) == [["动作电位", "形成"], ["研究", "生命", "起源"], ["细胞膜", "ATP", "2x"], [], None, []]
    assert cuts(word_tokens(spark, {})) == [[], [], ["ATP", "2x"], [], None, []]


def test_an_index_with_a_dictionary_finds_words_inside_runs(spark, tmp_path):
    texts = ["本章讲细胞膜的形成过程", "本章讲研究生命起源的方法", "其他内容"]
    made = [{"chunk_id": f"c{i}", "ord": i, "text": t, "textbook_id": "b", "textbook": "书", "chapter": "章", "page": 1} for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(made, schemas.CHUNKS)
    asked = spark.createDataFrame([(1, "生命")], "qid long, question string")
    words = word_tokens(spark, WORDS)
    index = Index.build(chunks, words=words).save(f"{tmp_path}/index")
    from quire.operators.rag import bm25

    assert [r.ord for r in bm25(asked, index.postings, index.stats, words=index.words).collect()] == [1]
    assert bm25(asked, Index.build(chunks).postings, index.stats).count() == 0  # the run pattern knows whole runs only
    assert index.retrieve(asked).first().ord == 1
