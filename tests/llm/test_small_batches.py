"""What a task of the pipeline's operators holds at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import decontam, jaccard, mixing, quality, shared, tokens, words


def operators(docs):
    n = 3 * quality.N_OWN
    return {
        "quality": lambda: quality.score(docs, quality.Chain(np.zeros(n), np.ones(n), np.zeros(n), 0.0, np.zeros((2, 2)), 0.5)),
        "jaccard": lambda: jaccard.keep_one(docs),
        "decontam": lambda: decontam.clean(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(1)),
        "tokens": lambda: tokens.write_orc(docs, __import__("public_tokenizers").path("word_bpe_49k.json")),
    }


@pytest.mark.parametrize("name", ["quality", "jaccard", "decontam", "tokens"])
def test_batches_of_long_texts_are_bounded(spark, name):
    own = spark.newSession()
    docs = own.range(20, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: (F.lit(100_000) * F.col("id") + i).cast("string")), " ").alias("text"))
    operators(docs)[name]()

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    wide = own.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 5000).alias("t"))
    found = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 4000 * 5000 and max(found) <= 4 << 20


def test_a_session_keeps_its_own_limit(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "65536")
    jaccard.join(own.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == "65536"


def test_pieces_of_short_texts_are_small():
    texts = pa.array(["word " * 2000] * 200)
    found = list(words.pieces(texts))
    assert sum(len(data) for _, _, data, _ in found) == 200 * 10_000 and max(len(data) for _, _, data, _ in found) <= 1 << 17


def test_rows_of_the_driver_need_no_python_worker(spark, monkeypatch):
    """Lists that createDataFrame() is given are an RDD in Python; no operator of the pipeline makes one."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("a list went through an RDD"))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("key"), F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("source "), F.col("id") % 3)).alias("source"), F.lit("some words here\nand there").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert quality.score(docs, quality.train(docs, labels)).count() == 3000
    assert not quality.train(docs, labels.limit(0)).weight.any()
    assert mixing.mix(docs, F.array("source")).agg(F.sum("taken")).first()[0] > 3000
    two = spark.range(2).select(F.lit("a").alias("key"), F.col("id").alias("b"))
    assert shared.salted_join(docs.select("doc_id", "key"), two, "key").distinct().count() == 6000
    assert dict(shared.from_rows(spark, [([None, "é"], 1)], {"p": pa.list_(pa.string()), "n": pa.int32()}).dtypes) == {"p": "array<string>", "n": "int"}
