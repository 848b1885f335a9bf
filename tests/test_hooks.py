"""Settings, hooks for models and encoders, and what the store, the index and uploads do besides queries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.config import Settings
from quire.operators import extract, rag, report, vectors
from quire.operators.components import connected, cut
from quire.sources import readers, store


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# comment\nEMBEDDING_BACKEND = 'tfidf'\nENABLE_LLM_EXTRACTION=yes\nUNKNOWN=1\nnonsense\nMERGE_THRESHOLD=0.7\n")
    got = Settings.load({"embedding_backend": "hash"}, str(tmp_path / ".env"))
    assert got == Settings(embedding_backend="hash", enable_llm_extraction=True, merge_threshold=0.7)
    assert Settings.load({}, None) == Settings()


def chunks(spark):
    rows = [("c1", 0, "The heart pumps blood. It is a muscle in the chest.", "b1", "Book", "One", 1), ("c2", 1, "Lungs take in air; the air reaches the blood.", "b1", "Book", "Two", 2)]
    return spark.createDataFrame(rows, schemas.CHUNKS)


def test_answers_by_a_writer(spark):
    index = rag.Index.build(chunks(spark))
    asked = spark.createDataFrame([(1, "heart muscle"), (2, "lungs air"), (3, "zzzz qqqq")], "qid long, question string")

    def write(question, sources):
        if "lungs" in question:
            raise RuntimeError("no service")
        return f"{question}: {len(sources) <= rag.CONTEXT and '[Book, One, 第 1 页]' in sources}"

    got = {r.qid: r for r in index.answer(asked, write=write).collect()}
    plain = {r.qid: r for r in index.answer(asked).collect()}
    assert got[1].answer == "heart muscle: True" and got[2].answer == plain[2].answer != "" and got[3].answer == rag.NOT_FOUND


def test_index_is_saved_and_cleared(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    asked = spark.createDataFrame([(1, "heart muscle")], "qid long, question string")
    index = rag.Index.build(chunks(spark)).save(path)
    assert index.answer(asked).first().citations[0].chunk_id == "c1"
    assert rag.Index.clear(spark, path) and not os.path.exists(tmp_path / "index") and not rag.Index.clear(spark, path)
    assert rag.Index.empty(spark).answer(asked).first().answer == rag.NOT_INDEXED


def test_back_ends(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None)], "k long, t string")
    assert vectors.backend("auto") == vectors.backend("sentence-transformers") == "tfidf" and vectors.backend("hash") == "hash"
    encode = lambda texts: np.array([[len(t), 1.0] for t in texts])
    kind, rows = vectors.vectorized(docs, "k", "t", "auto", encode)
    got = {r.k: r.vector for r in rows.collect()}
    assert kind == "encoder" and got[1] == pytest.approx([5 / 26**0.5, 1 / 26**0.5]) and got[2] == [0.0, 1.0]
    for name in ("tfidf", "hash"):
        kind, rows = vectors.vectorized(docs, "k", "t", name)
        assert kind == name and {r.k: round(r.n, 6) for r in rows.groupBy("k").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()} == {1: 1.0}


def test_gram_counts_are_those_of_word_grams(spark):
    docs = spark.createDataFrame([(1, "A bc  bc\n déf x"), (2, ""), (3, None), (4, "  ")], "k long, t string")
    count = lambda df: sorted(map(tuple, df.collect()))
    assert count(vectors.gram_counts(docs, "k", "t")) == count(vectors.counts(docs, "k", vectors.word_grams(F.col("t"))))


def test_model_graphs(spark):
    chapters = spark.createDataFrame([("b", "c1", 1, "心脏", 3, "动作电位是细胞的电活动。静息电位是其基础。"), ("b", "c2", 2, "肺", 9, "x"), ("b", "c3", 3, "肾", 12, "x")], "textbook_id string, chapter_id string, chapter_ord int, title string, page_start int, content string")
    books = spark.createDataFrame([("b", "生理学")], "textbook_id string, title string")

    def ask(book, title, text):
        assert book == "生理学" and len(text) <= extract.SHOWN
        if title == "肺":
            raise RuntimeError("no service")
        if title == "肾":
            return "no JSON {"
        return 'Here: {"nodes": [{"name": "动作电位", "definition": ""}, {"name": "静息电位", "definition": "基础", "page": 4}, {"name": "主要症状"}], "edges": [{"source": "动作电位", "target": "静息电位", "relation_type": "prerequisite"}, {"source": "动作电位", "target": "静息电位", "relation_type": "odd"}]} done'

    nodes, edges = extract.model_graphs(chapters, books, ask)
    got = {r.name: r for r in nodes.collect()}
    assert set(got) == {"动作电位", "静息电位"} and got["静息电位"].page == 4 and got["动作电位"].page == 3 and got["动作电位"].definition.startswith("动作电位是") and got["动作电位"].importance == 0.75
    assert [(r.source, r.target, r.relation_type, r.weight) for r in edges.collect()] == [(got["动作电位"].id, got["静息电位"].id, "prerequisite", 1.0)]


def test_json_object(spark):
    said = ['{"a": 1}', 'x {"a": {"b": 2}} y', "{", "", None, "[1]"]
    got = [r.j for r in spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string").orderBy("k").select(extract.json_object(F.col("s")).alias("j")).collect()]
    assert got == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None, None]


def test_uploads_keep_chapters_and_deletion_cascades(spark, tmp_path):
    from quire.streaming import uploads

    landing, source = tmp_path / "landing", tmp_path / "My Book.md"
    landing.mkdir()
    source.write_text("# One\n" + "The heart pumps blood through the body all day long. " * 4 + "\n# Two\n" + "The lungs take in air and give it to the blood. " * 4)
    target = readers.save_upload(spark, f"file://{source}", f"file://{landing}")
    assert os.path.exists(target.removeprefix("file://")) and target.endswith(".md") and "My Book" not in target
    kept = store.Store(spark, f"file://{tmp_path}/store")
    uploads.ingest(uploads.upload_stream(spark, str(landing)), kept, f"file://{tmp_path}/checkpoint").awaitTermination()
    book = kept.read("books").first()
    assert kept.read("chapters").where(F.col("textbook_id") == book.textbook_id).count() == len(book.chapters) > 0
    rag.Index.build(chunks(spark)).save(f"file://{tmp_path}/index")
    kept.save_integration(*(spark.createDataFrame([], s) for s in (schemas.NODES, schemas.EDGES, schemas.DECISIONS)))
    assert kept.delete_book(book.textbook_id, f"file://{landing}", f"file://{tmp_path}/index") and not kept.delete_book(book.textbook_id)
    assert kept.read("books").count() == kept.read("chapters").count() == 0 and not os.path.exists(tmp_path / "index")
    assert [t.count() for t in kept.integration()] == [0, 0, 0]


def test_decision_summary(spark):
    decisions = spark.createDataFrame([(1, "merge_001", "merge", list("abcdef"), "m", "r", 0.9, False), (2, "keep_002", "keep", ["x"], "x", "r", 0.7, False)], schemas.DECISIONS)
    one = spark.range(3)
    lines = [r.text for r in report.decision_summary(decisions, one, one).orderBy("line").collect()]
    assert lines == ["# 跨教材整合决策摘要", "- 决策总数：2", "- 合并：1", "- 保留：1", "- 删除：0", "- 整合后节点：3", "- 整合后关系：3", "## 高置信度合并示例", "- merge_001：置信度 0.90，结果节点 m，来源 a、b、c、d、e"]
    assert report.listed_decisions(decisions, 1).first().decision_id == "merge_001"
    assert [r.qid for r in report.listed_results(spark.range(20).withColumnRenamed("id", "qid")).collect()] == list(range(8))


def test_components_of_chains(spark):
    nodes = spark.range(200).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(k, k + 1) for k in range(99)] + [(150, 150), (160, 170), (170, 160)], "a long, b long")
    got = {r.node: r.component for r in connected(nodes, edges).collect()}
    assert got == {k: 0 if k < 100 else 160 if k == 170 else k for k in range(200)}


def test_lineage_is_cut_by_a_table(spark):
    assert cut(spark.range(5)).inputFiles()


def test_hashed_grams_of_a_text_are_counted_inside_its_row(spark):
    """As the joined plan's, which rows of one key still take, without a shuffle of grams."""
    texts = ["abc de", "é中文 😀x" * 5, " \n", None, "a", "abc de"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = vectors.hashed(rows, "k", "t")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    slot = F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(vectors.SLOTS)).cast("int")
    grams = rows.where("k <> 1").select("k", F.explode(vectors.flat_grams(F.col("t"))).alias("gram"))
    want = vectors.normalized(grams.groupBy("k", slot.alias("term")).agg(F.count("*").cast("double").alias("w")), "k")
    as_map = lambda df: {(r[0], r[1]): round(r[2], 12) for r in df.collect()}
    assert as_map(got.where("k <> 1")) == as_map(want) and got.where("k = 1").count() > 20
    twice = vectors.hashed(spark.createDataFrame([(1, "abc"), (1, "abc")], "k long, t string"), "k", "t")
    assert as_map(twice) == as_map(vectors.hashed(spark.createDataFrame([(1, "abc")], "k long, t string"), "k", "t"))
