import io
import zipfile

from pyspark.sql import functions as F

from quire import schemas
from quire.operators import extract, feedback, graphview, integrate, rag, report, segment
from quire.operators.components import connected
from quire.sources import readers
from quire.sources.store import Store, chat_tail


def nodes_of(spark, rows):
    """(book, name, definition, importance) rows as nodes."""
    full = [(b, 1, k, f"n{k}", n, d, "核心概念", "第一章", k, b, f"{b} p{k}", 1, [], i) for k, (b, n, d, i) in enumerate(rows, 1)]
    return spark.createDataFrame(full, schemas.NODES)


def test_components_match_union_find(spark):
    edges = [(1, 2), (2, 3), (3, 3), (7, 8), (9, 8), (20, 7)] + [(100 + k, 101 + k) for k in range(40)]
    got = dict(connected(spark.range(1, 150).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {k: k for k in range(1, 150)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {k: find(k) for k in parent}


def test_integration(spark):
    nodes = nodes_of(spark, [("A", "动作电位", "动作电位是快速波动", 0.9), ("B", "Action Potential", "短", 0.95), ("A", "第一节", "x", 0.5), ("B", "第一节", "y", 0.5), ("B", "白细胞", "白细胞渗出现象", 0.4), ("A", "leukocyte", "white", 0.6)])
    edges = spark.createDataFrame([("A", 1, 1, "n1", "n6", "contains", "d1", 0.8), ("B", 1, 2, "n2", "n5", "contains", "d2", 0.8), ("A", 1, 3, "n5", "n6", "parallel", "loop", 0.4), ("A", 1, 4, "n1", "gone", "parallel", "dead", 0.4)], schemas.EDGES)
    books = spark.createDataFrame([("A", 100), ("B", 100)], "textbook_id string, total_chars long")
    out = integrate.integrate(books, nodes, edges)
    merged = {r.name: r for r in out.nodes.collect()}
    assert merged["动作电位"].aliases == ["Action Potential"] and merged["动作电位"].frequency == 2 and merged["动作电位"].importance == 1.0
    assert merged["白细胞"].aliases == ["leukocyte"] and merged["白细胞"].definition == "白细胞渗出现象（同义/近义表述：leukocyte。）"
    assert len([r for r in out.nodes.collect() if r.name == "第一节"]) == 2
    assert [(r.relation_type, r.description) for r in out.edges.collect()] == [("contains", "d1")]
    s = out.stats.first()
    assert (s.nodes_before, s.nodes_after, s.merge_count, s.keep_count, s.edges_after) == (6, 4, 2, 2, 1)
    replies, after = feedback.run_all(out.decisions, out.nodes, ["为什么合并 动作电位", "拆分 动作电位", "保留 动作电位", "合并 A 和 B", "你好", "删除 没有的概念"])
    assert replies[0].startswith("关于“动作电位”") and replies[1].startswith("已把“动作电位”") and "格式" in replies[3] and replies[5].startswith("没找到")
    kept = after.where("teacher_locked").collect()
    assert [d.action for d in kept] == ["keep"] and "不应合并" in kept[0].reason and "要求保留" in kept[0].reason
    chapters = spark.createDataFrame([("A", 1, "ch_001", "第一章", 1, 2, "x", 1)], schemas.CHAPTERS)
    text = report.markdown(books.withColumn("title", F.col("textbook_id")).withColumn("book_ord", F.lit(1)), chapters, nodes, edges, out.nodes, out.decisions, out.stats, "now")
    assert "| A | 1 | 100 | 3 | 3 |" in text and "### 案例：动作电位" in text


def test_merge_rule(spark):
    rows = spark.createDataFrame([(0.1, 0.95, 0.0, True), (0.9, 0.8, 0.0, True), (0.82, 0.72, 0.0, False), (0.82, 0.5, 0.58, False), (0.90, 0.55, 0.0, False), (0.81, 0.9, 0.9, False)], "s double, f double, o double, b boolean")
    assert [r[0] for r in rows.select(integrate.should_merge(F.col("s"), F.col("f"), F.col("o"), F.col("b"))).collect()] == [True, False, True, True, True, False]


def test_graph_of_a_book(spark):
    body = "静息电位是指细胞安静时膜两侧的电位差，是神经与肌肉活动的基础。" * 6 + "动作电位是指可兴奋细胞受刺激后膜电位的快速波动，临床上用于诊断。" * 6 + "稳态包括体温和血压的相对稳定，反射是神经调节的基本方式。" * 6
    chapters = spark.createDataFrame([("b1", 1, "ch_001", "第一章 电位", 1, 5, body, len(body)), ("b1", 2, "ch_002", "第二章 短", 6, 6, "太短", 2)], schemas.CHAPTERS)
    books = spark.createDataFrame([("b1", "生理学")], "textbook_id string, title string")
    nodes, edges = extract.build_graphs(chapters, books)
    got = nodes.orderBy("node_ord").collect()
    names = [n.name for n in got]
    assert {"静息电位", "动作电位"} <= set(names) and {n.chapter_id for n in got} == {"ch_001"}
    assert not any(a != b and a in b for a in names for b in names)
    ids = {n.id for n in got}
    kept = edges.collect()
    assert kept and all(e.source in ids and e.target in ids and e.source != e.target for e in kept)
    assert len({(e.source, e.target, e.relation_type) for e in kept}) == len(kept)


def test_pdf_blocks(spark):
    body = "机体的功能活动受到神经和体液的共同调节，这一点十分清楚。" * 30
    rows = [("b", 1, 100.0, 1, 0.0, 1.0, 9.0, 2.0, "页眉"), ("b", 1, 100.0, 2, 0.0, 10.0, 9.0, 20.0, "第一章 稳态"), ("b", 1, 100.0, 3, 0.0, 21.0, 9.0, 30.0, body), ("b", 2, 100.0, 1, 0.0, 10.0, 9.0, 20.0, "图 1 示意"), ("b", 2, 100.0, 2, 0.0, 21.0, 9.0, 30.0, body), ("b", 3, 100.0, 1, 0.0, 10.0, 9.0, 20.0, "第二章\n反射"), ("b", 3, 100.0, 2, 0.0, 21.0, 9.0, 30.0, body)]
    got = readers.parse_pdf_blocks(spark.createDataFrame(rows, schemas.PDF_BLOCKS), spark.createDataFrame([("b", 3)], "textbook_id string, total_pages int")).orderBy("chapter_ord").collect()
    assert [(c.chapter_id, c.title, c.page_start, c.page_end) for c in got] == [("ch_001", "第一章 稳态", 1, 2), ("ch_002", "第二章 反射", 3, 3)]
    assert "页眉" not in got[0].content and "示意" not in got[0].content


def office(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def test_readers(spark, tmp_path):
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>第一章 稳态</w:t></w:r></w:p><w:p><w:r><w:t>正文一些内容。</w:t></w:r></w:p></w:body></w:document>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    excel = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="表" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>血压</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>120</v></c></row></sheetData></worksheet>',
    }
    files = {"a.md": "前言内容在此\n# 第一章\n正文内容一\n# 空\n# 第二章\n正文内容二".encode(), "b.docx": bytes(office({"word/document.xml": word})), "c.xlsx": bytes(office(excel)), "d.docx": b"broken", "e.zip": b"x"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    books, chapters = readers.read_books(spark, str(tmp_path))
    status = {r.filename: (r.status, r.error is None) for r in books.collect()}
    assert status == {"a.md": ("已完成", True), "b.docx": ("已完成", True), "c.xlsx": ("已完成", True), "d.docx": ("失败", False), "e.zip": ("失败", False)}
    got = {(r.filename, c.title, c.content) for r in books.collect() for c in r.chapters}
    assert got == {("a.md", "未命名章节", "前言内容在此"), ("a.md", "第一章", "正文内容一"), ("a.md", "第二章", "正文内容二"), ("b.docx", "第一章 稳态", "正文一些内容。"), ("c.xlsx", "Excel 数据表 1", "# 表\n血压 120")}
    store = Store(spark, str(tmp_path / "store"))
    store.upsert("books", books)
    store.upsert("books", books.limit(2))
    assert store.read("books").count() == 5 and store.read("nodes").count() == 0
    gone = books.first().textbook_id
    assert store.delete_book(gone) and not store.delete_book("none") and store.get("books", gone).count() == 0


def test_chat_tail(spark):
    chat = spark.range(300).select(F.col("id").alias("seq"), F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))
    assert sorted(r.seq for r in chat_tail(chat).collect()) == list(range(100, 300))


def test_retrieval_on_demo(spark):
    books, chapters = readers.demo_books(spark)
    index = rag.index_books(books, chapters)
    q = spark.createDataFrame([(1, "什么是静息电位", 2), (2, "完全无关xyz", 1), (3, None, 1)], schemas.QUERIES)
    got = {r.qid: r for r in index.answer(q).collect()}
    assert "静息电位" in got[1].answer and got[1].citations[0].chapter == "第一章 细胞的电活动"
    assert got[3].answer == rag.NOT_FOUND and index.status().first().chunk_count == 3
    questions = rag.benchmark_questions(chapters, books)
    assert rag.hit_rate(index.retrieve(questions, 3), questions).first().hit_rate == 1.0


def test_neighbourhood_exact_follows_edge_order(spark):
    nodes = nodes_of(spark, [("A", "x", "", 0.5), ("A", "y", "", 0.5), ("A", "z", "", 0.5)]).withColumn("ord", F.col("node_ord"))
    edges = spark.createDataFrame([(1, "n1", "n2"), (2, "n2", "n3")], "ord int, source string, target string")
    assert {r.id for r in graphview.neighbourhood(nodes, edges, "x").collect()} == {"n1", "n2"}
    assert {r.id for r in graphview.neighbourhood(nodes, edges, "x", exact=True).collect()} == {"n1", "n2", "n3"}


def test_streams(spark, tmp_path):
    from quire.streaming import uploads

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("第一章 稳态\n正文内容在这里")
    store = Store(spark, str(tmp_path / "store"))
    uploads.ingest(uploads.upload_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination()
    assert [c.title for c in store.read("books").first().chapters] == ["第一章 稳态"]
    assert segment.chunks(spark.createDataFrame([(1, "abc def")], "doc_id long, text string"), ["doc_id"], "text").first().text == "abc def"
