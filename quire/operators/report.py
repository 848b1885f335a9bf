"""Reports over books, graphs and integration: counts, histograms, chosen cases, and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import collapse, strip, thousands
from quire.functions.titles import chapter_number

#: Concepts that a report shows first, and its limits.
PREFERRED = ("感染", "抗原", "受体", "抗体", "炎症")
CASES, TOP_NODES, TOP_MERGES, CHAPTER_NODES, CUT = 5, 30, 30, 20, 180
LISTED = {"chapters": 12, "decisions": 20, "results": 8}  # rows of the lists that a client shows
EMPTY_CHAPTER = "本章未保留独立核心节点，相关内容可能已并入跨教材同名或近义概念。"


def backend_label(c: Column) -> Column:
    return F.when(c == "tfidf", F.lit("TF-IDF 字符 n-gram + BM25 + RapidFuzz 名称约束")).otherwise(c)


def graph_sizes(books: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """books with their graphs' nodes and edges, 0 without a graph."""
    n = nodes.groupBy("textbook_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("textbook_id").agg(F.count("*").alias("edges"))
    return books.join(n, "textbook_id", "left").join(e, "textbook_id", "left").na.fill(0, ["nodes", "edges"])


def chapter_histogram(nodes: DataFrame) -> DataFrame:
    """(textbook_id, chapter, n, rank): nodes by chapter, most first, ties by first seen."""
    name = F.coalesce(F.nullif("chapter", F.lit("")), F.lit("未标注章节"))
    rows = nodes.groupBy("textbook_id", name.alias("chapter")).agg(F.count("*").alias("n"), F.min("node_ord").alias("first"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("textbook_id").orderBy(F.desc("n"), "first"))).drop("first")


def action_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(F.coalesce("action", F.lit("unknown")).alias("action")).agg(F.count("*").alias("n"))


def with_results(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """decisions with title: the result node's name, else its id, else the decision's."""
    names = nodes.select(F.col("id").alias("result_node"), F.col("name").alias("result_name"))
    return decisions.join(names, "result_node", "left").withColumn("title", F.coalesce("result_name", "result_node", "decision_id"))


def case_decisions(decisions: DataFrame, nodes: DataFrame, preferred: tuple[str, ...] = PREFERRED, most: int = CASES) -> DataFrame:
    """The merges a report tells of: the first of each preferred concept, then the largest."""
    rows = with_results(decisions.where("action = 'merge'"), nodes)
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col("result_name"))
    first = F.row_number().over(W.partitionBy("result_name").orderBy("decision_ord"))
    rows = rows.withColumn("__p", F.when((F.coalesce(place, F.lit(0)) > 0) & (first == 1), place).otherwise(1 << 30))
    rows = rows.orderBy("__p", F.desc(F.size("affected_nodes")), F.desc("confidence"), "decision_id").limit(most)
    n = F.row_number().over(W.orderBy("__p", F.desc(F.size("affected_nodes")), F.desc("confidence"), "decision_id"))
    return rows.withColumn("case", n).drop("__p", "result_name")


def top_nodes(nodes: DataFrame, by: list[str], most: int = TOP_NODES) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), F.coalesce("name", F.lit(""))))
    return nodes.withColumn("rank", rank).where(F.col("rank") <= most)


def top_merges(decisions: DataFrame, most: int = TOP_MERGES) -> DataFrame:
    return decisions.where("action = 'merge'").orderBy(F.desc("confidence"), "decision_id").limit(most)


def listed_chapters(chapters: DataFrame, most: int = LISTED["chapters"]) -> DataFrame:
    """The chapters that a list shows of each book: by chapter number, then page, then title."""
    order = W.partitionBy("textbook_id").orderBy(chapter_number(F.col("title")), "page_start", "title")
    return chapters.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def listed_decisions(decisions: DataFrame, most: int = LISTED["decisions"]) -> DataFrame:
    return decisions.orderBy("decision_ord").limit(most)


def listed_results(results: DataFrame, most: int = LISTED["results"]) -> DataFrame:
    """The first rows of a benchmark's results (qid, ...)."""
    return results.orderBy("qid").limit(most)


def book_summary(books: DataFrame, chapters: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(textbook_id, part, line, text): the summary of each book's graph as Markdown lines, in order of part and line."""
    sizes = export_summary(books, chapters, nodes, edges)
    heads = [F.format_string("# %s 知识图谱摘要", "title"), F.format_string("- 章节数：%d", "chapters"), F.format_string("- 知识点数：%d", "nodes"), F.format_string("- 关系数：%d", "edges"), F.lit("## 教材章节")]
    first = sizes.select("textbook_id", F.lit(0).alias("part"), F.posexplode(F.array(*heads)).alias("line", "text"))
    chapter = F.format_string("- %s（第 %d–%d 页，%d 字）", "title", "page_start", "page_end", "char_count")
    second = chapters.select("textbook_id", F.lit(1).alias("part"), F.col("chapter_ord").alias("line"), chapter.alias("text"))
    third = books.select("textbook_id", F.lit(2).alias("part"), F.lit(0).alias("line"), F.lit("## 章节节点分布").alias("text"))
    counts = chapter_histogram(nodes).select("textbook_id", F.lit(2).alias("part"), F.col("rank").alias("line"), F.format_string("- %s：%d 个节点", "chapter", "n").alias("text"))
    fourth = books.select("textbook_id", F.lit(3).alias("part"), F.lit(0).alias("line"), F.lit("## 重要知识点示例").alias("text"))
    best = top_nodes(nodes, ["textbook_id"]).select("textbook_id", F.lit(3).alias("part"), F.col("rank").alias("line"), F.format_string("- %s（%s，%s，第 %d 页）", "name", "chapter", "category", "page").alias("text"))
    return first.unionByName(second).unionByName(third).unionByName(counts).unionByName(fourth).unionByName(best)


def decision_summary(decisions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line, text): the decisions' counts and surest merges as Markdown lines."""
    n = decisions.agg(F.count("*").alias("all"), *(F.count_if(F.col("action") == a).alias(a) for a in ("merge", "keep", "remove")))
    n = n.crossJoin(nodes.agg(F.count("*").alias("nodes"))).crossJoin(edges.agg(F.count("*").alias("edges")))  # a row each
    said = (("决策总数", "all"), ("合并", "merge"), ("保留", "keep"), ("删除", "remove"), ("整合后节点", "nodes"), ("整合后关系", "edges"))
    heads = n.select(F.posexplode(F.array(F.lit("# 跨教材整合决策摘要"), *(F.format_string(f"- {a}：%d", c) for a, c in said), F.lit("## 高置信度合并示例"))).alias("line", "text"))
    text = F.format_string("- %s：置信度 %.2f，结果节点 %s，来源 %s", "decision_id", "confidence", "result_node", F.array_join(F.slice("affected_nodes", 1, 5), "、"))
    place = F.row_number().over(W.orderBy(F.desc("confidence"), "decision_id"))
    return heads.unionByName(top_merges(decisions).select((place + 100).alias("line"), text.alias("text")))


def export_summary(books: DataFrame, chapters: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(textbook_id, title, chapters, nodes, edges) of each book."""
    c = chapters.groupBy("textbook_id").agg(F.count("*").alias("chapters"))
    rows = graph_sizes(books, nodes, edges).join(c, "textbook_id", "left").na.fill(0, ["chapters"])
    return rows.select("textbook_id", "title", "chapters", "nodes", "edges")


def export_books(books: DataFrame) -> DataFrame:
    """books with their chapters' content blanked."""
    return books.withColumn("chapters", F.transform("chapters", lambda c: c.withField("content", F.lit(""))))


def refined_book(books: DataFrame, chapters: DataFrame, merged: DataFrame) -> DataFrame:
    """(book_ord, chapter_ord, line, text): the integrated concepts by book and chapter, as Markdown lines."""
    at = books.select("textbook_id", "book_ord", F.col("title").alias("book")).join(chapters.select("textbook_id", "chapter_ord", F.col("title").alias("chapter")), "textbook_id")
    best = top_nodes(merged, ["textbook_title", "chapter"], CHAPTER_NODES).select(F.col("textbook_title").alias("book"), "chapter", "rank", "name", "category", "page", "definition")
    flat = strip(collapse(F.coalesce("definition", F.lit(""))))
    short = F.when(F.length(flat) > CUT, F.concat(F.left(flat, F.lit(CUT)), F.lit("..."))).otherwise(flat)
    line = F.format_string("- **%s**（%s，第 %d 页）：%s", F.col("name"), F.col("category"), F.col("page"), short)
    rows = at.join(best, ["book", "chapter"], "left").select("book_ord", "chapter_ord", F.coalesce("rank", F.lit(1)).alias("line"), F.coalesce(line, F.lit(EMPTY_CHAPTER)).alias("text"))
    heads = at.select("book_ord", "chapter_ord", F.lit(0).alias("line"), F.concat(F.lit("### "), "chapter").alias("text"))
    titles = books.select("book_ord", F.lit(0).alias("chapter_ord"), F.lit(0).alias("line"), F.concat(F.lit("## "), "title").alias("text"))
    return titles.unionByName(heads).unionByName(rows)


def markdown(books: DataFrame, chapters: DataFrame, nodes: DataFrame, edges: DataFrame, merged: DataFrame, decisions: DataFrame, stats: DataFrame, generated: str) -> str:
    """The integration report. Only aggregates and a few cases come to the driver, a line per book at most."""
    s = stats.withColumn("label", backend_label(F.col("embedding_backend"))).first()
    n = lambda v: f"{v:,}"
    fits = "满足不超过 30% 的约束" if s.compression_ratio <= 30 and not s.target_exceeded else "超过 30%，需要继续压缩"
    out = ["# 教材知识整合报告", "", f"> 基于 {s.original_books} 本教材的当前数据生成。生成时间：{generated}", "", "## 1. 整合概览", ""]
    out += [f"- 原始教材数量：{n(s.original_books)}", f"- 原始总字数：{n(s.original_chars)}", f"- 整合后精华字数：{n(s.integrated_chars)}", f"- 30% 目标字数：{n(s.target_chars)}", f"- 压缩比：{s.compression_ratio}%（{fits}）", f"- 向量/对齐后端：{s.label}", ""]
    out += ["| 教材 | 章节数 | 原始字数 | 单书节点数 | 单书关系数 |", "| --- | ---: | ---: | ---: | ---: |"]
    rows = export_summary(books, chapters, nodes, edges).join(books.select("textbook_id", "total_chars", "book_ord"), "textbook_id").orderBy("book_ord")
    line = F.format_string("| %s | %d | %s | %s | %s |", F.col("title"), F.col("chapters"), *(thousands(F.col(c)) for c in ("total_chars", "nodes", "edges")))
    out += [r.l for r in rows.select(line.alias("l")).toLocalIterator()]
    out += ["", "## 2. 整合决策摘要", "", f"- 整合决策总数：{n(s.merge_count + s.keep_count + s.remove_count)} 项", f"- 合并：{n(s.merge_count)} 项", f"- 保留：{n(s.keep_count)} 项", f"- 删除：{n(s.remove_count)} 项"]
    out += [f"- 整合前节点数：{n(s.nodes_before)}", f"- 整合后节点数：{n(s.nodes_after)}", f"- 整合前关系数：{n(s.edges_before)}", f"- 整合后关系数：{n(s.edges_after)}", "", "## 3. 重点整合案例", ""]
    cases = case_decisions(decisions, merged).orderBy("case").collect()
    for d in cases:
        out += [f"### 案例：{d.title}", f"- 决策类型：{d.action}", f"- 影响范围：{len(d.affected_nodes)} 个节点", f"- 结果节点：{d.result_node or '无'}", f"- 置信度：{d.confidence:.2f}", f"- 理由：{d.reason}", ""]
    if not cases:
        out.append("当前没有合并案例。")
    return "\n".join(out)
