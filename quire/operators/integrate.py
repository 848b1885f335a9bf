"""Integrating graphs across books: clustering equal and similar concepts, merging nodes, remapping edges, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.terms import indel_ratio, mergeable_name
from quire.functions.text import char_overlap, normalize_key
from quire.operators import vectors
from quire.operators.components import connected, cut, numbered

#: The neighbours that are looked at, and the thresholds of the merge rule.
NEIGHBOURS, THRESHOLD, SURE, TIGHT = 10, 0.82, 0.94, 0.90
FUZZY, OVERLAP, LOOSE = 0.72, 0.58, 0.55


def concatenated(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All graphs' nodes with ord and edges with ord, in order of graph_ord."""
    return (
        numbered(nodes, "ord", "graph_ord", "textbook_id", "node_ord"),
        numbered(edges, "ord", "graph_ord", "textbook_id", "edge_ord"),
    )


def exact_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): each node and the first with the same mergeable key: a star per name, not all its pairs."""
    keyed = nodes.select("ord", normalize_key(F.col("name")).alias("key")).where(mergeable_name(F.col("key")))
    first = keyed.groupBy("key").agg(F.min("ord").alias("a"))
    return keyed.join(first, "key").where("ord <> a").select("a", F.col("ord").alias("b"))


def neighbour_pairs(nodes: DataFrame, features: int = vectors.FEATURES, k: int = NEIGHBOURS) -> DataFrame:
    """(a, b, cosine), a < b, for b among a's k nearest by character TF-IDF of name and definition.

    Equal texts are compared once, as a class named by its first node: a node's k nearest lie in the k + 1 nearest classes
    of its own, nearness of ties told by their first nodes, and are among the first k + 1 nodes of each.
    """
    texts = nodes.select("ord", F.coalesce(F.concat("name", F.lit("。"), F.coalesce("definition", F.lit(""))), F.lit("")).alias("text"))
    # Rows of one ord are one text.
    whole = texts.groupBy("ord").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    whole = cut(whole.withColumn("digest", F.sha2("text", 256)))
    classes = cut(whole.groupBy("digest").agg(F.min("ord").alias("class"), F.count("*").alias("copies"), F.min("text").alias("text")))
    members = whole.select("ord", "digest").join(classes.select("digest", "class"), "digest").select("ord", "class")
    terms = vectors.frequent(vectors.term_totals(classes, "text", "copies"), texts.count(), features)
    near = vectors.top_in_blocks(classes, "class", "text", terms, k + 1)
    turn = F.row_number().over(W.partitionBy("class").orderBy("ord"))
    first = members.withColumn("turn", turn).where(F.col("turn") <= k + 1).select(F.col("class").alias("b"), F.col("ord").alias("other"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("near"), "other"))
    ranked = near.join(first, "b").withColumn("rank", rank).where(F.col("rank") <= k + 1)
    lists = ranked.groupBy(F.col("a").alias("class")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("other").alias("b"), "cosine"))).alias("near"))
    own = members.join(lists, "class").select(F.col("ord").alias("a"), F.explode(F.slice(F.filter("near", lambda x: x["b"] != F.col("ord")), 1, k)).alias("x"))
    return own.select("a", "x.b", "x.cosine").where("a < b")


def should_merge(semantic: Column, fuzzy: Column, overlap: Column, same_book: Column, threshold: float = THRESHOLD) -> Column:
    close = ((semantic >= threshold) & ((fuzzy >= FUZZY) | (overlap >= OVERLAP))) | ((semantic >= TIGHT) & (fuzzy >= LOOSE))
    return (fuzzy >= SURE) | (~same_book & close)


def similar_pairs(nodes: DataFrame, threshold: float = THRESHOLD, features: int = vectors.FEATURES) -> DataFrame:
    """(a, b): neighbours that the merge rule joins."""
    side = nodes.select("ord", "textbook_id", normalize_key(F.col("name")).alias("key")).where(mergeable_name(F.col("key")))
    left, right = (side.select(*(F.col(c).alias(f"{c}_{x}") for c in side.columns)) for x in "ab")
    rows = neighbour_pairs(nodes, features).join(left, F.col("a") == F.col("ord_a")).join(right, F.col("b") == F.col("ord_b"))
    rows = rows.withColumn("fuzzy", indel_ratio("key_a", "key_b")).withColumn("overlap", char_overlap(F.col("key_a"), F.col("key_b")))
    same = F.col("textbook_id_a") == F.col("textbook_id_b")
    return rows.where(should_merge(F.col("cosine"), F.col("fuzzy"), F.col("overlap"), same, threshold)).select("a", "b")


def clusters(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, cluster, size): clusters numbered from 1 by falling size, then by their first node."""
    comp = connected(nodes.select(F.col("ord").alias("node")), pairs)
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    ranked = numbered(sizes.withColumn("falling", -F.col("size")), "cluster", "falling", "component").withColumn("cluster", F.col("cluster").cast("int"))
    return comp.join(ranked, "component").select(F.col("node").alias("ord"), "cluster", "size")


def _in_order(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", value.alias("v")))), lambda x: x["v"])


def merged_nodes(nodes: DataFrame, clustered: DataFrame) -> DataFrame:
    """One node per cluster: the fullest definition, the other names as aliases, the sources of the first five."""
    rows = nodes.join(clustered, "ord")
    best = F.max_by(F.struct("id", "name", "definition", "category", "chapter", "page", "textbook_id", "textbook_title"), F.struct(F.length("definition"), "importance", -F.col("ord")))
    g = rows.groupBy("cluster", "size").agg(best.alias("b"), F.collect_set("name").alias("names"), F.collect_set("textbook_title").alias("titles"), F.max("importance").alias("importance"), _in_order(F.col("source")).alias("sources"), _in_order(F.col("id")).alias("ids"), F.count_distinct(normalize_key(F.col("name"))).alias("keys"), F.first("aliases").alias("own"), F.first("source").alias("own_source"))
    g = g.withColumn("aliases", F.array_sort(F.array_except("names", F.array("b.name")))).withColumn("books", F.size("titles"))
    note = F.when(F.size("aliases") > 0, F.concat(F.lit("（同义/近义表述："), F.array_join(F.slice("aliases", 1, 6), "、"), F.lit("。）"))).otherwise("")
    many = F.col("size") > 1
    return g.select(
        "cluster", "size", "ids", "keys", F.array_sort("names").alias("names"), F.array_sort("titles").alias("titles"),
        F.when(many, F.format_string("merged_node_%03d", "cluster")).otherwise(F.col("b.id")).alias("id"), F.col("b.name").alias("name"),
        F.when(many, F.left(F.concat("b.definition", note), F.lit(500))).otherwise(F.col("b.definition")).alias("definition"),
        F.col("b.category").alias("category"), F.col("b.chapter").alias("chapter"), F.col("b.page").alias("page"), F.col("b.textbook_id").alias("textbook_id"), F.col("b.textbook_title").alias("textbook_title"),
        F.when(many, F.array_join(F.slice("sources", 1, 5), "；")).otherwise(F.col("own_source")).alias("source"),
        F.when(many, F.col("books")).otherwise(1).alias("frequency"), F.when(many, F.col("aliases")).otherwise(F.col("own")).alias("aliases"),
        F.when(many, F.least(F.lit(1.0), F.col("importance") + 0.08 * (F.col("books") - 1))).otherwise(F.col("importance")).alias("importance"),
    )


def decisions(merged: DataFrame) -> DataFrame:
    """DECISIONS of merged_nodes(): a merge for clusters of several nodes, a keep for the others."""
    many = F.col("size") > 1
    merge = F.format_string("%d 个节点（%s）在名称、定义或语义向量上高度相似，来自 %s；保留“%s”作为最完整表述，并把其他表述写入 aliases。", F.col("size"), F.array_join("names", "、"), F.array_join("titles", "、"), F.col("name"))
    keep = F.format_string("“%s”在当前教材集合中没有发现高相似重复概念，保留作为互补知识点。", F.col("name"))
    sure = F.least(F.lit(0.98), 0.82 + F.when(F.col("keys") == 1, 0.08).otherwise(0.0) + 0.02 * F.col("size"))
    action = F.when(many, F.lit("merge")).otherwise("keep")
    return merged.select(
        F.col("cluster").cast("int").alias("decision_ord"), F.concat(action, F.format_string("_%03d", "cluster")).alias("decision_id"), action.alias("action"), F.col("ids").alias("affected_nodes"),
        F.col("id").alias("result_node"), F.when(many, merge).otherwise(keep).alias("reason"), F.when(many, sure).otherwise(F.lit(0.78)).alias("confidence"), F.lit(False).alias("teacher_locked"),
    )


def remapped_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges between merged nodes: the first of each (source, target, relation), without self loops."""
    ids = merged.select(F.explode("ids").alias("old"), F.col("id").alias("new"))
    rows = edges.join(ids.select(F.col("old").alias("source"), F.col("new").alias("s")), "source").join(ids.select(F.col("old").alias("target"), F.col("new").alias("t")), "target").where("s <> t")
    n = F.row_number().over(W.partitionBy("s", "t", "relation_type").orderBy("ord"))
    return rows.withColumn("n", n).where("n = 1").select("ord", F.col("s").alias("source"), F.col("t").alias("target"), "relation_type", "description", "weight")


def statistics(books: DataFrame, nodes: DataFrame, edges: DataFrame, merged: DataFrame, kept: DataFrame, made: DataFrame) -> DataFrame:
    """One row of integration statistics."""
    one = lambda df, *a: df.agg(*a)
    row = one(books, F.count("*").alias("original_books"), F.coalesce(F.sum("total_chars"), F.lit(0)).alias("original_chars"))
    parts = [
        one(nodes, F.count("*").alias("nodes_before")), one(edges, F.count("*").alias("edges_before")),
        one(merged, F.count("*").alias("nodes_after"), F.coalesce(F.sum(F.length("definition")), F.lit(0)).alias("node_chars")),
        one(kept, F.count("*").alias("edges_after"), F.coalesce(F.sum(F.length("description")), F.lit(0)).alias("edge_chars")),
        one(made, *(F.count_if(F.col("action") == a).alias(f"{a}_count") for a in ("merge", "keep", "remove"))),
    ]
    for p in parts:  # every side is one row
        row = row.crossJoin(p)
    chars = F.col("node_chars") + F.col("edge_chars")
    target = F.when(F.col("original_chars") > 0, F.floor(F.col("original_chars") * 0.30)).otherwise(chars)
    return row.select(
        "original_books", "original_chars", chars.alias("integrated_chars"), chars.alias("raw_integrated_chars"),
        F.when(F.col("original_chars") > 0, F.round(chars / F.col("original_chars") * 100, 2)).otherwise(0.0).alias("compression_ratio"), F.lit(30).alias("target_ratio"), target.alias("target_chars"),
        ((F.col("original_chars") > 0) & (chars > target)).alias("target_exceeded"), "nodes_before", "nodes_after", "edges_before", "edges_after", "merge_count", "keep_count", "remove_count", F.lit("tfidf").alias("embedding_backend"),
    )


@dataclass
class Integrated:
    nodes: DataFrame
    edges: DataFrame
    decisions: DataFrame
    stats: DataFrame


def integrate(books: DataFrame, nodes: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> Integrated:
    """The integrated graph of all books' graphs."""
    nodes, edges = concatenated(nodes, edges)
    groups = clusters(nodes, exact_pairs(nodes).unionByName(similar_pairs(nodes, threshold)))
    merged = merged_nodes(nodes, groups)
    kept, made = remapped_edges(edges, merged), decisions(merged)
    return Integrated(merged, kept, made, statistics(books, nodes, edges, merged, kept, made))
