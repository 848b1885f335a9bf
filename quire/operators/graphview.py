"""Queries over a graph that a client draws: degree, matching, scores, the visible part, matrix and chapter tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.titles import chapter_number

#: How many nodes a view shows at each density, and edges for each node.
LIMITS = {"calm": {"force": 70, "tree": 48, "matrix": 28, "edges": 1.2}, "balanced": {"force": 135, "tree": 82, "matrix": 40, "edges": 1.8}, "rich": {"force": 230, "tree": 120, "matrix": 54, "edges": 2.4}}
UNKNOWN_CHAPTER = "未识别章节"
EXACT_EDGES = 100_000  # that one row may gather


def natural_key(c: Column) -> Column:
    """A sort key by which numbers inside names count as numbers (code point order otherwise, case apart)."""
    padded = F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("\\d+|\\D+"), F.lit(0)), lambda p: F.when(p.rlike("^\\d+$"), F.lpad(p, 20, "0")).otherwise(p))
    return F.array_join(padded, "")


def shorten(c: Column, most: int = 12) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\ufffd\\x08]", ""))
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def palette_index(c: Column, size: int) -> Column:
    """|h| mod size of the 32-bit rolling hash 31 * h + code, seed 7."""
    step = lambda h, ch: F.pmod(h * 31 + F.ascii(ch) + 2147483648, F.lit(4294967296)) - 2147483648
    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.pmod(F.abs(F.aggregate(chars, F.lit(7).cast("long"), step)), F.lit(size)).cast("int")


def file_size(c: Column) -> Column:
    unit = F.when(c >= 1 << 20, F.lit("MB")).when(c >= 1 << 10, F.lit("KB")).otherwise("B")
    value = F.when(c >= 1 << 20, c / (1 << 20)).when(c >= 1 << 10, c / (1 << 10)).otherwise(c.cast("double"))
    return F.when(c < 1 << 10, F.concat(c.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_number(value, 1), F.lit(" "), unit))


def in_source(nodes: DataFrame, edges: DataFrame, source: str = "all") -> tuple[DataFrame, DataFrame]:
    """Nodes of a book (or all), and the edges with both ends among them."""
    kept = nodes if source == "all" else nodes.where(F.col("textbook_id") == source)
    ids = kept.select(F.col("id").alias("source")).distinct()
    return kept, edges.join(ids, "source", "left_semi").join(ids.withColumnRenamed("source", "target"), "target", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree)."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def matches(query: str) -> Column:
    text = F.lower(F.concat_ws(" ", "name", F.coalesce("definition", F.lit("")), F.coalesce("chapter", F.lit("")), F.coalesce("category", F.lit("")), F.concat_ws(" ", "aliases")))
    return F.contains(text, F.lit(query.lower())) if query else F.lit(False)


def score(query: str = "") -> Column:
    """10000 for a match, and frequency, importance, degree and the definition's length."""
    base = F.coalesce(F.nullif("frequency", F.lit(0)), F.lit(1)) * 160 + F.coalesce(F.nullif("importance", F.lit(0.0)), F.lit(0.5)) * 120
    return F.when(matches(query), 10000).otherwise(0) + base + F.col("degree") * 18 + F.least(F.lit(40.0), F.length(F.coalesce("definition", F.lit(""))) / 25)


def neighbourhood(nodes: DataFrame, edges: DataFrame, query: str, exact: bool = False) -> DataFrame:
    """(id) of the nodes that match and their neighbours.

    By default a one-hop semi-join. exact follows one ordered pass over the edges, in which a later edge sees what
    earlier ones added: a fold, so it gathers the edges of the shown book into one row; meant for graphs on a screen, and
    refused for more than EXACT_EDGES edges.
    """
    found = nodes.where(matches(query)).select("id")
    if not exact:
        out = edges.join(found.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
        back = edges.join(found.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
        return found.union(out).union(back).distinct()
    if edges.limit(EXACT_EDGES + 1).count() > EXACT_EDGES:
        raise ValueError(f"more than {EXACT_EDGES} edges: take the semi-join (exact=False)")
    listed = edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source", "target"))), lambda e: F.struct(e["source"].alias("s"), e["target"].alias("t"))).alias("e"))
    start = found.agg(F.collect_set("id").alias("m"))

    def step(acc: Column, e: Column) -> Column:
        one = F.when(F.array_contains(acc, e["s"]), F.array_union(acc, F.array(e["t"]))).otherwise(acc)
        return F.when(F.array_contains(one, e["t"]), F.array_union(one, F.array(e["s"]))).otherwise(one)

    return start.crossJoin(listed).select(F.explode(F.aggregate("e", F.col("m"), step)).alias("id"))  # one row each


def view_order() -> list[Column]:
    return [natural_key(F.coalesce("textbook_title", "textbook_id")), chapter_number(F.coalesce("chapter", F.lit(""))), natural_key(F.col("chapter")), F.coalesce("page", F.lit(0)), natural_key(F.col("name"))]


def visible_graph(nodes: DataFrame, edges: DataFrame, query: str = "", source: str = "all", density: str = "balanced", view: str = "force", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes with degree, score and place; edges with place): the best nodes in view order, and their heaviest edges."""
    limit = LIMITS[density][view]
    own, inner = in_source(nodes, edges, source)
    scored = own.join(degrees(inner), "id", "left").na.fill(0, ["degree"]).withColumn("score", score(query))
    if query:
        scored = scored.join(neighbourhood(own, inner, query, exact), "id", "left_semi")
    shown = scored.orderBy(F.desc("score"), "ord").limit(limit)
    shown = shown.withColumn("place", F.row_number().over(W.orderBy(*view_order(), "ord")))
    most = limit * limit if view == "matrix" else max(60, round(limit * LIMITS[density]["edges"]))
    ids = shown.select(F.col("id").alias("source"))
    kept = edges.join(F.broadcast(ids), "source", "left_semi").join(F.broadcast(ids.withColumnRenamed("source", "target")), "target", "left_semi")  # at most limit rows
    kept = kept.orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), "ord").limit(most)
    return shown, kept.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), "ord")))


def relation_matrix(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """(x, y, relation_type): source and target places of the edges between shown nodes, from 0."""
    at = shown.select("id", (F.col("place") - 1).alias("p"))
    return edges.join(at.select(F.col("id").alias("source"), F.col("p").alias("x")), "source").join(at.select(F.col("id").alias("target"), F.col("p").alias("y")), "target").select("x", "y", "relation_type")


def source_options(nodes: DataFrame) -> DataFrame:
    """(id, title, count) of the books in a graph, in natural order of titles."""
    ident = F.coalesce(F.nullif("textbook_id", F.lit("")), F.lit("unknown"))
    rows = nodes.groupBy(ident.alias("id")).agg(F.min_by(F.coalesce(F.nullif("textbook_title", F.lit("")), ident), "ord").alias("title"), F.count("*").alias("count"))
    return rows.orderBy(natural_key(F.col("title")))


def chapter_tree(nodes: DataFrame, books: DataFrame, chapters: DataFrame, source: str = "all") -> DataFrame:
    """(book, chapter, names): each book's chapters in order with their shown concepts; then books that only nodes name."""
    ids = nodes.select("textbook_id").distinct()
    own = books.join(ids, "textbook_id", "left_semi") if source == "all" else books.where(F.col("textbook_id") == source)
    named = nodes.withColumn("chapter", F.coalesce("chapter", F.lit(UNKNOWN_CHAPTER)))
    listed = named.groupBy("textbook_id", "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
    rows = own.select("textbook_id", F.col("title").alias("book")).join(chapters.select("textbook_id", F.col("title").alias("chapter"), "page_start"), "textbook_id")
    known = rows.join(listed, ["textbook_id", "chapter"], "left").select("book", "chapter", "page_start", "names")
    loose = listed.join(own, "textbook_id", "left_anti").join(nodes.groupBy("textbook_id").agg(F.min("textbook_title").alias("t")), "textbook_id")
    extra = loose.select(F.coalesce("t", "textbook_id", F.lit("未知教材")).alias("book"), "chapter", F.lit(0).alias("page_start"), "names")
    order = W.partitionBy("book").orderBy(chapter_number(F.col("chapter")), "page_start", natural_key(F.col("chapter")))
    return known.unionByName(extra).select("book", F.row_number().over(order).alias("n"), "chapter", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def node_details(nodes: DataFrame) -> DataFrame:
    """What a detail panel shows of a node."""
    return nodes.select("id", "name", "category", F.coalesce("frequency", F.lit(1)).alias("frequency"), F.round(F.coalesce("importance", F.lit(0.0)) * 100).cast("int").alias("importance_pct"), F.coalesce(F.nullif("source", F.lit("")), F.format_string("%s, %s, 第 %d 页", "textbook_title", "chapter", "page")).alias("source"))
