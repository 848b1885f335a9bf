"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import terms as T
from quire.functions import text as X
from quire.functions import titles as H
from quire.lexicon import LATIN
from quire.operators import extract, feedback, graphview, integrate, rag, report, segment, vectors
from quire.plans import sql as S
from quire.sources import readers, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Texts


@query(f"SELECT doc_id, length(c) AS n_clean, md5(c) AS digest FROM (SELECT doc_id, {S.clean_text('text')} AS c FROM documents)")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every document, as length and digest."""
    c = table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("c"))
    return c.select("doc_id", F.length("c").cast("long").alias("n_clean"), F.md5(F.encode("c", "UTF-8")).alias("digest"))


@query(f"SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: {S.noise('x')})) AS n_noise FROM (SELECT doc_id, list_transform({S.lines('text')}, lambda x: {S.clean_line('x')}) AS l FROM documents)")
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and noise lines of every document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", X.LINE_BREAK), X.clean_line).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(F.filter("l", lambda x: X.is_noise_line(x, True))).cast("long").alias("n_noise"))


@query(f"SELECT doc_id, len(s) AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS n_chars FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.split_sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


@query("SELECT doc_id, (len(list_filter(l, lambda x: regexp_matches(x, '(?:[.\\x{2026}·•\\-—_]\\s*){4,}'))) >= 4) AS toc FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def toc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that read as a table of contents (the oracle has the rule that applies to Latin text)."""
    return table(spark, sf_dir, "documents").select("doc_id", X.looks_like_toc_page(F.col("text")).alias("toc"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents) GROUP BY term")
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and corpus frequency of every token."""
    tf = vectors.counts(table(spark, sf_dir, "documents"), "doc_id", X.tokenize(F.col("text")))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"SELECT count(*) AS n, round(avg(len({S.tokens('text')})), 6) AS avgdl FROM documents")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: number of texts and mean length in tokens."""
    return rag.corpus_stats(table(spark, sf_dir, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT p_partkey, 'part_' || left(sha1(p_name), 12) AS id, {S.key('p_name')} AS name_key, regexp_replace(p_type, '[<>:\"/\\\\|?*]', '_', 'g') AS file FROM part")
def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, keys and file names."""
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", X.safe_id("part", F.col("p_name")).alias("id"), X.normalize_key(F.col("p_name")).alias("name_key"), X.file_name(F.col("p_type")).alias("file"))


# Segments and chunks


@query("SELECT doc_id, i::INTEGER AS chapter_ord, '自动分段 ' || i AS title, substr(text, ((i - 1) * 16000 + 1)::BIGINT, 16000) AS content FROM (SELECT doc_id, text, unnest(range(1, (length(text) + 15999) // 16000 + 1)) AS i FROM documents)")
def fixed_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of 16,000 characters."""
    return segment.fixed_split(table(spark, sf_dir, "documents"), "doc_id", "text")


_LAST = "coalesce(length(regexp_extract(substr(t, s + 1, 700), '(?s)^(.*[。；\\n])', 1)), 0)"
_END = f"CASE WHEN s + 700 >= n THEN n WHEN {_LAST} - 1 > 455 THEN s + {_LAST} ELSE s + 700 END"


@query(
    f"WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE length(text) > 0), w AS ("
    f"SELECT doc_id, t, n, s, {_END} AS e FROM (SELECT doc_id, t, n, 0::BIGINT AS s FROM d) "
    f"UNION ALL SELECT doc_id, t, n, s, {_END} AS e FROM (SELECT doc_id, t, n, greatest(0, e - 80)::BIGINT AS s FROM w WHERE e < n)) "
    'SELECT doc_id, s::INTEGER AS "start", e::INTEGER AS "end", md5(substr(t, s + 1, e - s)) AS digest FROM w'
)
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of every document."""
    rows = segment.chunks(table(spark, sf_dir, "documents"), ["doc_id"], "text", clean=False)
    return rows.select("doc_id", "start", "end", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(
    "WITH l AS (SELECT doc_id, i, lines[i] AS line, regexp_matches(lines[i], '^.{1,60}$') AS h FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)), "
    "g AS (SELECT doc_id, i, line, h, sum(h::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM l), "
    "s AS (SELECT doc_id, seg, coalesce(max(CASE WHEN h THEN line END), '未命名章节') AS title, string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY i) AS content, sum((NOT h)::INTEGER) AS k FROM g GROUP BY doc_id, seg) "
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg))::INTEGER AS chapter_ord, title, md5(content) AS digest FROM s WHERE k > 0"
)
def heading_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: documents cut at short lines, which stand for headings."""
    rows = segment.heading_segments(table(spark, sf_dir, "documents"), "doc_id", "text", markdown=False, pattern="^.{1,60}$")
    return rows.select("doc_id", F.col("chapter_ord").cast("int").alias("chapter_ord"), "title", F.md5(F.encode("content", "UTF-8")).alias("digest"))


# Retrieval: conversation turns as chunks, benchmark texts as questions


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"))
    return rows.select(X.safe_id("chunk", F.concat_ws(":", "conv_id", "turn")).alias("chunk_id"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("ord"), "text", name.alias("textbook_id"), name.alias("textbook"), F.col("role").alias("chapter"), F.col("turn").cast("int").alias("page"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


_BM25 = f"""
c AS (SELECT conv_id * 100000 + turn AS ord, text FROM conversations), q AS (SELECT item_id AS qid, text AS question FROM benchmark),
ct AS (SELECT ord, {S.tokens('text')} AS l FROM c), st AS (SELECT count(*) AS n, avg(len(l)) AS avgdl FROM ct),
p AS (SELECT ord, term, count(*) AS tf, max(dl) AS dl FROM (SELECT ord, len(l) AS dl, unnest(l) AS term FROM ct) GROUP BY ord, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({S.tokens('question')}) AS term FROM q) GROUP BY qid, term),
bm AS (SELECT qid, ord, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM qt JOIN p USING (term) JOIN df USING (term), st GROUP BY qid, ord)"""
_GRAMS = """flatten(list_transform(list_filter(string_split(regexp_replace(lower({x}), '[%s]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w:
 list_concat(list_transform(range(1, greatest(1, length(w) + 1) + 1), lambda i: substr(' ' || w || ' ', i::BIGINT, 2)),
 list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i::BIGINT, 3)), list_transform(range(1, length(w)), lambda i: substr(' ' || w || ' ', i::BIGINT, 4))))))""" % S.SPACE
_VEC = f"""
cg AS (SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest({_GRAMS.replace('{x}', 'text')}) AS term FROM c) GROUP BY ord, term),
voc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM c)) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM cg GROUP BY term ORDER BY total DESC, term LIMIT 16000)),
cw AS (SELECT ord, term, tf * idf AS w FROM cg JOIN voc USING (term)), cn AS (SELECT ord, sqrt(sum(w * w)) AS norm FROM cw GROUP BY ord),
qg AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({_GRAMS.replace('{x}', 'question')}) AS term FROM q) GROUP BY qid, term),
qw AS (SELECT qid, term, tf * idf AS w FROM qg JOIN voc USING (term)), qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qw GROUP BY qid),
cs AS (SELECT qid, ord, sum(qw.w * cw.w) / max(qn.norm * cn.norm) AS cosine FROM qw JOIN cw USING (term) JOIN cn USING (ord) JOIN qn USING (qid) GROUP BY qid, ord)"""
_TOP = "SELECT qid, rank::INTEGER AS rank, ord, round({s}, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round({s}, 9) DESC, ord DESC) AS rank FROM {t}) WHERE rank <= 5 AND {s} > 0"


@query(f"WITH {_BM25} {_TOP.format(s='bm25', t='bm')}")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's five best texts by BM25."""
    turns = _turns(spark, sf_dir)
    best = rag.top_by(rag.bm25(_questions(spark, sf_dir), rag.term_postings(turns), rag.corpus_stats(turns)), "bm25", 5)
    return best.select("qid", "rank", "ord", F.round("bm25", 6).alias("score"))


@query(f"WITH {_BM25}, {_VEC} {_TOP.format(s='cosine', t='cs')}")
def tfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's five best texts by character TF-IDF."""
    index = rag.Index.build(_turns(spark, sf_dir))
    return index.nearest(_questions(spark, sf_dir), 5).select("qid", "rank", "ord", F.round("cosine", 6).alias("score"))


_EXACT = f"ex AS (SELECT qid, ord, count(*) / max(nq)::DOUBLE AS exact FROM (SELECT qid, len(list_distinct({S.tokens('question')})) AS nq, unnest(list_distinct({S.tokens('question')})) AS term FROM q) JOIN p USING (term) GROUP BY qid, ord)"
_HYBRID = f"""{_BM25}, {_VEC}, {_EXACT},
al AS (SELECT coalesce(a.qid, ex.qid) AS qid, coalesce(a.ord, ex.ord) AS ord, coalesce(cosine, 0) AS v, coalesce(bm25, 0) AS b, coalesce(exact, 0) AS e FROM (SELECT coalesce(cs.qid, bm.qid) AS qid, coalesce(cs.ord, bm.ord) AS ord, cosine, bm25 FROM cs FULL JOIN bm ON cs.qid = bm.qid AND cs.ord = bm.ord) a FULL JOIN ex ON a.qid = ex.qid AND a.ord = ex.ord),
hy AS (SELECT qid, ord, 0.62 * CASE WHEN mv > 0 THEN v / mv ELSE v END + 0.28 * CASE WHEN mb > 0 THEN b / mb ELSE b END + 0.10 * e AS s FROM (SELECT *, max(v) OVER (PARTITION BY qid) AS mv, max(b) OVER (PARTITION BY qid) AS mb FROM al))"""


@query(f"WITH {_HYBRID} {_TOP.format(s='s', t='hy')}")
def hybrid_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's five best texts by the hybrid score."""
    found = rag.Index.build(_turns(spark, sf_dir)).retrieve(_questions(spark, sf_dir))
    return found.select("qid", "rank", "ord", F.round("score", 6).alias("score"))


@query()
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their citations."""
    a = rag.Index.build(_turns(spark, sf_dir)).answer(_questions(spark, sf_dir))
    return a.select("qid", "answer", F.size("citations").alias("n_citations"))


@query(
    f"WITH {_HYBRID}, tp AS (SELECT qid, ord FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, ord DESC) AS rank FROM hy) WHERE rank <= 3 AND s > 0), "
    "h AS (SELECT DISTINCT qid FROM tp JOIN conversations ON conv_id * 100000 + turn = ord WHERE role = 'user') SELECT (SELECT count(*) FROM q) AS questions, round((SELECT count(*) FROM h) / (SELECT count(*) FROM q)::DOUBLE, 3) AS hit_rate"
)
def retrieval_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of benchmark texts whose role citation is a user's turn."""
    found = rag.Index.build(_turns(spark, sf_dir)).retrieve(_questions(spark, sf_dir), 3)
    return rag.hit_rate(found, _questions(spark, sf_dir).withColumn("expected", F.lit("user")))


@query()
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed character vectors of the benchmark."""
    return vectors.hashed(table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "slot", F.round("w", 9).alias("w"))


def neighbours_sql(texts: str) -> str:
    """The pairs of texts (a query for ord and text) among each other's ten nearest."""
    return (
        f"WITH c AS ({texts}), cg AS (SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest({_GRAMS.replace('{x}', 'text')}) AS term FROM c) GROUP BY ord, term), "
        "voc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM c)) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM cg GROUP BY term ORDER BY total DESC, term LIMIT 16000)), "
        "cw AS (SELECT ord, term, tf * idf AS w FROM cg JOIN voc USING (term)), cn AS (SELECT ord, sqrt(sum(w * w)) AS norm FROM cw GROUP BY ord), "
        "cs AS (SELECT x.ord AS a, y.ord AS b, sum(x.w * y.w) / max(nx.norm * ny.norm) AS cosine FROM cw x JOIN cw y ON x.term = y.term AND x.ord <> y.ord JOIN cn nx ON nx.ord = x.ord JOIN cn ny ON ny.ord = y.ord GROUP BY x.ord, y.ord) "
        "SELECT a, b, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS r FROM cs) WHERE r <= 10 AND a < b"
    )


@query(neighbours_sql("SELECT item_id AS ord, text || '。' AS text FROM benchmark"))
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of benchmark texts among each other's ten nearest, in order."""
    nodes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("name"), F.lit("").alias("definition"))
    return integrate.neighbour_pairs(nodes).select("a", "b", F.round("cosine", 6).alias("cosine"))


# Integration: parts as concepts named by their type, brands as books


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("name"), F.col("p_name").alias("definition"), F.lit("核心概念").alias("category"),
        F.col("p_type").alias("chapter"), F.col("p_size").alias("page"), F.col("p_brand").alias("textbook_id"), F.col("p_brand").alias("textbook_title"), F.concat("p_brand", F.lit(" p."), F.col("p_size").cast("string")).alias("source"),
        F.lit(1).alias("frequency"), F.array().cast("array<string>").alias("aliases"), (F.pmod("p_partkey", F.lit(20)) / 20).alias("importance"),
    )


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part beside the next of its brand."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lead("p_partkey").over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("next")).where("next is not null")
    return rows.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("next").cast("string")).alias("target"), F.lit("parallel").alias("relation_type"), F.concat(F.lit("next of "), "p_brand").alias("description"), F.lit(0.45).alias("weight"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _concepts(spark, sf_dir)
    return integrate.merged_nodes(nodes, integrate.clusters(nodes, integrate.exact_pairs(nodes)))


_CLUSTERS = f"""n AS (SELECT p_partkey AS ord, p_type AS name, p_name AS definition, p_brand AS book, p_size AS page, (p_partkey % 20) / 20.0::DOUBLE AS importance, {S.key('p_type')} AS k FROM part),
k AS (SELECT k, min(ord) AS first, count(*) AS size FROM n GROUP BY k), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, first) AS cluster FROM k),
m AS (SELECT n.*, cluster, size, row_number() OVER (PARTITION BY cluster ORDER BY length(definition) DESC, importance DESC, ord) AS best, row_number() OVER (PARTITION BY cluster ORDER BY ord) AS nth FROM n JOIN r USING (k)),
g AS (SELECT cluster, size, max(CASE WHEN best = 1 THEN definition END) AS definition, max(CASE WHEN best = 1 THEN ord END) AS best_ord, max(CASE WHEN best = 1 THEN book END) AS book, count(DISTINCT book) AS books, max(importance) AS top,
string_agg(CASE WHEN nth <= 5 THEN book || ' p.' || page END, '；' ORDER BY ord) AS source, max(CASE WHEN best = 1 THEN name END) AS name FROM m GROUP BY cluster, size),
f AS (SELECT *, CASE WHEN size > 1 THEN 'merged_node_' || CASE WHEN cluster < 1000 THEN lpad(cluster::VARCHAR, 3, '0') ELSE cluster::VARCHAR END ELSE 'n' || best_ord END AS id FROM g)"""


@query(f"WITH {_CLUSTERS} SELECT m.ord, m.cluster::INTEGER AS cluster, m.size FROM m")
def concept_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of equal names, by falling size."""
    nodes = _concepts(spark, sf_dir)
    return integrate.clusters(nodes, integrate.exact_pairs(nodes))


@query(f"WITH {_CLUSTERS} SELECT id, name, definition, book AS textbook_id, source, CASE WHEN size > 1 THEN books ELSE 1 END AS frequency, round(CASE WHEN size > 1 THEN least(1.0, top + 0.08 * (books - 1)) ELSE top END, 6) AS importance FROM f")
def merged_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: one node per cluster."""
    m = _merged(spark, sf_dir)
    return m.select("id", "name", "definition", "textbook_id", "source", F.col("frequency").cast("long").alias("frequency"), F.round("importance", 6).alias("importance"))


@query(f"WITH {_CLUSTERS} SELECT CASE WHEN size > 1 THEN 'merge' ELSE 'keep' END AS action, id AS result_node, size AS n_affected, round((CASE WHEN size > 1 THEN least(0.98, 0.90 + 0.02 * size) ELSE 0.78 END)::DOUBLE, 6) AS confidence FROM f")
def concept_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the decisions behind the merged nodes."""
    d = integrate.decisions(_merged(spark, sf_dir))
    return d.select("action", "result_node", F.size("affected_nodes").cast("long").alias("n_affected"), F.round("confidence", 6).alias("confidence"))


_REMAPPED = f"""{_CLUSTERS}, e AS (SELECT p_partkey AS ord, p_brand, p_partkey AS s, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS t FROM part),
x AS (SELECT e.ord, a.id AS source, b.id AS target, 'next of ' || e.p_brand AS description FROM e JOIN m ma ON ma.ord = e.s JOIN m mb ON mb.ord = e.t JOIN f a ON a.cluster = ma.cluster JOIN f b ON b.cluster = mb.cluster WHERE e.t IS NOT NULL AND a.id <> b.id),
y AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY ord) AS nth FROM x)"""


@query(f"WITH {_REMAPPED} SELECT ord, source, target, 'parallel' AS relation_type, description FROM y WHERE nth = 1")
def remapped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between merged nodes."""
    return integrate.remapped_edges(_relations(spark, sf_dir), _merged(spark, sf_dir)).select("ord", "source", "target", "relation_type", "description")


@query(
    f"WITH {_REMAPPED}, z AS (SELECT (SELECT sum(length(definition)) FROM f) + (SELECT coalesce(sum(length(description)), 0) FROM y WHERE nth = 1) AS chars, (SELECT sum(length(p_name)) FROM part) AS orig) "
    "SELECT (SELECT count(DISTINCT p_brand) FROM part) AS original_books, orig::BIGINT AS original_chars, chars::BIGINT AS integrated_chars, round(chars / orig * 100, 2) AS compression_ratio, (SELECT count(*) FROM part) AS nodes_before, (SELECT count(*) FROM f) AS nodes_after, "
    "(SELECT count(*) FROM e WHERE t IS NOT NULL) AS edges_before, (SELECT count(*) FROM y WHERE nth = 1) AS edges_after, (SELECT count(*) FROM f WHERE size > 1) AS merge_count, (SELECT count(*) FROM f WHERE size = 1) AS keep_count FROM z"
)
def integration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the integration."""
    nodes, edges, merged = _concepts(spark, sf_dir), _relations(spark, sf_dir), _merged(spark, sf_dir)
    books = nodes.groupBy("textbook_id").agg(F.sum(F.length("definition")).alias("total_chars"))
    s = integrate.statistics(books, nodes, edges, merged, integrate.remapped_edges(edges, merged), integrate.decisions(merged))
    return s.select("original_books", "original_chars", "integrated_chars", "compression_ratio", "nodes_before", "nodes_after", "edges_before", "edges_after", "merge_count", "keep_count")


# Graph views: regions and nations as a graph


def _geography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    none = F.array().cast("array<string>")
    both = r.select(F.col("r_regionkey").cast("long").alias("ord"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit(2).alias("frequency"), F.lit(0.9).alias("importance")).unionByName(
        n.select((100 + F.col("n_nationkey")).cast("long").alias("ord"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit(1).alias("frequency"), F.lit(0.5).alias("importance"))
    )
    nodes = both.withColumns({"definition": F.concat(F.lit("place "), "name"), "category": F.lit("核心概念"), "chapter": F.lit("第一章"), "page": F.col("ord").cast("int"), "textbook_id": F.lit("geo"), "textbook_title": F.lit("Geography"), "aliases": none})
    edges = n.select(F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target"), F.lit("contains").alias("relation_type"), ((F.col("n_nationkey") % 7) / 10).alias("weight"))
    return nodes, edges


_GEO = """nd AS (SELECT r_regionkey::BIGINT AS ord, 'r' || r_regionkey AS id, r_name AS name, 2 AS frequency, 0.9 AS importance FROM region UNION ALL SELECT 100 + n_nationkey, 'n' || n_nationkey, n_name, 1, 0.5 FROM nation),
ed AS (SELECT n_nationkey::BIGINT AS ord, 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, (n_nationkey % 7) / 10.0 AS weight FROM nation), dg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ed UNION ALL SELECT target FROM ed) GROUP BY id),
sc AS (SELECT nd.*, coalesce(degree, 0) AS degree, CASE WHEN contains(lower(name || ' place ' || name), 'nation_1') THEN 10000 ELSE 0 END + frequency * 160 + importance * 120 + coalesce(degree, 0) * 18 + least(40, (6 + length(name)) / 25.0) AS score FROM nd LEFT JOIN dg USING (id)),
hit AS (SELECT id FROM sc WHERE score >= 10000), nb AS (SELECT id FROM hit UNION SELECT target FROM ed WHERE source IN (SELECT id FROM hit) UNION SELECT source FROM ed WHERE target IN (SELECT id FROM hit))"""


@query(f"WITH {_GEO} SELECT id, degree, round(score, 6) AS score FROM sc WHERE id IN (SELECT id FROM nb)")
def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible nodes of a search."""
    shown, _ = graphview.visible_graph(*_geography(spark, sf_dir), query="nation_1")
    return shown.select("id", "degree", F.round("score", 6).alias("score"))


@query(f"WITH {_GEO} SELECT ord, source, target, round(weight, 6) AS weight FROM ed WHERE source IN (SELECT id FROM nb) AND target IN (SELECT id FROM nb)")
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges between the visible nodes."""
    _, kept = graphview.visible_graph(*_geography(spark, sf_dir), query="nation_1")
    return kept.select("ord", "source", "target", F.round("weight", 6).alias("weight"))


@query(f"WITH {_GEO} SELECT id, degree FROM dg")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return graphview.degrees(_geography(spark, sf_dir)[1])


@query(f"WITH {_GEO}, pl AS (SELECT id, (row_number() OVER (ORDER BY ord) - 1)::INTEGER AS p FROM nd) SELECT a.p AS x, b.p AS y, 'contains' AS relation_type FROM ed JOIN pl a ON a.id = source JOIN pl b ON b.id = target")
def relation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the relation matrix."""
    shown, kept = graphview.visible_graph(*_geography(spark, sf_dir), view="matrix")
    return graphview.relation_matrix(shown, kept)


@query("SELECT p_brand AS id, p_brand AS title, count(*) AS count FROM part GROUP BY p_brand")
def book_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of a graph with their node counts."""
    return graphview.source_options(_concepts(spark, sf_dir))


@query("SELECT p_brand AS book, p_type AS chapter, len(list(p_name)) AS n FROM part GROUP BY p_brand, p_type")
def concept_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books, chapters and their concepts."""
    nodes = _concepts(spark, sf_dir).withColumn("place", F.col("ord"))
    books = nodes.select("textbook_id", F.col("textbook_title").alias("title")).distinct()
    chapters = nodes.groupBy("textbook_id", F.col("chapter").alias("title")).agg(F.min("page").alias("page_start"))
    return graphview.chapter_tree(nodes, books, chapters).select("book", "chapter", F.size("names").cast("long").alias("n"))


# Extraction, feedback, reports


@query()
def document_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept nodes of all documents, by a lexicon for Latin prose."""
    books, chapters = readers.as_chapters(table(spark, sf_dir, "documents"))
    nodes, _ = extract.build_graphs(chapters, books, LATIN, cleaned=True)
    return nodes.select("textbook_id", "node_ord", "id", "name", "category", F.round("importance", 6).alias("importance"))


@query()
def document_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule edges between them."""
    books, chapters = readers.as_chapters(table(spark, sf_dir, "documents"))
    _, edges = extract.build_graphs(chapters, books, LATIN, cleaned=True)
    return edges.select("textbook_id", "edge_ord", "source", "target", "relation_type", "weight")


_STOP = ", ".join(map(S.quoted, feedback.STOP))
_COMMAND = " ".join(f"WHEN {' OR '.join(f'contains(m, {S.quoted(w)})' for w in ws)} THEN {S.quoted(n)}" for n, ws in feedback.COMMANDS)


@query(
    f"SELECT conv_id, turn, CASE {_COMMAND} ELSE 'help' END AS command, coalesce(k[len(k)], substr(m, greatest(1, length(m) - 11)::BIGINT, 12)) AS keyword FROM (SELECT conv_id, turn, m, "
    f"list_filter(regexp_extract_all(m, '[\\x{{4e00}}-\\x{{9fa5}}A-Za-z0-9_\\-]{{2,20}}'), lambda x: x NOT IN ({_STOP}) AND NOT regexp_matches(x, '^[0-9]+$')) AS k FROM (SELECT conv_id, turn, {S.strip('text')} AS m FROM conversations))"
)
def parsed_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a feedback command."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.strip(F.col("text")).alias("m"))
    return rows.select("conv_id", "turn", feedback.command(F.col("m")).alias("command"), feedback.keyword(F.col("m")).alias("keyword"))


@query("SELECT conv_id * 100000 + turn AS seq, role, text AS content FROM conversations ORDER BY seq DESC LIMIT 200")
def chat_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 messages."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"), "role", F.col("text").alias("content"))
    return store.chat_tail(rows)


@query("SELECT source AS textbook_id, coalesce(nullif(lang, ''), '未标注章节') AS chapter, count(*) AS n FROM documents GROUP BY ALL")
def chapter_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and language."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("textbook_id"), F.col("lang").alias("chapter"), F.col("doc_id").alias("node_ord"))
    return report.chapter_histogram(rows).select("textbook_id", "chapter", "n")


@query("SELECT source AS textbook_id, count(*) AS documents, sum(length(text))::BIGINT AS total_chars, coalesce(sum(l.n), 0)::BIGINT AS nodes FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l USING (doc_id) GROUP BY source")
def source_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and labels by source."""
    docs = table(spark, sf_dir, "documents")
    books = docs.groupBy(F.col("source").alias("textbook_id")).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("total_chars"))
    nodes = table(spark, sf_dir, "labels").join(docs.select("doc_id", F.col("source").alias("textbook_id")), "doc_id")
    return report.graph_sizes(books, nodes, nodes.limit(0)).select("textbook_id", "documents", "total_chars", "nodes")


@query(
    f"WITH {_CLUSTERS} SELECT (row_number() OVER (ORDER BY size DESC, least(0.98, 0.90 + 0.02 * size) DESC, cluster))::INTEGER AS \"case\", id AS result_node, name AS title FROM f WHERE size > 1 ORDER BY 1 LIMIT 5"
)
def case_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions that a report tells of."""
    m = _merged(spark, sf_dir)
    return report.case_decisions(integrate.decisions(m), m).select("case", "result_node", "title")


@query(f"WITH {_CLUSTERS} SELECT CASE WHEN size > 1 THEN 'merge' ELSE 'keep' END AS action, count(*) AS n FROM f GROUP BY ALL")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by action."""
    return report.action_counts(integrate.decisions(_merged(spark, sf_dir)))


@query("SELECT p_brand AS textbook_title, p_partkey AS ord, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey % 20) DESC, p_type, p_partkey) AS rank FROM part) WHERE rank <= 30")
def top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's 30 most important concepts."""
    rows = _concepts(spark, sf_dir).withColumn("name", F.concat("name", F.lit("\x01"), F.lpad(F.col("ord").cast("string"), 12, "0")))
    return report.top_nodes(rows, ["textbook_title"]).select("textbook_title", "ord", "rank")
