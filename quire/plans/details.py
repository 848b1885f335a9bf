"""More registered queries: functions and operators that the main ones reach only in part, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import terms as T
from quire.functions import text as X
from quire.functions import titles as H
from quire.lexicon import Lexicon
from quire.operators import extract, feedback, graphview, integrate, rag, report, segment
from quire.operators.components import once, spread
from quire.plans import sql as S
from quire.plans.queries import _CLUSTERS, _HYBRID, ORACLES, _concepts, _merged, _relations, _turns, query, table

# Text functions

_VERBS = (" is ", " la ", " der ", " el ", " the ")
_CLEAN = S.clean_text("text")


@query(
    f"WITH d AS (SELECT doc_id, {S.tokens('text')}[1] AS term, {_CLEAN} AS c FROM documents), s AS (SELECT *, list_filter({S.sentences('c')}, lambda x: NOT {S.noise(S.clean_line('x'))}) AS s FROM d), "
    f"n AS (SELECT *, list_filter(s, lambda x: contains(x, term)) AS named FROM s) "
    f"SELECT doc_id, md5(coalesce(left(list_filter(named, lambda x: {' OR '.join(f'contains(x, {S.quoted(v)})' for v in _VERBS)})[1], 220), left(named[1], 220), left(c, 140))) AS digest FROM n WHERE term IS NOT NULL"
)
def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best definition of each document's first token."""
    rows = once(table(spark, sf_dir, "documents").select("doc_id", "text"), "term", F.get(X.tokenize(F.col("text")), F.lit(0))).where("term is not null")
    return rows.select("doc_id", F.md5(F.encode(X.best_definition(F.col("term"), F.col("text"), _VERBS), "UTF-8")).alias("digest"))


def _chars(x: str) -> str:
    return f"list_filter(list_distinct(string_split(regexp_replace({x}, '[{S.SPACE}]+', '', 'g'), '')), lambda c: c <> '')"


def _indel(a: str, b: str) -> str:
    """The indel ratio of two strings by a row-wise dynamic programme over lists, of words in sorted order."""
    x, y = (f"array_to_string(list_sort(list_filter(string_split_regex({v}, '[{S.SPACE}]+'), lambda w: w <> '')), ' ')" for v in (a, b))
    row = "list_reduce(range(1, len(q) + 1), lambda n, j: list_append(n, greatest(r[j + 1], n[j], r[j] + (q[j] = c)::INT)), [0])"
    lcs = f"list_reduce(p, lambda r, c: {row}, list_transform(range(0, len(q) + 1), lambda j: 0))"
    return f"(SELECT CASE WHEN len(x) + len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE 2.0 * {lcs}[len(q) + 1] / (len(p) + len(q)) END FROM (SELECT x, y, string_split(x, '') AS p, string_split(y, '') AS q FROM (SELECT {x} AS x, {y} AS y)))"


@query(f"SELECT p_partkey, round(len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE, 9) AS overlap FROM (SELECT p_partkey, {_chars('p_name')} AS a, {_chars('p_brand')} AS b FROM part)")
def name_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared characters of parts' names and brands."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.char_overlap(F.col("p_name"), F.col("p_brand")), 9).alias("overlap"))


@query(f"WITH n AS (SELECT DISTINCT p_name FROM part), b AS (SELECT DISTINCT p_brand FROM part) SELECT p_name, p_brand, round({_indel('lower(p_name)', 'lower(p_brand)')}, 9) AS ratio FROM n, b")
def indel_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: the common-subsequence ratio of distinct part names and brands."""
    part = table(spark, sf_dir, "part")
    pairs = part.select("p_name").distinct().crossJoin(F.broadcast(part.select("p_brand").distinct()))  # 25 brands
    return pairs.select("p_name", "p_brand", F.round(T.indel_ratio(F.lower("p_name"), F.lower("p_brand")), 9).alias("ratio"))


_HASH = "list_reduce(list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT), lambda h, c: (((h * 31 + c + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648, 7::BIGINT)"
_NATURAL = "array_to_string(list_transform(regexp_extract_all(lower(p_brand || ' ' || p_size || 'x'), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(p, 20, '0') ELSE p END), '')"


@query(f"SELECT p_partkey, (abs({_HASH}) % 9)::INTEGER AS colour, CASE WHEN length(p_name) > 7 THEN left(p_name, 7) || '...' ELSE p_name END AS label, {_NATURAL} AS place, format('{{:,}}', p_partkey * 7919) AS shown FROM part")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours, short labels, natural sort keys and thousands."""
    name = F.concat_ws(" ", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit("x")))
    shown = X.thousands(F.col("p_partkey") * 7919)
    return table(spark, sf_dir, "part").select("p_partkey", graphview.palette_index(F.col("p_name"), 9).alias("colour"), graphview.shorten(F.col("p_name"), 7).alias("label"), graphview.natural_key(name).alias("place"), shown.alias("shown"))


_PLAIN = Lexicon(hints=(), publishing=(), min_chapter=500)
_TOC = "(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?:[.\\x{2026}·•\\-—_]\\s*){4,}'))) >= 4)"


@query(f"SELECT doc_id, (length({_CLEAN}) >= 500 AND NOT {_TOC}) AS good FROM documents")
def extractable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are long enough and no table of contents (the oracle has the rules that apply to Latin text)."""
    return table(spark, sf_dir, "documents").select("doc_id", T.chapter_is_extractable(F.lit("x"), F.col("text"), _PLAIN).alias("good"))


_CATEGORY = " ".join(f"WHEN regexp_matches(s, {S.quoted('|'.join(k))}) THEN {S.quoted(n)}" for n, k in (("生理机制", ("机制", "过程", "步骤", "通路", "反射")), ("方法/指标", ("方法", "测定", "评价", "指标", "ECG", "心电图")), ("应用场景", ("应用", "临床", "治疗", "诊断"))))
_WORDS = ("反射", "测定", "治疗", "机制", "植物")


@query(f"SELECT p_partkey, CASE {_CATEGORY} ELSE '核心概念' END AS category FROM (SELECT p_partkey, p_name || ([{', '.join(map(S.quoted, _WORDS))}])[(p_partkey % 5 + 1)::BIGINT] || p_type AS s FROM part)")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category that words of a name and definition tell."""
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.category(F.concat("p_name", word), F.col("p_type")).alias("category"))


# Segments


@query(
    f"WITH RECURSIVE t AS (SELECT conv_id, string_agg('# ' || role || ' ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id), "
    f"l AS (SELECT conv_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT conv_id, {S.lines('t')} AS ls FROM t)), h AS (SELECT *, starts_with(line, '#') AS h FROM l), "
    "g AS (SELECT *, sum(h::INTEGER) OVER (PARTITION BY conv_id ORDER BY i) AS seg FROM h), "
    "s AS (SELECT conv_id, seg, max(CASE WHEN h THEN line END) AS title, string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY i) AS content, sum((NOT h)::INTEGER) AS k FROM g GROUP BY conv_id, seg) "
    f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY seg))::INTEGER AS chapter_ord, {S.strip('regexp_replace(title, ' + S.quoted('^#+[' + S.SPACE + ']*') + ', ' + S.quoted('') + ')')} AS title, md5(content) AS digest FROM s WHERE k > 0"
)
def markdown_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown, a heading for each turn."""
    turn = F.struct("turn", F.concat(F.lit("# "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text").alias("t"))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"]), "\n").alias("text"))
    rows = segment.heading_segments(docs, "conv_id", "text")
    return rows.select("conv_id", F.col("chapter_ord").cast("int").alias("chapter_ord"), "title", F.md5(F.encode("content", "UTF-8")).alias("digest"))


_BLOCK_LINES = f"list_filter(list_transform({S.lines('t')}, lambda l: {S.clean_line('l')}), lambda l: NOT {S.noise('l')})"


@query(
    "WITH b AS (SELECT coalesce(source, '-') AS textbook_id, (doc_id % 97)::INTEGER AS page_no, doc_id AS block_no, (doc_id % 11) * 80.0 AS y0, "
    f"{S.strip('left(text, 400)')} AS t FROM documents), k AS (SELECT textbook_id, page_no, block_no, array_to_string({_BLOCK_LINES}, chr(10)) AS x FROM b WHERE y0 >= 800 * 0.04 AND y0 + 20 <= 800 * 0.965 AND length(t) >= 2), "
    f"p AS (SELECT textbook_id, page_no, string_agg(x, chr(10) ORDER BY block_no) AS text FROM k WHERE x <> '' GROUP BY ALL) SELECT textbook_id, page_no, md5({_CLEAN}) AS digest FROM p WHERE {_CLEAN} <> ''"
)
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of text blocks without margins and noise; documents stand for blocks."""
    d = table(spark, sf_dir, "documents")
    y0 = (F.col("doc_id") % 11 * 80).cast("double")
    blocks = d.select(F.coalesce("source", F.lit("-")).alias("textbook_id"), (F.col("doc_id") % 97).cast("int").alias("page_no"), F.col("doc_id").alias("block_no"), F.lit(800.0).alias("page_height"), y0.alias("y0"), (y0 + 20).alias("y1"), F.left("text", F.lit(400)).alias("text"))
    return segment.pdf_page_texts(blocks).select("textbook_id", "page_no", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(
    "WITH p AS (SELECT coalesce(source, '-') AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, left(text, 100) AS text, CASE WHEN doc_id % 5 = 0 THEN 'T' || doc_id // 20 END AS title FROM documents), "
    f"c AS (SELECT b, count(*) AS total FROM p GROUP BY b), k AS (SELECT * FROM p WHERE text <> '' AND NOT {_TOC}), "
    "o AS (SELECT *, row_number() OVER w AS r, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY b ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '未识别章节') AS last FROM k WINDOW w AS (PARTITION BY b ORDER BY n)), "
    "g AS (SELECT *, sum((r > 1 AND title IS NOT NULL AND title <> last)::INTEGER) OVER (PARTITION BY b ORDER BY n) AS seg FROM o), "
    "s AS (SELECT b, seg, arg_min(coalesce(title, ''), n) AS title, min(n) AS first, string_agg(text, chr(10) ORDER BY n) AS content FROM g GROUP BY b, seg), "
    "z AS (SELECT *, CASE WHEN seg = 0 AND title = '' THEN 1 ELSE first END AS page_start FROM s) "
    "SELECT b AS textbook_id, (seg + 1)::INTEGER AS chapter_ord, coalesce(nullif(title, ''), '未识别章节') AS title, page_start::INTEGER AS page_start, coalesce(lead(page_start) OVER (PARTITION BY b ORDER BY seg) - 1, total)::INTEGER AS page_end, md5(content) AS digest FROM z JOIN c USING (b)"
)
def page_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages grouped into chapters by their titles; documents stand for pages."""
    d = table(spark, sf_dir, "documents")
    book = F.coalesce("source", F.lit("-"))
    n = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    title = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("T"), F.floor(F.col("doc_id") / 20).cast("string")))
    pages = d.select(book.alias("textbook_id"), n.alias("page_no"), F.left("text", F.lit(100)).alias("text"), title.alias("title"))
    counts = pages.groupBy("textbook_id").agg(F.count("*").cast("int").alias("total_pages"))
    s = segment.page_segments(pages, counts)
    return s.select("textbook_id", "chapter_ord", "title", F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"), F.md5(F.encode("content", "UTF-8")).alias("digest"))


_LAST = "coalesce(length(regexp_extract(substr(t, s + 1, 700), '(?s)^(.*[。；\\n])', 1)), 0)"
_END = f"CASE WHEN s + 700 >= n THEN n WHEN {_LAST} - 1 > 455 THEN s + {_LAST} ELSE s + 700 END"


@query(
    f"WITH RECURSIVE d AS (SELECT doc_id, t, length(t) AS n FROM (SELECT doc_id, {_CLEAN} AS t FROM documents) WHERE t <> ''), w AS (SELECT doc_id, t, n, s, {_END} AS e FROM (SELECT doc_id, t, n, 0::BIGINT AS s FROM d) "
    f"UNION ALL SELECT doc_id, t, n, s, {_END} AS e FROM (SELECT doc_id, t, n, greatest(0, e - 80)::BIGINT AS s FROM w WHERE e < n)) "
    "SELECT 'chunk_' || left(sha1(doc_id || ':ch_001:' || s), 12) AS chunk_id, (row_number() OVER (ORDER BY doc_id, s) - 1)::BIGINT AS ord, doc_id::VARCHAR AS textbook_id, (1 + floor(s / greatest(1, n) * 10))::INTEGER AS page, md5(substr(t, s + 1, e - s)) AS digest FROM w"
)
def book_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of books of one chapter and ten pages, with ids, ordinals and pages."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string").alias("textbook_id")
    clean = once(spread(d.select("doc_id", "text")), "content", X.clean_text(F.col("text")))
    chapters = clean.select(key, F.lit(1).alias("chapter_ord"), F.lit("ch_001").alias("chapter_id"), F.lit("all").alias("title"), F.lit(1).alias("page_start"), F.lit(10).alias("page_end"), "content", F.length("content").alias("char_count"))
    books = d.select(key, F.lit("b").alias("title"), F.col("doc_id").alias("book_ord"))
    return segment.chunk_rows(chapters, books, clean=False).select("chunk_id", "ord", "textbook_id", "page", F.md5(F.encode("text", "UTF-8")).alias("digest"))


# Retrieval


_FOUND = "fd AS (SELECT qid, rank, ord, s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, ord DESC) AS rank FROM hy) WHERE rank <= 5 AND s > 0)"


@query(
    f"WITH {_HYBRID}, {_FOUND}, t AS (SELECT fd.*, q.question, c.text, ' [conv_' || conv_id || ', ' || role || ', 第 ' || turn || ' 页]' AS source FROM fd JOIN q USING (qid) JOIN conversations c ON conv_id * 100000 + turn = ord), "
    f"e AS (SELECT qid, rank, s, source, {S.sentences('text')} AS ss, list_distinct({S.tokens('question')}) AS qt FROM t), "
    "x AS (SELECT qid, rank, s, source, qt, unnest(range(1, len(ss) + 1)) AS pos, unnest(ss) AS sentence FROM e), "
    f"o AS (SELECT *, len(list_intersect(qt, list_distinct({S.tokens('sentence')}))) / greatest(1, len(qt))::DOUBLE AS overlap FROM x), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(overlap + s * 0.2, 9) DESC, rank, pos) AS n FROM o WHERE overlap > 0), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY qid, left(sentence, 30) ORDER BY n) AS first FROM n WHERE n <= 5), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n) AS place FROM f WHERE first = 1), b AS (SELECT qid, string_agg(sentence || source, chr(10) ORDER BY n) AS answer FROM g WHERE place <= 4 GROUP BY qid), "
    "pl AS (SELECT qid, '根据已检索到的教材片段，' || left(text, 220) || '……' || source AS plain FROM t WHERE rank = 1), c2 AS (SELECT qid, count(*) AS k FROM fd GROUP BY qid) "
    "SELECT q.qid, md5(coalesce(b.answer, pl.plain, '当前知识库中未找到相关信息。')) AS digest, coalesce(k, 0)::INTEGER AS n_citations FROM q LEFT JOIN b USING (qid) LEFT JOIN pl USING (qid) LEFT JOIN c2 USING (qid)"
)
def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive answers with their sources, and how many chunks they cite."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    a = rag.Index.build(_turns(spark, sf_dir)).answer(asked)
    return a.select("qid", F.md5(F.encode("answer", "UTF-8")).alias("digest"), F.coalesce(F.size("citations"), F.lit(0)).alias("n_citations"))


_TEXT = "coalesce(b.answer, pl.plain, '当前知识库中未找到相关信息。')"
ORACLES["extractive_answers"] = ORACLES["cited_answers"].replace(f"md5({_TEXT}) AS digest", f"{_TEXT} AS answer")


@query(f"SELECT item_id AS qid, {S.quoted(rag.NOT_INDEXED)} AS answer, 0 AS n_citations FROM benchmark")
def unindexed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cleared index answers."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    a = rag.Index.empty(spark).answer(asked)
    return a.select("qid", "answer", F.size("citations").alias("n_citations"))


@query(
    "WITH c AS (SELECT coalesce(source, '-') AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, 'Document ' || doc_id AS title FROM documents), o AS (SELECT b, row_number() OVER (ORDER BY b) AS o FROM (SELECT DISTINCT b FROM c)) "
    "SELECT (row_number() OVER (ORDER BY o, n))::BIGINT AS qid, title || '的核心内容是什么？' AS question, title AS expected FROM c JOIN o USING (b) WHERE n <= 4 ORDER BY o, n LIMIT 24"
)
def benchmark_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions after chapter titles."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("-")).alias("textbook_id"), F.col("doc_id").alias("chapter_ord"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"))
    books = d.select("textbook_id").distinct().withColumn("book_ord", F.dense_rank().over(W.orderBy("textbook_id")))
    return rag.benchmark_questions(d, books)


@query(
    f"WITH t AS (SELECT doc_id, {S.tokens('text')} AS l FROM documents), f AS (SELECT doc_id, term, count(*) / max(n)::DOUBLE AS tf FROM (SELECT doc_id, len(l) AS n, unnest(l) AS term FROM t) GROUP BY doc_id, term), "
    "d AS (SELECT term, count(*) AS df FROM f GROUP BY term), s AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS score FROM f JOIN d USING (term)) "
    "SELECT doc_id, rank::INTEGER AS rank, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS rank FROM s) WHERE rank <= 35"
)
def document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of every document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("textbook_id"), F.lit("c").alias("chapter_id"), F.col("text").alias("content"))
    return extract.keywords(d).select(F.col("textbook_id").alias("doc_id"), "rank", "term")


# Integration by similarity: suppliers as concepts, their nations as books


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("Depot "), F.substring(F.md5(F.col("s_suppkey").cast("string").cast("binary")), 1, 2), F.lit(" unit"))
    return s.select(F.col("s_suppkey").alias("ord"), name.alias("name"), F.concat(F.lit("serves nation "), F.col("s_nationkey").cast("string")).alias("definition"), F.col("s_nationkey").cast("string").alias("textbook_id"))


_SUPPLIERS = f"n AS (SELECT s_suppkey AS ord, 'Depot ' || left(md5(s_suppkey::VARCHAR), 2) || ' unit' AS name, 'serves nation ' || s_nationkey AS definition, s_nationkey::VARCHAR AS book, {S.key(chr(39) + 'Depot ' + chr(39) + ' || left(md5(s_suppkey::VARCHAR), 2) || ' + chr(39) + ' unit' + chr(39))} AS k FROM supplier)"
_GRAM = """flatten(list_transform(list_filter(string_split(regexp_replace(lower(name || '。' || definition), '[%s]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w:
 list_concat(list_transform(range(1, greatest(1, length(w) + 1) + 1), lambda i: substr(' ' || w || ' ', i::BIGINT, 2)),
 list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i::BIGINT, 3)), list_transform(range(1, length(w)), lambda i: substr(' ' || w || ' ', i::BIGINT, 4))))))""" % S.SPACE
_NEAR = f"""{_SUPPLIERS}, cg AS (SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest({_GRAM}) AS term FROM n) GROUP BY ord, term),
voc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM n)) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM cg GROUP BY term ORDER BY total DESC, term LIMIT 16000)),
cw AS (SELECT ord, term, tf * idf AS w FROM cg JOIN voc USING (term)), cn AS (SELECT ord, sqrt(sum(w * w)) AS norm FROM cw GROUP BY ord),
cs AS (SELECT x.ord AS a, y.ord AS b, sum(x.w * y.w) / max(nx.norm * ny.norm) AS cosine FROM cw x JOIN cw y ON x.term = y.term AND x.ord <> y.ord JOIN cn nx ON nx.ord = x.ord JOIN cn ny ON ny.ord = y.ord GROUP BY x.ord, y.ord),
nb AS (SELECT a, b, cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS r FROM cs) WHERE r <= 10 AND a < b),
pr AS (SELECT a, b, cosine, x.book = y.book AS same, {_indel('x.k', 'y.k')} AS fuzzy, len(list_intersect({_chars('x.k')}, {_chars('y.k')})) / least(len({_chars('x.k')}), len({_chars('y.k')}))::DOUBLE AS overlap FROM nb JOIN n x ON x.ord = a JOIN n y ON y.ord = b),
sm AS (SELECT a, b FROM pr WHERE fuzzy >= 0.94 OR (NOT same AND ((cosine >= 0.82 AND (fuzzy >= 0.72 OR overlap >= 0.58)) OR (cosine >= 0.90 AND fuzzy >= 0.55))))"""


@query(f"WITH {_NEAR} SELECT a, b FROM sm")
def similar_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by text that the merge rule joins."""
    return integrate.similar_pairs(_suppliers(spark, sf_dir))


@query(
    f"WITH RECURSIVE {_NEAR}, ex AS (SELECT min(ord) OVER (PARTITION BY k) AS a, ord AS b FROM n), ed AS (SELECT a, b FROM sm UNION SELECT b, a FROM sm UNION SELECT a, b FROM ex UNION SELECT b, a FROM ex), "
    "re AS (SELECT ord AS a, ord AS b FROM n UNION SELECT re.a, ed.b FROM re JOIN ed ON ed.a = re.b), co AS (SELECT a AS ord, min(b) AS c FROM re GROUP BY a), sz AS (SELECT c, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, c) AS cluster FROM co GROUP BY c) "
    "SELECT ord, cluster::INTEGER AS cluster, size FROM co JOIN sz USING (c)"
)
def integrated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of equal and similar names."""
    n = _suppliers(spark, sf_dir)
    return integrate.clusters(n, integrate.exact_pairs(n).unionByName(integrate.similar_pairs(n)))


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_size, p_brand, p_partkey))::BIGINT AS ord FROM part")
def concatenated_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of nodes of all graphs."""
    n = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("graph_ord"), F.col("p_brand").alias("textbook_id"), F.col("p_partkey").alias("node_ord"))
    e = n.select("graph_ord", "textbook_id", F.col("node_ord").alias("edge_ord"))
    return integrate.concatenated(n, e)[0].select("p_partkey", "ord")


# Feedback, reports, views

#: Commands in order; the later ones see what the earlier ones wrote.
COMMANDS = ("请删除 PROMO", "保留 SMALL", "这两个不应该合并 ECONOMY", "恢复 PROMO")
_AFTER = f"""{_CLUSTERS}, tt AS (SELECT cluster, string_agg(DISTINCT book, '、' ORDER BY book) AS titles FROM m GROUP BY cluster),
d AS (SELECT f.cluster, f.id, f.name, f.definition, CASE WHEN size > 1 THEN 'merge' ELSE 'keep' END AS action, size || ' 个节点（' || name || '）在名称、定义或语义向量上高度相似，来自 ' || titles || '；保留“' || name || '”作为最完整表述，并把其他表述写入 aliases。' AS reason FROM f JOIN tt USING (cluster))"""


@query(
    f"WITH {_AFTER} SELECT id AS result_node, CASE name WHEN 'PROMO' THEN 'keep' WHEN 'SMALL' THEN 'keep' WHEN 'ECONOMY' THEN 'split' ELSE action END AS action, name IN ('PROMO', 'SMALL', 'ECONOMY') AS teacher_locked, "
    "md5(reason || CASE name WHEN 'PROMO' THEN '；教师反馈要求删除“PROMO”，系统已调整为 remove。；教师反馈要求保留“PROMO”，系统已锁定为 keep。' WHEN 'SMALL' THEN '；教师反馈要求保留“SMALL”，系统已锁定为 keep。' WHEN 'ECONOMY' THEN '；教师反馈认为“ECONOMY”不应合并，系统已将该决策改为 split，前端会显示为待拆分。' ELSE '' END) AS digest FROM d"
)
def feedback_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions after a teacher's commands, in order."""
    merged = _merged(spark, sf_dir)
    _, after = feedback.run_all(integrate.decisions(merged), merged, list(COMMANDS))
    return after.select("result_node", "action", "teacher_locked", F.md5(F.encode("reason", "UTF-8")).alias("digest"))


@query(
    f"WITH {_AFTER} SELECT n::BIGINT AS n, md5(CASE n WHEN 1 THEN '已把“PROMO”标记为删除。' WHEN 2 THEN '关于“SMALL”：' || (SELECT reason FROM d WHERE name = 'SMALL') || ' 置信度 0.98。如果你认为不合理，可以说“保留 SMALL”或“拆分 SMALL”。' "
    "WHEN 3 THEN '没找到“NOWHERE”对应决策，请换一个更精确名称。' ELSE '可以合并。请用“合并 A 和 B”的格式告诉我两个知识点；当前版本会把它记录为教师建议，下一次整合会优先考虑。' END) AS digest FROM range(1, 5) t(n)"
)
def feedback_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies to commands."""
    merged = _merged(spark, sf_dir)
    replies, _ = feedback.run_all(integrate.decisions(merged), merged, ["删除 PROMO", "为什么合并 SMALL", "保留 NOWHERE", "合并 A 和 B"])
    rows = spark.createDataFrame(list(enumerate(replies, 1)), "n long, reply string")
    return rows.select("n", F.md5(F.encode("reply", "UTF-8")).alias("digest"))


@query(f"WITH {_CLUSTERS} SELECT (row_number() OVER (ORDER BY confidence DESC, decision_id))::INTEGER AS place, decision_id FROM (SELECT least(0.98, 0.90 + 0.02 * size) AS confidence, 'merge_' || CASE WHEN cluster < 1000 THEN lpad(cluster::VARCHAR, 3, '0') ELSE cluster::VARCHAR END AS decision_id FROM f WHERE size > 1) ORDER BY 1 LIMIT 30")
def top_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest merges."""
    d = report.top_merges(integrate.decisions(_merged(spark, sf_dir)))
    return d.select(F.row_number().over(W.orderBy(F.desc("confidence"), "decision_id")).alias("place"), "decision_id")


@query("SELECT p_brand AS textbook_id, 'Book ' || p_brand AS title, count(DISTINCT p_type) AS chapters, count(*) AS nodes, count(*) - 1 AS edges FROM part GROUP BY p_brand")
def export_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters, nodes and edges of each book."""
    nodes = _concepts(spark, sf_dir)
    edges = _relations(spark, sf_dir).withColumn("textbook_id", F.regexp_replace("description", "^next of ", ""))
    books = nodes.select("textbook_id", F.concat(F.lit("Book "), "textbook_id").alias("title")).distinct()
    return report.export_summary(books, nodes.select("textbook_id", "chapter").distinct(), nodes, edges)


@query(
    "WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS o FROM (SELECT DISTINCT p_brand FROM part)), c AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS k FROM (SELECT DISTINCT p_brand, p_type FROM part)), "
    "n AS (SELECT p_brand, p_type, p_size, p_name, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY (p_partkey % 20) DESC, p_name || ' ' || lpad(p_partkey::VARCHAR, 9, '0')) AS r, p_name || ' ' || lpad(p_partkey::VARCHAR, 9, '0') AS name FROM part WHERE p_size > 10) "
    "SELECT o::INTEGER AS book_ord, 0 AS chapter_ord, 0 AS line, '## ' || p_brand AS text FROM b UNION ALL SELECT o::INTEGER, k::INTEGER, 0, '### ' || p_type FROM c JOIN b USING (p_brand) "
    "UNION ALL SELECT o::INTEGER, k::INTEGER, coalesce(r, 1)::INTEGER, CASE WHEN r IS NULL THEN '本章未保留独立核心节点，相关内容可能已并入跨教材同名或近义概念。' ELSE '- **' || name || '**（核心概念，第 ' || p_size || ' 页）：' || p_name END FROM c JOIN b USING (p_brand) LEFT JOIN (SELECT * FROM n WHERE r <= 20) x USING (p_brand, p_type)"
)
def refined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refined book's lines."""
    nodes = _concepts(spark, sf_dir)
    books = nodes.select("textbook_id", F.col("textbook_title").alias("title")).distinct().withColumn("book_ord", F.dense_rank().over(W.orderBy("textbook_id")))
    chapters = nodes.select("textbook_id", F.col("chapter").alias("title")).distinct().withColumn("chapter_ord", F.dense_rank().over(W.partitionBy("textbook_id").orderBy("title")))
    kept = nodes.where("page > 10").withColumn("name", F.concat_ws(" ", "definition", F.lpad(F.col("ord").cast("string"), 9, "0")))
    return report.refined_book(books, chapters, kept)


@query(
    "WITH n AS (SELECT p_brand, p_type AS chapter, count(*) AS k, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) AS r FROM part GROUP BY p_brand, p_type), s AS (SELECT p_brand, count(DISTINCT p_type) AS c, count(*) AS n FROM part GROUP BY p_brand), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey % 20) DESC, p_type, p_partkey) AS r FROM part), "
    "h AS (SELECT p_brand, unnest(range(0, 5)) AS line, unnest(['# ' || p_brand || ' 知识图谱摘要', '- 章节数：' || c, '- 知识点数：' || n, '- 关系数：' || (n - 1), '## 教材章节']) AS text FROM s) "
    "SELECT p_brand AS textbook_id, 0 AS part, line::INTEGER AS line, text FROM h UNION ALL SELECT p_brand, 1, (row_number() OVER (PARTITION BY p_brand ORDER BY p_type))::INTEGER, '- ' || p_type || '（第 ' || min(p_size) || '–' || max(p_size) || ' 页，' || sum(length(p_name)) || ' 字）' FROM part GROUP BY p_brand, p_type "
    "UNION ALL SELECT p_brand, 2, 0, '## 章节节点分布' FROM s UNION ALL SELECT p_brand, 2, r::INTEGER, '- ' || chapter || '：' || k || ' 个节点' FROM n UNION ALL SELECT p_brand, 3, 0, '## 重要知识点示例' FROM s "
    "UNION ALL SELECT p_brand, 3, r::INTEGER, '- ' || p_type || ' ' || lpad(p_partkey::VARCHAR, 9, '0') || '（' || p_type || '，核心概念，第 ' || p_size || ' 页）' FROM t WHERE r <= 30"
)
def book_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each book's graph, line by line."""
    nodes = _concepts(spark, sf_dir).withColumn("name", F.concat_ws(" ", "name", F.lpad(F.col("ord").cast("string"), 9, "0"))).withColumn("node_ord", F.col("ord"))
    books = nodes.select("textbook_id", F.col("textbook_title").alias("title")).distinct()
    chapters = nodes.groupBy("textbook_id", F.col("chapter").alias("title")).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum(F.length("definition")).alias("char_count"))
    chapters = chapters.withColumn("chapter_ord", F.row_number().over(W.partitionBy("textbook_id").orderBy("title")))
    edges = _relations(spark, sf_dir).withColumn("textbook_id", F.regexp_replace("description", "^next of ", ""))
    return report.book_summary(books, chapters, nodes, edges)


@query("SELECT 'n' || p_partkey AS id, ((p_partkey % 20) * 5)::INTEGER AS importance_pct, p_brand || ' p.' || p_size AS source FROM part")
def node_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a detail panel shows."""
    return graphview.node_details(_concepts(spark, sf_dir)).select("id", "importance_pct", "source")


@query("SELECT p_brand AS textbook_id, p_type AS title, place::INTEGER AS place FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_size), p_type) AS place FROM part GROUP BY p_brand, p_type) WHERE place <= 3")
def listed_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters that a list shows."""
    chapters = _concepts(spark, sf_dir).groupBy("textbook_id", F.col("chapter").alias("title")).agg(F.min("page").alias("page_start"))
    return report.listed_chapters(chapters, 3).select("textbook_id", "title", "place")
