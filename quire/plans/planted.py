"""Registered queries for titles and terms: Chinese ones, planted into every document by its id and words.

No table has Chinese text. Each document's title and term are put together from its doc_id and its own first word, in
Spark and in SQL alike; the SQL then states what was planted, or the rules anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import terms as T
from quire.functions import titles as H
from quire.lexicon import DEFAULT
from quire.operators import vectors
from quire.plans import sql as S
from quire.plans.queries import query, table

NAMES = ("休 克", "上肢", "血液循环", "神经系统", "细胞与组织", "炎症反应", "ATP 合成", "呼吸")
PLAIN = ("休克", *NAMES[1:])  # as they are in a title's normal form
DIGITS = "一二三四五六七八九"
NUMERALS = tuple(("" if n < 10 else "十" if n < 20 else DIGITS[n // 10 - 1] + "十") + ("" if n % 10 == 0 else DIGITS[n % 10 - 1]) for n in range(1, 61))


def _pick(words: tuple[str, ...], by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.expr(by) + 1).cast("int"))


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(S.quoted, words)) + "]"


def _any(x: str, words: tuple[str, ...]) -> str:
    return f"(len(list_filter({_list(tuple(words))}, lambda w: contains({x}, w))) > 0)" if words else "false"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, num, raw, content): a title of one of ten forms, and a chapter that begins with it."""
    d = table(spark, sf_dir, "documents").where("doc_id >= 0").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    num = F.when(F.expr("doc_id % 4 = 1"), F.expr("doc_id % 60 + 1").cast("string")).otherwise(_pick(NUMERALS, "doc_id % 60"))
    d = d.select("doc_id", "text", num.alias("num"), _pick(NAMES, "doc_id % 8").alias("name"), F.left(F.regexp_extract("text", "[A-Za-z]{2,}", 0), F.lit(10)).alias("word"))
    forms = (("第", "num", "章 ", "name"), ("第 ", "num", " 章  ", "name"), ("第", "num", "章"), ("第", "num", "章 ", "name", " 128"), ("参见第", "num", "章。"), ("第", "num", "章 ", "name", "；", "word"), ("第", "num", "章 ", "name", " 学习目标 其他"), ("绪论",), ("Chapter 7: ", "word"), ("推荐阅读 12",))
    raw = F.element_at(F.array(*(F.concat(*(F.col(x) if x in ("num", "name", "word") else F.lit(x) for x in f)) for f in forms)), F.expr("doc_id % 10 + 1").cast("int"))
    parts = (F.repeat(F.concat("raw", F.lit("\n")), F.expr("doc_id % 4").cast("int")), F.when(F.expr("doc_id % 5 = 2"), F.lit("主编 王 版权 所有\n")).otherwise(""), F.when(F.expr("doc_id % 11 = 3"), F.lit("本章数字资源\n")).otherwise(""), F.left("text", (300 + F.expr("doc_id % 3") * 300).cast("int")))
    return d.withColumn("raw", raw).select("doc_id", "num", "raw", F.concat(*parts).alias("content"))


_TITLES = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 4 = 1 THEN (doc_id % 60 + 1)::VARCHAR ELSE {_list(NUMERALS)}[doc_id % 60 + 1] END AS num, {_list(NAMES)}[doc_id % 8 + 1] AS name, {_list(PLAIN)}[doc_id % 8 + 1] AS plain, left(regexp_extract(coalesce(text, ''), '[A-Za-z]{{2,}}'), 10) AS word FROM documents WHERE doc_id >= 0),
t AS (SELECT *, ['第' || num || '章 ' || name, '第 ' || num || ' 章  ' || name, '第' || num || '章', '第' || num || '章 ' || name || ' 128', '参见第' || num || '章。', '第' || num || '章 ' || name || '；' || word, '第' || num || '章 ' || name || ' 学习目标 其他', '绪论', 'Chapter 7: ' || word, '推荐阅读 12'][doc_id % 10 + 1] AS raw FROM d)"""


@query(
    f"WITH {_TITLES} SELECT doc_id, raw, ['第' || num || '章 ' || plain, '第' || num || '章 ' || plain, '第' || num || '章', '第' || num || '章 ' || plain || ' 128', '参见第' || num || '章 。', '第' || num || '章 ' || plain || '；' || word, '第' || num || '章 ' || plain, '绪论', trim('Chapter 7: ' || word, ' :'), '推荐阅读 12'][doc_id % 10 + 1] AS title, "
    "CASE doc_id % 10 WHEN 4 THEN '参见第' || num || '章。' WHEN 7 THEN '绪论' WHEN 8 THEN 'Chapter7:' || word WHEN 9 THEN '推荐阅读12' ELSE '第' || num || '章' END AS chapter_key, "
    "CASE doc_id % 10 WHEN 7 THEN 0 WHEN 8 THEN 9998 WHEN 9 THEN 9998 ELSE (doc_id % 60 + 1)::INTEGER END AS number FROM t"
)
def chapter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title planted into each document in one form, its key and its number."""
    return _titles(spark, sf_dir).select("doc_id", "raw", H.normalize_title(F.col("raw")).alias("title"), H.chapter_key(F.col("raw")).alias("chapter_key"), H.chapter_number(F.col("raw")).alias("number"))


_N = f"[{S.NUM}\\d]+"
_SP = f"[{S.SPACE}]*"
_PREFIX = f"第{_SP}{_N}{_SP}章"
_ROW = f"(?:{_PREFIX}|推荐阅读|索引|附录|AR{_SP}模型).{{0,24}}\\d+"
_KEY = "CASE WHEN regexp_matches({x}, '^第" + _N + "章') THEN regexp_extract({x}, '^(第" + _N + "章)', 1) ELSE {x} END"


@query(
    f"WITH {_TITLES}, c AS (SELECT doc_id, num, raw, {S.clean_line('raw')} AS t, repeat(raw || chr(10), doc_id % 4) || CASE WHEN doc_id % 5 = 2 THEN '主编 王 版权 所有' || chr(10) ELSE '' END || CASE WHEN doc_id % 11 = 3 THEN '本章数字资源' || chr(10) ELSE '' END || left(text, 300 + doc_id % 3 * 300) AS content FROM t), "
    f"h AS (SELECT *, regexp_extract(t, '^{_SP}(?:[0-9]+[{S.SPACE}]+)?{_PREFIX}(.*)$', 1) AS rest, regexp_matches(t, '^{_SP}(?:[0-9]+[{S.SPACE}]+)?{_PREFIX}') AS lined, {S.clean_text('substr(content, 1, 1800)')} AS head, regexp_replace(t, '[{S.SPACE}]+', '', 'g') AS k FROM c), "
    f"r AS (SELECT *, regexp_replace(rest, '[{S.SPACE}]+', '', 'g') AS bare, len(regexp_extract_all(head, '{_PREFIX}')) AS chapters, len(regexp_extract_all(head, '{_ROW}')) AS listed, len(list_filter({_list(H.CATALOG)}, lambda w: contains(head, w))) AS marks, len(list_filter({_list(H.PUBLISHING)}, lambda w: contains(head, w))) AS published FROM h) "
    f"SELECT doc_id, (t = '' OR {_any('t', H.NOT_TITLE)} OR regexp_matches(t, '[。！？；;]') OR (lined AND (length(bare) > 22 OR regexp_matches(bare, '[0-9]')))) AS suspicious, "
    f"(length(raw) BETWEEN 1 AND 45 AND NOT {_any('raw', H.NOT_TITLE)} AND NOT regexp_matches(raw, '[。！？；;]') AND regexp_matches(raw, '^{_PREFIX}')) AS valid, regexp_matches(raw, '{_ROW}{_SP}$') AS catalogue, "
    f"(t <> '第' || num || '章' AND ({_KEY.format(x='k')}) = '第' || num || '章') AS detail, "
    "(NOT contains(head, '本章数字资源') AND ((length(head) < 500 AND chapters >= 1) OR chapters >= 2 OR marks >= 2 OR listed >= 2)) AS fragment, "
    f"(NOT contains(head, '本章数字资源') AND NOT (regexp_matches(t, '{_PREFIX}') AND NOT {_any('t', H.UNKNOWN)}) AND ({_any('t', H.UNKNOWN)} OR starts_with(t, '自动分段') OR published >= 2)) AS front FROM r"
)
def title_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's planted title and the chapter under it look like."""
    t, c = F.col("raw"), F.col("content")
    bare = F.concat(F.lit("第"), "num", F.lit("章"))
    return _titles(spark, sf_dir).select(
        "doc_id", H.is_suspicious(t).alias("suspicious"), H.is_valid_title(t).alias("valid"), H.is_catalog_row(t).alias("catalogue"), H.has_more_detail(t, bare).alias("detail"),
        H.is_catalog_fragment(c).alias("fragment"), H.is_front_matter(t, c).alias("front"),
    )


GOOD = ("抗原", "神经内分泌细胞", "骨骼肌", "动作电位", "肾小球滤过率", "上颌动脉", "外分泌腺", "leukocyte", "平滑肌", "静息电位")
BAD = ("主要症状", "感染", "解剖学", "有调节体温", "目录")
BEFORE = ("", "根据", "称为", "释放", "分化为", "第三章 ", "二、", "4.", "的", "在")
AFTER = ("", "可", "以翼外肌为标志可", "按形态可", "，", "是指一种状态", "导致的后果")


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN {_list(BAD)}[doc_id // 6 % {len(BAD)} + 1] ELSE {_list(BEFORE)}[doc_id // 7 % {len(BEFORE)} + 1] || {_list(GOOD)}[doc_id % {len(GOOD)} + 1] || {_list(AFTER)}[doc_id % {len(AFTER)} + 1] END AS raw, "
    f"CASE WHEN doc_id % 6 = 5 THEN {_list(BAD)}[doc_id // 6 % {len(BAD)} + 1] ELSE {_list(GOOD)}[doc_id % {len(GOOD)} + 1] END AS term, doc_id % 6 <> 5 AS ok FROM documents WHERE doc_id >= 0"
)
def chinese_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate planted into each document, what normalizing makes of it, and whether it is a concept."""
    made = F.concat(_pick(BEFORE, f"doc_id div 7 % {len(BEFORE)}"), _pick(GOOD, f"doc_id % {len(GOOD)}"), _pick(AFTER, f"doc_id % {len(AFTER)}"))
    raw = F.when(F.expr("doc_id % 6 = 5"), _pick(BAD, f"doc_id div 6 % {len(BAD)}")).otherwise(made)
    rows = table(spark, sf_dir, "documents").where("doc_id >= 0").select("doc_id", raw.alias("raw")).withColumn("term", T.normalize_term(F.col("raw")))
    return rows.withColumn("ok", T.term_ok(F.col("term")))


HEADS = ("静息", "动作", "体液", "血压", "的细胞", "神经", "个体", "炎症", "平滑", "ATP", "K", "", "有调节")
MIDS = ("", "的", "导致", "形成", "3", "（", "分泌", "与各种各样的", "是")
TAILS = ("电位", "调节", "反应", "受体", "屏障", "因子", "机制", "了", "和", "特点", "发育", "。", "肌", "出版社", "主编", "着", "", "中")
_EVIDENT = f"({_any('t', DEFAULT.hints)} OR t IN ({', '.join(map(S.quoted, DEFAULT.short_terms))}))"
_ENDING = f"(len(list_filter({_list(DEFAULT.suffixes)}, lambda w: ends_with(t, w))) > 0)"
_ALONE = "regexp_matches(t, '^[A-Za-z][A-Za-z0-9+\\-]{2,12}$')"
_COUNT = "(length(t) - length(replace(t, {x}, '')))"


@query(
    f"WITH j AS (SELECT doc_id, {_list(HEADS)}[doc_id % {len(HEADS)} + 1] || {_list(MIDS)}[doc_id % {len(MIDS)} + 1] || {_list(TAILS)}[doc_id // 3 % {len(TAILS)} + 1] AS t FROM documents WHERE doc_id >= 0), "
    f"e AS (SELECT *, length(t) AS n, {_EVIDENT} AS hinted, {_ENDING} AS ending, {_ALONE} AS alone, lower(t) IN ({', '.join(map(S.quoted, DEFAULT.english))}) AS listed, t IN ({', '.join(map(S.quoted, DEFAULT.not_terms))}) AS label FROM j) "
    f"SELECT doc_id, t AS term, CASE WHEN alone OR listed THEN NOT label AND (listed OR regexp_matches(t, '^(?:[A-Z]{{2,6}}[0-9]{{0,2}}|[A-Z]{{1,4}}[a-z]?[0-9]{{0,2}})$')) ELSE NOT ("
    f"n < 2 OR n > 18 OR label OR {_any('t', (*DEFAULT.clauses, *DEFAULT.publishing))} OR regexp_matches(t, '{T.INSTITUTION}') "
    f"OR len(list_filter({_list(DEFAULT.bad_starts)}, lambda w: starts_with(t, w))) > 0 OR len(list_filter({_list(DEFAULT.bad_ends)}, lambda w: ends_with(t, w))) > 0 "
    f"OR regexp_matches(t, '^[{T.STARTS}{T.TYPE_START}{T.FUNCTION_STARTS}{T.FRAGMENT_STARTS}{T.VERB_STARTS}]|[{T.PROTEIN_END}{T.FUNCTION_ENDS}{T.JOINING_ENDS}{T.ADVERB_ENDS}]$') OR regexp_matches(t, '^{T.ACTS}') "
    f"OR (NOT ending AND regexp_matches(t, '[{T.FRAGMENT_ENDS}]$')) OR (n > 5 AND regexp_matches(t, '(?:{'|'.join(T.DESCRIPTORS)})$')) OR (n >= 6 AND NOT ending AND regexp_matches(t, '[{T.LAST_OF_LONG}]$')) OR (n > 6 AND ends_with(t, '发育')) "
    f"OR {_any('t', T.VERBS)} OR (NOT ending AND {_any('t', T.LOOSE_VERBS)}) OR (n >= 6 AND NOT ending AND {_any('t', T.COPULAS)}) OR (contains(t, '的') AND n > 4 AND NOT {_any('t', T.DESCRIBED)}) OR {_COUNT.format(x=S.quoted('的'))} >= 2 "
    f"OR {_COUNT.format(x=S.quoted('（'))} <> {_COUNT.format(x=S.quoted('）'))} OR {_COUNT.format(x=S.quoted('('))} <> {_COUNT.format(x=S.quoted(')'))} OR regexp_matches(t, '[^一-龥A-Za-z0-9α-ωΑ-Ω（）()+\\-/%]') OR regexp_matches(t, '^[0-9]+$') "
    f"OR (regexp_matches(t, '^[A-Za-z]{{1,2}}[0-9]?$') AND t NOT IN ({', '.join(map(S.quoted, T.CHEMICALS))})) OR (regexp_matches(t, '[0-9]') AND regexp_matches(t, '[一-龥]')) "
    "OR (n > 8 AND NOT hinted AND NOT ending) OR (regexp_matches(t, '^[一-龥]{2,4}$') AND NOT hinted AND NOT ending) OR (n = 2 AND NOT hinted)) END AS ok FROM e"
)
def judged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a term planted into each document names a concept, as it stands."""
    made = F.concat(_pick(HEADS, f"doc_id % {len(HEADS)}"), _pick(MIDS, f"doc_id % {len(MIDS)}"), _pick(TAILS, f"doc_id div 3 % {len(TAILS)}"))
    rows = table(spark, sf_dir, "documents").where("doc_id >= 0").select("doc_id", made.alias("term"))
    return rows.withColumn("ok", T.term_ok(F.col("term"), normalized=True))


@query(
    f"WITH RECURSIVE poly AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8), "
    f"d AS (SELECT doc_id, ' ' || regexp_replace(text, '[{S.SPACE}]+', '', 'g') || ' ' AS w FROM documents), c AS (SELECT doc_id, unnest(l) AS ch, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(w, '') AS l FROM d WHERE length(w) > 2)), "
    "l AS (SELECT doc_id, ch || lead(ch) OVER o AS two, ch || lead(ch) OVER o || lead(ch, 2) OVER o AS three, ch || lead(ch) OVER o || lead(ch, 2) OVER o || lead(ch, 3) OVER o AS four FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)), "
    "g AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest([two, three, four]) AS g FROM l) WHERE g IS NOT NULL GROUP BY doc_id, g), "
    "u AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM g)), "
    "b AS (SELECT g, x, 0 AS pos, 4294967295::BIGINT AS c FROM u UNION ALL SELECT g, x, pos + 1, xor(b.c >> 8, p.c) FROM b JOIN (SELECT i, c FROM poly WHERE k = 8) p ON p.i = xor(b.c, ('0x' || substr(x, (2 * pos + 1)::BIGINT, 2))::BIGINT) & 255 WHERE 2 * pos < length(x)), "
    "s AS (SELECT g, (xor(c, 4294967295) % 4096)::INTEGER AS slot FROM b WHERE 2 * pos = length(x)), "
    "w AS (SELECT doc_id, slot, sum(n)::DOUBLE AS n FROM g JOIN s USING (g) GROUP BY doc_id, slot) SELECT doc_id, count(*) AS slots, max(slot)::BIGINT AS highest, sum(slot * n)::BIGINT AS placed, round(max(n) / sqrt(sum(n * n)), 6) AS largest FROM w GROUP BY doc_id"
)
def hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed character vectors of all documents, as their slots, the slots by count, and the largest weight."""
    v = vectors.hashed(table(spark, sf_dir, "documents"), "doc_id", "text")
    least = F.min(F.col("w"))
    n = v.groupBy("doc_id").agg(F.count("*").alias("slots"), F.max("slot").cast("long").alias("highest"), F.round(F.max("w"), 6).alias("largest"), F.sum(F.col("slot") * F.col("w")).alias("p"), F.sum("w").alias("sum"), least.alias("least"))
    grams = table(spark, sf_dir, "documents").select("doc_id", F.size(vectors.flat_grams(F.col("text"))).alias("grams"))
    return n.join(grams, "doc_id").select("doc_id", "slots", "highest", F.round(F.col("p") / F.col("sum") * F.col("grams")).cast("long").alias("placed"), "largest")
