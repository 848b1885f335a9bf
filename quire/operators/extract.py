"""Concept graphs of books: candidate terms of each chapter, ranked nodes, and rule edges."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import terms as T
from quire.functions.text import CJK, best_definition, best_sentence, clean_again, clean_line, clean_text, contains_any, is_noise_line, normalize_key, safe_id, split_sentences, strip, sub, tokenize
from quire.lexicon import DEFAULT, Lexicon
from quire.llm.shared import small_batches
from quire.operators.components import cut, once
from quire.operators.vectors import unique

#: How many terms, nodes and edges a chapter gives, and the edges' weights.
CONTEXT, TERMS, NODES, EDGES, CHAIN = 6, 20, 14, 35, 4
WEIGHTS = {"contains": 0.8, "parallel": 0.45, "applies_to": 0.55, "prerequisite": 0.65}
NAME = f"[{CJK}A-Za-z0-9（）()]{{2,18}}"
NAME_END = re.compile("[\u4e00-\u9fa5A-Za-z0-9（）()]{2,18}\\Z")
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")  # as Java's (?U)\\s
LETTER = re.compile("[\u4e00-\u9fa5A-Za-z0-9]")
LETTERS = re.compile("[\u4e00-\u9fa5A-Za-z0-9]*")
LONGEST, SPACES = 18, 64  # characters of a term; white space before a verb that is looked at before all of it is
CHAPTER_KEY = ["textbook_id", "chapter_id"]
#: Keywords of a chapter; what a model is shown and how many nodes and edges of its reply count.
KEYWORDS = 35
KNOWN = 100_000  # frequent terms that every task has, some 15 MB
SHOWN, MODEL_NODES, MODEL_EDGES, MODEL_IMPORTANCE = 8000, 18, 30, 0.75
REPLY = "nodes array<struct<name:string,definition:string,category:string,page:int>>, edges array<struct<source:string,target:string,relation_type:string,description:string>>"


def scanned(verbs: tuple[str, ...]) -> bool:
    """Whether names before these verbs are told by the verbs' places: a name ends before a blank, and no two verbs stand at one place."""
    return all(re.fullmatch(" \\w[\\w ]*", v) for v in verbs) and not any(a != b and b.startswith(a) for a in verbs for b in verbs)


def said_candidates(text: Column, title: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """array<array<string>> of candidates in order: the title and the terms before, after and before defining verbs.

    Those before verbs that are scanned() are left to said_names().
    """
    every = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), strip)
    none = F.array().cast("array<string>")
    before = lambda verbs: every(f"(?U)({NAME})\\s*(?:{'|'.join(verbs)})") if verbs and not scanned(verbs) else none
    lead = every(f"(?U)(?:{'|'.join(lexicon.lead_words)})\\s*({NAME})") if lexicon.lead_words else none
    return F.array(F.array(strip(sub(clean_line(title), "(?U)^(?:第.+章|第.+节)\\s*"))), before(lexicon.subject_verbs), lead, before(lexicon.object_verbs))


def said_names(text: str, verbs: list[tuple[int, int]]) -> list[str]:
    """The names before verbs, given by (start, end) from left to right: what the pattern NAME, white space, verb finds.

    A name has two to LONGEST characters and begins as far left as it may, but not inside the match before.
    """
    out, at = [], 0
    for p, end in verbs:
        q = p
        while q > at and text[q - 1] in WHITE:
            q -= 1
        name = NAME_END.search(text, max(at, q - LONGEST), q) if q - at >= 2 else None
        if name:
            out.append(name.group())
            at = end
    return out


def defining_verbs(lexicon: Lexicon = DEFAULT) -> tuple[str, ...]:
    """The verbs after a term that count as its definition."""
    return (*lexicon.subject_verbs, *lexicon.object_verbs[:2])


def hint_contexts(text: str, size: int, places: list[int]) -> list[str]:
    """What stands around a hint of some size: up to CONTEXT letters before and after, from left to right, no two overlapping.

    places are all places of the hint in text. A stretch begins as far left as it may; if the hint stands again within
    CONTEXT letters of there, the last of these is the one that it goes on from.
    """
    out, at, k = [], 0, 0
    while k < len(places):
        p = places[k]
        if p < at:
            k += 1
            continue
        start = p
        while start > at and p - start < CONTEXT and LETTER.match(text[start - 1]):
            start -= 1
        last, j = p, k + 1
        while j < len(places) and places[j] <= start + CONTEXT:
            if not LETTERS.fullmatch(text, start, places[j]):
                break
            last = places[j]
            j += 1
        end = last + size
        stop = end
        while stop < len(text) and stop - end < CONTEXT and LETTER.match(text[stop]):
            stop += 1
        out.append(text[start:stop].strip())
        at = stop
    return out


def _scanner(lexicon: Lexicon, names: bool = False):
    """text -> (the contexts of all hints, hint by hint; what stands before defining verbs), by one pass of an automaton; with
    names also [the said_names() of subject verbs, of object verbs]."""
    import ahocorasick

    hints, verbs, found = list(dict.fromkeys(lexicon.hints)), set(defining_verbs(lexicon)), ahocorasick.Automaton()
    groups = [set(g) if names and scanned(g) else set() for g in (lexicon.subject_verbs, lexicon.object_verbs)]
    for w in {*hints, *verbs, *groups[0], *groups[1]} - {""}:
        found.add_word(w, w)
    if len(found):
        found.make_automaton()

    def scan(text: str) -> tuple:
        places: dict[str, list[int]] = {}
        ends: dict[str, None] = {}
        said: list[list[tuple[int, int]]] = [[], []]
        for e, w in found.iter(text) if len(found) else ():
            p = e - len(w) + 1
            places.setdefault(w, []).append(p)
            for g, own in zip(groups, said):
                if w in g:
                    own.append((p, e + 1))
            if w in verbs:
                q = len(text[max(0, p - SPACES) : p].rstrip()) + max(0, p - SPACES)
                if q == max(0, p - SPACES):
                    q = len(text[:p].rstrip())
                ends[text[max(0, q - LONGEST) : q]] = None
        near = [c for h in hints if h in places for c in hint_contexts(text, len(h), places[h])]
        return (near, list(ends), [said_names(text, sorted(x)) for x in said]) if names else (near, list(ends))

    return scan


def raw_candidates(chapters: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(textbook_id, chapter_id, raw, ends) of chapters (textbook_id, chapter_id, title, text): candidates in order, and
    what stands before the defining verbs. Each text is read once for all hints and verbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(lexicon, names=True)
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                found = [scan(t) for t in part.column(2).to_pylist()]
                raw = [[*title, *(before or x), *lead, *(about or y), *c] for (title, before, lead, about), (c, _, (x, y)) in zip(part.column(3).to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(raw, pa.list_(pa.string())), pa.array([e for _, e, _ in found], pa.list_(pa.string()))], names=[*CHAPTER_KEY, "raw", "ends"])

    rows = chapters.select(*(F.col(c).cast("string").alias(c) for c in CHAPTER_KEY), F.coalesce("text", F.lit("")).alias("text"), said_candidates(F.coalesce("text", F.lit("")), F.col("title"), lexicon).alias("said"))
    return rows.mapInArrow(run, "textbook_id string, chapter_id string, raw array<string>, ends array<string>")


def candidate_terms(chapters: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(textbook_id, chapter_id, rank, term): up to TERMS accepted terms of a chapter, best first, none inside another.

    chapters have content, or text, its clean form. Terms are normalized and judged once per distinct candidate, whatever
    the number of chapters that have it. A chapter's text is not joined with its terms: which of them are defined is told
    by what stands before its verbs.
    """
    ranked = ranked_terms(chapters if "text" in chapters.columns else chapters.withColumn("text", clean_text(F.col("content"))), lexicon)
    return ranked.select(*CHAPTER_KEY, F.posexplode("terms").alias("rank", "term")).withColumn("rank", F.col("rank") + 1)


def ranked_terms(chapters: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(textbook_id, chapter_id, terms) of chapters (textbook_id, chapter_id, title, text)."""
    read = cut(raw_candidates(chapters, lexicon))
    found = read.select(*CHAPTER_KEY, F.posexplode("raw").alias("pos", "raw"))
    known = once(found.select("raw").distinct(), "term", T.normalize_term(F.col("raw"), lexicon))  # or candidates would be judged before they are distinct
    known = cut(known.where(T.term_ok(F.col("term"), lexicon)))
    counted = found.join(known, "raw").groupBy(*CHAPTER_KEY, "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    listed = counted.groupBy(*CHAPTER_KEY).agg(F.collect_list(F.struct("term", "n", "pos")).alias("found"))  # of one text
    ends = F.flatten(F.transform("ends", lambda e: F.transform(F.sequence(F.lit(1), F.length(e)), lambda n: F.substring(e, n, F.lit(LONGEST)))))
    rows = once(listed.join(read.select(*CHAPTER_KEY, "ends"), CHAPTER_KEY), "defined", F.array_intersect("found.term", F.when(F.size("ends") > 0, ends).otherwise(F.array().cast("array<string>"))))
    down = F.transform("found", lambda f: T.falling_score(f["term"], f["n"], F.array_contains("defined", f["term"]), f["pos"], lexicon))

    def keep(acc: Column, t: Column) -> Column:
        return F.when((F.size(acc) >= TERMS) | F.exists(acc, lambda r: r.contains(t) | t.contains(r)), acc).otherwise(F.concat(acc, F.array(t)))

    ordered = rows.select(*CHAPTER_KEY, F.transform(F.array_sort(down), lambda x: x["term"]).alias("all"))
    return ordered.select(*CHAPTER_KEY, F.aggregate("all", F.array().cast("array<string>"), keep).alias("terms"))


def keywords(chapters: DataFrame, most: int = KEYWORDS, known: int = KNOWN) -> DataFrame:
    """(textbook_id, chapter_id, rank, term, score): the best tokens of a chapter's whole text by TF-IDF over the chapters.

    A chapter's tokens are counted inside its row. The most frequent terms, `known` at most, are at hand there with their
    frequency; any other term is no more frequent than the rarest of them, which bounds its score from both sides. Terms
    that can't be among the chapter's best leave, and only what is left of the others is joined with its frequency.
    """
    small_batches(chapters.sparkSession)  # a row has all tokens of a text
    tokens = chapters.select(*CHAPTER_KEY, tokenize(F.col("content")).alias("t")).withColumn("n", F.size("t"))
    if not unique(chapters, *CHAPTER_KEY):  # rows of one chapter are counted together, by the longest's length
        tokens = tokens.groupBy(*CHAPTER_KEY).agg(F.flatten(F.collect_list("t")).alias("t"), F.max("n").alias("n"))
    total, n_terms = chapters.count(), F.count("*").alias("df")
    df = cut(tokens.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(n_terms))
    common = df.orderBy(F.desc("df"), "term").limit(known).collect()  # bounded
    table = chapters.sparkSession.sparkContext.broadcast({r.term: r.df for r in common})
    rarest = common[-1].df if len(common) == known else 0  # 0: all terms are known
    idf = lambda n: math.log((1 + total) / (1 + n)) + 1
    high, low = idf(1), idf(max(1, rarest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = {t: idf(n) for t, n in table.value.items()} if total else {}
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                rows, out = [], []
                for j, (t, n) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    tf = {w: c / n for w, c in Counter(t or ()).items()}
                    least = sorted((round(f * weight.get(w, low), 9) for w, f in tf.items()), reverse=True)[:most]
                    bar = (least[-1] if len(least) == most else 0.0) - 1e-8  # the last of the best reaches it; what rounding may change
                    best = [(w, f, table.value.get(w)) for w, f in tf.items() if f * weight.get(w, high) >= bar]
                    rows += [j] * len(best)
                    out += best
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64())))], names=[*CHAPTER_KEY, "term", "tf", "df"])

    kinds = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in CHAPTER_KEY)
    rows = tokens.mapInArrow(run, f"{kinds}, term string, tf double, df long")
    if rarest:
        rows = cut(rows)
        rows = rows.where("df IS NOT NULL").unionByName(rows.where("df IS NULL").drop("df").join(df, "term").select(rows.columns))
    scored = rows.withColumn("score", F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1))
    rank = F.row_number().over(W.partitionBy(*CHAPTER_KEY).orderBy(F.round("score", 9).desc(), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select(*CHAPTER_KEY, "rank", "term", "score")


def json_object(reply: Column) -> Column:
    """The JSON object in a model's reply: the reply itself if it is one, else what its outermost braces hold, else null."""
    text = strip(reply)
    inner = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    valid = lambda c: F.when(c.startswith("{") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(text), valid(inner))


def model_graphs(chapters: DataFrame, books: DataFrame, ask: Callable[[str, str, str], str | None], lexicon: Lexicon = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a model of your own finds: ask(book title, chapter title, text) returns JSON with nodes and edges.

    It is shown the first SHOWN characters. Names are normalized and judged as those of rules are; edges count if both
    ends are nodes and their relation is known. Chapters without a usable reply have no rows: use the rules for them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = []
            for row in zip(b["textbook_title"], b["title"], b["shown"]):
                try:
                    said.append(ask(*row) or None)
                except Exception:  # a service that fails leaves the chapter to the rules
                    said.append(None)
            yield b.drop(columns="shown").assign(reply=said)

    rows = chapters.join(books.select("textbook_id", F.col("title").alias("textbook_title")), "textbook_id").select(*CHAPTER_KEY, "chapter_ord", "title", "page_start", "textbook_title", "content")
    shown = rows.drop("content").withColumn("shown", F.lit("")).schema
    asked = rows.withColumn("shown", F.left("content", F.lit(SHOWN))).drop("content")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown if f.name != "shown")
    said = cut(asked.mapInPandas(run, f"{schema}, reply string")).withColumn("r", F.from_json(json_object(F.col("reply")), REPLY))
    named = said.select(*CHAPTER_KEY, "chapter_ord", "title", "page_start", "textbook_title", F.posexplode(F.slice("r.nodes", 1, MODEL_NODES)).alias("pos", "n"))
    named = named.withColumn("name", T.normalize_term(F.coalesce("n.name", F.lit("")), lexicon)).where(T.term_ok(F.col("name"), lexicon))
    named = named.withColumn("turn", F.row_number().over(W.partitionBy(*CHAPTER_KEY, "name").orderBy("pos"))).where("turn = 1")
    text = chapters.select(*CHAPTER_KEY, "content")
    named = named.join(text, CHAPTER_KEY).withColumn("definition", F.coalesce(F.nullif("n.definition", F.lit("")), best_definition(F.col("name"), F.col("content"))))
    nodes = named.select(
        "textbook_id", "chapter_id", "chapter_ord", safe_id("node", F.concat_ws(":", "textbook_id", "chapter_id", "name")).alias("id"), "name", T.clean_definition(F.col("name"), F.col("definition"), lexicon).alias("definition"),
        clean_line(F.coalesce(F.nullif("n.category", F.lit("")), F.lit("核心概念"))).alias("category"), clean_line(F.col("title")).alias("chapter"), F.coalesce(F.nullif("n.page", F.lit(0)), "page_start").alias("page"), "textbook_title",
        F.format_string("%s, %s, 第 %d 页", "textbook_title", "title", "page_start").alias("source"), F.lit(1).alias("frequency"), F.array().cast("array<string>").alias("aliases"), F.lit(MODEL_IMPORTANCE).alias("importance"),
    )
    edges = said.select(*CHAPTER_KEY, F.posexplode(F.slice("r.edges", 1, MODEL_EDGES)).alias("edge_ord", "e")).where(F.col("e.relation_type").isin(list(WEIGHTS)))
    ids = nodes.select(*CHAPTER_KEY, "name", "id")
    ends = edges.join(ids.select(*CHAPTER_KEY, F.col("name").alias("s"), F.col("id").alias("source")), CHAPTER_KEY).where("e.source = s")
    ends = ends.join(ids.select(*CHAPTER_KEY, F.col("name").alias("t"), F.col("id").alias("target")), CHAPTER_KEY).where("e.target = t")
    return nodes, ends.select("textbook_id", "chapter_id", "edge_ord", "source", "target", F.col("e.relation_type").alias("relation_type"), F.coalesce("e.description", F.lit("")).alias("description"), F.lit(1.0).alias("weight"))


def chapter_nodes(chapters: DataFrame, books: DataFrame, lexicon: Lexicon = DEFAULT, cleaned: bool = False) -> DataFrame:
    """Nodes of the chapters that are extractable, before names are judged again; with chapter_ord, chapter_id and rank.

    cleaned: content is what clean_text() has made.
    """
    keys = [*CHAPTER_KEY, "chapter_ord", "title", "page_start"]
    clean = once(chapters.select(*keys, "content"), "text", (clean_again if cleaned else clean_text)(F.col("content")))
    good = cut(clean.where(T.chapter_is_extractable(F.col("title"), F.col("content"), lexicon, F.col("text"))).drop("content"))
    ranked = ranked_terms(good, lexicon).withColumn("terms", F.slice("terms", 1, NODES))
    rows = once(good.join(ranked, CHAPTER_KEY), "sentences", F.filter(split_sentences(F.col("text")), lambda s: ~is_noise_line(s)))
    # A chapter's sentences meet its terms inside its row; only terms and definitions leave it.
    named = F.transform("terms", lambda t, k: F.struct((k + 1).alias("rank"), t.alias("term"), best_sentence(t, F.col("sentences"), F.col("text")).alias("definition")))
    rows = rows.select(*keys, F.explode(named).alias("t")).select(*keys, "t.*")
    rows = rows.join(books.select("textbook_id", F.col("title").alias("textbook_title")), "textbook_id")
    rows = rows.withColumn("definition", T.clean_definition(F.col("term"), F.col("definition"), lexicon))
    return rows.select(
        "textbook_id", "chapter_id", "chapter_ord", "rank", "title",
        safe_id("node", F.concat_ws(":", "textbook_id", "chapter_id", "term")).alias("id"), F.col("term").alias("name"), "definition",
        T.category(F.col("term"), F.col("definition")).alias("category"), clean_line(F.col("title")).alias("chapter"), F.col("page_start").alias("page"), "textbook_title",
        F.format_string("%s, %s, 第 %d 页", "textbook_title", "title", "page_start").alias("source"), F.lit(1).alias("frequency"),
        F.array().cast("array<string>").alias("aliases"), F.greatest(F.lit(0.2), 1 - F.col("rank") / 20).alias("importance"),
    )


def rule_edges(nodes: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(textbook_id, chapter_ord, ord, source, target, relation_type, description, weight) inside each chapter."""
    root = nodes.where("rank = 1").select(*CHAPTER_KEY, F.col("id").alias("root"), F.col("name").alias("root_name"))
    rooted = nodes.join(root, CHAPTER_KEY)

    def edge(rows: DataFrame, order: Column, source: str, target: str, kind: str, text: Column) -> DataFrame:
        return rows.select("textbook_id", "chapter_id", "chapter_ord", order.alias("ord"), F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("relation_type"), text.alias("description"), F.lit(WEIGHTS[kind]).alias("weight"))

    below = edge(rooted.where(F.col("rank").between(2, 8)), F.col("rank"), "root", "id", "contains", F.format_string("“%s”中的核心主题“%s”包含或统摄“%s”。", "title", "root_name", "name"))
    b = nodes.where(F.col("rank").between(2, 7)).select(*CHAPTER_KEY, F.col("category"), F.col("rank").alias("rank_b"), F.col("id").alias("id_b"), F.col("name").alias("name_b"))
    pairs = nodes.where(F.col("rank").between(2, 7)).join(b, [*CHAPTER_KEY, "category"]).where("rank < rank_b")
    beside = edge(pairs, 100 + F.col("rank") * 10 + F.col("rank_b"), "id", "id_b", "parallel", F.format_string("“%s”与“%s”均属于%s层级。", "name", "name_b", "category"))
    used = edge(rooted.where(contains_any(F.col("definition"), lexicon.applied)), 1000 + F.col("rank"), "id", "root", "applies_to", F.format_string("“%s”可用于解释“%s”相关临床或应用场景。", "name", "root_name"))
    rows = below.unionByName(beside).unionByName(used)
    n = F.row_number().over(W.partitionBy(*CHAPTER_KEY).orderBy("ord"))
    return rows.withColumn("ord", n).where(F.col("ord") <= EDGES)


def prerequisites(nodes: DataFrame) -> DataFrame:
    """Edges along the CHAIN most important nodes of each chapter title, in order."""
    by = W.partitionBy("textbook_id", "chapter").orderBy(F.desc("importance"), "node_ord")
    rows = nodes.withColumn("n", F.row_number().over(by)).where(F.col("n") <= CHAIN)
    rows = rows.withColumn("next", F.lead("id").over(by)).withColumn("next_name", F.lead("name").over(by)).where("next is not null")
    first = F.min("node_ord").over(W.partitionBy("textbook_id", "chapter"))
    return rows.select("textbook_id", (first * 10 + F.col("n")).alias("ord"), F.col("id").alias("source"), F.col("next").alias("target"), F.lit("prerequisite").alias("relation_type"), F.format_string("学习“%s”通常需要先理解“%s”。", "next_name", "name").alias("description"), F.lit(WEIGHTS["prerequisite"]).alias("weight"))


def first_edges(edges: DataFrame, order: str, by: tuple[str, ...] = ("textbook_id",)) -> DataFrame:
    """Edges without self loops, the first of each (source, target, relation)."""
    n = F.row_number().over(W.partitionBy(*by, "source", "target", "relation_type").orderBy(order))
    return edges.where("source <> target").withColumn("__n", n).where("__n = 1").drop("__n")


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (of their book)."""
    ids = nodes.select("textbook_id", F.col("id").alias("source")).distinct()
    return edges.join(ids, ["textbook_id", "source"], "left_semi").join(ids.withColumnRenamed("source", "target"), ["textbook_id", "target"], "left_semi")


def build_graphs(chapters: DataFrame, books: DataFrame, lexicon: Lexicon = DEFAULT, cleaned: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all books: NODES and EDGES columns but graph_ord; cleaned: the chapters' content is what clean_text() has made."""
    raw = cut(chapter_nodes(chapters, books, lexicon, cleaned))
    edges = rule_edges(raw, lexicon)
    named = raw.withColumn("name", T.normalize_term(F.col("name"), lexicon)).where(T.term_ok(F.col("name"), lexicon))
    order = W.partitionBy("textbook_id").orderBy("chapter_ord", "rank")
    named = named.withColumn("key", normalize_key(F.col("name"))).withColumn("seen", F.row_number().over(W.partitionBy(*CHAPTER_KEY, "key").orderBy("rank"))).where("seen = 1")
    nodes = named.withColumn("node_ord", F.row_number().over(order)).drop("key", "seen", "rank", "title", "chapter_ord")
    inner = edges.select("textbook_id", (F.col("chapter_ord").cast("long") * 1000 + F.col("ord")).alias("ord"), "source", "target", "relation_type", "description", "weight")
    chain = prerequisites(nodes).withColumn("ord", F.col("ord").cast("long") + (1 << 40))
    kept = first_edges(live_edges(inner.unionByName(chain), nodes), "ord")
    kept = kept.withColumn("edge_ord", F.row_number().over(W.partitionBy("textbook_id").orderBy("ord"))).drop("ord")
    return nodes, kept
