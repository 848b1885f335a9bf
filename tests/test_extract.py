"""Candidate terms against a plain search with one pattern for each hint, and definitions inside a chapter's row."""

import math
import random
import re
import time
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quire.functions import terms as T
from quire.functions import text as X
from quire.lexicon import DEFAULT, LATIN, Lexicon
from quire.operators import extract as E

LETTERS = "[一-龥A-Za-z0-9]"
NAME = "[一-龥A-Za-z0-9（）()]{2,18}"


def contexts(text, hint):
    return [m.group(0).strip() for m in re.finditer(f"{LETTERS}{{0,6}}{re.escape(hint)}{LETTERS}{{0,6}}", text)]


def test_hint_contexts_are_those_of_a_pattern():
    rng = random.Random(91)
    for _ in range(4000):
        text = "".join(rng.choice("ab调节 ，x\n") for _ in range(rng.randint(0, 40)))
        for hint in ("a", "ab", "调节", "aba", "aa"):
            places = [i for i in range(len(text)) if text.startswith(hint, i)]
            assert E.hint_contexts(text, len(hint), places) == contexts(text, hint), (text, hint)


@pytest.mark.parametrize("lexicon", [DEFAULT, LATIN, Lexicon(hints=("电位", "位", "位差"), subject_verbs=("是", "是指"))])
def test_one_pass_finds_every_hint_and_name(lexicon):
    rng, scan = random.Random(92), E._scanner(lexicon)
    words = [*lexicon.hints[:12], *E.defining_verbs(lexicon), "膜", "电", "word", "  ", "　", "，", "\n", "x" * 25, " " * 90]
    verbs = "|".join(map(re.escape, E.defining_verbs(lexicon)))
    for _ in range(300):
        text = "".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        found, ends = scan(text)
        assert found == [c for h in dict.fromkeys(lexicon.hints) for c in contexts(text, h)]
        for _ in range(20):  # a term is defined if a verb follows it somewhere, after any white space
            a = rng.randint(0, max(0, len(text) - 2))
            term = text[a : a + rng.randint(1, 18)].strip()
            if term:
                assert any(e.endswith(term) for e in ends) == bool(re.search(f"{re.escape(term)}\\s*(?:{verbs})", text)), (text, term)


def plain_terms(spark, chapters, lexicon):
    """{chapter: its terms} of {chapter: (title, text)}, each candidate looked up in the whole text."""
    one = lambda words: "|".join(words)
    raw = {}
    for c, (title, text) in chapters.items():
        found = [re.sub("^(?:第.+章|第.+节)\\s*", "", title).strip()]
        for words, pattern in ((lexicon.subject_verbs, f"({NAME})\\s*(?:{one(lexicon.subject_verbs)})"), (lexicon.lead_words, f"(?:{one(lexicon.lead_words)})\\s*({NAME})"), (lexicon.object_verbs, f"({NAME})\\s*(?:{one(lexicon.object_verbs)})")):
            found += [m.group(1).strip() for m in re.finditer(pattern, text)] if words else []
        raw[c] = found + [x for h in dict.fromkeys(lexicon.hints) for x in contexts(text, h)]
    every = sorted({x for xs in raw.values() for x in xs})
    named = spark.createDataFrame([(x,) for x in every], "raw string").select("raw", T.normalize_term(F.col("raw"), lexicon).alias("t")).select("raw", "t", T.term_ok(F.col("t"), lexicon).alias("ok"))
    known = {r.raw: r.t for r in named.collect() if r.ok}
    out = {}
    for c, (_, text) in chapters.items():
        counts = Counter(known[x] for x in raw[c] if x in known)
        score = {}
        for t, n in counts.items():
            hint = any(h in t for h in lexicon.hints) or t in lexicon.short_terms
            defined = bool(re.search(f"{re.escape(t)}\\s*(?:{one(E.defining_verbs(lexicon))})", text))
            score[t] = (n + 2 * hint + 3 * defined, hint, defined, min(len(t), 8))
        kept = []
        for t in sorted(counts, key=lambda t: score[t], reverse=True):
            if not any(t in k or k in t for k in kept):
                kept.append(t)
        out[c] = kept[: E.TERMS]
    return out


def ranked(spark, chapters, lexicon):
    df = spark.createDataFrame([("b", c, title, text) for c, (title, text) in chapters.items()], "textbook_id string, chapter_id string, title string, text string")
    out = {c: [] for c in chapters}
    for r in sorted(E.candidate_terms(df.repartition(3), lexicon).collect(), key=lambda r: r.rank):
        assert len(out[r.chapter_id]) + 1 == r.rank
        out[r.chapter_id].append(r.term)
    return out


def test_terms_of_chinese_chapters(spark):
    rng = random.Random(93)
    parts = ["静息电位", "动作电位", "跨膜电位差", "神经调节", "体液调节", "血压", "炎症反应", "缺氧", "，", "。", "是指", "称为", "包括", "分为", "是", "所谓", "细胞", "在", "机体", "的", "ATP", " ", "\n"]
    chapters = {f"c{k}": (f"第{k}章 神经调节", "".join(rng.choice(parts) for _ in range(rng.randint(0, 400)))) for k in range(25)}
    got = ranked(spark, chapters, DEFAULT)
    assert got == plain_terms(spark, chapters, DEFAULT) and sum(map(len, got.values())) > 60


def test_terms_of_given_documents(spark):
    from quire.functions.text import clean_text

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", clean_text(F.col("text")).alias("text")).collect()
    chapters = {str(r.doc_id): (r.text.split("\n")[0][:40].strip(), r.text) for r in docs if r.text}
    got = ranked(spark, chapters, LATIN)
    assert got == plain_terms(spark, chapters, LATIN) and sum(map(len, got.values())) > 500


def test_a_chapter_of_many_candidates(spark):
    text = " ".join(f"term{k}x is thing{k} and" for k in range(10_000))
    began = time.time()
    got = ranked(spark, {"c": ("Many", text), "d": ("", ""), "e": ("None of it", "")}, LATIN)
    assert len(got["c"]) == E.TERMS and not got["d"] and time.time() - began < 60


def test_definitions_are_those_of_the_first_sentences(spark):
    text = "血压可以测量，记录下来也很有用。血压是指血管内血液对管壁的侧压力。动作电位在这里没有定义的句子。" + "填充句子用来让这一章足够长，它没有名词。" * 40
    chapters = spark.createDataFrame([("b", "c1", 1, "第一章 血压", text, 3)], "textbook_id string, chapter_id string, chapter_ord int, title string, content string, page_start int")
    books = spark.createDataFrame([("b", "书")], "textbook_id string, title string")
    nodes = {r.name: r for r in E.chapter_nodes(chapters, books).collect()}
    assert nodes["血压"].definition == "血压是指血管内血液对管壁的侧压力。" and nodes["血压"].source == "书, 第一章 血压, 第 3 页"
    assert [r["rank"] for r in sorted(nodes.values(), key=lambda r: r["rank"])] == list(range(1, len(nodes) + 1))


def test_names_before_verbs_are_those_of_the_pattern_and_no_text_is_matched_by_it(spark):
    rng = random.Random(9)
    words = ["a", "I", "abc", "is", "are", "was", "x" * 17, "y" * 18, "z" * 19, "q" * 40, "（a)", "细胞", "-", "a-b", ".", "has"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\u3000", "\u2003 ", ""]) for _ in range(60)) for _ in range(200)] + ["", "is is is is", "abc is is x"]
    pattern = f"(?U)({E.NAME})\\s*(?:{'|'.join(LATIN.subject_verbs)})"
    rows = spark.createDataFrame(list(enumerate(texts)), "chapter_id long, text string").selectExpr("'b' AS textbook_id", "cast(chapter_id AS string) AS chapter_id", "'t' AS title", "text")
    want = {r.chapter_id: r.w for r in rows.select("chapter_id", F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("w")).collect()}
    lexicon = replace(LATIN, object_verbs=(), lead_words=())
    assert {r.chapter_id: r.raw[1:] for r in E.raw_candidates(rows, lexicon).collect()} == want and sum(map(len, want.values())) > 100
    plan = E.raw_candidates(rows, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    assert not E.scanned(("是", "是指")) and not E.scanned((" is", " is ")) and not E.scanned((" a.b",))


def test_lines_and_cleaned_texts_are_judged_as_by_cleaning_all(spark):
    rng = random.Random(4)
    bits = ["第", "1", "2", "3", " 页", "/", "共", "\n", " ", "\u3000", "....", "·", "abc", "白细胞", "a", "\ufeff", "\x00", "目", "一、", "12345678901", "\ufffd", "\r\n", "\t", "\x85", "\u2028", "\x1c", "\x0b", "\x7f", "--", "Abcd e"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["第1第2页/共3页页/共3页", None]
    c = F.col("t")
    line, n = X.clean_line(c), F.length(X.clean_line(c))
    noise = (n == 0) | ((n <= 2) & ~line.rlike(f"[{X.CJK}A-Za-z]")) | line.rlike(X.TOC_LINE) | ((F.regexp_count(line, F.lit("(?U)\\d")) > 10) & (n < 40))
    whole = X.sub(X.sub(X.sub(X._scrubbed(c), "[\\t\\r\\f]+", " "), "[ \\u3000]{2,}", " "), "(?U)第\\s*\\d+\\s*页\\s*/\\s*共\\s*\\d+\\s*页")
    whole = X.sub(X.sub(X.sub(whole, X.LINE_BREAK, "\n"), X.LEADER.replace("\\s", X.BLANK), " "), "[ \\u3000]{2,}", " ")
    whole = X.strip(X.sub(X.sub(whole, f"(?Umd)^{X.BLANK}+|{X.BLANK}+$"), X.NOISE_LINES))
    once, twice = X.clean_text(c), X.clean_text(X.clean_text(c))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(noise.alias("a"), X.is_noise_line(c).alias("b"), twice.alias("c"), X.clean_again(once).alias("d"), whole.alias("e"), once.alias("f"), X.clean_short(c).alias("g")).collect()
    assert all(r.a == r.b and r.c == r.d and r.e == r.f == r.g for r in got) and len({r.a for r in got}) == 3


@pytest.mark.parametrize("known", [3, 40, 1000])
def test_keywords_are_the_best_by_exact_scores_however_few_frequencies_are_at_hand(spark, known):
    rng = random.Random(35)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice((5, 60, 300))]) for _ in range(rng.randint(0, 150))) for _ in range(60)] + ["", None]
    rows = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "textbook_id long, chapter_id string, content string")
    tf = {i: Counter((t or "").split()) for i, t in enumerate(texts)}
    df = Counter(w for c in tf.values() for w in c)
    want = {}
    for i, c in tf.items():
        score = {w: round(k / c.total() * (math.log((1 + len(texts)) / (1 + df[w])) + 1), 9) for w, k in c.items()}
        want[i] = sorted(c, key=lambda w: (-score[w], w))[:12]
    got = {}
    for r in E.keywords(rows, 12, known=known).orderBy("textbook_id", "rank").collect():
        got.setdefault(r.textbook_id, []).append(r.term)
    assert got == {i: w for i, w in want.items() if w}
    twice = E.keywords(spark.createDataFrame([(1, "c", "aa bb aa"), (1, "c", "cc")], rows.schema), known=known).collect()
    assert {r.term: round(r.score, 9) for r in twice} == {w: round(k / 3 * (math.log(3 / 2) + 1), 9) for w, k in (("aa", 2), ("bb", 1), ("cc", 1))}
    plan = E.keywords(rows, 12, known=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # a text's terms are neither counted nor looked up by a shuffle


def test_keywords_count_whole_texts(spark):
    rows = spark.createDataFrame([(1, "c", "aa " * 5000 + "bb " * 6000), (2, "c", "aa")], "textbook_id long, chapter_id string, content string")
    assert {(r.textbook_id, r.rank, r.term, round(r.score, 9)) for r in E.keywords(rows).collect()} == {(1, 1, "bb", round(6 / 11 * (math.log(3 / 2) + 1), 9)), (1, 2, "aa", round(5 / 11, 9)), (2, 1, "aa", 1.0)}
