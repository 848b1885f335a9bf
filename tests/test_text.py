import time

from pyspark.sql import functions as F

from quire.functions import terms as T
from quire.functions import text as X
from quire.functions import titles as H
from quire.lexicon import Lexicon
from quire.operators import graphview, segment


def row(spark, **columns):
    return tuple(spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first())


def test_cleaning_and_tokens(spark):
    raw = F.lit("a\tb ......... 12\n第一章 绪论   5\n\n12345678901234\n第 3 页 / 共 9 页\nok　　x")
    got = row(
        spark, a=X.clean_text(raw), b=X.clean_text(F.lit("")), c=X.clean_text(F.lit(None).cast("string")), d=X.tokenize(F.lit("细胞 稳态 a ab 以及 稳态")),
        e=X.split_sentences(F.lit("这是一个很长的句子哦。短句！another long sentence here; x")), f=X.normalize_key(F.lit(" Leuko-cyte ")), g=X.normalize_key(F.lit("炎症反应")),
        h=X.char_overlap(F.lit("abc"), F.lit("bcde")), i=X.char_overlap(F.lit(""), F.lit("x")), j=X.file_name(F.lit(' a/b:c ')), k=X.file_name(F.lit("  ")), l=X.thousands(F.lit("1234567")), m=X.thousands(F.lit("x")),
    )
    assert got == ("a b 12\nok x", "", None, ["稳态", "ab", "稳态"], ["这是一个很长的句子哦。", "another long sentence here;"], "白细胞", "炎症", 2 / 3, 0.0, "a_b_c", "未命名", "1,234,567", "x")


def test_definitions_prefer_defining_sentences(spark):
    text = F.lit("我们先来谈一谈稳态这个词。稳态是指内环境的理化性质相对稳定。其他内容在这里继续。")
    got = row(spark, a=X.best_definition(F.lit("稳态"), text), b=X.best_definition(F.lit("反射"), text), c=T.clean_definition(F.lit("稳态"), F.lit("另一类是  稳态的\n定义在此处说明")))
    assert got == ("稳态是指内环境的理化性质相对稳定。", "我们先来谈一谈稳态这个词。稳态是指内环境的理化性质相对稳定。其他内容在这里继续。", "稳态的 定义在此处说明")


def test_terms(spark):
    repaired = {"根据抗原": "抗原", "释放顶体酶": "顶体酶", "又称腰方肌筋膜quadra": "腰方肌筋膜", "上颌动脉以翼外肌为标志可": "上颌动脉", "细胞黏附分子又": "细胞黏附分子"}
    good = ["动作电位", "肾小球滤过率", "弥散性血管内凝血", "半乳甘露聚糖（GM）抗原", "人类免疫缺陷病毒", "leukocyte", "肾小管重吸收"]
    bad = ["主要症状", "感染", "第八章", "有调节体温", "并分泌到血液循环中", "中段发育为气管", "静脉血氧含量差减", "认知障碍尤其", "a", "12", "大学"]
    rows = spark.createDataFrame([(x,) for x in [*repaired, *good, *bad]], "t string").select("t", T.normalize_term(F.col("t")).alias("n"), T.term_ok(F.col("t")).alias("ok")).collect()
    got = {r.t: r for r in rows}
    assert {x: got[x].n for x in repaired} == repaired
    assert [x for x in [*repaired, *good] if not got[x].ok] == []
    assert [x for x in bad if got[x].ok] == []


def test_lexicon_lists_are_parameters(spark):
    own = Lexicon.from_json('{"not_terms": ["动作电位"]}')
    assert row(spark, a=T.term_ok(F.lit("动作电位"), own), b=T.term_ok(F.lit("动作电位"))) == (False, True)


def test_indel_ratio_is_not_levenshtein(spark):
    got = spark.createDataFrame([("ab", "ba"), ("b a", "a b"), ("", ""), ("abc", "")], "a string, b string").select(T.indel_ratio("a", "b")).collect()
    assert [r[0] for r in got] == [0.5, 1.0, 1.0, 0.0]


def test_titles(spark):
    got = row(spark, a=H.normalize_title(F.lit("第七章 上 肢本章数字资源")), b=H.chapter_key(F.lit("第 七 章 上肢")), c=H.chapter_number(F.lit("第二十三章")), d=H.chapter_number(F.lit("绪论")), e=H.has_more_detail(F.lit("第七章 上肢"), F.lit("第七章")), f=H.is_suspicious(F.lit("参见第三章。")), g=H.is_heading(F.lit("Chapter 3: Shock")))
    assert got == ("第七章 上肢", "第七章", 23, 0, True, True, True)


def test_title_scan():
    from quire.functions.titlescan import infer

    assert infer(["第七章 上", "肢", "本章数字资源", "第一节 | 概 述", "上肢连于胸廓外上部。"]) == "第七章 上肢"
    assert infer(["本章数字资源", "第十三章  休", "克", "休克是指机体在严重失血等强烈致病因子作用下的反应。"]) == "第十三章 休克"
    assert infer(["对肺鼠疫的严格隔离、", "2. 消毒 参见第三章。", "三", "保护易感人群"]) is None
    assert infer([]) is None and infer(["绪", "论", "本章数字资源"]) == "绪论"


def test_windows_cover_the_text(spark):
    text = "这是一个测试句子。" * 120
    for t, size, overlap in ((text, 120, 20), ("x" * 2000, 700, 80), ("short", 700, 80), ("", 700, 80)):
        w = spark.createDataFrame([(t,)], "t string").select(segment.windows(F.col("t"), size, overlap).alias("w")).first().w
        assert bool(w) == bool(t)
        if t:
            assert w[0].start == 0 and w[-1].end == len(t)
            assert all(b.start <= a.end and a.end - a.start <= size and b.end > a.end for a, b in zip(w, w[1:]))
    assert len(w) == 0


def test_windows_of_a_long_text_take_time_in_proportion(spark):
    """A text of four million characters: a window is cut where the last one ended, not by walking there from the start."""
    text = "".join(f"Sentence {i} of many;" if i % 3 else f"第{i}句。\n" for i in range(220_000))
    begun = time.monotonic()
    rows = segment.chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), ["doc_id"], "text", clean=False).collect()
    assert time.monotonic() - begun < 30
    assert all(text[r.start : r.end] == r.text for r in rows) and rows[-1].end == len(text) and {r.doc_id for r in rows} == {1}
    assert all(b.start == a.end - 80 and 455 < a.end - a.start <= 700 for a, b in zip(rows, rows[1:])) and len(rows) > 5000


def test_display_functions(spark):
    def palette(s, size):
        h = 7
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h) % size

    got = row(spark, a=graphview.palette_index(F.lit("book_abcdef"), 9), b=graphview.shorten(F.lit("abcdefghijklmnop")), c=graphview.natural_key(F.lit("A10")), d=graphview.natural_key(F.lit("a9")), e=graphview.file_size(F.lit(2048)))
    assert got[0] == palette("book_abcdef", 9) and got[1] == "abcdefghijkl..." and got[3] < got[2] and got[4] == "2.0 KB"


def test_lines_are_looked_at_only_where_a_table_of_contents_can_be(spark, monkeypatch):
    """Prose without any mark of a table of contents is told by the whole text, with the result of the lines."""
    leaders = "\n".join(f"Chapter {i} ..... {i}" for i in range(5))
    texts = ["Plain prose. Of lines\nand - dashes.\n" * 3, leaders, "目录\nx", "第一章 甲\n第二章 乙\n第三章 丙", "a ---- b", "", None, "第﻿一章 a\n第二章 b\n第三章 c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = {r.i: r.toc for r in rows.select("i", X.looks_like_toc_page(F.col("t")).alias("toc")).collect()}
    assert [out[i] for i in range(8)] == [False, True, True, True, False, False, None, True]
    monkeypatch.setattr(X, "lines_of", lambda c: F.array(F.raise_error(F.lit("lines were read")).cast("string")))
    assert rows.where("i = 0").select(X.looks_like_toc_page(F.col("t")).alias("toc")).first().toc is False


def test_only_sentences_with_the_term_are_asked_whether_they_are_noise(spark, monkeypatch):
    asked = X.is_noise_line
    monkeypatch.setattr(X, "is_noise_line", lambda c, cleaned=False: F.when(c.contains("other"), F.raise_error(F.lit("asked")).cast("boolean")).otherwise(asked(c, cleaned)))
    rows = spark.createDataFrame([("Some other words here! The term is defined here! More of other things!",)], "t string")
    assert rows.select(X.best_definition(F.lit("term"), F.col("t"), (" is ",)).alias("d")).first().d == "The term is defined here!"


def test_a_chapters_clean_text_is_made_once(spark):
    rows = spark.createDataFrame([("word " * 200,)], "t string")
    found = rows.select(T.chapter_is_extractable(F.lit("x"), F.col("t"), Lexicon(hints=(), publishing=("a", "b"), min_chapter=500)).alias("good"))
    assert found._jdf.queryExecution().analyzed().toString().count(X.NOISE_LINES[:12]) == 1
    assert found.first().good
