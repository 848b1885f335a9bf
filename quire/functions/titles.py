"""Chapter titles: keys, normal form, and the tests that tell titles from catalogue rows and body lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import NUMERAL, clean_line, clean_text, collapse, contains_any, count_of, strip, sub

# Fixed values from here to TITLE: markers of resources, sections and publishing matter, the patterns of titles, and their limits.
RESOURCES = "本章数字资源"
STOP_MARKERS = ("本章数字资源", "学习目标", "本章思维导图", "推荐阅读", "中英文名词对照索引", "附录", "数字特色", "AR 模型")
CATALOG = ("推荐阅读", "中英文名词对照索引", "附录", "数字特色", "AR 模型")
NOT_TITLE = ("目录", "推荐阅读", "索引", "附录", "AR 模型", "数字特色")
PUBLISHING = ("规划教材", "人民卫生出版社", "主编", "副主编", "版权", "目录", "编写", "修订")
UNKNOWN = ("未识别", "未命名")

N = f"[{NUMERAL}\\d]+"
PREFIX = f"第\\s*{N}\\s*章"
HEADING = f"(?iU)^\\s*(?:{PREFIX}[\\s\\u3000：:、.-]*.{{0,40}}|Chapter\\s+\\d+\\s*[:.\\-\\s].{{0,60}})\\s*$"
TITLE_LINE = f"(?U)^\\s*(?:\\d+\\s+)?({PREFIX})(.*)$"
SECTION = f"(?U)^\\s*(?:第\\s*{N}\\s*节|[一二三四五六七八九十]+、|\\d+[\\.、])"
CATALOG_ROW = f"(?U)(?:{PREFIX}|推荐阅读|索引|附录|AR\\s*模型).{{0,24}}\\d+"
REST, BODY, TITLE = 22, 30, 45  # characters after a title's number, of a body line at least, of a title


def is_heading(c: Column) -> Column:
    return c.rlike(HEADING)


def chapter_key(c: Column) -> Column:
    """第…章 without spaces, else the whole title without spaces."""
    key = collapse(clean_line(c), "")
    found = F.regexp_extract(key, f"(?U)^(第{N}章)", 1)
    return F.when(found != "", found).otherwise(key)


def normalize_title(c: Column) -> Column:
    """A title in one form: 第…章, one space, the name, without what follows on the page."""
    t = strip(collapse(clean_line(c)))
    t = sub(t, f"(?U)(第)\\s*({N})\\s*(章)", "$1$2$3 ")
    t = F.get(F.split(t, "(?U)\\s*(?:本章数字资源|学习目标|本章思维导图|第一节|第二节|一、|二、)", 2), F.lit(0))
    t = sub(t, "(?U)(?<=[\\u4e00-\\u9fa5])\\s+(?=[\\u4e00-\\u9fa5])")
    t = sub(t, f"(?U)(第{N}章)(.+?)\\s+\\2.+$", "$1$2")
    t = sub(collapse(t), "^[ ：:、.-]+|[ ：:、.-]+$")
    return strip(sub(t, f"(?U)(第{N}章)\\s*", "$1 "))


def has_more_detail(candidate: Column, current: Column) -> Column:
    """Whether candidate is the same chapter's title, and fuller."""
    a, b = clean_line(candidate), clean_line(current)
    bare = b.rlike(f"(?U)^{PREFIX}\\s*$") | b.rlike(f"(?U)^{PREFIX}\\s*[上下中]$")
    return (a != "") & (a != b) & (chapter_key(a) == chapter_key(b)) & (bare | (F.length(a) >= F.length(b) + 2))


def is_suspicious(c: Column) -> Column:
    """Whether a title looks like something else: a catalogue row, a sentence, or an overlong name."""
    t = clean_line(c)
    rest = collapse(F.regexp_extract(t, TITLE_LINE, 2), "")
    odd = t.rlike(TITLE_LINE) & ((F.length(rest) > REST) | rest.rlike("(?U)\\d"))
    return (t == "") | contains_any(t, NOT_TITLE) | t.rlike("[。！？；;]") | odd


def is_catalog_row(c: Column) -> Column:
    return c.rlike(CATALOG_ROW + "\\s*$")


def is_body_line(c: Column) -> Column:
    return (F.length(c) > BODY) | c.rlike("[。！？；;]")


def is_stop_line(c: Column) -> Column:
    return c.rlike("(?U)^\\d+$") | contains_any(c, STOP_MARKERS) | c.rlike(SECTION)


def is_valid_title(c: Column) -> Column:
    return (F.length(c) > 0) & (F.length(c) <= TITLE) & ~contains_any(c, NOT_TITLE) & ~c.rlike("[。！？；;]") & c.rlike(f"(?U)^{PREFIX}")


def is_catalog_fragment(content: Column) -> Column:
    """Whether a chapter's content is a piece of a catalogue."""
    head = clean_text(F.substring(content, 1, 1800))
    chapters = F.regexp_count(head, F.lit(f"(?U){PREFIX}"))
    rows = F.regexp_count(head, F.lit(CATALOG_ROW))
    short = (F.length(head) < 500) & (chapters >= 1)
    return ~F.contains(head, F.lit(RESOURCES)) & (short | (chapters >= 2) | (count_of(head, CATALOG) >= 2) | (rows >= 2))


def is_front_matter(title: Column, content: Column) -> Column:
    """Whether a chapter is a preface, imprint or the like."""
    t, head = clean_line(title), clean_text(F.substring(content, 1, 1800))
    numbered = t.rlike(f"(?U){PREFIX}") & ~contains_any(t, UNKNOWN)
    loose = contains_any(t, UNKNOWN) | t.startswith("自动分段") | (count_of(head, PUBLISHING) >= 2)
    return ~F.contains(head, F.lit(RESOURCES)) & ~numbered & loose


def chapter_number(c: Column) -> Column:
    """A title's chapter number: Arabic or Chinese; 0 for an introduction, 9999 for an unknown title, else 9998."""
    arabic = F.regexp_extract(c, "(?U)第\\s*(\\d+)\\s*[章节]", 1)
    chinese = F.regexp_extract(c, f"(?U)第\\s*([{NUMERAL}]+)\\s*[章节]", 1)
    digits = F.translate(chinese, "零〇一二两三四五六七八九", "001223456789")
    place = F.instr(chinese, "十")
    left = F.substring_index(digits, "十", 1)
    right = F.regexp_extract(digits, "十(.*)$", 1)
    one = lambda x: F.coalesce(F.try_to_number(x, F.lit("9")).cast("int"), F.lit(0))
    tens = F.when(left == "", 1).otherwise(one(left)) * 10 + F.when(right == "", 0).otherwise(one(right))
    plain = F.aggregate(F.filter(F.split(digits, ""), lambda d: d != ""), F.lit(0), lambda s, d: s * 10 + F.when(d.rlike("^[0-9]$"), d.try_cast("int")).otherwise(0))
    number = F.when(place > 0, tens).otherwise(plain)
    return (
        F.when(arabic != "", arabic.try_cast("int"))
        .when(chinese != "", number)
        .when(c.rlike("(?U)^\\s*(?:绪论|总论)\\s*$"), 0)
        .when(contains_any(c, UNKNOWN), 9999)
        .otherwise(9998)
    )
