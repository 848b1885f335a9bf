"""Scalar text functions as Column expressions: cleaning, noise, sentences, tokens, keys and ids.

Patterns that need Unicode white space or digits carry the (?U) flag, as Java's classes are ASCII without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chinese numerals, stop words, synonyms and the words that tell tables of contents and back matter.
NUMERAL = "一二三四五六七八九十百千万零〇两"
STOP_WORDS = (
    "以及 进行 可以 通过 由于 因此 主要 包括 具有 作用 功能 过程 细胞 系统 而不 而非 不同 但是 如果 或者 因为 所以 其中 本章 "
    "本节 教材 医学 教学 修订 本次 尤其 可能 发现 形成 研究 患者 正常 异常 有关 相关 一种 一个 这些 这种 同时 一般 发生 发展"
).split()
SYNONYMS = {"leukocyte": "白细胞", "whitebloodcell": "白细胞", "whitebloodcells": "白细胞", "炎症反应": "炎症", "actionpotential": "动作电位", "restingpotential": "静息电位", "内环境稳态": "稳态"}
BACK_MATTER = ("推荐阅读", "中英文名词对照索引", "附录", "数字特色")
DEFINING = ("是", "是指", "称为", "定义为", "表现为", "包括")
CJK = "\\u4e00-\\u9fa5"

NUMBERED = f"第[{NUMERAL}\\d]+"
LEADER = "(?U)(?:[.\\u2026·•\\-—_]\\s*){4,}"
TOC_LINE = f"(?U)^\\s*(?:{NUMBERED}[章节部篇].*|[一二三四五六七八九十]+[、.].*)\\s+\\d+\\s*$"
BLANK = "[\\s&&[^\\n]]"  # white space inside a line, under (?U)
#: Lines as is_noise_line() means them, each with its line break, in a text whose lines are clean.
NOISE_LINES = (
    f"(?Umd)^(?:|[^{CJK}A-Za-z\\n]{{1,2}}|(?:{NUMBERED}[章节部篇].*|[一二三四五六七八九十]+[、.].*){BLANK}+\\d+|(?=.{{0,39}}$)(?:[^\\d\\n]*\\d){{11}}.*)(?:\\n|\\z)"
)
LINE_BREAK = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]"


def sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return sub(c, "(?U)^\\s+|\\s+$")


def collapse(c: Column, by: str = " ") -> Column:
    return sub(c, "(?U)\\s+", by)


def contains_any(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether c has any of the words; words are matched literally."""
    if not words:
        return F.lit(False)
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(c, w))


def count_of(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """How many of the words c has."""
    return F.size(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(c, w)))


def _scrubbed(c: Column) -> Column:
    c = sub(sub(c, "\\x00", " "), "\\ufeff")
    return sub(sub(c, "[\\x01-\\x08\\x0b\\x0e-\\x1f\\x7f]", " "), "\\ufffd+", " ")


def clean_line(c: Column) -> Column:
    """One line without control characters, leader dots and repeated spaces."""
    return strip(sub(sub(_scrubbed(c), LEADER, " "), "[ \\u3000]{2,}", " "))


def is_noise_line(c: Column, cleaned: bool = False) -> Column:
    """Whether a line is empty, a stray mark, a line of a table of contents or a row of digits."""
    line = c if cleaned else clean_line(c)
    n = F.length(line)
    mark = (n <= 2) & ~line.rlike(f"[{CJK}A-Za-z]")
    digits = (F.regexp_count(line, F.lit("(?U)\\d")) > 10) & (n < 40)
    # Most lines show without being cleaned that they are none: cleaning takes no letter away and adds no digit or numeral.
    plain = c.rlike(f"[{CJK}A-Za-z]{{3}}") & ~c.rlike("[第一二三四五六七八九十]") & (F.regexp_count(c, F.lit("(?U)\\d")) <= 10)
    return F.when(plain, F.lit(False)).otherwise((n == 0) | mark | line.rlike(TOC_LINE) | digits)


def clean_text(c: Column) -> Column:
    """The text's clean lines that aren't noise, joined by newlines.

    What clean_line() and is_noise_line() do to a line is done to all lines of the text at once, by multi-line patterns:
    these run as compiled code over the whole text, an array of lines would be interpreted line by line.
    """
    c = F.when(c.rlike("[\\x00-\\x09\\x0b-\\x1f\\x7f\\ufeff\\ufffd]"), sub(_scrubbed(c), "[\\t\\r\\f]+", " ")).otherwise(c)
    c = sub(sub(c, "[ \\u3000]{2,}", " "), "(?U)第\\s*\\d+\\s*页\\s*/\\s*共\\s*\\d+\\s*页")
    c = sub(sub(sub(c, "[\\u0085\\u2028\\u2029]", "\n"), LEADER.replace("\\s", BLANK), " "), "[ \\u3000]{2,}", " ")
    c = sub(c, f"(?Umd)^{BLANK}+|{BLANK}+$")
    return strip(sub(c, NOISE_LINES))


def clean_short(c: Column) -> Column:
    """clean_text() of a short text: a line of plain ASCII without repeated spaces, leaders and many digits is clean as it stands."""
    plain = c.rlike("\\A[A-Za-z][ -~]*[!-~]\\z") & c.rlike("[A-Za-z]{3}") & ~c.contains("  ") & ~c.rlike(LEADER) & (F.regexp_count(c, F.lit("[0-9]")) <= 10)
    return F.when(plain, c).otherwise(clean_text(c))


def clean_again(c: Column) -> Column:
    """clean_text() of what clean_text() has made, which differs only if a page mark that it took away has left another one."""
    return F.when(c.contains("页"), clean_text(c)).otherwise(c)


def lines_of(c: Column) -> Column:
    """The non-blank lines of a text, stripped."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda x: x != "")


#: What a table of contents has at least one of: a mark of chapters, catalogues and numbered lines, or a leader.
TOC_MARK = "[第目一二三四五六七八九十]|\\ufffd{3}"


def looks_like_toc_page(c: Column) -> Column:
    """Whether a page reads as a table of contents; lines are looked at only if the page has what such lines are told by."""

    def listed(raw: Column, clean: Column) -> Column:
        leaders = F.size(F.filter(raw, lambda x: x.rlike(LEADER) | x.rlike("\\ufffd{3,}") | clean_line(x).rlike(TOC_LINE)))
        chapters = F.size(F.filter(clean, lambda x: x.rlike(f"(?U)^\\s*{NUMBERED}[章部篇]")))
        sections = F.size(F.filter(clean, lambda x: x.rlike(f"(?U)^\\s*{NUMBERED}节")))
        named = F.exists(F.slice(clean, 1, 8), lambda x: F.contains(x, F.lit("目录")))
        back = F.exists(F.slice(clean, 1, 14), lambda x: contains_any(x, BACK_MATTER))
        marks = F.regexp_count(c, F.lit("[，。；：、]"))
        prose = (F.length(c) > 1200) & (marks > 18) & ~named & (leaders < 4)
        found = named | (leaders >= 4) | (chapters >= 3) | ((chapters >= 2) & back) | ((chapters + sections >= 5) & (leaders >= 1))
        return (F.size(raw) > 0) & ~prose & found

    marked = c.rlike(TOC_MARK) | c.rlike(LEADER)
    return F.when(~marked, F.lit(False)).otherwise(bind(lines_of(c), lambda raw: bind(F.transform(raw, clean_line), lambda clean: listed(raw, clean))))


def normalize_key(c: Column, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """The form under which equal names meet: lower case, without white space and punctuation, synonyms folded."""
    key = sub(strip(F.lower(c)), "(?U)[\\s\\-_/（）()《》〈〉\\[\\]【】,:：;；。,.，·•]+")
    if not synonyms:
        return key
    table = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), key)


def split_sentences(c: Column, least: int = 8) -> Column:
    """Sentences of more than `least` characters; a full-width or ASCII ! ? ; ends one, an ASCII period doesn't."""
    parts = F.transform(F.split(c, "(?U)(?<=[。！？!?；;])\\s*"), strip)
    return F.filter(parts, lambda s: F.length(s) > least)


def tokenize(c: Column, stop: list[str] | tuple[str, ...] = tuple(STOP_WORDS)) -> Column:
    """Runs of two or more CJK, Latin or digit characters that aren't stop words; repeats stay."""
    found = F.regexp_extract_all(c, F.lit(f"[{CJK}A-Za-z0-9]{{2,}}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(list(stop))) if stop else found


def best_definition(term: Column, text: Column, verbs: tuple[str, ...] = DEFINING, fallback: int = 140, cut: int = 220) -> Column:
    """The first sentence with the term and a defining verb, else the first with the term, else the text's start."""
    # Only sentences with the term are asked whether they are noise, and the clean text is made once.
    named = lambda clean: F.filter(split_sentences(clean), lambda s: F.contains(s, term) & ~is_noise_line(s))
    return bind(clean_text(text), lambda clean: best_sentence(term, named(clean), clean, verbs, fallback, cut))


def best_sentence(term: Column, sentences: Column, clean: Column, verbs: tuple[str, ...] = DEFINING, fallback: int = 140, cut: int = 220) -> Column:
    """best_definition() of a text whose clean form and sentences are already at hand."""
    first = lambda found: F.substring(F.get(found, F.lit(0)), 1, cut)
    best = lambda named: F.coalesce(first(F.filter(named, lambda s: contains_any(s, verbs))), first(named))
    return F.coalesce(bind(F.filter(sentences, lambda s: F.contains(s, term)), best), F.substring(clean, 1, fallback))


def safe_id(prefix: str, value: Column, length: int = 12) -> Column:
    """prefix_ and the first hex digits of the value's SHA-1."""
    return F.concat(F.lit(f"{prefix}_"), F.left(F.sha1(F.encode(value, "UTF-8")), F.lit(length)))


def char_overlap(a: Column, b: Column) -> Column:
    """Shared distinct characters over those of the string with fewer; white space doesn't count."""
    x, y = (F.array_distinct(F.split(collapse(c, ""), "")) for c in (a, b))
    x, y = (F.filter(v, lambda ch: ch != "") for v in (x, y))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def file_name(c: Column) -> Column:
    """A name that file systems take; 未命名 if nothing is left."""
    name = strip(sub(c, "[<>:\"/\\\\|?*]", "_"))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("未命名")).otherwise(name)


def thousands(c: Column) -> Column:
    """An integer with thousands separators; other values as they are written."""
    number = F.try_to_number(c.cast("string"), F.lit("S999999999999999999"))
    return F.coalesce(F.format_number(number.cast("double"), 0), c.cast("string"))
