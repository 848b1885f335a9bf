"""Pieces of DuckDB SQL for the oracles: the text functions again, spelled out for RE2 (ASCII classes, no look-behind)."""

from __future__ import annotations

from quire.functions.text import STOP_WORDS, SYNONYMS

SPACE = r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NUM = "一二三四五六七八九十百千万零〇两"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^[{SPACE}]+|[{SPACE}]+$")


def scrubbed(x: str) -> str:
    x = f"replace({x}, chr(65279), '')"
    return sub(sub(x, r"[\x01-\x08\x0b\x0e-\x1f\x7f]", " "), r"\x{fffd}+", " ")


def clean_line(x: str) -> str:
    return strip(sub(sub(scrubbed(x), rf"(?:[.\x{{2026}}·•\-—_][{SPACE}]*){{4,}}", " "), r"[ \x{3000}]{2,}", " "))


def noise(x: str) -> str:
    """x must be clean."""
    toc = rf"^[{SPACE}]*(?:第[{NUM}\d]+[章节部篇].*|[一二三四五六七八九十]+[、.].*)[{SPACE}]+\d+[{SPACE}]*$"
    few = f"(length({x}) <= 2 AND NOT regexp_matches({x}, '[\\x{{4e00}}-\\x{{9fa5}}A-Za-z]'))"
    digits = f"(length({sub(x, '[^0-9]')}) > 10 AND length({x}) < 40)"
    return f"({x} = '' OR {few} OR regexp_matches({x}, {quoted(toc)}) OR {digits})"


def lines(x: str) -> str:
    return f"string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"


def clean_text(x: str) -> str:
    x = sub(sub(sub(scrubbed(x), r"[\t\r\f]+", " "), r"[ \x{3000}]{2,}", " "), rf"第[{SPACE}]*\d+[{SPACE}]*页[{SPACE}]*/[{SPACE}]*共[{SPACE}]*\d+[{SPACE}]*页")
    kept = f"list_filter(list_transform(list_transform({lines(x)}, lambda l: {clean_line('l')}), lambda l: {clean_line('l')}), lambda l: NOT {noise('l')})"
    return strip(f"array_to_string({kept}, chr(10))")


def sentences(x: str, least: int = 8) -> str:
    cut = f"regexp_replace({x}, '([。！？!?；;])[{SPACE}]*', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {strip('s')}), lambda s: length(s) > {least})"


def tokens(x: str) -> str:
    stop = ", ".join(map(quoted, STOP_WORDS))
    return f"list_filter(regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fa5}}A-Za-z0-9]{{2,}}'), lambda t: t NOT IN ({stop}))"


def key(x: str) -> str:
    bare = sub(strip(f"lower({x})"), rf"[{SPACE}\-_/（）()《》〈〉\[\]【】,:：;；。,.，·•]+")
    cases = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in SYNONYMS.items())
    return f"(CASE {bare} {cases} ELSE {bare} END)"
