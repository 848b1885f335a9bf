"""The scan that spells a chapter title from a page's first lines: a stateful read, so plain Python, one page at a time."""

from __future__ import annotations

import re

from quire.functions.text import LEADER, TOC_LINE
from quire.functions.titles import BODY, CATALOG_ROW, NOT_TITLE, PREFIX, RESOURCES, SECTION, STOP_MARKERS, TITLE, TITLE_LINE, N

EDGE = " 　：:、.-|"


def _python(pattern: str, flags: int = 0) -> re.Pattern[str]:
    return re.compile(pattern.replace("(?U)", "").replace("(?iU)", ""), flags)


_PREFIX, _LINE, _SECTION, _ROW = _python(PREFIX), _python(TITLE_LINE), _python(SECTION), _python(CATALOG_ROW + r"\s*$")
_LEADER, _TOC, _MARKS = _python(LEADER), _python(TOC_LINE), re.compile("[。！？；;]")
_CUT = re.compile(r"\s*(?:本章数字资源|学习目标|本章思维导图|第一节|第二节|一、|二、)")


def _tidy(line: str) -> str:
    line = re.sub("[\x00-\x08\x0b\x0e-\x1f\x7f]", " ", line.replace("﻿", ""))
    line = _LEADER.sub(" ", re.sub("�+", " ", line))
    return re.sub("[ 　]{2,}", " ", line).strip()


def _noise(line: str) -> bool:
    few = len(line) <= 2 and not re.search("[一-龥A-Za-z]", line)
    return not line or few or bool(_TOC.match(line)) or len(re.findall(r"\d", line)) > 10 and len(line) < 40


def _piece(line: str) -> str:
    return " ".join(re.sub(r"^[\s：:、.-]+|[\s：:、.-]+$", "", _tidy(line)).split())


def _stops(line: str) -> bool:
    return line.isdecimal() or any(m in line for m in STOP_MARKERS) or bool(_SECTION.match(line))


def _prose(line: str) -> bool:
    return len(line) > BODY or bool(_MARKS.search(line))


def _whole(prefix: str, parts: list[str]) -> str | None:
    """The title in its normal form if it is one."""
    t = " ".join(_tidy(" ".join([prefix, "".join(parts)])).split())
    t = re.sub(rf"(第)\s*({N})\s*(章)", r"\1\2\3 ", t)
    t = _CUT.split(t, maxsplit=1)[0]
    t = re.sub("(?<=[一-龥])\\s+(?=[一-龥])", "", t)
    t = re.sub(rf"(第{N}章)(.+?)\s+\2.+$", r"\1\2", t)
    t = re.sub(rf"(第{N}章)\s*", r"\1 ", " ".join(t.split()).strip(" ：:、.-")).strip()
    bad = not t or len(t) > TITLE or any(m in t for m in NOT_TITLE) or _MARKS.search(t) or not _PREFIX.match(t)
    return None if bad else t


def infer(lines: list[str]) -> str | None:
    """The title that the lines spell: before the resource marker if there is one, else after the first 第…章."""
    clean = []
    for raw in lines[:30]:
        line = _tidy(" ".join((raw or "").split()))
        if line and "目录" not in line and (not _noise(line) or _PREFIX.search(line)):
            clean.append(line)
    marker = next((i for i, x in enumerate(clean) if RESOURCES in x), None)
    if marker is not None and (found := _before(clean[max(0, marker - 6) : marker])):
        return found
    for i, line in enumerate(clean):
        head = _LINE.match(line)
        if head and not _ROW.search(line):
            parts = [p] if (p := _piece(head[2].strip(EDGE))) else []
            for follow in clean[i + 1 : i + 6]:
                piece = _piece(follow)
                if piece and _stops(piece):
                    if parts:
                        break
                elif piece:
                    if _PREFIX.search(piece) or _ROW.search(piece) or _prose(piece):
                        break
                    parts.append(piece)
                    if sum(map(len, parts)) >= 24:
                        break
            if found := _whole(head[1], parts):
                return found
    return None


def _before(window: list[str]) -> str | None:
    heads = [(i, m) for i, x in enumerate(window) if (m := _LINE.match(x)) and not _ROW.search(x)]
    if not heads:
        tail = "".join(_piece(x) for x in window[-3:] if not _stops(x))
        return "绪论" if "".join(tail.split()) == "绪论" else None
    i, head = heads[-1]
    parts = [p] if (p := _piece(head[2].strip(EDGE))) else []
    for follow in window[i + 1 :]:
        piece = _piece(follow)
        if not piece or _stops(piece):
            continue
        if _LINE.match(piece) or _prose(piece):
            break
        parts.append(piece)
    return _whole(head[1], parts)
