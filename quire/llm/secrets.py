"""Secret scan: fixed patterns, and password guess-cost for values that stand in a credential context.

Base kinds, each found leftmost and without overlap within its kind: assign (a credential name, : or =, a value of 8
characters or more), access (AKIA and capitals or digits, 16 or more), hex (32 or more lower-case hex digits).

The guess kind judges every value in a credential context, which is wider than assign's (more names, "is" and arrows as
separators, symbols in the value). A value's guess cost is the cheapest segmentation, by dynamic programming over its
characters, into words (by rank in a word list, or letters of one case as an unlisted word), dates, repeats, keyboard
walks and sequences, and brute-force spans; a value that takes 10 ** GUESSES guesses or more is reported, so
placeholders and prose are not. A value that an assign span holds too is reported beside it: assign says that it is
named as a secret, guess that it is a strong one.

Every span is kind:start:end in code points, end exclusive. Cases: null and empty texts have no spans, an empty
string of them and the SHA-256 of nothing; repeated rows are scanned each; two spans with the same start are ordered
assign, access, hex, guess; an empty table gives no rows; further columns are ignored. A value of any length is
segmented whole, in time that grows with its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import pieces

KINDS = ("assign", "access", "hex", "guess")
GUESSES = 12.0
UNIT = 12  # as every character of a unit takes 10 guesses at least
LEAST, UNLISTED, EACH = 3, 3.5, 0.15  # letters of an unlisted word, what it costs and each letter more

#: The base patterns.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_RUN, ACCESS_RUN, VALUE_RUN = 32, 16, 8

CONTEXT = re.compile(
    rb"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth|credentials?|bearer)"
    rb"[\"']?(?:\x20*(?:[:=]|=>|->)\x20*|\x20+(?:is|was)\x20+)[\"'`]?([^\s\"'`<>,;]{8,})", re.I
)

SAID = re.compile(rb"\x20(?:is|was)\x20", re.I)  # with : = and ->, what CONTEXT can't do without

#: Words that guessers try first, most common first.
WORDS = (
    "password 123456 qwerty admin welcome login letmein dragon monkey master shadow sunshine princess football baseball secret token changeme "
    "default example sample test testing user username root guest public private server access system service account super summer winter spring "
    "autumn monday friday january december love hello world freedom flower computer internet michael jennifer thomas jordan hunter ranger buster "
    "soccer hockey killer george charlie andrew pepper cheese ginger cookie please your here none null true false placeholder redacted hidden "
    "value string insert replace enter this that with from have will what when where"
).split()
RANK = {w: k + 1 for k, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("@4013$5!7", "aaoiessit")
KEYS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


def _neighbours() -> set[tuple[str, str]]:
    at = {c: (r, k + r * 0.5) for r, row in enumerate(KEYS) for k, c in enumerate(row)}
    return {(a, b) for a, (r, x) in at.items() for b, (q, y) in at.items() if a != b and abs(r - q) <= 1 and abs(x - y) <= 1}


_NEAR = _neighbours()


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes; its time grows with the value's length.

    Brute force takes a character at a time. A listed word is looked up, with leet spelling undone; unlisted words are
    letters of one case, or a capital and small letters. A keyboard walk or sequence, and a repeat of a unit, starts where
    its run does or up to two characters, or units, later. Units have UNIT characters at most: a longer one alone takes
    10 ** GUESSES guesses, whatever repeats it, so no verdict depends on them.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    single = [_brute(c) for c in value]
    ahead = [0.0]
    for c in single:
        ahead.append(ahead[-1] + c)
    best = [0.0] + [float("inf")] * n
    more = math.log10(2)  # a further segment doubles the orders to try
    walk = turns = 0  # where the walk up to here starts, and its turns
    letters, kind, word = 0, None, float("inf")  # where the letters of one case up to here start; the cheapest start of an unlisted word among them
    period = [0] * (UNIT + 1)  # how many characters up to here equal the one a unit before
    for j in range(1, n + 1):
        c = value[j - 1]
        b = best[j - 1] + single[j - 1]  # brute force, joined to what stands before
        case = "lower" if c.isalpha() and c.islower() else "upper" if c.isalpha() and c.isupper() else None
        if case != kind or case is None:
            letters, kind, word = j - 1, case, float("inf")
        if case and j - letters >= LEAST:
            word = min(word, best[j - LEAST] - EACH * (j - LEAST))
            b = min(b, word + EACH * j + UNLISTED + more)
        if case == "lower" and letters and value[letters - 1].isupper() and j - letters + 1 >= LEAST:
            b = min(b, best[letters - 1] + EACH * (j - letters + 1) + UNLISTED + more)
        for i in range(max(0, j - LONGEST), j - LEAST + 1):
            if (r := RANK.get(plain[i:j]) or RANK.get(low[i:j])) is not None:
                b = min(b, best[i] + math.log10(r + 1) + (0.3 if value[i:j] != low[i:j] else 0) + (0.3 if plain[i:j] != low[i:j] else 0) + more)
        if c.isdigit():
            for i in range(max(0, j - 10), j - 3):
                if value[i].isdigit() and _DATE.fullmatch(value, i, j):
                    b = min(b, best[i] + math.log10(365 * 120) + more)
        if j > 1:
            step = ord(low[j - 1]) - ord(low[j - 2])
            if (low[j - 2], low[j - 1]) not in _NEAR and abs(step) != 1:
                walk, turns = j - 1, 0
            elif j - walk > 2:
                turns += step != ord(low[j - 2]) - ord(low[j - 3])
            for i in range(walk, min(walk + 3, j - LEAST + 1)):
                b = min(b, best[i] + 1.7 + 0.5 * min(turns, j - i) + math.log10(j - i) + more)
        for unit in range(1, min(UNIT, j - 1) + 1):
            period[unit] = period[unit] + 1 if c == value[j - 1 - unit] else 0
            longest = period[unit] // unit + 1
            for times in range(max(2, longest - 2), longest + 1):
                if times >= 3 or unit >= 3:
                    b = min(b, best[j - times * unit] + ahead[j] - ahead[j - unit] + math.log10(times) + more)
        best[j] = b
    return best[n]


def _runs(ok: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of True of least length or more, cut at at."""
    edge = np.zeros(len(ok) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = ok[1:] != ok[:-1]
    edge[at] = True
    cut = np.flatnonzero(edge)
    keep = (np.diff(cut) >= least) & ok[cut[:-1]] if len(cut) > 1 else np.zeros(0, bool)
    return cut[:-1][keep], cut[1:][keep]


_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def spans(data: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) in code points, ordered, of each text data[at[i]:at[i+1]]."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    if not len(data):
        return out
    starts, ends = _runs(_HEX[data], at, HEX_RUN)
    for a, b, d in zip(starts, ends, np.searchsorted(at, starts, "right") - 1):
        out[d].append((int(a - at[d]), 2, int(b - at[d])))
    raw = data.tobytes()
    for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        text = raw[a:b]
        found = out[d]
        if b"AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_RUN]
        named = b":" in text or b"=" in text
        if named:
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= VALUE_RUN]
        if named or b"->" in text or SAID.search(text):
            for m in CONTEXT.finditer(text):
                value = m[1].decode(errors="replace").rstrip(".)]}!?:")
                if len(value) >= VALUE_RUN and guess_cost(value) >= GUESSES:
                    found.append((m.start(1), 3, m.start(1) + len(value.encode())))
        if found:
            if not text.isascii():
                whole = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])
                found[:] = [(int(whole[x]), k, int(whole[y])) for x, k, y in found]
            found.sort()
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                found = spans(data, at)
                said = [[f"{KINDS[k]}:{x}:{y}" for x, k, y in f] for f in found]
                base = [",".join(w for w, s in zip(words, f) if s[1] < 3) for words, f in zip(said, found)]
                counts = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(4)]
                digest = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *counts, digest, pa.array([",".join(w) for w in said], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
