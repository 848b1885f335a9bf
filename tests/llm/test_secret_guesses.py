"""Guess costs against a plain search over all segmentations, and spans that scan() adds."""

import math
import random
import time

import pytest

from quire.llm import secrets as S


def plain_cost(value):
    """The cheapest segmentation, every segment tried."""
    n, low = len(value), value.lower()
    leet, single = low.translate(S.LEET), [S._brute(c) for c in value]
    near = [False] + [(low[i - 1], low[i]) in S._NEAR or abs(ord(low[i]) - ord(low[i - 1])) == 1 for i in range(1, n)]
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        options = [best[j - 1] + single[j - 1]]
        start = j - 1  # of the walk that ends here
        while start and near[start]:
            start -= 1
        for i in range(j):
            piece, size = value[i:j], j - i
            if (r := S.RANK.get(leet[i:j]) or S.RANK.get(low[i:j])) is not None and size >= S.LEAST:
                options.append(best[i] + math.log10(r + 1) + 0.3 * (piece != low[i:j]) + 0.3 * (leet[i:j] != low[i:j]) + math.log10(2))
            if size >= S.LEAST and piece.isalpha() and (piece.islower() or piece.isupper() or (piece[0].isupper() and piece[1:].islower())):
                options.append(best[i] + S.UNLISTED + S.EACH * size + math.log10(2))
            if piece[0].isdigit() and S._DATE.fullmatch(piece):
                options.append(best[i] + math.log10(365 * 120) + math.log10(2))
            if size >= S.LEAST and start <= i < start + 3:
                turns = sum(ord(low[k]) - ord(low[k - 1]) != ord(low[k - 1]) - ord(low[k - 2]) for k in range(start + 2, j))
                options.append(best[i] + 1.7 + 0.5 * min(turns, size) + math.log10(size) + math.log10(2))
            for unit in range(1, min(S.UNIT, size // 2) + 1):
                times = size // unit
                if size % unit or piece != piece[:unit] * times or not (times >= 3 or unit >= 3):
                    continue
                longest = times
                while i - (longest - times + 1) * unit >= 0 and value[i - (longest - times + 1) * unit : i - (longest - times) * unit] == piece[:unit]:
                    longest += 1
                if times >= longest - 2:
                    options.append(best[i] + sum(single[j - unit : j]) + math.log10(times) + math.log10(2))
        best[j] = min(options)
    return best[n]


def test_cost_is_the_cheapest_segmentation():
    rng = random.Random(41)
    parts = ["pass", "word", "P@ss", "qwe", "asdf", "123", "2024", "0131", "aaa", "xYxY", "Z", "#", "é", "Summer", "KEY", "k9", "ab", "monkey", "321", "01/02/1999"]
    for _ in range(300):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))[:30]
        assert S.guess_cost(value) == pytest.approx(plain_cost(value)), value


def test_long_values_take_time_in_proportion():
    began = time.time()
    assert S.guess_cost("a" * 20_000) < 12 and S.guess_cost("ab" * 10_000) < 12 and S.guess_cost("x7#Q" + "b3" * 10_000 + "".join(map(chr, range(33, 120)))) > 12
    assert time.time() - began < 20


def test_scan_adds_strong_values(spark):
    strong, weak = "8f3kQ9zLx0Vb2Rm7", "password123"
    texts = [f"é api_key = '{strong}' and", f"secret: {weak}!", f"My passphrase is {strong}.", "the token was changeme123 then", f"auth -> {strong}", "nothing here: " + strong, None, ""]
    rows = {r.doc_id: r for r in S.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at = lambda k: f"guess:{texts[k].index(strong)}:{texts[k].index(strong) + len(strong)}"
    assert rows[0].spans == f"assign:2:{texts[0].index(strong) + len(strong)},{at(0)}" and (rows[0].n_assign, rows[0].n_guess) == (1, 1)
    assert rows[1].spans == f"assign:0:{8 + len(weak)}" and rows[1].n_guess == 0
    assert rows[2].spans == at(2) and rows[3].spans == "" and rows[4].spans == at(4)
    assert rows[5].spans == rows[6].spans == rows[7].spans == ""
