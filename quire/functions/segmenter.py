"""Words of Chinese text by a dictionary: the likeliest way through the graph of the words that a text holds."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import CJK, STOP_WORDS

_RUNS = re.compile(f"([{CJK}]+)|[A-Za-z0-9]+")


def cheapest_path(run: str, cost: Mapping[str, float], longest: int, unknown: float) -> list[str]:
    """The words of run whose costs have the smallest sum; a character that the dictionary lacks costs `unknown`; of ties the longer first word."""
    n = len(run)
    best, step = [0.0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        best[i] = cost.get(run[i], unknown) + best[i + 1]
        for j in range(i + 2, min(n, i + longest) + 1):
            c = cost.get(run[i:j])
            if c is not None and c + best[j] <= best[i]:
                best[i], step[i] = c + best[j], j - i
    words, i = [], 0
    while i < n:
        words.append(run[i : i + step[i]])
        i += step[i]
    return words


def word_tokens(spark: SparkSession, dictionary: Mapping[str, float], stop: tuple[str, ...] = tuple(STOP_WORDS)) -> Callable[[Column], Column]:
    """A tokenizer to use instead of text.tokenize(): the words of two or more characters that aren't stop words; repeats stay.

    dictionary gives words' counts (positive); a word costs the negative logarithm of its share. Runs of Latin letters
    and digits are words. It is broadcast, so it is to be a dictionary of a language, not a table of the corpus. A null
    text is null, an empty one has no words; without a dictionary every Chinese character stands alone.
    """
    total = math.log(sum(dictionary.values()) or 1.0)
    costs = {w: total - math.log(n) for w, n in dictionary.items() if w and n > 0}
    shipped, longest, left_out = spark.sparkContext.broadcast(costs), max(map(len, costs), default=1), frozenset(stop)

    @F.pandas_udf("array<string>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cost = shipped.value
        for texts in batches:
            out = []
            for text in texts:
                if text is None:
                    out.append(None)
                    continue
                found = (w for m in _RUNS.finditer(text) for w in (cheapest_path(m[1], cost, longest, total) if m[1] else [m[0]]))
                out.append([w for w in found if len(w) > 1 and w not in left_out])
            yield pd.Series(out, dtype=object)

    return words
