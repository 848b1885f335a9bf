"""Sparse text vectors as postings (doc, term, weight): character TF-IDF, hashed characters, and their cosine."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import sub
from quire.llm.shared import small_batches
from quire.operators.components import cut

SIZES, FEATURES, SLOTS = (2, 3, 4), 16_000, 4096
HELD = 200_000  # terms that a task sums up before it hands their sums on
WORDS = 1 << 16  # words whose terms a task keeps, some 20 MB


def _every(w: Column, n: int) -> Column:
    """All grams of n characters of w; w itself if it is shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, F.lit(n)))


def word_grams(text: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """The grams inside each word, padded by a space at both ends; a padded word shorter than a size is one gram, once."""
    words = F.filter(F.split(F.lower(sub(text, "(?U)\\s+", " ")), " "), lambda w: w != "")

    def grams(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        parts = []
        for n in sizes:
            every = _every(w, n)
            # Sizes beyond the word's give the word itself, which only the first such size keeps.
            parts.append(every if n == sizes[0] else F.when(F.length(w) >= n, every).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(words, grams))


def flat_grams(text: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """All grams of the text without white space, padded by one space at both ends."""
    compact = sub(text, "(?U)\\s+", "")
    w = F.concat(F.lit(" "), compact, F.lit(" "))
    every = [F.regexp_extract_all(w, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]  # in time linear in the text: cutting at a place walks there
    return F.when(compact == "", F.array().cast("array<string>")).otherwise(F.concat(*every))


def counts(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def gram_counts(docs: DataFrame, key: str, text: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(key, term, tf) of word_grams(): words are counted first, and grams are cut from each distinct word of a text.

    Words and grams are rows, not arrays, so that all of it runs as compiled code.
    """
    words = docs.select(key, F.explode(F.split(F.lower(sub(F.col(text), "(?U)\\s+", " ")), " ")).alias("w")).where("w <> ''").groupBy(key, "w").agg(F.count("*").alias("n"))
    padded = words.select(key, "n", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"), F.explode(F.array(*map(F.lit, sizes))).alias("size")).where((F.length("w") >= F.col("size")) | (F.col("size") == sizes[0]))
    placed = padded.select(key, "n", "w", "size", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("w") - F.col("size") + 1))).alias("i"))
    return placed.groupBy(key, F.substring("w", F.col("i"), F.col("size")).alias("term")).agg(F.sum("n").alias("tf"))


def _gram_list(word: str, sizes: tuple[int, ...]) -> tuple[str, ...]:
    w = f" {word} "
    return tuple(w[i : i + n] for n in sizes if len(w) >= n or n == sizes[0] for i in range(max(1, len(w) - n + 1)))


@lru_cache(1 << 16)
def _cut_grams(word: str, sizes: tuple[int, ...]) -> tuple[str, ...]:
    return _gram_list(word, sizes)


def text_grams(folded: str, sizes: tuple[int, ...] = SIZES) -> list[str]:
    """The grams of word_grams() of one text that folded() has made ready, repeats among them."""
    return [g for word in folded.split(" ") if word for g in _cut_grams(word, sizes)]


def folded(text: Column) -> Column:
    """The text as gram_counts() and text_grams() cut it into words; a null text has none."""
    return F.coalesce(F.lower(sub(text, "(?U)\\s+", " ")), F.lit(""))


def term_totals(docs: DataFrame, text: str, copies: str | None = None, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(term, total, df) of the grams of all texts, each as often as its copies say; what leaves a task is a sum a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        words: dict[str, list[int]] = {}
        total, df = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sums() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(number.keys(), pa.string()), pa.array(total[: len(number)]), pa.array(df[: len(number)])], names=["term", "total", "df"])
            number.clear()
            words.clear()
            return out

        for batch in batches:
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: list[int] = []
                for word in t.split(" "):
                    if word and word not in words:
                        if len(words) > WORDS:
                            words.clear()
                        words[word] = [number.setdefault(g, len(number)) for g in _gram_list(word, sizes)]
                    if word:
                        found += words[word]
                if len(number) > len(total):
                    total, df = (np.append(x, np.zeros(len(number), np.int64)) for x in (total, df))
                own, times = np.unique(np.array(found, np.int64), return_counts=True)
                total[own] += times * n
                df[own] += n
                if len(number) > HELD:
                    yield sums()
                    total, df = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield sums()

    rows = docs.select(folded(F.col(text)).alias("t"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"))
    return rows.mapInArrow(run, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def frequent(totals: DataFrame, n_docs: int, features: int = FEATURES) -> list[tuple[str, float]]:
    """vocabulary() of term_totals(), of `features` terms at most, as a list in the order of the terms."""
    terms = totals.orderBy(F.desc("total"), "term").limit(features)
    return sorted((r.term, r.idf) for r in terms.select("term", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf")).collect())


class Coder:
    """TF-IDF vectors of single texts over a list of terms; the terms of a word are looked up once."""

    def __init__(self, terms: list[tuple[str, float]], sizes: tuple[int, ...] = SIZES):
        self.number, self.idf, self.sizes = {t: i for i, (t, _) in enumerate(terms)}, np.array([idf for _, idf in terms], float), sizes
        self.words: dict[str, list[int]] = {}

    def counts(self, folded: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of terms, how often the text has them); empty if it has none of the terms."""
        found: list[int] = []
        for word in folded.split(" "):
            if word not in self.words:
                if len(self.words) > WORDS:
                    self.words.clear()
                self.words[word] = [self.number[g] for g in _gram_list(word, self.sizes) if g in self.number] if word else []
            found += self.words[word]
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        tf = np.bincount(found, minlength=len(self.idf))
        codes = np.flatnonzero(tf)
        return codes, tf[codes]

    def unit(self, folded: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of terms, weights) of the text's vector of length 1; empty if it has none of the terms."""
        codes, tf = self.counts(folded)
        w = tf * self.idf[codes]
        return codes, w / np.sqrt(w @ w) if len(w) else w


def vocabulary(tf: DataFrame, n_docs: Column | int, key: str, features: int | None = FEATURES) -> DataFrame:
    """(term, idf) of the most frequent terms, ties by term; idf = ln((1 + N) / (1 + df)) + 1."""
    terms = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    if features:
        terms = terms.orderBy(F.desc("total"), "term").limit(features)
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return terms.select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def normalized(weights: DataFrame, key: str) -> DataFrame:
    """(key, term, w) with each key's weights scaled to length 1."""
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, key).select(key, "term", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("w"))


def tfidf(tf: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, term, w): TF-IDF over the vocabulary, which is broadcast if it is of FEATURES terms at most."""
    return normalized(tf.join(vocab, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w")), key)


def unique(docs: DataFrame, *key: str) -> bool:
    """Whether no two rows have one key."""
    return not docs.groupBy(*key).count().where("count > 1").limit(1).count()


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC_TABLE = _crc_table()


def gram_slots(compact: str, slots: int = SLOTS, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """The CRC-32 slots of flat_grams() of a text without white space, all grams of a size at once."""
    if not compact:
        return np.zeros(0, np.int64)
    data = np.frombuffer(f" {compact} ".encode("utf-8", "surrogatepass"), np.uint8)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    out = []
    for n in sizes:
        start, end = at[: max(0, len(at) - n)], at[n:]
        crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
        for step in range(int((end - start).max(initial=0))):
            place = start + step
            more = CRC_TABLE[(crc ^ data[np.minimum(place, len(data) - 1)]) & 0xFF] ^ (crc >> 8)
            crc = np.where(place < end, more, crc)
        out.append((crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % slots)
    return np.concatenate(out)


def hashed(docs: DataFrame, key: str, text: str, slots: int = SLOTS) -> DataFrame:
    """(key, slot, w): counts of CRC-32 hashed grams, scaled to length 1, worked out inside a text's row unless rows share a key."""
    if unique(docs, key):
        kind = docs.select(F.col(key).alias("k")).schema["k"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, len(batch), 64):
                    part = batch.slice(i, 64)
                    rows, found, weights = [], [], []
                    for j, t in enumerate(part.column(1).to_pylist()):
                        tf = np.bincount(gram_slots(t or "", slots), minlength=slots)
                        own = np.flatnonzero(tf)
                        w = tf[own].astype(float)
                        rows.append(np.full(len(own), j))
                        found.append(own.astype(np.int32))
                        weights.append(w / np.sqrt(w @ w) if len(w) else w)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(found)), pa.array(np.concatenate(weights))], names=[key, "slot", "w"])

        return docs.select(key, sub(F.col(text), "(?U)\\s+", "").alias("__compact")).mapInArrow(run, f"`{key}` {kind}, slot int, w double")
    grams = docs.select(key, F.explode(flat_grams(F.col(text))).alias("gram"))
    slot = F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(slots)).cast("int")
    tf = grams.groupBy(key, slot.alias("term")).agg(F.count("*").cast("double").alias("w"))
    return normalized(tf, key).withColumnRenamed("term", "slot")


def cosine_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, cosine) of pairs that share a term, from postings of unit vectors."""
    return left.join(right.withColumnRenamed("w", "w2"), "term").groupBy(a, b).agg(F.sum(F.col("w") * F.col("w2")).alias("cosine"))


def encoded(docs: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(key, vector array<double>): what an encoder of your own makes of each batch of texts, scaled to length 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.asarray(encode(b["__text"].tolist()), float).reshape(len(b), -1)
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            yield pd.DataFrame({key: b[key], "vector": list(v / np.where(norm > 0, norm, 1.0))})

    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return rows.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, vector array<double>")


def backend(name: str = "auto", encode: Callable[[list[str]], np.ndarray] | None = None) -> str:
    """The vectors that a setting stands for: an encoder's if asked for and given, else TF-IDF; hash is asked for by name."""
    wanted = (name or "auto").lower()
    if wanted in ("hash", "hashing"):
        return "hash"
    return "encoder" if wanted in ("auto", "encoder", "sentence-transformers") and encode is not None else "tfidf"


def vectorized(docs: DataFrame, key: str, text: str, name: str = "auto", encode: Callable[[list[str]], np.ndarray] | None = None, features: int = FEATURES) -> tuple[str, DataFrame]:
    """(the back end, its unit vectors of docs): postings (key, term, w) or, by an encoder, (key, vector)."""
    kind = backend(name, encode)
    if kind == "encoder":
        return kind, encoded(docs, key, text, encode)
    if kind == "hash":
        return kind, hashed(docs, key, text).withColumnRenamed("slot", "term")
    tf = cut(gram_counts(docs, key, text))
    return kind, tfidf(tf, vocabulary(tf, docs.count(), key, features), key)


def dense_cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays; a zero vector's norm counts as 1."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)
    norm = lambda p: F.when(dot(p, p) > 0, F.sqrt(dot(p, p))).otherwise(1.0)
    return dot(x, y) / (norm(x) * norm(y))


def top_neighbours(pairs: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """The k most similar b of each a; of ties, to nine places, the smaller b."""
    rank = F.row_number().over(W.partitionBy(a).orderBy(F.round("cosine", 9).desc(), b))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


#: Postings that a text's first look at its neighbours may read, and the margin for sums of doubles in another order.
PROBED, MARGIN = 1000, 1e-8


def bounded_terms(left: DataFrame, right: DataFrame, a: str) -> DataFrame:
    """(a, term, w, read, bound): left's terms that right has, rarest first.

    read is the number of right's postings of this term and the rarer ones; bound is the largest cosine of a pair of
    unit vectors that shares this term or more common ones only: the smaller of the sum of weights times right's
    largest ones, and of the length of what is left of the vector.
    """
    known = right.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("most"))
    rare = W.partitionBy(a).orderBy("df", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = W.partitionBy(a).orderBy("df", "term").rowsBetween(W.currentRow, W.unboundedFollowing)
    bound = F.least(F.sum(F.col("w") * F.col("most")).over(rest), F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest)))
    return left.join(known, "term").select(a, "term", "w", F.sum("df").over(rare).alias("read"), bound.alias("bound"))


def promising_pairs(terms: DataFrame, right: DataFrame, a: str, b: str, k: int, probed: int = PROBED) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, part) that may be among a's k best, terms (a, term, w) that part does not count), of bounded_terms().

    The rarest terms, up to `probed` postings, give some partners, and the k-th best of their sums is a threshold that
    a's k best reach. A partner that shares only terms whose bound is below it is none of them, so the lists of those
    terms, which are the long ones, aren't read; pairs whose sum and the rest's bound stay below it leave, too.
    """
    near = cosine_pairs(terms.where(F.col("read") <= probed).select(a, "term", "w"), right, a, b).where(F.col(a) != F.col(b))
    rank = F.row_number().over(W.partitionBy(a).orderBy(F.desc("cosine"), b))
    least = near.withColumn("rank", rank).where(F.col("rank") == k).select(a, (F.col("cosine") - MARGIN).alias("least"))
    judged = cut(terms.join(least, a, "left").select(a, "term", "w", "bound", F.coalesce("least", F.lit(-1.0)).alias("least")))
    kept, late = judged.where("bound >= least"), judged.where("bound < least")
    rest = judged.groupBy(a).agg(F.first("least").alias("least"), F.coalesce(F.max(F.when(F.col("bound") < F.col("least"), F.col("bound"))), F.lit(0.0)).alias("rest"))
    pairs = cosine_pairs(kept.select(a, "term", "w"), right, a, b).where(F.col(a) != F.col(b))
    return cut(pairs.join(rest, a).where(F.col("cosine") + F.col("rest") >= F.col("least")).select(a, b, F.col("cosine").alias("part"))), late.select(a, "term", "w")


def top_cosine(left: DataFrame, right: DataFrame, a: str, b: str, k: int = 10, probed: int = PROBED) -> DataFrame:
    """(a, b, cosine, rank): the k most similar b of each a, itself left out, as top_neighbours() of all cosine_pairs().

    left (a, term, w) and right (b, term, w) are postings of vectors of length 1 without negative weights. Exact: terms
    are left unread only where no pair can reach a's k best by them. A text without k partners by its rare terms has
    no threshold, so all its terms are read. Pairs that share no term don't count; empty tables give no rows.
    """
    terms = cut(bounded_terms(left, right, a))
    pairs, late = promising_pairs(terms, right, a, b, k, probed)
    more = pairs.select(a, b).join(late, a).join(right.withColumnRenamed("w", "w2"), [b, "term"]).select(a, b, (F.col("w") * F.col("w2")).alias("part"))
    full = pairs.unionByName(more).groupBy(a, b).agg(F.sum("part").alias("cosine"))
    return top_neighbours(full, a, b, k)


#: Texts in a block, about, and at least; a term is a column if this share of the pairs of two blocks has it, of so many columns at once.
BLOCK, SMALL_BLOCK, COLUMN, COLUMNS = 1024, 64, 1 / 768, 2048
#: From so many texts on, like texts are put into one block; the kinds of texts, the texts and the characters of each that kinds are told by, the slots of their grams.
SORTED, KINDS, SHOWN_TEXTS, SHOWN_CHARS, KIND_SLOTS = 4096, 8, 2000, 400, 512
PAIRS = 1 << 18  # products that are added up one by one at once
SIDE = 256 << 20  # bytes of blocks that a task sets beside others


def _short(x: np.ndarray) -> bytes:
    """Numbers not below 0, in two bytes each if all fit, else in four."""
    return x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.int32).tobytes()


def packed(docs: DataFrame, key: str, text: str, terms: list[tuple[str, float]], size: int = BLOCK, k: int = 1) -> DataFrame:
    """(ids, n, codes, tf, least): the counts of terms in docs, each partition of docs in blocks of up to `size` texts, by rising key.

    Texts without any of the terms are left out. The arrays are binary: keys, numbers of terms, terms' numbers, their counts, and
    what the cosines of a text's k nearest reach at least, as those inside its own block do.
    """
    coder = Coder(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            ids, n = np.array([x[0] for x in held], np.int64), np.array([len(x[1]) for x in held], np.int64)
            codes, tf = (_short(np.concatenate([x[i] for x in held])) for i in (1, 2))
            held.clear()
            own = _unpacked(*map(pa.py_buffer, (ids.tobytes(), n.tobytes(), codes, tf)), coder.idf)
            laid = Laid(own, len(coder.idf))
            least = _reached(_products(laid, laid), k, _slack(own, own))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids.tobytes(), n.tobytes(), codes, tf, least.tobytes())], names=["ids", "n", "codes", "tf", "least"])

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, tf = coder.counts(t)
                if len(codes):
                    held.append((name, codes.astype(np.int32), tf.astype(np.int32)))
                if len(held) == size:
                    yield block()
        if held:
            yield block()

    return docs.select(F.col(key).cast("long").alias("k"), folded(F.col(text)).alias("t")).mapInArrow(run, "ids binary, n binary, codes binary, tf binary, least binary")


def _unpacked(ids: pa.Buffer, n: pa.Buffer, codes: pa.Buffer, tf: pa.Buffer, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ids, n, codes, weights of the unit vectors) of a block of packed()."""
    ids, n = np.frombuffer(ids, np.int64), np.frombuffer(n, np.int64)
    codes, tf = (np.frombuffer(x, np.uint16 if x.size == 2 * n.sum() else np.int32).astype(np.int32) for x in (codes, tf))
    w = tf * idf[codes]
    return ids, n, codes, w / np.repeat(np.sqrt(np.add.reduceat(w * w, np.cumsum(n) - n)), n)


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each row, n places."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)


class Laid:
    """A block's weights in single precision, text by text."""

    def __init__(self, block: tuple[np.ndarray, ...], terms: int):
        _, n, codes, w = block
        self.n, self.rows, self.codes, self.w = len(n), np.repeat(np.arange(len(n), dtype=np.int32), n), codes, w.astype(np.float32)
        self.count = np.bincount(codes, minlength=terms)

    def columns(self, place: np.ndarray, begin: int, width: int) -> np.ndarray:
        """The matrix of the terms with places from begin on, `width` of them."""
        p = place[self.codes]
        own = np.flatnonzero((p >= begin) & (p < begin + width))
        m = np.zeros(self.n * width, np.float32)
        m[self.rows[own] * np.int64(width) + p[own] - begin] = self.w[own]
        return m.reshape(self.n, width)

    def of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, codes, weights) of the terms marked in some."""
        own = np.flatnonzero(some[self.codes])
        return self.rows[own], self.codes[own], self.w[own]


def _products(a: Laid, b: Laid) -> np.ndarray:
    """All dot products of two blocks in single precision: terms that many of their pairs share by columns, the others pair by pair."""
    near = None
    shared = a.count * b.count
    common = np.flatnonzero(shared > COLUMN * a.n * b.n)
    place = np.full(len(shared), -1, np.int32)
    place[common] = np.arange(len(common), dtype=np.int32)
    for begin in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - begin)
        x = a.columns(place, begin, width)
        y = x if a is b else b.columns(place, begin, width)
        near = x @ y.T if near is None else np.add(near, x @ y.T, out=near)
        x = y = None
    near = np.zeros((a.n, b.n), np.float32) if near is None else near
    shared[common] = 0
    (i, x, v), (j, y, w) = a.of(shared > 0), b.of(shared > 0)
    order = np.argsort(y, kind="stable")
    j, w = j[order], w[order]
    n = np.where(shared > 0, b.count, 0)
    start, n = (np.cumsum(n) - n)[x], n[x]
    part = np.cumsum(n) // PAIRS
    begin, flat = 0, near.ravel()
    for end in (np.flatnonzero(np.diff(part, append=-1)) + 1).tolist():
        at, m = _ragged(start[begin:end], n[begin:end]), n[begin:end]
        np.add.at(flat, np.repeat(i[begin:end] * np.int64(b.n), m) + j[at], np.repeat(v[begin:end], m) * w[at])
        begin = end
    return near


def _exact(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], r: np.ndarray, c: np.ndarray, terms: int) -> np.ndarray:
    """The dot products, in double precision, of a's texts r, rising, and b's texts c."""
    out, m = np.zeros(len(r)), np.zeros(terms)
    at, begin = ([0, *np.cumsum(x[1]).tolist()] for x in (a, b))
    own, last = a[2][:0], -1
    for place, (i, j) in enumerate(zip(r.tolist(), c.tolist())):
        if i != last:
            m[own] = 0
            own, last = a[2][at[i] : at[i + 1]], i
            m[own] = a[3][at[i] : at[i + 1]]
        out[place] = m.take(b[2][begin[j] : begin[j + 1]]) @ b[3][begin[j] : begin[j + 1]]
    return out


def best_places(rows: np.ndarray, ids: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k best: by falling cosine to nine places, then by id."""
    order = np.lexsort((ids, -np.round(near, 9), rows))
    r = rows[order]
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, int)
    return order[np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r)))) < k]


def _slack(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """The error of _products() in single precision: of m products each, all positive, less than (m + 8) / 2^24; and a margin for rounding."""
    return (min(a[1].max(), b[1].max()) + 8) / 2**24 + MARGIN


def _reached(near: np.ndarray, k: int, slack: float) -> np.ndarray:
    """What the k largest of each row reach at least."""
    return np.partition(near, -k, 1)[:, -k].astype(float) - slack if near.shape[1] >= k else np.full(len(near), -1.0)


class Best:
    """The k best partners so far of each text of a block, of those that reach what its k best do at least."""

    def __init__(self, names: np.ndarray, k: int, least: np.ndarray):
        self.names, self.k, self.floor = names.copy(), k, least.copy()
        self.rows, self.ids, self.near = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)

    def add(self, rows: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        rows, ids, near = np.append(self.rows, rows), np.append(self.ids, ids), np.append(self.near, near)
        keep = best_places(rows, ids, near, self.k)
        self.rows, self.ids, self.near = rows[keep], ids[keep], near[keep]

    def least(self, near: np.ndarray, slack: float) -> np.ndarray:
        """What a text's partners must reach in near, whose errors are below slack, to be among the k best."""
        least, n = self.floor.copy(), np.bincount(self.rows, minlength=len(self.names))
        full = n == self.k
        least[full] = np.maximum(least[full], self.near[np.cumsum(n)[full] - 1])
        low = np.maximum(least - slack, np.finfo(np.float32).tiny).astype(np.float32)
        many = np.flatnonzero(np.count_nonzero(near >= low[:, None], 1) > self.k)  # the k best of these alone are enough
        if len(many):
            low[many] = np.maximum(low[many], (_reached(near[many], self.k, slack) - slack).astype(np.float32))
        return low

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.names[self.rows]), pa.array(self.ids), pa.array(self.near), pa.array(np.round(self.near, 9))], names=["a", "b", "cosine", "near"])


def compared(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], near: np.ndarray, best: Best, other: Best | None, terms: int) -> None:
    """By near, their _products(), adds b's texts to the best of a's and, unless a block is set beside itself, a's to the best of b's.

    Single precision tells who may be among the best, doubles who is.
    """
    slack = _slack(a, b)
    wanted = near >= best.least(near, slack)[:, None]
    if other is not None:
        wanted |= near >= other.least(near.T, slack)[None, :]
    r, c = np.nonzero(wanted)
    cosine = _exact(a, b, r, c, terms)
    best.add(r, b[0][c], cosine)
    if other is not None:
        other.add(c, a[0][r], cosine)


def _looks(compact: str) -> np.ndarray:
    """How often a text without white space has each slot's pairs of letters, damped, as a vector of length 1."""
    v = np.sqrt(np.bincount(gram_slots(compact, KIND_SLOTS, SIZES[:1]), minlength=KIND_SLOTS))
    return v / max(1.0, np.sqrt(v @ v))


def alike(docs: DataFrame, key: str, text: str, n: int, parts: int) -> DataFrame:
    """docs (key, text) in `parts` partitions of about one size, texts of one kind and of like length side by side.

    Kinds, such as languages, are told by pairs of letters in the texts' beginnings; their means are those of some texts
    that the driver looks at. They decide only what is set beside what: terms that are common there are few.
    """
    shown = F.left(sub(F.col(text), "(?U)\\s+", ""), F.lit(SHOWN_CHARS))
    some = docs.sample(min(1.0, 1.2 * SHOWN_TEXTS / n), 0).select(F.coalesce(shown, F.lit("")).alias("t")).limit(SHOWN_TEXTS).collect()  # bounded
    seen = np.array([_looks(r.t) for r in some]).reshape(-1, KIND_SLOTS)
    means = seen[np.random.default_rng(0).permutation(len(seen))[:KINDS]]
    for _ in range(8):
        kind = (seen @ means.T).argmax(1)
        sums = np.array([seen[kind == i].sum(0) for i in range(len(means))]).reshape(-1, KIND_SLOTS)
        means = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [int((means @ _looks(t)).argmax()) if len(means) else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.int32()), batch.column(3)], names=[key, text, "__kind", "__size"])

    told = docs.select(key, text, F.coalesce(shown, F.lit("")).alias("t"), F.coalesce(F.length(text), F.lit(0)).alias("size"))
    told = told.mapInArrow(run, f"`{key}` {told.schema[key].dataType.simpleString()}, `{text}` string, __kind int, __size int")
    return told.repartitionByRange(parts, "__kind", "__size", key).select(key, text).coalesce(parts)


def block_pairs(packs: DataFrame, sides: int) -> DataFrame:
    """Each two blocks once, each block with itself, too, in the square of `sides` tasks at most, however finely files are split.

    Which of two blocks comes first is told by chance, so that tasks are alike.
    """
    left = packs.coalesce(sides)
    right = left.select(*(F.col(c).alias(f"{c}_b") for c in packs.columns))
    turned = F.pmod(F.xxhash64(F.col("block") + F.col("block_b")), F.lit(2)) == 1
    chosen = (F.col("block") == F.col("block_b")) | ((F.col("block") != F.col("block_b")) & ((F.col("block") < F.col("block_b")) != turned))
    return left.join(right.hint("shuffle_replicate_nl"), chosen)


def top_in_blocks(docs: DataFrame, key: str, text: str, terms: list[tuple[str, float]], k: int, size: int = BLOCK) -> DataFrame:
    """(a, b, cosine, near): the k texts nearest to each, itself among them, of those that share a term of `terms` with it; near is rounded, ties go to the smaller b.

    Every pair of texts is multiplied once, in blocks that a task reads from the shared folder: no pair is shuffled, only the
    k best of each text among the blocks that one task sets beside it. The blocks are dealt into few sides, so what is stored
    and shuffled grows with the texts, time with their square.
    """
    spark = docs.sparkSession
    small_batches(spark)  # a row has two blocks
    n, cores = docs.count(), spark.sparkContext.defaultParallelism
    size = max(SMALL_BLOCK, min(size, -(-n // (4 * cores))))
    parts, rows = max(1, -(-n // size)), docs.select(key, text)
    rows = alike(rows, key, text, n, parts) if n >= SORTED else rows.repartition(parts)
    packs = packed(rows, key, text, terms, size + size // 2, k).withColumn("block", F.monotonically_increasing_id())
    packs = cut(packs.repartition(parts) if n >= SORTED else packs)  # or long texts would meet in a few tasks
    width, idf = len(terms), np.array([x for _, x in terms], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _cut_grams.cache_clear()  # a worker that has cut texts before
        best: dict[int, Best] = {}
        last, a, own = None, (), None
        for batch in batches:
            for j in range(len(batch)):
                i, o = batch.column(5)[j].as_py(), batch.column(11)[j].as_py()
                if i != last:
                    last, a = i, _unpacked(*(batch.column(c)[j].as_buffer() for c in range(4)), idf)
                    own = Laid(a, width)
                b = a if i == o else _unpacked(*(batch.column(c)[j].as_buffer() for c in range(6, 10)), idf)
                for x, block, c in ((i, a, 4), (o, b, 10)):
                    if x not in best:
                        best[x] = Best(block[0], k, np.frombuffer(batch.column(c)[j].as_buffer(), float))
                near = _products(own, own if i == o else Laid(b, width))
                compared(a, b, near, best[i], best[o] if i != o else None, width)
        for x in best.values():
            yield x.batch()

    size_of = packs.agg(F.sum(F.octet_length("codes") + F.octet_length("tf"))).first()[0] or 0
    # Some tasks for each core, in whole rounds if that can be.
    fewest = max(math.isqrt(3 * cores), -(-size_of // SIDE))
    sides = min(range(fewest, fewest + 3), key=lambda s: -(-s * s // cores) / (s * s))
    pairs = block_pairs(packs, sides)
    pairs = pairs.mapInArrow(run, "a long, b long, cosine double, near double")
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("near"), "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
