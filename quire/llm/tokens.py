"""Token ids in ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Texts are dealt by ranges of doc_id, so each ORC file holds one range in ascending order. Inside a file ORC keeps
per-stripe and per-row-group minima and maxima of doc_id and a Bloom filter, by which a reader skips what it does not
need; token ids are an integer list, which ORC stores as run-length encoded version 2 integers. Readers take stripes
in parallel.

The encoder gives exactly the ids of the tokenizers library. For plain texts (characters below U+0180, without
control characters or a special token's string) it encodes each distinct piece once with the library's own BPE model
and keeps the ids; every other text goes through the library as a whole.

Cases: a null or empty text has only the end id; a null doc_id sorts first; repeated rows and equal ids are kept, by
the hash of their texts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.shared import new_path, small_batches, stored

END_ID = 2
KEPT_WORDS, KEPT_PARTS = 250_000, 700_000  # per Python worker; a cache starts anew beyond it
ORC = {"compression": "zlib", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20), "orc.create.index": "true"}
TEXT_PER_FILE = 64 << 20  # characters of text that one file takes, about

#: Texts by which a vocabulary shows whether its ids can be made piece by piece.
PROBES = ("The Quick brown fox, isn't it? 12 3.5% a_b", "  Été naïve ¿qué? Größe\tx'd WE'LL ... (ok) #1 £5", "x", " \n ")
#: The split rule of the word vocabulary, for characters below U+0180.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\s\w]|_)+")
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(128, 192), 0xC2, 0xC3, 0xC4, 0xC5])
_ODD = re.compile(rb"\xc2[\x80-\xa0]|\xc4\xb0")


def _plain(text: str) -> bool:
    """Whether text has only printable ASCII, plain white space and U+00A1 to U+017F but for U+0130, and no special token's start."""
    raw = text.encode()
    return not raw.translate(None, _PLAIN) and b"<|" not in raw and (text.isascii() or not _ODD.search(raw))


class Words(dict):
    """Ids of words, made on first use."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.make(word)
        return found


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary uses for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.words = Words(lambda w: b"".join([self.parts[p] for p in _PIECE.findall(w)]))
        self.parts = Words(self._part)
        self.fast = True
        self.fast = self._agrees()

    def _agrees(self) -> bool:
        """Whether ids made piece by piece are the library's for PROBES: a vocabulary of another kind goes through the library."""
        try:
            return all(self.encode(t) == np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in PROBES)
        except Exception:  # another kind of model may not know the pieces at all
            return False

    def _part(self, p: str) -> bytes:
        spelled = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.fast or not _plain(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for cache, most in ((self.words, KEPT_WORDS), (self.parts, KEPT_PARTS)):
            if len(cache) > most:
                cache.clear()
        known = self.words
        return b"".join([known[w] for w in text.lower().split()])


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def encode(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, place, tokens array<int>) of every row of docs, end_id appended; place counts a partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, place = _encoder(vocabulary), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                ids = [enc.encode(t) + end for t in part.column(1).to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                places = pa.array(np.arange(place, place := place + len(part)))
                yield pa.RecordBatch.from_arrays([part.column(0), places, pa.ListArray.from_arrays(at, flat)], names=["doc_id", "place", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, place long, tokens array<int>")


def write_orc(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Writes the ids of all rows of docs as ORC files of ascending doc_id ranges; returns the folder."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or new_path(spark, "tokens")
    chars = docs.select(F.sum(F.length("text"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, -(-chars // TEXT_PER_FILE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    encode(rows, vocabulary, end_id).write.options(**ORC).orc(path)
    return path


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, place, tokens, file): the ids as written, the row's place in its file and the file's number."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return spark.read.schema("doc_id long, place long, tokens array<int>").orc(path).withColumn("file", number)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of the little-endian ids).

    start needs a running sum over all documents: the files' totals are summed on the driver's side of a small
    aggregate (a row per file), the rest inside each file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            at = np.asarray(ids.offsets).astype(np.int64)
            flat = np.ascontiguousarray(np.asarray(ids.values), "<i4").view(np.uint8)
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(crc, pa.int64()), batch.column(3)], names=["doc_id", "place", "n_tokens", "ids_crc32", "file"])

    rows = read_orc(spark, path).mapInArrow(run, "doc_id long, place long, n_tokens long, ids_crc32 long, file long")
    rows = stored(rows, "digests")
    each = W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(each), F.lit(0)))
    files = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).select("file", F.coalesce(F.sum("total").over(files), F.lit(0)).alias("ahead"))
    return rows.join(F.broadcast(totals), "file").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
