"""Document quality by a linear-chain conditional random field over lines.

Each non-blank line is a position of a chain with two states, bad and good. Its features are measures of its own
text and of its neighbours'; learned transitions tie the states of neighbouring lines. Labels are of documents, and a
document teaches its label to all its lines; so training sees neighbours of one state only, and what it learns of
transitions is how far a line's state speaks for the next one's. A document's score is the mean of its lines'
forward-backward marginals of "good", weighted by the lines' lengths.

The model is fitted on a bounded sample of labelled documents: those first by the hash of doc_id, TRAIN_DOCS at most,
of which those are left out that would bring the sample above TRAIN_LINES lines. All lines of a document are learned
from, in chains of CHAIN neighbouring lines. Scoring reads every line of every text, as one chain.

Cases: a null or empty text, or one of blank lines, scores the sample's share of good documents; a document without
label, or whose label is null, is not learned from; contradicting labels of a document count as good if any is;
repeated rows are scored each; without any label all scores are 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.llm.shared import columns, from_rows, only_ids, small_batches
from quire.llm.words import pieces, words

TRAIN_DOCS, TRAIN_LINES, CHAIN = 6000, 100_000, 60
STEPS, RATE, RIDGE = 250, 0.05, 1e-3

_KIND = {
    "upper": range(65, 91), "lower": [*range(97, 123), *range(128, 256)], "digit": range(48, 58),
    "mark": [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?!"], "stop": b"!?", "soft": b".,;:'\"()-",
}
_MASKS = np.zeros((len(_KIND), 256), np.int32)
for _k, _bytes in enumerate(_KIND.values()):
    _MASKS[_k, list(_bytes)] = 1
N_OWN = len(_KIND) + 7


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, document, length) of every non-blank line of the texts data[at[i]:at[i+1]]."""
    cuts = np.unique(np.concatenate([at, np.flatnonzero(data == 10) + 1]))
    cuts = cuts[cuts <= len(data)]
    h, line, start, end = words(data, cuts)
    n = np.bincount(line, minlength=len(cuts) - 1)
    lines = np.flatnonzero(n)
    if not len(lines):
        return np.empty((0, 3 * N_OWN)), lines, lines
    a, b, n = cuts[lines], cuts[lines + 1], n[lines]
    doc = np.searchsorted(at, a, "right") - 1
    size = (b - a).astype(float)
    own = []
    for mask in _MASKS:
        sums = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        own.append((sums[b] - sums[a]) / size)
    number = np.zeros(len(cuts), np.int64)
    number[lines] = np.arange(len(lines))
    of = number[line]
    chars = np.bincount(of, end - start, len(lines))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    keys = np.unique((of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ h, return_index=True)[1]
    distinct = np.bincount(of[keys], minlength=len(lines))
    odd = (data[end - 1] < 128) & ~np.isin(data[end - 1], np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8))
    whole = np.bincount(of, (h >> np.uint64(16)).astype(float), len(lines)) + n
    seen = np.ones(len(lines))
    order = np.lexsort((np.arange(len(lines)), whole, doc))
    again = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    seen[order[0]] = 0
    seen[order[1:]] = again
    own += [np.log1p(size) / 5, np.minimum(chars / n, 40) / 10, np.bincount(of, same, len(lines)) / n, 1 - distinct / n, np.bincount(of, odd, len(lines)) / n, seen, np.log1p(n) / 5]
    own = np.stack(own, 1)
    before, after = np.empty_like(own), np.empty_like(own)
    before[0], before[1:] = own[0], own[:-1]
    after[-1], after[:-1] = own[-1], own[1:]
    head = np.ones(len(doc), bool)
    head[1:] = doc[1:] != doc[:-1]
    tail = np.append(head[1:], True)
    before[head], after[tail] = own[head], own[tail]
    return np.concatenate([own, before, after], 1), doc, size


@dataclass
class Chain:
    """The chain's parameters: feature means and scales, weights of "good", and the two states' transitions."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    step: np.ndarray  # step[i, j]: log potential of state j after state i
    prior: float

    def potentials(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight + self.bias

    def marginals(self, u: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """P(good) of each line; u: potentials; doc: ascending document of each line."""
        return _chains(u, doc, self.step)[0]


def _chains(u: np.ndarray, doc: np.ndarray, step: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, summed pair marginals). All chains move on together, longest first."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(doc)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")  # chains longer than t
    e = np.exp(step)
    fore, back, pair = np.empty((len(u), 2)), np.ones((len(u), 2)), np.zeros((2, 2))
    out = np.stack([1 / (1 + np.exp(np.clip(u, -30, 30))), 1 / (1 + np.exp(-np.clip(u, -30, 30)))], 1)
    for t in range(longest):
        i = first[: live[t]] + t
        f = out[i] if t == 0 else (fore[i - 1] @ e) * out[i]
        fore[i] = f / f.sum(1, keepdims=True)
    for t in range(longest - 1, 0, -1):
        i = first[: live[t]] + t
        b = (back[i] * out[i]) @ e.T
        back[i - 1] = b / b.sum(1, keepdims=True)
        if label is not None:
            p = fore[i - 1][:, :, None] * e * (out[i] * back[i])[:, None, :]
            pair += (p / p.sum((1, 2), keepdims=True)).sum(0)
    both = fore * back
    return both[:, 1] / np.maximum(both.sum(1), 1e-300), pair


def fit(x: np.ndarray, doc: np.ndarray, line: np.ndarray, label: np.ndarray) -> Chain:
    """Maximum likelihood with a ridge penalty, by Adam. doc, line and label are each line's, ordered by doc and line."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -6, 6)
    docs, of = np.unique(doc, return_inverse=True)
    chain = np.cumsum(np.append(True, (of[1:] != of[:-1]) | (line[1:] // CHAIN != line[:-1] // CHAIN)))
    prior = float(np.bincount(of, label).astype(bool).mean()) if len(docs) else 0.5
    same = chain[1:] == chain[:-1]
    true_pair = np.zeros((2, 2))
    np.add.at(true_pair, (label[:-1][same], label[1:][same]), 1)
    w, step = np.zeros(x.shape[1] + 1), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, STEPS + 1):
        p, pair = _chains(z @ w[:-1] + w[-1], chain, step, label)
        gap = label - p
        grad = np.concatenate([z.T @ gap, [gap.sum()], (true_pair - pair).ravel()]) / len(x) - RIDGE * np.concatenate([w[:-1], [0], step.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, step = w + move[:-4], step + move[-4:].reshape(2, 2)
    return Chain(mean, scale, w[:-1], float(w[-1]), step, prior)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality") -> Chain:
    """Fits the chain on labels (doc_id, label) of documents for which usable holds."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.where(usable) if usable is not None else known
    picked = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row"))
    sizes = only_ids(texts, picked.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit("\n")) + 1).alias("n"))
    y, total = {}, 0
    for r in picked.join(sizes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # TRAIN_DOCS rows at most
        if r.n is not None and total + r.n <= TRAIN_LINES:
            y[r.doc_id], total = int(r.y > 0), total + r.n
    chosen = from_rows(docs.sparkSession, [(i,) for i in y], {"doc_id": pa.int64()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                x, doc, _ = line_features(data, at)
                line = np.arange(len(doc)) - np.searchsorted(doc, doc)
                ids, rows = (pa.array(batch.column(k).to_numpy(zero_copy_only=False)[i:j][doc], pa.int64()) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, rows, pa.array(line), pa.array(list(x.astype("f4")), pa.list_(pa.float32()))], names=["doc_id", "row", "line", "x"])

    lines = only_ids(texts, chosen, "doc_id").mapInArrow(run, "doc_id long, row long, line long, x array<float>").toPandas()
    lines = lines.sort_values(["doc_id", "row", "line"], kind="stable")
    if not len(lines):
        return Chain(np.zeros(3 * N_OWN), np.ones(3 * N_OWN), np.zeros(3 * N_OWN), 0.0, np.zeros((2, 2)), 0.5)
    return fit(np.stack(lines.x.to_numpy()).astype(float), lines.groupby(["doc_id", "row"]).ngroup().to_numpy(), lines.line.to_numpy(), lines.doc_id.map(y).to_numpy())


def score(docs: DataFrame, model: Chain, out: str = "score") -> DataFrame:
    """All columns of docs with out, the length-weighted mean marginal of "good" (0 to 1, never null).

    A column of docs that is named like out gives way to it.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    rows = docs.withColumn("text", F.col("text").cast("string")).select([c for c, name in zip(columns(docs), docs.columns) if name in kept])
    rows = rows.toDF(*(f"c{k}" for k in range(len(kept))))  # names that Arrow functions take, whatever the columns'
    names, at_text = rows.columns, kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in pieces(batch.column(at_text)):  # handed on piece by piece, as whole texts go with their scores
                score = np.full(j - i, model.prior)
                x, doc, size = line_features(data, at)
                if len(x):
                    p = model.marginals(model.potentials(x), doc)
                    total = np.bincount(doc, size, j - i)
                    score = np.where(total > 0, np.bincount(doc, size * p, j - i) / np.maximum(total, 1), model.prior)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(np.clip(score, 0, 1))], names=[*names, "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())])).toDF(*kept, out)
