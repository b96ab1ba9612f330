"""Toxic spans and document scores from a linear-chain conditional random field.

A token is a run of ASCII letters, digits and bytes above 127, A-Z lower-cased; its features are the word,
its prefixes of 3 to 7 bytes and both neighbours, hashed to ``BUCKETS`` weights. The field has two
states, clean and toxic. It is trained on labelled tokens: in documents labelled toxic, a token is
toxic if its word or a prefix marks toxic documents (found at least ``ODDS`` times as often as in clean
ones, and in ``COMMON`` of them, or in ``SUPPORT`` of them that have no other mark); all
other tokens are clean. Forward-backward gives each token's
marginal. A document's score is a logistic function of the largest marginal and of the
expected number of toxic tokens, fitted on labelled documents.

Forward and backward passes run over all tokens of many texts at once: a text's first transfer matrix
forgets what stands before it, and products of 2 x 2 matrices are taken block by block, so
a text of any length needs no Python code per token.

Learning uses a bounded sample of labelled documents, about ``PER_CLASS`` of each class; scoring reads all
rows and whole texts. Defined results: null or empty text is scored as a text without
toxic tokens; without labels of both classes every score is 0; rows without an id are scored, never
learned from, and count as held out; of conflicting labels of one id, toxic wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm import words as W
from tablegauge.llm.language import held_out

BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 6, 7)
PER_CLASS = 500
MARKED, COMMON, SUPPORT, ODDS = 5, 0.05, 0.01, 20.0
STEPS, RATE, DECAY = 40, 0.5, 1e-4
BLOCK = 128
OTHER = np.ones(256, bool)
OTHER[np.r_[48:58, 65:91, 97:123, 128:256]] = False


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (tokens x features), first token of each text, starts and ends in the bytes of their text."""
    data, at = W.buffers(texts)
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, at, OTHER)
    n = len(starts)
    word = W.hashes(data, starts, ends, OTHER)
    lengths = ends - starts
    places = starts[:, None] + np.arange(max(PREFIXES))
    head = data[np.minimum(places, max(len(data) - 1, 0))] if n else np.zeros((0, max(PREFIXES)), np.uint8)
    terms = (head.astype(np.uint64) + np.uint64(1)) * W.factors(64)[32 : 32 + max(PREFIXES)]
    sums = np.cumsum(terms, axis=1, dtype=np.uint64)
    columns = [word]
    for k in PREFIXES:
        columns.append(np.where(lengths >= k, W.mixed(sums[:, k - 1] + np.uint64(k)), np.uint64(0)))
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:] = W.mixed(word[:-1] + np.uint64(101))
    after[:-1] = W.mixed(word[1:] + np.uint64(102))
    filled = first[:-1][first[:-1] < first[1:]]
    before[filled] = 0
    after[first[1:][first[:-1] < first[1:]] - 1] = 0
    features = (np.stack([*columns, before, after], axis=1) >> np.uint64(42)).astype(np.int32)
    base = np.repeat(at[:-1], np.diff(first))
    return features, first, starts - base, ends - base


def _carried(m: np.ndarray) -> np.ndarray:
    """For every position, the row vector after it: ones times the product of all matrices up to it, scaled."""
    n = len(m)
    if n <= BLOCK:
        out, row = np.empty((n, 2)), np.ones(2)
        for k in range(n):
            row = row @ m[k]
            row = row / row.sum()
            out[k] = row
        return out
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks * BLOCK, 2, 2))
    padded[:n] = m
    padded[n:] = np.eye(2)
    inside = padded.reshape(blocks, BLOCK, 2, 2)
    for k in range(1, BLOCK):
        a, b = inside[:, k - 1], inside[:, k]
        product = a[:, :, 0, None] * b[:, None, 0, :] + a[:, :, 1, None] * b[:, None, 1, :]
        inside[:, k] = product / product.max(axis=(1, 2), keepdims=True)
    entering = np.ones((blocks, 2))
    entering[1:] = _carried(np.ascontiguousarray(inside[:, -1]))[:-1]
    rows = entering[:, None, 0, None] * inside[:, :, 0, :] + entering[:, None, 1, None] * inside[:, :, 1, :]
    rows = rows.reshape(-1, 2)[:n]
    return rows / rows.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Model:
    """Weights of the nonzero features, the field's 2 x 2 transition scores (clean, toxic), the score's logistic."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    logistic: np.ndarray

    @property
    def empty(self) -> bool:
        return not len(self.logistic)


@lru_cache(maxsize=2)
def _table(features: bytes, weights: bytes) -> np.ndarray:
    table = np.zeros(BUCKETS, np.float32)
    table[np.frombuffer(features, np.int32)] = np.frombuffer(weights, np.float32)
    return table


def _transfers(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Per token the scaled matrix from the state before to its own state."""
    m = np.exp(transition)[None] * np.ones((len(score), 1, 1))
    opens = first[:-1][first[:-1] < first[1:]]
    m[opens] = 1.0
    toxic = np.exp(np.clip(score, -30, 30))
    m[:, :, 1] *= toxic[:, None]
    return m / m.max(axis=(1, 2), keepdims=True)


def marginals(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability of being toxic, and of each pair of states with the token before it."""
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    m = _transfers(score, first, transition)
    ahead = _carried(m)
    back = np.ones((n, 2))
    back[:-1] = _carried(np.ascontiguousarray(m[:0:-1].transpose(0, 2, 1)))[::-1]
    state = ahead * back
    state /= state.sum(axis=1, keepdims=True)
    before = np.ones((n, 2))
    before[1:] = ahead[:-1]
    pair = before[:, :, None] * m * back[:, None, :]
    return state[:, 1], pair / pair.sum(axis=(1, 2), keepdims=True)


def _gathered(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: one, the log-odds of its largest marginal, the logarithm of its expected toxic tokens."""
    texts = len(first) - 1
    some = first[:-1] < first[1:]
    top, total = np.zeros(texts), np.zeros(texts)
    if len(p):
        at = first[:-1][some]
        top[some] = np.maximum.reduceat(p, at)
        total[some] = np.add.reduceat(p, at)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(texts), np.log(top / (1 - top)), np.log1p(total)], axis=1)


def _score(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
    features, first, starts, ends = tokens(texts)
    if model.empty:
        return np.zeros(len(texts)), np.zeros(len(features)), (first, starts, ends)
    table = _table(model.features.tobytes(), model.weights.tobytes())
    emission = np.full(len(features), model.bias)
    for k in range(features.shape[1]):
        emission += table[features[:, k]]
    p, _ = marginals(emission, first, model.transition)
    return 1 / (1 + np.exp(-np.clip(_gathered(p, first) @ model.logistic, -35, 35))), p, (first, starts, ends)


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for low, high in W.slices(texts):
            features, first, _, _ = tokens(texts[low:high])
            flat = pa.array(features.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array((first * features.shape[1]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic")[low:high], batch.column("draw")[low:high], lists], ["toxic", "draw", "features"]
            )


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Token features of about ``per_class`` labelled documents of each class."""
    rows = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id"), 5, 0))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {row["toxic"]: row["n"] for row in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.xxhash64(F.col("id"), F.lit("toxicity")) / F.lit(2.0**64) + 0.5
    share = F.when(F.col("toxic") == 1, per_class / max(counts.get(1, 1), 1)).otherwise(per_class / max(counts.get(0, 1), 1))
    # about 2 * per_class rows of an id, a label and a number: a bounded broadcast
    drawn = F.broadcast(rows.select("id", "toxic", draw.alias("draw")).where(F.col("draw") < share))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.join(drawn, "id").select("toxic", "draw", "text").mapInArrow(
        _tokenised, "toxic int, draw double, features array<int>"
    )


def marked(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The words and prefixes that mark toxic documents: common marks, then marks of documents without one.

    A group of near copies shares all its words, so a rarer mark counts only by the documents that no
    stronger mark explains.
    """
    own = features[:, : 1 + len(PREFIXES)]
    pairs = np.unique(own.astype(np.int64).ravel() * len(toxic) + np.repeat(doc, own.shape[1]))
    feature, where = pairs // len(toxic), pairs % len(toxic)
    names, at = np.unique(feature, return_inverse=True)
    bad = np.bincount(at, toxic[where])
    good = np.bincount(at) - bad
    n_bad, n_good = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
    marks = (((bad + 0.1) / n_bad) / ((good + 0.1) / n_good) >= ODDS) & (names != 0)
    chosen = marks & (bad >= max(MARKED, COMMON * n_bad))
    rows = (toxic[where] == 1) & marks[at]
    at, where = at[rows], where[rows]
    while True:
        explained = np.zeros(len(toxic), bool)
        explained[where[chosen[at]]] = True
        new = np.bincount(at[~explained[where]], minlength=len(names))
        best = int(new.argmax()) if len(new) else 0
        if not len(new) or new[best] < max(MARKED, SUPPORT * n_bad):
            return names[chosen]
        chosen[best] = True


def fit(documents: list[tuple[int, np.ndarray]]) -> Model:
    """Train the field on the labelled tokens of (label, features) documents, then the document score."""
    width = 3 + len(PREFIXES)
    documents = [(label, np.asarray(f, np.int32).reshape(-1, width)) for label, f in documents]
    toxic = np.array([label for label, _ in documents], dtype=np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, np.zeros((2, 2)), np.zeros(0))
    sizes = np.array([len(f) for _, f in documents])
    features = np.concatenate([f for _, f in documents])
    first = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(documents)), sizes)
    chosen = np.zeros(BUCKETS, bool)
    chosen[marked(features, doc, toxic)] = True
    truth = (chosen[features[:, : 1 + len(PREFIXES)]].any(axis=1) & (toxic[doc] == 1)).astype(float)
    names, at = np.unique(features, return_inverse=True)
    at = at.reshape(features.shape).astype(np.int32)
    columns = range(width)
    inner = np.ones(len(truth), bool)
    inner[first[:-1][sizes > 0]] = False
    seen = np.zeros((2, 2))
    before = np.concatenate(([0.0], truth[:-1]))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = (inner & (before == i) & (truth == j)).sum()
    w, bias, transition = np.zeros(len(names)), 0.0, np.zeros((2, 2))
    squares, bias_squares, transition_squares = np.full(len(names), 1e-8), 1e-8, np.full((2, 2), 1e-8)

    def counted(share):
        return sum(np.bincount(at[:, k], share, minlength=len(names)) for k in columns)

    def emission():
        return sum(w[at[:, k]] for k in columns) + bias

    wanted = counted(truth)
    for _ in range(STEPS):
        p, pair = marginals(emission(), first, transition)
        gradient = wanted - counted(p) - DECAY * len(truth) * w / len(names)
        squares += gradient**2
        w += RATE * gradient / np.sqrt(squares)
        g = (truth - p).sum()
        bias_squares += g * g
        bias += RATE * g / np.sqrt(bias_squares)
        turn = seen - pair[inner].sum(axis=0)
        transition_squares += turn**2
        transition = transition + RATE * turn / np.sqrt(transition_squares)
    w[(names == 0) | (np.abs(w) < 0.02)] = 0.0
    p, _ = marginals(emission(), first, transition)
    x = _gathered(p, first)
    logistic = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2]) * len(toxic)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ logistic, -35, 35)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + ridge
        logistic = logistic + np.linalg.solve(hessian, x.T @ (toxic - q) - ridge @ logistic)
    kept = w != 0
    return Model(names[kept].astype(np.int32), w[kept].astype(np.float32), float(bias), transition, logistic)


def learned(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows = training_sample(docs, labels, per_class).toPandas().sort_values(["draw", "toxic"])
    return fit(list(zip(rows["toxic"], rows["features"])))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in W.slices(batch.column("text")):
            part = batch.slice(low, high - low)
            scores, _, _ = _score(model, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every text; without a ``model`` one is learned from ``labels``."""
    model = learned(docs, labels) if model is None else model
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInArrow(lambda batches: _scored(batches, model), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def _spanned(batches: Iterator[pa.RecordBatch], model: Model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in W.slices(batch.column("text")):
            part = batch.slice(low, high - low)
            _, p, (first, starts, ends) = _score(model, part.column("text"))
            rows = []
            for k, text in enumerate(part.column("text").to_pylist()):
                hits = np.flatnonzero(p[first[k] : first[k + 1]] >= least) + first[k]
                raw = (text or "").encode()
                # offsets count code points: bytes that do not continue one
                counts = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))) if len(hits) else None
                rows.append([{"start": int(counts[starts[h]]), "end": int(counts[ends[h]]), "p": float(p[h])} for h in hits])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])


def spans(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id and the toxic tokens of every text: code point offsets (end exclusive) and marginal."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        lambda batches: _spanned(batches, model, least), f"doc_id {kind}, spans array<struct<start:long,end:long,p:double>>"
    )
