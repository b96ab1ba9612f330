"""Language of whole texts: sparse multinomial logistic regression on character n-grams.

A text is lower-cased, runs of other characters than letters become one blank, and its
1-, 2- and 3-grams are hashed to ``BUCKETS`` features. A feature's value is TF-IDF:
its share of the text's n-grams times ``log(N / (1 + documents with it)) + 1``. The weights are
learned by FTRL-proximal, whose L1 and L2 terms (elastic net) leave most of them zero, and the
softmax is calibrated by one temperature fitted on rows the weights never saw.

Scoring is linear in the n-grams, so a text of any length is scored in one pass over its
characters. Learning uses a bounded sample, at most about ``PER_LANGUAGE`` rows of each language, drawn by
a hash of the id; everything else reads all rows.

Defined results: null text or text without a letter is ``und`` with score 0, so is every text when
there is nothing to learn from; rows without an id are scored, never learned from, and count
as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm import words as W

BUCKETS = 1 << 16
PER_LANGUAGE = 500
MAX_LANGUAGES = 500
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2e-4, 1e-4
_ORDER = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Per code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of every n-gram, the text it belongs to, and per text whether it has a letter."""
    lowered = [f" {t.lower()} " if t else " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    letter = letters()[points]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    codes = np.where(letter, points, 0)[keep].astype(np.uint32)
    owner = owner[keep]
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[codes > 0]] = True
    features, owners = [], []
    value = np.zeros(len(codes), np.uint32)
    for n in range(3):
        size = len(codes) - n
        if size <= 0:
            break
        value = value[:size] * np.uint32(0x01000193) + codes[n:] * _ORDER[n]
        hashed = value * np.uint32(2654435761) + np.uint32(n)
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        within = owner[:size] == owner[n:]
        if n == 0:
            within &= codes > 0
        features.append((hashed[within] >> np.uint32(16)).astype(np.int32))
        owners.append(owner[:size][within])
    return np.concatenate(features), np.concatenate(owners), has_letter


@dataclass(frozen=True)
class Model:
    """Languages, the weight of each feature and language (IDF included), biases, temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        features, owners, has_letter = grams(texts)
        total = np.maximum(np.bincount(owners, minlength=len(texts)), 1)
        sums = np.stack(
            [np.bincount(owners, self.weights[k][features], minlength=len(texts)) / total for k in range(len(self.languages))], axis=1
        ) if self.languages else np.zeros((len(texts), 0))
        return sums + self.bias, has_letter

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        logits, has_letter = self.logits(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        names = [self.languages[k] if known else "und" for k, known in zip(best, has_letter)]
        return names, np.where(has_letter, p[np.arange(len(best)), best], 0.0)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features and their shares, per text."""
    for batch in batches:
        texts = batch.column("text")
        for low, high in W.slices(texts):
            features, owners, has_letter = grams(texts[low:high].to_pylist())
            pairs, counts = np.unique(owners.astype(np.int64) * BUCKETS + features, return_counts=True)
            row, feature = pairs // BUCKETS, (pairs % BUCKETS).astype(np.int32)
            share = counts / np.maximum(np.bincount(row, counts, minlength=high - low), 1)[row]
            ends = np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32)
            columns = [
                batch.column("lang")[low:high],
                batch.column("draw")[low:high],
                pa.ListArray.from_arrays(pa.array(ends), pa.array(feature)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(share.astype(np.float32))),
            ]
            out = pa.RecordBatch.from_arrays(columns, ["lang", "draw", "features", "shares"])
            yield out.filter(pa.array(has_letter))


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether the id's checksum falls in the held-out part; an id that is null is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(True))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Features of at most about ``per_language`` learnable rows of each language."""
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    draw = F.xxhash64(F.col("doc_id"), F.lit("language")) / F.lit(2.0**64) + 0.5
    wanted = F.lit(False)
    for row in counts:
        wanted = wanted | ((F.col("lang") == row["lang"]) & (draw < per_language / row["n"]))
    return rows.where(wanted & F.col("text").isNotNull()).select("lang", "text", draw.alias("draw")).mapInArrow(
        _counted, "lang string, draw double, features array<int>, shares array<float>"
    )


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Learn from (language, features, shares) rows: four fifths for the weights, the rest for the temperature."""
    languages = tuple(sorted({row[0] for row in sample}))
    classes = len(languages)
    if not classes:
        return Model((), np.zeros((0, BUCKETS), np.float32), np.zeros(0), 1.0)
    code = {name: k for k, name in enumerate(languages)}
    rows = [(code[name], f, s) for name, f, s in sample]
    check = rows[::5] if len(rows) >= 50 else rows
    learn = [r for k, r in enumerate(rows) if k % 5] if len(rows) >= 50 else rows
    seen = np.zeros(BUCKETS)
    for _, f, _ in learn:
        seen[f] += 1
    idf = np.log(len(learn) / (1 + seen)) + 1
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def weight(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in order.permutation(len(learn)):
            label, f, s = learn[k]
            x = s * idf[f]
            w, wb = weight(z[f], n[f]), weight(zb, nb)
            error = _softmax(x @ w + wb)
            error[label] -= 1
            g = x[:, None] * error[None]
            z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA * w
            n[f] += g * g
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / ALPHA * wb
            nb += error * error
    weights, bias = weight(z, n) * idf[:, None], weight(zb, nb)
    logits = np.array([s @ weights[f] + bias for _, f, s in check])
    truth = np.array([label for label, _, _ in check])

    def loss(t):
        return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-300)).mean()

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 121))
    return Model(languages, np.ascontiguousarray(weights.T.astype(np.float32)), bias, float(min(grid, key=loss)))


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    rows = training_sample(docs, per_language).toPandas().sort_values(["draw", "lang"])
    return fit(list(zip(rows["lang"], rows["features"], rows["shares"])))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("text")
        for low, high in W.slices(batch.column("text")):
            part = batch.slice(low, high - low)
            names, scores = model.predict(part.column("text").to_pylist())
            columns = [c for k, c in enumerate(part.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])


def verdict(text: Column, model: Model) -> Column:
    """A struct of lang_pred and score of a text, for use beside other columns."""

    def scored(texts: pd.Series) -> pd.DataFrame:
        found = pa.array(texts, pa.string(), from_pandas=True)
        names, scores = [], []
        for low, high in W.slices(found):
            some = model.predict(found[low:high].to_pylist())
            names += some[0]
            scores += list(some[1])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    scored.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(scored, "lang_pred string, score double")(text.cast("string"))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every text; without a ``model`` one is learned from ``docs``."""
    model = learned(docs) if model is None else model
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInArrow(lambda batches: _scored(batches, model), f"doc_id {kind}, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
