"""Marginals against brute force, held-out accuracy, spans and defined results."""

import itertools
import random

import numpy as np
import pytest

from tablegauge.llm import toxicity as T

BAD = ["wretch", "vileling", "Ñoñazo"]


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(2)
    docs, labels = [], []
    for i in range(500):
        words = ["".join(draw.choices(["ka", "lo", "mi", "ne", "su", "ra"], k=3)) for _ in range(40)]
        toxic = int(draw.random() < 0.3)
        for _ in range(toxic * 3):
            words[draw.randrange(40)] = draw.choice(BAD) + draw.choice(["", ",", "!!"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, toxic))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score string").cache(),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(),
    )


@pytest.mark.parametrize("block", [2, 3, 128])
def test_marginals_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    draw = np.random.default_rng(1)
    score, transition = draw.normal(0, 2, 12), draw.normal(0, 1, (2, 2))
    first = np.array([0, 5, 5, 6, 12])
    p, pair = T.marginals(score, first, transition)
    for low, high in zip(first[:-1], first[1:]):
        total, one = 0.0, np.zeros(high - low)
        for path in itertools.product((0, 1), repeat=high - low):
            s = sum(score[low + k] for k, y in enumerate(path) if y) + sum(transition[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(s)
            one += np.exp(s) * np.array(path)
        if high > low:
            assert np.allclose(p[low:high], one / total)
    assert np.allclose(pair[1].sum(axis=0), [1 - p[1], p[1]]) and np.allclose(pair[1].sum(axis=1), [1 - p[0], p[0]])


def test_held_out_accuracy_and_spans(tables):
    docs, labels = tables
    model = T.learned(docs, labels)
    rows = T.score(docs, model=model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 500 and 50 < len(held) < 150
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    text = {r.doc_id: r.text for r in docs.collect()}
    spans = [(text[r.doc_id], s) for r in T.spans(docs, model).collect() for s in r.spans]
    hits = [t[s.start : s.end] for t, s in spans]
    assert len(hits) > 200 and sum(h in BAD for h in hits) / len(hits) > 0.95


def test_odd_rows(spark, tables):
    docs, labels = tables
    model = T.learned(docs, labels)
    rows = [(1, None), (2, ""), (3, "\u20ac !!"), (None, "wretch wretch"), (5, "kalomi " * 100000), (5, "wretch")]
    got = T.score(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {(r.doc_id, r.predicted) for r in got} == {(1, 0), (2, 0), (3, 0), (None, 1), (5, 0), (5, 1)}


def test_without_labels(spark, tables):
    docs, labels = tables
    assert {r.score for r in T.score(docs.limit(5), labels.limit(0)).collect()} == {0.0}
    assert T.score(docs.limit(0), labels).count() == 0
