"""Signature sets, edits and near pairs against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tablegauge.llm import spotsigs
from tablegauge.llm.quality import COMMON

STOP = set(COMMON)


def chains(text):
    """Readable signatures; single words where there are too few."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = []
    for i, w in enumerate(words):
        rest = [x for x in words[i + 1 :] if x not in STOP]
        if w in STOP and len(rest) >= 2:
            out.append((w, *rest[:2]))
    return set(out) if len(set(out)) >= 3 else set(words) or ({text} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(n, seed):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefghijkläéß", k=draw.randrange(2, 6))) for _ in range(300)] + ["the", "of", "and", "der", "la"] * 30
    return [" ".join(draw.choices(vocabulary, k=draw.randrange(0, 60))) + draw.choice(["", ".", "!!\n"]) for _ in range(n)]


def test_rows_equal_python(spark):
    rows = [(7 * i * i, t) for i, t in enumerate(texts(60, 3))] + [(1, None), (2, "###"), (3, "The THE the of x y")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in spotsigs.compared(docs).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after, r = text or "", after or "", got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == 8 * len(chains(text)) and len(r.edited_fingerprint) == 8 * len(chains(edited))
        assert abs(r.near_edited - jaccard(chains(text), chains(edited))) < 1e-9, text
        assert abs(r.near_next - jaccard(chains(text), chains(after))) < 1e-9


def test_near_pairs_equal_brute_force(spark):
    draw = random.Random(4)
    rows = list(enumerate(texts(30, 5)))
    for k in range(30, 70):
        words = draw.choice(rows)[1].split()
        for _ in range(draw.randrange(3)):
            if words:
                words[draw.randrange(len(words))] = "new" + str(k)
        rows.append((k, " ".join(words)))
    groups = {}
    for i, t in rows:
        if chains(t):
            groups.setdefault(frozenset(chains(t)), i)
    want = set()
    for a, i in groups.items():
        for b, j in groups.items():
            if i < j and jaccard(a, b) >= 0.8:
                want.add((i, j))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.a, r.b) for r in spotsigs.near_pairs(docs).collect()} == want and len(want) > 5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "the cat sat on the mat"), (5, "x"), (5, "x"), (9, "the long word " * 100000)], "doc_id long, text string")
    got = spotsigs.compared(docs).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    assert [r.near_next for r in got if r.doc_id is None] == [0.0]
    assert spotsigs.compared(docs.limit(0)).count() == 0
    assert spotsigs.compared(docs.where(F.col("doc_id") == 9)).first().near_next == 1.0
