"""Counts and distances against brute force."""

import math
import random
import re
from collections import Counter

from tablegauge.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    words = WORD.findall(text or "")
    places = {}
    for k in range(len(words) - 2):
        places.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {p + d for v in places.values() if len(v) > 1 for p in v for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, chars int")
    return {r.doc_id: r for r in quality.judged(docs).collect()}


def test_counts_equal_brute_force(spark):
    draw = random.Random(8)
    parts = ["a", "b", "c", "é", "the", "#x", "<p>", "\n", "\t", "  ", "\x0b", "a b c", " "]
    texts = [None, "", " \n", "a a a a", "a b c a b c", "x"] + [" ".join(draw.choices(parts, k=draw.randrange(80))) for _ in range(80)]
    got = run(spark, [(i, t, draw.choice(["en", "de", None])) for i, t in enumerate(texts)])
    for i, text in enumerate(texts):
        r, want = got[i], counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(text)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def classes(text):
    known = [len(re.findall(f"[{c}]", text, re.A)) for c in quality.CLASSES.values()]
    return [*known, max(len(text) - sum(known), 0)]


def jensen_shannon(a, b):
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    total = sum(0.5 * x * math.log2(x / ((x + y) / 2)) for x, y in zip(p, q) if x)
    return math.sqrt(total + sum(0.5 * y * math.log2(y / ((x + y) / 2)) for x, y in zip(p, q) if y))


def test_distances_equal_brute_force_and_judge(spark):
    draw = random.Random(9)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randrange(2, 7))) for _ in range(900)]
    plain = [" ".join(draw.choices(vocabulary + ["the", "of", "and"] * 100, k=120)) + "." for _ in range(30)]
    odd = " ".join(w + "###%%%" for w in draw.choices(vocabulary, k=120))
    short = " ".join(draw.choices("xwz", k=60))
    got = run(spark, [(i, t, "en") for i, t in enumerate([*plain, odd, short])])
    pooled = [sum(x) for x in zip(*(classes(t) for t in [*plain, odd, short]))]
    words = [Counter(w.lower() for w in WORD.findall(t)) for t in [*plain, odd, short]]
    names = sorted(set(quality.COMMON))
    common = [sum(c[n] for c in words) for n in names]
    for i, text in enumerate(plain):
        assert math.isclose(got[i].char_distance, jensen_shannon(classes(text), pooled), abs_tol=1e-9)
        if sum(words[i][n] for n in names) < quality.LEAST_COMMON:
            assert got[i].word_distance is None
            continue
        assert math.isclose(got[i].word_distance, jensen_shannon([words[i][n] for n in names], common), abs_tol=1e-9)
    assert all(got[i].kept for i in range(30)) and not got[30].kept and not got[30].base_failed
    assert got[31].char_distance is None and got[31].word_distance is None


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "w " * 200000, None), (1, "a", "x"), (1, "a", "x")], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.n_words, r.n_repeat_words) for r in quality.judged(docs).collect()]
    assert sorted(got, key=str) == [(1, 1, 0), (1, 1, 0), (None, 200000, 200000)]
    assert quality.judged(docs.limit(0)).count() == 0


def test_texts_without_common_words_are_far(spark):
    draw = random.Random(10)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randrange(2, 7))) for _ in range(900)]
    names = sorted(set(quality.COMMON))
    plain = [" ".join(draw.choices(vocabulary + names * 5, k=draw.randrange(150, 250))) for _ in range(60)]
    none = [" ".join(draw.choices([w for w in vocabulary if w not in names], k=n)) for n in (150, 240)]
    langs = [*["en"] * 62, *[f"l{k}" for k in range(600)]]
    got = run(spark, list(zip(range(662), [*plain, *none, *["a b"] * 600], langs)))
    words = [Counter(w.lower() for w in WORD.findall(t)) for t in [*plain, *none]]
    bins = [[*(c[n] for n in names), sum(c.values()) - sum(c[n] for n in names)] for c in words]
    pooled = [sum(x) for x in zip(*bins)]
    assert all(math.isclose(got[i].vocabulary_distance, jensen_shannon(b, pooled), abs_tol=1e-9) for i, b in enumerate(bins))
    assert [i for i in range(60) if not got[i].kept] == []
    assert not any(got[i].kept or got[i].base_failed for i in (60, 61)) and got[61].word_distance is None
