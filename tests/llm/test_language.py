"""Held-out accuracy and defined results of language identification."""

import random

import pytest

from tablegauge.llm import language

SYLLABLES = {"aa": "ka lo mi ne su".split(), "bb": "tra sch ung ver ei".split(), "cc": "ção ñe ló que ár".split()}


def text(draw, lang, n=30):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(4)
    langs = [draw.choice(sorted(SYLLABLES)) for _ in range(600)]
    rows = [(i, text(draw, lang), lang, 1) for i, lang in enumerate(langs)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").cache()


def test_held_out_accuracy(docs):
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 300 and len(got) == 600
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_label_and_source_are_no_inputs(spark, docs):
    model = language.learned(docs)
    rows = spark.createDataFrame([(1, "trasch ungver", "aa"), (2, "trasch ungver", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, round(r.score, 9)) for r in language.identify(rows, model).collect()} == {("bb", round(language.identify(rows, model).first().score, 9))}


def test_undetermined_and_odd_rows(spark, docs):
    model = language.learned(docs)
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "ka lo"), (5, "ka lo " * 200000), (5, "ka lo")]
    got = {(r.doc_id, r.lang_pred) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "aa"), (5, "aa")}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(docs).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0)).count() == 0


def test_weights_are_sparse_and_calibrated(docs):
    model = language.learned(docs)
    assert (model.weights != 0).mean() < 0.5 and model.temperature > 0
