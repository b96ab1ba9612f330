"""The whole pipeline over the smallest tables against plain Python, and stages on odd rows."""

import os

import pytest

import corpus_pipeline
from tablegauge.llm import language, mixing, pieces, secrets

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def kept(rows):
    """Ids that are the smallest of their near-duplicate group."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] != label[b] and sets[a] | sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i for i in sets if label[i] == i}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_rows_equal_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.learned(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    names, scores = model.predict(list(rows.values()))
    sure = [i for i, name, s in zip(rows, names, scores) if name != "und" and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    left = kept([(i, rows[i]) for i in sure])
    stage = docs.where(docs.doc_id.isin(sorted(left)))
    table = secrets.learned(stage)
    texts = {}
    for r in secrets.report(stage, table).collect():
        out, at = "", 0
        for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s):
            if start >= at:
                out += rows[r.doc_id][at:start] + "[secret]"
            at = max(at, end)
        texts[r.doc_id] = out + rows[r.doc_id][at:]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    v = pieces.load()
    ids, first = pieces.encode(v, list(texts.values()))
    assert got.keys() == texts.keys()
    for k, i in enumerate(texts):
        assert got[i].ids == ids[first[k] : first[k + 1]].tolist() and got[i].round_trip
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "mix", "encode"]


def test_stages_on_odd_rows(spark):
    text = "the quick brown fox jumps over it "
    rows = [(None, text, "en", None, 5), (3, None, "en", "a", None), (4, text * 3, None, "b", 9), (4, text * 3, None, "b", 9), (5, "", "en", "a", 0)]
    rows += [(10 + i, f"{text} number {i} " + "x" * i, "en", "a", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, COLUMNS)
    first = corpus_pipeline.language_id(spark, docs, "")
    assert first.columns == docs.columns and sorted(str(r.doc_id) for r in first.collect()) == sorted(str(r[0]) for r in rows if r[1])
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() >= 7
    assert corpus_pipeline.mix(spark, docs, "").count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_mixing_carries_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x", "s", 1), (2, "b", "x", "t", 2)], COLUMNS)
    assert {tuple(r.row) for r in mixing.mixed(docs, whole=True).collect()} == {tuple(r) for r in docs.collect()}


def test_copies_without_an_id_or_with_a_repeated_one_leave_one_row(spark):
    long = [" ".join(f"{w}{k}" for k in range(60)) for w in "abcd"]
    rows = [(None, long[0]), (None, long[0]), (3, long[1]), (3, long[1]), (3, long[2]), (None, long[2]), (7, long[3]), (None, long[3] + " end"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], COLUMNS)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(out) == 5 and {t for _, t in out} == {*long, None} and (7, long[3]) in out


def test_the_last_stage_returns_the_schedule(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "ab"[i % 10 == 0], 1) for i in range(3000)], COLUMNS)
    want = {r.doc_id: r.position for r in mixing.mixed(docs).collect()}
    corpus_pipeline.mix(spark, docs, "").write.parquet(f"{tmp_path}/mix")
    got = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mix"), "").collect()
    assert {r.doc_id: r.position for r in got} == want and sorted(want.values()) == list(range(3000))
    share = 10 / (10 + 85)  # blocks of both sources, which end in the first cycle
    order = [r.doc_id % 10 == 0 for r in sorted(got, key=lambda r: r.position)]
    assert all(abs(sum(order[:n]) - share * n) <= 2 * mixing.BLOCK_ROWS for n in range(0, 3001, 50))
