"""Cuts, forms and digests against plain matching, exact round trips, and odd rows."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablegauge.llm import fill_middle as fm

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 80
    output = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(output), sha(text)


def rows(df):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_equals_plain_matching(spark):
    texts = [None, "", " ", "\n\n", "one", " one two\tthree \r\n", "a<P>b c", "x <S> y", "\x0b\x0c é 漢字 \U0001f600 z", "nbsp inside   wide"]
    texts += ["a<P b <S c <M d> e P> f", "<< <<S >", "word " * 2000, " " * 5000 + "x", "y" * 5000]
    data = [(i * 7 + j, t) for i in range(8) for j, t in enumerate(texts)] + [(None, "no id at all"), (5, "same id"), (5, "same id"), (5, "other text")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("output", F.lit("x"))
    got = rows(fm.report(docs.repartition(5)))
    assert got == sorted((brute(*d) for d in data), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_other_id_types(spark):
    assert fm.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(7, "a b c d"), (8, "e f g h")], "doc_id int, text string")
    assert rows(fm.report(docs)) == [brute(7, "a b c d"), brute(8, "e f g h")]


def test_other_sentinels_and_rates_are_restored(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(i, f"w{i} [pre x] <P> y z[suf " * 3) for i in range(50)], "doc_id long, text string")
    made = fm.transformed(docs, seed=1, rate=100, spm_rate=50, sentinels=marks)
    back = made.select("doc_id", "form", fm.restored(F.col("output"), F.col("form"), marks).alias("text")).collect()
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.text for r in docs.collect()}
    assert {r.form for r in back} == {"psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\raé漢<PSM> \u0085 ", max_size=60), st.integers(0, 10**6))
def test_one_match_keeps_every_unit(text, doc_id):
    import regex

    ends = regex.compile(fm.UNITS).fullmatch(text).ends(1)
    assert ends == [m.end() for m in UNIT.finditer(text)]
    n, form, prefix, middle, output = fm.arranged(text, fm.draws(42, doc_id), regex.compile(fm.UNITS), fm.SENTINELS, 50, 80)
    assert (doc_id, n, form, prefix, middle, sha(output)) == brute(doc_id, text)[:6]


def test_a_long_text_is_read_in_linear_time():
    import time

    import regex

    units = regex.compile(fm.UNITS)
    start = time.perf_counter()
    assert len(units.fullmatch("ab  " * 1_000_000).ends(1)) == 1_000_001
    assert time.perf_counter() - start < 20
