"""Near-duplicate components against brute force over all pairs."""

import random

import pytest

from tablegauge.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 3:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                union = len(sets[a] | sets[b])
                if union and 100 * both >= percent * union and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def result(spark, rows, percent=85):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 3, percent).collect()}


def test_components_equal_brute_force(spark):
    draw = random.Random(3)
    base = [" ".join(f"w{draw.randrange(400)}" for _ in range(draw.randrange(1, 200))) for _ in range(25)]
    rows = [(100 - 2 * i, t) for i, t in enumerate(base)]
    for n in range(1, 60, 2):
        w = draw.choice(base).split()
        for _ in range(draw.randrange(0, 4)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(9)}"
        rows.append((n, " ".join(w).upper() if n % 3 else "  " + "\n".join(w) + "\t"))
    assert result(spark, rows) == brute(rows)


def test_chain_and_star_of_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):  # each differs from the last in one word
        rows.append((i, " ".join(words)))
        words[5 * i % 200] = f"y{i}"
    assert result(spark, rows) == brute(rows)


def test_nulls_blanks_repeats_and_length(spark):
    long = " ".join(str(i % 5000) for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + " end"), (9, "É é x"), (10, "é é x")]
    got = result(spark, rows)
    assert got[1] == got[2][:1] + (1, True) == (0, 1, True) and got[3] == (0, 3, True)
    assert got[5] == (1, 4, False) and got[6] == (1, 6, True)
    assert got[8][1:] == (7, False) and got[10][1] == 10


def test_empty_table_null_and_repeated_ids(spark):
    assert result(spark, []) == {}
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    rows = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    assert rows == [(4, 2, 4, True), (4, 2, 4, True), (None, 2, None, True)]


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", 5, "x"), (2, "a b c", 6, "y")], "doc_id long, text string, node long, key string"
    )
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {1}


@pytest.mark.parametrize("percent", [60, 80])
def test_lower_likeness_equals_brute_force(spark, percent):
    draw = random.Random(percent)
    rows = []
    for k in range(40):  # pairs around the limit, some above and some below
        words = [f"p{k}w{i}" for i in range(120)]
        rows.append((2 * k, " ".join(words)))
        # a word changes three of the 118 shingles
        edits = round(118 * (100 - percent) / (3 * (100 + percent))) - 2 + k % 5
        for at in draw.sample(range(120), edits):
            words[at] = f"y{at}"
        rows.append((2 * k + 1, " ".join(words)))
    want = brute(rows, percent)
    assert result(spark, rows, percent) == want and 5 < sum(kept for _, _, kept in want.values()) - 40 < 40


def test_distance_follows_the_likeness():
    assert minhash.cut(85) == (16, 6, 31)
    for percent in (60, 70, 80, 90, 95):
        chunks, width, most = minhash.cut(percent)
        assert chunks * width <= minhash.SYMBOLS and most // chunks == 1 and width >= 2
    with pytest.raises(ValueError):
        minhash.cut(10)


def test_texts_that_share_an_id_are_compared_each(spark):
    first, second = (" ".join(f"{w}{i}" for i in range(60)) for w in "pq")
    rows = [(4, first), (4, second), (6, second + " end"), (7, first + " end"), (9, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(4, 4, True), (6, 4, False), (7, 4, False), (9, 9, True)}
