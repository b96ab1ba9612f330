"""The schedule against a slot-by-slot run, its windows, and defined results."""

from collections import Counter

from tablegauge.llm import mixing


def rows_of(spark, sizes):
    rows = [(i * 100 + k, name) for i, (name, n) in enumerate(sizes.items()) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string")


def test_windows_and_deviation(spark):
    sizes = {"a": 90, "b": 60, "c": 7, "d": 31}
    targets = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    weights = spark.createDataFrame(list(targets.items()), "source string, weight double")
    got = sorted((tuple(r) for r in mixing.mixed(rows_of(spark, sizes), weights, cycle=20, block_rows=1, bucket_rows=8).collect()), key=lambda r: r[6])
    assert [r[6] for r in got] == list(range(188)) and Counter(r[1] for r in got) == sizes
    assert all(release <= slot < deadline for _, _, _, release, deadline, slot, _ in got)
    assert len({r[5] for r in got}) == 188
    done = Counter()
    for t, r in enumerate(got):
        if done["c"] >= 6:  # the first source that ends: shares change with its last cycle
            break
        done[r[1]] += 1
        assert all(abs(done[s] - targets[s] * (t + 1)) < 1 for s in targets)
    blocks = {(r[1], r[2]): r[5] for r in got}
    assert all(blocks[s, k] < blocks[s, k + 1] for s, n in sizes.items() for k in range(n - 1))


def test_partial_blocks_leave_no_gap(spark):
    got = mixing.mixed(rows_of(spark, {"a": 33, "b": 50, "c": 1}), cycle=7, block_rows=4, bucket_rows=5).collect()
    assert sorted(r.position for r in got) == list(range(84))
    assert max(Counter((r.source, r.block) for r in got).values()) == 4
    assert len({(r.source, r.block) for r in got}) == len({r.slot for r in got}) == 9 + 13 + 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "a", None), (2, "a", ""), (3, "", "t")], "doc_id long, source string, n string")
    weights = spark.createDataFrame([("a", 3.0), ("", -1.0), ("none", 5.0)], "source string, weight double")
    got = mixing.mixed(docs, weights, cycle=10, block_rows=1).collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3, 4] and {r.source for r in got} == {None, "a", ""}
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_too_many_sources_are_refused(spark):
    try:
        mixing.mixed(rows_of(spark, {str(k): 1 for k in range(5)}), cycle=4)
    except ValueError:
        return
    raise AssertionError("five sources in a cycle of four")
