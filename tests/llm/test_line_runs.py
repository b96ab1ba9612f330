"""Kept lines against a plain dictionary, the runs' levels and plans, and odd rows."""

import hashlib
import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tablegauge.llm import line_runs
from tablegauge.session import shared_folder

BLANK = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least_chars=40, least_docs=5):
    holders = defaultdict(list)
    texts = [(i, (t or "").split("\n")) for i, t in docs]
    small = float("-inf")
    for i, lines in texts:
        for key in {line.strip(BLANK).translate(UPPER) for line in lines}:
            if len(key) >= least_chars:
                holders[key].append(small if i is None else i)
    found = []
    for i, lines in texts:
        kept = []
        for line in lines:
            ids = holders.get(line.strip(BLANK).translate(UPPER), [])
            if len(ids) < least_docs or max(ids) == (small if i is None else i):
                kept.append(line)
        found.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(found, key=repr)


def made(n, seed=3):
    draw = random.Random(seed)
    common = [f"{'a common line that many documents share, number'} {i} " + "x" * i for i in range(12)]
    common += ["É" * 39, "É" * 40, "z" * 39, "z" * 40, " \t" + "Long Enough And Accented é " * 2 + "\r"]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(draw.randrange(9)):
            line = draw.choice(common + ["", "short", f"a line that only document {i} has, in forty characters"])
            lines.append(draw.choice([line, line.upper() if line.isascii() else line, f"  {line}\t", line]))
        docs.append((i, "\n".join(lines)))
    return docs


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


def test_equals_a_dictionary(spark):
    docs = made(300)
    clash = table(spark, docs).withColumns({n: F.lit("x") for n in ("h1", "h2", "row", "pos", "first", "batch", "drops", "keeper", "n_lines")})
    assert rows(line_runs.report(clash.repartition(7))) == brute(docs)


def test_odd_rows(spark):
    same = "this line is shared by every document with an odd id here"
    docs = [(None, same), (None, same), (3, same + "\n" + same), (3, same), (9, f"{same}\nend\n"), (9, same.upper()), (9, f"{same}\nend\n")]
    docs += [(1, None), (2, ""), (4, "\n\n\n"), (5, "\n".join([same] * 3000)), (6, "z" * 300_000), (7, "y" * 100)]
    only_null = "and this one only rows without any id at all do hold"
    docs += [(None, f"{only_null} \n{same}") for _ in range(6)]
    got = rows(line_runs.report(table(spark, docs)))
    assert got == brute(docs)
    assert (5, 3000, 3000, hashlib.sha256(b"").hexdigest()) in got
    assert line_runs.report(table(spark, [])).count() == 0


def test_other_limits_and_one_batch(spark):
    docs = made(80, seed=8)
    for batches, least in ((1, 2), (7, 3)):
        out = line_runs.deduplicated(table(spark, docs), least_chars=5, least_docs=least, batches=batches)
        got = out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
        assert rows(got) == brute(docs, 5, least)


def test_batches_claim_new_keys_once_and_runs_are_merged_by_level(spark):
    folder = f"{shared_folder(spark)}/run-test"
    runs = line_runs.LineRuns(spark, folder, buckets=3, fanout=2)
    shapes = []
    for batch in range(5):
        keys = spark.range(batch * 10, batch * 10 + 25).select(F.col("id").alias("h1"), (F.col("id") * 7).alias("h2"), F.lit(batch).alias("keeper"))
        runs.add(keys)
        shapes.append([len(level) for level in runs.levels])
    assert shapes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    claimed = {r.h1: r.keeper for r in runs.claims().collect()}
    assert claimed == {i: min(b for b in range(5) if b * 10 <= i < b * 10 + 25) for i in range(65)}
    assert runs.claims().count() == 65
    assert runs.unclaimed(spark.range(60, 70).selectExpr("id AS h1", "id * 7 AS h2")).count() == 5
    files = os.listdir(folder.removeprefix("file:"))
    assert len(files) == 2  # merged runs are gone
    for level in runs.levels:
        for name in level:
            runs.drop(name)
    assert os.listdir(folder.removeprefix("file:")) == []


def test_runs_are_joined_by_merging_without_a_shuffle(spark):
    runs = line_runs.LineRuns(spark, f"{shared_folder(spark)}/run-plan", buckets=8)
    runs.add(spark.range(100).selectExpr("id AS h1", "id AS h2", "id AS keeper"))
    other = runs.write(spark.range(50, 150).selectExpr("id AS h1", "id AS h2", "id AS keeper"))
    joined = runs.unclaimed(spark.table(other))
    assert joined.count() == 50
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange hashpartitioning" not in plan
    for name in [other, *runs.levels[0]]:
        runs.drop(name)


def test_nothing_stays_behind(spark):
    before = set(spark.catalog.listTables())
    out = line_runs.report(table(spark, made(50)))
    out.collect()
    assert set(spark.catalog.listTables()) == before
    folder = shared_folder(spark).removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("lines-")]
