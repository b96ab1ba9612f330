import json

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import ledger, prep, scripts
from tablegauge.sources import logs, manifests, models, responses, runs, sinks, tabular


def test_group_split_keeps_copies_together(spark):
    df = spark.range(900).select(F.col("id"), F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 200).alias("v"), (F.col("id") % 2).cast("string").alias("s"))
    split = prep.group_split(df, ["v", "s"], ["id"], "s", 0.25, 1)
    assert split.count() == 900
    assert prep.contamination(split.where("holdout"), split.where("NOT holdout"), ["id"]).count() == 0
    sizes = split.select("s", "group_code", "holdout").distinct().groupBy("s").agg(F.avg(F.col("holdout").cast("int"))).collect()
    assert all(abs(r[1] - 0.25) < 0.02 for r in sizes)


def test_null_patterns_are_distinct_groups(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a")], "x string, y string")
    codes = [r[0] for r in df.select(prep.group_code(["x", "y"])).collect()]
    assert codes[0] == codes[2] != codes[1]


def test_draws_reuse_no_response(spark):
    items = spark.range(300).select((F.col("id") % 60).alias("response_id"), F.col("id").cast("string").alias("item"), F.when(F.col("id") % 3 == 0, "s1").otherwise("s2").alias("stratum"))
    picks = prep.draw_fixed(items, {"s1": 15, "s2": 20}, 1).collect()
    assert len(picks) == 35 and len({p.response_id for p in picks}) == 35
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "s string, n long")
    assert {r.s: r.quota for r in prep.largest_remainder(counts, 7).collect()} == {"a": 4, "b": 2, "c": 1}


def test_script_rules(spark):
    good = "import numpy as np\nSEED = 3\nrng = np.random.default_rng(SEED)\ndf = df.drop_duplicates()\nX = df.drop(columns=['y'])\nX_tr, X_te = train_test_split(X, t)\nsc = StandardScaler()\nX_tr = sc.fit_transform(X_tr)\n"
    bad = "import numpy as np\nsc = MinMaxScaler()\nX = sc.fit_transform(df)\ndf2 = df.drop_duplicates()\nX_tr, X_te = train_test_split(X, t)\nprint(accuracy_score(a, b))\n"
    rows = [(1, good, "y", 5, 0.1, False), (2, bad, "y", 5, 0.1, False), (3, "x = 1", "y", 0, None, True)]
    df = spark.createDataFrame(rows, "script_id long, source string, target string, duplicate_rows long, minority_fraction double, target_is_last boolean")
    got = {r.script_id: [n for n in scripts.RULES if r[n]] for r in scripts.scan_scripts(df).collect()}
    assert got[1] == []
    assert got[2] == ["no_seed", "leak_fit_before_split", "leak_duplicate_rows", "wrong_metric_for_imbalance", "target_in_features"]
    assert got[3] == ["no_seed", "no_validation", "target_in_features"]


def test_script_target_exclusion_forms(spark):
    forms = {
        "X = df.drop(columns=['V1'])": True,
        "X = df.drop(\n    columns=[\n        'a',\n        'V1'])": True,
        "X = df[[c for c in df.columns if c != 'V10']]": False,
        "X = df[[c for c in df.columns if c != 'V1']]": True,
        "COLS = ['a', 'b']\nX = df[COLS]": True,
        "COLS = ['a', 'V1']\nX = df[COLS]": False,
        "COLS = ['a', 'b']\nX = df.loc[:, COLS]": True,
        "def load(df, target='V1'):\n    return df.drop(columns=[target])": True,
        "LABEL: str = 'V1'\nX = df.drop(LABEL, axis=1)": True,
        "run(label='V1')\ny = df.pop(label)": True,
        "X = df.drop(columns=['V10'])": False,
        "X = df[list(set(df.columns) - {'V1'})]": True,
        "cols = df.columns.difference(['V1'])": True,
        "X = df": False,
        "COLS = [c for c in df.columns if c != 'V10']\nX = df[COLS]": False,
        "NUM = ['a']\nCAT = ['b']\nCOLS = NUM + CAT\nX = df[COLS]": True,
        "NUM = ['a', 'V1']\nCAT = ['b']\nCOLS = NUM + CAT\nX = df[COLS]": False,
        "NUM = ['a']\nCOLS = NUM + OTHER\nX = df[COLS]": False,
    }
    rows = [(i, text, "V1", 0, None, False) for i, text in enumerate(forms)]
    df = spark.createDataFrame(rows, "script_id long, source string, target string, duplicate_rows long, minority_fraction double, target_is_last boolean")
    got = {r.script_id: not r.target_in_features for r in scripts.scan_scripts(df).collect()}
    assert {text: got[i] for i, text in enumerate(forms)} == forms


def test_seed_constants_of_any_scope_but_not_keywords(spark):
    split = "from sklearn.model_selection import train_test_split\n"
    forms = {
        "def main():\n    SEED = 7\n    train_test_split(X, random_state=SEED)": True,
        "A = B = 7\ntrain_test_split(X, random_state=B)": True,
        "train_test_split(X, random_state=SEED)": False,
        "f(\n    a,\n    # why not\n    state=42\n)\ntrain_test_split(X, random_state=state)": False,
        "model = Forest(\n    n=200,\n    random_state=42\n)": True,
        "SEED = True\ntrain_test_split(X, random_state=SEED)": False,
    }
    rows = [(i, split + text, "y", 0, None, False) for i, text in enumerate(forms)]
    df = spark.createDataFrame(rows, "script_id long, source string, target string, duplicate_rows long, minority_fraction double, target_is_last boolean")
    got = {r.script_id: not r.no_seed for r in scripts.scan_scripts(df).collect()}
    assert {text: got[i] for i, text in enumerate(forms)} == forms


def test_table_digest_counts_duplicates(spark):
    def digest(values):
        return manifests.table_fingerprint(spark.createDataFrame([(v,) for v in values], "x long")).first().digest

    assert digest([1, 1, 2]) != digest([3, 3, 2]) and digest([1, 2, 1]) == digest([1, 1, 2])


def test_transcript_budget(spark):
    rows = [(1, i, "message", "x" * 20, None, None, None) for i in range(50)] + [(2, 0, "stop", "done", None, None, None)]
    steps = spark.createDataFrame(rows, "run_id long, step_no long, kind string, content string, tool_name string, payload string, ok boolean")
    got = {r.run_id: r for r in ledger.transcript_text(steps, 100).collect()}
    assert got[1].cut and got[1].text.count("agent:") == 3 and got[1].text.endswith("truncated ...]")
    assert got[2].text == "stop: done" and not got[2].cut


def test_tables_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    for suffix, write in (("csv", lambda p: df.write.option("header", True).csv(p)), ("parquet", df.write.parquet), ("jsonl", df.write.json)):
        path = str(tmp_path / f"t.{suffix}")
        write(path)
        assert tabular.load_table(spark, path).count() == 2
    (tmp_path / "t.json").write_text(json.dumps([{"n": 1}, {"n": 2}]))
    assert tabular.load_table(spark, str(tmp_path / "t.json")).count() == 2
    with pytest.raises(ValueError):
        tabular.load_table(spark, "t.xml")


def test_file_sources(spark, tmp_path):
    for run, text in (("r1", '{"metrics": [{"loss": 1.0}, {"loss": 0.5}], "config": {"lr": 0.1}}'), ("r2", "[{\"loss\": 2}]"), ("r3", "{oops")):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "run.json").write_text(text)
    records = runs.read_run_records(spark, str(tmp_path / "runs/*/run.json"))
    assert sorted((r.run_id, r.seq, r.value) for r in runs.run_metrics(records).collect()) == [("r1", 0, 1.0), ("r1", 1, 0.5), ("r2", 0, 2.0)]
    (tmp_path / "runs" / "r1" / "notes.md").write_text("tuned\n")
    details = runs.run_details(records, runs.read_run_notes(spark, str(tmp_path / "runs/*/notes.md")))
    assert sorted((r.run_id, r.name, r.notes) for r in details.collect()) == [("r1", None, "tuned\n"), ("r2", None, None), ("r3", None, None)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("Epoch 1 loss=2.0\r\nEpoch 2 loss=1.0\n")
    assert [r.epoch for r in logs.parse_log_lines(logs.read_lines(spark, str(tmp_path / "logs"))).orderBy("seq").collect()] == [1, 2]
    (tmp_path / "tb" / "files").mkdir(parents=True)
    (tmp_path / "tb" / "files" / "wandb-history.jsonl").write_text("{}")
    assert logs.classify_run_folders(logs.list_run_files(spark, str(tmp_path / "tb"))).first().source == "wandb"


def test_model_headers_are_read_in_part(spark, tmp_path):
    (tmp_path / "m.pkl").write_bytes(b"\x80\x04" + b"0" * 2000)
    (tmp_path / "m.bin").write_bytes(b"PK\x03\x04rest")
    got = {r.path.rsplit("/", 1)[-1]: r for r in models.model_inventory(models.list_models(spark, str(tmp_path))).collect()}
    assert got["m.pkl"].format == "pickle" and got["m.pkl"].warnings == ["unsafe_pickle"] and got["m.pkl"].size == "2.0 KB"
    assert got["m.bin"].format == "pytorch"


def test_sizes_halfway_go_to_the_even_digit(spark):
    sizes = {1310720: "1.2 MB", 3328: "3.2 KB", 8448: "8.2 KB", 3379: "3.3 KB", 1408: "1.4 KB", 1434: "1.4 KB", 1792: "1.8 KB", 1023: "1023 B"}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", models.readable_size(F.col("n")).alias("shown")).collect()
    assert {r.n: r.shown for r in rows} == sizes


def test_responses_manifests_and_ledgers(spark, tmp_path):
    (tmp_path / "deepseek_e0a1b2c3.jsonl").write_text('{"i": 1}\n{bad\n{"i": 2}\n')
    rows = responses.read_responses(spark, str(tmp_path / "*.jsonl"), "i long").collect()
    assert {(r.i, r.evidence_hash) for r in rows} == {(1, "0a1b2c3"), (2, "0a1b2c3")}
    lines = spark.createDataFrame([("m", s) for s in ("torch==2.0  # x", "-r a.txt", "Pandas", "", "a[b]>=1")], "manifest string, line string")
    row = manifests.manifest_summary(manifests.requirement_lines(lines)).first()
    assert (row.entries, row.pinned, row.unpinned, row.learning) == (3, 2, 1, "pandas,torch")
    sets = spark.createDataFrame([("p", "1"), ("p", "1"), ("q", "1")], "path string, modified string").withColumn("fingerprint", sinks.dataset_fingerprint())
    empty = spark.createDataFrame([], sets.schema)
    sinks.register_datasets(sets, empty, str(tmp_path / "registry"))
    registry = spark.read.parquet(str(tmp_path / "registry"))
    assert registry.count() == 2
    sinks.register_datasets(sets, registry, str(tmp_path / "registry"))
    assert spark.read.parquet(str(tmp_path / "registry")).count() == 2
    sinks.append_decision(spark.createDataFrame([("profile", "done", "")], "command string, summary string, reasoning string"), str(tmp_path / "decisions"))
    assert spark.read.parquet(str(tmp_path / "decisions")).count() == 1
