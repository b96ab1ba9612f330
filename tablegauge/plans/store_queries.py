"""Registered queries of sources, sinks, preparation, script scans and ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablegauge.operators import ledger as G
from tablegauge.operators import prep as P
from tablegauge.operators import scripts as K
from tablegauge.plans import evidence_queries as V
from tablegauge.plans.inputs import derive, table, with_inputs
from tablegauge.plans.rounding import rounded
from tablegauge.session import durable
from tablegauge.sources import manifests, models, responses, sinks, tabular

PROPS = "SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 5) ELSE props END AS line FROM {events}"
MANIFEST = """
SELECT 'doc_' || doc_id AS path, CASE WHEN doc_id % 10 = 1 THEN 'changed' ELSE text END AS text FROM {documents} WHERE doc_id % 10 <> 2
UNION ALL SELECT 'gone_' || doc_id, text FROM {documents} WHERE doc_id % 50 = 0"""
CRLF = "SELECT doc_id, lang, text, replace(text, chr(10), chr(13) || chr(10)) AS crlf FROM {documents}"
MODELS = """
SELECT 'store/m' || doc_id || CASE doc_id % 8 WHEN 0 THEN '.pkl' WHEN 1 THEN '.joblib' WHEN 2 THEN '.pt' WHEN 3 THEN '.onnx' WHEN 4 THEN '.H5'
    WHEN 5 THEN '.safetensors' WHEN 6 THEN '.weights' ELSE '.gguf' END AS path,
  CAST(n_chars * CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 40000 WHEN 3 THEN 1000000 ELSE 3 END AS BIGINT) AS length,
  CASE doc_id % 3 WHEN 0 THEN '8004' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN '504B0304' ELSE '0812' END ELSE '7B22' END AS head
FROM {documents}"""
REQUIREMENTS = """
SELECT 'team' || (p_partkey % 30) || '/requirements.txt' AS manifest, CASE p_partkey % 9 WHEN 0 THEN 'numpy==1.' || p_size WHEN 1 THEN '# ' || p_name
  WHEN 2 THEN 'Torch>=2.' || p_size || '  # gpu' WHEN 3 THEN '-r base.txt' WHEN 4 THEN 'requests' WHEN 5 THEN 'pkg' || p_size || '[extra]~=1.0'
  WHEN 6 THEN '' WHEN 7 THEN 'lib @ https://x/' || p_size ELSE 'plain' || p_size END AS line FROM {part}"""
REGISTRY = "SELECT 'd' || l_orderkey AS path, CAST(l_linenumber AS STRING) AS modified FROM {lineitem}"
SCRIPTS = """
SELECT doc_id AS script_id, CASE WHEN doc_id % 2 = 0 THEN 'churn' ELSE 'price.usd' END AS target, CAST(doc_id % 3 AS BIGINT) AS duplicate_rows,
  CASE WHEN doc_id % 4 > 0 THEN (doc_id % 4) / 10.0 END AS minority_fraction, doc_id % 5 = 0 AS target_is_last,
  '# ' || source || chr(10) || 'import pandas as pd' || chr(10) || 'import numpy as np' || chr(10)
  || CASE doc_id % 3 WHEN 0 THEN 'np.random.seed(7)' WHEN 1 THEN 'from sklearn.svm import SVC' ELSE 'rng = 1' END || chr(10)
  || CASE WHEN doc_id % 14 = 0 THEN 'def main():' || chr(10) || '    SEED = 42' WHEN doc_id % 7 = 0 THEN 'SEED = 42' ELSE '' END || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN 'TARGET = "churn"' ELSE 'TARGET = "price.usd"' END || chr(10)
  || CASE WHEN doc_id % 4 = 1 THEN 'df = df.drop_duplicates()' ELSE '' END || chr(10)
  || CASE doc_id % 6 WHEN 0 THEN 'X = df.drop(columns=["churn", "price.usd"])' WHEN 1 THEN 'X = df[[c for c in df.columns if c != TARGET]]'
       WHEN 2 THEN 'X = df.iloc[:, :-1]' WHEN 3 THEN 'X = df[["a", "b"]]' WHEN 4 THEN 'y = df.pop(TARGET); X = df'
       ELSE CASE WHEN doc_id % 4 = 1 THEN 'NUM = ["a", "b"]' || chr(10) || 'CAT = ["d"]' || chr(10) || 'COLS = NUM + CAT' || chr(10) || 'X = df[COLS]'
                 WHEN doc_id % 5 < 3 THEN 'COLS = [c for c in df.columns if c != "other"]' || chr(10) || 'X = df[COLS]' ELSE 'X = df' END END || chr(10)
  || CASE WHEN doc_id % 4 = 2 THEN 'df = df.drop_duplicates()' ELSE '' END || chr(10)
  || CASE WHEN doc_id % 5 < 2 THEN 'sc = StandardScaler()' || chr(10) || 'X = sc.fit_transform(X)' ELSE '' END || chr(10)
  || CASE WHEN doc_id % 8 > 0 THEN 'X_train, X_test = train_test_split(X, y, random_state=' || CASE WHEN doc_id % 7 = 0 THEN 'SEED' WHEN doc_id % 3 = 1
       THEN '3' ELSE 'None' END || ')' ELSE '' END || chr(10)
  || CASE WHEN doc_id % 9 = 0 THEN 'print(accuracy_score(y, p))' ELSE 'print(f1_score(y, p))' END || chr(10) AS source
FROM {documents}"""
LOG = """
SELECT CASE event_id % 6 WHEN 0 THEN '{{"recommendation": "x", "n": 1}}' WHEN 1 THEN '{{"command": ' || event_id || '}}' WHEN 2 THEN '{{"command": "'
  WHEN 3 THEN '[1]' ELSE '{{"command": "' || event_type || '"}}' END AS line FROM {events}"""
DECISIONS = "SELECT event_id AS decision_id, ts, event_type AS command, ' used ' || props || ' ' AS summary FROM {events}"
RUNS = "SELECT CAST(CAST(ts AS DATE) AS STRING) || '-' || user_id AS run_id FROM {events}"
STEPS = """
SELECT conv_id AS run_id, turn AS step_no, CASE WHEN turn % 5 = 4 THEN 'note' WHEN role = 'user' THEN 'message' WHEN turn % 2 = 1 THEN 'tool_call' ELSE 'tool_result' END AS kind,
  text AS content, role AS tool_name, '{{"t": "' || length(text) || '"}}' AS payload, turn % 3 > 0 AS ok FROM {conversations}"""
_DOC_COLS = ["text", "lang"]


def _split(spark, folder):
    return durable(P.group_split(table(spark, folder, "documents"), _DOC_COLS, ["doc_id"], "lang", 0.25, 7))


def _naive(spark, folder):
    docs = table(spark, folder, "documents").withColumn("group_code", P.group_code(_DOC_COLS))
    return docs.where("doc_id % 4 = 0"), docs.where("doc_id % 4 > 0")


def _split_checks(spark, folder):
    split = _split(spark, folder)
    leaked = P.contamination(split.where("holdout"), split.where("NOT holdout"), ["doc_id"]).agg(F.count(F.lit(1))).scalar()
    groups = split.select("lang", "group_code", "holdout").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("groups"), F.count_if("holdout").alias("holdout_groups")
    )
    return groups.withColumn("contaminated_rows", leaked)


_ITEM_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _injected(spark, folder):
    df = table(spark, folder, "lineitem").select(*_ITEM_KEYS, "l_extendedprice")
    return P.inject_binned(P.inject_inverse(P.inject_copy(df, "l_extendedprice"), "l_extendedprice"), "l_extendedprice")


def _noise(spark, folder):
    df = table(spark, folder, "lineitem").select(*_ITEM_KEYS, "l_extendedprice", F.lit(0.0).alias("y_pred"))
    df = P.inject_noisy_proxy(df, "l_extendedprice", _ITEM_KEYS)
    df = P.inject_monotone_log(df, "l_extendedprice", _ITEM_KEYS)
    df = P.inject_memorised(df, "l_extendedprice", "y_pred", _ITEM_KEYS)
    y = F.col("l_extendedprice")
    same = F.avg((F.col("y_pred") == y).cast("int"))
    return df.agg(
        (F.corr("l_extendedprice_proxy", y) > 0.99).alias("proxy_is_a_leak"),
        (F.corr("l_extendedprice_log", y) > 0.8).alias("log_follows"),
        ((same > 0.95) & (same < 0.99)).alias("mostly_memorised"),
    )


def _pseudonyms(spark, folder):
    renamed, mapping = P.pseudonymise(table(spark, folder, "orders"), ["o_orderkey"])
    counts = renamed.agg(*[F.count(F.col(c)).alias(c) for c in mapping.values()])
    return counts.unpivot([], list(mapping.values()), "pseudonym", "present")


def _draws(spark, folder):
    items = V.items(spark, folder).names.where("outside").select(
        "response_id", F.concat_ws(":", "place", "entity").alias("item"), V.S.name_origin().alias("stratum")
    )
    picks = P.draw_fixed(durable(items), {"unlisted": 40, "misfiled": 30, "invented": 50}, 3)
    return picks.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("picks"), F.count_distinct("response_id").alias("responses")
    )


def _proportional(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return P.draw_proportional(docs, "lang", "doc_id", 101).groupBy("lang").agg(F.count(F.lit(1)).alias("picks"))


def _appended(spark, folder):
    """Results appended twice to a partitioned table and read back."""
    durable(spark.range(1))
    path = f"{spark.sparkContext.getCheckpointDir()}/results-{uuid.uuid4()}"
    rows = table(spark, folder, "events").select("event_id", "value", F.col("event_type").alias("experiment_id"))
    sinks.append_results(rows.where("event_id % 2 = 0"), path)
    sinks.append_results(rows.where("event_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total")
    )


def _unregistered(spark, folder):
    all_sets = derive(spark, folder, REGISTRY).withColumn("fingerprint", sinks.dataset_fingerprint())
    known = all_sets.where("modified = '1'")
    return sinks.unregistered(all_sets, known).select("path", "modified", "fingerprint")


def _rescored(spark, folder):
    pairs = derive(spark, folder, SCRIPTS).withColumn(
        "source_before", F.when(F.col("script_id") % 2 == 0, F.regexp_replace("source", "train_test_split", "tts"))
    )
    return K.rescore(pairs).groupBy("side").agg(
        F.count(F.lit(1)).alias("scripts"), F.sum("defect_count").alias("defects"), F.count_if("no_validation").alias("no_validation")
    )


def _fingerprints(spark, folder):
    t = tabular.load_table(spark, f"{folder}/orders.parquet")
    return manifests.table_fingerprint(t).select("rows", "columns").withColumn(
        "order_free", (manifests.table_fingerprint(t.repartition(5)).select("digest").scalar() == manifests.table_fingerprint(t).select("digest").scalar())
    )


QUERIES = {
    "src_01_tabular_scan": lambda s, f: rounded(
        tabular.load_table(s, f"{f}/orders.parquet").groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total")
        ), 2,
    ),
    "src_02_first_rows": lambda s, f: tabular.first_rows(table(s, f, "customer"), ["c_custkey"], 50),
    "src_08_tolerant_json": lambda s, f: tabular.tolerant_json(derive(s, f, PROPS), "k:bigint").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("record.k").alias("k")
    ),
    "src_09_response_pairs": lambda s, f: responses.pair_with_evidence(derive(s, f, V.FILE_LIST), derive(s, f, V.DUMPS)),
    "src_10_fingerprint": lambda s, f: derive(s, f, CRLF).select(
        "doc_id", manifests.text_fingerprint(F.col("crlf")).alias("sha256")
    ),
    "src_10_manifest": lambda s, f: manifests.check_manifest(
        derive(s, f, MANIFEST).select("path", manifests.text_fingerprint(F.col("text")).alias("sha256")),
        table(s, f, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), manifests.text_fingerprint(F.col("text")).alias("sha256")),
    ),
    "src_10_table_digest": _fingerprints,
    "src_11_model_inventory": lambda s, f: models.model_inventory(
        derive(s, f, MODELS).withColumn("header", F.unhex("head"))
    ).withColumn("warnings", F.array_join("warnings", ",")),
    "src_12_requirements": lambda s, f: manifests.manifest_summary(manifests.requirement_lines(derive(s, f, REQUIREMENTS))),
    "snk_01_append_results": _appended,
    "snk_02_unregistered": _unregistered,
    "prp_01_duplicate_groups": lambda s, f: table(s, f, "documents").groupBy(P.group_code(_DOC_COLS).alias("code")).agg(
        F.count(F.lit(1)).alias("copies")
    ).groupBy("copies").agg(F.count(F.lit(1)).alias("groups")),
    "prp_02_group_split": _split_checks,
    "prp_03_contamination": lambda s, f: P.contamination(*_naive(s, f), ["doc_id"]).select("doc_id"),
    "prp_04_split_facts": lambda s, f: rounded(
        P.split_facts(
            table(s, f, "documents").withColumns({"group_code": P.group_code(_DOC_COLS), "holdout": F.col("doc_id") % 4 == 0}), "lang"
        )
    ),
    "prp_05_injected": lambda s, f: rounded(_injected(s, f), 4),
    "prp_05_noisy": _noise,
    "prp_06_pseudonyms": _pseudonyms,
    "prp_07_fixed_draw": _draws,
    "prp_07_proportional_draw": _proportional,
    "prp_08_script_scan": lambda s, f: K.scan_scripts(derive(s, f, SCRIPTS)),
    "prp_08_rescored": _rescored,
    "led_01_commands": lambda s, f: G.command_counts(derive(s, f, LOG)),
    "led_02_decisions": lambda s, f: G.latest_decisions(derive(s, f, DECISIONS)),
    "led_03_recent_runs": lambda s, f: G.recent_runs(derive(s, f, RUNS)),
    "led_03_find_run": lambda s, f: G.find_run(derive(s, f, RUNS), "2024-01-1"),
    "led_04_transcripts": lambda s, f: G.transcript_text(derive(s, f, STEPS), 500),
}

_EDGE = ", ".join(f"{i / 20}" for i in range(1, 20))
_LINE = """CASE kind WHEN 'message' THEN 'agent: ' || CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '…' ELSE content END
  WHEN 'tool_call' THEN '→ ' || tool_name || '(' || substr(payload, 1, 120) || ')' WHEN 'tool_result' THEN '  ← ' || CASE WHEN ok THEN 'ok' ELSE 'ERR' END || ': ' || substr(payload, 1, 120) END"""
ORACLES = {
    "src_01_tabular_scan": "SELECT o_orderstatus, count(*) AS rows, ROUND(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus",
    "src_02_first_rows": "SELECT * FROM customer ORDER BY c_custkey LIMIT 50",
    "src_08_tolerant_json": "SELECT user_id, count(*) AS lines, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0 GROUP BY user_id",
    "src_09_response_pairs": with_inputs(
        "SELECT f.h AS evidence_hash, f.path, d.path AS dump FROM (SELECT path, regexp_extract(path, '_e([0-9a-f]{6,64})\\.jsonl$', 1) AS h FROM f "
        "WHERE path NOT LIKE '%superseded%' AND path NOT LIKE '%/transport_errors/%') f JOIN (SELECT path, regexp_extract(path, 'evidence_([0-9a-f]+)\\.json$', 1) AS h FROM d) d ON f.h = d.h AND f.h <> ''",
        f=V.FILE_LIST, d=V.DUMPS,
    ),
    "src_10_fingerprint": "SELECT doc_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS sha256 FROM documents",
    "src_10_manifest": "SELECT 'doc_' || doc_id AS path, CASE WHEN doc_id % 10 = 2 THEN 'UNLISTED' WHEN doc_id % 10 = 1 AND text <> 'changed' THEN 'CHANGED' ELSE 'ok' END AS state FROM documents "
    "UNION ALL SELECT 'gone_' || doc_id, 'MISSING' FROM documents WHERE doc_id % 50 = 0",
    "src_10_table_digest": "SELECT count(*) AS rows, 6 AS columns, true AS order_free FROM orders",
    "src_11_model_inventory": with_inputs(
        "SELECT path, length, size, size_class, format, concat_ws(',', CASE WHEN format = 'pickle' THEN 'unsafe_pickle' END, CASE WHEN format = 'unknown' THEN 'unknown_format' END, "
        "CASE WHEN size_class = 'huge' THEN 'huge_model' END) AS warnings FROM (SELECT path, length, CASE WHEN length < 1024 THEN length || ' B' WHEN length < 1048576 THEN printf('%.1f KB', length / 1024) "
        "WHEN length < 1073741824 THEN printf('%.1f MB', length / 1048576) ELSE printf('%.1f GB', length / 1073741824) END AS size, "
        "CASE WHEN length < 10485760 THEN 'small' WHEN length < 104857600 THEN 'medium' WHEN length < 1073741824 THEN 'large' ELSE 'huge' END AS size_class, "
        "CASE WHEN head = '504B0304' THEN 'pytorch' WHEN head = '0812' THEN 'onnx' WHEN head = '8004' THEN CASE WHEN path LIKE '%.joblib' THEN 'joblib' ELSE 'pickle' END "
        "WHEN path LIKE '%.pkl' THEN 'pickle' WHEN path LIKE '%.joblib' THEN 'joblib' WHEN path LIKE '%.pt' THEN 'pytorch' WHEN path LIKE '%.onnx' THEN 'onnx' WHEN path LIKE '%.H5' THEN 'tensorflow_h5' "
        "WHEN path LIKE '%.safetensors' THEN 'safetensors' WHEN path LIKE '%.gguf' THEN 'gguf' ELSE 'unknown' END AS format FROM m)",
        m=MODELS,
    ),
    "src_12_requirements": with_inputs(
        "SELECT *, unpinned > 0 AS warn_unpinned, learning = '' AS warn_no_learning FROM (SELECT manifest, count(*) AS entries, count(*) FILTER (pin) AS pinned, count(*) FILTER (NOT pin) AS unpinned, "
        "coalesce(string_agg(DISTINCT pkg, ',' ORDER BY pkg) FILTER (pkg IN ('numpy', 'torch')), '') AS learning FROM (SELECT manifest, regexp_matches(spec, '[=<>@;~]') AS pin, "
        "lower(regexp_extract(spec, '^([A-Za-z0-9]*)', 1)) AS pkg FROM (SELECT manifest, trim(regexp_replace(line, '#.*$', '')) AS spec FROM r) WHERE spec <> '' AND spec NOT LIKE '-%') GROUP BY manifest)",
        r=REQUIREMENTS,
    ),
    "snk_01_append_results": "SELECT event_type AS experiment_id, count(*) AS rows, ROUND(sum(value), 4) AS total FROM events GROUP BY event_type",
    "snk_02_unregistered": with_inputs(
        "SELECT DISTINCT path, modified, substr(sha256(path || '|' || modified), 1, 16) AS fingerprint FROM r WHERE modified <> '1'", r=REGISTRY
    ),
    "prp_01_duplicate_groups": "SELECT copies, count(*) AS groups FROM (SELECT count(*) AS copies FROM documents GROUP BY text, lang) GROUP BY copies",
    "prp_02_group_split": "SELECT lang, count(*) AS groups, CAST(ROUND(count(*) * 0.25::DOUBLE) AS BIGINT) AS holdout_groups, 0 AS contaminated_rows FROM (SELECT DISTINCT text, lang FROM documents) GROUP BY lang",
    "prp_03_contamination": "SELECT doc_id FROM documents d WHERE doc_id % 4 = 0 AND EXISTS (SELECT 1 FROM documents t WHERE t.doc_id % 4 > 0 AND t.text = d.text AND t.lang = d.lang)",
    "prp_04_split_facts": "SELECT holdout, CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS duplicates, ROUND(any_value(share), 6) AS minority_share FROM "
    "(SELECT doc_id % 4 = 0 AS holdout, text, lang, count(*) AS n FROM documents GROUP BY ALL) JOIN (SELECT holdout, min(n) / sum(n) AS share FROM "
    "(SELECT doc_id % 4 = 0 AS holdout, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY holdout) USING (holdout) GROUP BY holdout",
    "prp_05_injected": f"WITH q AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [{_EDGE}]))) AS cuts, min(l_extendedprice) AS lo FROM lineitem), "
    "b AS (SELECT *, len(list_filter(cuts, lambda c: c < l_extendedprice)) AS bin FROM lineitem, q) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(l_extendedprice, 4) AS l_extendedprice, "
    "ROUND(l_extendedprice, 4) AS l_extendedprice_copy, ROUND(1 / (l_extendedprice - lo + 1), 4) AS l_extendedprice_inverse, ROUND(avg(l_extendedprice) OVER (PARTITION BY bin), 4) AS l_extendedprice_binned FROM b",
    "prp_05_noisy": "SELECT true AS proxy_is_a_leak, true AS log_follows, true AS mostly_memorised FROM lineitem HAVING count(*) > 0",
    "prp_06_pseudonyms": " UNION ALL ".join(
        f"SELECT 'col_' || substr(sha256('{c}'), 1, 8) AS pseudonym, count({c}) AS present FROM orders"
        for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
    "prp_07_fixed_draw": V._sql(
        "SELECT stratum, least(count(DISTINCT response_id), any_value(quota)) AS picks, least(count(DISTINCT response_id), any_value(quota)) AS responses FROM "
        "(SELECT response_id, CASE WHEN in_names THEN 'misfiled' WHEN in_frame THEN 'unlisted' ELSE 'invented' END AS stratum FROM refs WHERE outside) "
        "JOIN (VALUES ('unlisted', 40), ('misfiled', 30), ('invented', 50)) AS q(stratum, quota) USING (stratum) GROUP BY stratum"
    ),
    "prp_07_proportional_draw": "SELECT lang, CAST(quota + CASE WHEN row_number() OVER (ORDER BY exact - quota DESC, lang, n) <= 101 - sum(quota) OVER () THEN 1 ELSE 0 END AS BIGINT) AS picks FROM "
    "(SELECT lang, n, n * 101 / sum(n) OVER () AS exact, floor(n * 101 / sum(n) OVER ()) AS quota FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang))",
    "prp_08_script_scan": "SELECT script_id, no_seed, fit AS leak_fit_before_split, dup AS leak_duplicate_rows, acc AS wrong_metric_for_imbalance, noval AS no_validation, tgt AS target_in_features, "
    "CAST(no_seed AS INTEGER) + CAST(fit AS INTEGER) + CAST(dup AS INTEGER) + CAST(acc AS INTEGER) + CAST(noval AS INTEGER) + CAST(tgt AS INTEGER) AS defect_count FROM (SELECT doc_id AS script_id, "
    "NOT (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 8 > 0)) AS no_seed, doc_id % 5 < 2 AS fit, "
    "doc_id % 3 > 0 AND doc_id % 4 <> 1 AS dup, "
    "doc_id % 4 = 1 AND doc_id % 9 = 0 AS acc, doc_id % 8 = 0 AS noval, "
    "NOT (doc_id % 6 = 0 OR doc_id % 6 = 1 OR doc_id % 6 = 3 OR doc_id % 6 = 4 OR (doc_id % 6 = 2 AND doc_id % 5 = 0) OR (doc_id % 6 = 5 AND doc_id % 4 = 1)) AS tgt FROM documents)",
    "prp_08_rescored": "SELECT side, count(*) AS scripts, CAST(sum(d) AS BIGINT) AS defects, count(*) FILTER (noval) AS no_validation FROM (SELECT side, noval, "
    "CAST(no_seed AS INTEGER) + CAST(fit AS INTEGER) + CAST(dup AS INTEGER) + CAST(acc AS INTEGER) + CAST(noval AS INTEGER) + CAST(tgt AS INTEGER) AS d FROM (SELECT side, "
    "NOT (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 8 > 0)) AS no_seed, doc_id % 5 < 2 AS fit, "
    "doc_id % 3 > 0 AND NOT (doc_id % 4 = 1 OR (doc_id % 4 = 2 AND side = 'before')) AS dup, doc_id % 4 = 1 AND doc_id % 9 = 0 AS acc, doc_id % 8 = 0 OR side = 'before' AS noval, "
    "NOT (doc_id % 6 IN (0, 1, 3, 4) OR (doc_id % 6 = 2 AND doc_id % 5 = 0) OR (doc_id % 6 = 5 AND doc_id % 4 = 1)) AS tgt FROM documents, (VALUES ('after'), ('before')) AS v(side) WHERE side = 'after' OR doc_id % 2 = 0)) GROUP BY side",
    "led_01_commands": "SELECT command, count(*) AS n FROM (SELECT CASE WHEN event_id % 6 = 0 THEN 'advise' WHEN event_id % 6 > 3 THEN event_type END AS command FROM events) WHERE command IS NOT NULL GROUP BY command",
    "led_02_decisions": "SELECT event_id AS decision_id, '- [' || strftime(ts, '%Y-%m-%d') || '] ' || event_type || ': used ' || props AS line FROM events ORDER BY ts DESC, event_id DESC LIMIT 10",
    "led_03_recent_runs": with_inputs("SELECT DISTINCT run_id FROM r ORDER BY run_id DESC LIMIT 5", r=RUNS),
    "led_03_find_run": with_inputs("SELECT min(run_id) AS run_id FROM r WHERE run_id LIKE '2024-01-1%'", r=RUNS),
    "led_04_transcripts": with_inputs(
        f"SELECT run_id, coalesce(string_agg(line, chr(10) ORDER BY step_no) FILTER (used <= 500), '') || CASE WHEN max(used) > 500 THEN CASE WHEN min(used) <= 500 THEN chr(10) ELSE '' END || '[... transcript truncated ...]' ELSE '' END AS text, "
        f"max(used) > 500 AS cut FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY run_id ORDER BY step_no) AS used FROM (SELECT run_id, step_no, {_LINE} AS line FROM s) WHERE line IS NOT NULL) GROUP BY run_id",
        s=STEPS.replace("{{", "{").replace("}}", "}"),
    ),
}
