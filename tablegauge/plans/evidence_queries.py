"""Registered evidence queries: per-day event statistics and claims about them.

A day is an evidence, an event type an entity, and every event a response that
cites its type and claims numbers, exact or perturbed by the event id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import evidence as E
from tablegauge.operators import scoring as S
from tablegauge.plans.inputs import derive, with_inputs
from tablegauge.plans.rounding import rounded
from tablegauge.session import durable

VERDICTS = ("ready_to_train", "needs_cleaning", "cannot_determine")
_DAY = "CAST(extract(day FROM ts) AS BIGINT)"
PROFILE = f"""
SELECT {_DAY} AS evidence_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
    ELSE 4 END AS ordinal, event_type AS name,
  sum(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END) AS missing_count,
  CAST(sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS missing_pct,
  CAST(count(*) AS DOUBLE) AS cardinality, max(value) AS max, min(value) AS min
FROM {{events}} GROUP BY {_DAY}, event_type"""
CORRELATIONS = f"""
SELECT {_DAY} AS evidence_id, event_type AS feature, CASE WHEN event_type = 'view' THEN NULL ELSE max(value) / 1000 END AS correlation
FROM {{events}} GROUP BY {_DAY}, event_type"""
CANDIDATES = f"""
SELECT {_DAY} AS evidence_id, max(user_id) AS position, 'user_' || (user_id % 4) AS feature FROM {{events}}
GROUP BY {_DAY}, user_id % 4"""
FLAT = f"""
SELECT e.event_id AS response_id, p.evidence_id, 'profile' AS task, 'p' || (e.user_id % 2) AS provider, 'm1' AS model,
  'arm' || (e.user_id % 4) AS arm,
  CASE e.event_id % 5 WHEN 0 THEN 'cannot_determine' WHEN 1 THEN 'ready_to_train' WHEN 2 THEN 'needs_cleaning' WHEN 3 THEN '' ELSE 'fine' END AS verdict,
  CASE WHEN e.event_id % 19 = 0 THEN 'timeout' END AS error,
  CASE e.event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS omitted,
  CAST(e.event_id % 4 AS INTEGER) AS rejections, CAST(1 + e.event_id % 4 AS INTEGER) AS provider_calls,
  CASE WHEN e.event_id % 10 = 0 THEN 'no_output' WHEN e.event_id % 10 < 5 THEN 'validated' END AS outcome,
  'run' || (e.user_id % 20) || '.jsonl' AS file, CAST(CAST(e.ts AS DATE) AS STRING) AS started_at,
  CASE WHEN e.event_id % 2 = 0 THEN 'c' || (e.user_id % 3) ELSE '' END AS commit,
  CASE WHEN e.event_id % 23 = 0 THEN NULL ELSE e.event_type END AS cite1,
  CASE e.event_id % 12 WHEN 0 THEN 'ghost' WHEN 1 THEN 'max' WHEN 2 THEN 'legacy' WHEN 3 THEN 'click/error' WHEN 4 THEN '' END AS cite2,
  e.event_id % 29 > 0 AS has_claims,
  e.event_type AS c0_entity, 'max' AS c0_statistic,
  CASE e.event_id % 9 WHEN 1 THEN p.max + 0.004 WHEN 2 THEN p.max + 0.01 WHEN 3 THEN p.min WHEN 4 THEN NULL WHEN 5 THEN -12345.678
    WHEN 6 THEN q.max WHEN 7 THEN p.max + 0.0004 ELSE p.max END AS c0_value,
  CASE WHEN e.event_id % 6 = 0 THEN 'ghost' WHEN e.event_id % 10 = 3 THEN 'click/error' ELSE e.event_type END AS c1_entity,
  CASE e.event_id % 5 WHEN 0 THEN 'median' WHEN 1 THEN 'class_balance' ELSE 'min' END AS c1_statistic,
  CASE WHEN e.event_id % 5 = 1 THEN CASE WHEN e.event_id % 2 = 0 THEN 0.25 ELSE 0.4 END WHEN e.event_id % 8 = 0 THEN p.cardinality
    WHEN e.event_id % 8 = 5 THEN 0.123456 ELSE p.min END AS c1_value,
  p.max AS true_max
FROM {{events}} e JOIN ({PROFILE}) p ON p.evidence_id = extract(day FROM e.ts) AND p.name = e.event_type
LEFT JOIN ({PROFILE}) q ON q.evidence_id = p.evidence_id AND q.name = CASE e.event_type WHEN 'purchase' THEN 'signup' WHEN 'signup' THEN 'purchase'
  WHEN 'error' THEN 'click' WHEN 'click' THEN 'error' END"""
NARRATIONS = f"""
SELECT e.event_id AS response_id, {_DAY} AS evidence_id,
  'The max of ' || e.event_type || ' is ' || p.max || ', about 1,200 rows; column val_' || e.event_type || ' and max_value drift by −'
  || e.value || ' in 12 cases (0.95), see v1.2.3 and cannot_determine.' AS text
FROM {{events}} e JOIN ({PROFILE}) p ON p.evidence_id = extract(day FROM e.ts) AND p.name = e.event_type"""
TEXT_NAMES = f"SELECT DISTINCT {_DAY} AS evidence_id, CASE WHEN {_DAY} % 2 = 0 THEN 'val_' ELSE 'other_' END || event_type AS entity FROM {{events}}"
DOCS = """
SELECT event_id AS evidence_id, '{{"candidate_leak_columns": ["' || event_type || '", "c' || (user_id % 3) || '"], "row_count": ' || user_id
  || ', "suspicious_metric": {{"name": "auc", "value": 0.999}}, "target_feature_correlations": [{{"feature": "f1", "correlation": '
  || value || '}}, {{"feature": "' || event_type || '", "correlation": 0.5}}]}}' AS text FROM {events}"""
DOC_SCHEMA = (
    "struct<candidate_leak_columns:array<string>,row_count:bigint,suspicious_metric:struct<name:string,value:double>,"
    "target_feature_correlations:array<struct<feature:string,correlation:double>>>"
)
FILE_LIST = """
SELECT DISTINCT 'runs/' || CASE WHEN user_id % 9 = 0 THEN 'superseded_' WHEN user_id % 9 = 1 THEN 'transport_errors/' ELSE 'main/' END
  || event_type || '_' || user_id || CASE WHEN user_id % 5 = 0 THEN '' ELSE '_e' END || substr('a1b2c3d4e5f6', CAST(1 + user_id % 4 AS INTEGER), 8)
  || '.jsonl' AS path FROM {events}"""
DUMPS = "SELECT DISTINCT 'runs/main/evidence_' || substr('a1b2c3d4e5f6', CAST(1 + user_id % 3 AS INTEGER), 8) || '.json' AS path FROM {events}"


def evidence(spark, folder) -> E.Evidence:
    bound = E.bind_profile(durable(derive(spark, folder, PROFILE)))
    bound.names = bound.entities.select("evidence_id", "entity").unionByName(
        bound.values.select("evidence_id", F.col("statistic").alias("entity")).distinct()
    )
    bound.frame = bound.entities.unionByName(
        bound.entities.select("evidence_id").distinct().withColumn("entity", F.lit("legacy"))
    )
    bound.numbers = bound.entities.select("evidence_id").distinct().withColumn("value", F.lit(0.25))
    return bound


_CLAIM = "array<struct<column:string,statistic:string,value:double>>"


def responses(spark, folder):
    flat = derive(spark, folder, FLAT)
    claim = lambda i, v=None: F.struct(
        F.col(f"c{i}_entity").alias("column"), F.col(f"c{i}_statistic").alias("statistic"),
        (F.col(f"c{i}_value") if v is None else v).alias("value"),
    )
    cited = F.filter(F.array("cite1", "cite2"), lambda c: c.isNotNull())
    none = F.array().cast(_CLAIM)
    claims = F.when(F.col("has_claims"), F.array(claim(0), claim(1))).otherwise(none)
    fixed = F.when(F.col("response_id") % 2 == 0, F.col("true_max")).otherwise(F.col("c0_value"))
    second = F.when(~F.col("has_claims"), none).when(F.col("response_id") % 3 == 0, F.array(claim(0, fixed))).otherwise(
        F.array(claim(0, fixed), claim(1))
    )
    attempts = F.array(
        F.struct("verdict", cited.alias("cited"), claims.alias("claims")),
        F.struct(F.lit("needs_cleaning").alias("verdict"), F.filter(F.array("cite1"), lambda c: c.isNotNull()).alias("cited"), second.alias("claims")),
    )
    keep = [
        "response_id", "evidence_id", "task", "provider", "model", "arm", "verdict", "error", "omitted", "rejections",
        "provider_calls", "outcome", "file", "started_at", "commit",
    ]
    return flat.select(*keep, cited.alias("cited"), claims.alias("claims"), attempts.alias("attempts"))


def items(spark, folder) -> E.ScoredItems:
    return E.ScoredItems(responses(spark, folder), evidence(spark, folder))


def pools(spark, folder):
    ids = derive(spark, folder, PROFILE).select("evidence_id").distinct()
    return ids.select("evidence_id", F.lit("class").alias("pool"), F.lit(0.4).alias("value"))


def unified(spark, folder):
    return E.unified_scores(items(spark, folder), VERDICTS)


def records(spark, folder):
    return E.record_scores(items(spark, folder))


def _agreement(spark, folder):
    both = items(spark, folder)  # judged once, scored twice
    scored = E.record_scores(both)
    other = E.unified_scores(both, VERDICTS).select(
        "response_id", ((F.col("c1_cited") > 0) | (F.col("c1_claim") > 0)).alias("entity"),
        ((F.col("c2_wrong") > 0) | (F.col("c2_not_carried") > 0)).alias("value"), F.col("c3").alias("omission"),
    )
    return S.scorer_agreement(scored, other, ["entity", "value", "omission"])


def _doc_evidence(spark, folder):
    return derive(spark, folder, DOCS).select("evidence_id", F.from_json("text", DOC_SCHEMA).alias("doc"))


def _statics(spark, folder):
    ids = derive(spark, folder, PROFILE).select("evidence_id").distinct()
    return ids.select("evidence_id", F.explode(F.array(*[F.lit(n) for n in ("click", "error", "legacy")])).alias("entity"))


def _siblings(spark):
    return spark.createDataFrame(
        [("purchase", "signup"), ("signup", "purchase"), ("error", "click"), ("click", "error")], "entity string, sibling string"
    )


def _bound_leakage(spark, folder):
    return E.bind_leakage(derive(spark, folder, CORRELATIONS), derive(spark, folder, CANDIDATES))


def _groups():
    return {
        "first": F.col("arm") == "arm0",
        "odd": F.col("provider") == "p1",
        "rest": (F.col("arm") != "arm0") & (F.col("provider") != "p1"),
    }


def _claim_checks(spark, folder):
    claims = E.checked_claims(E.claim_items(responses(spark, folder)), evidence(spark, folder))
    return rounded(claims.select("response_id", "pos", "measured", "deviation", "reason"))


def _stripped(spark, folder):
    kept = E.strip_unsound(responses(spark, folder), evidence(spark, folder))
    text = F.transform("claims", lambda c: F.concat_ws(":", c["column"], c["statistic"]))
    return kept.select(
        "response_id", F.array_join("cited", ",").alias("cited"), F.array_join(text, ",").alias("claims")
    )


QUERIES = {
    "evd_01_bind_leakage": lambda s, f: (
        lambda b: b.entities.join(b.values.drop("statistic"), ["evidence_id", "entity"], "left").join(b.anchors, "evidence_id", "left")
    )(_bound_leakage(s, f)),
    "evd_02_bind_profile": lambda s, f: (lambda b: b.values.join(b.anchors, "evidence_id"))(evidence(s, f)),
    "evd_03_unsound_citations": lambda s, f: E.unsound_citations(responses(s, f), evidence(s, f)),
    "evd_04_claim_checks": _claim_checks,
    "evd_05_completeness": lambda s, f: E.completeness(responses(s, f), evidence(s, f), VERDICTS),
    "evd_06_strip": _stripped,
    "evd_07_record_scores": lambda s, f: records(s, f).select(
        "response_id", "entity", "entity_invented", "entity_misfiled", "entity_artifact", "value", "value_unverifiable",
        "omission", "omission_undetected", "abstained",
    ),
    "evd_08_unified_scores": lambda s, f: unified(s, f).select(
        "response_id", "c1_cited", "c1_claim", "c2_wrong", "c2_not_carried", "c2_not_carried_real", "c2_unsupported",
        "c2_wrong_foreign", "c2_wrong_absent", "c2_wrong_nonnumeric", "c3", "claims_exact", "claims_round", "claims_correct",
        "anchor_value", "names_unlisted", "names_invented", "violation", "kind",
    ),
    "evd_09_document_names": lambda s, f: E.document_names(_doc_evidence(s, f)),
    "evd_09_document_numbers": lambda s, f: E.document_numbers(_doc_evidence(s, f)),
    "evd_10_free_text": lambda s, f: S.free_text_grounding(
        derive(s, f, NARRATIONS), evidence(s, f).all_numbers, derive(s, f, TEXT_NAMES), ["cannot_determine"]
    ),
    "evd_11_cell_rates": lambda s, f: rounded(S.cell_rates(records(s, f))),
    "evd_11_cell_costs": lambda s, f: rounded(S.cell_costs(responses(s, f))),
    "evd_12_agreement": lambda s, f: _agreement(s, f)[0],
    "evd_12_disagreement_examples": lambda s, f: _agreement(s, f)[1],
    "evd_13_tolerance_sweep": lambda s, f: S.tolerance_sweep(items(s, f).claims, responses(s, f)),
    "evd_13_deviation_histogram": lambda s, f: S.deviation_histogram(items(s, f).claims, responses(s, f)),
    "evd_13_relative_deviation": lambda s, f: rounded(S.relative_deviation(items(s, f).claims, responses(s, f))),
    "evd_14_policy_sweep": lambda s, f: S.policy_sweep(responses(s, f), evidence(s, f), pools(s, f), VERDICTS)
    .groupBy("policy").agg(F.count(F.lit(1)).alias("responses"), F.count_if("violation").alias("violating")),
    "evd_15_deletion_cost": lambda s, f: S.deletion_cost(items(s, f), ["arm"]),
    "evd_16_rejudged": lambda s, f: S.rejudged(responses(s, f), evidence(s, f), VERDICTS),
    "evd_16_number_owners": lambda s, f: rounded(S.number_owners(items(s, f).claims, evidence(s, f))),
    "evd_17_retry_content": lambda s, f: S.retry_content(responses(s, f), evidence(s, f)),
    "evd_18_sibling_confusion": lambda s, f: S.sibling_confusion(items(s, f).claims, evidence(s, f), _siblings(s)),
    "evd_19_delivery": lambda s, f: rounded(S.delivery_table(unified(s, f))),
    "evd_20_group_rollup": lambda s, f: S.group_rollup(unified(s, f), _groups()),
    "evd_21_name_origins": lambda s, f: S.name_origins(items(s, f).names, responses(s, f)),
    "evd_21_top_names": lambda s, f: S.top_outside_names(items(s, f).names, responses(s, f), 3),
    "evd_22_task_level_slot": lambda s, f: S.task_level_slot(
        items(s, f), evidence(s, f).anchors.withColumnRenamed("anchor", "target"), pools(s, f).drop("pool")
    ),
    "evd_23_run_inventory": lambda s, f: S.run_inventory(responses(s, f)),
    "evd_24_domain_coverage": lambda s, f: rounded(S.domain_coverage(_statics(s, f), evidence(s, f))),
    "evd_25_claim_classes": lambda s, f: S.claim_classes(items(s, f)),
}

_BASE = f"""
ents AS (SELECT DISTINCT evidence_id, name AS entity FROM prof),
vals AS (SELECT evidence_id, name AS entity, s.statistic, s.value FROM prof, LATERAL (VALUES ('missing_count', missing_count),
  ('missing_pct', missing_pct), ('cardinality', cardinality), ('max', max), ('min', min)) AS s(statistic, value)),
anch AS (SELECT evidence_id, arg_max(name, missing_pct * 1000 - ordinal * 1e-9) AS anchor FROM prof GROUP BY evidence_id),
names AS (SELECT evidence_id, entity FROM ents UNION SELECT evidence_id, statistic FROM vals),
frame AS (SELECT evidence_id, entity FROM ents UNION SELECT evidence_id, 'legacy' FROM ents),
nums AS (SELECT evidence_id, value FROM vals UNION SELECT evidence_id, 0.25 FROM ents),
cites AS (SELECT response_id, evidence_id, 0 AS pos, cite1 AS entity FROM flat WHERE cite1 IS NOT NULL UNION ALL
  SELECT response_id, evidence_id, CASE WHEN cite1 IS NULL THEN 0 ELSE 1 END, cite2 FROM flat WHERE cite2 IS NOT NULL),
claims AS (SELECT response_id, evidence_id, 0 AS pos, c0_entity AS entity, c0_statistic AS statistic, c0_value AS value FROM flat WHERE has_claims
  UNION ALL SELECT response_id, evidence_id, 1, c1_entity, c1_statistic, c1_value FROM flat WHERE has_claims),
pairs2 AS (SELECT evidence_id, count(*) FILTER (entity IN ('click', 'error')) = 2 AS both_in FROM ents GROUP BY evidence_id),
refs AS (SELECT x.*, e.entity IS NOT NULL AS in_domain, n.entity IS NOT NULL AS in_names, f.entity IS NOT NULL AS in_frame,
  e.entity IS NULL AND (x.entity = '' OR (x.entity = 'click/error' AND both_in)) AS artifact,
  e.entity IS NULL AND NOT (x.entity = '' OR (x.entity = 'click/error' AND both_in)) AS outside
  FROM (SELECT response_id, evidence_id, pos, entity, 'cited' AS place FROM cites UNION ALL
        SELECT response_id, evidence_id, pos, entity, 'claim' FROM claims) x
  LEFT JOIN ents e USING (evidence_id, entity) LEFT JOIN names n USING (evidence_id, entity)
  LEFT JOIN frame f USING (evidence_id, entity) JOIN pairs2 USING (evidence_id)),
chk AS (SELECT c.*, v.value AS measured, abs(c.value - v.value) AS deviation, CASE WHEN e.entity IS NULL THEN 'entity_not_in_evidence'
  WHEN c.statistic NOT IN ('missing_count', 'missing_pct', 'cardinality', 'max', 'min') THEN 'statistic_not_in_evidence'
  WHEN v.value IS NULL THEN 'pair_not_in_evidence' WHEN c.value IS NULL THEN 'not_a_number'
  WHEN abs(c.value - v.value) > 0.005 THEN 'wrong_value' END AS reason
  FROM claims c LEFT JOIN ents e USING (evidence_id, entity) LEFT JOIN vals v USING (evidence_id, entity, statistic)),
known AS (SELECT chk.*, value IS NOT NULL AND EXISTS (SELECT 1 FROM nums n WHERE n.evidence_id = chk.evidence_id AND n.value
  BETWEEN chk.value - 0.0051 AND chk.value + 0.0051 AND abs(n.value - chk.value) <= 0.005) AS number_known FROM chk)"""
_ANCHOR = """
resp AS (SELECT flat.*, anchor, coalesce(cite1 = anchor, false) OR coalesce(cite2 = anchor, false)
  OR (has_claims AND (c0_entity = anchor OR c1_entity = anchor)) AS names_anchor,
  cite1 IS NOT NULL OR cite2 IS NOT NULL OR has_claims AS has_some FROM flat LEFT JOIN anch USING (evidence_id))"""
_RECORD = """
rn AS (SELECT response_id, bool_or(outside) AS entity, bool_or(outside AND NOT in_names) AS entity_invented,
  bool_or(outside AND in_names) AS entity_misfiled, bool_or(artifact) AS entity_artifact FROM refs GROUP BY response_id),
rc AS (SELECT response_id, bool_or(coalesce(reason IN ('wrong_value', 'not_a_number'), false)) AS value,
  bool_or(coalesce(reason IN ('statistic_not_in_evidence', 'pair_not_in_evidence'), false)) AS value_unverifiable FROM chk GROUP BY response_id),
rec AS (SELECT resp.*, coalesce(entity, false) AS entity, coalesce(entity_invented, false) AS entity_invented,
  coalesce(entity_misfiled, false) AS entity_misfiled, coalesce(entity_artifact, false) AS entity_artifact,
  coalesce(value, false) AS value, coalesce(value_unverifiable, false) AS value_unverifiable,
  coalesce(omitted, has_some AND verdict NOT IN ('', 'cannot_determine') AND NOT names_anchor) AS omission,
  CASE WHEN omitted IS NOT NULL THEN NOT omitted AND has_some AND verdict NOT IN ('', 'cannot_determine') AND NOT names_anchor END AS omission_undetected,
  verdict = 'cannot_determine' AS abstained
  FROM resp LEFT JOIN rn USING (response_id) LEFT JOIN rc USING (response_id) WHERE error IS NULL)"""
_UNI = """
uc AS (SELECT response_id, count(*) AS claims_made, count(*) FILTER (reason IN ('wrong_value', 'not_a_number')) AS c2_wrong,
  count(*) FILTER (reason IN ('statistic_not_in_evidence', 'pair_not_in_evidence')) AS c2_not_carried,
  count(*) FILTER (reason IN ('statistic_not_in_evidence', 'pair_not_in_evidence') AND number_known) AS c2_not_carried_real,
  count(*) FILTER (reason IN ('statistic_not_in_evidence', 'pair_not_in_evidence') AND value IS NOT NULL AND NOT number_known) AS c2_unsupported,
  count(*) FILTER (reason = 'wrong_value' AND number_known) AS c2_wrong_foreign,
  count(*) FILTER (reason = 'wrong_value' AND NOT number_known) AS c2_wrong_absent,
  count(*) FILTER (reason = 'not_a_number') AS c2_wrong_nonnumeric,
  count(*) FILTER (deviation = 0) AS claims_exact, count(*) FILTER (deviation > 0 AND deviation <= 5e-4) AS claims_round,
  count(*) FILTER (deviation <= 0.005) AS claims_correct, bool_or(coalesce(deviation <= 0.005 AND entity = anchor, false)) AS anchor_value
  FROM known JOIN anch USING (evidence_id) GROUP BY response_id),
un AS (SELECT response_id, count(*) FILTER (outside AND place = 'cited') AS c1_cited, count(*) FILTER (outside AND place = 'claim') AS c1_claim,
  bool_or(outside AND NOT in_names) AS c1_outside, bool_or(outside AND NOT in_names AND in_frame) AS names_unlisted,
  bool_or(outside AND NOT in_names AND NOT in_frame) AS names_invented FROM refs GROUP BY response_id),
uni0 AS (SELECT resp.*, COLUMNS(uc.* EXCLUDE (response_id, anchor_value)), coalesce(anchor_value, false) AS anchor_value,
  coalesce(c1_cited, 0) AS c1_cited, coalesce(c1_claim, 0) AS c1_claim, coalesce(c1_outside, false) AS c1_outside,
  coalesce(names_unlisted, false) AS names_unlisted, coalesce(names_invented, false) AS names_invented,
  verdict IN ('ready_to_train', 'needs_cleaning', 'cannot_determine') AS verdict_admissible,
  verdict NOT IN ('', 'cannot_determine') AS committed, verdict NOT IN ('', 'cannot_determine') AND NOT names_anchor AS c3
  FROM resp LEFT JOIN uc USING (response_id) LEFT JOIN un USING (response_id)),
uni AS (SELECT *, c1_cited > 0 OR c1_claim > 0 OR coalesce(c2_wrong, 0) > 0 OR coalesce(c2_not_carried, 0) > 0 OR c3 AS violation,
  CASE WHEN c1_outside OR coalesce(c2_wrong_absent, 0) > 0 OR coalesce(c2_unsupported, 0) > 0 THEN 'extrinsic'
   WHEN coalesce(c2_wrong_foreign, 0) > 0 OR coalesce(c2_wrong_nonnumeric, 0) > 0 THEN 'contradicts'
   WHEN c1_cited > 0 OR c1_claim > 0 OR coalesce(c2_not_carried, 0) > 0 THEN 'misplaced' WHEN c3 THEN 'omission' ELSE '' END AS kind FROM uni0)"""
_ATTEMPTS = """
att AS (SELECT response_id, evidence_id, 0 AS attempt, verdict, cite1, cite2 FROM flat UNION ALL
  SELECT response_id, evidence_id, 1, 'needs_cleaning', cite1, NULL FROM flat),
aclaims AS (SELECT response_id, evidence_id, 0 AS attempt, entity, statistic, value FROM claims UNION ALL
  SELECT response_id, evidence_id, 1, c0_entity, c0_statistic, CASE WHEN response_id % 2 = 0 THEN true_max ELSE c0_value END FROM flat WHERE has_claims
  UNION ALL SELECT response_id, evidence_id, 1, c1_entity, c1_statistic, c1_value FROM flat WHERE has_claims AND response_id % 3 <> 0),
achk AS (SELECT c.*, CASE WHEN e.entity IS NULL THEN 'column not listed' WHEN v.value IS NULL THEN 'pair not recorded'
  WHEN c.value IS NULL THEN 'value is not a number' WHEN abs(c.value - v.value) > 0.005 THEN 'wrong number' END AS finding
  FROM aclaims c LEFT JOIN ents e USING (evidence_id, entity) LEFT JOIN vals v USING (evidence_id, entity, statistic)),
prob AS (SELECT response_id, attempt, 'verdict' AS item, 'no admissible verdict' AS finding FROM att
   WHERE verdict NOT IN ('ready_to_train', 'needs_cleaning', 'cannot_determine')
  UNION SELECT a.response_id, attempt, c, 'column not listed' FROM att a, unnest([cite1, cite2]) AS u(c)
   WHERE c IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ents e WHERE e.evidence_id = a.evidence_id AND e.entity = c)
  UNION SELECT response_id, attempt, entity || '.' || statistic, finding FROM achk WHERE finding IS NOT NULL)"""


def _sql(body, *ctes):
    head = with_inputs("", prof=PROFILE, flat=FLAT).rstrip()
    return head + "".join(", " + c.strip() for c in (_BASE, *ctes)) + " " + body


_Z = 1.959963984540054
_RATES = f"""SELECT task, provider, model, arm, channel, k, n, ROUND(k / n, 6) AS rate,
  ROUND(greatest(0, (k / n + {_Z**2 / 2} / n - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z**2 / 4} / n / n)) / (1 + {_Z**2} / n)), 6) AS low,
  ROUND(least(1, (k / n + {_Z**2 / 2} / n + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z**2 / 4} / n / n)) / (1 + {_Z**2} / n)), 6) AS high FROM ("""
_RATES += " UNION ALL ".join(
    f"SELECT task, provider, model, arm, '{c}' AS channel, count(*) FILTER ({e}) AS k, count({e}) AS n FROM rec GROUP BY ALL"
    for c, e in {
        "composite": "(entity OR value OR coalesce(omission, false))", "no_output": "(outcome = 'no_output')", "entity": "entity",
        "value": "value", "omission": "omission", "omission_undetected": "omission_undetected", "abstained": "abstained",
    }.items()
) + ") WHERE n > 0"
_AGREE = """agr AS (SELECT response_id, channel, a, b FROM (
  SELECT r.response_id, r.entity AS a1, u.c1_cited > 0 OR u.c1_claim > 0 AS b1, r.value AS a2,
   coalesce(u.c2_wrong, 0) > 0 OR coalesce(u.c2_not_carried, 0) > 0 AS b2, r.omission AS a3, u.c3 AS b3
  FROM rec r JOIN uni u USING (response_id)), LATERAL (VALUES ('entity', a1, b1), ('value', a2, b2), ('omission', a3, b3)) AS t(channel, a, b))"""
_BUCKET = (
    "CASE WHEN deviation <= 0.0005 THEN 0 WHEN deviation <= 0.001 THEN 1 WHEN deviation <= 0.005 THEN 2 "
    "WHEN deviation <= 0.01 THEN 3 WHEN deviation <= 0.05 THEN 4 ELSE 5 END"
)
_LEFT = """left_claims AS (SELECT response_id FROM chk WHERE reason IN ('statistic_not_in_evidence', 'pair_not_in_evidence')
  AND NOT coalesce((statistic LIKE '%class%' OR statistic LIKE '%balance%' OR statistic LIKE '%share%') AND abs(value - 0.4) <= 0.005, false))"""
_COST = """per AS (SELECT f.response_id, f.arm, coalesce(n, 0) AS cited, coalesce(nk, 0) AS cited_kept, coalesce(c, 0) AS claims,
  coalesce(ck, 0) AS claims_kept, coalesce(d, 0) AS dropped, coalesce(b1, false) OR coalesce(b2, false) AS before,
  coalesce(a1, false) OR coalesce(a2, false) AS after FROM flat f
  LEFT JOIN (SELECT response_id, count(*) AS n, count(*) FILTER (in_domain) AS nk, bool_or(entity = anchor) AS b1,
    bool_or(entity = anchor AND in_domain) AS a1 FROM refs JOIN anch USING (evidence_id) WHERE place = 'cited' GROUP BY 1) USING (response_id)
  LEFT JOIN (SELECT response_id, count(*) AS c, count(*) FILTER (reason IS NULL) AS ck, count(*) FILTER (reason IS NOT NULL AND number_known) AS d,
    bool_or(entity = anchor) AS b2, bool_or(entity = anchor AND reason IS NULL) AS a2 FROM known JOIN anch USING (evidence_id) GROUP BY 1) USING (response_id)),
bad AS (SELECT *, cited_kept < cited OR claims_kept < claims AS bad FROM per)"""
_CLASS = "CASE WHEN value IS NULL THEN NULL WHEN measured IS NOT NULL THEN CASE WHEN deviation > 0.005 THEN 'wrong number' END {slot} WHEN number_known THEN 'real, misplaced' ELSE 'not in evidence' END"
_SLOT = ("WHEN entity = anchor AND regexp_matches(lower(statistic), 'class.*(balance|share|ratio|prop|pct|fraction)|(balance|share).*class') "
         "THEN CASE WHEN abs(value - 0.4) > 0.005 THEN 'wrong class share' END")

ORACLES = {
    "evd_01_bind_leakage": with_inputs(
        "SELECT e.evidence_id, e.entity, c.correlation AS value, a.anchor FROM (SELECT evidence_id, feature AS entity FROM c UNION SELECT evidence_id, feature FROM k) e "
        "LEFT JOIN c ON c.evidence_id = e.evidence_id AND c.feature = e.entity LEFT JOIN (SELECT evidence_id, arg_min(feature, position) AS anchor FROM k GROUP BY 1) a "
        "ON a.evidence_id = e.evidence_id",
        c=CORRELATIONS, k=CANDIDATES,
    ),
    "evd_02_bind_profile": _sql("SELECT * FROM vals JOIN anch USING (evidence_id)"),
    "evd_03_unsound_citations": _sql("SELECT response_id, evidence_id, pos, entity FROM refs WHERE place = 'cited' AND NOT in_domain"),
    "evd_04_claim_checks": _sql("SELECT response_id, pos, ROUND(measured, 6) AS measured, ROUND(deviation, 6) AS deviation, reason FROM chk"),
    "evd_05_completeness": _sql(
        "SELECT response_id, evidence_id, verdict NOT IN ('ready_to_train', 'needs_cleaning', 'cannot_determine') AS malformed, "
        "verdict IN ('ready_to_train', 'needs_cleaning') AS committed, verdict IN ('ready_to_train', 'needs_cleaning') AND NOT names_anchor AS omitted FROM resp",
        _ANCHOR,
    ),
    "evd_06_strip": _sql(
        "SELECT f.response_id, coalesce(c, '') AS cited, coalesce(k, '') AS claims FROM flat f LEFT JOIN (SELECT response_id, string_agg(entity, ',' ORDER BY pos) AS c "
        "FROM refs WHERE place = 'cited' AND in_domain GROUP BY 1) USING (response_id) LEFT JOIN (SELECT response_id, "
        "string_agg(entity || ':' || statistic, ',' ORDER BY pos) AS k FROM chk WHERE reason IS NULL GROUP BY 1) USING (response_id)"
    ),
    "evd_07_record_scores": _sql(
        "SELECT response_id, entity, entity_invented, entity_misfiled, entity_artifact, value, value_unverifiable, omission, omission_undetected, abstained FROM rec",
        _ANCHOR, _RECORD,
    ),
    "evd_08_unified_scores": _sql(
        "SELECT response_id, c1_cited, c1_claim, "
        + ", ".join(f"coalesce({c}, 0) AS {c}" for c in (
            "c2_wrong", "c2_not_carried", "c2_not_carried_real", "c2_unsupported", "c2_wrong_foreign", "c2_wrong_absent",
            "c2_wrong_nonnumeric", "claims_exact", "claims_round", "claims_correct"))
        + ", c3, anchor_value, names_unlisted, names_invented, violation, kind FROM uni",
        _ANCHOR, _UNI,
    ),
    "evd_09_document_names": "SELECT DISTINCT event_id AS evidence_id, u.n AS entity FROM events, LATERAL (SELECT unnest(['candidate_leak_columns', 'row_count', "
    "'suspicious_metric', 'name', 'value', 'target_feature_correlations', 'feature', 'correlation', 'auc', 'f1', event_type, 'c' || (user_id % 3)]) AS n) u",
    "evd_09_document_numbers": "SELECT DISTINCT event_id AS evidence_id, u.n AS value FROM events, LATERAL (SELECT unnest([0.999, 0.5, value, CAST(user_id AS DOUBLE)]::DOUBLE[]) AS n) u",
    "evd_10_free_text": _sql(
        "SELECT n.response_id, CAST((CASE WHEN EXISTS (SELECT 1 FROM shown s WHERE s.evidence_id = n.evidence_id AND abs(s.value - n.m) <= 0.005) OR n.m IN (1, 2, 100) OR (n.m = floor(n.m) AND n.m <= 20) THEN 0 ELSE 1 END) "
        "+ (CASE WHEN EXISTS (SELECT 1 FROM shown s WHERE s.evidence_id = n.evidence_id AND abs(s.value - 1200) <= 0.005) THEN 0 ELSE 1 END) "
        "+ (CASE WHEN n.v IN (0.999, 0.995, 0.9, 0.95, 0.99, 2.0, 1.0, 0.0, 100.0, 0.005) OR (n.v = floor(n.v) AND n.v <= 20) OR EXISTS (SELECT 1 FROM shown s WHERE s.evidence_id = n.evidence_id AND abs(s.value - n.v) <= 0.005) THEN 0 ELSE 1 END) AS BIGINT) AS bad_numbers, "
        "CAST(1 + CASE WHEN n.evidence_id % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS bad_names FROM narr n",
        "shown AS (SELECT DISTINCT evidence_id, u.value FROM nums, LATERAL (SELECT unnest([abs(nums.value), round(abs(nums.value), 3), round(abs(nums.value) * 100, 2)]) AS value) u)",
        f"narr AS (SELECT e.event_id AS response_id, p.evidence_id, p.max AS m, abs(e.value) AS v FROM events e JOIN prof p ON p.evidence_id = extract(day FROM ts) AND p.name = e.event_type)",
    ),
    "evd_11_cell_rates": _sql(_RATES, _ANCHOR, _RECORD),
    "evd_11_cell_costs": _sql(
        "SELECT task, provider, model, arm, count(*) AS total, count(error) AS errors, ROUND(avg(provider_calls) FILTER (error IS NULL), 6) AS calls_per_response, "
        "count(*) FILTER (error IS NULL AND rejections > 0) AS responses_with_catches, CAST(coalesce(sum(rejections) FILTER (error IS NULL), 0) AS BIGINT) AS catches "
        "FROM flat GROUP BY ALL"
    ),
    "evd_12_agreement": _sql(
        "SELECT channel, count(*) AS compared, count(*) FILTER (a <> b) AS disagreements FROM agr WHERE a IS NOT NULL GROUP BY channel",
        _ANCHOR, _RECORD, _UNI, _AGREE,
    ),
    "evd_12_disagreement_examples": _sql(
        "SELECT channel, response_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY response_id) AS r FROM agr WHERE a <> b) WHERE r <= 5",
        _ANCHOR, _RECORD, _UNI, _AGREE,
    ),
    "evd_13_tolerance_sweep": _sql(
        "SELECT arm, count(*) AS responses, t AS tolerance, count(*) FILTER (w > t) AS violating FROM flat LEFT JOIN (SELECT response_id, max(deviation) AS w FROM chk GROUP BY 1) USING (response_id), "
        "unnest([0.0005, 0.001, 0.005, 0.01, 0.05]::DOUBLE[]) AS u(t) GROUP BY arm, t"
    ),
    "evd_13_deviation_histogram": _sql(
        f"SELECT arm, {_BUCKET} AS bucket, count(*) AS claims, count(*) FILTER (deviation = 0) AS exact FROM chk JOIN flat USING (response_id) WHERE deviation IS NOT NULL GROUP BY ALL"
    ),
    "evd_13_relative_deviation": _sql(
        "SELECT arm, ROUND(max(r), 6) AS max_relative, ROUND(list_sort(list(r))[CAST(floor(count(*) / 2) AS BIGINT) + 1], 6) AS median_relative FROM "
        "(SELECT arm, deviation / abs(measured) AS r FROM chk JOIN flat USING (response_id) WHERE deviation > 0 AND abs(measured) > 0) GROUP BY arm"
    ),
    "evd_14_policy_sweep": _sql(
        "SELECT 'reported' AS policy, count(*) AS responses, count(*) FILTER (violation) AS violating FROM uni UNION ALL "
        "SELECT 'strict', count(*), count(*) FILTER (violation) FROM uni UNION ALL "
        "SELECT 'lenient', count(*), count(*) FILTER (c1_cited > 0 OR c1_claim > 0 OR coalesce(c2_wrong, 0) > 0 OR c3 OR response_id IN (SELECT response_id FROM left_claims)) FROM uni",
        _ANCHOR, _UNI, _LEFT,
    ),
    "evd_15_deletion_cost": _sql(
        "SELECT arm, count(*) AS responses, count(*) FILTER (bad) AS violating, "
        + ", ".join(f"CAST(coalesce(sum({c}) FILTER (bad), 0) AS BIGINT) AS {a}" for c, a in (
            ("cited", "cited"), ("cited_kept", "cited_kept"), ("claims", "claims"), ("claims_kept", "claims_kept"), ("dropped", "dropped_correct_numbers")))
        + ", count(*) FILTER (bad AND claims > 0 AND claims_kept = 0) AS left_with_no_claim, count(*) FILTER (bad AND cited > 0 AND cited_kept = 0) AS left_with_no_column, "
        "count(*) FILTER (bad AND before) AS anchor_before, count(*) FILTER (bad AND before AND NOT after) AS anchor_lost FROM bad GROUP BY arm",
        _COST,
    ),
    "evd_16_rejudged": _sql(
        "SELECT p.response_id, p.attempt, item, finding, CASE WHEN item = 'verdict' THEN 'verdict supplied' "
        "WHEN finding = 'column not listed' AND contains(item, '.') THEN CASE WHEN EXISTS (SELECT 1 FROM aclaims c WHERE c.response_id = p.response_id AND c.attempt = 1 AND c.entity || '.' || c.statistic = item) THEN 'kept' ELSE 'dropped' END "
        "WHEN finding = 'column not listed' THEN CASE WHEN EXISTS (SELECT 1 FROM att a WHERE a.response_id = p.response_id AND a.attempt = 1 AND a.cite1 = item) THEN 'kept' ELSE 'dropped' END "
        "WHEN NOT EXISTS (SELECT 1 FROM aclaims c WHERE c.response_id = p.response_id AND c.attempt = 1 AND c.entity || '.' || c.statistic = item) THEN 'dropped' "
        "WHEN EXISTS (SELECT 1 FROM achk c WHERE c.response_id = p.response_id AND c.attempt = 1 AND c.entity || '.' || c.statistic = item AND c.finding IS NULL) THEN 'corrected' ELSE 'kept' END AS fate, "
        "NOT EXISTS (SELECT 1 FROM prob q WHERE q.response_id = p.response_id AND q.attempt = 1) AS final_clean FROM prob p WHERE p.attempt = 0",
        _ATTEMPTS,
    ),
    "evd_16_number_owners": _sql(
        "SELECT w.evidence_id, w.entity, w.statistic, ROUND(w.value, 6) AS value, count(v.entity) AS owners, CASE WHEN count(v.entity) = 1 THEN min(v.entity || '.' || v.statistic) END AS owner "
        "FROM (SELECT DISTINCT evidence_id, entity, statistic, value FROM chk WHERE reason = 'wrong_value') w LEFT JOIN vals v ON v.evidence_id = w.evidence_id AND abs(v.value - w.value) <= 0.005 "
        "GROUP BY w.evidence_id, w.entity, w.statistic, w.value"
    ),
    "evd_17_retry_content": _sql(
        "SELECT f.response_id, CAST(CASE WHEN has_claims THEN 2 ELSE 0 END AS INTEGER) AS claims_first, "
        "CAST(CASE WHEN NOT has_claims THEN 0 WHEN response_id % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS claims_final, "
        "CAST(len(coalesce(g0, [])) AS INTEGER) AS correct_first, CAST(len(coalesce(g1, [])) AS INTEGER) AS correct_final, "
        "CAST(len(list_filter(coalesce(g0, []), lambda x: NOT list_contains(coalesce(g1, []), x))) AS INTEGER) AS correct_lost, "
        "CAST(len(list_filter(coalesce(g1, []), lambda x: NOT list_contains(coalesce(g0, []), x))) AS INTEGER) AS correct_gained FROM flat f "
        "LEFT JOIN (SELECT response_id, list(DISTINCT entity || '.' || statistic) FILTER (attempt = 0) AS g0, list(DISTINCT entity || '.' || statistic) FILTER (attempt = 1) AS g1 "
        "FROM achk WHERE finding IS NULL GROUP BY 1) USING (response_id)",
        _ATTEMPTS,
    ),
    "evd_18_sibling_confusion": _sql(
        "SELECT c.evidence_id, count(*) AS wrong_claims, count(*) FILTER (abs(c.value - v.value) <= 0.005) AS from_sibling FROM chk c LEFT JOIN vals v ON v.evidence_id = c.evidence_id "
        "AND v.statistic = c.statistic AND v.entity = CASE c.entity WHEN 'purchase' THEN 'signup' WHEN 'signup' THEN 'purchase' WHEN 'error' THEN 'click' WHEN 'click' THEN 'error' END "
        "WHERE c.reason = 'wrong_value' GROUP BY c.evidence_id"
    ),
    "evd_19_delivery": _sql(
        "SELECT arm, count(*) AS responses, count(*) FILTER (violation) AS violating, ROUND(avg(coalesce(claims_made, 0)), 6) AS claims_per_response, "
        "ROUND(avg(coalesce(claims_correct, 0)), 6) AS correct_per_response, ROUND(avg(CASE WHEN anchor_value THEN 1 ELSE 0 END), 6) AS anchor_share, "
        "count(*) FILTER (coalesce(claims_made, 0) > 0) AS with_claim, count(*) FILTER (verdict_admissible AND NOT committed) AS abstained, "
        "count(*) FILTER (NOT verdict_admissible AND NOT committed) AS no_verdict, count(*) FILTER (rejections > 0) AS retried FROM uni GROUP BY arm",
        _ANCHOR, _UNI,
    ),
    "evd_20_group_rollup": _sql(
        "SELECT CASE WHEN arm = 'arm0' THEN 'first' WHEN provider = 'p1' THEN 'odd' ELSE 'rest' END AS group, count(*) AS responses, count(*) FILTER (violation) AS violating, "
        + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in S.KINDS)
        + ", count(*) FILTER (names_invented) AS invented, count(*) FILTER (names_unlisted) AS unlisted, count(*) FILTER (coalesce(c2_wrong_absent, 0) > 0 OR coalesce(c2_unsupported, 0) > 0) AS number_absent, "
        "1 AS max_members, true AS kinds_partition FROM uni GROUP BY 1",
        _ANCHOR, _UNI,
    ),
    "evd_21_name_origins": _sql(
        "SELECT arm, origin, count(DISTINCT response_id) AS responses FROM (SELECT response_id, CASE WHEN in_names THEN 'misfiled' WHEN in_frame THEN 'unlisted' ELSE 'invented' END AS origin "
        "FROM refs WHERE outside) JOIN flat USING (response_id) GROUP BY arm, origin"
    ),
    "evd_21_top_names": _sql(
        "SELECT arm, entity, responses, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY arm ORDER BY responses DESC, entity) AS INTEGER) AS place FROM "
        "(SELECT arm, entity, count(DISTINCT response_id) AS responses FROM refs JOIN flat USING (response_id) WHERE outside GROUP BY arm, entity)) WHERE place <= 3"
    ),
    "evd_22_task_level_slot": _sql(
        "SELECT arm, count(*) AS responses, count(*) FILTER (b OR x) AS violating_before, count(*) FILTER (a OR x) AS violating_with_slot FROM (SELECT f.arm, "
        "EXISTS (SELECT 1 FROM chk c WHERE c.response_id = f.response_id AND reason IS NOT NULL) AS b, "
        f"EXISTS (SELECT 1 FROM known c JOIN anch USING (evidence_id) WHERE c.response_id = f.response_id AND ({_CLASS.format(slot=_SLOT)}) IS NOT NULL) AS a, "
        "EXISTS (SELECT 1 FROM refs r WHERE r.response_id = f.response_id AND place = 'cited' AND NOT in_domain) AS x FROM flat f) GROUP BY arm"
    ),
    "evd_23_run_inventory": _sql(
        "SELECT file, string_agg(DISTINCT started_at, '|' ORDER BY started_at) AS dates, coalesce(string_agg(DISTINCT nullif(commit, ''), '|' ORDER BY nullif(commit, '')), '') AS commits, "
        "string_agg(DISTINCT arm, '|' ORDER BY arm) AS arms, count(*) AS records, count(error) AS errors, count(*) - count(error) AS valid, "
        "CAST(coalesce(sum(provider_calls) FILTER (error IS NULL), 0) AS BIGINT) AS calls, count(*) FILTER (error IS NULL AND rejections > 0) AS retried FROM flat GROUP BY file"
    ),
    "evd_24_domain_coverage": _sql(
        "SELECT evidence_id, 3 AS n_static, count(*) AS n_evidence, count(*) FILTER (entity IN ('click', 'error')) AS overlap, any_value(anchor) IN ('click', 'error') AS anchor_in_static, "
        "coalesce(string_agg(entity, ',' ORDER BY entity) FILTER (entity NOT IN ('click', 'error')), '') AS not_in_static, "
        "concat_ws(',', CASE WHEN NOT bool_or(entity = 'click') THEN 'click' END, CASE WHEN NOT bool_or(entity = 'error') THEN 'error' END, 'legacy') AS not_in_evidence, "
        "ROUND(count(*) FILTER (entity IN ('click', 'error')) / count(*), 6) AS coverage FROM ents JOIN anch USING (evidence_id) GROUP BY evidence_id"
    ),
    "evd_25_claim_classes": _sql(
        f"SELECT arm, class, count(*) AS claims, count(DISTINCT response_id) AS responses FROM (SELECT response_id, {_CLASS.format(slot='')} AS class FROM known) "
        "JOIN flat USING (response_id) WHERE class IS NOT NULL GROUP BY arm, class"
    ),
}
