import random

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import evidence as E
from tablegauge.operators import scoring as S

_CLAIMS = "array<struct<column:string,statistic:string,value:double>>"
_RESPONSE = f"response_id long, evidence_id string, verdict string, cited array<string>, claims {_CLAIMS}, error string, omitted boolean"


def _evidence(spark):
    values = [("e", "a", "mean", 1.0), ("e", "a", "max", 2.0), ("e", "b", "mean", 3.0)]
    return E.Evidence(
        spark.createDataFrame([("e", "a"), ("e", "b")], "evidence_id string, entity string"),
        spark.createDataFrame(values, "evidence_id string, entity string, statistic string, value double"),
        spark.createDataFrame([("e", "a")], "evidence_id string, anchor string"),
        names=spark.createDataFrame([("e", "a"), ("e", "b"), ("e", "noted")], "evidence_id string, entity string"),
        frame=spark.createDataFrame([("e", "a"), ("e", "b"), ("e", "real")], "evidence_id string, entity string"),
    )


def _responses(spark, rows):
    return spark.createDataFrame([(i, "e", *r) for i, r in enumerate(rows)], _RESPONSE)


def test_claim_reasons(spark):
    claims = [("a", "mean", 1.004), ("a", "mean", 1.01), ("a", "mean", float("nan")), ("b", "max", 2.0), ("c", "mean", 1.0), ("a", "median", 1.0), ("a", "max", None)]
    rows = _responses(spark, [("ok", ["a"], claims, None, None)])
    got = {r.pos: r.reason for r in E.checked_claims(E.claim_items(rows), _evidence(spark)).collect()}
    assert got == {
        0: None, 1: "wrong_value", 2: "wrong_value", 3: "pair_not_in_evidence", 4: "entity_not_in_evidence",
        5: "statistic_not_in_evidence", 6: "not_a_number",
    }


def test_completeness(spark):
    rows = [("ok", ["b"], [], None, None), ("ok", [], [("a", "mean", 1.0)], None, None), ("cannot_determine", [], [], None, None), ("odd", [], [], None, None)]
    got = {r.response_id: (r.malformed, r.committed, r.omitted) for r in E.completeness(_responses(spark, rows), _evidence(spark), ["ok", "cannot_determine"]).collect()}
    assert got == {0: (False, True, True), 1: (False, True, False), 2: (False, False, False), 3: (True, False, False)}


def test_stripped_responses_have_no_violation(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        claims = [(rng.choice("abc"), rng.choice(["mean", "max", "median"]), rng.choice([1.0, 2.0, 3.0, None, float("inf"), 1.003])) for _ in range(rng.randrange(4))]
        rows.append((rng.choice(["ok", "cannot_determine"]), [rng.choice("abcd") for _ in range(rng.randrange(3))], claims, None, None))
    ev = _evidence(spark)
    kept = E.strip_unsound(_responses(spark, rows), ev)
    assert E.unsound_citations(kept, ev).count() == 0
    assert E.checked_claims(E.claim_items(kept), ev).where("reason IS NOT NULL").count() == 0
    assert kept.count() == 60


def test_near_any_equals_brute_force(spark):
    rng = random.Random(9)
    numbers = [("e", rng.choice([0.0, 1.0, rng.uniform(-1, 1), rng.uniform(-50, 50)])) for _ in range(300)] + [("f", 1e9), ("f", float("nan"))]
    probes = [(i, 0, rng.choice("efg"), rng.choice([rng.uniform(-1.1, 1.1), 0.005, -0.005, 1.004999, 1e9 + 0.004, None])) for i in range(400)]
    table = spark.createDataFrame(numbers, "evidence_id string, value double")
    rows = spark.createDataFrame(probes, "response_id long, pos int, evidence_id string, value double")
    got = {r.response_id: r.near for r in E.near_any(rows, table, "near", 0.005, ["response_id"]).collect()}
    for i, _, ev, v in probes:
        assert got[i] == (v is not None and any(e == ev and abs(x - v) <= 0.005 for e, x in numbers)), (ev, v)


def test_record_scores_and_kinds(spark):
    rows = [
        ("ok", ["noted", "a"], [], None, None),
        ("ok", ["ghost", "a"], [("a", "mean", 1.0)], None, None),
        ("ok", ["a / b"], [("a", "mean", 3.0)], None, None),
        ("ok", ["a"], [("a", "mean", 9.0)], None, False),
        ("ok", ["b"], [], None, False),
        ("ok", ["a"], [], "timeout", None),
    ]
    items = E.ScoredItems(_responses(spark, rows), _evidence(spark))
    got = {r.response_id: r for r in E.record_scores(items).collect()}
    assert 5 not in got
    assert got[0].entity_misfiled and not got[0].entity_invented
    assert got[1].entity_invented and not got[1].value
    assert got[2].entity_artifact and not got[2].entity and got[2].value
    assert got[4].omission is False and got[4].omission_undetected is True
    kinds = {r.response_id: r.kind for r in E.unified_scores(items, ["ok"]).collect()}
    assert kinds == {0: "misplaced", 1: "extrinsic", 2: "contradicts", 3: "extrinsic", 4: "omission", 5: ""}


def test_documents(spark):
    docs = spark.createDataFrame([("e", '{"cols": ["x"], "items": [{"f": "y", "v": 0.5}], "n": 7}')], "evidence_id string, text string")
    typed = docs.select("evidence_id", F.from_json("text", "struct<cols:array<string>,items:array<struct<f:string,v:double>>,n:bigint>").alias("doc"))
    assert {r.entity for r in E.document_names(typed).collect()} == {"cols", "items", "f", "v", "n", "x", "y"}
    assert sorted(r.value for r in E.document_numbers(typed).collect()) == [0.5, 7.0]


@pytest.mark.parametrize(
    "text, numbers, names",
    [("r is 0.123 on 12 of 1,200 rows", 0, 0), ("99.12% of total_rows; −0.777", 2, 1), ("cannot_determine", 0, 0), ("|r| <= 12.3 %", 0, 0)],
)
def test_free_text(spark, text, numbers, names):
    known = spark.createDataFrame([("e", -0.123), ("e", 1200.0)], "evidence_id string, value double")
    empty = spark.createDataFrame([("e", "x")], "evidence_id string, entity string")
    texts = spark.createDataFrame([(1, "e", text)], "response_id long, evidence_id string, text string")
    row = S.free_text_grounding(texts, known, empty, ["cannot_determine"]).first()
    assert (row.bad_numbers, row.bad_names) == (numbers, names)


def test_bisection_equals_looking_at_every_number(spark):
    import random

    draw = random.Random(6)
    rows = []
    for i in range(300):
        numbers = sorted({round(draw.uniform(-1, 1), 3) for _ in range(draw.choice([0, 1, 2, 7, 40]))})
        near = draw.choice(numbers) + draw.choice([0.005, -0.005, 0.0051, 0.0]) if numbers else 0.1
        rows.append((i, numbers if i % 10 else None, draw.choice([near, near, None, float("nan"), float("inf"), 5.0, -5.0])))
    df = spark.createDataFrame(rows, "i long, numbers array<double>, value double")
    got = {r.i: r.near for r in df.select("i", E.near_sorted(df.value, df.numbers, 0.005).alias("near")).collect()}
    for i, numbers, value in rows:
        assert got[i] is any(value is not None and abs(x - value) <= 0.005 for x in numbers or []), (numbers, value)


def test_a_hot_evidence_is_split_by_its_weight(spark):
    from tablegauge.operators.skew import weighed_join

    rows = spark.range(2000).selectExpr("id", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 = 8 THEN NULL ELSE concat('k', id) END AS k")
    lookup = spark.createDataFrame([("hot", 1), ("k9", 2), ("unused", 3)], "k string, v int")
    joined = weighed_join(rows, lookup, ["k"], ["id"], share=0.01)
    assert joined.columns == ["k", "id", "v"] and joined.count() == 2000
    assert joined.where("v = 1").count() == 1400 and joined.where("v = 2").count() == 1 and joined.where("v = 3").count() == 0


def test_names_of_documents_with_own_ids_are_not_hashed_again(spark):
    docs = spark.createDataFrame([(1, ("x", 0.0)), (2, ("x", -0.0)), (3, ("b", 1.0))], "evidence_id long, doc struct<b:string,v:double>")
    names = E.document_names(docs)
    assert "HashAggregate" not in names._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, names.collect())) == [(1, "b"), (1, "v"), (1, "x"), (2, "b"), (2, "v"), (2, "x"), (3, "b"), (3, "v")]
    again = docs.unionByName(spark.createDataFrame([(1, ("y", -0.0)), (None, ("n", 2.0)), (None, ("n", 2.0))], docs.schema))
    assert sorted(map(tuple, E.document_names(again).where("evidence_id = 1").collect())) == [(1, "b"), (1, "v"), (1, "x"), (1, "y")]
    assert sorted(r.entity for r in E.document_names(again).where("evidence_id IS NULL").collect()) == ["b", "n", "v"]
    assert sorted(map(tuple, E.document_numbers(again).where("evidence_id IS NOT NULL").collect())) == [(1, 0.0), (2, 0.0), (3, 1.0)]


def test_agreement_joins_responses_and_judges_them_once(spark, monkeypatch):
    from tablegauge.plans import evidence_queries as Q

    first = spark.createDataFrame([(1, True, None), (2, False, True), (3, True, True), (4, True, True)], "response_id long, entity boolean, value boolean")
    second = spark.createDataFrame([(1, False, True), (2, False, False), (3, False, True)], "response_id long, entity boolean, value boolean")
    counts, shown = S.scorer_agreement(first, second, ["entity", "value"], 1)
    assert {tuple(r) for r in counts.collect()} == {("entity", 3, 2), ("value", 2, 1)}
    assert {tuple(r) for r in shown.collect()} == {("entity", 1, True, False), ("value", 2, True, False)}
    calls, judged = [], E.judged
    monkeypatch.setattr(E, "judged", lambda *a: calls.append(a) or judged(*a))
    monkeypatch.setattr(Q, "responses", lambda s, f: _responses(s, [("ok", ["a"], [], None, None)]))
    monkeypatch.setattr(Q, "evidence", lambda s, f: _evidence(s))
    Q._agreement(spark, "")
    assert len(calls) == 1
