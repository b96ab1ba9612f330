"""Aggregates over scored responses: rates, agreement, sweeps, retries, classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.functions.probability import wilson
from tablegauge.operators import evidence as E
from tablegauge.operators.order_stats import running_totals
from tablegauge.operators.skew import salted_join, weighed_join
from tablegauge.session import durable

CELL = ("task", "provider", "model", "arm")
# Fixed values of the sweeps.
TOLERANCES = (0.0005, 0.001, 0.005, 0.01, 0.05)
DEVIATION_EDGES = (0.0, 0.0005, 0.001, 0.005, 0.01, 0.05, float("inf"))
# Numbers and statistic names with a meaning of their own.
PROMPT_LITERALS = (0.999, 0.995, 0.9, 0.95, 0.99, 2.0, 1.0, 0.0, 100.0, 0.005)
COUNTING_UP_TO = 20
CLASS_WORDS = ("class", "balance", "share")
ROW_STATISTICS = ("rows", "row_count", "n_rows", "num_rows", "nrows", "row_total")
COLUMN_STATISTICS = ("cols", "columns", "n_cols", "num_columns", "column_count", "ncols")
DATASET_STATISTICS = ("perfect_match_rate", "row_count")
CLASS_STATISTIC = r"class.*(balance|share|ratio|prop|pct|fraction)|(balance|share).*class"


# ---------------------------------------------------------------- free text


def free_text_grounding(
    narrations: DataFrame, numbers: DataFrame, names: DataFrame, vocabulary: Sequence[str] = ()
) -> DataFrame:
    """Numbers and identifiers of (response_id, evidence_id, text) not in the evidence.

    Prose drops signs and writes a share as a percentage, so a number is searched
    among the magnitudes, their three-digit roundings and their percentages.
    """
    plain = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("−"), F.lit("-")), r"(?<=\d),(?=\d{3}(?!\d))", "")
    texts = narrations.select("response_id", "evidence_id", plain.alias("text"))
    found = texts.select(
        "response_id",
        "evidence_id",
        F.posexplode(F.regexp_extract_all("text", F.lit(r"(?<![\w.])(-?\d+(?:\.\d+)?)(?![\w.])"), F.lit(1))).alias("pos", "raw"),
    )
    value = F.abs(F.col("raw").cast("double"))
    counting = (value == F.floor(value)) & (value <= COUNTING_UP_TO)
    claims = found.withColumn("value", value).where(~F.col("value").isin(*PROMPT_LITERALS) & ~counting)
    size = F.abs("value")
    shown = numbers.select("evidence_id", F.explode(F.array(size, F.round(size, 3), F.round(size * 100, 2))).alias("value"))
    ungrounded = E.near_any(claims, shown, "grounded", E.TOLERANCE, ["response_id", "pos"]).where("NOT grounded")
    idents = texts.select(
        "response_id",
        "evidence_id",
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"), F.lit(1)))).alias("entity"),
    ).where(~F.col("entity").isin(*vocabulary) if vocabulary else F.lit(True))
    known = names.select("evidence_id", "entity").distinct()
    unknown = salted_join(idents, known, ["evidence_id", "entity"], ["response_id"], "left_anti")
    bad_numbers = ungrounded.groupBy("response_id").agg(F.count(F.lit(1)).alias("bad_numbers"))
    bad_names = unknown.groupBy("response_id").agg(F.count(F.lit(1)).alias("bad_names"))
    return (
        narrations.select("response_id")
        .join(bad_numbers, "response_id", "left")
        .join(bad_names, "response_id", "left")
        .select("response_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bad_numbers", "bad_names")])
    )


# ---------------------------------------------------------------- cells and agreement

CHANNELS = ("entity", "value", "omission", "omission_undetected", "abstained")


def cell_rates(scores: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(cell, channel, k, n, rate, low, high) of every channel and the composite."""
    composite = F.col("entity") | F.col("value") | F.coalesce("omission", F.lit(False))
    no_output = F.when(F.col("outcome").isNotNull(), F.col("outcome") == "no_output")
    flags = {"composite": composite, "no_output": no_output, **{c: F.col(c) for c in CHANNELS}}
    counted = scores.groupBy(*cell).agg(
        *[a for c, f in flags.items() for a in (F.count_if(f).alias(f"k_{c}"), F.count(f).alias(f"n_{c}"))]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("channel"), F.col(f"k_{c}").alias("k"), F.col(f"n_{c}").alias("n")) for c in flags]
    )
    long = counted.select(*cell, F.explode(rows).alias("r")).select(*cell, "r.*").where("n > 0")
    low, high = wilson(F.col("k"), F.col("n"))
    return long.select(*cell, "channel", "k", "n", C.ratio(F.col("k"), F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def cell_costs(responses: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Responses, excluded errors, calls per response and catches per cell."""
    valid = F.col("error").isNull()
    return responses.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~valid).alias("errors"),
        F.avg(F.when(valid, F.col("provider_calls"))).alias("calls_per_response"),
        F.count_if(valid & (F.col("rejections") > 0)).alias("responses_with_catches"),
        F.coalesce(F.sum(F.when(valid, F.col("rejections"))), F.lit(0)).alias("catches"),
    )


def scorer_agreement(first: DataFrame, second: DataFrame, channels: Sequence[str], examples: int = 5) -> tuple[DataFrame, DataFrame]:
    """(channel, compared, disagreements) of two score tables and the first examples."""

    def wide(df: DataFrame, name: str) -> DataFrame:
        return df.select("response_id", F.struct(*channels).alias(name))

    # a response is one row of the join, its channels are told apart afterwards
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"a.{c}").alias("a"), F.col(f"b.{c}").alias("b")) for c in channels])
    both = wide(first, "a").join(wide(second, "b"), "response_id").select("response_id", F.inline(cells)).where("a IS NOT NULL AND b IS NOT NULL")
    counts = both.groupBy("channel").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(F.col("a") != F.col("b")).alias("disagreements")
    )
    place = F.row_number().over(Window.partitionBy("channel").orderBy("response_id"))
    shown = both.where("a <> b").withColumn("place", place).where(F.col("place") <= examples)
    return counts, shown.select("channel", "response_id", "a", "b")


# ---------------------------------------------------------------- sweeps


def tolerance_sweep(
    claims: DataFrame, responses: DataFrame, group: Sequence[str] = ("arm",), tolerances: Sequence[float] = TOLERANCES
) -> DataFrame:
    """Responses with some deviation above each tolerance, per group."""
    worst = claims.groupBy("response_id").agg(F.max("deviation").alias("worst"))
    joined = responses.select("response_id", *group).join(worst, "response_id", "left")
    counted = joined.groupBy(*group).agg(
        F.count(F.lit(1)).alias("responses"),
        *[F.count_if(F.col("worst") > float(t)).alias(f"v{i}") for i, t in enumerate(tolerances)],
    )
    points = F.array(
        *[F.struct(F.lit(float(t)).alias("tolerance"), F.col(f"v{i}").alias("violating")) for i, t in enumerate(tolerances)]
    )
    return counted.select(*group, "responses", F.explode(points).alias("p")).select(*group, "responses", "p.*")


def deviation_histogram(claims: DataFrame, responses: DataFrame, group: Sequence[str] = ("arm",)) -> DataFrame:
    """Checkable claims per deviation bucket (low, high], zero in the first one."""
    joined = claims.where("deviation IS NOT NULL").join(responses.select("response_id", *group), "response_id")
    d, edges = F.col("deviation"), DEVIATION_EDGES
    bucket = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        bucket = F.when(d <= edges[i + 1], i).otherwise(bucket)
    return joined.groupBy(*group, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(d == 0).alias("exact")
    )


def relative_deviation(claims: DataFrame, responses: DataFrame, group: Sequence[str] = ("arm",)) -> DataFrame:
    """Largest and upper-median relative deviation of the inexact claims."""
    inexact = claims.where((F.col("deviation") > 0) & (F.abs("measured") > 0))
    share = (F.col("deviation") / F.abs("measured")).alias("value")
    counts = (
        inexact.select("response_id", share)
        .join(responses.select("response_id", *group), "response_id")
        .groupBy(*group, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = running_totals(counts, list(group), "value", ["n"])
    middle = F.floor(F.col("total_n") / 2)
    covers = (middle >= F.col("before_n")) & (middle < F.col("before_n") + F.col("n"))
    return totals.groupBy(*group).agg(
        F.max("value").alias("max_relative"), F.max(F.when(covers, F.col("value"))).alias("median_relative")
    )


def task_pool(statistic: Column) -> Column:
    """class, rows or cols: which task-level numbers a statistic name may cite."""
    name = F.lower(statistic)
    return (
        F.when(name.rlike("|".join(CLASS_WORDS)), "class")
        .when(name.isin(*ROW_STATISTICS), "rows")
        .when(name.isin(*COLUMN_STATISTICS), "cols")
    )


def near_pool(claims: DataFrame, pools: DataFrame, name: str, tolerance: float = E.TOLERANCE) -> DataFrame:
    """Add ``name``: the value lies near a number of the claim's pool.

    ``pools(evidence_id, pool, value)``; the pool joins the evidence key.
    """
    keyed = claims.withColumn("_evidence", F.col("evidence_id")).withColumn(
        "evidence_id", F.concat_ws("\u0001", F.col("evidence_id").cast("string"), "pool")
    )
    numbers = pools.select(F.concat_ws("\u0001", F.col("evidence_id").cast("string"), "pool").alias("evidence_id"), "value")
    found = E.near_any(keyed, numbers, name, tolerance, ["response_id", "pos"])
    return found.withColumn("evidence_id", F.col("_evidence")).drop("_evidence")


def policy_sweep(responses: DataFrame, evidence: E.Evidence, pools: DataFrame, verdicts: Sequence[str]) -> DataFrame:
    """(policy, response_id, violation) as reported, strict and lenient.

    Strict drops dataset-level statistics from the evidence. Lenient admits claims
    the evidence carries at task level: class shares, row and column counts.
    """
    reported_items = E.ScoredItems(responses, evidence)
    reported = durable(E.unified_scores(reported_items, verdicts))
    strict = E.unified_scores_without(reported_items, verdicts, DATASET_STATISTICS)
    uncarried = reported_items.claims.where(
        F.col("reason").isin("statistic_not_in_evidence", "pair_not_in_evidence")
    ).withColumn("pool", task_pool(F.col("statistic")))
    left = near_pool(uncarried, pools, "admitted").where(F.col("pool").isNull() | ~F.col("admitted"))
    still = left.select("response_id").distinct().withColumn("still", F.lit(True))
    hard = (F.col("c1_cited") > 0) | (F.col("c1_claim") > 0) | (F.col("c2_wrong") > 0) | F.col("c3")
    lenient = reported.join(still, "response_id", "left").select(
        F.lit("lenient").alias("policy"), "response_id", (hard | F.coalesce("still", F.lit(False))).alias("violation")
    )
    return (
        reported.select(F.lit("reported").alias("policy"), "response_id", "violation")
        .unionByName(strict.select(F.lit("strict").alias("policy"), "response_id", "violation"))
        .unionByName(lenient)
    )


# ---------------------------------------------------------------- deletion and retries


def deletion_cost(items: E.ScoredItems, group: Sequence[str] = ()) -> DataFrame:
    """What deleting unsound parts costs the violating responses."""
    cited = items.citations.groupBy("response_id").agg(
        F.count(F.lit(1)).alias("cited"), F.count_if("in_domain").alias("cited_kept")
    )
    sound = F.col("reason").isNull()
    claims = items.claims.groupBy("response_id").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(sound).alias("claims_kept"),
        F.count_if(~sound & F.col("number_known")).alias("dropped_correct_numbers"),
    )
    anchors = items.evidence.anchors.select("evidence_id", "anchor")
    named = salted_join(
        items.citations.select("response_id", "evidence_id", "entity", F.col("in_domain").alias("kept")).unionByName(
            items.claims.select("response_id", "evidence_id", "entity", sound.alias("kept"))
        ),
        anchors, ["evidence_id"], ["response_id", "entity"], "inner",
    )
    is_anchor = F.col("entity") == F.col("anchor")
    anchored = named.groupBy("response_id").agg(
        F.bool_or(is_anchor).alias("before"), F.bool_or(is_anchor & F.col("kept")).alias("after")
    )
    counts = ("cited", "cited_kept", "claims", "claims_kept", "dropped_correct_numbers")
    rows = items.responses.select("response_id", *group)
    for part in (cited, claims, anchored):
        rows = rows.join(part, "response_id", "left")
    rows = rows.fillna(0, list(counts)).fillna(False, ["before", "after"])
    bad = (F.col("cited_kept") < F.col("cited")) | (F.col("claims_kept") < F.col("claims"))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(bad, F.col(c))), F.lit(0)).alias(c)

    # the per-response columns are read under their own names before the sums shadow them
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(bad).alias("violating"),
        *[total(c) for c in counts],
        F.count_if(bad & (F.col("claims") > 0) & (F.col("claims_kept") == 0)).alias("left_with_no_claim"),
        F.count_if(bad & (F.col("cited") > 0) & (F.col("cited_kept") == 0)).alias("left_with_no_column"),
        F.count_if(bad & F.col("before")).alias("anchor_before"),
        F.count_if(bad & F.col("before") & ~F.col("after")).alias("anchor_lost"),
    )


def attempts_of(responses: DataFrame) -> DataFrame:
    """Attempts as responses of their own: response_id is a struct (id, attempt)."""
    rows = responses.select("response_id", "evidence_id", F.size("attempts").alias("total"), F.posexplode("attempts").alias("attempt", "a"))
    return rows.select(
        F.struct(F.col("response_id").alias("id"), "attempt").alias("response_id"), "evidence_id", "total",
        F.col("a.verdict").alias("verdict"), F.col("a.cited").alias("cited"), F.col("a.claims").alias("claims"),
    )


def attempt_problems(attempts: DataFrame, evidence: E.Evidence, verdicts: Sequence[str]) -> DataFrame:
    """(response_id, item, finding) of everything the evidence does not support."""
    verdict = attempts.where(~F.coalesce("verdict", F.lit("")).isin(*verdicts)).select(
        "response_id", F.lit("verdict").alias("item"), F.lit("no admissible verdict").alias("finding")
    )
    cited = E.unsound_citations(attempts, evidence).select(
        "response_id", F.col("entity").alias("item"), F.lit("column not listed").alias("finding")
    )
    finding = (
        F.when(F.col("reason") == "entity_not_in_evidence", "column not listed")
        .when(F.col("reason").isin("statistic_not_in_evidence", "pair_not_in_evidence"), "pair not recorded")
        .when(F.col("reason") == "not_a_number", "value is not a number")
        .otherwise("wrong number")
    )
    claims = E.checked_claims(E.claim_items(attempts), evidence).where("reason IS NOT NULL").select(
        "response_id", F.concat_ws(".", "entity", "statistic").alias("item"), finding.alias("finding")
    )
    return verdict.unionByName(cited).unionByName(claims)


def rejudged(responses: DataFrame, evidence: E.Evidence, verdicts: Sequence[str]) -> DataFrame:
    """Every problem of a rejected attempt and what the next attempt did with it."""
    attempts = durable(attempts_of(responses))
    problems = durable(attempt_problems(attempts, evidence, verdicts).distinct())
    following = attempts.select(
        F.struct(F.col("response_id.id").alias("id"), (F.col("response_id.attempt") - 1).alias("attempt")).alias("response_id"),
        F.col("verdict").alias("next_verdict"), F.col("cited").alias("next_cited"), F.col("claims").alias("next_claims"),
        (F.col("total") - 1).alias("last"),
    )
    values = E.checked_claims(E.claim_items(attempts), evidence)
    good = values.where("reason IS NULL").select(
        F.struct(F.col("response_id.id").alias("id"), (F.col("response_id.attempt") - 1).alias("attempt")).alias("response_id"),
        F.concat_ws(".", "entity", "statistic").alias("item"), F.lit(True).alias("corrected"),
    ).distinct()
    unclean = problems.select("response_id").distinct().withColumn("unclean", F.lit(True))
    rows = problems.join(following, "response_id").join(good, ["response_id", "item"], "left")
    named = F.exists(
        F.coalesce("next_claims", F.array().cast("array<struct<column:string,statistic:string,value:double>>")),
        lambda c: F.concat_ws(".", c["column"], c["statistic"]) == F.col("item"),
    )
    as_column = F.col("finding") == "column not listed"
    fate = (
        F.when((F.col("item") == "verdict") & F.coalesce("next_verdict", F.lit("")).isin(*verdicts), "verdict supplied")
        .when(F.col("item") == "verdict", "still missing")
        .when(as_column & F.contains("item", F.lit(".")), F.when(named, "kept").otherwise("dropped"))
        .when(as_column, F.when(F.array_contains("next_cited", F.col("item")), "kept").otherwise("dropped"))
        .when(~named, "dropped")
        .when(F.col("corrected"), "corrected")
        .otherwise("kept")
    )
    last = rows.withColumn("fate", fate).withColumn(
        "last_id", F.struct(F.col("response_id.id").alias("id"), F.col("last").cast("int").alias("attempt"))
    )
    ends = unclean.withColumnRenamed("response_id", "last_id")
    return last.join(ends, "last_id", "left").select(
        F.col("response_id.id").alias("response_id"), F.col("response_id.attempt").alias("attempt"),
        "item", "finding", "fate", F.col("unclean").isNull().alias("final_clean"),
    )


def number_owners(claims: DataFrame, evidence: E.Evidence) -> DataFrame:
    """How many other pairs own a wrong number, and which one if it is one.

    An evidence's numbers stand in order with the running count of their pairs, so the owners of a number are the
    difference of two counts, found by bisection at both ends of the tolerance.
    """
    tau = evidence.tolerance
    wrong = claims.where("reason = 'wrong_value'").select("evidence_id", "entity", "statistic", "value").distinct()
    each = evidence.values.groupBy("evidence_id", F.col("value").cast("double").alias("owned")).agg(
        F.count(F.lit(1)).alias("pairs"), F.min(F.concat_ws(".", "entity", "statistic")).alias("first")
    )
    through = Window.partitionBy("evidence_id").orderBy("owned").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = each.withColumn("through", F.sum("pairs").over(through)).groupBy("evidence_id").agg(
        F.array_sort(F.collect_list(F.struct("owned", "through", "first"))).alias("owned")
    )
    rows = weighed_join(wrong, listed, ["evidence_id"], ["entity", "statistic", "value"])
    numbers, value = F.col("owned")["owned"], F.col("value")
    low = E.first_not_below(numbers, lambda x: x - value < -tau)
    high = E.first_not_below(numbers, lambda x: x - value <= tau)

    def counted(upto: Column) -> Column:
        return F.coalesce(F.get("owned", upto - 1)["through"], F.lit(0))

    some = E.finite(value) & F.col("owned").isNotNull()
    placed = rows.select("*", F.when(some, low).alias("low"), F.when(some, high).alias("high"))
    found = placed.select(
        "evidence_id", "entity", "statistic", "value", F.when(some, counted(F.col("high")) - counted(F.col("low"))).alias("owners"),
        F.get("owned", F.col("low"))["first"].alias("first"),
    )
    return found.select(
        "evidence_id", "entity", "statistic", "value",
        F.coalesce("owners", F.lit(0)).alias("owners"), F.when(F.col("owners") == 1, F.col("first")).alias("owner"),
    )


def retry_content(responses: DataFrame, evidence: E.Evidence) -> DataFrame:
    """Correct claims of the first and the last attempt, and what changed."""
    retried = responses.where(F.size("attempts") >= 2)
    attempts = attempts_of(retried).where("response_id.attempt = 0 OR response_id.attempt = total - 1")
    good = E.checked_claims(E.claim_items(attempts), evidence).where("reason IS NULL")
    last = attempts.select("response_id", (F.col("response_id.attempt") > 0).alias("final"))
    pairs = good.select("response_id", F.concat_ws("\u0001", "entity", "statistic").alias("pair")).distinct()
    # the set holds the claims of one response
    sets = pairs.join(last, "response_id").groupBy(F.col("response_id.id").alias("response_id")).agg(
        F.collect_set(F.when(~F.col("final"), F.col("pair"))).alias("first"),
        F.collect_set(F.when(F.col("final"), F.col("pair"))).alias("final"),
    )
    rows = retried.select(
        "response_id",
        F.size(F.get("attempts", F.lit(0))["claims"]).alias("claims_first"),
        F.size(F.element_at("attempts", -1)["claims"]).alias("claims_final"),
    ).join(sets, "response_id", "left")
    none = F.array().cast("array<string>")
    first, final = F.coalesce("first", none), F.coalesce("final", none)
    return rows.select(
        "response_id", "claims_first", "claims_final",
        F.size(first).alias("correct_first"), F.size(final).alias("correct_final"),
        F.size(F.array_except(first, final)).alias("correct_lost"),
        F.size(F.array_except(final, first)).alias("correct_gained"),
    )


def sibling_confusion(claims: DataFrame, evidence: E.Evidence, siblings: DataFrame) -> DataFrame:
    """Wrong numbers that equal the value of the paired column.

    ``siblings(entity, sibling)`` names the pair of a column.
    """
    wrong = claims.where("reason = 'wrong_value'")
    other = salted_join(
        evidence.values, siblings, ["entity"], ["evidence_id", "statistic"], "inner"
    ).select("evidence_id", F.col("sibling").alias("entity"), "statistic", F.col("value").alias("sibling_value"))
    joined = salted_join(wrong, other, ["evidence_id", "entity", "statistic"], ["response_id", "pos"])
    hit = F.abs(F.col("value") - F.col("sibling_value")) <= evidence.tolerance
    return joined.groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("wrong_claims"), F.count_if(hit).alias("from_sibling")
    )


# ---------------------------------------------------------------- tables of results


def delivery_table(unified: DataFrame, group: Sequence[str] = ("arm",)) -> DataFrame:
    """What users of each arm received."""
    return unified.groupBy(*group).agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if("violation").alias("violating"),
        F.avg("claims_made").alias("claims_per_response"),
        F.avg("claims_correct").alias("correct_per_response"),
        F.avg(F.col("anchor_value").cast("int")).alias("anchor_share"),
        F.count_if(F.col("claims_made") > 0).alias("with_claim"),
        F.count_if(F.col("verdict_admissible") & ~F.col("committed")).alias("abstained"),
        F.count_if(~F.col("verdict_admissible") & ~F.col("committed")).alias("no_verdict"),
        F.count_if(F.col("rejections") > 0).alias("retried"),
    )


KINDS = ("extrinsic", "contradicts", "misplaced", "omission")


def group_rollup(unified: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Violations by kind per group; each response counts in its first group.

    ``members`` is how many groups claim the response, so a check can ask for 1.
    """
    label = F.coalesce(*[F.when(test, F.lit(name)) for name, test in groups.items()])
    members = sum((F.coalesce(t, F.lit(False)).cast("int") for t in groups.values()), F.lit(0))
    rows = unified.withColumn("group", label).withColumn("members", members)
    return rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if("violation").alias("violating"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS],
        F.count_if("names_invented").alias("invented"),
        F.count_if("names_unlisted").alias("unlisted"),
        F.count_if((F.col("c2_wrong_absent") > 0) | (F.col("c2_unsupported") > 0)).alias("number_absent"),
        F.max("members").alias("max_members"),
        (F.count_if("violation") == F.count_if(F.col("kind") != "")).alias("kinds_partition"),
    )


def name_origin() -> Column:
    """Where an out-of-evidence name comes from."""
    return (
        F.when(F.col("in_names"), "misfiled").when(F.col("in_frame"), "unlisted").otherwise("invented")
    )


def name_origins(names: DataFrame, responses: DataFrame, group: Sequence[str] = ("arm",)) -> DataFrame:
    """Responses per origin of their out-of-evidence names."""
    kinds = names.where("outside").select("response_id", name_origin().alias("origin")).distinct()
    return kinds.join(responses.select("response_id", *group), "response_id").groupBy(*group, "origin").agg(
        F.count(F.lit(1)).alias("responses")
    )


def top_outside_names(names: DataFrame, responses: DataFrame, k: int = 5, group: Sequence[str] = ("arm",)) -> DataFrame:
    """The k out-of-evidence names most responses use, ties by name."""
    uses = names.where("outside").select("response_id", "entity").distinct()
    counts = uses.join(responses.select("response_id", *group), "response_id").groupBy(*group, "entity").agg(
        F.count(F.lit(1)).alias("responses")
    )
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("responses"), "entity"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def claim_class(slot: Column | None = None) -> Column:
    """wrong number, real but misplaced, or not in the evidence; NULL when sound."""
    number = F.col("value").isNotNull()
    carried = F.col("measured").isNotNull()
    far = F.coalesce(F.col("deviation") > E.TOLERANCE, F.lit(True))
    rule = F.when(~number, None).when(carried, F.when(far, "wrong number"))
    if slot is not None:
        rule = rule.when(slot, F.when(~F.col("share_known"), "wrong class share"))
    return rule.when(F.col("number_known"), "real, misplaced").otherwise("not in evidence")


def claim_classes(items: E.ScoredItems, group: Sequence[str] = ("arm",)) -> DataFrame:
    """Claims and responses per class of unsound claim, per group."""
    classed = items.claims.withColumn("class", claim_class()).where("class IS NOT NULL")
    per_response = classed.groupBy("response_id", "class").agg(F.count(F.lit(1)).alias("n"))
    return per_response.join(items.responses.select("response_id", *group), "response_id").groupBy(*group, "class").agg(
        F.sum("n").alias("claims"), F.count(F.lit(1)).alias("responses")
    )


def task_level_slot(
    items: E.ScoredItems, targets: DataFrame, shares: DataFrame, group: Sequence[str] = ("arm",)
) -> DataFrame:
    """Violations before and after class shares get a slot of their own.

    ``targets(evidence_id, target)`` and ``shares(evidence_id, value)``.
    """
    with_target = salted_join(items.claims, targets, ["evidence_id"], ["response_id", "pos"])
    spread = ["response_id", "pos"]
    claims = E.near_any(with_target, shares, "share_known", items.evidence.tolerance, spread)
    slot = (F.col("entity") == F.col("target")) & F.lower("statistic").rlike(CLASS_STATISTIC)
    per_claim = claims.withColumn("class", claim_class(F.coalesce(slot, F.lit(False))))
    after_claims = per_claim.groupBy("response_id").agg(
        F.bool_or(F.col("class").isNotNull()).alias("after"), F.bool_or(F.col("reason").isNotNull()).alias("before")
    )
    cited = items.citations.groupBy("response_id").agg(F.bool_or(~F.col("in_domain")).alias("cited_bad"))
    rows = items.responses.select("response_id", *group)
    rows = rows.join(after_claims, "response_id", "left").join(cited, "response_id", "left")
    rows = rows.fillna(False, ["after", "before", "cited_bad"])
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(F.col("before") | F.col("cited_bad")).alias("violating_before"),
        F.count_if(F.col("after") | F.col("cited_bad")).alias("violating_with_slot"),
    )


def run_inventory(records: DataFrame) -> DataFrame:
    """One row per file: dates, commits, arms, valid records, calls and retries."""

    def listed(value: Column) -> Column:
        # the set holds the distinct settings of one file
        return F.array_join(F.array_sort(F.collect_set(F.nullif(value, F.lit("")))), "|")

    valid = F.col("error").isNull()
    return records.groupBy("file").agg(
        listed(F.substring(F.col("started_at"), 1, 10)).alias("dates"),
        listed(F.col("commit")).alias("commits"),
        listed(F.col("arm")).alias("arms"),
        F.count(F.lit(1)).alias("records"),
        F.count_if(~valid).alias("errors"),
        F.count_if(valid).alias("valid"),
        F.sum(F.when(valid, F.coalesce("provider_calls", F.lit(1))).otherwise(0)).alias("calls"),
        F.count_if(valid & (F.coalesce("rejections", F.lit(0)) > 0)).alias("retried"),
    )


def domain_coverage(static_names: DataFrame, evidence: E.Evidence) -> DataFrame:
    """How a fixed name list covers each evidence: overlap, share and both gaps.

    Both lists of (evidence_id, entity) are name sets of one evidence.
    """
    s = static_names.select("evidence_id", "entity").distinct().withColumn("in_static", F.lit(True))
    e = evidence.entities.select("evidence_id", "entity").distinct().withColumn("in_evidence", F.lit(True))
    both = s.join(e, ["evidence_id", "entity"], "full").fillna(False, ["in_static", "in_evidence"])
    both = both.join(evidence.anchors, "evidence_id", "left")
    in_both = F.col("in_static") & F.col("in_evidence")

    def gap(test: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("entity")))), ",")

    counted = both.groupBy("evidence_id").agg(
        F.count_if("in_static").alias("n_static"),
        F.count_if("in_evidence").alias("n_evidence"),
        F.count_if(in_both).alias("overlap"),
        F.bool_or(F.col("in_static") & (F.col("entity") == F.col("anchor"))).alias("anchor_in_static"),
        gap(F.col("in_evidence") & ~F.col("in_static")).alias("not_in_static"),
        gap(F.col("in_static") & ~F.col("in_evidence")).alias("not_in_evidence"),
    )
    return counted.withColumn("coverage", C.ratio(F.col("overlap"), F.col("n_evidence")))
