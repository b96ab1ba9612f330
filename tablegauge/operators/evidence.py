"""Verification of written claims against computed evidence tables.

Evidence is relational: admissible entities, measured (entity, statistic) values,
one anchor per evidence, all names and all numbers it carries. A response cites
entities and makes (entity, statistic, value) claims. An evidence is one document, so
all a check needs of it is one row: a map of its names with their facts and its numbers
in order. Responses meet that row in one join, hot evidence split by its weight, and
everything else is decided inside the response.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.operators.skew import salted_join, weighed_join
from tablegauge.session import durable

# Fixed values of the claim contract.
TOLERANCE = 0.005
ABSTENTION = "cannot_determine"
PROFILE_STATISTICS = (
    "cardinality", "iqr_count", "max", "mean", "min", "missing_count", "missing_pct", "q25", "q50",
    "q75", "std", "z_score_count", "zero_ratio",
)
# Spellings of the correlation statistic.
CORRELATION_NAMES = (
    "correlation", "corr", "abs_corr", "pearson", "spearman", "pearson_correlation",
    "spearman_correlation", "pearson_correlation_with_target", "spearman_correlation_with_target",
    "correlation_with_target", "max_abs_correlation",
)
EMPTY_NAMES = ("", "None", "null")
WRONG = ("wrong_value", "not_a_number")
UNCARRIED = ("statistic_not_in_evidence", "pair_not_in_evidence")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & ~F.abs(value).isin(float("inf"))


def statistic_name(raw: Column) -> Column:
    """Lower case with underscores, correlation spellings folded into one."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "[- ]", "_")
    return F.when(name.isin(*CORRELATION_NAMES), "correlation").otherwise(name)


@dataclass
class Evidence:
    """Bound evidence, keyed by evidence_id.

    entities(entity), values(entity, statistic, value), anchors(anchor),
    names(entity): all names, numbers(value): all numbers, frame(entity): columns
    of the frame the evidence was computed from.
    """

    entities: DataFrame
    values: DataFrame
    anchors: DataFrame
    names: DataFrame | None = None
    numbers: DataFrame | None = None
    frame: DataFrame | None = None
    tolerance: float = TOLERANCE

    @cached_property
    def all_numbers(self) -> DataFrame:
        measured = self.values.select("evidence_id", "value")
        return measured if self.numbers is None else measured.unionByName(self.numbers.select("evidence_id", "value"))

    @cached_property
    def facts(self) -> DataFrame:
        """One row per evidence: known (name -> flags and statistics), statistics, sorted numbers, anchor.

        Of several values of one pair the smallest counts.
        """
        flags = ("in_domain", "in_names", "in_frame")
        pair = "struct<statistic:string,measured:double>"

        def marked(df: DataFrame, flag: str | None) -> DataFrame:
            stat = F.struct("statistic", F.col("value").cast("double").alias("measured")) if flag is None else F.lit(None).cast(pair)
            return df.select("evidence_id", "entity", *[F.lit(f == flag).alias(f) for f in flags], stat.alias("stat"))

        sources = [(self.entities, "in_domain"), (self.names, "in_names"), (self.frame, "in_frame"), (self.values, None)]
        pieces = [marked(df, flag) for df, flag in sources if df is not None]
        union = pieces[0]
        for piece in pieces[1:]:
            union = union.unionByName(piece)
        each = union.where("entity IS NOT NULL").groupBy("evidence_id", "entity").agg(
            *[F.bool_or(f).alias(f) for f in flags], F.array_sort(F.collect_set("stat")).alias("stats")
        )
        known = each.groupBy("evidence_id").agg(
            F.map_from_entries(F.collect_list(F.struct("entity", F.struct(*flags, "stats")))).alias("known"),
            F.array_distinct(F.flatten(F.collect_list(F.col("stats.statistic")))).alias("statistics"),
        )
        numbers = self.all_numbers.where(finite(F.col("value"))).groupBy("evidence_id").agg(
            F.array_sort(F.collect_set(F.col("value").cast("double"))).alias("numbers")
        )
        anchors = self.anchors.select("evidence_id", "anchor")
        return known.join(numbers, "evidence_id", "full").join(anchors, "evidence_id", "full")


def bind_leakage(correlations: DataFrame, candidates: DataFrame) -> Evidence:
    """From correlations(evidence_id, feature, correlation) and candidates(evidence_id, position, feature)."""
    features = correlations.select("evidence_id", F.col("feature").alias("entity"))
    named = candidates.select("evidence_id", F.col("feature").alias("entity"))
    return Evidence(
        entities=features.unionByName(named).where("entity IS NOT NULL").distinct(),
        values=correlations.where("correlation IS NOT NULL").select(
            "evidence_id",
            F.col("feature").alias("entity"),
            F.lit("correlation").alias("statistic"),
            F.col("correlation").alias("value"),
        ),
        anchors=candidates.groupBy("evidence_id").agg(F.min_by("feature", "position").alias("anchor")),
    )


def bind_profile(profiled: DataFrame) -> Evidence:
    """From narrowed profile rows (evidence_id, ordinal, name, statistics...)."""
    present = [s for s in PROFILE_STATISTICS if s in profiled.columns]
    wide = profiled.select("evidence_id", "name", *[F.col(s).cast("double").alias(s) for s in present])
    long = wide.unpivot(["evidence_id", "name"], present, "statistic", "value")
    worst = F.struct("missing_pct", -F.col("ordinal"))
    return Evidence(
        entities=profiled.select("evidence_id", F.col("name").alias("entity")).distinct(),
        values=long.where("value IS NOT NULL").withColumnRenamed("name", "entity"),
        anchors=profiled.where("missing_pct IS NOT NULL")
        .groupBy("evidence_id")
        .agg(F.max_by("name", worst).alias("anchor")),
    )


# ---------------------------------------------------------------- names and numbers of documents


def _leaves(value: Column, dtype: T.DataType, wanted) -> list[Column]:
    """Arrays of the leaf values of one type inside a nested column."""
    if isinstance(dtype, T.StructType):
        return [a for f in dtype.fields for a in _leaves(value[f.name], f.dataType, wanted)]
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if isinstance(inner, (T.StructType, T.ArrayType)):
            count = len(_leaves(F.lit(None).cast(inner), inner, wanted))

            def of_each(i: int) -> Column:
                return F.flatten(F.transform(value, lambda x: _leaves(x, inner, wanted)[i]))

            return [of_each(i) for i in range(count)]
        return [value] if wanted(inner) else []
    return [F.array(value)] if wanted(dtype) else []


def _keys(value: Column, dtype: T.DataType) -> list[Column]:
    if isinstance(dtype, T.StructType):
        own = [F.when(value.isNotNull(), F.array(*[F.lit(f.name) for f in dtype.fields]))]
        return own + [k for f in dtype.fields for k in _keys(value[f.name], f.dataType)]
    if isinstance(dtype, T.ArrayType):
        return _keys(F.get(value, F.lit(0)), dtype.elementType)
    return []


def _each_once(docs: DataFrame, leaves: Column, name: str) -> DataFrame:
    """(evidence_id, name) of the different leaves of every document.

    The leaves of one document are told apart in its row; only documents that share an id are compared with others.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("evidence_id").alias("_id")).repartition(partitions, "_id").groupBy("_id")
    shared = durable(ids.agg(F.count(F.lit(1)).alias("_docs")).where("_docs > 1").select("_id"))
    rows = docs.select("evidence_id", F.explode(F.array_distinct(leaves)).alias(name)).where(F.col(name).isNotNull())
    if shared.isEmpty():
        return rows
    same = F.col("evidence_id").eqNullSafe(F.col("_id"))
    return rows.join(shared, same, "left_anti").unionByName(rows.join(shared, same, "left_semi").distinct())


def document_names(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Every key and text value of typed evidence documents (evidence_id, doc)."""
    dtype = docs.schema[column].dataType
    texts = _leaves(F.col(column), dtype, lambda t: isinstance(t, T.StringType))
    arrays = [F.coalesce(a, F.array().cast("array<string>")) for a in _keys(F.col(column), dtype) + texts]
    return _each_once(docs, F.concat(*arrays), "entity")


def document_numbers(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Every number of typed evidence documents."""
    dtype = docs.schema[column].dataType
    numbers = _leaves(F.col(column), dtype, lambda t: isinstance(t, T.NumericType))
    arrays = [F.coalesce(a.cast("array<double>"), F.array().cast("array<double>")) for a in numbers]
    # adding zero makes -0.0 and 0.0 one number
    return _each_once(docs, F.transform(F.concat(*arrays), lambda x: x + F.lit(0.0)), "value")


# ---------------------------------------------------------------- range lookups


def _bucket(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width))


def near_any(rows: DataFrame, numbers: DataFrame, name: str, tolerance: float, spread: Sequence[str]) -> DataFrame:
    """Add ``name``: some number of the same evidence lies within the tolerance.

    Buckets are as wide as the tolerance, so only the nearest number of the bucket
    itself and of its two neighbours can decide. Those few are folded into one row
    per bucket, and a claim meets one row, however many numbers a bucket holds.
    """
    finite = ~(F.isnan("value") | F.abs("value").isin(float("inf")))
    per_bucket = (
        numbers.where(F.col("value").isNotNull() & finite)
        .withColumn("_b", _bucket(F.col("value"), tolerance))
        .groupBy("evidence_id", "_b")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
    )
    # From the bucket below its largest number, from the one above its smallest.
    reach = F.array(
        F.struct((F.col("_b") + 1).alias("b"), F.array("high").alias("xs")),
        F.struct(F.col("_b").alias("b"), F.array("low", "high").alias("xs")),
        F.struct((F.col("_b") - 1).alias("b"), F.array("low").alias("xs")),
    )
    lookup = (
        per_bucket.select("evidence_id", F.explode(reach).alias("r"))
        .groupBy("evidence_id", F.col("r.b").alias("_b"))
        .agg(F.flatten(F.collect_list("r.xs")).alias("_near"))
    )
    known = F.col("value").isNotNull() & finite
    keyed = rows.withColumn("_b", F.when(known, _bucket(F.col("value"), tolerance)))
    joined = salted_join(keyed, lookup, ["evidence_id", "_b"], spread, "left")
    hit = F.exists("_near", lambda x: F.abs(x - F.col("value")) <= tolerance)
    return joined.select(*rows.columns, (known & F.coalesce(hit, F.lit(False))).alias(name))


# ---------------------------------------------------------------- items


def cited_items(responses: DataFrame, column: str = "cited") -> DataFrame:
    return responses.select("response_id", "evidence_id", F.posexplode(column).alias("pos", "entity")).withColumn(
        "entity", F.coalesce("entity", F.lit("None"))
    )


def claim_items(responses: DataFrame, column: str = "claims") -> DataFrame:
    """Exploded claims; a value that is no number is NULL."""
    items = responses.select("response_id", "evidence_id", F.posexplode(column).alias("pos", "claim"))
    return items.select(
        "response_id", "evidence_id", "pos",
        F.coalesce("claim.column", F.lit("None")).alias("entity"),
        F.coalesce("claim.statistic", F.lit("")).alias("statistic"),
        F.col("claim.value").cast("double").alias("value"),
    )


def first_not_below(numbers: Column, below) -> Column:
    """The index of the first of the sorted ``numbers`` that is not ``below``, by bisection; their count if all are."""

    def halved(range_: Column, _: Column) -> Column:
        low, high = range_["low"], range_["high"]
        middle = F.floor((low + high) / 2).cast("int")
        lower = (low < high) & below(F.get(numbers, middle))
        return F.struct(
            F.when(lower, middle + 1).otherwise(low).alias("low"),
            F.when((low < high) & ~lower, middle).otherwise(high).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(numbers) + 1.0)).cast("int") + 1)
    start = F.struct(F.lit(0).alias("low"), F.size(numbers).alias("high"))
    return F.aggregate(steps, start, halved)["low"]


def near_sorted(value: Column, numbers: Column, tolerance: float) -> Column:
    """Whether one of the sorted ``numbers`` lies within the tolerance."""
    found = F.get(numbers, first_not_below(numbers, lambda x: x - value < -tolerance))
    usable = finite(value) & numbers.isNotNull()
    return F.when(usable, F.coalesce(found - value <= tolerance, F.lit(False))).otherwise(F.lit(False))


def _in_domain(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col("known"), name)["in_domain"], F.lit(False))


def _own_flags(fact: Column) -> list[Column]:
    return [F.coalesce(fact[f], F.lit(False)).alias(f) for f in ("in_domain", "in_names", "in_frame")]


def _artifact(entity: Column, in_domain: Column) -> Column:
    """A reading fault: an empty name, or a text made of several admissible names."""
    parts = F.filter(F.transform(F.split(entity, "[/,]"), lambda p: F.trim(p)), lambda p: p != "")
    compound = entity.rlike("[/,]") & (F.size(parts) > 0) & F.forall(parts, _in_domain)
    return ~in_domain & (F.trim(entity).isin(*EMPTY_NAMES) | compound)


def _measured(stats: Column, statistic: Column) -> Column:
    return F.get(F.filter(stats, lambda s: s["statistic"] == statistic), F.lit(0))["measured"]


def _reason(in_domain: Column, known_statistic: Column, value: Column, real: Column, deviation: Column, tolerance: float) -> Column:
    within = F.coalesce(deviation <= tolerance, F.lit(False))
    return (
        F.when(~in_domain, "entity_not_in_evidence")
        .when(~known_statistic, "statistic_not_in_evidence")
        .when(real.isNull(), "pair_not_in_evidence")
        .when(value.isNull(), "not_a_number")
        .when(~within, "wrong_value")
    )


def with_name_flags(items: DataFrame, evidence: Evidence) -> DataFrame:
    """Add in_domain, in_names, in_frame, artifact and outside to cited or claimed names."""
    joined = weighed_join(items, evidence.facts.select("evidence_id", "known"), ["evidence_id"], ["response_id", "pos"])
    return _flagged(joined).select(*items.columns, "in_domain", "in_names", "in_frame", "artifact", "outside")


def _flagged(rows: DataFrame) -> DataFrame:
    found = rows.withColumn("fact", F.try_element_at("known", "entity"))
    found = found.select("*", *_own_flags(F.col("fact")))
    found = found.withColumn("artifact", _artifact(F.col("entity"), F.col("in_domain")))
    return found.withColumn("outside", ~F.col("in_domain") & ~F.col("artifact"))


def checked_claims(claims: DataFrame, evidence: Evidence, alias_statistics: bool = False) -> DataFrame:
    """Claims with their measured value, deviation and the reason they fail, if any."""
    facts = evidence.facts.select("evidence_id", "known", "statistics")
    rows = _flagged(weighed_join(claims, facts, ["evidence_id"], ["response_id", "pos"]))
    if alias_statistics:
        rows = rows.withColumn("statistic", statistic_name(F.col("statistic")))
    value, real = F.col("value"), F.col("measured")
    rows = rows.withColumn("measured", _measured(F.col("fact.stats"), F.col("statistic")))
    rows = rows.withColumn("known_statistic", F.coalesce(F.array_contains("statistics", F.col("statistic")), F.lit(False)))
    rows = rows.withColumn("deviation", F.when(finite(value), F.abs(value - real)))
    reason = _reason(F.col("in_domain"), F.col("known_statistic"), value, real, F.col("deviation"), evidence.tolerance)
    return rows.withColumn("reason", reason).drop("known", "statistics", "fact")


def judged(responses: DataFrame, evidence: Evidence, alias_statistics: bool = False) -> DataFrame:
    """Responses with ``anchor`` and their names and claims judged, as arrays ``_cited`` and ``_claims``.

    One join; nothing is exploded, so nothing has to be grouped again. Each step of a judgement is a transform of
    its own, because a lambda computes what it names twice twice.
    """
    rows = weighed_join(responses, evidence.facts, ["evidence_id"], ["response_id"])
    known, tau = F.col("known"), evidence.tolerance

    def cited(entity: Column, pos: Column) -> Column:
        return F.struct(pos.alias("pos"), F.coalesce(entity, F.lit("None")).alias("entity"))

    def read(claim: Column, pos: Column) -> Column:
        statistic = F.coalesce(claim["statistic"], F.lit(""))
        return F.struct(
            pos.alias("pos"), F.coalesce(claim["column"], F.lit("None")).alias("entity"),
            (statistic_name(statistic) if alias_statistics else statistic).alias("statistic"), claim["value"].cast("double").alias("value"),
        )

    def kept(x: Column, names: Sequence[str], *more: Column) -> Column:
        return F.struct(*[x[n].alias(n) for n in names], *more)

    def named(items: Column, own: list[str]) -> Column:
        flags = ["in_domain", "in_names", "in_frame"]
        found = F.transform(items, lambda x: kept(x, own, F.try_element_at(known, x["entity"]).alias("fact")))
        found = F.transform(found, lambda x: kept(x, [*own, "fact"], *_own_flags(x["fact"])))
        found = F.transform(found, lambda x: kept(x, [*own, "fact", *flags], _artifact(x["entity"], x["in_domain"]).alias("artifact")))
        outside = lambda x: (~x["in_domain"] & ~x["artifact"]).alias("outside")
        return F.transform(found, lambda x: kept(x, [*own, "fact", *flags, "artifact"], outside(x)))

    flags, claim = ["in_domain", "in_names", "in_frame", "artifact", "outside"], ["pos", "entity", "statistic", "value"]

    def looked_up(x: Column) -> Column:
        known_statistic = F.coalesce(F.array_contains("statistics", x["statistic"]), F.lit(False))
        return kept(x, [*claim, *flags], known_statistic.alias("known_statistic"), _measured(x["fact"]["stats"], x["statistic"]).alias("measured"))

    def apart(x: Column) -> Column:
        deviation = F.when(finite(x["value"]), F.abs(x["value"] - x["measured"]))
        return kept(x, [*claim, *flags, "known_statistic", "measured"], deviation.alias("deviation"))

    def decided(x: Column) -> Column:
        reason = _reason(x["in_domain"], x["known_statistic"], x["value"], x["measured"], x["deviation"], tau)
        return kept(x, [*claim, *flags, "known_statistic", "measured", "deviation"], reason.alias("reason"))

    def near(x: Column) -> Column:
        # a sound claim's number is one of the evidence's
        found = F.when(x["reason"].isNull(), True).otherwise(near_sorted(x["value"], F.col("numbers"), tau))
        return kept(x, [*claim, *flags, "known_statistic", "measured", "deviation", "reason"], found.alias("number_known"))

    claims = named(F.transform("claims", read), claim)
    for step in (looked_up, apart, decided, near):
        claims = F.transform(claims, step)
    names = F.transform(named(F.transform("cited", cited), ["pos", "entity"]), lambda x: kept(x, ["pos", "entity", *flags]))
    return rows.withColumns({"_cited": names, "_claims": claims}).drop("known", "statistics", "numbers")


# ---------------------------------------------------------------- verification


def unsound_citations(responses: DataFrame, evidence: Evidence) -> DataFrame:
    """Cited names outside the admissible entities."""
    admitted = evidence.entities.select("evidence_id", "entity").distinct()
    return salted_join(cited_items(responses), admitted, ["evidence_id", "entity"], ["response_id", "pos"], "left_anti").select(
        "response_id", "evidence_id", "pos", "entity"
    )


def with_anchor(responses: DataFrame, evidence: Evidence) -> DataFrame:
    """Add the evidence's anchor and whether the response refers to it."""
    joined = weighed_join(responses, evidence.facts.select("evidence_id", "anchor"), ["evidence_id"], ["response_id"])
    return joined.withColumn("names_anchor", _names_anchor())


def _names_anchor() -> Column:
    named = F.array_union(
        F.coalesce("cited", F.array().cast("array<string>")),
        F.coalesce(F.col("claims")["column"], F.array().cast("array<string>")),
    )
    return F.coalesce(F.array_contains(named, F.col("anchor")), F.lit(False))


def completeness(responses: DataFrame, evidence: Evidence, verdicts: Sequence[str]) -> DataFrame:
    """Per response: admissible verdict, commitment, and an omitted anchor."""
    verdict = F.coalesce("verdict", F.lit(""))
    admissible = verdict.isin(*verdicts)
    committed = admissible & (verdict != ABSTENTION)
    return with_anchor(responses, evidence).select(
        "response_id",
        "evidence_id",
        (~admissible).alias("malformed"),
        committed.alias("committed"),
        (committed & F.col("anchor").isNotNull() & ~F.col("names_anchor")).alias("omitted"),
    )


def strip_unsound(responses: DataFrame, evidence: Evidence) -> DataFrame:
    """Responses without their unsound citations and claims, order kept.

    The lists collected back are parts of one response. Omissions are left as
    they are: deleting is safe, inserting is not.
    """
    cited = with_name_flags(cited_items(responses), evidence).where("in_domain")
    claims = checked_claims(claim_items(responses), evidence).where("reason IS NULL")
    kept_cited = cited.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("pos", "entity"))).alias("kept_cited"))
    kept_claims = claims.groupBy("response_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("entity").alias("column"), "statistic", "value"))).alias("kept_claims")
    )
    none = F.array().cast("array<string>")
    return (
        responses.join(kept_cited, "response_id", "left")
        .join(kept_claims, "response_id", "left")
        .withColumn("cited", F.coalesce(F.col("kept_cited")["entity"], none))
        .withColumn(
            "claims",
            F.coalesce(
                F.transform("kept_claims", lambda c: F.struct(c["column"].alias("column"), c["statistic"].alias("statistic"), c["value"].alias("value"))),
                F.array().cast("array<struct<column:string,statistic:string,value:double>>"),
            ),
        )
        .drop("kept_cited", "kept_claims")
    )


# ---------------------------------------------------------------- scoring


@dataclass
class ScoredItems:
    """Citations and claims of responses with every flag the scores read."""

    responses: DataFrame
    evidence: Evidence
    alias_statistics: bool = False

    @cached_property
    def judged(self) -> DataFrame:
        return durable(judged(self.responses, self.evidence, self.alias_statistics))

    @cached_property
    def citations(self) -> DataFrame:
        return self.judged.select("response_id", "evidence_id", F.inline("_cited"))

    @cached_property
    def claims(self) -> DataFrame:
        return self.judged.select("response_id", "evidence_id", F.inline("_claims"))

    @cached_property
    def names(self) -> DataFrame:
        """Every name a response points at, cited or claimed."""
        columns = ["response_id", "evidence_id", "pos", "entity", "in_domain", "in_names", "in_frame", "artifact", "outside"]
        cited = self.citations.select(*columns, F.lit("cited").alias("place"))
        return cited.unionByName(self.claims.select(*columns, F.lit("claim").alias("place")))


def record_scores(items: ScoredItems) -> DataFrame:
    """Channel flags per response; transport errors are not data and drop out."""
    def name(test) -> Column:
        return _any("_cited", test) | _any("_claims", test)

    flags = {
        "entity": name(lambda n: n["outside"]),
        "entity_invented": name(lambda n: n["outside"] & ~n["in_names"]),
        "entity_misfiled": name(lambda n: n["outside"] & n["in_names"]),
        "entity_artifact": name(lambda n: n["artifact"]),
        "value": _any("_claims", lambda c: c["reason"].isin(*WRONG)),
        "value_unverifiable": _any("_claims", lambda c: c["reason"].isin(*UNCARRIED)),
    }
    rows = items.judged.where("error IS NULL").withColumn("names_anchor", _names_anchor())
    some = (F.coalesce(F.size("cited"), F.lit(0)) > 0) | (F.coalesce(F.size("claims"), F.lit(0)) > 0)
    # a missing verdict is read as a position taken
    silent = F.coalesce(F.col("verdict").isin("", ABSTENTION), F.lit(False))
    skips = some & ~silent & ~F.col("names_anchor")
    anchored, flag = F.col("anchor").isNotNull(), F.col("omitted")
    return rows.select(
            *[c for c in items.responses.columns if c not in ("cited", "claims", "attempts")],
            *[c.alias(f) for f, c in flags.items()],
            F.when(anchored, F.coalesce(flag, skips)).alias("omission"),
            F.when(anchored & flag.isNotNull(), ~flag & skips).alias("omission_undetected"),
            F.coalesce(F.col("verdict") == ABSTENTION, F.lit(False)).alias("abstained"),
    )


def unified_scores(items: ScoredItems, verdicts: Sequence[str]) -> DataFrame:
    """Counts of every violation per response and the one kind it falls under."""
    return _scored(items.judged, items, verdicts)


def unified_scores_without(items: ScoredItems, verdicts: Sequence[str], statistics: Sequence[str]) -> DataFrame:
    """``unified_scores`` as if the evidence did not carry these statistics; its numbers stay known."""

    def struck(claim: Column) -> Column:
        gone = claim["in_domain"] & claim["statistic"].isin(*statistics)
        return (
            claim.withField("reason", F.when(gone, "statistic_not_in_evidence").otherwise(claim["reason"]))
            .withField("deviation", F.when(~claim["statistic"].isin(*statistics), claim["deviation"]))
        )

    return _scored(items.judged.withColumn("_claims", F.transform("_claims", struck)), items, verdicts)


def _any(column: str, test) -> Column:
    return F.coalesce(F.exists(column, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def _count(column: str, test) -> Column:
    return F.coalesce(F.size(F.filter(column, test)), F.lit(0)).cast("long")


def _scored(judged_rows: DataFrame, items: ScoredItems, verdicts: Sequence[str]) -> DataFrame:
    tau = items.evidence.tolerance

    def wrong(c: Column) -> Column:
        return c["reason"].isin(*WRONG)

    def uncarried(c: Column) -> Column:
        return c["reason"].isin(*UNCARRIED)

    claim_counts = {
        "claims_made": lambda c: F.lit(True),
        "c2_wrong": wrong,
        "c2_not_carried": uncarried,
        "c2_not_carried_real": lambda c: uncarried(c) & c["number_known"],
        "c2_unsupported": lambda c: uncarried(c) & c["value"].isNotNull() & ~c["number_known"],
        "c2_wrong_foreign": lambda c: wrong(c) & c["value"].isNotNull() & c["number_known"],
        "c2_wrong_absent": lambda c: wrong(c) & c["value"].isNotNull() & ~c["number_known"],
        "c2_wrong_nonnumeric": lambda c: wrong(c) & c["value"].isNull(),
        "claims_checked": lambda c: c["deviation"].isNotNull(),
        "claims_exact": lambda c: c["deviation"] == 0,
        "claims_round": lambda c: (c["deviation"] > 0) & (c["deviation"] <= 5e-4),
        "claims_correct": lambda c: c["deviation"] <= tau,
    }
    counts = {"c1_cited": _count("_cited", lambda n: n["outside"]), "c1_claim": _count("_claims", lambda n: n["outside"])}
    counts |= {name: _count("_claims", test) for name, test in claim_counts.items()}

    def name(test) -> Column:
        return _any("_cited", test) | _any("_claims", test)

    flags = {
        "anchor_value": _any("_claims", lambda c: (c["deviation"] <= tau) & (c["entity"] == F.col("anchor"))),
        "c1_misfiled": name(lambda n: n["outside"] & n["in_names"]),
        "c1_outside": name(lambda n: n["outside"] & ~n["in_names"]),
        "names_unlisted": name(lambda n: n["outside"] & ~n["in_names"] & n["in_frame"]),
        "names_invented": name(lambda n: n["outside"] & ~n["in_names"] & ~n["in_frame"]),
        "artifact": name(lambda n: n["artifact"]),
    }
    verdict = F.trim(F.coalesce("verdict", F.lit("")))
    committed = (verdict != "") & ~F.lower(verdict).isin(ABSTENTION, "cannot determine")
    rows = judged_rows.withColumn("names_anchor", _names_anchor())
    scored = rows.select(
        *[c for c in items.responses.columns if c not in ("cited", "claims", "attempts")],
        verdict.isin(*verdicts).alias("verdict_admissible"),
        committed.alias("committed"),
        (committed & F.col("anchor").isNotNull() & ~F.col("names_anchor")).alias("c3"),
        *[c.alias(n) for n, c in (counts | flags).items()],
    )
    any_name = (F.col("c1_cited") > 0) | (F.col("c1_claim") > 0)
    kind = (
        F.when(F.col("c1_outside") | (F.col("c2_wrong_absent") > 0) | (F.col("c2_unsupported") > 0), "extrinsic")
        .when((F.col("c2_wrong_foreign") > 0) | (F.col("c2_wrong_nonnumeric") > 0), "contradicts")
        .when(any_name | (F.col("c2_not_carried") > 0), "misplaced")
        .when(F.col("c3"), "omission")
        .otherwise("")
    )
    violation = any_name | (F.col("c2_wrong") > 0) | (F.col("c2_not_carried") > 0) | F.col("c3")
    return scored.withColumn("violation", violation).withColumn("kind", kind)
