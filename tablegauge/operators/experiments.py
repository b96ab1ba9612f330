"""Statistics of experiments on grouped counts: intervals, tests, agreement, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.functions.probability import chi_square_tail, fisher_two_sided, newcombe, normal_two_sided, wilson
from tablegauge.operators.order_stats import quantiles, running_totals

# Fixed values of the contrast verdict.
EQUIVALENCE, MATERIAL = 0.02, 0.05
VALID_SHARE = 0.9
# Report section headers and the sections that only suggest.
SECTIONS = (
    ("⚠ Warnings", "warnings"),
    ("✨ Recommended models", "models"),
    ("🔧 Feature engineering", "features"),
    ("⚠ Pitfalls", "pitfalls"),
)
SUGGESTING = ("models", "features")


def with_wilson(counts: DataFrame, k: str = "k", n: str = "n") -> DataFrame:
    low, high = wilson(F.col(k), F.col(n))
    return counts.withColumn("rate", C.ratio(F.col(k), F.col(n))).withColumn("low", low).withColumn("high", high)


def arm_pairs(cells: DataFrame, group: Sequence[str], baseline: str) -> DataFrame:
    """Each arm (k1, n1) next to the baseline arm (k2, n2) of its group."""
    base = cells.where(F.col("arm") == baseline).select(*group, F.col("k").alias("k2"), F.col("n").alias("n2"))
    others = cells.where(F.col("arm") != baseline).select(*group, "arm", F.col("k").alias("k1"), F.col("n").alias("n1"))
    return others.join(base, list(group))


def with_difference(pairs: DataFrame) -> DataFrame:
    low, high = newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    difference = F.try_divide(F.col("k1").cast("double"), F.col("n1")) - F.try_divide(F.col("k2").cast("double"), F.col("n2"))
    return pairs.withColumn("difference", difference).withColumn("low", low).withColumn("high", high)


def with_fisher(pairs: DataFrame) -> DataFrame:
    args = [F.col(c).cast("double") for c in ("k1", "n1", "k2", "n2")]
    return pairs.withColumn("p", fisher_two_sided(*args))


def with_holm(tests: DataFrame, family: Sequence[str], order: Sequence[str], p: str = "p") -> DataFrame:
    """Step-down adjusted p per family of registered tests."""
    by = Window.partitionBy(*family).orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(by) + 1) * F.col(p))
    rows = tests.withColumn("_step", step)
    running = F.max("_step").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("p_holm", running).drop("_step")


def trend(counts: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """Cochran-Armitage trend of k of n over scores: z and its two-sided p."""
    k, n, s = F.col("k"), F.col("n"), F.col(score).cast("double")
    sums = counts.groupBy(*group).agg(
        F.sum(n).cast("double").alias("rows"),
        (F.sum(k) / F.sum(n)).alias("pooled"),
        F.sum(s * k).alias("sk"),
        F.sum(s * n).alias("sn"),
        F.sum(s * s * n).alias("ssn"),
    )
    variance = F.col("pooled") * (1 - F.col("pooled")) * (F.col("ssn") - F.col("sn") * F.col("sn") / F.col("rows"))
    z = F.when(variance > 0, (F.col("sk") - F.col("pooled") * F.col("sn")) / F.sqrt(variance)).otherwise(0.0)
    return sums.select(*group, z.alias("z")).withColumn(
        "p", F.when(F.col("z") == 0, 1.0).otherwise(normal_two_sided(F.col("z")))
    )


def heterogeneity(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """k x 2 chi-square over the arms of a group, with the pooled rate.

    One degree of freedom takes the continuity correction.
    """
    by = Window.partitionBy(*group)  # the arms of one group
    rows = cells.withColumns(
        {"all_k": F.sum("k").over(by), "all_n": F.sum("n").over(by), "arms": F.count(F.lit(1)).over(by)}
    )
    hit = F.col("n") * F.col("all_k") / F.col("all_n")
    miss = F.col("n") - hit
    off = F.abs(F.col("k") - hit)
    off = F.when(F.col("arms") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
    term = F.try_divide(off * off, hit) + F.try_divide(off * off, miss)
    stats = rows.groupBy(*group, "all_k", "all_n", "arms").agg(F.sum(term).alias("chi2"))
    low, high = wilson(F.col("all_k"), F.col("all_n"))
    return stats.select(
        *group,
        "chi2",
        (F.col("arms") - 1).alias("dof"),
        chi_square_tail(F.col("chi2"), (F.col("arms") - 1).cast("double")).alias("p"),
        C.ratio(F.col("all_k"), F.col("all_n")).alias("pooled"),
        low.alias("low"),
        high.alias("high"),
    )


def pairwise_fisher(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """Fisher p of every two arms of a group; the arms are few by design."""
    left = cells.select(*group, F.col("arm").alias("a"), F.col("k").alias("k1"), F.col("n").alias("n1"))
    right = cells.select(*group, F.col("arm").alias("b"), F.col("k").alias("k2"), F.col("n").alias("n2"))
    return with_fisher(left.join(right, list(group)).where("a < b"))


def kappa(ratings: DataFrame, group: Sequence[str], a: str = "a", b: str = "b", constant: float | None = None) -> DataFrame:
    """Agreement and Cohen's kappa; ``constant`` where chance agreement is 1."""
    cells = ratings.groupBy(*group, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).alias("nb"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same")),
        F.struct(F.col("b").alias("label"), F.lit(0).alias("na"), F.col("n").alias("nb"), F.lit(0).alias("same")),
    )
    marginals = cells.select(*group, F.explode(sides).alias("s")).groupBy(*group, F.col("s.label").alias("label")).agg(
        *[F.sum(f"s.{c}").cast("double").alias(c) for c in ("na", "nb", "same")]
    )
    sums = marginals.groupBy(*group).agg(
        F.sum("na").alias("items"), F.sum("same").alias("agreed"), F.sum(F.col("na") * F.col("nb")).alias("chance")
    )
    po = F.col("agreed") / F.col("items")
    pe = F.col("chance") / (F.col("items") * F.col("items"))
    value = F.when(pe < 1, F.try_divide(po - pe, 1 - pe)).otherwise(F.lit(constant).cast("double"))
    return sums.select(*group, F.col("items").cast("long").alias("items"), po.alias("agreement"), value.alias("kappa"))


def contrast_verdict(difference: Column, low: Column, high: Column) -> Column:
    """Equivalent, inconclusive, material or below the bar; negative is better."""
    return (
        F.when((low >= -EQUIVALENCE) & (high <= EQUIVALENCE), "equivalent")
        .when(~((low > 0) | (high < 0)), "inconclusive")
        .when(difference <= -MATERIAL, "contract lower")
        .when(difference >= MATERIAL, "baseline lower")
        .otherwise("below the bar")
    )


def contrast_table(
    cells: DataFrame, group: Sequence[str], contract: str, contrasts: Sequence[tuple[str, str, bool]], coverage: DataFrame | None = None
) -> DataFrame:
    """Every registered contrast of every group that has the contract arm.

    ``contrasts`` lists (name, baseline arm, in the corrected family). A baseline
    that did not run stays in the table. ``coverage(group, arm, share)`` withholds
    the verdict of arms whose fixed domain covers nothing or everything.
    """
    own = cells.where(F.col("arm") == contract).select(*group, F.col("k").alias("k1"), F.col("n").alias("n1"))
    listed = F.array(
        *[F.struct(F.lit(c).alias("contrast"), F.lit(b).alias("arm"), F.lit(f).alias("in_family")) for c, b, f in contrasts]
    )
    wanted = own.select(*group, "k1", "n1", F.explode(listed).alias("c")).select(*group, "k1", "n1", "c.*")
    base = cells.select(*group, "arm", F.col("k").alias("k2"), F.col("n").alias("n2"))
    rows = with_difference(wanted.join(base, [*group, "arm"], "left"))
    ran = F.col("n2").isNotNull()
    rows = with_fisher(rows.withColumn("ran", ran)).withColumn("p", F.when(ran, F.col("p")))
    rows = rows.withColumn("tested", F.col("in_family") & ran)
    adjusted = with_holm(rows, [*group, "tested"], ["contrast"])
    if coverage is None:
        adjusted = adjusted.withColumn("share", F.lit(None).cast("double"))
    else:
        adjusted = adjusted.join(coverage, [*group, "arm"], "left")
    degenerate = F.coalesce((F.col("share") <= 0) | (F.col("share") >= 1), F.lit(False))
    verdict = (
        F.when(~ran, "not run")
        .when(degenerate, "not interpretable")
        .otherwise(contrast_verdict(F.col("difference"), F.col("low"), F.col("high")))
    )

    def only(condition: Column, name: str) -> Column:
        return F.when(condition, F.col(name)).alias(name)

    return adjusted.select(
        *group, "contrast", "arm", "k1", "n1", "k2", "n2", only(ran, "difference"), only(ran, "low"), only(ran, "high"),
        "p", only(F.col("tested"), "p_holm"), verdict.alias("verdict"),
    )


def label_shares(labels: DataFrame, group: Sequence[str], label: str = "label") -> DataFrame:
    """Share and interval of each label within its group."""
    counts = labels.groupBy(*group, label).agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k").over(Window.partitionBy(*group))  # one row per label
    return with_wilson(counts.withColumn("n", total))


def checklist_accuracy(a: DataFrame, b: DataFrame, key: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Kappa of two raters and precision and recall of the key where they agree.

    Each table holds (script_id, one boolean column per rule).
    """

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select("script_id", *rules).unpivot(["script_id"], list(rules), "rule", name)

    rated = long(a, "a").join(long(b, "b"), ["script_id", "rule"]).join(long(key, "k"), ["script_id", "rule"])
    rated = rated.where("a IS NOT NULL AND b IS NOT NULL")
    same, human, found = F.col("a") == F.col("b"), F.col("a"), F.coalesce("k", F.lit(False))
    counts = rated.groupBy("rule").agg(
        F.count(F.lit(1)).alias("rated"),
        F.count_if(same).alias("agreed"),
        F.count_if(same & human & found).alias("tp"),
        F.count_if(same & ~human & found).alias("fp"),
        F.count_if(same & human & ~found).alias("fn"),
    )
    tp = F.col("tp").cast("double")
    return counts.join(kappa(rated, ["rule"]).select("rule", "kappa"), "rule").select(
        *counts.columns,
        F.try_divide(tp, tp + F.col("fp")).alias("precision"),
        F.try_divide(tp, tp + F.col("fn")).alias("recall"),
        "kappa",
    )


def defect_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fixed, introduced and persisted defects per rule of (run_id, rule) tables."""
    pre, post = before.select("run_id", "rule", F.lit(True).alias("pre")), after.select("run_id", "rule", F.lit(True).alias("post"))
    both = pre.join(post, ["run_id", "rule"], "full")
    return both.groupBy("rule").agg(
        F.count_if(F.col("pre") & F.col("post").isNull()).alias("fixed"),
        F.count_if(F.col("pre").isNull() & F.col("post")).alias("introduced"),
        F.count_if(F.col("pre") & F.col("post")).alias("persisted"),
    )


def net_transitions(runs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Runs that got better, worse or stayed level in their number of defects."""
    pre = before.groupBy("run_id").agg(F.count(F.lit(1)).alias("pre"))
    post = after.groupBy("run_id").agg(F.count(F.lit(1)).alias("post"))
    rows = runs.select("run_id").join(pre, "run_id", "left").join(post, "run_id", "left").fillna(0)
    net = F.when(F.col("post") > F.col("pre"), "worse").when(F.col("post") < F.col("pre"), "better").otherwise("same")
    return rows.groupBy(net.alias("net")).agg(F.count(F.lit(1)).alias("runs"))


def report_findings(reports: DataFrame) -> DataFrame:
    """(report_id, no, section, finding) of the bulleted findings of report texts.

    Continuation lines fold into the bullet above; repeats keep their first
    place. Windows and lists stay within one report.
    """
    lines = reports.select("report_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"))
    bare = F.trim("line")
    section = F.lit(None).cast("string")
    for header, name in reversed(SECTIONS):
        section = F.when(F.startswith(bare, F.lit(header)), name).otherwise(section)
    bullet = section.isNull() & bare.rlike(r"^[•\-*]") & (F.char_length(bare) > 2)
    inside = section.isNull() & ~bullet & F.startswith("line", F.lit(" ")) & (bare != "")
    by = Window.partitionBy("report_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.select(
        "report_id", "line_no", bare.alias("bare"), bullet.alias("bullet"), inside.alias("inside"),
        F.coalesce(F.last(section, ignorenulls=True).over(by), F.lit("")).alias("section"),
        F.count_if(bullet).over(by).alias("no"),
    )
    text = F.when(F.col("bullet"), F.regexp_replace("bare", r"^[•\-* ]+", "")).otherwise(F.col("bare"))
    parts = marked.where((F.col("bullet") | F.col("inside")) & (F.col("no") > 0)).groupBy("report_id", "no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))).alias("parts"),
        F.min_by("section", "line_no").alias("section"),
    )
    found = parts.select("report_id", "no", "section", F.array_join(F.col("parts")["t"], " ").alias("finding"))
    folded = F.regexp_replace(F.lower("finding"), r"\s+", " ")
    first = Window.partitionBy("report_id", folded).orderBy("no")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def match_findings(reports: DataFrame, cases: DataFrame) -> DataFrame:
    """Detected and missed cases and unverified findings per report.

    ``cases(dataset, case_id, pattern, required)`` meet the reports of their
    dataset; a case counts when its pattern and all required texts occur.
    """
    flat = F.regexp_replace(F.lower("text"), r"\s+", " ")
    hay = reports.select("report_id", "dataset", flat.alias("hay")).join(cases, "dataset")
    required = F.forall("required", lambda r: F.contains("hay", F.lower(r)))
    judged = hay.withColumn("hit", F.regexp_like("hay", F.lower("pattern")) & required)
    per_case = judged.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("known"), F.count_if("hit").alias("detected"), F.count_if(~F.col("hit")).alias("missed")
    )
    hits = judged.where("hit").select("report_id", F.lower("pattern").alias("pattern"))
    found = report_findings(reports).withColumn("flat", F.regexp_replace(F.lower("finding"), r"\s+", " "))
    verified = found.join(hits, "report_id").where(F.regexp_like("flat", F.col("pattern"))).select("report_id", "no").distinct()
    loose = found.join(verified, ["report_id", "no"], "left_anti")
    suggestion = F.col("section").isin(*SUGGESTING)
    per_finding = loose.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("unverified"),
        F.count_if(suggestion).alias("unverified_suggestions"),
        F.count_if(~suggestion).alias("unverified_claims"),
    )
    return reports.select("report_id").join(per_case, "report_id", "left").join(per_finding, "report_id", "left").fillna(0)


def arm_outcomes(panel: DataFrame) -> DataFrame:
    """Runs, outcomes, defects, time and tokens per arm; empty cells are skipped."""
    base = panel.groupBy("arm").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "script_failed").alias("failed"),
        F.count("holdout_score").alias("scored"),
        F.count_if((F.col("status") == "completed") & F.col("holdout_score").isNull()).alias("ran_unscored"),
        F.coalesce(F.sum("defects"), F.lit(0)).alias("defects"),
        (F.coalesce(F.sum("defects"), F.lit(0)) / F.count(F.lit(1))).alias("defects_per_run"),
        F.avg("seconds").alias("mean_seconds"),
        F.avg("input_tokens").alias("mean_input_tokens"),
        F.avg("output_tokens").alias("mean_output_tokens"),
    )
    counts = panel.where("seconds IS NOT NULL").groupBy("arm", F.col("seconds").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    median = quantiles(running_totals(counts, ["arm"], "value", ["n"], reused=True), [0.5], ["arm"])
    return base.join(median.select("arm", F.col("q")[0].alias("median_seconds")), "arm", "left")


def rule_totals(panel: DataFrame, rules: Sequence[str], arms: Sequence[str]) -> DataFrame:
    """Defects per rule with one column per arm."""
    long = panel.select("arm", *rules).unpivot(["arm"], list(rules), "rule", "hits")
    return long.groupBy("rule").pivot("arm", list(arms)).agg(F.coalesce(F.sum("hits"), F.lit(0)))


def judge_validity(key: DataFrame, labels: DataFrame, truth: DataFrame, judges: Sequence[str]) -> DataFrame:
    """Share of expected labels per judge on strata whose truth is known.

    ``key(id, stratum)``, ``labels(id, judge, label)``, ``truth(stratum, side,
    expected)`` with the labels a stratum may get. Missing labels count against.
    """
    expected = key.join(truth, "stratum").withColumn("judge", F.explode(F.array(*[F.lit(j) for j in judges])))
    rated = expected.join(labels, ["id", "judge"], "left")
    good = F.coalesce(F.array_contains("expected", F.col("label")), F.lit(False))
    counts = rated.groupBy("judge", "side").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("k"), F.count_if(F.col("label").isNull()).alias("missing")
    )
    return with_wilson(counts).withColumn("valid", F.col("k") >= VALID_SHARE * F.col("n"))


def judge_consensus(key: DataFrame, labels: DataFrame, first: str, second: str) -> DataFrame:
    """Agreed label, or disagree, per stratum of the items both judges labelled; a null label is none."""
    labels = labels.where("label IS NOT NULL")
    a = labels.where(F.col("judge") == first).select("id", F.col("label").alias("a"))
    b = labels.where(F.col("judge") == second).select("id", F.col("label").alias("b"))
    joined = key.join(a, "id").join(b, "id")
    outcome = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("disagree")
    return joined.groupBy("stratum", outcome.alias("consensus")).agg(F.count(F.lit(1)).alias("items"))
