"""Run comparison and hyperparameter history over tables of runs.

``run_metrics(run_id, seq, metric, value)`` holds the history and
``run_config(run_id, key, value)`` the settings, values as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.numbers import to_number
from tablegauge.operators.leakage import weighted_pearson
from tablegauge.operators.order_stats import average_ranks, running_totals
from tablegauge.operators.skew import salted_join
from tablegauge.session import durable

# Name parts that tell the direction of a metric.
LOWER_PARTS = ("loss", "error", "mae", "mse", "rmse", "nll", "perplexity", "brier", "mape", "msle")
LOWER_WORDS = ("wer", "cer", "ece", "eer", "fpr", "fnr")
HIGHER_PARTS = ("acc", "auc", "f1", "precision", "recall", "iou", "score", "r2")
# Bounds of well-known hyperparameters, first matching name part wins.
SOFT_BOUNDS = (
    ("dropout", 0.0, 0.8),
    ("weight_decay", 0.0, 1.0),
    ("momentum", 0.0, 0.99),
    ("learning_rate", 1e-7, 10.0),
    ("lr", 1e-7, 10.0),
)
USEFUL_CORRELATION = 0.05
STEP = 0.5


def final_metrics(run_metrics: DataFrame) -> DataFrame:
    """The metrics of each run's last history row."""
    last = run_metrics.groupBy("run_id", "metric").agg(
        F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value")
    )
    newest = F.max("seq").over(Window.partitionBy("run_id"))  # one row per metric name of the run
    return last.withColumn("_newest", newest).where("seq = _newest").select("run_id", "seq", "metric", "value")


def _sides(pairs: DataFrame, rows: DataFrame, on: str, name: str, value: str) -> tuple[DataFrame, DataFrame]:
    sides = []
    for side in ("a", "b"):
        keyed = rows.select(F.col(on).alias(side), name, F.col(value).alias(f"{side}_value"))
        sides.append(pairs.join(keyed, side))
    return sides[0], sides[1]


def config_diff(pairs: DataFrame, run_config: DataFrame) -> DataFrame:
    """Settings that differ between the runs a and b; a missing one is NULL."""
    left, right = _sides(pairs, run_config.where("value IS NOT NULL"), "run_id", "key", "value")
    both = left.join(right, ["a", "b", "key"], "full")
    return both.where(~F.equal_null("a_value", "b_value"))


def better_side(metric: Column, a: Column, b: Column) -> Column:
    """a, b or tie by the direction the name tells; NULL where it tells none."""
    name = F.lower(metric)
    words = F.split(name, "[^a-z0-9]+")
    lower = name.rlike("|".join(LOWER_PARTS)) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in LOWER_WORDS]))
    smaller, larger = F.when(a < b, "a").when(b < a, "b"), F.when(a > b, "a").when(b > a, "b")
    return F.when(lower, smaller.otherwise("tie")).when(
        name.rlike("|".join(HIGHER_PARTS)), larger.otherwise("tie")
    )


def metric_comparison(pairs: DataFrame, finals: DataFrame) -> DataFrame:
    """Common final metrics of the runs a and b with their delta and better side."""
    left, right = _sides(pairs, finals.where("metric <> 'epoch'"), "run_id", "metric", "value")
    both = left.join(right, ["a", "b", "metric"])
    return both.withColumn("delta", F.col("b_value") - F.col("a_value")).withColumn(
        "better", better_side(F.col("metric"), F.col("a_value"), F.col("b_value"))
    )


def comparison_verdict(compared: DataFrame) -> DataFrame:
    wins = compared.groupBy("a", "b").agg(
        F.count_if(F.col("better") == "a").alias("a_wins"),
        F.count_if(F.col("better") == "b").alias("b_wins"),
        F.count_if(F.col("better") == "tie").alias("ties"),
    )
    a, b = F.col("a_wins"), F.col("b_wins")
    verdict = (
        F.when(a + b == 0, "inconclusive").when(b == 0, "a_better").when(a == 0, "b_better").otherwise("mixed")
    )
    return wins.withColumn("verdict", verdict)


def score_runs(finals: DataFrame, metric: str) -> DataFrame:
    """Finite scores of the runs that carry the metric, whatever its case."""
    named = finals.where(F.lower("metric") == metric.lower())
    finite = F.col("value").isNotNull() & ~F.isnan("value") & ~F.col("value").isin(float("inf"), float("-inf"))
    return named.where(finite).groupBy("run_id").agg(F.min_by("value", "metric").alias("score"))


def skipped_runs(runs: DataFrame, scored: DataFrame) -> DataFrame:
    kept = scored.agg(F.count(F.lit(1))).scalar()
    return runs.agg(F.count_distinct("run_id").alias("runs")).select(
        "runs", kept.alias("scored"), (F.col("runs") - kept).alias("skipped")
    )


def leaderboard(scored: DataFrame, k: int = 5, direction: str = "max") -> DataFrame:
    order = F.desc("score") if direction == "max" else F.asc("score")
    return scored.orderBy(order, "run_id").limit(k)


def sensitivity(scored: DataFrame, run_config: DataFrame, direction: str = "max") -> DataFrame:
    """Rank correlation of every numeric setting with the score, larger = better.

    Scores are ranked over all scored runs; a setting over the runs that have it.
    """
    if direction not in ("max", "min"):
        raise ValueError("direction is max or min")
    sign = 1.0 if direction == "max" else -1.0
    scored = durable(scored)
    score_counts = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    score_ranks = average_ranks(running_totals(score_counts, [], "score", ["n"])).select(
        "score", (F.col("rank") * sign).alias("score_rank")
    )
    ranked_scores = salted_join(scored, score_ranks, ["score"], ["run_id"], "inner")
    settings = durable(run_config.withColumn("num", to_number(F.col("value"))).join(ranked_scores, "run_id"))
    finite = F.col("num").isNotNull() & ~F.isnan("num") & ~F.col("num").isin(float("inf"), float("-inf"))
    facts = settings.groupBy("key").agg(
        F.count_if(finite).alias("observations"),
        F.min(F.when(finite, F.col("num"))).alias("min"),
        F.max(F.when(finite, F.col("num"))).alias("max"),
    )
    usable = (F.col("observations") >= 3) & (F.col("min") < F.col("max"))
    numeric = settings.where(finite)
    key_counts = numeric.groupBy("key", "num").agg(F.count(F.lit(1)).alias("n"))
    ranks = average_ranks(running_totals(key_counts, ["key"], "num", ["n"])).select(
        "key", "num", F.col("rank").alias("num_rank")
    )
    rows = salted_join(numeric, ranks, ["key", "num"], ["run_id"], "inner").withColumn("n", F.lit(1))
    correlations = weighted_pearson(rows, ["key"], "num_rank", "score_rank")
    enough = scored.agg(F.count(F.lit(1))).scalar() >= 3
    return facts.join(correlations, "key", "left").where(enough).select(
        "key",
        F.when(usable, "numeric").otherwise("categorical_or_constant").alias("kind"),
        "observations",
        F.when(usable, F.coalesce("correlation", F.lit(0.0))).alias("correlation"),
        F.when(usable, F.col("min")).alias("min"),
        F.when(usable, F.col("max")).alias("max"),
    )


def _soft_bound(key: Column, side: int) -> Column:
    bound = F.lit(None).cast("double")
    for part in reversed(SOFT_BOUNDS):
        bound = F.when(F.contains(F.lower(key), F.lit(part[0])), part[side]).otherwise(bound)
    return bound


def suggestions(
    ranked: DataFrame,
    leader_config: DataFrame,
    n: int = 3,
    constraints: DataFrame | None = None,
) -> DataFrame:
    """Next values for the most telling settings, stepped from the leader's.

    The top setting is stepped the way its correlation points and once against
    it, the following ones only with it. Correlations already read "larger is
    better" for both directions, so their sign alone gives the direction.
    ``constraints(key, low, high)`` bounds a setting and allows sign changes.
    """
    useful = ranked.where((F.col("kind") == "numeric") & (F.abs("correlation") >= USEFUL_CORRELATION))
    order = Window.orderBy(F.round(F.abs("correlation"), 9).desc(), "key")
    # One row per setting name.
    placed = useful.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    moves = F.when(
        F.col("place") == 1,
        F.array(
            F.struct(F.lit(1).alias("no"), F.lit("exploit").alias("move"), F.lit(STEP).alias("step")),
            F.struct(F.lit(2).alias("no"), F.lit("explore").alias("move"), F.lit(-STEP).alias("step")),
        ),
    ).otherwise(
        F.array(
            F.struct((F.col("place") + 1).alias("no"), F.lit("exploit").alias("move"), F.lit(STEP).alias("step"))
        )
    )
    plan = placed.withColumn("m", F.explode(moves)).select("key", "correlation", "min", "max", "m.*").where(
        F.col("no") <= n
    )
    leader = leader_config.select("key", F.col("value").alias("leader_value"))
    rows = plan.join(leader, "key", "left")
    if constraints is None:
        rows = rows.withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    else:
        rows = rows.join(constraints, "key", "left")
    lo, hi = F.col("min"), F.col("max")
    now = F.coalesce(to_number(F.col("leader_value")), lo)
    direction = F.signum(F.col("correlation")) * F.signum("step")
    size = F.abs("step")
    bounded = F.col("low").isNotNull()
    scaled = ~bounded & (lo > 0) & (now > 0)
    span = F.greatest(hi - lo, F.abs(now) * 0.5, F.lit(1e-6))
    raw = F.when(scaled, now * F.pow(F.lit(10.0), direction * size)).otherwise(now + direction * size * span)
    floor = F.when(bounded, F.col("low")).when(scaled, lo / 10.0).otherwise(lo - span)
    ceiling = F.when(bounded, F.col("high")).when(scaled, hi * 10.0).otherwise(hi + span)
    # greatest and least skip NULL, so a name without soft bounds keeps its own.
    floor = F.when(bounded, floor).otherwise(F.greatest(floor, _soft_bound(F.col("key"), 1)))
    ceiling = F.when(bounded, ceiling).otherwise(F.least(ceiling, _soft_bound(F.col("key"), 2)))
    clamped = F.greatest(floor, F.least(ceiling, raw))
    whole = F.coalesce(F.col("leader_value").rlike(r"^\s*[-+]?\d+\s*$"), F.lit(False))
    value = F.when(whole, F.bround(clamped, 0)).otherwise(clamped)
    return rows.select(F.col("no").alias("suggestion"), "move", "key", "correlation", now.alias("leader_num"), value.alias("value"))
