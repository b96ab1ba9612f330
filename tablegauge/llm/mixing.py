"""Mix sources to target weights by a Pfair schedule.

Documents of a source are put in a fixed random order and cut into blocks. Time is slots, one block
each. A cycle holds about ``CYCLE`` slots, of which a source owns a whole number after its
weight. Its j-th block of ``b`` in a cycle of ``L`` slots is released at ``floor((j-1) L / b)`` and due at
``ceil(j L / b)``; the earliest deadline among the released blocks goes first. Every block then meets its window, so at
any slot a source is less than one block from its exact share.

All cycles in which the same sources are left are alike, and the number of kinds is at most twice the number of
sources plus one: one cycle of each kind is scheduled, and a block finds its slot by arithmetic. A source that
runs out gives its slots to the others in proportion, from the cycle in which it ends. No row is dropped
or repeated.

Defined results: null is a source like any other; a source without a positive weight owns one slot a
cycle; rows that repeat an id get places of their own; an empty table gives none. More sources
than slots in a cycle are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.session import durable

CYCLE = 1000
BLOCK_ROWS = 32
BUCKET_ROWS = 4096
TEMPER = 0.5

# One cycle: at each slot the released block with the earliest deadline, ties to the first source.
_SCHEDULE = """
aggregate(
  sequence(0, int(length) - 1),
  named_struct('done', transform(shares, b -> 0), 'picks', cast(array() AS array<int>)),
  (state, slot) -> transform(
    array(array_min(transform(shares, (b, i) ->
      CASE WHEN state.done[i] < b AND (state.done[i] * length) div b <= slot
      THEN named_struct('deadline', ((state.done[i] + 1) * length + b - 1) div b, 'source', i) END))),
    pick -> named_struct(
      'done', transform(state.done, (d, i) -> CASE WHEN i = pick.source THEN d + 1 ELSE d END),
      'picks', concat(state.picks, array(pick.source))))[0],
  state -> state.picks)
"""


def tempered(counts: DataFrame, power: float = TEMPER) -> DataFrame:
    """Target weights (source, weight) that lift small sources: the row count to a power below one."""
    return counts.select("source", F.pow(F.col("n"), F.lit(power)).alias("weight"))


def cycle_plan(counts: DataFrame, weights: DataFrame, cycle: int, block_rows: int) -> DataFrame:
    """One row per source: its share of a cycle, and the slots it owns in each kind of cycle."""
    least = F.lit(1).cast("long")
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    target = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
    rows = counts.join(target, counts["source"].eqNullSafe(F.col("_source")), "left").drop("_source")
    everything = Window.partitionBy(F.lit(0))
    total = F.sum(weight).over(everything)
    share = F.when(total > 0, F.round(F.lit(float(cycle)) * weight / total)).otherwise(F.lit(0))
    blocks = F.ceil(F.col("n") / block_rows)
    rows = rows.select("source", "n", blocks.alias("blocks"), F.greatest(share.cast("long"), least).alias("share"))
    rows = rows.select("*", F.expr("blocks div share").alias("cycles"), F.expr("blocks % share").alias("rest"))
    rows = rows.withColumn("at", F.row_number().over(everything.orderBy("source")) - 1)
    listed = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("at", "share", "cycles", "rest"))).alias("sources"))
    starts = F.expr(
        "array_sort(array_distinct(concat(array(0L), transform(sources, s -> s.cycles), transform(sources, s -> s.cycles + 1))))"
    )
    kinds = listed.select("sources", F.explode(starts).alias("start"))
    kinds = kinds.select(
        "start",
        F.expr(
            "transform(sources, s -> CASE WHEN start < s.cycles THEN s.share WHEN start = s.cycles THEN s.rest ELSE 0L END)"
        ).alias("shares"),
    ).withColumn("length", F.expr("aggregate(shares, 0L, (a, b) -> a + b)"))
    # as many rows as kinds of cycles, so one task is enough for the running total
    order = everything.orderBy("start")
    kinds = kinds.withColumn("until", F.lead("start").over(order)).where("length > 0")
    before = F.sum(F.expr("(until - start) * length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kinds = kinds.withColumn("base", F.coalesce(before, F.lit(0))).withColumn("picks", F.expr(_SCHEDULE))
    owned = kinds.select("start", "base", "length", "picks", F.posexplode("shares").alias("at", "owned")).where("owned > 0")
    owned = owned.select(
        "at",
        F.struct(
            "start", "base", "length", "owned", F.expr("filter(transform(picks, (p, i) -> CASE WHEN p = at THEN i END), i -> i IS NOT NULL)").alias("slots")
        ).alias("kind"),
    )
    kept = owned.groupBy("at").agg(F.array_sort(F.collect_list("kind")).alias("kinds"))
    plan = rows.join(kept, "at").select("source", "n", "blocks", "share", "kinds")
    last = _placed(plan.withColumn("block", F.col("blocks") - 1)).withColumn("missing", F.col("blocks") * block_rows - F.col("n"))
    return last.select(
        "source", "n", "share", "kinds", F.collect_list(F.struct("slot", "missing")).over(everything).alias("short")
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Add slot, release and deadline of ``block`` (from 0) of a source with ``share`` and ``kinds``."""
    rows = rows.withColumn("turn", F.expr("block div share")).withColumn("nth", F.expr("block % share"))
    rows = rows.withColumn("kind", F.element_at(F.filter("kinds", lambda k: k["start"] <= F.col("turn")), -1))
    begins = F.col("kind.base") + (F.col("turn") - F.col("kind.start")) * F.col("kind.length")
    return rows.select(
        "*",
        (begins + F.get(F.col("kind.slots"), F.col("nth").cast("int"))).alias("slot"),
        (begins + F.expr("(nth * kind.length) div kind.owned")).alias("release"),
        (begins + F.expr("((nth + 1) * kind.length + kind.owned - 1) div kind.owned")).alias("deadline"),
    ).drop("turn", "nth", "kind")


def _drawn(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def mixed(
    docs: DataFrame,
    weights: DataFrame | None = None,
    cycle: int = CYCLE,
    block_rows: int = BLOCK_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    whole: bool = False,
) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, position (from 0, without gaps) of every row.

    ``weights`` (source, weight) are the targets; without them they are tempered row counts.
    ``whole`` adds ``row``, a struct of all columns of ``docs``.
    """
    carried = ["row"] if whole else []
    rows = docs.select("doc_id", "source", *([F.struct(*docs.columns).alias("row")] if whole else []))
    counts = durable(rows.groupBy("source").agg(F.count("*").alias("n")))
    if counts.count() > cycle:
        raise ValueError(f"more than {cycle} sources: give a longer cycle")
    plan = durable(cycle_plan(counts, tempered(counts) if weights is None else weights, cycle, block_rows))
    # a row per source, at most ``cycle`` of them with ``cycle`` slots per kind: a bounded broadcast
    known = F.broadcast(plan.withColumnRenamed("source", "_source"))
    draw = _drawn(F.col("doc_id"))
    buckets = F.ceil(F.col("n") / bucket_rows)
    bucket = F.expr("cast(conv(substr(draw, 1, 8), 16, 10) AS bigint)") * F.col("buckets")
    drawn = (
        rows.join(F.broadcast(counts.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", draw.alias("draw"), buckets.alias("buckets"), *carried)
        .select("doc_id", "source", *carried, "draw", F.shiftright(bucket, 32).alias("bucket"))
    )
    sizes = drawn.groupBy("source", "bucket").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset")
    )
    same = drawn["source"].eqNullSafe(offsets["_source"]) & (drawn["bucket"] == offsets["_bucket"])
    within = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id")
    numbered = drawn.join(offsets, same).select(
        "doc_id", "source", *carried, (F.col("offset") + F.row_number().over(within) - 1).alias("number")
    )
    blocks = numbered.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", F.expr(f"number div {block_rows}"))
    placed = _placed(blocks)
    shortened = F.aggregate(
        F.filter("short", lambda s: s["slot"] < F.col("slot")), F.lit(0).cast("long"), lambda a, s: a + s["missing"]
    )
    position = F.col("slot") * block_rows + F.col("number") % block_rows - shortened
    return placed.select("doc_id", "source", "block", "release", "deadline", "slot", position.alias("position"), *carried)


# The same rows by one recursion over the slots of a cycle.
ORACLE = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (SELECT source, n, CAST(ceil(n / {BLOCK_ROWS}.0) AS BIGINT) AS blocks,
  greatest(CAST(round({CYCLE}.0 * pow(n, {TEMPER}) / sum(pow(n, {TEMPER})) OVER ()) AS BIGINT), 1) AS share,
  row_number() OVER (ORDER BY source NULLS FIRST) AS idx FROM counts),
plan AS (SELECT *, blocks // share AS cycles, blocks % share AS rest FROM weighted),
starts AS (SELECT 0 AS start UNION SELECT cycles FROM plan UNION SELECT cycles + 1 FROM plan),
shares AS (SELECT start, idx, CASE WHEN start < cycles THEN share WHEN start = cycles THEN rest ELSE 0 END AS b FROM starts, plan),
kinds AS (SELECT start, sum(b) AS length, list(b ORDER BY idx) AS bs FROM shares GROUP BY start),
based AS (SELECT *, coalesce(sum((until - start) * length) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM (SELECT *, lead(start) OVER (ORDER BY start) AS until FROM kinds) WHERE length > 0),
run AS (
  SELECT start, -1 AS slot, CAST(NULL AS BIGINT) AS pick, list_transform(bs, lambda x: CAST(0 AS BIGINT)) AS done FROM based
  UNION ALL
  SELECT start, slot, pick, list_transform(done, lambda d, i: CASE WHEN i = pick THEN d + 1 ELSE d END) FROM (
    SELECT r.start, r.slot + 1 AS slot, r.done, list_min(list_filter(list_transform(b.bs, lambda x, i: CASE
      WHEN r.done[i] < x AND (r.done[i] * b.length) // x <= r.slot + 1
      THEN (((r.done[i] + 1) * b.length + x - 1) // x) * 100000 + i END), lambda v: v IS NOT NULL)) % 100000 AS pick
    FROM run r JOIN based b USING (start) WHERE r.slot + 1 < b.length)),
owned AS (SELECT start, pick AS idx, slot, row_number() OVER (PARTITION BY start, pick ORDER BY slot) - 1 AS nth FROM run WHERE slot >= 0),
numbered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS number FROM documents),
blocked AS (SELECT d.doc_id, d.source, d.number, p.idx, d.number // {BLOCK_ROWS} AS block, (d.number // {BLOCK_ROWS}) // p.share AS turn,
  (d.number // {BLOCK_ROWS}) % p.share AS nth FROM numbered d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
placed AS (SELECT d.*, k.base + (d.turn - k.start) * k.length AS begins, k.length, k.start, k.bs[d.idx] AS b
  FROM blocked d ASOF JOIN based k ON d.turn >= k.start),
slotted AS (SELECT p.doc_id, p.source, p.block, p.begins + (p.nth * p.length) // p.b AS release,
  p.begins + ((p.nth + 1) * p.length + p.b - 1) // p.b AS deadline, p.begins + o.slot AS slot, p.number
  FROM placed p JOIN owned o ON o.start = p.start AND o.idx = p.idx AND o.nth = p.nth)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(release AS BIGINT) AS release, CAST(deadline AS BIGINT) AS deadline,
  CAST(slot AS BIGINT) AS slot, row_number() OVER (ORDER BY slot, number) - 1 AS position FROM slotted
"""
