"""Registered leakage queries: features of line items against price and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import leakage as L
from tablegauge.operators.order_stats import average_ranks
from tablegauge.plans.inputs import derive, with_inputs
from tablegauge.plans.rounding import rounded

PRICE = """
SELECT l_extendedprice AS price, l_quantity, l_discount, nullif(l_tax, 0.0) AS l_tax,
  ln(l_extendedprice) AS log_price, l_extendedprice AS price_copy, l_returnflag, l_linestatus,
  floor(l_extendedprice / 1000) * 1000 AS y_pred, 1.0 AS constant
FROM {lineitem}"""
RETURNED = """
SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, l_quantity, l_discount,
  nullif(l_tax, 0.0) AS l_tax, l_linestatus, l_extendedprice,
  CASE WHEN l_returnflag = 'R' THEN l_quantity * l_quantity ELSE -l_linenumber END AS status_code
FROM {lineitem}"""
FLAGS = """
SELECT l_returnflag AS flag, l_quantity, l_linestatus, ascii(l_returnflag) AS flag_code,
  CASE WHEN l_linenumber > 5 THEN NULL WHEN l_linenumber > 3 THEN 'N' ELSE l_returnflag END AS y_pred
FROM {lineitem}"""


def price(spark, folder):
    return L.LeakageTables(derive(spark, folder, PRICE), "price", ["y_pred"])


def returned(spark, folder):
    return L.LeakageTables(derive(spark, folder, RETURNED), "returned")


def flags(spark, folder):
    return L.LeakageTables(derive(spark, folder, FLAGS), "flag", ["y_pred"])


def _pairs(numbers, texts, target, text_target=False):
    parts = [
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, y FROM src WHERE {c} IS NOT NULL" for c in numbers
    ] + [
        f"SELECT '{c}', CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE), y FROM src WHERE {c} IS NOT NULL"
        for c in texts
    ]
    y = f"CAST(dense_rank() OVER (ORDER BY {target}) - 1 AS DOUBLE)" if text_target else f"CAST({target} AS DOUBLE)"
    return f"src AS (SELECT *, {y} AS y FROM input), pairs AS ({' UNION ALL '.join(parts)})"


_RANKS = """
ranked AS (SELECT feature, x, y,
  rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry
  FROM pairs)"""
_PEARSON = """
pearson AS (SELECT feature, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS c
  FROM pairs GROUP BY feature)"""
_SPEARMAN = """
spearman AS (SELECT feature, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS c
  FROM ranked GROUP BY feature)"""
_BISERIAL = """
biserial AS (SELECT feature, 2 * (sum(rx) FILTER (y = hi) - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) - 1 AS c
  FROM (SELECT *, max(y) OVER (PARTITION BY feature) AS hi FROM ranked)
  JOIN (SELECT feature, count(*) FILTER (y = m) AS n1, count(*) AS n FROM
    (SELECT feature, y, max(y) OVER (PARTITION BY feature) AS m FROM ranked) GROUP BY feature) USING (feature)
  GROUP BY feature, n1, n)"""


def _sql(source, ctes, body):
    return with_inputs("", input=source).rstrip() + ", " + ", ".join(c.strip() for c in ctes) + " " + body


_P = _pairs(
    ["l_quantity", "l_discount", "l_tax", "log_price", "price_copy", "constant"], ["l_returnflag", "l_linestatus"], "price"
)
_R = _pairs(["l_quantity", "l_discount", "l_tax", "l_extendedprice", "status_code"], ["l_linestatus"], "returned")
_F = _pairs(["l_quantity", "flag_code"], ["l_linestatus"], "flag", True)


def _best(methods, limit=10):
    union = " UNION ALL ".join(
        f"SELECT feature, c, '{m}' AS method, {i} AS p FROM {m if m != 'rank_biserial' else 'biserial'}"
        for i, m in enumerate(methods)
    )
    return (
        "SELECT feature, ROUND(c, 6) AS correlation, method FROM (SELECT *, row_number() OVER (PARTITION BY feature "
        f"ORDER BY round(abs(c), 9) DESC, p) AS r FROM ({union}) WHERE c IS NOT NULL) WHERE r = 1 "
        f"ORDER BY round(abs(c), 9) DESC, feature LIMIT {limit}"
    )


QUERIES = {
    "lkg_01_ordinal_codes": lambda s, f: price(s, f).codes(["l_returnflag", "l_linestatus"]).drop("n", "total_n"),
    "lkg_02_pearson": lambda s, f: rounded(L.pearson(price(s, f))),
    "lkg_03_average_ranks": lambda s, f: rounded(
        average_ranks(price(s, f).x_totals).groupBy("feature", "x").agg(F.max("rank").alias("rank"))
    ),
    "lkg_04_spearman": lambda s, f: rounded(L.spearman(price(s, f))),
    "lkg_05_rank_biserial": lambda s, f: rounded(L.rank_biserial(returned(s, f))),
    "lkg_06_strongest": lambda s, f: rounded(L.strongest(price(s, f))),
    "lkg_06_strongest_binary": lambda s, f: rounded(L.strongest(returned(s, f))),
    "lkg_06_strongest_labels": lambda s, f: rounded(L.strongest(flags(s, f))),
    "lkg_07_candidates": lambda s, f: L.candidate_leaks(L.strongest(price(s, f), None)).select("feature", "method"),
    "lkg_08_match_rate": lambda s, f: rounded(
        L.match_rate(derive(s, f, FLAGS), "flag", "y_pred", "multiclass_classification").unionByName(
            L.match_rate(derive(s, f, PRICE), "price", "y_pred", "regression")
        )
    ),
}
ORACLES = {
    "lkg_01_ordinal_codes": with_inputs(
        " UNION ALL ".join(
            f"SELECT DISTINCT '{c}' AS feature, {c} AS value, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS code "
            "FROM input"
            for c in ("l_returnflag", "l_linestatus")
        ),
        input=PRICE,
    ),
    "lkg_02_pearson": _sql(PRICE, [_P, _PEARSON], "SELECT feature, ROUND(c, 6) AS correlation FROM pearson"),
    "lkg_03_average_ranks": _sql(
        PRICE, [_P, _RANKS], "SELECT feature, ROUND(x, 6) AS x, ROUND(max(rx), 6) AS rank FROM ranked GROUP BY feature, x"
    ),
    "lkg_04_spearman": _sql(PRICE, [_P, _RANKS, _SPEARMAN], "SELECT feature, ROUND(c, 6) AS correlation FROM spearman"),
    "lkg_05_rank_biserial": _sql(
        RETURNED, [_R, _RANKS, _BISERIAL], "SELECT feature, ROUND(c, 6) AS correlation FROM biserial"
    ),
    "lkg_06_strongest": _sql(PRICE, [_P, _RANKS, _PEARSON, _SPEARMAN], _best(["pearson", "spearman"])),
    "lkg_06_strongest_binary": _sql(
        RETURNED, [_R, _RANKS, _PEARSON, _SPEARMAN, _BISERIAL], _best(["pearson", "spearman", "rank_biserial"])
    ),
    "lkg_06_strongest_labels": _sql(FLAGS, [_F, _RANKS, _SPEARMAN], _best(["spearman"])),
    "lkg_07_candidates": _sql(
        PRICE,
        [_P, _RANKS, _PEARSON, _SPEARMAN],
        f"SELECT feature, method FROM ({_best(['pearson', 'spearman']).partition(' LIMIT')[0]}) WHERE abs(correlation) >= 0.99",
    ),
    "lkg_08_match_rate": with_inputs(
        "SELECT count(*) AS row_count, ROUND(avg(CASE WHEN flag = y_pred THEN 1 ELSE 0 END), 6) AS match_rate, "
        "count(*) >= 50 AS trustworthy FROM flags UNION ALL SELECT count(*), ROUND(avg(CASE WHEN price = y_pred THEN 1 "
        "WHEN price IS NULL OR y_pred IS NULL THEN NULL ELSE 0 END), 6), count(*) >= 50 FROM price",
        flags=FLAGS,
        price=PRICE,
    ),
}
