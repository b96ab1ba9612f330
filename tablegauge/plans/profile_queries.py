"""Registered profile queries over line items and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import profile as P
from tablegauge.plans.inputs import derive, table, with_inputs
from tablegauge.plans.rounding import rounded

ITEMS = """
SELECT l_quantity, l_extendedprice, l_discount, nullif(l_tax, 0.0) AS l_tax, l_linenumber,
  l_returnflag, l_linestatus, l_shipdate,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS ship_text,
  CASE WHEN l_linenumber = 7 AND l_orderkey % 10 = 0 THEN ''
       ELSE CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING) END AS cents_text,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line_id,
  CASE WHEN l_shipdate < TIMESTAMP '1998-01-01 00:00:00' THEN 1997 ELSE 1998 END AS ship_year,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS done,
  l_quantity > 25 AS bulky,
  CASE WHEN l_linenumber > 5 THEN l_quantity ELSE 0.0 END AS extra_units,
  CASE WHEN l_linenumber > 6 THEN l_quantity END AS mostly_null
FROM {lineitem}"""
CAPPED = "SELECT least(l_extendedprice, 60000.0) AS price, l_quantity FROM {lineitem}"
NUMBERS = [
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "ship_year", "done",
    "extra_units", "mostly_null",
]
TEXTS = ["l_returnflag", "l_linestatus", "ship_text", "cents_text", "line_id"]
ALL = [
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag",
    "l_linestatus", "l_shipdate", "ship_text", "cents_text", "line_id", "ship_year", "done", "bulky",
    "extra_units", "mostly_null",
]


def items(spark, folder) -> P.ProfileTables:
    return P.ProfileTables(derive(spark, folder, ITEMS))


def _types(spark, folder):
    return P.column_types(items(spark, folder))


def _only(df, kind):
    return df.where(F.col("type") == kind)


_NUMBER_SHARE = r"regexp_full_match({c}, '\s*[-+]?((\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)\s*')"
_TEXT_FACTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, count(DISTINCT {c}) AS levels, count({c}) AS present,
  avg(CASE WHEN length({c}) >= 8 AND regexp_matches({c}, '[-/:]') THEN 1 ELSE 0 END) AS shaped_share,
  avg(CASE WHEN length({c}) >= 8 AND regexp_matches({c}, '[-/:]')
      AND TRY_CAST({c} AS DATE) IS NOT NULL THEN 1 ELSE 0 END) AS date_share,
  avg(CASE WHEN {_NUMBER_SHARE.format(c=c)} THEN 1 ELSE 0 END) AS number_share,
  avg(length({c})) AS avg_length FROM items"""
    for c in TEXTS
)
_TEXT_TYPE = """CASE WHEN shaped_share >= 0.95 AND date_share >= 0.95 THEN 'datetime'
  WHEN levels <= 10 THEN 'categorical' WHEN levels >= 500 OR levels / present > 0.5 THEN 'text'
  ELSE 'categorical' END"""
_NUMBER_FACTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, count(DISTINCT {c}) AS levels, avg({c}) AS mean, stddev_samp({c}) AS std,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, quantile_cont({c}, 0.25) AS q25,
  quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75,
  avg(CASE WHEN {c} IS NULL THEN NULL WHEN {c} = 0 THEN 1 ELSE 0 END) AS zero_ratio FROM items"""
    for c in NUMBERS
)
_OUTLIERS = " UNION ALL ".join(
    f"""SELECT '{c}' AS name,
  count(*) FILTER ({c} < q25 - 1.5 * (q75 - q25) OR {c} > q75 + 1.5 * (q75 - q25)) AS iqr_count,
  count(*) FILTER (std > 0 AND abs({c} - mean) / std > 3) AS z_score_count
  FROM items, numbers WHERE name = '{c}' AND zero_ratio <= 0.5 GROUP BY name"""
    for c in NUMBERS
)


def _sql(body, **more):
    return with_inputs(body, items=ITEMS, **more)


_WITH_NUMBERS = {"numbers": _NUMBER_FACTS}
_WITH_TEXTS = {"texts": _TEXT_FACTS}
_TYPE_ROWS = (
    "SELECT name, CASE WHEN levels = 2 AND name <> 'ship_year' THEN 'categorical' ELSE 'numeric' END AS type "
    f"FROM numbers UNION ALL SELECT name, {_TEXT_TYPE} FROM texts "
    "UNION ALL SELECT 'l_shipdate', 'datetime' UNION ALL SELECT 'bulky', 'boolean'"
)
_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) - count({c}) AS missing_count, "
    f"(count(*) - count({c})) / count(*) AS missing_pct FROM items"
    for c in ALL
)
_WARN = f"""types AS ({_TYPE_ROWS}), missing AS ({_MISSING}),
profiled AS (SELECT m.name, m.missing_pct, t.type, x.number_share, x.levels, x.present, n.zero_ratio
  FROM missing m JOIN types t USING (name) LEFT JOIN texts x USING (name) LEFT JOIN numbers n USING (name)),
fired AS (SELECT name, 'mostly_missing' AS rule FROM profiled WHERE missing_pct > 0.5
  UNION ALL SELECT name, 'partly_missing' FROM profiled WHERE missing_pct > 0.1 AND missing_pct <= 0.5
  UNION ALL SELECT name, 'high_cardinality' FROM profiled WHERE type = 'categorical' AND levels > 50
  UNION ALL SELECT name, 'dirty_numeric' FROM profiled WHERE type = 'text' AND number_share >= 0.95
  UNION ALL SELECT name, 'id_like' FROM profiled WHERE type = 'text' AND levels = present
  UNION ALL SELECT name, 'sparse_numeric' FROM profiled WHERE type = 'numeric' AND zero_ratio > 0.5),
ordinals AS (SELECT unnest({ALL!r}) AS name, unnest(range(0, {len(ALL)})) AS ordinal)"""


def _narrow(spark, folder):
    return rounded(P.narrowed(P.profile(items(spark, folder)), 8), 4)


QUERIES = {
    "prf_01_missing": lambda s, f: rounded(P.missing(items(s, f))),
    "prf_02_column_types": lambda s, f: _types(s, f).select("name", "type"),
    "prf_03_year_columns": lambda s, f: _types(s, f)
    .where(F.col("base").isin("integer", "numeric"))
    .select("name", P.is_year(F.col("name"), F.col("min")).alias("is_year")),
    "prf_04_date_strings": lambda s, f: rounded(
        P.text_facts(items(s, f)).select("name", "shaped_share", "date_share")
    ),
    "prf_05_dirty_numbers": lambda s, f: rounded(
        P.text_facts(items(s, f)).select(
            "name", "number_share", (F.col("number_share") >= P.NUMBER_SHARE).alias("looks_numeric")
        )
    ),
    "prf_06_numeric_summary": lambda s, f: rounded(
        P.numeric_summary(items(s, f)).drop("zero_ratio", "sparse"), 4
    ),
    "prf_07_zero_share": lambda s, f: rounded(
        P.numeric_summary(items(s, f)).select("name", "zero_ratio", "sparse")
    ),
    "prf_08_iqr_outliers": lambda s, f: P.outliers(items(s, f)).select("name", "iqr_count"),
    "prf_09_z_outliers": lambda s, f: P.outliers(items(s, f)).select("name", "z_score_count"),
    "prf_10_top_values": lambda s, f: (
        lambda t: P.top_values(t, P.column_types(t)).select("name", "value", "n", "cardinality")
    )(items(s, f)),
    "prf_11_date_ranges": lambda s, f: P.date_ranges(_types(s, f)),
    "prf_12_boolean_counts": lambda s, f: items(s, f)
    .basics.where("base = 'boolean'")
    .select("name", "true_count", "false_count"),
    "prf_13_text_summary": lambda s, f: rounded(P.text_summary(_types(s, f))),
    "prf_14_target": lambda s, f: P.detect_target(table(s, f, "labels")).unionByName(
        P.detect_target(derive(s, f, CAPPED))
    ),
    "prf_15_task": lambda s, f: rounded(
        P.infer_task(derive(s, f, ITEMS), "l_returnflag")
        .unionByName(P.infer_task(derive(s, f, ITEMS), "done"))
        .unionByName(P.infer_task(derive(s, f, ITEMS), "l_extendedprice").drop("minority_share"), True)
    ),
    "prf_16_duplicate_rows": lambda s, f: rounded(
        P.duplicate_rows(table(s, f, "documents"), ["text", "lang"])
    ),
    "prf_17_censored_target": lambda s, f: rounded(P.censored_target(derive(s, f, CAPPED), "price")),
    "prf_18_warnings": lambda s, f: P.column_warnings(P.profile(items(s, f))).select(
        "rule", "n", F.array_join("names", ",").alias("names")
    ),
    "prf_18_table_warnings": lambda s, f: P.table_warnings(derive(s, f, CAPPED), "price").select("rule", "n"),
    "prf_19_narrowed": _narrow,
}

ORACLES = {
    "prf_01_missing": _sql(f"SELECT name, missing_count, ROUND(missing_pct, 6) AS missing_pct FROM ({_MISSING})"),
    "prf_02_column_types": _sql(_TYPE_ROWS, **_WITH_NUMBERS, **_WITH_TEXTS),
    "prf_03_year_columns": _sql(
        "SELECT name, regexp_matches(lower(name), 'year|yr') AND min >= 1800 AND min <= 2200 AS is_year FROM numbers",
        **_WITH_NUMBERS,
    ),
    "prf_04_date_strings": _sql(
        "SELECT name, ROUND(shaped_share, 6) AS shaped_share, ROUND(date_share, 6) AS date_share FROM texts",
        **_WITH_TEXTS,
    ),
    "prf_05_dirty_numbers": _sql(
        "SELECT name, ROUND(number_share, 6) AS number_share, number_share >= 0.95 AS looks_numeric FROM texts",
        **_WITH_TEXTS,
    ),
    "prf_06_numeric_summary": _sql(
        "SELECT name, ROUND(mean, 4) AS mean, ROUND(std, 4) AS std, ROUND(min, 4) AS min, ROUND(max, 4) AS max, "
        "ROUND(q25, 4) AS q25, ROUND(q50, 4) AS q50, ROUND(q75, 4) AS q75 FROM numbers",
        **_WITH_NUMBERS,
    ),
    "prf_07_zero_share": _sql(
        "SELECT name, ROUND(zero_ratio, 6) AS zero_ratio, zero_ratio > 0.5 AS sparse FROM numbers", **_WITH_NUMBERS
    ),
    "prf_08_iqr_outliers": _sql(f"SELECT name, iqr_count FROM ({_OUTLIERS})", **_WITH_NUMBERS),
    "prf_09_z_outliers": _sql(f"SELECT name, z_score_count FROM ({_OUTLIERS})", **_WITH_NUMBERS),
    "prf_10_top_values": _sql(
        "SELECT name, value, n, cardinality FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS r, "
        "count(*) OVER (PARTITION BY name) AS cardinality FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM items GROUP BY {c}"
            for c in ("l_returnflag", "l_linestatus", "done")
        )
        + ")) WHERE r <= 5"
    ),
    "prf_11_date_ranges": _sql(
        "SELECT 'l_shipdate' AS name, strftime(min(l_shipdate), '%Y-%m-%d') AS range_min, "
        "strftime(max(l_shipdate), '%Y-%m-%d') AS range_max, 0 AS unparsed_count FROM items UNION ALL "
        "SELECT 'ship_text', min(ship_text), max(ship_text), count(*) FILTER (TRY_CAST(ship_text AS DATE) IS NULL) FROM items"
    ),
    "prf_12_boolean_counts": _sql(
        "SELECT 'bulky' AS name, count(*) FILTER (bulky) AS true_count, count(*) FILTER (NOT bulky) AS false_count FROM items"
    ),
    "prf_13_text_summary": _sql(
        "SELECT name, ROUND(avg_length, 6) AS avg_length, levels AS cardinality, number_share >= 0.95 AS looks_numeric, "
        f"levels = present AS looks_like_id FROM texts WHERE ({_TEXT_TYPE}) = 'text'",
        **_WITH_TEXTS,
    ),
    "prf_14_target": "SELECT CASE WHEN count(DISTINCT toxic) <= 10 THEN 'toxic' END AS column, "
    "CASE WHEN count(DISTINCT toxic) <= 10 THEN 'low' ELSE 'none' END AS confidence FROM labels "
    "UNION ALL SELECT 'price', 'high'",
    "prf_15_task": _sql(
        " UNION ALL ".join(
            f"SELECT CASE WHEN {num} AND count(*) > 10 THEN 'regression' WHEN count(*) = 2 THEN 'binary_classification' "
            "WHEN count(*) BETWEEN 3 AND 20 THEN 'multiclass_classification' ELSE 'unknown' END AS task, "
            f"count(*) AS levels, {share} AS minority_share FROM (SELECT {c}, count(*) AS n FROM items GROUP BY {c})"
            for c, num, share in (
                ("l_returnflag", "false", "ROUND(min(n) / sum(n), 6)"),
                ("done", "true", "ROUND(min(n) / sum(n), 6)"),
                ("l_extendedprice", "true", "NULL"),
            )
        )
    ),
    "prf_16_duplicate_rows": "SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicates, "
    "ROUND(sum(c - 1) / sum(c), 6) AS share, sum(c - 1) / sum(c) >= 0.005 AND sum(c - 1) > 0 AS flagged "
    "FROM (SELECT text, lang, count(*) AS c FROM documents GROUP BY text, lang)",
    "prf_17_censored_target": with_inputs(
        " UNION ALL ".join(
            f"SELECT '{b}' AS bound, bound_value AS value, at_bound AS rows_at_bound, ROUND(at_bound / total, 6) AS share, "
            f"levels >= 20 AND at_bound / total >= 0.01 AS flagged FROM (SELECT {fn}(price) AS bound_value, count(*) AS total, "
            f"count(DISTINCT price) AS levels, count(*) FILTER (price = (SELECT {fn}(price) FROM capped)) AS at_bound FROM capped)"
            for b, fn in (("minimum", "min"), ("maximum", "max"))
        ),
        capped=CAPPED,
    ),
    "prf_18_warnings": _sql(
        "SELECT rule, count(*) AS n, array_to_string(list(name ORDER BY ordinal), ',') AS names "
        "FROM fired JOIN ordinals USING (name) GROUP BY rule",
        **_WITH_NUMBERS, **_WITH_TEXTS,
    ).replace(" SELECT rule, count", f", {_WARN} SELECT rule, count", 1),
    "prf_18_table_warnings": with_inputs(
        "SELECT 'duplicate_rows' AS rule, CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT price, l_quantity, count(*) AS c "
        "FROM capped GROUP BY ALL) HAVING sum(c - 1) / sum(c) >= 0.005 AND sum(c - 1) > 0 UNION ALL "
        "SELECT 'censored_maximum', count(*) FROM capped WHERE price = (SELECT max(price) FROM capped) "
        "HAVING count(*) >= 0.01 * (SELECT count(*) FROM capped) UNION ALL "
        "SELECT 'censored_minimum', count(*) FROM capped WHERE price = (SELECT min(price) FROM capped) "
        "HAVING count(*) >= 0.01 * (SELECT count(*) FROM capped)",
        capped=CAPPED,
    ),
    "prf_19_narrowed": _sql(
        "SELECT CAST(o.ordinal AS INTEGER) AS ordinal, o.name, t.type, m.missing_count, ROUND(m.missing_pct, 4) AS missing_pct, "
        "CASE WHEN t.type IN ('categorical', 'text') THEN coalesce(x.levels, n.levels) END AS cardinality, "
        + ", ".join(
            f"CASE WHEN t.type = 'numeric' THEN ROUND(n.{c}, 4) END AS {c}"
            for c in ("zero_ratio", "mean", "std", "min", "max", "q25", "q50", "q75")
        )
        + ", iqr_count, z_score_count FROM ordinals o JOIN types t USING (name) JOIN missing m USING (name) "
        f"LEFT JOIN numbers n USING (name) LEFT JOIN texts x USING (name) LEFT JOIN ({_OUTLIERS}) z USING (name) "
        "WHERE o.ordinal < 8",
        **_WITH_NUMBERS, **_WITH_TEXTS,
    ).replace(" SELECT CAST(o.ordinal", f", {_WARN} SELECT CAST(o.ordinal", 1),
}
