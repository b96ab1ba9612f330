"""Registered drift queries: line items shipped before a date against those after."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import drift as D
from tablegauge.plans.inputs import derive, with_inputs
from tablegauge.plans.rounding import rounded

_COMMON = (
    "l_extendedprice, l_discount, l_linenumber, l_returnflag, l_linestatus, "
    "CAST(CAST(l_shipdate AS DATE) AS STRING) AS ship_text, l_shipdate"
)
REF = (
    f"SELECT l_quantity, l_tax, {_COMMON} FROM {{lineitem}} "
    "WHERE l_shipdate < TIMESTAMP '1998-01-01 00:00:00'"
)
CUR = (
    f"SELECT l_quantity * 1.5 AS l_quantity, CASE WHEN l_tax < 0 THEN l_tax END AS l_tax, {_COMMON} "
    "FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'"
)
NUMBERS = ["l_quantity", "l_tax", "l_extendedprice", "l_discount", "l_linenumber"]
TEXTS = ["l_returnflag", "l_linestatus", "ship_text"]
BINNED = ["l_quantity", "l_extendedprice", "l_discount"]
LEVELED = ["l_linenumber", "l_returnflag", "l_linestatus"]


def tables(spark, folder) -> D.DriftTables:
    return D.drift_tables(derive(spark, folder, REF), derive(spark, folder, CUR))


def _long(features, kind):
    return " UNION ALL ".join(
        f"SELECT '{side}' AS side, '{f}' AS feature, CAST({f} AS {kind}) AS v FROM {side} "
        f"WHERE {f} IS NOT NULL"
        for side in ("ref", "cur")
        for f in features
    )


_PROBS = ", ".join(f"{i / 10}" for i in range(11))
_INPUTS = {"ref": REF, "cur": CUR}
_NUM = f"num AS ({_long(BINNED, 'DOUBLE')})"
_NUM_ALL = f"num AS ({_long(NUMBERS, 'DOUBLE')})"
# l_tax has no current value, so nothing to compare
_NUM_BOTH = f"num AS ({_long([n for n in NUMBERS if n != 'l_tax'], 'DOUBLE')})"
_EDGES = f"""
edges0 AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [{_PROBS}]))) AS d
  FROM num WHERE side = 'ref' GROUP BY feature),
edges AS (SELECT feature, i, d[i] + CASE WHEN i = 1 THEN -1e-9 WHEN i = len(d) THEN 1e-9 ELSE 0 END AS e,
  len(d) - 1 AS k FROM edges0, unnest(range(1, len(d) + 1)) AS u(i))"""
_HIST = """
bins AS (SELECT a.feature, a.i AS bin, a.e AS lo, b.e AS hi, a.k FROM edges a
  JOIN edges b ON a.feature = b.feature AND b.i = a.i + 1),
hist AS (SELECT b.feature, b.bin, b.k,
  count(*) FILTER (side = 'ref') AS ref, count(*) FILTER (side = 'cur') AS cur
  FROM bins b LEFT JOIN num n ON n.feature = b.feature AND n.v >= b.lo
   AND (n.v < b.hi OR (b.bin = b.k AND n.v = b.hi)) GROUP BY b.feature, b.bin, b.k)"""
_CAT = f"""
cat AS ({_long(LEVELED, 'VARCHAR')}),
levels AS (SELECT feature, v AS level, count(*) FILTER (side = 'ref') AS ref,
  count(*) FILTER (side = 'cur') AS cur FROM cat GROUP BY feature, v)"""


def _psi(r, c):
    return (
        f"greatest(sum(((CASE WHEN {c} = 0 THEN 1e-6 ELSE {c} END) - (CASE WHEN {r} = 0 THEN 1e-6 ELSE {r} END))"
        f" * ln((CASE WHEN {c} = 0 THEN 1e-6 ELSE {c} END) / (CASE WHEN {r} = 0 THEN 1e-6 ELSE {r} END))), 0)"
    )


_SCORED = f"""
rows AS (SELECT feature, count(*) FILTER (side = 'ref') AS n_ref, count(*) FILTER (side = 'cur') AS n_cur
  FROM (SELECT * FROM num UNION ALL SELECT side, feature, 0 FROM cat) GROUP BY feature),
cells AS (SELECT feature, ref, cur FROM hist UNION ALL SELECT feature, ref, cur FROM levels),
shares AS (SELECT feature, ref / greatest(sum(ref) OVER (PARTITION BY feature), 1) AS r,
  cur / greatest(sum(cur) OVER (PARTITION BY feature), 1) AS c FROM cells),
psi AS (SELECT feature, count(*) AS k, {_psi('r', 'c')} AS psi FROM shares GROUP BY feature),
feat AS (SELECT feature, psi, (k - 1) * (1.0 / n_ref + 1.0 / n_cur) AS null_psi,
  greatest(0, psi - (k - 1) * (1.0 / n_ref + 1.0 / n_cur)) AS excess, n_ref, n_cur
  FROM psi JOIN rows USING (feature)),
sev AS (SELECT *, CASE WHEN excess < 0.1 THEN 'stable' WHEN excess < 0.2 THEN 'moderate' ELSE 'major' END AS severity
  FROM feat)"""
_KS = """
cdf AS (SELECT feature, v,
  sum(r) OVER (PARTITION BY feature ORDER BY v) / sum(r) OVER (PARTITION BY feature) AS fa,
  sum(c) OVER (PARTITION BY feature ORDER BY v) / sum(c) OVER (PARTITION BY feature) AS fb,
  sum(r) OVER (PARTITION BY feature) AS n1, sum(c) OVER (PARTITION BY feature) AS n2
  FROM (SELECT feature, v, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c
        FROM num GROUP BY feature, v)),
ks AS (SELECT feature, max(abs(fa - fb)) AS d, any_value(n1) AS n1, any_value(n2) AS n2 FROM cdf GROUP BY feature),
lam AS (SELECT feature, d, d * (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) AS lam FROM ks),
ksp AS (SELECT feature, d, greatest(0, least(1, CASE WHEN lam <= 0 THEN 1
   WHEN lam < 1 THEN 1 - sqrt(2 * pi()) / lam
     * list_sum(list_transform(range(1, 101), lambda k: exp(-power(2 * k - 1, 2) * pi() * pi() / (8 * lam * lam))))
   ELSE 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)
     * exp(-2 * power(k * lam, 2)))) END)) AS p FROM lam)"""
_CHI = """
tot AS (SELECT *, sum(ref) OVER w AS rt, sum(cur) OVER w AS ct, count(*) OVER w AS k
  FROM levels WINDOW w AS (PARTITION BY feature)),
chi AS (SELECT feature, any_value(k) - 1 AS dof,
  sum(power(ref - rt * (ref + cur) / (rt + ct), 2) / (rt * (ref + cur) / (rt + ct))
    + power(cur - ct * (ref + cur) / (rt + ct), 2) / (ct * (ref + cur) / (rt + ct))) AS stat
  FROM tot GROUP BY feature),
chip AS (SELECT feature, dof, stat, greatest(0, 1 - list_sum(list_transform(range(0, 400),
   lambda j: exp(-stat / 2 + (dof / 2 + j) * ln(stat / 2) - lgamma(dof / 2 + j + 1))))) AS p FROM chi)"""


def _sql(body, *ctes):
    head = with_inputs("", **_INPUTS).rstrip()
    return head + "".join(", " + c.strip() for c in ctes) + " " + body


def _kind_rows():
    fixed = [
        ("l_quantity", "numeric"), ("l_tax", "numeric"), ("l_extendedprice", "numeric"),
        ("l_discount", "numeric"), ("l_shipdate", "datetime"),
    ]
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{k}' AS kind" for f, k in fixed)
    texts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CASE WHEN avg(CASE WHEN length({f}) >= 8 AND regexp_matches({f}, '[-/:]') "
        f"AND TRY_CAST({f} AS DATE) IS NOT NULL THEN 1 ELSE 0 END) >= 0.95 THEN 'datetime' ELSE 'categorical' END "
        f"AS kind FROM ref"
        for f in TEXTS
    )
    return (
        f"{rows} UNION ALL {texts} UNION ALL SELECT 'l_linenumber', "
        "CASE WHEN count(DISTINCT l_linenumber) <= 10 THEN 'categorical' ELSE 'numeric' END FROM ref"
    )


def _level_rows(spark, folder):
    return rounded(D.with_chi_square_p(D.level_statistics(tables(spark, folder))))


def _features(spark, folder):
    return D.feature_drift(tables(spark, folder))


_SHORT = ["feature", "kind", "psi", "psi_null_expected", "psi_excess", "severity", "small_sample"]


def entry_query(spark, folder):
    """The flagship query: one row per feature with its drift and severity."""
    return rounded(_features(spark, folder).select(*_SHORT))


QUERIES = {
    "drf_01_align": lambda s, f: D.aligned_counts(tables(s, f)),
    "drf_02_kind": lambda s, f: D.feature_kinds(tables(s, f)).select("feature", "kind"),
    "drf_03_edges": lambda s, f: rounded(
        D.bin_edges(tables(s, f))
        .select("feature", F.posexplode("edges").alias("pos", "edge"))
    ),
    "drf_04_histogram": lambda s, f: D.histogram(tables(s, f)),
    "drf_05_levels": lambda s, f: D.level_counts(tables(s, f)),
    "drf_06_psi": lambda s, f: rounded(
        _features(s, f).where("psi IS NOT NULL").select("feature", "psi")
    ),
    "drf_07_psi_excess": lambda s, f: rounded(
        _features(s, f)
        .where("psi IS NOT NULL")
        .select("feature", "psi_null_expected", "psi_excess", "out_of_range_share"),
        8,
    ),
    "drf_08_ks": lambda s, f: rounded(
        D.ks_statistics(tables(s, f)).select("feature", "ks_stat")
    ),
    "drf_09_ks_pvalue": lambda s, f: rounded(
        D.ks_statistics(tables(s, f)).select("feature", "ks_pvalue")
    ),
    "drf_10_chi_square": lambda s, f: _level_rows(s, f).select("feature", "chi2_stat", "dof"),
    "drf_11_chi_square_pvalue": lambda s, f: _level_rows(s, f).select("feature", "chi2_pvalue"),
    "drf_12_severity": lambda s, f: _features(s, f).select("feature", "severity", "small_sample"),
    "drf_13_aggregate": lambda s, f: rounded(
        D.drift_summary(_features(s, f)).drop("status", "retrain_recommended")
    ),
    "drf_14_top": lambda s, f: rounded(D.top_drifted(_features(s, f), 3)),
    "drf_15_verdict": lambda s, f: D.drift_summary(_features(s, f)).select(
        "status", "retrain_recommended"
    ),
    "drf_16_skipped": lambda s, f: D.skipped_features(tables(s, f)),
}

_ALL_SCORED = (_NUM, _EDGES, _HIST, _CAT, _SCORED)
_KIND_CASE = "CASE WHEN feature IN ('l_linenumber', 'l_returnflag', 'l_linestatus') THEN 'categorical' ELSE 'numeric' END"
ORACLES = {
    "drf_01_align": _sql(
        "SELECT f.feature, count(*) FILTER (side = 'ref') AS ref_rows, count(*) FILTER (side = 'cur') AS cur_rows "
        "FROM everything f GROUP BY f.feature",
        f"everything AS ({_long(NUMBERS + TEXTS, 'VARCHAR')})",
    ),
    "drf_02_kind": _sql(_kind_rows()),
    "drf_03_edges": _sql(
        "SELECT feature, CAST(i - 1 AS INTEGER) AS pos, ROUND(e, 6) AS edge FROM edges", _NUM_ALL, _EDGES
    ),
    "drf_04_histogram": _sql(
        "SELECT feature, CAST(bin AS INTEGER) AS bin, ref, cur FROM hist", _NUM_ALL, _EDGES, _HIST
    ),
    "drf_05_levels": _sql("SELECT * FROM levels", _CAT),
    "drf_06_psi": _sql("SELECT feature, ROUND(psi, 6) AS psi FROM sev", *_ALL_SCORED),
    "drf_07_psi_excess": _sql(
        "SELECT feature, ROUND(null_psi, 8) AS psi_null_expected, ROUND(excess, 8) AS psi_excess, "
        "CASE WHEN feature IN ('l_quantity', 'l_extendedprice', 'l_discount') "
        "THEN ROUND(1 - inside / n_cur, 8) END AS out_of_range_share FROM sev LEFT JOIN "
        "(SELECT feature, sum(cur) AS inside FROM hist GROUP BY feature) USING (feature)",
        *_ALL_SCORED,
    ),
    "drf_08_ks": _sql("SELECT feature, ROUND(d, 6) AS ks_stat FROM ksp", _NUM_BOTH, _KS),
    "drf_09_ks_pvalue": _sql("SELECT feature, ROUND(p, 6) AS ks_pvalue FROM ksp", _NUM_BOTH, _KS),
    "drf_10_chi_square": _sql("SELECT feature, ROUND(stat, 6) AS chi2_stat, dof FROM chi", _CAT, _CHI),
    "drf_11_chi_square_pvalue": _sql(
        "SELECT feature, ROUND(p, 6) AS chi2_pvalue FROM chip", _CAT, _CHI
    ),
    "drf_12_severity": _sql(
        "SELECT feature, severity, least(n_ref, n_cur) < 30 AS small_sample FROM sev "
        "UNION ALL SELECT unnest(['l_tax', 'ship_text', 'l_shipdate']), 'skipped', false",
        *_ALL_SCORED,
    ),
    "drf_13_aggregate": _sql(
        "SELECT ROUND(avg(psi), 6) AS mean_psi, ROUND(max(psi), 6) AS max_psi, "
        "ROUND(avg(excess), 6) AS mean_psi_excess, ROUND(max(excess), 6) AS max_psi_excess, "
        "count(*) FILTER (severity = 'stable') AS n_stable, count(*) FILTER (severity = 'moderate') AS n_moderate, "
        "count(*) FILTER (severity = 'major') AS n_major FROM sev",
        *_ALL_SCORED,
    ),
    "drf_14_top": _sql(
        f"SELECT feature, ROUND(psi, 6) AS psi, severity, {_KIND_CASE} AS kind FROM sev "
        "ORDER BY sev.psi DESC, feature LIMIT 3",
        *_ALL_SCORED,
    ),
    "drf_15_verdict": _sql(
        "SELECT CASE WHEN max(excess) >= 0.2 THEN 'major_drift' WHEN avg(excess) >= 0.1 THEN 'moderate_drift' "
        "ELSE 'stable' END AS status, max(excess) >= 0.2 AS retrain_recommended FROM sev",
        *_ALL_SCORED,
    ),
    "drf_16_skipped": _sql(
        "SELECT feature, count(*) FILTER (side = 'ref') AS ref_rows, count(*) FILTER (side = 'cur') AS cur_rows "
        "FROM everything GROUP BY feature HAVING ref_rows = 0 OR cur_rows = 0",
        f"everything AS ({_long(NUMBERS + TEXTS, 'VARCHAR')})",
    ),
}
