"""Registered experiment statistics over counts derived from events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import experiments as X
from tablegauge.plans.inputs import derive, with_inputs
from tablegauge.plans.rounding import rounded

COUNTS = """
SELECT event_type AS series, 'arm' || (user_id % 4) AS arm, user_id % 4 AS dose,
  CAST(sum(CASE WHEN value > 50 + 4 * (user_id % 4) THEN 1 ELSE 0 END) AS BIGINT) AS k, count(*) AS n
FROM {events} GROUP BY event_type, user_id % 4"""
TWO = COUNTS.replace("% 4", "% 2")
RATINGS = """
SELECT event_type, value > 50 AS a, value > 60 OR user_id % 10 = 0 AS b,
  CASE WHEN value > 80 THEN 'A' WHEN value > 40 THEN 'B' ELSE 'C' END AS la,
  CASE WHEN value > 90 THEN 'A' WHEN value > 30 THEN 'B' ELSE 'C' END AS lb, 'same' AS s
FROM {events}"""
SHEETS = """
SELECT event_id AS script_id, value > 50 AS leak, user_id % 3 = 0 AS seed, value > 60 OR event_id % 9 = 0 AS leak_b,
  CASE WHEN event_id % 7 > 0 THEN user_id % 3 = 0 OR event_id % 5 = 0 END AS seed_b, value > 55 AS leak_k, user_id % 6 = 0 AS seed_k
FROM {events}"""
BEFORE = "SELECT DISTINCT event_id % 1000 AS run_id, event_type AS rule FROM {events} WHERE value > 60"
AFTER = "SELECT DISTINCT event_id % 1000 AS run_id, event_type AS rule FROM {events} WHERE value > 55 AND user_id % 5 > 0 OR value > 150"
REPORTS = """
SELECT doc_id AS report_id, lang AS dataset,
  'head of ' || source || chr(10) || '- early ' || source || chr(10) || '⚠ Warnings' || chr(10) || '• ' || n_chars || ' characters in'
  || chr(10) || '   language ' || lang || chr(10) || chr(10) || '• Short  Text' || chr(10) || '* short text' || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '🔧 Feature engineering' || chr(10) || '- encode ' || source || chr(10) ELSE '' END
  || '⚠ Pitfalls' || chr(10) || '- ' || CASE WHEN n_chars > 3000 THEN 'long document' ELSE 'short one' END AS text
FROM {documents}"""
PANEL = """
SELECT event_id, 'arm' || (user_id % 3) AS arm, CASE WHEN event_id % 6 = 0 THEN 'script_failed' ELSE 'completed' END AS status,
  CASE WHEN event_id % 4 > 0 THEN value / 500 END AS holdout_score, CAST(event_id % 5 AS INTEGER) AS defects,
  CASE WHEN event_id % 11 > 0 THEN value END AS seconds, CASE WHEN event_id % 3 > 0 THEN user_id * 10 END AS input_tokens,
  user_id AS output_tokens, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS no_seed, CASE WHEN value > 70 THEN 1 ELSE 0 END AS leak
FROM {events}"""
KEYS = "SELECT event_id AS id, event_type AS stratum FROM {events}"
LABELS = """
SELECT event_id AS id, 'j1' AS judge, CASE WHEN event_id % 17 = 0 THEN NULL WHEN value > 100 AND event_type IN ('view', 'click') THEN 'C' WHEN event_type IN ('view', 'click') THEN 'A'
  ELSE 'D' END AS label FROM {events}
UNION ALL SELECT event_id, 'j2', CASE WHEN event_type = 'view' THEN 'A' WHEN event_type = 'click' THEN 'B' WHEN user_id % 2 = 0 THEN 'D' ELSE 'A' END FROM {events}"""
CONTRASTS = (("X1", "arm1", True), ("X2", "arm2", True), ("X3", "arm3", True), ("X4", "arm9", True), ("X5", "arm3", False))


def counts(spark, folder):
    return derive(spark, folder, COUNTS)


def pairs(spark, folder):
    return X.arm_pairs(counts(spark, folder), ["series"], "arm0")


def contrasts(spark, folder):
    cells = counts(spark, folder)
    share = F.when(F.col("series") == "view", 1.0).otherwise(0.5)
    coverage = cells.where("arm = 'arm2'").select("series", "arm", share.alias("share"))
    return X.contrast_table(cells, ["series"], "arm0", CONTRASTS, coverage)


def _sheets(spark, folder):
    s = derive(spark, folder, SHEETS)
    pick = lambda x: s.select("script_id", F.col(f"leak{x}").alias("leak"), F.col(f"seed{x}").alias("seed"))
    return pick(""), pick("_b"), pick("_k")


def _cases(spark):
    rows = [
        (lang, f"{lang}{i}", pattern, required)
        for lang in ("de", "en", "es", "fr")
        for i, (pattern, required) in enumerate(
            [("[0-9]+ characters in language", [lang]), ("Long Document", []), ("encode src[0-2]", ["Encode"]), ("absent|nowhere", [])]
        )
    ]
    return spark.createDataFrame(rows, "dataset string, case_id string, pattern string, required array<string>")


def _truth(spark):
    rows = [("view", "true", ["A", "B"]), ("click", "true", ["A", "B"]), ("error", "false", ["C", "D"]), ("signup", "false", ["C", "D"])]
    return spark.createDataFrame(rows, "stratum string, side string, expected array<string>")


_Z2 = 1.959963984540054**2
_Z = 1.959963984540054


def _w(k, n, sign):
    bound = f"(({k}) / {n} + {_Z2 / 2} / {n} {sign} {_Z} * sqrt(({k}) / {n} * (1 - ({k}) / {n}) / {n} + {_Z2 / 4} / {n} / {n})) / (1 + {_Z2} / {n})"
    return f"greatest(0, {bound})" if sign == "-" else f"least(1, {bound})"


_PAIRS = "pairs AS (SELECT a.series, a.arm, a.k AS k1, a.n AS n1, b.k AS k2, b.n AS n2 FROM c a JOIN c b USING (series) WHERE a.arm <> 'arm0' AND b.arm = 'arm0')"


def _newcombe(src):
    return f"""diff AS (SELECT *, k1 / n1 - k2 / n2 AS d,
  greatest(-1, k1 / n1 - k2 / n2 - sqrt(power(k1 / n1 - {_w('k1', 'n1', '-')}, 2) + power({_w('k2', 'n2', '+')} - k2 / n2, 2))) AS lo,
  least(1, k1 / n1 - k2 / n2 + sqrt(power({_w('k1', 'n1', '+')} - k1 / n1, 2) + power(k2 / n2 - {_w('k2', 'n2', '-')}, 2))) AS hi FROM {src})"""


def _fisher(src):
    lc = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"
    pmf = "(" + lc.format(n="n1", k="x") + ") + (" + lc.format(n="n2", k="(k1 + k2 - x)") + ") - (" + lc.format(n="(n1 + n2)", k="(k1 + k2)") + ")"
    return f"""fis AS (SELECT *, least(1, list_sum(list_transform(list_filter(list_transform(range(greatest(0, k1 + k2 - n2), least(n1, k1 + k2) + 1),
  lambda x: {pmf}), lambda l: l <= ({pmf.replace('x)', 'k1)').replace('(x ', '(k1 ').replace('- x ', '- k1 ')}) + 1e-7), lambda l: exp(l)))) AS p FROM {src})"""


_HOLM = """holm AS (SELECT *, max(least(1, (m - r + 1) * p)) OVER (PARTITION BY {g} ORDER BY r) AS p_holm FROM
  (SELECT *, count(*) OVER (PARTITION BY {g}) AS m, row_number() OVER (PARTITION BY {g} ORDER BY p, {o}) AS r FROM {src}))"""
_VERDICT = """CASE WHEN lo >= -0.02 AND hi <= 0.02 THEN 'equivalent' WHEN NOT (lo > 0 OR hi < 0) THEN 'inconclusive'
  WHEN d <= -0.05 THEN 'contract lower' WHEN d >= 0.05 THEN 'baseline lower' ELSE 'below the bar' END"""


def _sql(body, *ctes, **inputs):
    return with_inputs("", **inputs).rstrip() + "".join(", " + c for c in ctes) + " " + body


def _kappa(a, b, group, constant):
    return (
        f"SELECT {group}, count(*) AS items, ROUND(avg(CASE WHEN {a} = {b} THEN 1 ELSE 0 END), 6) AS agreement, ROUND(CASE WHEN any_value(pe) < 1 - 1e-12 THEN "
        f"(avg(CASE WHEN {a} = {b} THEN 1 ELSE 0 END) - any_value(pe)) / (1 - any_value(pe)) ELSE {constant} END, 6) AS kappa FROM r JOIN (SELECT {group}, "
        f"sum(pa * pb) AS pe FROM (SELECT {group}, {a} AS l, count(*) / sum(count(*)) OVER (PARTITION BY {group}) AS pa FROM r GROUP BY {group}, {a}) JOIN "
        f"(SELECT {group}, {b} AS l, count(*) / sum(count(*)) OVER (PARTITION BY {group}) AS pb FROM r GROUP BY {group}, {b}) USING ({group}, l) GROUP BY {group}) USING ({group}) GROUP BY {group}"
    )


_CHI = """tot AS (SELECT series, arm, k, n, sum(k) OVER w AS kk, sum(n) OVER w AS nn, count(*) OVER w AS arms FROM c WINDOW w AS (PARTITION BY series)),
off AS (SELECT *, n * kk / nn AS e1, n - n * kk / nn AS e2, CASE WHEN arms = 2 THEN abs(k - n * kk / nn) - least(0.5, abs(k - n * kk / nn)) ELSE abs(k - n * kk / nn) END AS o FROM tot),
het AS (SELECT series, sum(o * o / e1 + o * o / e2) AS chi2, any_value(arms) - 1 AS dof, any_value(kk) AS kk, any_value(nn) AS nn FROM off GROUP BY series)"""
_CHI_P = "greatest(0, 1 - list_sum(list_transform(range(0, 600), lambda j: exp(-chi2 / 2 + (dof / 2 + j) * ln(chi2 / 2) - lgamma(dof / 2 + j + 1)))))"
_HET = (
    f"SELECT series, ROUND(chi2, 6) AS chi2, dof, ROUND(CASE WHEN chi2 <= 0 THEN 1 ELSE {_CHI_P} END, 6) AS p, ROUND(kk / nn, 6) AS pooled, "
    f"ROUND({_w('kk', 'nn', '-')}, 6) AS low, ROUND({_w('kk', 'nn', '+')}, 6) AS high FROM het"
)
_CON = ", ".join(f"('{c}', '{a}', {str(f).lower()})" for c, a, f in CONTRASTS)
_WANTED = f"""wanted AS (SELECT o.series, v.contrast, v.arm, v.in_family, o.k AS k1, o.n AS n1, b.k AS k2, b.n AS n2
  FROM c o, (VALUES {_CON}) AS v(contrast, arm, in_family) LEFT JOIN c b ON b.series = o.series AND b.arm = v.arm WHERE o.arm = 'arm0')"""
_R6 = "ROUND({0}, 6) AS {1}"

QUERIES = {
    "sta_01_wilson": lambda s, f: rounded(X.with_wilson(counts(s, f))),
    "sta_02_newcombe": lambda s, f: rounded(X.with_difference(pairs(s, f))),
    "sta_03_fisher": lambda s, f: rounded(X.with_fisher(pairs(s, f))),
    "sta_04_holm": lambda s, f: rounded(
        X.with_holm(X.with_fisher(pairs(s, f)), ["series"], ["arm"]).select("series", "arm", "p", "p_holm")
    ),
    "sta_05_trend": lambda s, f: rounded(X.trend(counts(s, f), ["series"], "dose")),
    "sta_06_heterogeneity": lambda s, f: rounded(X.heterogeneity(counts(s, f), ["series"])),
    "sta_06_heterogeneity_two_arms": lambda s, f: rounded(X.heterogeneity(derive(s, f, TWO), ["series"])),
    "sta_06_pairwise_fisher": lambda s, f: rounded(X.pairwise_fisher(counts(s, f), ["series"]).select("series", "a", "b", "p")),
    "sta_07_kappa_binary": lambda s, f: rounded(X.kappa(derive(s, f, RATINGS), ["event_type"])),
    "sta_07_kappa_labels": lambda s, f: rounded(X.kappa(derive(s, f, RATINGS), ["event_type"], "la", "lb", 1.0)),
    "sta_07_kappa_constant": lambda s, f: rounded(X.kappa(derive(s, f, RATINGS), ["event_type"], "s", "s", 1.0)),
    "sta_08_verdict": lambda s, f: X.with_difference(pairs(s, f)).select(
        "series", "arm", X.contrast_verdict(F.col("difference"), F.col("low"), F.col("high")).alias("verdict")
    ),
    "sta_09_contrasts": lambda s, f: rounded(contrasts(s, f)),
    "sta_10_label_shares": lambda s, f: rounded(X.label_shares(derive(s, f, RATINGS), ["event_type"], "la")),
    "sta_11_checklist": lambda s, f: rounded(X.checklist_accuracy(*_sheets(s, f), ["leak", "seed"])),
    "sta_12_transitions": lambda s, f: X.defect_transitions(derive(s, f, BEFORE), derive(s, f, AFTER)),
    "sta_12_net": lambda s, f: X.net_transitions(
        derive(s, f, "SELECT DISTINCT event_id % 1000 AS run_id FROM {events}"), derive(s, f, BEFORE), derive(s, f, AFTER)
    ),
    "sta_13_findings": lambda s, f: X.report_findings(derive(s, f, REPORTS)).select("report_id", "section", "finding"),
    "sta_13_matches": lambda s, f: X.match_findings(derive(s, f, REPORTS), _cases(s)),
    "sta_14_outcomes": lambda s, f: rounded(X.arm_outcomes(derive(s, f, PANEL))),
    "sta_14_rule_totals": lambda s, f: X.rule_totals(derive(s, f, PANEL), ["no_seed", "leak"], ["arm0", "arm1", "arm2"]),
    "sta_15_validity": lambda s, f: rounded(X.judge_validity(derive(s, f, KEYS), derive(s, f, LABELS), _truth(s), ["j1", "j2"])),
    "sta_15_consensus": lambda s, f: X.judge_consensus(derive(s, f, KEYS), derive(s, f, LABELS), "j1", "j2"),
}
ORACLES = {
    "sta_01_wilson": _sql(
        f"SELECT *, ROUND(k / n, 6) AS rate, ROUND({_w('k', 'n', '-')}, 6) AS low, ROUND({_w('k', 'n', '+')}, 6) AS high FROM c", c=COUNTS
    ),
    "sta_02_newcombe": _sql(
        "SELECT series, arm, k1, n1, k2, n2, ROUND(d, 6) AS difference, ROUND(lo, 6) AS low, ROUND(hi, 6) AS high FROM diff", _PAIRS, _newcombe("pairs"), c=COUNTS
    ),
    "sta_03_fisher": _sql("SELECT series, arm, k1, n1, k2, n2, ROUND(p, 6) AS p FROM fis", _PAIRS, _fisher("pairs"), c=COUNTS),
    "sta_04_holm": _sql(
        "SELECT series, arm, ROUND(p, 6) AS p, ROUND(p_holm, 6) AS p_holm FROM holm", _PAIRS, _fisher("pairs"),
        _HOLM.format(g="series", o="arm", src="fis"), c=COUNTS,
    ),
    "sta_05_trend": _sql(
        "SELECT series, ROUND(z, 6) AS z, ROUND(2 * (1 - (0.5 * (1 + sign(abs(z)) * (1 - greatest(0, 1 - list_sum(list_transform(range(0, 600), "
        "lambda j: exp(-z * z / 2 + (0.5 + j) * ln(z * z / 2) - lgamma(0.5 + j + 1)))))))) ), 6) AS p FROM (SELECT series, (sum(dose * k) - sum(k) / sum(n) * sum(dose * n)) / "
        "sqrt(sum(k) / sum(n) * (1 - sum(k) / sum(n)) * (sum(dose * dose * n) - sum(dose * n) * sum(dose * n) / sum(n))) AS z FROM c GROUP BY series)",
        c=COUNTS,
    ),
    "sta_06_heterogeneity": _sql(_HET, _CHI, c=COUNTS),
    "sta_06_heterogeneity_two_arms": _sql(_HET, _CHI, c=TWO),
    "sta_06_pairwise_fisher": _sql(
        "SELECT series, a, b, ROUND(p, 6) AS p FROM fis",
        "pairs AS (SELECT x.series, x.arm AS a, y.arm AS b, x.k AS k1, x.n AS n1, y.k AS k2, y.n AS n2 FROM c x JOIN c y USING (series) WHERE x.arm < y.arm)",
        _fisher("pairs"), c=COUNTS,
    ),
    "sta_07_kappa_binary": _sql(_kappa("a", "b", "event_type", "NULL"), r=RATINGS),
    "sta_07_kappa_labels": _sql(_kappa("la", "lb", "event_type", "1.0"), r=RATINGS),
    "sta_07_kappa_constant": _sql(_kappa("s", "s", "event_type", "1.0"), r=RATINGS),
    "sta_08_verdict": _sql(f"SELECT series, arm, {_VERDICT} AS verdict FROM diff", _PAIRS, _newcombe("pairs"), c=COUNTS),
    "sta_09_contrasts": _sql(
        "SELECT series, contrast, arm, k1, n1, k2, n2, ROUND(d, 6) AS difference, ROUND(lo, 6) AS low, ROUND(hi, 6) AS high, ROUND(p, 6) AS p, "
        f"ROUND(p_holm, 6) AS p_holm, CASE WHEN series = 'view' AND arm = 'arm2' THEN 'not interpretable' ELSE {_VERDICT} END AS verdict FROM "
        "(SELECT fis.*, p_holm FROM fis LEFT JOIN holm USING (series, contrast)) UNION ALL "
        "SELECT series, contrast, arm, k1, n1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not run' FROM wanted WHERE k2 IS NULL",
        _WANTED, "ran AS (SELECT * FROM wanted WHERE k2 IS NOT NULL)", _newcombe("ran"), _fisher("diff"),
        "family AS (SELECT * FROM fis WHERE in_family)", _HOLM.format(g="series", o="contrast", src="family"), c=COUNTS,
    ),
    "sta_10_label_shares": _sql(
        f"SELECT event_type, la, k, n, ROUND(k / n, 6) AS rate, ROUND({_w('k', 'n', '-')}, 6) AS low, ROUND({_w('k', 'n', '+')}, 6) AS high FROM "
        "(SELECT event_type, la, count(*) AS k, CAST(sum(count(*)) OVER (PARTITION BY event_type) AS BIGINT) AS n FROM r GROUP BY event_type, la)",
        r=RATINGS,
    ),
    "sta_11_checklist": _sql(
        "SELECT rule, rated, agreed, tp, fp, fn, ROUND(tp / (tp + fp), 6) AS precision, ROUND(tp / (tp + fn), 6) AS recall, kappa FROM (SELECT rule, count(*) AS rated, "
        "count(*) FILTER (a = b) AS agreed, count(*) FILTER (a = b AND a AND k) AS tp, count(*) FILTER (a = b AND NOT a AND k) AS fp, "
        "count(*) FILTER (a = b AND a AND NOT k) AS fn FROM r GROUP BY rule) JOIN (" + _kappa("a", "b", "rule", "NULL") + ") USING (rule)",
        "r AS (SELECT * FROM (SELECT script_id, 'leak' AS rule, leak AS a, leak_b AS b, leak_k AS k FROM s UNION ALL SELECT script_id, 'seed', seed, seed_b, seed_k FROM s) WHERE b IS NOT NULL)",
        s=SHEETS,
    ),
    "sta_12_transitions": _sql(
        "SELECT rule, count(*) FILTER (y IS NULL) AS fixed, count(*) FILTER (x IS NULL) AS introduced, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS persisted FROM "
        "(SELECT run_id, rule, 1 AS x FROM b) FULL JOIN (SELECT run_id, rule, 1 AS y FROM a) USING (run_id, rule) GROUP BY rule",
        b=BEFORE, a=AFTER,
    ),
    "sta_12_net": _sql(
        "SELECT CASE WHEN y > x THEN 'worse' WHEN y < x THEN 'better' ELSE 'same' END AS net, count(*) AS runs FROM (SELECT run_id, "
        "(SELECT count(*) FROM b WHERE b.run_id = r.run_id) AS x, (SELECT count(*) FROM a WHERE a.run_id = r.run_id) AS y FROM r) GROUP BY 1",
        b=BEFORE, a=AFTER, r="SELECT DISTINCT event_id % 1000 AS run_id FROM {events}",
    ),
    "sta_13_findings": "SELECT doc_id AS report_id, u.section, u.finding FROM documents, LATERAL (SELECT * FROM (VALUES ('', 'early ' || source), "
    "('warnings', n_chars || ' characters in language ' || lang), ('warnings', 'Short  Text'), "
    "('features', CASE WHEN doc_id % 2 = 0 THEN 'encode ' || source END), "
    "('pitfalls', CASE WHEN n_chars > 3000 THEN 'long document' ELSE 'short one' END)) AS t(section, finding) WHERE finding IS NOT NULL) u",
    "sta_13_matches": "SELECT doc_id AS report_id, 4 AS known, 1 + long + enc AS detected, 3 - long - enc AS missed, "
    "2 + (1 - long) + CASE WHEN doc_id % 2 = 0 THEN 1 - enc ELSE 0 END AS unverified, "
    "CASE WHEN doc_id % 2 = 0 THEN 1 - enc ELSE 0 END AS unverified_suggestions, 2 + (1 - long) AS unverified_claims FROM (SELECT *, "
    "CASE WHEN n_chars > 3000 THEN 1 ELSE 0 END AS long, CASE WHEN doc_id % 2 = 0 AND regexp_matches(source, '^src[0-2]') THEN 1 ELSE 0 END AS enc FROM documents)",
    "sta_14_outcomes": _sql(
        "SELECT arm, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'script_failed') AS failed, count(holdout_score) AS scored, "
        "count(*) FILTER (status = 'completed' AND holdout_score IS NULL) AS ran_unscored, CAST(sum(defects) AS BIGINT) AS defects, ROUND(sum(defects) / count(*), 6) AS defects_per_run, "
        "ROUND(avg(seconds), 6) AS mean_seconds, ROUND(avg(input_tokens), 6) AS mean_input_tokens, ROUND(avg(output_tokens), 6) AS mean_output_tokens, "
        "ROUND(quantile_cont(seconds, 0.5), 6) AS median_seconds FROM p GROUP BY arm",
        p=PANEL,
    ),
    "sta_14_rule_totals": _sql(
        " UNION ALL ".join(
            f"SELECT '{r}' AS rule, " + ", ".join(f"CAST(sum({r}) FILTER (arm = 'arm{i}') AS BIGINT) AS arm{i}" for i in range(3)) + " FROM p"
            for r in ("no_seed", "leak")
        ),
        p=PANEL,
    ),
    "sta_15_validity": _sql(
        f"SELECT judge, side, n, k, missing, ROUND(k / n, 6) AS rate, ROUND({_w('k', 'n', '-')}, 6) AS low, ROUND({_w('k', 'n', '+')}, 6) AS high, k >= 0.9 * n AS valid FROM "
        "(SELECT j.judge, CASE WHEN stratum IN ('view', 'click') THEN 'true' ELSE 'false' END AS side, count(*) AS n, "
        "count(*) FILTER (CASE WHEN stratum IN ('view', 'click') THEN label IN ('A', 'B') ELSE label IN ('C', 'D') END) AS k, count(*) - count(label) AS missing "
        "FROM keys CROSS JOIN (VALUES ('j1'), ('j2')) AS j(judge) LEFT JOIN labels l ON l.id = keys.id AND l.judge = j.judge WHERE stratum <> 'purchase' GROUP BY 1, 2)",
        keys=KEYS, labels=LABELS,
    ),
    "sta_15_consensus": _sql(
        "SELECT stratum, CASE WHEN a.label = b.label THEN a.label ELSE 'disagree' END AS consensus, count(*) AS items FROM keys JOIN labels a ON a.id = keys.id AND a.judge = 'j1' AND a.label IS NOT NULL "
        "JOIN labels b ON b.id = keys.id AND b.judge = 'j2' AND b.label IS NOT NULL GROUP BY 1, 2",
        keys=KEYS, labels=LABELS,
    ),
}
