"""Query name -> DuckDB SQL."""

from __future__ import annotations

import math

from oracles.base import (
    CLEANED, FEAT, FRAUDS, LOSS, LOSS_RAW, RATE, RAW, SCORE, SCORED, SOILED, TYPE_CODE, VALID,
    WAREHOUSE, div, mean, pct, r,
)

N = "count(*)"
F_AMT = "CASE WHEN is_fraud = 1 THEN amount END"
L_AMT = "CASE WHEN is_fraud = 0 THEN amount END"
DAY = "CASE is_weekend WHEN 1 THEN 'Weekend' ELSE 'Weekday' END"
BIG = "AS BIGINT)"


def _count(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def _txn(body: str) -> str:
    return f"{WAREHOUSE}\n{body}"


def _feat(body: str) -> str:
    return f"{FEAT}\n{body}"


def _scored(body: str) -> str:
    return f"{SCORED}\n{body}"


def _report(where: str) -> str:
    return _txn(f"""SELECT risk_tier, type, {N} AS total_count, {FRAUDS} AS fraud_count,
       {RATE} AS fraud_rate_pct, {LOSS} AS fraud_loss, {mean('amount')} AS avg_amount,
       {mean(SCORE)} AS avg_risk_score FROM txn WHERE {where} GROUP BY ALL""")


def _share(cond: str, digits: int = 4) -> str:
    return pct(_count(cond), N, digits)


def _rate_where(cond: str) -> str:
    return pct(f'sum("isFraud") FILTER (WHERE {cond})', _count(cond), 4)


def _fraud_rate_by(key: str) -> str:
    return _feat(f"""SELECT {key}, {N} AS transactions, CAST(sum("isFraud") AS BIGINT) AS fraud_count,
       {pct('sum("isFraud")', N, 4)} AS fraud_rate_pct FROM feat GROUP BY {key}""")


def _value_counts(key: str) -> str:
    return _feat(f"""SELECT {key}, {N} AS count, {pct(N, '(SELECT count(*) FROM feat)', 4)} AS pct
       FROM feat GROUP BY {key}""")


def _lift(key: str) -> str:
    share = div('sum("isFraud")', N)
    base = f"(SELECT {share} FROM feat)"
    return _feat(f"""SELECT {key}, {N} AS transactions, {r(f'{share} * 100', 4)} AS fraud_rate_pct,
       {r(f'{share} / nullif({base}, 0)', 4)} AS lift FROM feat GROUP BY {key}""")


def _histogram(value: str, bins: int) -> str:
    return _feat(f""", x AS (SELECT {value} AS x FROM feat),
  e AS (SELECT min(x) AS lo, (max(x) - min(x)) / {bins} AS w FROM x),
  c AS (SELECT CAST(least(floor((x - lo) / w), {bins - 1}) AS BIGINT) AS bin, count(*) AS n FROM x, e GROUP BY 1)
SELECT g.bin, {r('lo + g.bin * w', 6)} AS bin_start, {r('lo + (g.bin + 1) * w', 6)} AS bin_end,
       coalesce(n, 0) AS count
FROM (SELECT unnest(range({bins})) AS bin) g CROSS JOIN e LEFT JOIN c USING (bin)""")


def _percentiles(where: str) -> str:
    return _txn(f""", p AS (SELECT *, percent_rank() OVER (ORDER BY amount) AS pr,
            cume_dist() OVER (ORDER BY amount) AS cd FROM txn WHERE {where})
SELECT id, type, {r('amount', 2)} AS amount, is_fraud, risk_tier,
       {r('pr * 100', 2)} AS amount_percentile, {r('cd * 100', 2)} AS cumulative_distribution
FROM p ORDER BY p.amount DESC, id LIMIT 20""")


def _repeat(limit: str) -> str:
    return _txn(f""", l AS (SELECT *, lag(is_fraud) OVER w AS prev_is_fraud, lag(amount) OVER w AS prev_amount,
            lag(step) OVER w AS prev_step
       FROM txn WINDOW w AS (PARTITION BY name_orig ORDER BY step, id)),
  h AS (SELECT id, name_orig, step, type, CAST(amount AS DOUBLE) AS amount, is_fraud, prev_is_fraud,
        CAST(prev_amount AS DOUBLE) AS prev_amount, step - prev_step AS hours_since_last_txn
        FROM l WHERE is_fraud = 1 AND prev_is_fraud = 1
        ORDER BY hours_since_last_txn, id {limit})
SELECT * EXCLUDE (id) FROM h""")


def _above(limit: str) -> str:
    return _txn(f""", m AS (SELECT {div('sum(amount)', N)} AS m FROM txn WHERE is_fraud = 1)
SELECT id, type, {r('CAST(amount AS DOUBLE)', 2)} AS amount, risk_tier, risk_score,
       {r('m', 2)} AS avg_fraud_amount, {r('CAST(amount AS DOUBLE) / m', 2)} AS times_above_avg
FROM txn, m WHERE is_fraud = 1 AND CAST(amount AS DOUBLE) > m ORDER BY txn.amount DESC, id {limit}""")


def _text(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DECIMAL(18,{digits}))"


def _dollars(expr: str) -> str:
    return f"'$' || format('{{:,.2f}}', CAST({_text(expr, 2)} AS DOUBLE))"


RUN = """, d AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos,
              count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY score),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
        FROM d WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""

CM = """, cm AS (SELECT count(*) FILTER (WHERE label = 0 AND score <= 0.5) AS tn,
             count(*) FILTER (WHERE label = 0 AND score > 0.5) AS fp,
             count(*) FILTER (WHERE label = 1 AND score <= 0.5) AS fn,
             count(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp FROM scored)"""

ALERTS = f""", alerts AS (SELECT id, {r('score', 4)} AS fraud_probability,
       CAST(score > 0.5 AS INTEGER) AS fraud_label, label AS actual_fraud,
       CASE WHEN score <= 0 THEN NULL WHEN score <= 0.3 THEN 'Low' WHEN score <= 0.6 THEN 'Medium'
            WHEN score <= 0.85 THEN 'High' WHEN score <= 1 THEN 'Critical' END AS alert_priority
  FROM scored)"""

CORRELATED = ['amount', '"oldbalanceOrg"', '"newbalanceOrig"', '"oldbalanceDest"', '"newbalanceDest"',
              'balance_diff_orig', 'balance_diff_dest', 'zero_balance_after', 'amount_to_balance',
              'risk_score', 'hour_of_day', 'is_weekend', 'is_extreme_amount', '"isFraud"']


def _q0(z: str, n: str) -> str:
    return f"coalesce({div(z, n)}, 0)"


def _quart(col: str, p: float, where: str = "") -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return f"quantile_cont({col}, {p}){f}"


def _corr_pairs() -> str:
    rows = []
    for i, x in enumerate(CORRELATED):
        for y in CORRELATED[:i]:
            rows.append(f"SELECT '{x.strip(chr(34))}' AS x, '{y.strip(chr(34))}' AS y, "
                        f"{r(f'corr({x}, {y})', 6)} AS correlation FROM feat")
    return _feat("\nUNION ALL ".join(rows))


def _label_corr() -> str:
    rows = [f"SELECT '{x.strip(chr(34))}' AS feature, corr({x}, \"isFraud\") AS c FROM feat"
            for x in CORRELATED[:-1]]
    union = " UNION ALL ".join(rows)
    return _feat(f"""SELECT feature, {r('abs(c)', 4)} AS strength,
       CASE WHEN c > 0 THEN '+' ELSE '-' END AS direction
FROM ({union}) ORDER BY strength DESC, feature LIMIT 8""")


def _describe() -> str:
    rows = []
    for c in ['amount', '"oldbalanceOrg"', '"newbalanceOrig"', '"oldbalanceDest"', '"newbalanceDest"', 'risk_score']:
        stats = [('mean', f'avg({c})'), ('std', f'stddev_samp({c})'), ('min', f'min({c})'),
                 ('p25', _quart(c, 0.25)), ('p50', _quart(c, 0.5)), ('p75', _quart(c, 0.75)),
                 ('max', f'max({c})')]
        cells = ", ".join(f"{r(e, 2)} AS {n}" for n, e in stats)
        rows.append(f"SELECT '{c.strip(chr(34))}' AS \"column\", count({c}) AS count, {cells} FROM feat")
    return _feat("\nUNION ALL ".join(rows))


def _type_hours() -> str:
    cells = ", ".join(
        f"coalesce({_rate_where(f'hour_of_day = {h}')}, 0) AS h{h}" for h in range(24))
    return _feat(f"SELECT type, {cells} FROM feat GROUP BY type")


def _deciles() -> str:
    edges = ", ".join(f"quantile_cont(amount, {i / 10}) AS e{i}" for i in range(1, 10))
    cases = " ".join(f"WHEN amount <= e{i} THEN {i}" for i in range(1, 10))
    return _feat(f""", e AS (SELECT {edges} FROM feat),
  b AS (SELECT amount, "isFraud" AS f, CASE {cases} ELSE 10 END AS d FROM feat, e)
SELECT 'D' || d AS decile, count(*) FILTER (WHERE f = 1) AS fraud_count,
       {r('coalesce(sum(amount) FILTER (WHERE f = 1), 0) / 1e6', 6)} AS fraud_loss_millions
FROM (SELECT unnest(range(1, 11)) AS d) LEFT JOIN b USING (d) GROUP BY d""")


def _box(by: str = '"isFraud"') -> str:
    return _feat(f""", x AS (SELECT {by}, ln(1 + amount) AS x FROM feat),
  q AS (SELECT {by}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2,
               quantile_cont(x, 0.75) AS q3, count(*) AS n FROM x GROUP BY 1),
  k AS (SELECT {by}, min(x) AS lo, max(x) AS hi, count(*) AS kept FROM x JOIN q USING ({by})
        WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1)
SELECT {by}, n AS count, {r('q1', 6)} AS q1, {r('q2', 6)} AS median, {r('q3', 6)} AS q3,
       {r('least(lo, q1)', 6)} AS whisker_low, {r('greatest(hi, q3)', 6)} AS whisker_high,
       n - kept AS outliers FROM q JOIN k USING ({by})""")


def _density(by: str = '"isFraud"', points: int = 100) -> str:
    return _feat(f""", s AS (SELECT {by}, count(*) AS n, min(risk_score) AS lo, max(risk_score) AS hi,
             nullif(stddev_samp(risk_score), 0) * power(count(*), -0.2) AS h, median(risk_score) AS m
      FROM feat GROUP BY 1),
  v AS (SELECT {by}, risk_score AS v, count(*) AS c FROM feat GROUP BY 1, 2),
  g AS (SELECT *, lo + point * ((hi - lo) / {points - 1}) AS x FROM s, (SELECT unnest(range({points})) AS point))
SELECT {by}, CAST(point AS INTEGER) AS point, {r('any_value(x)', 6)} AS x,
       {r('coalesce(sum(c * exp(-0.5 * power((x - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 1)', 8)} AS density,
       {r('any_value(m)', 4)} AS median
FROM g JOIN v USING ({by}) GROUP BY {by}, point""")


def _by_account(bins: int) -> str:
    return _feat(f""", e AS (SELECT "nameOrig", count(*) AS n, CASE WHEN min(amount) = max(amount) THEN min(amount) - 0.5::DOUBLE ELSE min(amount) END AS lo,
              CASE WHEN min(amount) = max(amount) THEN 1::DOUBLE ELSE max(amount) - min(amount) END / {bins} AS w FROM feat GROUP BY 1),
  c AS (SELECT "nameOrig", CAST(least(floor((amount - lo) / w), {bins - 1}) AS BIGINT) AS bin, count(*) AS k
        FROM feat JOIN e USING ("nameOrig") GROUP BY 1, 2)
SELECT "nameOrig", bin, {r('lo + bin * w', 6)} AS bin_start, {r('lo + (bin + 1) * w', 6)} AS bin_end,
       coalesce(k, 0) AS count, {r('coalesce(k, 0) / (n * w)', 8)} AS density
FROM e CROSS JOIN (SELECT unnest(range({bins})) AS bin) LEFT JOIN c USING ("nameOrig", bin)""")


def _class_density() -> str:
    return _feat(f""", x AS (SELECT "isFraud", ln(1 + amount) AS x FROM feat),
  e AS (SELECT "isFraud", min(x) AS lo, (max(x) - min(x)) / 40 AS w, count(*) AS n FROM x GROUP BY 1),
  c AS (SELECT "isFraud", CAST(least(floor((x - lo) / w), 39) AS BIGINT) AS bin, count(*) AS k
        FROM x JOIN e USING ("isFraud") GROUP BY 1, 2)
SELECT "isFraud", bin, {r('lo + bin * w', 6)} AS bin_start, {r('lo + (bin + 1) * w', 6)} AS bin_end,
       coalesce(k, 0) AS count, {r('coalesce(k, 0) / (n * w)', 8)} AS density
FROM e CROSS JOIN (SELECT unnest(range(40)) AS bin) LEFT JOIN c USING ("isFraud", bin)""")


def _audit() -> str:
    names = ['step', 'type', 'amount', 'nameOrig', 'oldbalanceOrg', 'newbalanceOrig', 'nameDest',
             'oldbalanceDest', 'newbalanceDest', 'isFraud', 'isFlaggedFraud']
    rows = []
    for c in names:
        gone = _count(f'"{c}" IS NULL')
        rows.append(f"SELECT 'missing_count' AS \"check\", '{c}' AS subject, CAST({gone} AS DOUBLE) AS value "
                    f"FROM dirty HAVING {gone} > 0")
        rows.append(f"SELECT 'missing_pct', '{c}', {pct(gone, N, 2)} FROM dirty HAVING {gone} > 0")
    rows += [
        f"SELECT 'invalid_amounts', '', CAST({_count('amount <= 0')} AS DOUBLE) FROM dirty",
        "SELECT 'amount_outliers_q999', '', CAST(count(*) AS DOUBLE) FROM dirty "
        "WHERE amount > (SELECT quantile_cont(amount, 0.999) FROM dirty)",
        f"SELECT 'fraud_rate_pct', '', {pct('sum(\"isFraud\")', 'count(\"isFraud\")', 4)} FROM dirty",
        "SELECT 'duplicates', '', CAST((SELECT count(*) FROM dirty) - "
        "(SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS DOUBLE)",
        "SELECT 'type_distribution', type, CAST(count(*) AS DOUBLE) FROM dirty GROUP BY type",
        "SELECT 'fraud_by_type', type, CAST(count(*) AS DOUBLE) FROM dirty WHERE \"isFraud\" = 1 GROUP BY type",
    ]
    return f"{SOILED}\n" + "\nUNION ALL ".join(rows)


def _step_audit() -> str:
    return f"""{SOILED},{VALID},
  k AS (SELECT (SELECT count(*) FROM dirty) AS raw, (SELECT count(*) FROM filled) AS uniq,
               (SELECT count(*) FROM valid) AS ok, cap,
               (SELECT count(*) FROM dirty WHERE "oldbalanceDest" IS NULL) AS o,
               (SELECT count(*) FROM dirty WHERE "newbalanceDest" IS NULL) AS w,
               (SELECT count(*) FROM valid WHERE amount > cap) AS above,
               (SELECT count(*) FROM valid WHERE amount > 200000) AS extreme FROM cap)
SELECT 'fill oldbalanceDest' AS step, raw AS rows_in, raw AS rows_out, o || ' missing filled with 0.0' AS detail FROM k
UNION ALL SELECT 'fill newbalanceDest', raw, raw, w || ' missing filled with 0.0' FROM k
UNION ALL SELECT 'drop duplicates', raw, uniq, (raw - uniq) || ' removed' FROM k
UNION ALL SELECT 'drop invalid amounts', uniq, ok, (uniq - ok) || ' removed' FROM k
UNION ALL SELECT 'cap amounts', ok, ok, 'cap ' || {_text('cap', 2)} || ', ' || above || ' capped, ' || extreme || ' extreme' FROM k
UNION ALL SELECT 'encode types', ok, ok, '0 unknown' FROM k"""


KINDS = [('step', 'int'), ('type', 'string'), ('amount', 'double'), ('nameOrig', 'string'),
         ('oldbalanceOrg', 'double'), ('newbalanceOrig', 'double'), ('nameDest', 'string'),
         ('oldbalanceDest', 'double'), ('newbalanceDest', 'double'), ('isFraud', 'int'),
         ('isFlaggedFraud', 'int')]


def _info() -> str:
    return f"{SOILED}\n" + "\nUNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS \"column\", count(\"{n}\") AS non_null, '{k}' AS dtype FROM dirty"
        for i, (n, k) in enumerate(KINDS))


def _diagnostics() -> str:
    rows = ", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate(KINDS))
    return f"""{SOILED}
SELECT v.position, v."column", v.dtype, (SELECT count(*) FROM dirty) AS rows
FROM (VALUES {rows}) AS v(position, "column", dtype)"""


def _report_lines() -> str:
    legit = (_q0("tn", "tn + fn"), _q0("tn", "tn + fp"), _q0("2 * tn", "2 * tn + fn + fp"))
    fraud = (_q0("tp", "tp + fp"), _q0("tp", "fn + tp"), _q0("2 * tp", "2 * tp + fp + fn"))
    n = "tn + fp + fn + tp"

    def line(name, p, rec, f, support):
        return f"SELECT '{name}' AS class, {p} AS precision, {rec} AS recall, {f} AS f1, {support} AS support FROM cm"

    rows = [line("Legitimate", *[r(x, 4) for x in legit], "tn + fp"),
            line("Fraud", *[r(x, 4) for x in fraud], "fn + tp"),
            line("accuracy", "NULL", "NULL", r(_q0("tn + tp", n), 4), n)]
    rows.append(line("macro avg", *[r(f"({a} + {b}) / 2", 4) for a, b in zip(legit, fraud)], n))
    rows.append(line("weighted avg", *[
        r(f"({a} * (tn + fp) + {b} * (fn + tp)) / ({n})", 4) for a, b in zip(legit, fraud)], n))
    return _scored(CM + "\n" + "\nUNION ALL ".join(rows))


# Rows of the test part by class: proportional, largest remainders rounded up.
SPLIT = """, n AS (SELECT "isFraud" AS label, count(*) AS n, sum(count(*)) OVER () AS all_n
       FROM feat GROUP BY 1),
  s AS (SELECT *, ceil(all_n * 0.2) AS want, ceil(all_n * 0.2) * n / all_n AS x FROM n),
  k AS (SELECT *, CAST(floor(x) AS BIGINT) + CAST(row_number() OVER (ORDER BY x - floor(x) DESC, label)
          <= want - sum(floor(x)) OVER () AS BIGINT) AS t FROM s)
"""

PARTS = f"""{SPLIT}, parts AS (SELECT id, CASE WHEN r <= t THEN 'test' ELSE 'train' END AS part
  FROM k JOIN (SELECT id, "isFraud" AS label, row_number() OVER (
    PARTITION BY "isFraud" ORDER BY CAST('0x' || substr(md5(id || ':42'), 1, 13) AS BIGINT)) AS r FROM feat) USING (label))"""

# The model features, in their order.
FEATURES = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "balance_diff_orig",
            "balance_diff_dest", "zero_balance_after", "amount_to_balance", "balance_mismatch", "is_extreme_amount",
            "hour_of_day", "is_weekend", "type_encoded"]


def _names(names: list[str]) -> str:
    return ", ".join(f"('{n}')" for n in names)


def _train(body: str) -> str:
    return _feat(f"""{PARTS}, train AS (SELECT feat.*, {TYPE_CODE} AS type_encoded FROM feat JOIN parts USING (id) WHERE part = 'train')
{body}""")


def _draws(text: str) -> str:
    """The Poisson count, mean 1, at a hash of ``text``."""
    share = f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / CAST({1 << 52} AS DOUBLE)"
    steps, reached = [], 0.0
    for k in range(14):
        reached += math.exp(-1.0) / math.factorial(k)
        steps.append(f"CAST({share} >= {reached!r}::DOUBLE AS INTEGER)")
    return " + ".join(steps)


def _scaler() -> str:
    return _train("\nUNION ALL ".join(
        f"""SELECT '{f}' AS feature, {r(f'avg("{f}")', 4)} AS mean, {r(f'stddev_samp("{f}")', 4)} AS deviation FROM train""" for f in FEATURES))


APPENDED = f"""{RAW}, numbered AS (SELECT id AS source_id, if(step <= 372, 'early', 'late') AS batch,
       row_number() OVER (PARTITION BY step <= 372 ORDER BY step, id)
       + if(step <= 372, 0, (SELECT count(*) FROM raw WHERE step <= 372)) AS id FROM raw)"""

# The warehouse columns and types as DESCRIBE shows them.
DESCRIBED = [("id", "bigint"), ("step", "int"), ("type", "string"), ("amount", "decimal(18,2)"), ("name_orig", "string"),
             ("old_balance_orig", "decimal(18,2)"), ("new_balance_orig", "decimal(18,2)"), ("name_dest", "string"),
             ("old_balance_dest", "decimal(18,2)"), ("new_balance_dest", "decimal(18,2)"), ("is_fraud", "int"),
             ("is_flagged_fraud", "int"), ("hour_of_day", "int"), ("day_of_week", "int"), ("is_weekend", "int"),
             ("balance_diff_orig", "decimal(18,2)"), ("zero_balance_after", "int"), ("amount_to_balance", "double"),
             ("balance_mismatch", "int"), ("dest_type", "string"), ("is_extreme_amount", "int"), ("risk_score", "double"),
             ("risk_tier", "string")]

ORACLES: dict[str, str] = {
    "raw_transactions": f"{RAW}\nSELECT * FROM raw",
    "feature_table": _feat(f"SELECT *, {TYPE_CODE} AS type_encoded, {r('ln(1 + amount)', 8)} AS log_amount FROM feat"),
    "warehouse_table": _txn("SELECT * FROM txn"),
    "csv_scan": f"{SOILED}\nSELECT * FROM dirty",
    "scan_diagnostics": _diagnostics(),
    "table_info": _info(),
    "key_collisions": f"""{RAW}
SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS colliding_rows
FROM (SELECT count(*) AS n FROM (SELECT * EXCLUDE (id) FROM raw) AS x GROUP BY x)""",
    "sequence_ids": f"""{SOILED}
SELECT unnest(range(1, (SELECT count(*) + 1 FROM (SELECT DISTINCT * FROM dirty)))) AS id""",
    "clustered_layout": _txn(f"""SELECT type, {N} AS total_count, {FRAUDS} AS fraud_count
FROM txn WHERE is_fraud = 1 GROUP BY type"""),

    "appended_ids": f"{APPENDED}\nSELECT id, source_id, batch FROM numbered",
    "appended_batches": f"""{APPENDED}
SELECT batch, {N} AS rows, min(id) AS first_id, max(id) AS last_id, {N} AS stamped, {N} AS ids FROM numbered GROUP BY batch""",
    "stamped_table": _txn("SELECT *, true AS stamped FROM txn"),
    "described_table": f"SELECT * FROM (VALUES {', '.join(map(str, DESCRIBED))}) AS v(col_name, data_type)",
    "explained_report": f"""SELECT * FROM (VALUES {_names(['AdaptiveSparkPlan', 'HashAggregate', 'Exchange', 'Filter', 'Scan'])})
AS v(operator)""",

    "kpi_summary": _txn(f"""SELECT {N} AS total_transactions, {FRAUDS} AS total_fraud_count,
       {RATE} AS fraud_rate_pct, {LOSS} AS total_fraud_loss, {mean(F_AMT)} AS avg_fraud_amount,
       {mean(L_AMT)} AS avg_legit_amount, CAST(sum(is_flagged_fraud) {BIG} AS system_flagged_count,
       {pct('sum(is_flagged_fraud)', 'sum(is_fraud)', 2)} AS flag_coverage_pct FROM txn"""),
    "fraud_by_type": _txn(f"""SELECT type AS transaction_type, {N} AS total_count, {FRAUDS} AS fraud_count,
       {RATE} AS fraud_rate_pct, {LOSS} AS fraud_loss, {mean(F_AMT)} AS avg_fraud_amount,
       {pct(LOSS_RAW, 'sum(amount)', 4)} AS fraud_loss_pct_of_total FROM txn GROUP BY type"""),
    "riskiest_hours": _txn(f"""SELECT hour_of_day, {N} AS total_transactions, {FRAUDS} AS fraud_count,
       {RATE} AS fraud_rate_pct, {LOSS} AS fraud_loss FROM txn GROUP BY hour_of_day
       ORDER BY fraud_rate_pct DESC, hour_of_day LIMIT 10"""),
    "fraud_by_tier": _txn(f"""SELECT risk_tier, {N} AS total_count, {FRAUDS} AS fraud_count,
       {RATE} AS fraud_rate_pct, {mean(SCORE)} AS avg_risk_score, {LOSS} AS fraud_loss
       FROM txn GROUP BY risk_tier"""),
    "drain_analysis": _txn(f"""SELECT zero_balance_after, {N} AS transaction_count, {FRAUDS} AS fraud_count,
       {RATE} AS fraud_rate_pct, {mean('amount')} AS avg_amount, {LOSS} AS fraud_loss
       FROM txn WHERE type = 'TRANSFER' OR type = 'CASH_OUT' GROUP BY zero_balance_after"""),
    "top_fraud": _txn(f"""SELECT id, step, type, {r('amount', 2)} AS amount, name_orig AS sender_account,
       name_dest AS receiver_account, {r('old_balance_orig', 2)} AS sender_balance_before,
       {r('new_balance_orig', 2)} AS sender_balance_after, risk_score, risk_tier, hour_of_day,
       {DAY} AS day_type FROM txn WHERE is_fraud = 1 ORDER BY txn.amount DESC, id LIMIT 20"""),
    "loss_trend": _txn(f"""SELECT step AS simulation_hour, {N} AS total_transactions, {FRAUDS} AS fraud_count,
       {LOSS} AS fraud_loss, {RATE} AS fraud_rate_pct FROM txn GROUP BY step ORDER BY step LIMIT 50"""),
    "weekend_comparison": _txn(f"""SELECT {DAY} AS day_category, {N} AS total_transactions,
       {FRAUDS} AS fraud_count, {RATE} AS fraud_rate_pct, {mean(F_AMT)} AS avg_fraud_amount,
       {LOSS} AS total_fraud_loss FROM txn GROUP BY is_weekend"""),
    "flag_outcomes": _txn(f"""SELECT is_fraud, is_flagged_fraud, {N} AS count,
       CASE WHEN is_fraud = 1 AND is_flagged_fraud = 1 THEN 'True Positive (Caught!)'
            WHEN is_fraud = 1 THEN 'False Negative (MISSED!)'
            WHEN is_flagged_fraud = 1 THEN 'False Positive (False Alarm)'
            ELSE 'True Negative (Correct)' END AS outcome
       FROM txn GROUP BY is_fraud, is_flagged_fraud"""),
    "flag_precision_recall": _txn(f"""SELECT {_count('is_fraud = 1 AND is_flagged_fraud = 1')} AS true_positives,
       {_count('is_fraud = 0 AND is_flagged_fraud = 1')} AS false_positives,
       {_count('is_fraud = 1 AND is_flagged_fraud = 0')} AS false_negatives,
       {_count('is_fraud = 0 AND is_flagged_fraud = 0')} AS true_negatives,
       {pct(_count('is_fraud = 1 AND is_flagged_fraud = 1'), 'sum(is_flagged_fraud)', 2)} AS precision_pct,
       {pct(_count('is_fraud = 1 AND is_flagged_fraud = 1'), 'sum(is_fraud)', 2)} AS recall_pct FROM txn"""),

    "multi_signal": _txn(f""", s AS (SELECT *, zero_balance_after + is_extreme_amount + balance_mismatch
            + CAST(type IN ('TRANSFER', 'CASH_OUT') AS INTEGER)
            + CAST(amount_to_balance > 0.9 AS INTEGER) AS signal_count FROM txn)
SELECT risk_tier, signal_count, {N} AS transactions, {FRAUDS} AS confirmed_fraud,
       {pct('sum(is_fraud)', N, 2)} AS fraud_rate_pct, {mean(SCORE)} AS avg_risk_score
FROM s WHERE signal_count >= 3 GROUP BY risk_tier, signal_count"""),
    "hourly_running_loss": _txn(f""", h AS (SELECT hour_of_day, {LOSS_RAW} AS loss, sum(is_fraud) AS c
       FROM txn GROUP BY hour_of_day)
SELECT hour_of_day, {r('loss', 2)} AS fraud_loss, CAST(c AS BIGINT) AS hourly_fraud_count,
       {r('sum(loss) OVER (ORDER BY hour_of_day ROWS UNBOUNDED PRECEDING)', 2)} AS cumulative_fraud_loss,
       {r(div('sum(loss) OVER t', 'count(loss) OVER t'), 2)} AS rolling_3hr_avg_loss
FROM h WINDOW t AS (ORDER BY hour_of_day ROWS 2 PRECEDING)"""),
    "sender_ranking": _txn(f""", s AS (SELECT name_orig AS sender_account, {N} AS total_transactions,
       {FRAUDS} AS fraud_transactions, {r('sum(amount)', 2)} AS total_fraud_loss,
       {mean(SCORE)} AS avg_risk_score FROM txn WHERE is_fraud = 1 GROUP BY name_orig)
SELECT *, CAST(rank() OVER w AS INTEGER) AS loss_rank, CAST(dense_rank() OVER w AS INTEGER) AS loss_dense_rank,
       CAST(ntile(4) OVER (ORDER BY total_fraud_loss DESC, sender_account) AS INTEGER) AS loss_quartile
FROM s WINDOW w AS (ORDER BY total_fraud_loss DESC) ORDER BY total_fraud_loss DESC, sender_account LIMIT 20"""),
    "amount_percentiles": _percentiles("is_fraud = 1"),
    "amount_percentiles_all": _percentiles("true"),
    "repeat_fraud": _repeat("LIMIT 10"),
    "repeat_fraud_all": _repeat(""),
    "repeat_fraud_stored": _repeat("LIMIT 10"),
    "above_average_fraud": _above("LIMIT 20"),
    "above_average_fraud_all": _above(""),
    "fraud_report_critical": _report("risk_tier = 'Critical'"),
    "fraud_report_fraud": _report("is_fraud = 1"),
    "fraud_report_high_fraud": _report("risk_tier = 'High' AND is_fraud = 1"),
    "fraud_report_all": _report("true"),
    "report_function_critical": _report("risk_tier = 'Critical'"),
    "report_function_fraud": _report("is_fraud = 1"),
    "report_function_high_fraud": _report("risk_tier = 'High' AND is_fraud = 1"),
    "report_function_all": _report("true"),
    "investigation_view": _txn(f"""SELECT id AS case_id, step AS simulation_hour, type AS transaction_type,
       {r('amount', 2)} AS transaction_amount, name_orig AS sender_account, name_dest AS receiver_account,
       {r('old_balance_orig', 2)} AS sender_balance_before, {r('new_balance_orig', 2)} AS sender_balance_after,
       dest_type AS receiver_type, risk_score, risk_tier, hour_of_day, {DAY} AS day_category,
       if(zero_balance_after = 1, 'YES - Account Drained', 'No') AS account_drained,
       if(balance_mismatch = 1, 'YES - Suspicious', 'Normal') AS balance_consistency,
       is_fraud AS confirmed_fraud, is_flagged_fraud AS system_flagged
FROM txn WHERE risk_tier = 'Critical' OR risk_tier = 'High'"""),
    "fraud_counts_by_type": _txn(f"""SELECT type, {N} AS total_count, {FRAUDS} AS fraud_count
FROM txn WHERE is_fraud = 1 GROUP BY type"""),
    "executive_summary": _txn(f"""SELECT {N} AS "Total Transactions", {FRAUDS} AS "Fraud Transactions",
       CAST(sum(is_flagged_fraud) {BIG} AS "System Flagged", {_text(RATE, 4)} || '%' AS "Fraud Rate",
       {_dollars(LOSS_RAW)} AS "Total Fraud Loss", {_dollars(div(f'sum({F_AMT})', f'count({F_AMT})'))} AS "Avg Fraud Amount",
       {_dollars(f'max(coalesce({F_AMT}, 0))')} AS "Largest Fraud",
       {_count("risk_tier = 'Critical'")} AS "Critical Risk Count",
       {_text(pct(_count("risk_tier = 'Critical' AND is_fraud = 1"), _count("risk_tier = 'Critical'"), 2), 2)} || '%'
         AS "Critical Tier Fraud Rate" FROM txn"""),
    "amount_ranks": _txn(f"""SELECT id, rank() OVER a AS rank, dense_rank() OVER a AS dense_rank,
       row_number() OVER b AS row_number, CAST(ntile(4) OVER b AS INTEGER) AS ntile,
       {r('percent_rank() OVER a', 8)} AS percent_rank, {r('cume_dist() OVER a', 8)} AS cume_dist
FROM txn WINDOW a AS (ORDER BY amount), b AS (ORDER BY amount, id)"""),
    "next_transaction": _txn("""SELECT id, name_orig, step, lead(id) OVER w AS next_id, lead(step) OVER w AS next_step,
       lead(step) OVER w - step AS hours_to_next FROM txn WINDOW w AS (PARTITION BY name_orig ORDER BY step, id)"""),
    "largest_per_tier": _txn(f""", n AS (SELECT risk_tier, id, amount,
       row_number() OVER (PARTITION BY risk_tier ORDER BY amount DESC, id) AS p FROM txn)
SELECT risk_tier, id, {r('amount', 2)} AS amount, CAST(p AS INTEGER) AS place FROM n WHERE p < 4"""),

    "missing_report": f"""{SOILED}, m AS (
       SELECT 'oldbalanceDest' AS "column", {_count('"oldbalanceDest" IS NULL')} AS count, {N} AS n FROM dirty
       UNION ALL SELECT 'newbalanceDest', {_count('"newbalanceDest" IS NULL')}, {N} FROM dirty)
SELECT "column", count, {pct('count', 'n', 2)} AS pct FROM m WHERE count > 0""",
    "duplicate_rows": f"""{SOILED}
SELECT CAST(sum(n - 1) {BIG} AS duplicate_rows FROM (SELECT count(*) AS n FROM dirty GROUP BY dirty) g""",
    "invalid_amounts": f"{SOILED}\nSELECT {_count('amount <= 0')} AS invalid_amounts FROM dirty",
    "amount_outliers": f"""{SOILED}, q AS (SELECT quantile_cont(amount, 0.999) AS q FROM dirty)
SELECT {r('any_value(q)', 6)} AS quantile_value, {_count('amount > q')} AS outliers FROM dirty, q""",
    "fraud_share": f"""{SOILED}
SELECT {pct('sum("isFraud")', N, 4)} AS fraud_rate_pct FROM dirty""",
    "type_distribution": f"{SOILED}\nSELECT type, {N} AS count FROM dirty GROUP BY type",
    "fraud_type_distribution": f"{SOILED}\nSELECT type, {N} AS count FROM dirty WHERE \"isFraud\" = 1 GROUP BY type",
    "quality_audit": _audit(),
    "fill_report": f"""{SOILED}
SELECT type, {N} AS rows, {_count('coalesce("oldbalanceDest", 0) = 0')} AS zero_old,
       {_count('coalesce("newbalanceDest", 0) = 0')} AS zero_new, CAST(0 {BIG} AS missing FROM dirty GROUP BY type""",
    "learned_fills": f"""{SOILED}, g AS (SELECT CASE WHEN amount >= 1000 THEN amount END AS amount,
       CASE WHEN type <> 'DEBIT' THEN "nameDest" END AS d,
       CASE WHEN type <> 'CASH_IN' THEN step END AS s, type, "nameOrig" FROM dirty),
  f AS (SELECT quantile_cont(amount, 0.5) AS ma, quantile_cont(CAST(s AS DOUBLE), 0.5) AS ms FROM g),
  m AS (SELECT d AS md FROM g WHERE d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1)
SELECT CAST(coalesce(s, ms) AS DOUBLE) AS step, {r('coalesce(amount, ma)', 4)} AS amount,
       coalesce(d, md) AS "nameDest", type, "nameOrig" FROM g CROSS JOIN f LEFT JOIN m ON true""",
    "cleaned_table": f"{CLEANED}\nSELECT * FROM cleaned",
    "validation_report": f"""{CLEANED}
SELECT v."check", v.violations, v.violations = 0 AS passed FROM (
  SELECT 'no_missing_values' AS "check", (SELECT count(*) FROM cleaned WHERE COLUMNS(*) IS NULL) AS violations
  UNION ALL SELECT 'amounts_positive', (SELECT count(*) FROM cleaned WHERE NOT amount > 0)
  UNION ALL SELECT 'risk_score_present', 0
  UNION ALL SELECT 'types_encoded', (SELECT count(*) FROM cleaned WHERE type_encoded IS NULL)
  UNION ALL SELECT 'no_duplicate_rows',
       (SELECT count(*) FROM cleaned) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned))) v""",
    "cleaned_summary": f"""{CLEANED}
SELECT {N} AS rows, 25 AS columns, CAST(sum("isFraud") {BIG} AS fraud_rows,
       {pct('sum("isFraud")', N, 4)} AS fraud_rate_pct, {r('min(amount)', 2)} AS min_amount,
       {r('max(amount)', 2)} AS max_amount FROM cleaned""",
    "step_audit": _step_audit(),
    "unknown_types": f"{RAW}\nSELECT id, 'debit card' AS type, amount FROM raw WHERE type = 'DEBIT'",

    "describe_columns": _describe(),
    "class_distribution": _value_counts('"isFraud"'),
    "amount_histogram": _histogram("ln(1 + amount)", 50),
    "score_histogram": _histogram("risk_score", 30),
    "reference_markers": _feat(f"""SELECT {r('median(amount)', 2)} AS median_amount,
       {r('ln(1 + median(amount))', 6)} AS log_median_amount, {r('avg(risk_score)', 4)} AS mean_risk_score FROM feat"""),
    "type_counts": _value_counts("type"),
    "hour_counts": _value_counts("hour_of_day"),
    "day_counts": _feat("""SELECT d AS day_of_week, count(day_of_week) AS count,
       ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][d + 1] AS day_name
FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS d) LEFT JOIN feat ON day_of_week = d GROUP BY d"""),
    "tier_counts": _feat(f"""SELECT t AS risk_tier, count(risk_tier) AS count,
       {pct('count(risk_tier)', '(SELECT count(*) FROM feat)', 4)} AS pct
FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) AS v(t) LEFT JOIN feat ON risk_tier = t GROUP BY t"""),
    "fraud_rate_by_type": _fraud_rate_by("type"),
    "fraud_rate_by_drained": _fraud_rate_by("zero_balance_after"),
    "fraud_rate_by_hour": _fraud_rate_by("hour_of_day"),
    "fraud_rate_by_receiver": _fraud_rate_by("dest_type"),
    "tier_fraud_rate": _feat(f"""SELECT t AS risk_tier, count(risk_tier) AS transactions,
       CAST(coalesce(sum("isFraud"), 0) AS BIGINT) AS fraud_count,
       coalesce({pct('sum("isFraud")', 'count("isFraud")', 4)}, 0) AS fraud_rate_pct
FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) AS v(t) LEFT JOIN feat ON risk_tier = t GROUP BY t"""),
    "amount_box_stats": _box(),
    "score_density": _density(),
    "account_box_stats": _box('"nameOrig"'),
    "account_amount_density": _by_account(8),
    "account_score_density": _density('"nameDest"', 10),
    "correlation_pairs": _corr_pairs(),
    "top_label_correlations": _label_corr(),
    "class_amount_density": _class_density(),
    "type_hour_rates": _type_hours(),
    "decile_loss": _deciles(),
    "business_metrics": _feat(f"""SELECT {N} AS total_transactions, CAST(sum("isFraud") {BIG} AS fraud_transactions,
       {r('sum(amount) FILTER (WHERE "isFraud" = 1)', 2)} AS total_fraud_loss,
       {r('avg(amount) FILTER (WHERE "isFraud" = 1)', 2)} AS avg_fraud_amount,
       {r('avg(amount) FILTER (WHERE "isFraud" = 0)', 2)} AS avg_legit_amount,
       {r('avg(amount) FILTER (WHERE "isFraud" = 1) / avg(amount) FILTER (WHERE "isFraud" = 0)', 4)}
         AS fraud_to_legit_ratio FROM feat"""),
    "insight_summary": _feat(f"""SELECT {pct('sum("isFraud")', N, 4)} AS fraud_rate_pct,
       {_rate_where("type = 'CASH_OUT'")} AS cash_out_rate_pct, {_rate_where("type = 'TRANSFER'")} AS transfer_rate_pct,
       {_rate_where("zero_balance_after = 1")} AS drained_rate_pct,
       {_count("type = 'CASH_OUT'")} AS cash_out_count, {_share("type = 'CASH_OUT'")} AS cash_out_share_pct,
       {pct(_count("type IN ('CASH_OUT', 'TRANSFER') AND \"isFraud\" = 1"), 'sum("isFraud")', 4)}
         AS fraud_in_eligible_types_pct,
       {r('avg(amount) FILTER (WHERE "isFraud" = 1)', 2)} AS avg_fraud_amount,
       {r('avg(amount) FILTER (WHERE "isFraud" = 0)', 2)} AS avg_legit_amount,
       {_share("risk_tier = 'Low'")} AS low_share_pct, {_share("risk_tier = 'Medium'")} AS medium_share_pct,
       {_share("risk_tier = 'High'")} AS high_share_pct, {_share("risk_tier = 'Critical'")} AS critical_share_pct
FROM feat"""),
    "tier_lift": _lift("risk_tier"),
    "drained_lift": _lift("zero_balance_after"),
    "account_history": _txn(f""", w AS (SELECT name_orig AS a FROM txn GROUP BY 1 ORDER BY sum(is_fraud) DESC, 1 LIMIT 1)
SELECT id, step, type, {r('amount', 2)} AS amount, name_orig, name_dest,
       if(name_orig = a, 'sender', 'receiver') AS role FROM txn, w WHERE a IN (name_orig, name_dest)"""),
    "dashboard_measures": _txn(f"""SELECT {RATE} AS fraud_rate_pct,
       {r('sum(amount) FILTER (WHERE is_fraud = 1)', 2)} AS total_fraud_loss,
       {pct(_count('is_fraud = 1 AND is_flagged_fraud = 1'), _count('is_fraud = 1'), 2)} AS detection_rate_pct,
       {pct(_count('is_fraud = 0 AND is_flagged_fraud = 1'), _count('is_fraud = 0'), 2)} AS false_alarm_rate_pct,
       {mean(SCORE)} AS avg_risk_score,
       {r('sum(amount * CAST(risk_score AS DECIMAL(5,2))) * 0.01', 2)} AS risk_exposure FROM txn"""),

    "threshold_metrics": _scored(f"""{CM} SELECT {r(_q0('tp', 'tp + fp'), 4)} AS precision,
       {r(_q0('tp', 'tp + fn'), 4)} AS recall, {r(_q0('2 * tp', '2 * tp + fp + fn'), 4)} AS f1 FROM cm"""),
    "model_metrics": _scored(f"""{RUN}{CM},
  a AS (SELECT sum(neg * (tp - pos + pos / 2)) / any_value(CAST(p AS DOUBLE) * n) AS auc,
               sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / any_value(p) AS ap FROM c)
SELECT {r(_q0('tp', 'tp + fp'), 6)} AS precision, {r(_q0('tp', 'tp + fn'), 6)} AS recall,
       {r(_q0('2 * tp', '2 * tp + fp + fn'), 6)} AS f1, {r('auc', 6)} AS roc_auc, {r('ap', 6)} AS avg_precision
FROM cm, a"""),
    "confusion_matrix": _scored(f"""SELECT actual, predicted, count(label) AS count
FROM (VALUES (0, 'Legitimate'), (1, 'Fraud')) AS a(x, actual),
     (VALUES (0, 'Legitimate'), (1, 'Fraud')) AS p(y, predicted)
LEFT JOIN scored ON label = x AND CAST(score > 0.5 AS INTEGER) = y GROUP BY actual, predicted"""),
    "classification_report": _report_lines(),
    "roc_curve": _scored(f"""{RUN} SELECT score AS threshold, {r(div('fp', 'n'), 8)} AS fpr, {r(div('tp', 'p'), 8)} AS tpr FROM c
UNION ALL SELECT NULL, 0, 0"""),
    "pr_curve": _scored(f"""{RUN} SELECT score AS threshold, {r(div('tp', 'p'), 8)} AS recall,
       {r(div('tp', 'tp + fp'), 8)} AS precision, {r(div('p', 'p + n'), 8)} AS baseline FROM c
UNION ALL SELECT NULL, 0, 1, {r('avg(label)', 8)} FROM scored"""),
    "alert_table": _scored(f"{ALERTS} SELECT * FROM alerts"),
    "priority_counts": _scored(f"""{ALERTS} SELECT t AS alert_priority, count(alert_priority) AS count
FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) AS v(t) LEFT JOIN alerts ON alert_priority = t GROUP BY t"""),
    "priority_hit_rate": _scored(f"""{ALERTS} SELECT {N} AS urgent_rows, {_count('actual_fraud = 1')} AS urgent_fraud,
       {r(div(_count('actual_fraud = 1'), N) + ' * 100', 1)} AS urgent_fraud_pct
FROM alerts WHERE alert_priority IN ('High', 'Critical')"""),
    "split_rows": _feat(f"""{SPLIT}SELECT 'test' AS part, label, t AS rows FROM k UNION ALL SELECT 'train', label, n - t FROM k"""),
    "split_membership": _feat(f"""{SPLIT}SELECT id, CASE WHEN r <= t THEN 'test' ELSE 'train' END AS part
FROM k JOIN (SELECT id, "isFraud" AS label, row_number() OVER (
  PARTITION BY "isFraud" ORDER BY CAST('0x' || substr(md5(id || ':42'), 1, 13) AS BIGINT)) AS r FROM feat) USING (label)"""),
    "metric_agreement": f"""SELECT model, true AS roc_auc, true AS recall, true AS precision
FROM (VALUES {_names(['Logistic Regression', 'Decision Tree', 'Random Forest'])}) AS v(model)""",
    "training_matrix": _train(f"""SELECT {', '.join(f'{r(chr(34) + f + chr(34), 6)} AS {chr(34)}{f}{chr(34)}' for f in FEATURES)},
       CAST("isFraud" AS DOUBLE) AS label,
       {r('(SELECT count(*) FROM train) / CAST(2 * count(*) OVER (PARTITION BY "isFraud") AS DOUBLE)', 6)} AS weight FROM train"""),
    "scaler_figures": _scaler(),
    "importance_agreement": f"SELECT feature, true AS agrees FROM (VALUES {_names(FEATURES)}) AS v(feature)",
    "logistic_certificate": f"SELECT feature, true AS optimal FROM (VALUES {_names([*FEATURES, 'intercept'])}) AS v(feature)",
    "rule_decisions": _feat(f"{PARTS} SELECT id, 1 AS n_rules, true AS agrees FROM parts WHERE part = 'test'"),
    "leaf_rows": "SELECT true AS agrees, CAST(0 AS BIGINT) AS lost",
    "bootstrap_samples": _train(f"""SELECT CAST(tree AS INTEGER) AS tree, label, {_count('k > 0')} AS rows, CAST(sum(k) {BIG} AS draws
FROM (SELECT tree, "isFraud" AS label, {_draws("id || ':' || tree || ':42'")} AS k FROM train, (SELECT unnest(range(10)) AS tree)) GROUP BY tree, label"""),
    "stored_model_agreement": _feat(f"{PARTS} SELECT id, true AS same FROM parts WHERE part = 'test'"),
    "training_pipeline": _feat(f"""{PARTS} SELECT {_count("part = 'train'")} AS train_rows, {_count("part = 'test'")} AS test_rows,
       CAST(3 AS BIGINT) AS models, CAST(3 AS BIGINT) AS stored_models, {_count("part = 'test'")} AS scored_rows,
       CAST(sum("isFraud") FILTER (WHERE part = 'test') AS BIGINT) AS scored_fraud FROM parts JOIN feat USING (id)"""),
    "live_hourly": _feat(f"""SELECT step AS simulation_hour, {N} AS transactions, CAST(sum("isFraud") {BIG} AS fraud_count,
       CAST(sum(CASE "isFraud" WHEN 1 THEN CAST(amount AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS fraud_loss
FROM feat GROUP BY step"""),
}

ORACLES["sender_ranking_stored"] = ORACLES["sender_ranking"]
ORACLES["queue_view"] = ORACLES["investigation_view"]
