"""DuckDB SQL for the registered queries, written from their definitions and independent of the operators' code."""

from __future__ import annotations

_RAW = """
first_supplier AS (SELECT l_orderkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY l_orderkey),
raw0 AS (SELECT *, CASE left(o_orderpriority, 1) WHEN '1' THEN 'CASH_IN' WHEN '2' THEN 'CASH_OUT' WHEN '3' THEN 'DEBIT' WHEN '4' THEN 'PAYMENT' WHEN '5' THEN 'TRANSFER' END AS kind
  FROM orders JOIN first_supplier ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = suppkey JOIN customer ON c_custkey = o_custkey),
raw AS (SELECT CAST(date_diff('hour', TIMESTAMP '1992-01-01', o_orderdate) AS INTEGER) AS step, kind AS type, o_totalprice AS amount, 'C' || o_custkey AS "nameOrig", c_acctbal AS "oldbalanceOrg",
  CASE WHEN kind = 'CASH_IN' THEN c_acctbal + o_totalprice ELSE greatest(c_acctbal - o_totalprice, 0.0) END + CASE WHEN o_orderkey % 7 = 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS "newbalanceOrig",
  'S' || s_suppkey AS "nameDest", s_acctbal AS "oldbalanceDest", s_acctbal + o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS "newbalanceDest",
  CAST(o_orderstatus = 'F' AS INTEGER) AS "isFraud", CAST(o_orderkey % 97 = 0 AS INTEGER) AS "isFlaggedFraud" FROM raw0)"""
_CANON = f"""{_RAW},
canon AS (SELECT sha256(step::VARCHAR || '||' || type || '||' || amount::VARCHAR || '||' || "nameOrig" || '||' || "nameDest") AS transaction_id, TIMESTAMP '2026-01-01' + to_hours(step) AS "timestamp", type AS transaction_type,
  "nameOrig" AS origin_account_id, "nameDest" AS destination_account_id, amount, "oldbalanceOrg" AS origin_balance_before, "newbalanceOrig" AS origin_balance_after,
  "oldbalanceDest" AS destination_balance_before, "newbalanceDest" AS destination_balance_after, "isFraud" AS is_fraud, "isFlaggedFraud" AS is_flagged_fraud FROM raw),
ruled AS (SELECT *, least(origin_balance_before, origin_balance_after, destination_balance_before, destination_balance_after) < 0 AS negative,
  CASE WHEN transaction_type = 'CASH_IN' THEN abs(origin_balance_after - (origin_balance_before + amount)) > 1e-6 ELSE abs(origin_balance_after - greatest(origin_balance_before - amount, 0.0)) > 1e-6 END AS origin_bad,
  transaction_type IN ('CASH_IN', 'PAYMENT', 'TRANSFER') AND abs(destination_balance_after - (destination_balance_before + amount)) > 1e-6 AS destination_bad FROM canon)"""
_AMOUNT = """round(ln(1 + amount), 9) AS amount_log, CASE WHEN origin_balance_before > 0 THEN amount / origin_balance_before ELSE 0.0 END AS amount_to_origin_balance_ratio,
  CASE WHEN destination_balance_before > 0 THEN amount / destination_balance_before ELSE 0.0 END AS amount_to_destination_balance_ratio"""
_BALANCE = """origin_balance_after - origin_balance_before AS origin_balance_delta, destination_balance_after - destination_balance_before AS destination_balance_delta,
  CASE WHEN origin_balance_before > 0 THEN (origin_balance_after - origin_balance_before) / origin_balance_before ELSE 0.0 END AS origin_balance_change_ratio,
  CASE WHEN destination_balance_before > 0 THEN (destination_balance_after - destination_balance_before) / destination_balance_before ELSE 0.0 END AS destination_balance_change_ratio,
  CAST(origin_bad AS INTEGER) AS origin_balance_mismatch, CAST(destination_bad AS INTEGER) AS destination_balance_mismatch,
  CAST(origin_balance_before = 0 AS INTEGER) AS is_zero_origin_balance_before, CAST(destination_balance_before = 0 AS INTEGER) AS is_zero_destination_balance_before,
  CAST(origin_balance_after = 0 AS INTEGER) AS origin_balance_depleted, CAST(destination_balance_after > destination_balance_before AS INTEGER) AS destination_balance_increased"""
_TYPES = ", ".join(f"CAST(transaction_type = '{t}' AS INTEGER) AS is_{t.lower()}" for t in ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"))
_CALENDAR = 'CAST(hour("timestamp") AS INTEGER) AS transaction_hour, CAST(dayofweek("timestamp") + 1 AS INTEGER) AS transaction_day_of_week'


def _behavior(origin: str, time: str, amount: str, destination: str) -> str:
    over = lambda s: f"OVER (PARTITION BY {origin} ORDER BY (epoch_us({time}) // 1000000) RANGE BETWEEN {s} PRECEDING AND 1 PRECEDING)"
    return f"""CAST(count(*) {over(3600)} AS INTEGER) AS transactions_last_1h, CAST(count(*) {over(86400)} AS INTEGER) AS transactions_last_24h,
  round(coalesce(sum({amount}) {over(86400)}, 0.0), 6) AS amount_sum_last_24h, CAST(count(DISTINCT {destination}) {over(2592000)} AS INTEGER) AS unique_destinations_last_30d"""


_ORDERS = """o AS (SELECT o_orderkey::VARCHAR AS transaction_id, o_orderdate AS "timestamp", o_totalprice AS amount, CAST(o_orderstatus = 'F' AS INTEGER) AS is_fraud FROM orders)"""
_SPLIT = f"""{_ORDERS}, numbered AS (SELECT *, row_number() OVER (ORDER BY "timestamp", transaction_id) AS k, count(*) OVER () AS n FROM o),
parts AS (SELECT *, CASE WHEN k <= CAST(floor(n * 0.70) AS BIGINT) THEN 'train' WHEN k <= CAST(floor(n * 0.70) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM numbered)"""
_HASHED = f"""{_ORDERS}, hashed AS (SELECT *, sha256(transaction_id || '||42') AS h, count(*) OVER () AS n, sum(is_fraud) OVER () AS p FROM o)"""
_SCORES = """s AS (SELECT 'alpha' AS model, CAST(event_id % 7 = 0 AS INTEGER) AS label, least(value / 400.0::DOUBLE, 1.0::DOUBLE) AS score FROM events
  UNION ALL SELECT 'beta', CAST(event_id % 7 = 0 AS INTEGER), CAST(event_id * 37 % 1000 AS DOUBLE) / 1000.0::DOUBLE FROM events)"""


def _sweep(thresholds: str) -> str:
    return f"""{_SCORES}, ts AS (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS threshold),
c AS (SELECT model, threshold, count(*) AS row_count, count(*) FILTER (score < threshold AND label = 0) AS true_negatives, count(*) FILTER (score >= threshold AND label = 0) AS false_positives,
  count(*) FILTER (score < threshold AND label = 1) AS false_negatives, count(*) FILTER (score >= threshold AND label = 1) AS true_positives, avg((score - label) * (score - label)) AS brier FROM s, ts WHERE {thresholds} GROUP BY model, threshold),
sweep AS (SELECT *, coalesce(true_positives / nullif(true_positives + false_positives, 0)::DOUBLE, 0) AS prec, coalesce(true_positives / nullif(true_positives + false_negatives, 0)::DOUBLE, 0) AS rec,
  coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0)::DOUBLE, 0) AS f, (true_positives + false_positives) / row_count::DOUBLE AS alert, false_positives * 1.0::DOUBLE + false_negatives * 5.0::DOUBLE AS expected_cost FROM c)"""


_METRICS = "row_count, true_negatives, false_positives, false_negatives, true_positives, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f, 6) AS f1, round(brier, 6) AS brier_score, round(alert, 6) AS alert_rate"


def _auc(rows: str, by: str) -> str:
    return f"""g AS (SELECT {by}, score, count(*) AS n, sum(label) AS tp FROM {rows} GROUP BY {by}, score),
k AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ctp, sum(tp) OVER (PARTITION BY {by}) AS pos, sum(n) OVER (PARTITION BY {by}) AS tot FROM g WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
auc AS (SELECT {by}, sum((n - tp) * (ctp - tp) + (n - tp) * tp / 2.0::DOUBLE) / nullif(max(pos * (tot - pos)), 0)::DOUBLE AS roc_auc, sum(tp * ctp / cn::DOUBLE) / nullif(max(pos), 0)::DOUBLE AS pr_auc FROM k GROUP BY {by})"""


_BINS = f"""{_SCORES}, edges AS (SELECT i AS bin, i * 0.1::DOUBLE AS lower, CASE WHEN i = 9 THEN 1.0::DOUBLE ELSE (i + 1) * 0.1::DOUBLE END AS upper FROM (SELECT unnest(range(0, 10)) AS i)),
bins AS (SELECT m.model, bin, lower, upper, count(score) AS row_count, coalesce(avg(score), 0) AS mp, coalesce(avg(label), 0) AS rate FROM (SELECT DISTINCT model FROM s) m CROSS JOIN edges LEFT JOIN s ON s.model = m.model AND score >= lower AND (score < upper OR bin = 9 AND score <= upper) GROUP BY m.model, bin, lower, upper)"""
_EVENTS = """p AS (SELECT event_id::VARCHAR AS feedback_id, ts AS event_time, CASE WHEN user_id % 3 = 0 THEN 'risk' ELSE 'risk model' END AS model_name, 'v' || (user_id % 2) AS model_version, 'pre-transaction-v1' AS feature_contract_version,
  least(value / 400.0::DOUBLE, 1.0::DOUBLE) AS risk_score, 0.25::DOUBLE AS decision_threshold FROM events),
l AS (SELECT event_id::VARCHAR AS feedback_id, CAST(event_id % 2 AS INTEGER) AS label, ts + to_days(CAST(event_id % 10 - 1 AS INTEGER)) AS label_time FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT 'x' || event_id, 1, ts FROM events WHERE event_id % 50 = 0)"""
_LABELLED = f"""{_EVENTS}, j AS (SELECT p.*, l.label, l.label_time FROM p LEFT JOIN l ON l.feedback_id = p.feedback_id AND l.label_time >= p.event_time)"""
_SEG = "model_name, model_version, feature_contract_version"
_BALANCES = "origin_balance_before, origin_balance_after, destination_balance_before, destination_balance_after"


def _violations(flag: str) -> str:
    return f"WITH {_CANON} SELECT transaction_id, transaction_type, amount, {_BALANCES} FROM ruled WHERE {flag}"


def _psi() -> str:
    def one(name: str, edges: str, n: int) -> str:
        return f"""SELECT '{name}' AS feature, b.i AS bin, {n} AS k, count(e.side) FILTER (e.side = 0) AS r, count(e.side) FILTER (e.side = 1) AS c FROM (SELECT unnest(range(0, {n})) AS i) b
  LEFT JOIN (SELECT CAST(ts >= '2024-01-16' AS INTEGER) AS side, len(list_filter([{edges}], lambda x: {name} >= x)) AS place FROM events) e ON e.place = b.i GROUP BY b.i"""

    return f"""WITH counts AS ({one("value", "10.0, 25.0, 50.0, 100.0, 200.0", 6)} UNION ALL {one("user_id", "5.0, 50.0, 500.0", 4)}),
shares AS (SELECT feature, (r + 0.5::DOUBLE) / (sum(r) OVER f + 0.5 * k) AS rs, (c + 0.5::DOUBLE) / (sum(c) OVER f + 0.5 * k) AS cs FROM counts WINDOW f AS (PARTITION BY feature))
SELECT feature, round(sum((cs - rs) * ln(cs / rs)), 6) AS psi FROM shares GROUP BY feature"""


_SPLIT_SCORES = """numbered AS (SELECT *, row_number() OVER (ORDER BY ts, event_id::VARCHAR) AS k, count(*) OVER () AS n FROM events),
parts AS (SELECT *, CASE WHEN k <= floor(n * 0.70) THEN 'train' WHEN k <= floor(n * 0.70) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM numbered),
s AS (SELECT split || '_alpha' AS model, CAST(event_id % 7 = 0 AS INTEGER) AS label, least(value / 400.0::DOUBLE, 1.0::DOUBLE) AS score FROM parts WHERE split <> 'train'
  UNION ALL SELECT split || '_beta', CAST(event_id % 7 = 0 AS INTEGER), (event_id * 37 % 1000) / 1000.0::DOUBLE FROM parts WHERE split <> 'train')"""


def _segment_drift() -> str:
    cuts = {"amount": ("amount", "10.0, 25.0, 50.0, 100.0, 200.0", 6), "hour": ("hour", "6.0, 12.0, 18.0", 4), "risk_score": ("risk_score", "0.1, 0.2, 0.4", 4)}
    long = " UNION ALL ".join(f"SELECT {_SEG}, cur, '{f}' AS feature, {n} AS k, len(list_filter([{e}]::DOUBLE[], lambda x: {c} >= x)) AS bin, isinf({c}) AS odd FROM x" for f, (c, e, n) in cuts.items())
    return f"""WITH {_EVENTS}, x AS (SELECT p.*, e.ts >= '2024-01-16' AS cur, (event_id % 24)::DOUBLE AS hour, CASE WHEN model_name = 'risk model' AND model_version = 'v0' AND event_id % 100 = 0 THEN 'inf'::DOUBLE ELSE value END AS amount FROM p JOIN events e ON p.feedback_id = e.event_id::VARCHAR),
y AS ({long}), refs AS (SELECT 'risk' AS reference_model, 'v1' AS reference_version UNION ALL SELECT 'risk model', 'v0'),
seg AS (SELECT {_SEG}, feature, k, count(*) AS nc, bool_or(odd) AS odd FROM y WHERE cur GROUP BY ALL), whole AS (SELECT {_SEG}, bool_or(odd) AS odd, max(nc) AS n FROM seg GROUP BY ALL),
c AS (SELECT {_SEG}, feature, bin, count(*) AS c FROM y WHERE cur GROUP BY ALL), r AS (SELECT model_name, model_version, feature, bin, count(*) AS r FROM y WHERE NOT cur GROUP BY ALL),
t AS (SELECT model_name, model_version, feature, sum(r) AS nr FROM r GROUP BY ALL), bins AS (SELECT unnest(range(0, 6)) AS bin),
grid AS (SELECT reference_model, s.model_name, s.model_version, s.feature_contract_version, s.feature, (coalesce(c, 0) + 0.5::DOUBLE) / (nc + 0.5 * k) AS cs, (coalesce(r, 0) + 0.5::DOUBLE) / (nr + 0.5 * k) AS rs
  FROM seg s JOIN bins b ON b.bin < k JOIN refs f ON true LEFT JOIN c ON c.model_name = s.model_name AND c.model_version = s.model_version AND c.feature = s.feature AND c.bin = b.bin
  LEFT JOIN r ON r.model_name = reference_model AND r.model_version = reference_version AND r.feature = s.feature AND r.bin = b.bin JOIN t ON t.model_name = reference_model AND t.model_version = reference_version AND t.feature = s.feature),
psis AS (SELECT reference_model, {_SEG}, feature, sum((cs - rs) * ln(cs / rs)) AS psi FROM grid GROUP BY ALL),
told AS (SELECT reference_model, {_SEG}, feature, psi, CASE WHEN model_name <> reference_model OR model_version <> reference_version THEN 'skipped_reference_model_mismatch' WHEN n < 2 THEN 'insufficient_current_rows' WHEN odd THEN 'failed' ELSE 'generated' END AS drift_status
  FROM psis JOIN refs USING (reference_model) JOIN whole USING ({_SEG}))
SELECT reference_model, {_SEG}, feature, drift_status, CASE WHEN drift_status = 'failed' THEN 'prepare_data' ELSE '' END AS drift_error_stage, CASE WHEN drift_status = 'failed' THEN 'InvalidNumber' ELSE '' END AS drift_error, CASE WHEN drift_status = 'generated' THEN round(psi, 6) ELSE -1.0::DOUBLE END AS psi FROM told"""


def _gate() -> str:
    floors = {"pr_auc": (0.5, -0.01), "precision": (0.5, -0.05), "recall": (0.8, -0.02)}
    caps = {"expected_cost_per_transaction": (0.1, 0.01), "brier_score": (0.1, 0.01), "calibration_error": (0.1, 0.02), "alert_rate": (0.05, 0.02)}
    twice = "(SELECT count(*) FROM (SELECT event_id FROM events GROUP BY event_id HAVING count(*) > 1))"
    shared = "(SELECT coalesce(sum(c * (c - 1) // 2), 0) FROM (SELECT count(DISTINCT split) AS c FROM parts GROUP BY event_id))"
    rows = [("schema.feature_contract", "1.0", "==", 1.0), ("leakage.duplicate_transaction_ids", twice, "==", 0.0), ("leakage.split_overlap", shared, "==", 0.0), ("test.rows", "b.row_count", ">=", 10000.0), ("test.positives", "b.positives", ">=", 100.0)]
    rows += [(f"validation.{k}", f"v.{k}", ">=", v[0]) for k, v in floors.items()] + [(f"test.{k}", f"b.{k}", ">=", v[0]) for k, v in floors.items()] + [(f"test.{k}", f"b.{k}", "<=", v[0]) for k, v in caps.items()]
    rows += [(f"comparison.{k}", f"b.{k} - a.{k}", ">=", v[1]) for k, v in floors.items()] + [(f"comparison.{k}_increase", f"b.{k} - a.{k}", "<=", v[1]) for k, v in caps.items()]
    union = " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({e} AS DOUBLE) AS actual, '{op}' AS operator, {t}::DOUBLE AS threshold FROM b, a, v" for n, e, op, t in rows)
    sweep = f"{_SPLIT_SCORES}, {_sweep('threshold = 0.25').removeprefix(_SCORES + ', ')}"
    return f"""WITH {sweep}, {_auc("s", "model")}, {_BINS.removeprefix(_SCORES + ",")}, ece AS (SELECT model, sum(row_count * abs(mp - rate)) / sum(row_count) AS calibration_error FROM bins GROUP BY model),
m AS (SELECT sweep.model, row_count, true_positives + false_negatives AS positives, pr_auc, prec AS precision, rec AS recall, expected_cost / row_count AS expected_cost_per_transaction, brier AS brier_score, alert AS alert_rate, calibration_error
  FROM sweep JOIN auc USING (model) JOIN ece USING (model)), a AS (SELECT * FROM m WHERE model = 'test_alpha'), b AS (SELECT * FROM m WHERE model = 'test_beta'), v AS (SELECT * FROM m WHERE model = 'validation_beta'), every AS ({union})
SELECT 'beta' AS model, name, round(actual, 6) AS actual, operator, threshold, CASE operator WHEN '>=' THEN actual >= threshold WHEN '<=' THEN actual <= threshold ELSE actual = threshold END AS passed FROM every"""


def _histogram() -> str:
    bounds = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)
    counts = ", ".join(f"count(*) FILTER (value / 100.0::DOUBLE <= {b}::DOUBLE) AS le{i}" for i, b in enumerate(bounds))
    cases = " ".join(
        f"WHEN le{i} >= q THEN {bounds[i - 1] if i else 0.0}::DOUBLE + {b - (bounds[i - 1] if i else 0.0)!r}::DOUBLE * coalesce((q - {f'le{i - 1}' if i else '0'}) / nullif(le{i} - {f'le{i - 1}' if i else '0'}, 0)::DOUBLE, 0)" for i, b in enumerate(bounds)
    )
    return f"WITH h AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS requests, 0.95::DOUBLE * count(*) AS q, {counts} FROM events GROUP BY 1) SELECT window_start, requests, round(CASE {cases} ELSE 5.0::DOUBLE END, 6) AS quantile FROM h"


_SUMMED = ["amount", "amount_log", "origin_balance_before", "amount_to_origin_balance_ratio", "destination_balance_before", "amount_to_destination_balance_ratio", "is_zero_origin_balance_before",
  "is_zero_destination_balance_before", "transaction_hour", "transaction_day_of_week", "is_cash_in", "is_cash_out", "is_debit", "is_payment", "is_transfer", "risk_score"]


def _newton(steps: int = 6) -> str:
    """Newton steps of a logistic curve with one feature: the two-by-two system written out."""
    out = ["b0 AS (SELECT DISTINCT model, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS ll FROM s)"]
    for k in range(1, steps + 1):
        out.append(f"""p{k} AS (SELECT s.model, a, b, score AS x, label AS y, a + b * score AS z, 1 / (1 + exp(-(a + b * score))) AS p FROM s JOIN b{k - 1} ON b{k - 1}.model = s.model),
g{k} AS (SELECT model, max(a) AS a, max(b) AS b, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11, sum(y * z - ln(1 + exp(z))) AS ll FROM p{k} GROUP BY model),
b{k} AS (SELECT model, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b, ll FROM g{k})""")
    return ",\n".join(out)


def _content(name: str, columns: list[str]) -> str:
    cell = lambda c: f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    row = f"sha256({" || ',' || ".join(map(cell, sorted(columns)))})"
    number = lambda at: f"list_reduce(list_prepend(0::HUGEINT, list_transform(range({at}, {at} + 15), lambda i: (strpos('0123456789abcdef', h[i]) - 1)::HUGEINT)), lambda a, b: a * 16 + b)"
    return f"SELECT '{name}' AS name, count(*) AS row_count, sum({number(1)})::VARCHAR AS low, sum({number(16)})::VARCHAR AS high FROM (SELECT {row} AS h FROM {name})"


ORACLE_SQL: dict[str, str] = {
    "behavior_features": f"SELECT event_id AS transaction_id, ts AS \"timestamp\", user_id AS origin_account_id, event_type AS destination_account_id, value AS amount, {_behavior('user_id', 'ts', 'value', 'event_type')} FROM events",
    "raw_transactions": f"WITH {_RAW} SELECT * FROM raw",
    "canonical_transactions": f"WITH {_CANON} SELECT * FROM canon",
    "amount_features": f"WITH {_CANON} SELECT transaction_id, {_AMOUNT} FROM canon",
    "balance_features": f"WITH {_CANON} SELECT transaction_id, {_BALANCE} FROM ruled",
    "type_indicators": f"WITH {_CANON} SELECT transaction_id, {_TYPES} FROM canon",
    "calendar_features": f"WITH {_CANON} SELECT transaction_id, {_CALENDAR} FROM canon",
    "full_feature_row": f"WITH {_CANON} SELECT ruled.* EXCLUDE (negative, origin_bad, destination_bad), {_AMOUNT}, {_BALANCE}, {_TYPES}, {_CALENDAR}, {_behavior('origin_account_id', '\"timestamp\"', 'amount', 'destination_account_id')} FROM ruled",
    "model_dataset": f"""WITH {_CANON} SELECT transaction_id, transaction_type, amount, origin_balance_before, destination_balance_before, is_fraud, {_AMOUNT}, {_TYPES}, {_CALENDAR},
  CAST(origin_balance_before = 0 AS INTEGER) AS is_zero_origin_balance_before, CAST(destination_balance_before = 0 AS INTEGER) AS is_zero_destination_balance_before FROM canon""",
    "raw_validation": f"""WITH {_RAW} SELECT count(*) AS row_count, count(*) FILTER (step IS NULL OR type IS NULL OR amount IS NULL OR "nameOrig" IS NULL OR "nameDest" IS NULL OR "oldbalanceOrg" IS NULL OR "newbalanceOrig" IS NULL OR "oldbalanceDest" IS NULL OR "newbalanceDest" IS NULL OR "isFraud" IS NULL OR "isFlaggedFraud" IS NULL) AS null_count,
  count(*) FILTER (amount < 0) AS invalid_amount_count, count(*) FILTER (step < 0) AS invalid_step_count, count(*) FILTER (type NOT IN ('CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER')) AS invalid_type_count, count(*) FILTER ("isFraud" NOT IN (0, 1)) AS invalid_fraud_label_count, count(*) FILTER ("isFlaggedFraud" NOT IN (0, 1)) AS invalid_flagged_fraud_count FROM raw""",
    "canonical_validation": f"""WITH {_CANON}, x AS (SELECT count(*) AS row_count, count(*) FILTER (transaction_id IS NULL OR "timestamp" IS NULL OR transaction_type IS NULL OR amount IS NULL OR is_fraud IS NULL OR is_flagged_fraud IS NULL OR origin_account_id IS NULL OR destination_account_id IS NULL) AS null_count,
  count(*) FILTER (length(transaction_id) <> 64) AS invalid_transaction_id_count, count(*) FILTER (amount < 0) AS invalid_amount_count, count(*) FILTER (transaction_type NOT IN ('CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER')) AS invalid_transaction_type_count,
  count(*) FILTER (is_fraud NOT IN (0, 1)) AS invalid_fraud_label_count, count(*) FILTER (is_flagged_fraud NOT IN (0, 1)) AS invalid_flagged_fraud_count, count(*) FILTER (origin_balance_before IS NULL OR origin_balance_after IS NULL OR destination_balance_before IS NULL OR destination_balance_after IS NULL) AS null_balance_count FROM canon),
d AS (SELECT count(*) AS duplicate_transaction_id_count FROM (SELECT transaction_id FROM canon GROUP BY 1 HAVING count(*) > 1))
SELECT *, row_count > 0 AND null_count + invalid_transaction_id_count + invalid_amount_count + invalid_transaction_type_count + invalid_fraud_label_count + invalid_flagged_fraud_count + duplicate_transaction_id_count = 0 AS is_valid FROM x, d""",
    "domain_validation": f"WITH {_CANON} SELECT count(*) FILTER (negative) AS negative_balance_count, count(*) FILTER (origin_bad) AS origin_balance_mismatch_count, count(*) FILTER (destination_bad) AS destination_balance_mismatch_count FROM ruled",
    "negative_balances": _violations("negative"),
    "origin_inconsistent": _violations("origin_bad"),
    "destination_inconsistent": _violations("destination_bad"),
    "duplicate_keys": "SELECT l_orderkey || '-' || l_linenumber AS transaction_id, count(*) AS row_count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "invalid_numbers": "SELECT event_id FROM events WHERE value = floor(value)",
    "consistency_by_type": f"""WITH {_CANON} SELECT transaction_type, count(*) AS transaction_count, count(*) FILTER (origin_bad) AS inconsistent_origin_count, count(*) FILTER (destination_bad) AS inconsistent_destination_count,
  count(*) FILTER (origin_bad) / count(*)::DOUBLE AS origin_inconsistency_rate, count(*) FILTER (destination_bad) / count(*)::DOUBLE AS destination_inconsistency_rate FROM ruled GROUP BY transaction_type""",
    "behavior_flags": f"""WITH {_CANON}, f AS (SELECT transaction_id, transaction_type, amount, origin_balance_before AS ob, origin_balance_after AS oa, origin_balance_after - origin_balance_before AS origin_delta, destination_balance_after - destination_balance_before AS destination_delta,
  CASE WHEN transaction_type = 'CASH_IN' THEN amount ELSE -amount END AS origin_expected_delta FROM canon)
SELECT transaction_id, origin_delta, destination_delta, origin_expected_delta, abs(origin_delta - origin_expected_delta) <= 0.01 AS origin_exact_match, transaction_type <> 'CASH_IN' AND ob < amount AND abs(oa) <= 0.01 AS origin_floor_match, abs(destination_delta - amount) <= 0.01 AS destination_plus_amount_match FROM f""",
    "behavior_by_type": f"""WITH {_CANON}, f AS (SELECT transaction_type, count(*) AS n, count(*) FILTER (abs(origin_balance_after - origin_balance_before - CASE WHEN transaction_type = 'CASH_IN' THEN amount ELSE -amount END) <= 0.01) AS e,
  count(*) FILTER (transaction_type <> 'CASH_IN' AND origin_balance_before < amount AND abs(origin_balance_after) <= 0.01) AS fl, count(*) FILTER (abs(destination_balance_after - destination_balance_before - amount) <= 0.01) AS d FROM canon GROUP BY transaction_type)
SELECT transaction_type, n AS transaction_count, e AS origin_exact_match_count, fl AS origin_floor_match_count, d AS destination_plus_amount_match_count, n - e - fl AS origin_mismatch_count, (n - e - fl) / n::DOUBLE AS origin_mismatch_rate, n - d AS destination_mismatch_count, (n - d) / n::DOUBLE AS destination_mismatch_rate FROM f""",
    "split_exact": f"WITH {_SPLIT} SELECT transaction_id, split FROM parts",
    "split_time_boundary": f"""WITH {_ORDERS}, q AS (SELECT quantile_disc("timestamp", 0.70) AS a, quantile_disc("timestamp", 0.85) AS b FROM o) SELECT transaction_id, CASE WHEN "timestamp" <= a THEN 'train' WHEN "timestamp" <= b THEN 'validation' ELSE 'test' END AS split FROM o, q""",
    "split_stats": f"""WITH {_SPLIT} SELECT split, count(*) AS row_count, count(*) FILTER (is_fraud NOT IN (0, 1)) AS invalid_target_count, min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp FROM parts GROUP BY split""",
    "split_overlap": """WITH numbered AS (SELECT user_id, row_number() OVER (ORDER BY ts, event_id::VARCHAR) AS k, count(*) OVER () AS n FROM events),
parts AS (SELECT DISTINCT user_id, CASE WHEN k <= floor(n * 0.70) THEN 'train' WHEN k <= floor(n * 0.70) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM numbered),
pairs AS (SELECT unnest(['train', 'train', 'validation']) AS a, unnest(['validation', 'test', 'test']) AS b)
SELECT a || '__' || b AS pair, (SELECT count(*) FROM parts x JOIN parts y USING (user_id) WHERE x.split = a AND y.split = b) AS overlap_count FROM pairs""",
    "split_summary": f"""WITH {_ORDERS} SELECT count(*) AS row_count, count(*) FILTER (is_fraud = 1) AS positive_count, count(*) FILTER (is_fraud = 0) AS negative_count, min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp FROM o""",
    "sample_keep_positives": f"WITH {_HASHED}, r AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY h) AS k FROM hashed) SELECT transaction_id, is_fraud FROM r WHERE is_fraud = 1 OR k <= n // 2 - p",
    "sample_exact": f"WITH {_HASHED}, r AS (SELECT *, row_number() OVER (ORDER BY h) AS k FROM hashed) SELECT transaction_id FROM r WHERE k <= n // 3",
    "split_validation": f"WITH {_SPLIT} SELECT count(*) AS total_row_count, count(*) FILTER (is_fraud NOT IN (0, 1)) AS invalid_target_count, count(*) - count(DISTINCT transaction_id) AS duplicate_transaction_id_count, count(*) FILTER (split = 'train') AS train_row_count, count(*) FILTER (split = 'validation') AS validation_row_count, count(*) FILTER (split = 'test') AS test_row_count FROM parts",
    "sample_dispatch": f"""WITH {_SPLIT}, h AS (SELECT *, sha256(transaction_id || '||42') AS h, count(*) OVER (PARTITION BY split) AS sn, sum(is_fraud) OVER (PARTITION BY split) AS p FROM parts),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h) AS i, row_number() OVER (PARTITION BY split, is_fraud ORDER BY h) AS j FROM h)
SELECT transaction_id, split FROM r WHERE split = 'test' OR split = 'validation' AND i <= n // 20 OR split = 'train' AND (sn <= n // 2 OR is_fraud = 1 OR j <= n // 2 - p)""",
    "imbalance_weights": f"""WITH {_SCORES}, c AS (SELECT label, count(*) AS row_count FROM s GROUP BY label), t AS (SELECT sum(row_count)::DOUBLE AS n, max(CASE WHEN label = 1 THEN row_count END)::DOUBLE AS p FROM c)
SELECT 'class_weights' AS policy, label, row_count, round(n / (2.0::DOUBLE * row_count), 6) AS weight FROM c, t UNION ALL SELECT 'scale_pos_weight', label, row_count, round(CASE WHEN label = 1 THEN (n - p) / p ELSE 1.0::DOUBLE END, 6) FROM c, t""",
    "event_contract": """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'x' || event_id ELSE printf('%08x-0000-4000-8000-%012x', event_id, event_id) END AS feedback_id, ts, value / 400.0::DOUBLE AS risk, event_id % 41 - 1 AS latency,
  '{' || CASE WHEN event_id % 31 = 0 THEN '' ELSE '"amount":' || CASE WHEN event_id % 23 = 0 THEN '"much"' ELSE event_id::VARCHAR END || ',' END || '"transaction_type":"' || CASE WHEN event_id % 29 = 0 THEN 'X' ELSE 'PAYMENT' END || '"}' AS j FROM events),
f AS (SELECT *, json_extract_string(j, '$.amount') AS amount, json_extract_string(j, '$.transaction_type') AS kind FROM e)
SELECT event_id, concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'schema_version' END, CASE WHEN NOT regexp_full_match(feedback_id, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') THEN 'feedback_id' END, CASE WHEN event_id % 17 = 0 OR ts IS NULL THEN 'event_time' END,
  CASE WHEN event_id % 19 = 0 THEN 'model_name' END, CASE WHEN amount IS NULL OR kind IS NULL THEN 'features' END, CASE WHEN amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL THEN 'feature_values' END,
  CASE WHEN kind NOT IN ('CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER') THEN 'transaction_type' END, CASE WHEN risk IS NULL OR NOT risk BETWEEN 0 AND 1 THEN 'risk_score' END, CASE WHEN event_id % 37 = 0 THEN 'decision' END, CASE WHEN latency < 0 THEN 'latency_seconds' END) AS errors FROM f""",
    "label_contract": f"""WITH {_EVENTS} SELECT feedback_id, label_time, concat_ws(',', CASE WHEN feedback_id LIKE '%3' THEN 'schema_version' END, CASE WHEN feedback_id LIKE '%7' THEN 'label' END, CASE WHEN label_time > TIMESTAMP '2024-02-01 00:05:00' THEN 'label_time' END) AS errors FROM l""",
    "categorical_drift": """WITH e AS (SELECT 'event_type' AS feature, event_type AS v, ts >= '2024-01-16' AS cur FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR, ts >= '2024-01-16' FROM events),
g AS (SELECT feature, v, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM e GROUP BY feature, v), t AS (SELECT feature, sum(r)::DOUBLE AS nr, sum(c)::DOUBLE AS nc, count(*) - 1 AS degrees FROM g GROUP BY feature)
SELECT feature, round(sum(power(r - (r + c) * nr / (nr + nc), 2) / ((r + c) * nr / (nr + nc)) + power(c - (r + c) * nc / (nr + nc), 2) / ((r + c) * nc / (nr + nc))), 6) AS chi_square, degrees FROM g JOIN t USING (feature) GROUP BY feature, degrees""",
    "rate_5m_sliding": "WITH w AS (SELECT time_bucket(INTERVAL '1 minute', ts) - to_minutes(k) AS window_start, event_type FROM events, (SELECT unnest(range(5)) AS k)) SELECT window_start, event_type, count(*) AS requests, round(count(*) / 300.0::DOUBLE, 6) AS rate FROM w GROUP BY 1, 2",
    "error_ratio_sliding": "WITH w AS (SELECT time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * k) AS window_start, event_type = 'error' AS bad FROM events, (SELECT unnest(range(4)) AS k)) SELECT window_start, count(*) AS requests, count(*) FILTER (bad) AS errors, round(count(*) FILTER (bad) / count(*)::DOUBLE, 6) AS ratio, count(*) FILTER (bad) / count(*)::DOUBLE > 0.02 AS firing FROM w GROUP BY 1",
    "logistic_newton": f"WITH {_SCORES}, {_newton()} SELECT model, round(a, 6) AS intercept, round(b, 6) AS coefficient, round(ll, 3) AS log_likelihood FROM b6",
    "calibrated_scores": f"WITH {_SCORES}, {_newton()} SELECT round(1 / (1 + exp(-(a + b * score))), 6) AS chance, label, count(*) AS row_count FROM s JOIN b6 ON b6.model = s.model WHERE s.model = 'alpha' GROUP BY 1, 2",
    "table_fingerprint": _content("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]) + " UNION ALL " + _content("events", ["event_id", "user_id", "event_type"]),
    "segment_calibration": f"""WITH {_LABELLED}, y AS (SELECT {_SEG}, label, risk_score AS score FROM j WHERE label IS NOT NULL), b AS (SELECT {_SEG} FROM y GROUP BY ALL HAVING count(DISTINCT label) = 2),
edges AS (SELECT i AS bin, i * 0.1::DOUBLE AS lower, CASE WHEN i = 9 THEN 1.0::DOUBLE ELSE (i + 1) * 0.1::DOUBLE END AS upper FROM (SELECT unnest(range(0, 10)) AS i))
SELECT b.model_name, b.model_version, b.feature_contract_version, CAST(bin AS INTEGER) AS bin, round(lower, 6) AS lower, round(upper, 6) AS upper, count(score) AS row_count, round(coalesce(avg(score), 0), 6) AS mean_predicted_probability, round(coalesce(avg(label), 0), 6) AS observed_positive_rate
FROM b CROSS JOIN edges LEFT JOIN y ON y.model_name = b.model_name AND y.model_version = b.model_version AND y.feature_contract_version = b.feature_contract_version AND score >= lower AND (score < upper OR bin = 9 AND score <= upper)
GROUP BY b.model_name, b.model_version, b.feature_contract_version, bin, lower, upper""",
    "data_summary": f"""WITH {_CANON}, f AS (SELECT *, least(amount / 1e6::DOUBLE, 1.0::DOUBLE) AS risk_score, {_AMOUNT}, {_TYPES}, {_CALENDAR}, CAST(origin_balance_before = 0 AS INTEGER) AS is_zero_origin_balance_before, CAST(destination_balance_before = 0 AS INTEGER) AS is_zero_destination_balance_before
  FROM canon WHERE "timestamp" >= TIMESTAMP '2030-01-01' AND "timestamp" < TIMESTAMP '2032-01-01'),
l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(\"timestamp\" AS DATE) AS day, {c}::DOUBLE AS v, {c}::DOUBLE IS NULL AS lost FROM f" for c in _SUMMED)} UNION ALL SELECT 'transaction_type', CAST("timestamp" AS DATE), NULL, transaction_type IS NULL FROM f)
SELECT feature, count(DISTINCT day) AS day_count, count(*) AS row_count, count(*) FILTER (lost) AS null_count, round(min(v), 5) AS minimum, round(max(v), 5) AS maximum, round(avg(v), 5) AS mean, CASE WHEN avg(v) IS NOT NULL THEN round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)), 5) END AS deviation FROM l GROUP BY feature""",
    "alert_states": """WITH w AS (SELECT time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * k) AS window_start, event_type = 'error' AS bad FROM events, (SELECT unnest(range(4)) AS k)),
r AS (SELECT window_start, count(*) FILTER (bad) / count(*)::DOUBLE > 0.2 AS firing FROM w GROUP BY 1),
p AS (SELECT *, lag(window_start) OVER (ORDER BY window_start) AS b, lag(firing) OVER (ORDER BY window_start) AS bf FROM r),
g AS (SELECT *, sum(CASE WHEN firing AND bf AND b = window_start - INTERVAL 15 MINUTE THEN 0 ELSE 1 END) OVER (ORDER BY window_start) AS island FROM p),
s AS (SELECT *, min(window_start) OVER (PARTITION BY island) AS since FROM g)
SELECT window_start, firing, CASE WHEN firing THEN since ELSE TIMESTAMP '1970-01-01' END AS active_since, CASE WHEN NOT firing THEN 'inactive' WHEN window_start - since >= INTERVAL 30 MINUTE THEN 'firing' ELSE 'pending' END AS state FROM s""",
    "rate_extrapolated": """WITH x AS (SELECT ts, user_id, (event_id % 1000)::DOUBLE AS v, lag((event_id % 1000)::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id % 1000) AS b FROM events),
d AS (SELECT *, CASE WHEN b IS NULL THEN 0.0::DOUBLE WHEN v < b THEN v ELSE v - b END AS delta FROM x),
w AS (SELECT time_bucket(INTERVAL '6 hours', ts) - to_hours(6 * k) AS window_start, * FROM d, (SELECT unnest(range(4)) AS k)),
n AS (SELECT *, row_number() OVER (PARTITION BY window_start, user_id ORDER BY ts, v) AS i FROM w),
a AS (SELECT window_start, user_id, count(*) AS samples, sum(CASE WHEN i > 1 THEN delta ELSE 0.0::DOUBLE END) AS inc, max(CASE WHEN i = 1 THEN v END) AS v0, epoch_us(min(ts)) / 1e6::DOUBLE AS f, epoch_us(max(ts)) / 1e6::DOUBLE AS t, epoch_us(window_start) / 1e6::DOUBLE AS s FROM n GROUP BY window_start, user_id),
m AS (SELECT *, t - f AS cov, (t - f) / (samples - 1) AS mean FROM a WHERE samples > 1 AND t > f),
e AS (SELECT *, CASE WHEN f - s >= 1.1::DOUBLE * mean THEN mean / 2 ELSE f - s END AS g0, CASE WHEN s + 86400 - t >= 1.1::DOUBLE * mean THEN mean / 2 ELSE s + 86400 - t END AS g1 FROM m),
z AS (SELECT *, inc * (cov + CASE WHEN inc > 0 AND v0 >= 0 THEN least(g0, cov * v0 / inc) ELSE g0 END + g1) / cov AS y FROM e)
SELECT window_start, user_id, samples, round(y, 6) AS increase, round(y / 86400, 6) AS rate FROM z""",
    "class_counts": f"WITH {_ORDERS} SELECT count(*) AS row_count, count(*) FILTER (is_fraud = 1) AS positive_count FROM o",
    "strided_sample": "WITH r AS (SELECT event_id::VARCHAR AS feedback_id, row_number() OVER (ORDER BY ts, event_id::VARCHAR) - 1 AS k, count(*) OVER () AS n FROM events) SELECT feedback_id FROM r WHERE k IN (SELECT CAST(floor(i * (SELECT count(*) FROM events) / 777.0::DOUBLE) AS BIGINT) FROM (SELECT unnest(range(0, 777)) AS i))",
    "kth_row": f"""WITH {_ORDERS} SELECT "timestamp", transaction_id FROM (SELECT *, row_number() OVER (ORDER BY "timestamp", transaction_id) AS k, count(*) OVER () AS n FROM o) WHERE k = n // 2""",
    "confusion_at_threshold": f"WITH {_sweep('threshold = 0.25')} SELECT model, {_METRICS} FROM sweep",
    "threshold_sweep": f"WITH {_sweep('true')} SELECT model, threshold, {_METRICS}, expected_cost FROM sweep",
    "roc_pr_auc": f"WITH {_SCORES}, {_auc('s', 'model')} SELECT model, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM auc",
    "calibration_bins": f"WITH {_BINS} SELECT model, CAST(bin AS INTEGER) AS bin, round(lower, 6) AS lower, round(upper, 6) AS upper, row_count, round(mp, 6) AS mean_predicted_probability, round(rate, 6) AS observed_positive_rate FROM bins",
    "calibration_error": f"WITH {_BINS} SELECT model, round(sum(row_count * abs(mp - rate)) / sum(row_count), 6) AS calibration_error FROM bins GROUP BY model",
    "class_weights": f"WITH {_SCORES}, x AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS p FROM s) SELECT n AS row_count, p AS positive_count, n - p AS negative_count, round(p / n::DOUBLE, 6) AS positive_rate, round(n / (2.0::DOUBLE * (n - p)), 6) AS negative_weight, round(n / (2.0::DOUBLE * p), 6) AS positive_weight, round((n - p) / p::DOUBLE, 6) AS scale_pos_weight FROM x",
    "best_threshold_metric": f"WITH {_sweep('true')} SELECT model, threshold, expected_cost FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f DESC, expected_cost, threshold) AS k FROM sweep WHERE rec >= 0.3) WHERE k = 1",
    "best_threshold_cost": f"WITH {_sweep('true')} SELECT model, threshold, expected_cost FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY expected_cost, rec DESC, threshold) AS k FROM sweep) WHERE k = 1",
    "candidate_ranking": f"WITH {_sweep('true')}, {_auc('s', 'model')}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f DESC, expected_cost, threshold) AS k FROM sweep WHERE rec >= 0.3) WHERE k = 1) SELECT model, threshold, CAST(row_number() OVER (ORDER BY pr_auc DESC, expected_cost, model) AS INTEGER) AS place FROM best JOIN auc USING (model)",
    "rejected_candidates": f"WITH {_sweep('threshold >= 0.44')}, b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rec DESC, expected_cost, threshold) AS k FROM sweep) SELECT model, round(rec, 6) AS maximum_recall, threshold AS diagnostic_threshold FROM b WHERE k = 1 AND rec < 0.5",
    "labels_joined": f"WITH {_LABELLED} SELECT feedback_id, event_time, coalesce(label, -1) AS label, label_time FROM j",
    "labels_unmatched": f"WITH {_EVENTS} SELECT l.feedback_id, l.label, l.label_time FROM l LEFT JOIN p ON p.feedback_id = l.feedback_id WHERE p.feedback_id IS NULL OR l.label_time < p.event_time",
    "labels_overdue": f"WITH {_LABELLED} SELECT feedback_id, event_time FROM j WHERE event_time < TIMESTAMP '2024-01-25' AND label_time IS NULL",
    "label_conflicts": "WITH s AS (SELECT user_id::VARCHAR AS feedback_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, event_id AS arrival FROM events), r AS (SELECT *, first_value(label) OVER w AS fl, first_value(arrival) OVER w AS fa FROM s WINDOW w AS (PARTITION BY feedback_id ORDER BY arrival)) SELECT feedback_id, CAST(label AS INTEGER) AS label, arrival, CASE WHEN arrival = fa THEN 'accepted' WHEN label = fl THEN 'duplicate' ELSE 'conflict' END AS outcome FROM r",
    "monitoring_counters": f"""WITH {_EVENTS}, pr AS (SELECT * FROM p WHERE event_time >= TIMESTAMP '2024-01-11'), lr AS (SELECT * FROM l WHERE label_time >= TIMESTAMP '2024-01-11'), w AS (SELECT * FROM pr WHERE event_time >= TIMESTAMP '2024-01-18'),
x AS (SELECT (SELECT count(*) FROM w) AS event_count, (SELECT count(*) FROM w JOIN lr ON lr.feedback_id = w.feedback_id AND lr.label_time >= w.event_time) AS joined_label_count,
 (SELECT count(*) FROM lr LEFT JOIN pr ON pr.feedback_id = lr.feedback_id WHERE pr.feedback_id IS NULL OR lr.label_time < pr.event_time) AS unmatched_label_count,
 (SELECT count(*) FROM pr LEFT JOIN lr ON lr.feedback_id = pr.feedback_id AND lr.label_time >= pr.event_time WHERE pr.event_time < TIMESTAMP '2024-01-25' AND lr.feedback_id IS NULL) AS late_unlabeled_count)
SELECT *, event_count > 500 AS truncated FROM x""",
    "latest_events": f"WITH {_EVENTS} SELECT feedback_id, event_time FROM p ORDER BY event_time DESC, feedback_id DESC LIMIT 500",
    "retained_events": f"WITH {_EVENTS} SELECT feedback_id FROM p WHERE event_time >= TIMESTAMP '2024-01-18'",
    "segment_summary": f"""WITH {_LABELLED} SELECT {_SEG}, count(*) AS event_count, count(label) AS labeled_count, replace(model_name, ' ', '-') || '-' || model_version || '-' || feature_contract_version AS slug,
  CASE WHEN NOT (model_name = 'risk' AND model_version = 'v1') THEN 'skipped_reference_model_mismatch' WHEN count(*) < 2 THEN 'insufficient_current_rows' ELSE 'generated' END AS drift_status FROM j GROUP BY {_SEG}""",
    "segment_performance": f"""WITH {_LABELLED}, y AS (SELECT {_SEG}, label, risk_score AS score, decision_threshold AS t FROM j WHERE label IS NOT NULL), {_auc("y", _SEG)},
c AS (SELECT {_SEG}, count(*) AS n, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp, count(*) FILTER (score < t AND label = 1) AS fn, avg((score - label) * (score - label)) AS brier, avg((score >= t)::INT) AS alert, min(label) <> max(label) AS two FROM y GROUP BY {_SEG})
SELECT {_SEG}, CASE WHEN n IS NULL THEN 'awaiting_labels' WHEN NOT two THEN 'awaiting_both_label_classes' ELSE 'computed' END AS status, coalesce(n, 0) AS labeled_count, round(CASE WHEN two THEN coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) END, 6) AS precision,
  round(CASE WHEN two THEN coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) END, 6) AS recall, round(CASE WHEN two THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) END, 6) AS f1, round(CASE WHEN two THEN roc_auc END, 6) AS roc_auc, round(CASE WHEN two THEN pr_auc END, 6) AS pr_auc,
  round(CASE WHEN two THEN brier END, 6) AS brier_score, round(CASE WHEN two THEN alert END, 6) AS alert_rate FROM (SELECT DISTINCT {_SEG} FROM j) LEFT JOIN c USING ({_SEG}) LEFT JOIN auc USING ({_SEG})""",
    "decisions": f"WITH {_EVENTS} SELECT feedback_id, CASE WHEN risk_score >= 0.25 THEN 'review' ELSE 'allow' END AS decision FROM p",
    "psi_drift": _psi(),
    "ks_drift": """WITH e AS (SELECT 'value' AS feature, value AS v, ts >= '2024-01-16' AS cur FROM events UNION ALL SELECT 'user_id', user_id, ts >= '2024-01-16' FROM events),
g AS (SELECT feature, v, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM e GROUP BY feature, v),
k AS (SELECT feature, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY feature)::DOUBLE - sum(c) OVER w / sum(c) OVER (PARTITION BY feature)::DOUBLE) AS gap FROM g WINDOW w AS (PARTITION BY feature ORDER BY v))
SELECT feature, round(max(gap), 6) AS ks FROM k GROUP BY feature""",
    "quality_gate_checks": _gate(),
    "segment_drift": _segment_drift(),
    "sample_in_order": f"""WITH {_HASHED}, r AS (SELECT *, row_number() OVER (ORDER BY h) AS i FROM hashed) SELECT row_number() OVER (ORDER BY "timestamp", transaction_id) - 1 AS row_index, transaction_id FROM r WHERE i <= n // 4""",
    "preprocessed_features": """WITH e AS (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN value END AS v, user_id::DOUBLE AS u, CASE WHEN event_id % 17 <> 0 THEN event_type END AS t FROM events),
fills AS (SELECT quantile_disc(v, 0.5) AS median, (SELECT t FROM e WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t LIMIT 1) AS mode FROM e),
f AS (SELECT event_id, coalesce(v, median) AS v, u, coalesce(t, mode) AS t FROM e, fills), m AS (SELECT avg(v) AS av, stddev_samp(v) AS sv, avg(u) AS au, stddev_samp(u) AS su FROM f),
cats AS (SELECT t, row_number() OVER (ORDER BY count(*) DESC, t) AS category FROM f GROUP BY t)
SELECT event_id, round((v - av) / sv, 6) AS value, round((u - au) / su, 6) AS user_id, category FROM f, m, cats WHERE cats.t = f.t""",
    "rate_5m": "SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS requests, round(count(*) / 300.0::DOUBLE, 6) AS rate FROM events GROUP BY 1, 2",
    "error_ratio": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS ratio, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE > 0.02 AS firing FROM events GROUP BY 1",
    "histogram_p95": _histogram(),
    "counter_increase": """WITH x AS (SELECT ts, user_id, (event_id % 1000)::DOUBLE AS v, lag((event_id % 1000)::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
y AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id, sum(CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END) AS increase FROM x GROUP BY 1, 2) SELECT window_start, user_id, increase, round(increase / 86400.0::DOUBLE, 6) AS rate FROM y""",
}
