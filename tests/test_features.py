import math
from datetime import datetime, timedelta

import pytest

from txnlens.functions import features as fx
from txnlens.functions import rules
from txnlens.operators import canonical, profiling, validation, windows
from txnlens.plans import contract
from txnlens.schemas import CANONICAL, FEATURES, RAW, require_schema, schema_errors

T0 = datetime(2026, 1, 1, 10)


def row(df, exprs):
    return df.select(*[c.alias(k) for k, c in exprs.items()]).first().asDict()


def test_canonicalize_keys_and_times(spark):
    raw = spark.createDataFrame([(1, "PAYMENT", 100.0, "C123", 1000.0, 900.0, "M123", 500.0, 600.0, 0, 0)], RAW)
    out = canonical.canonicalize(raw)
    r = out.first()
    assert schema_errors(out.schema, CANONICAL) == [] and len(r["transaction_id"]) == 64 and r["timestamp"] == datetime(2026, 1, 1, 1)


@pytest.mark.parametrize(
    "kind,before,after,amount,bad",
    [("CASH_OUT", 1000, 800, 200, False), ("CASH_OUT", 100, 0, 200, False), ("CASH_OUT", 1000, 900, 200, True), ("CASH_IN", 1000, 1200, 200, False), ("PAYMENT", 1000, 950, 100, True), ("OTHER", 1000, 1, 5, False)],
)
def test_origin_rule(transactions, kind, before, after, amount, bad):
    df = transactions((T0, kind, amount, before, after, 0, amount, 0))
    assert df.select(rules.origin_inconsistent()).first()[0] is bad
    assert validation.violations(df, "origin_inconsistent").count() == int(bad)


def test_amount_features(transactions):
    r = row(transactions((T0, "PAYMENT", 100, 1000, 900, 500, 600, 0)), fx.amount_features())
    assert r["amount_log"] == pytest.approx(4.61512051684126) and (r["amount_to_origin_balance_ratio"], r["amount_to_destination_balance_ratio"]) == (0.1, 0.2)
    r = row(transactions((T0, "PAYMENT", 100, 0, 0, 0, 0, 0)), fx.amount_features())
    assert (r["amount_to_origin_balance_ratio"], r["amount_to_destination_balance_ratio"]) == (0.0, 0.0)


def test_balance_features(transactions):
    r = row(transactions((T0, "PAYMENT", 300, 1000, 700, 500, 800, 0)), fx.balance_features())
    assert (r["origin_balance_delta"], r["destination_balance_delta"], r["origin_balance_change_ratio"], r["destination_balance_change_ratio"]) == (-300, 300, -0.3, 0.6)
    assert (r["origin_balance_depleted"], r["destination_balance_increased"]) == (0, 1)
    r = row(transactions((T0, "PAYMENT", 100, 0, 0, 500, 400, 0)), fx.balance_features())
    assert (r["origin_balance_delta"], r["destination_balance_delta"], r["origin_balance_change_ratio"]) == (0, -100, 0.0)


@pytest.mark.parametrize("at,hour,day", [(datetime(2026, 1, 1, 10, 30), 10, 5), (datetime(2026, 1, 4, 23, 45), 23, 1)])
def test_calendar(transactions, at, hour, day):
    assert row(transactions((at, "PAYMENT", 1, 1, 1, 1, 1, 0)), fx.calendar_features()) == {"transaction_hour": hour, "transaction_day_of_week": day}


def behaviours(spark, rows):
    df = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp, origin_account_id string, destination_account_id string, amount double")
    names = ("transactions_last_1h", "transactions_last_24h", "amount_sum_last_24h", "unique_destinations_last_30d")
    return {r["transaction_id"]: tuple(r[n] for n in names) for r in windows.add_behavior_features(df).collect()}


ROWS = [("tx-001", T0 - timedelta(hours=2), "A", "D1", 50.0), ("tx-002", T0 - timedelta(minutes=30), "A", "D2", 100.0), ("tx-003", T0, "A", "D1", 200.0), ("tx-004", T0 + timedelta(hours=1), "A", "D3", 300.0)]


def test_behavior_windows(spark):
    got = behaviours(spark, ROWS)
    assert got["tx-003"] == (1, 2, 150.0, 2) and got["tx-004"] == (1, 3, 350.0, 2)


def test_same_second_rows_do_not_see_each_other(spark):
    got = behaviours(spark, [("a", T0, "A", "D", 1.0), ("b", T0 + timedelta(microseconds=5), "A", "D", 2.0)])
    assert set(got.values()) == {(0, 0, 0.0, 0)}


def test_later_rows_do_not_leak(spark):
    changed = [*ROWS[:3], ("tx-004", T0 + timedelta(hours=1), "A", "D9", 99999.0)]
    assert behaviours(spark, ROWS)["tx-003"] == behaviours(spark, changed)["tx-003"]


def test_windows_equal_frames(spark):
    """Against the plain frames: dense seconds, gaps beyond 30 days, null keys and amounts, one account with a third of all rows."""
    from pyspark.sql import functions as F

    h = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    second = F.when(h(1, 3) == 0, h(2, 4000)).otherwise(h(3, 100) * 86400 + h(4, 3) * 3600 + h(5, 3))
    df = spark.range(900).select(
        F.col("id").alias("transaction_id"), F.timestamp_seconds(second + 1767225600 + h(6, 2) / 2).alias("timestamp"), F.nullif(F.when(h(7, 3) == 0, 1).otherwise(h(8, 9)), F.lit(5)).alias("origin_account_id"),
        F.nullif(h(9, 6), F.lit(3)).cast("string").alias("destination_account_id"), F.nullif(h(10, 50) / 4, F.lit(2.0)).alias("amount"), F.lit("x").alias("a"), F.lit("y").alias("_row"),
    )
    split = lambda d: windows.add_behavior_features(d, hot_rows=0)
    got, expected, mixed = (sorted(map(tuple, f(df).collect()), key=str) for f in (split, windows.add_behavior_features_by_window, lambda d: windows.add_behavior_features(d, hot_rows=80)))
    sizes = sorted(r["count"] for r in df.groupBy("origin_account_id").count().collect())
    assert got == expected == mixed and sizes[0] <= 80 < sizes[-1] and windows.add_behavior_features(df).columns == windows.add_behavior_features_by_window(df).columns
    assert max(r[-1] for r in got) == 5 and windows.add_behavior_features(df.limit(0)).count() == 0


def test_only_hot_accounts_are_split(spark):
    rows = [(str(i), T0 + timedelta(seconds=i), "hot" if i % 3 else f"A{i}", "D", 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp, origin_account_id string, destination_account_id string, amount double")
    plan = lambda n: windows.add_behavior_features(df, hot_rows=n)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(40) and "Union" in plan(39)  # the hot account has 40 rows


def test_rows_without_a_time_have_zeros(spark):
    got = behaviours(spark, [("a", None, "A", "D", 1.0), ("b", T0, "A", "D", 2.0), ("c", T0 + timedelta(minutes=1), "A", "D", 4.0)])
    assert got == {"a": (0, 0, 0.0, 0), "b": (0, 0, 0.0, 0), "c": (1, 1, 2.0, 1)}


def test_features_have_the_schema_and_the_contract(transactions):
    out = canonical.build_features(transactions((T0, "PAYMENT", 100, 1000, 900, 500, 600, 0)))
    require_schema(out, FEATURES)
    contract.check_features(canonical.model_dataset(out).columns[1:-1])
    with pytest.raises(ValueError, match="misses"):
        canonical.model_dataset(out.drop("amount_log"))


@pytest.mark.parametrize("columns,what", [((*contract.MODEL_FEATURES, "is_fraud"), "forbidden"), (contract.MODEL_FEATURES[1:], "missing"), ((*contract.MODEL_FEATURES, "amount"), "duplicate"), ((*contract.MODEL_FEATURES, "x"), "unexpected"), (contract.MODEL_FEATURES[::-1], "order")])
def test_contract_rejects(columns, what):
    with pytest.raises(ValueError, match=what):
        contract.check_features(columns)


def test_validation_counts(spark, transactions):
    df = spark.createDataFrame([("short-id", T0, "INVALID_TYPE", "A", "M", -100.0, 1.0, 1.0, 1.0, 1.0, 2, 0)], CANONICAL)
    r = validation.validate_canonical(df).first()
    assert (r["invalid_transaction_id_count"], r["invalid_amount_count"], r["invalid_fraud_label_count"], r["invalid_transaction_type_count"], r["is_valid"]) == (1, 1, 1, 1, False)
    good = transactions((T0, "PAYMENT", 100, 1000, 900, 500, 600, 0))
    assert validation.validate_canonical(good).first()["is_valid"]
    r = validation.validate_canonical(good.union(good)).first()
    assert (r["duplicate_transaction_id_count"], r["is_valid"], r["row_count"]) == (1, False, 2)
    assert validation.validate_canonical(good.limit(0)).first()["row_count"] == 0


def test_domain_validation(transactions):
    r = validation.validate_domain(transactions((T0, "PAYMENT", 100, 1000, 950, 0, 100, 0), (T0, "PAYMENT", 100, 1000, -50, 0, 100, 0))).first()
    assert (r["negative_balance_count"], r["origin_balance_mismatch_count"]) == (1, 2)


def test_raw_validation_sees_null_labels_as_nulls(spark):
    rows = [(1, "PAYMENT", -1.0, "C", 1.0, 1.0, "M", 1.0, 1.0, None, 0), (-1, "X", 1.0, "C", 1.0, 1.0, "M", 1.0, 1.0, 3, 0)]
    r = validation.validate_raw(spark.createDataFrame(rows, RAW)).first()
    assert r.asDict() == {"row_count": 2, "null_count": 1, "invalid_amount_count": 1, "invalid_step_count": 1, "invalid_type_count": 1, "invalid_fraud_label_count": 1, "invalid_flagged_fraud_count": 0}


def test_infinity_and_nan_are_invalid_numbers(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.inf), (3, -math.inf), (4, math.nan), (5, None)], "id int, x double")
    assert sorted(r["id"] for r in validation.invalid_numbers(df).collect()) == [2, 3, 4, 5]


def test_profiles(transactions):
    df = transactions((T0, "PAYMENT", 100, 1000, 900, 500, 600, 0), (T0, "PAYMENT", 200, 1000, 900, 500, 700, 0))
    r = profiling.consistency_by_type(df).first()
    assert (r["transaction_count"], r["inconsistent_origin_count"], r["origin_inconsistency_rate"], r["destination_inconsistency_rate"]) == (2, 1, 0.5, 0.0)
    # exact and floor matches overlap where the amount exceeds the balance by no more than the tolerance
    r = profiling.behavior_by_type(profiling.behavior_flags(transactions((T0, "CASH_OUT", 100.005, 100, 0, 0, 0, 0)))).first()
    assert (r["origin_exact_match_count"], r["origin_floor_match_count"], r["origin_mismatch_count"]) == (1, 1, -1)
    r = profiling.behavior_by_type(profiling.behavior_flags(transactions((T0, "OTHER", 1, 1, 1, 1, 1, 0)))).first()
    assert (r["origin_exact_match_count"], r["origin_mismatch_count"]) == (0, 1)
