import json
from datetime import date, datetime

import pytest

from txnlens.operators import dataset, lineage, ml
from txnlens.operators.split import SPLITS
from txnlens.plans import pipeline
from txnlens.schemas import RAW
from txnlens.sources import config, event_store, readers, registry, sinks

CSV = """step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud
1,PAYMENT,100.0,C001,1000.0,900.0,M001,500.0,600.0,0,0
2,TRANSFER,200.0,C001,900.0,700.0,C002,0.0,200.0,1,0
3,CASH_IN,50.0,C002,0.0,50.0,C001,700.0,750.0,0,0
4,DEBIT,25.0,C002,50.0,25.0,C003,0.0,0.0,0,0
5,CASH_OUT,10.0,C001,700.0,690.0,C003,0.0,10.0,0,0
6,PAYMENT,15.0,C001,690.0,675.0,M002,10.0,25.0,0,0
"""


def setup(tmp_path, text=CSV):
    (tmp_path / "raw.csv").write_text(text)
    return config.DataConfig(str(tmp_path / "raw.csv"), str(tmp_path / "out"), train_ratio=0.5, validation_ratio=0.25, test_ratio=0.25, output_files=1)


def test_etl_end_to_end_and_again(spark, tmp_path):
    cfg = setup(tmp_path)
    first = pipeline.run_etl(spark, cfg)
    assert first["splits"] == {"train": 3, "validation": 1, "test": 2} and first["raw"]["row_count"] == 6
    rows = {n: sorted(map(tuple, spark.read.parquet(f"{cfg.output_folder}/{n}").collect())) for n in SPLITS}
    assert pipeline.run_etl(spark, cfg) == first
    assert rows == {n: sorted(map(tuple, spark.read.parquet(f"{cfg.output_folder}/{n}").collect())) for n in SPLITS}
    assert json.loads((tmp_path / "out/lineage.json").read_text())["strategy"] == "exact"
    data = dataset.load_splits(spark, cfg.output_folder)
    assert data.summaries["train"]["row_count"] == 3 and set(data.overlaps.values()) == {0}


def test_etl_fails_before_it_writes(spark, tmp_path):
    with pytest.raises(ValueError, match="invalid_amount_count"):
        pipeline.run_etl(spark, setup(tmp_path, CSV.replace("PAYMENT,100.0", "PAYMENT,-100.0")))
    assert not (tmp_path / "out").exists()


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV.replace("step,type", "type,step"))
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_raw_csv(spark, str(tmp_path / "a.csv")).collect()
    (tmp_path / "b.csv").write_text(CSV + "x,PAYMENT,oops\n")
    assert readers.read_raw_csv(spark, str(tmp_path / "b.csv"), keep_malformed=True).select("step", "_corrupt_record").collect()[-1]["_corrupt_record"] == "x,PAYMENT,oops"
    assert readers.read_raw_csv(spark, str(tmp_path / "b.csv")).schema.names == RAW.names


@pytest.mark.parametrize("change,what", [(lambda s: s | {"test": s["test"].drop("amount_log")}, "misses"), (lambda s: s | {"test": s["train"]}, "overlaps"), (lambda s: s | {"test": s["test"].union(s["test"])}, "duplicate")])
def test_split_contract(spark, tmp_path, change, what):
    rows = spark.createDataFrame([(str(i), 0.5, i % 2) for i in range(1, 7)], "transaction_id string, amount_log double, is_fraud int")
    splits = {n: rows.filter(f"transaction_id in ('{2 * k + 1}', '{2 * k + 2}')") for k, n in enumerate(SPLITS)}
    for n, df in splits.items():
        df.write.parquet(f"{tmp_path}/good/{n}")
    columns = ("transaction_id", "amount_log", "is_fraud")
    got = dataset.load_splits(spark, f"{tmp_path}/good", columns)
    assert set(got.overlaps) == {"train__validation", "train__test", "validation__test"} and all(s["positive_count"] == 1 for s in got.summaries.values())
    for n, df in change(splits).items():
        df.write.parquet(f"{tmp_path}/bad/{n}")
    with pytest.raises(ValueError, match=what):
        dataset.load_splits(spark, f"{tmp_path}/bad", columns)


def test_idempotent_events_and_labels(spark, tmp_path):
    t = datetime(2026, 1, 1)
    events = spark.createDataFrame([("a", t, 1.0), ("a", t, 1.0), ("b", t, 2.0)], "feedback_id string, event_time timestamp, risk_score double")
    for _ in range(2):
        event_store.append(events, f"{tmp_path}/events")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/events").select("feedback_id").collect()) == ["a", "b"]
    label = lambda y: spark.createDataFrame([("a", y, t)], "feedback_id string, label int, stored_at timestamp")
    assert [sinks.submit_labels(label(y), f"{tmp_path}/labels").first()["outcome"] for y in (1, 1, 0)] == ["accepted", "duplicate", "conflict"]
    assert [r["label"] for r in spark.read.parquet(f"{tmp_path}/labels").collect()] == [1]
    event_store.purge(spark, f"{tmp_path}/events", datetime(2026, 3, 1), 30, events)
    assert event_store.stored_days(spark, f"{tmp_path}/events") == []


def test_event_store_reads_and_replaces_only_the_days_of_a_batch(spark, tmp_path):
    schema, path = "feedback_id string, event_time timestamp, risk_score double", f"{tmp_path}/events"
    at = lambda d, h=0: datetime(2026, 1, d, h)
    days = [spark.createDataFrame([(f"d{d}-{i}", at(d, i), float(i)) for i in range(4)], schema) for d in range(1, 6)]
    for df in days:
        event_store.append(df, path)
    again = spark.createDataFrame([("d2-0", at(2), 0.0), ("d2-9", at(2, 9), 9.0), ("d2-9", at(2, 10), 8.0), ("d3-1", at(3, 1), 1.0), (None, at(3), 1.0), ("lost", None, 1.0)], schema)
    new = event_store.unseen(again, path)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2026-01-02" in plan.replace("20455", "2026-01-02") and len(set(new.inputFiles())) > 0
    assert sorted((r["feedback_id"] or "", r["risk_score"]) for r in new.collect()) == [("", 1.0), ("d2-9", 9.0)]
    files = lambda d: sorted(p.name for p in (tmp_path / "events" / f"day=2026-01-0{d}").glob("*.parquet"))
    before = {d: files(d) for d in range(1, 6)}
    event_store.append(again, path)
    event_store.append(again, path)
    assert [files(d) == before[d] for d in range(1, 6)] == [True, False, False, True, True]
    event_store.compact(spark, path, [date(2026, 1, 2)], again)
    assert len(files(2)) == 1 and files(4) == before[4]
    event_store.purge(spark, path, datetime(2026, 2, 2, 2), 30, again)  # the cutoff is on the third, at two
    left = sorted((r["day"].day, r["feedback_id"]) for r in event_store.read(spark, path, again).collect())
    assert left == [(3, "d3-2"), (3, "d3-3"), *[(d, f"d{d}-{i}") for d in (4, 5) for i in range(4)]] and files(5) == before[5]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["events"]  # nothing staged is left


def test_json_round_trip_and_exposition(spark, tmp_path):
    df = spark.createDataFrame([("PAYMENT", 1.5)], "transaction_type string, amount double")
    back = readers.parse_features(readers.encode_features(df, df.columns).select("features_json"), df.columns).first()["features"]
    assert back.asDict() == {"transaction_type": "PAYMENT", "amount": 1.5}
    assert sinks.exposition(df, "n", "amount", ["transaction_type"]).first()["line"] == 'n{transaction_type="PAYMENT"} 1.5'
    sinks.write_json({"a": 1}, tmp_path / "x.json")
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 1} and [p.name for p in tmp_path.iterdir()] == ["x.json"]


def test_config(tmp_path):
    (tmp_path / "d.yaml").write_text("raw_path: a\noutput_folder: b\nspark: {shuffle_partitions: 3}\n")
    assert config.data_config(str(tmp_path / "d.yaml")).spark.shuffle_partitions == 3
    (tmp_path / "m.yaml").write_text("models: [random_forest]\nthresholds: [0.5]\n")
    assert config.model_config(str(tmp_path / "m.yaml")).models == ("random_forest",)
    for text in ("raw_path: a\noutput_folder: b\ntrain_ratio: 0.9\n", "raw_path: a\noutput_folder: b\nx: 1\n", "[1]"):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ValueError):
            config.data_config(str(tmp_path / "bad.yaml"))


def test_sampling_and_weights_exclude_each_other():
    assert config.ModelConfig().imbalance == "none" and config.ModelConfig(imbalance="class_weights", train_strategy="none").imbalance == "class_weights"
    for policy in ("class_weights", "scale_pos_weight"):
        with pytest.raises(ValueError, match="twice"):
            config.ModelConfig(imbalance=policy)


def test_runs(spark, tmp_path):
    from txnlens.sources import tracking

    at = tmp_path / "t.yaml"
    at.write_text("tracking: {uri: ' /x ', experiment_name: e, registered_model_name: m}\n")
    assert config.tracking_config(str(at)).uri == "/x" and config.tracking_config(str(at)).artifact_location is None
    for text in ("tracking: {uri: '', experiment_name: e, registered_model_name: m}\n", "uri: x\n", "tracking: {uri: x, experiment_name: e, registered_model_name: m, artifact_location: ' '}\n", "tracking: {uri: x, experiment_name: 1, registered_model_name: m}\n"):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ValueError):
            config.tracking_config(str(tmp_path / "bad.yaml"))
    runs = tracking.Runs(spark, config.tracking_config(str(at), uri=str(tmp_path / "runs")))
    runs.log("a", {"model": {"depth": 3}}, {"pr_auc": 0.5}, {"stage": "try"})
    runs.log("b", {}, {"pr_auc": 0.75})
    runs.log("c", {}, {"pr_auc": float("nan")})
    with pytest.raises(ValueError, match="already"):
        runs.log("a", {}, {"pr_auc": 1.0})
    assert {tuple(r) for r in runs.read().filter("run = 'a'").collect()} == {("param", "model.depth", "3", "a"), ("metric", "pr_auc", "0.5", "a"), ("tag", "stage", "try", "a")}
    assert [tuple(r) for r in runs.ranked("pr_auc").orderBy("place").collect()] == [("b", 0.75, 1), ("a", 0.5, 2)]
    assert runs.ranked("pr_auc", largest=False).filter("place = 1").first()["run"] == "a" and runs.ranked("x").count() == 0


def test_gate_measures_the_contract(spark):
    from txnlens.operators.dataset import Dataset
    from txnlens.plans.contract import MODEL_DATASET, MODEL_FEATURES, passes

    assert passes(MODEL_FEATURES) and not passes(MODEL_FEATURES[::-1]) and not passes((*MODEL_FEATURES, "timestamp"))
    row = spark.createDataFrame([("m", 1, 1, 1, *[0.5] * 9)], "model string, row_count long, true_positives long, false_negatives long, pr_auc double, precision double, recall double, expected_cost_per_transaction double, brier_score double, alert_rate double, a double, b double, c double")
    for columns, want in ((MODEL_DATASET, True), (MODEL_DATASET[:-2], False)):
        data = Dataset(dict.fromkeys(SPLITS, spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))), {}, {"train": 0}, {"x": 2})
        got = pipeline.measure(row, row, data, {"pr_auc": 0.1}, 0.2).first()
        assert got["schema_contract_passed"] is want and got["split_overlap_count"] == 2


def test_manifest_and_approval(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/t")
    a = lineage.manifest(spark, f"{tmp_path}/t", {"id": "long"}, {"x": 1}, "now")
    assert a["dataset_id"] == lineage.manifest(spark, f"{tmp_path}/t", {"id": "long"}, {"x": 1}, "later")["dataset_id"]
    assert a["dataset_id"] != lineage.manifest(spark, f"{tmp_path}/t", {"id": "long"}, {"x": 2}, "now")["dataset_id"]
    lineage.approve(a, "me", tmp_path / "ok.json", "now")
    assert lineage.check_approval(a, tmp_path / "ok.json")["approved_by"] == "me"
    with pytest.raises(FileExistsError):
        lineage.approve(a, "me", tmp_path / "ok.json", "now")
    (tmp_path / "ok.json").write_text((tmp_path / "ok.json").read_text().replace('"me"', '"you"'))
    with pytest.raises(ValueError, match="changed"):
        lineage.check_approval(a, tmp_path / "ok.json")
    assert lineage.flatten({"a": {"b": 1}, "c": 2}) == {"a.b": 1, "c": 2} and lineage.run_metadata(spark, "r", {"a": {"b": 1}}, {"m": 1}).count() == 2


def table(spark, n=400):
    return spark.range(n).selectExpr("cast(id as string) as transaction_id", "case when id % 3 = 0 then 'PAYMENT' else 'TRANSFER' end as transaction_type", "cast(id % 100 as double) as amount", "cast(id % 7 as int) as transaction_hour", "cast(id % 100 > 70 as int) as is_fraud")


COLUMNS = ("transaction_type", "amount", "transaction_hour")


@pytest.mark.parametrize("name,params", [("logistic_regression", {}), ("random_forest", {"trees": 5, "depth": 4}), ("gradient_boosting", {"trees": 3, "depth": 3})])
def test_models_learn_and_take_unknown_types(spark, name, params):
    rows = table(spark)
    model = ml.train(rows, name, COLUMNS, **params)
    odd = rows.limit(1).selectExpr("transaction_id", "'NEW' as transaction_type", "cast(null as double) as amount", "transaction_hour", "is_fraud")
    scored = ml.score(model, rows.union(odd), COLUMNS)
    assert scored.columns == [*rows.columns, "risk_score"] and scored.filter("risk_score between 0 and 1").count() == 401
    assert scored.filter("(risk_score >= 0.5) = (is_fraud = 1)").count() > 370
    with pytest.raises(ValueError):
        ml.classifier("x")


def test_registry(spark, tmp_path):
    model = ml.train(table(spark, 60), "logistic_regression", COLUMNS, max_iter=2)
    r, t = registry.Registry(spark, str(tmp_path)), datetime(2026, 1, 1)
    assert [r.register("m", model, t) for _ in range(2)] == [1, 2]
    with pytest.raises(ValueError):
        r.promote("m", 1, "production", "me", t, approved=False)
    r.promote("m", 1, "production", "me", t, approved=True)
    with pytest.raises(ValueError):
        r.rollback("m", "production", "me", t)
    r.promote("m", 2, "production", "me", t, approved=True)
    assert r.current("m", "production") == 2 and r.rollback("m", "production", "me", t) == 1 and r.current("m", "production") == 1
    assert r.load("m", 2) is not None


def test_training_run(spark, tmp_path):
    from txnlens.plans.contract import MODEL_DATASET, MODEL_FEATURES

    values = ", ".join(f"cast(id % 100 as double) as {c}" if c != "transaction_type" else "case when id % 3 = 0 then 'PAYMENT' else 'TRANSFER' end as transaction_type" for c in MODEL_FEATURES)
    rows = spark.range(600).selectExpr("cast(id as string) as transaction_id", *values.split(", "), "cast(id % 100 > 70 as int) as is_fraud").select(*MODEL_DATASET)
    for i, n in enumerate(SPLITS):
        rows.filter(f"cast(transaction_id as int) % 3 = {i}").write.parquet(f"{tmp_path}/{n}")
    cfg = config.ModelConfig(models=("logistic_regression", "random_forest"), thresholds=(0.3, 0.5, 0.7))
    incumbent = dict.fromkeys(("pr_auc", "precision", "recall", "expected_cost_per_transaction", "brier_score", "calibration_error", "alert_rate"), 0.5)
    out = pipeline.run_training(spark, str(tmp_path), cfg, incumbent, logistic_regression={"max_iter": 20}, random_forest={"trees": 5, "depth": 4})
    assert out["test"]["recall"] > 0.8 and out["gate"]["status"] == "rejected" and "test.rows" in out["gate"]["failed_checks"]
    assert pipeline.model_card(out)["model"] == out["model"]


@pytest.mark.parametrize("files", [1, 3, 5])
def test_parquet_file_count(spark, tmp_path, files):
    sinks.write_parquet(spark.range(100), str(tmp_path / "t"), files)
    assert len(list((tmp_path / "t").glob("part-*"))) == files and spark.read.parquet(str(tmp_path / "t")).count() == 100
