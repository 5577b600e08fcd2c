"""The demo study with known answers, and the rules around labels and splits."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import checks, labels, metrics

RETURNS = {"demo_train": [-0.12, -0.08, -0.05, -0.03, -0.01, 0, 0.01, 0.03, 0.05, 0.20], "demo_test": [-0.18, -0.07, -0.02, 0.01, 0.06, 0.20]}
PREDICTED = [(0.90, -0.15), (0.25, -0.04), (0.10, -0.01), (0.08, 0.02), (0.30, 0.05), (0.85, 0.18)]
LABEL = "event_id string, market string, ticker string, event_return double, label_available_flag string"
MEMBER = "fold_id string, part string, event_id string, market string, ticker string"


@pytest.fixture
def demo(spark):
    rows, n = [], 0
    for event, values in RETURNS.items():
        for x in values:
            n += 1
            rows.append((event, "DEMO", f"D{n:02d}", float(x), "true"))
    predictions = [("demo_test", "DEMO", f"D{11 + k}", a, b) for k, (a, b) in enumerate(PREDICTED)]
    member = [("demo__test", "train", "demo_train", "DEMO", None), ("demo__test", "test", "demo_test", "DEMO", None)]
    return spark.createDataFrame(rows, LABEL), spark.createDataFrame(predictions, "event_id string, market string, ticker string, t1_score double, t2_prediction double"), spark.createDataFrame(member, MEMBER)


def test_known_metrics(demo):
    got = {(r["task"], r["metric"]): r for r in metrics.evaluate_predictions(*demo).collect()}
    assert len(got) == 6
    want = {("T1", "auprc"): 1.0, ("T1", "auroc"): 1.0, ("T2", "mae"): 0.0183333333, ("T2", "spearman"): 1.0, ("T3", "ndcg_at_10pct"): 1.0, ("T3", "spearman"): 0.8857142857}
    for key, value in want.items():
        assert got[key]["value"] == pytest.approx(value, abs=1e-9)
    assert got["T1", "auprc"]["high_impact_threshold"] == pytest.approx(0.128)
    assert got["T3", "spearman"]["n_groups"] == 1 and got["T1", "auprc"]["n_groups"] is None


def test_threshold_is_inclusive_and_returns_are_centred(spark):
    rows = spark.createDataFrame([("b", "DEMO", "B01", -1.0, "true"), ("b", "DEMO", "B02", 1.0, "true")], LABEL)
    member = spark.createDataFrame([("f", p, "b", "DEMO", None) for p in ("train", "test")], MEMBER)
    frames = labels.task_frames(checks.base_labels(rows)[0], member)
    assert {r["high_impact_label"] for r in frames.collect()} == {1}
    assert all(abs(r[0]) < 1e-12 for r in frames.groupBy("part").agg(F.avg("abnormal_return")).select("avg(abnormal_return)").collect())


def test_materialised_labels_are_refused(demo):
    with pytest.raises(checks.ValidationError):
        checks.base_labels(demo[0].withColumn("high_impact_label", F.lit(1)))


def test_missing_prediction_fails(demo):
    with pytest.raises(checks.ValidationError, match="without a prediction"):
        metrics.evaluate_predictions(demo[0], demo[1].where("ticker <> 'D11'"), demo[2])


def test_single_class_has_no_value(spark):
    rows = spark.createDataFrame([(1, 0.2, 0), (1, 0.3, 0)], "g int, s double, y int")
    assert metrics.average_precision(rows, "s", "y", ["g"]).first()["auprc"] is None
    assert metrics.roc_area(rows, "s", "y", ["g"]).first()["auroc"] is None
    assert metrics.spearman(rows, "s", "y", ["g"]).first()["spearman"] is None


def test_flags(spark):
    rows = spark.createDataFrame([(" Yes ",), ("0",), (None,), ("maybe",)], "v string")
    assert [r[0] for r in rows.select(checks.as_flag(F.col("v"))).collect()] == [True, False, False, None]


def test_splits(spark):
    samples = spark.createDataFrame([(f"e{e}", f"m{m}", f"{m}{t}") for e in range(4) for m in range(4) for t in range(10)], "event_id string, market string, ticker string")
    assert labels.leave_one_out(samples, "event_id", "l").select("fold_id").distinct().count() == 4
    firm = labels.random_firm(samples)
    assert {(r["part"], r["n"]) for r in firm.groupBy("part", "market").agg(F.count_distinct("ticker").alias("n")).collect()} == {("train", 7), ("validation", 1), ("test", 2)}
    assert firm.groupBy("market", "ticker").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()


def test_model_queries_fit_the_whole_models(spark, monkeypatch):
    from tideline.operators import boosting, train
    from tideline.plans import QUERIES

    made, estimator = [], train.estimator

    def spied(*args):
        made.append((args[0], args[1], estimator(*args)))
        return made[-1][2]

    monkeypatch.setattr(train, "estimator", spied)
    QUERIES["ml5_perceptron"](spark, "/root/testdata/sf0.001")
    assert [(t, m, e.getMaxIter()) for t, m, e in made if m != "linear"] == [("T1", "mlp", 200)]
    real, grown = boosting.fit, []
    monkeypatch.setattr(boosting, "fit", lambda *args: grown.append(args[2]) or real(*args[:2], 1, *args[3:]))
    QUERIES["ml6_boosted_trees"](spark, "/root/testdata/sf0.001")
    assert grown == [50]


def test_rows_without_prediction_are_left_out_when_partial(spark):
    """Before: an error (m8_evaluate), and places and shares that counted rows without a score (o2_top_share)."""
    names = [(e, "m", str(k)) for e in ("a", "b") for k in range(12)]
    base = spark.createDataFrame([(*n, (i * 7 % 13) / 10, True) for i, n in enumerate(names)], "event_id string, market string, ticker string, event_return double, label_available_flag boolean")
    member = spark.createDataFrame([("f", "train", "a", "m", None), ("f", "test", "b", "m", None)], "fold_id string, part string, event_id string, market string, ticker string")
    pred = spark.createDataFrame([(*n, 0.1 + 0.01 * i, 0.02 * i) for i, n in enumerate(names) if n[2] != "3"], "event_id string, market string, ticker string, t1_score double, t2_prediction double")
    with pytest.raises(checks.ValidationError, match="without a prediction"):
        metrics.evaluate_predictions(base, pred, member)
    rows = metrics.evaluate_predictions(base, pred, member, partial=True).collect()
    assert len(rows) == 6 and {r["n_samples"] for r in rows} == {11}
    frames = labels.task_frames(base, member)
    mean = sum((i * 7 % 13) / 10 for i in range(12, 24)) / 12  # of all test rows
    got = metrics.matched(frames, pred, "inner")
    assert got.count() == 11 and abs(got.where("ticker = '0'").first()["abnormal_return"] - ((12 * 7 % 13) / 10 - mean)) < 1e-12
    assert metrics.top_share(got, "t3_score", ["fold_id", "event_id", "market"], share=1 / 11).count() == 1  # 12 rows would give 2
