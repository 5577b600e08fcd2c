"""Daily panel, embeddings and sequences of the small multimodal fixture."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.operators import checks, features, train

START = {"demo_train": dt.date(2024, 1, 10), "demo_test": dt.date(2024, 2, 10)}


@pytest.fixture(scope="module")
def study(spark):
    daily, emb, lab = [], [], []
    for i in range(16):
        event = "demo_train" if i < 10 else "demo_test"
        lab.append((event, "DEMO", f"D{i + 1:02d}", (i % 7 - 3) / 20 + i / 500, "true"))
        for j in range(3):
            day = START[event] - dt.timedelta(days=3 - j)
            daily.append((event, "DEMO", f"D{i + 1:02d}", day, START[event], 3 - j, 100.0 + i + j, 1000.0 + 10 * i, 0.001 * (i - j), float((i + j) % 3), 0.0, float(i + j), float(j - 1), 20.0 + j, 0.25 * j))
            if len(daily) % 2:
                emb.append((event, "DEMO", f"D{i + 1:02d}", day, 1, 2, 0.1, -0.2))
    names = "days_to_event_start int, close double, volume double, price_daily_return double, source_news_count double, source_news_missing_flag double, gdelt_news_count double, avg_gdelt_tone double, market_gdelt_unique_article_count double, avg_market_gdelt_tone_equal_weighted double"
    return (
        spark.createDataFrame(daily, f"event_id string, market string, ticker string, date date, event_start_date date, {names}"),
        spark.createDataFrame(lab, "event_id string, market string, ticker string, event_return double, label_available_flag string"),
        spark.createDataFrame(emb, "event_id string, market string, ticker string, date date, text_doc_count int, embedding_dim int, emb_000 double, emb_001 double"),
    )


def test_full_set_has_all_modalities(study):
    frame = features.build_event_feature_frame(study[0], study[1], "S6", features.as_array(study[2]))
    assert frame.count() == 16
    for c in ("close__last", "volume__sum", "source_news_count__sum", "gdelt_news_count__mean", "market_gdelt_unique_article_count__max", "text_embedding_doc_count", "embedding", "pre_event_day_count"):
        assert c in frame.columns
    assert "close__sum" not in frame.columns
    first = frame.where("ticker = 'D01'").first()
    assert first["close__last"] == 102.0 and first["close__std"] == pytest.approx(1.0) and first["volume__sum"] == 3000.0


def test_nulls_and_nan_are_skipped(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, float("nan")), ("b", 1, None)], "k string, date int, volume double")
    got = {r["k"]: r for r in features.aggregate_days(rows, ["volume"], ["k"]).collect()}
    assert got["a"]["volume__last"] == 1.0 and got["a"]["volume__std"] == 0.0 and got["a"]["pre_event_day_count"] == 2
    assert got["b"]["volume__sum"] == 0.0 and got["b"]["volume__mean"] is None


def test_leak_is_found(study):
    moved = study[0].withColumn("date", F.when(F.col("ticker") == "D01", F.col("event_start_date")).otherwise(F.col("date")))
    assert checks.leaking_days(study[0]).isEmpty()
    with pytest.raises(checks.ValidationError):
        checks.require_empty(checks.leaking_days(moved), "daily")


def test_sequences(study):
    batch, names = features.build_sequence_batch(study[0], study[1], "S6", study[2], 4)
    rows = batch.collect()
    assert len(rows) == 16 and all(len(r["values"]) == 4 and r["mask"] == [False, True, True, True] for r in rows)
    assert names[-2:] == ["emb_000", "emb_001"] and all(len(v) == len(names) for v in rows[0]["values"])


def test_embedding_order():
    assert features.embedding_columns(["emb_1000", "emb_101", "emb_100", "x"]) == ["emb_100", "emb_101", "emb_1000"]
    with pytest.raises(checks.ValidationError):
        features.embedding_columns(["emb_x"])


def test_unknown_set():
    with pytest.raises(checks.ValidationError):
        features.feature_columns("S9", [])


def test_training(spark, study):
    frame = features.build_event_feature_frame(study[0], study[1], "S0")
    member = spark.createDataFrame([("d__test", p, e, "DEMO", None) for p, e in (("train", "demo_train"), ("test", "demo_test"))], "fold_id string, part string, event_id string, market string, ticker string")
    run = train.train_reference_model(frame, study[1], member)
    rows = run["predictions"].collect()
    assert len(rows) == 6 and all(0 <= r["t1_score"] <= 1 for r in rows)
    assert run["metrics"].count() == 6 and run["folds"].first()["n_train"] == 10


def test_medians_and_indicators(spark):
    rows = spark.createDataFrame([(1.0, None, None), (3.0, 2.0, None)], "a double, b double, c double")
    medians, missing = train.imputation(rows, ["a", "b", "c"])
    assert medians == {"a": 2.0, "b": 2.0} and missing == ["b"]
    assert train.prepared(rows, medians, missing).first()["b__missing"] == 1.0


def test_runs_of_days_are_found_in_words_not_in_sorted_days(spark):
    import random

    from tideline.operators import panel

    rng, first = random.Random(5), dt.date(1969, 10, 1)
    days = {k: {first + dt.timedelta(rng.randrange(260)) for _ in range(k * 30)} for k in range(1, 7)} | {7: {first + dt.timedelta(n) for n in range(200)}, 8: {dt.date(1970, 1, 1)}}
    rows = [(k, d) for k, some in days.items() for d in some for _ in range(2)] + [(1, None), (9, None)]
    found = panel.islands(spark.createDataFrame(rows, "k int, date date"), ["k"])
    want = []
    for k, some in days.items():
        ends = [d for d in sorted(some) if d + dt.timedelta(1) not in some]
        want += [(k, a, b) for a, b in zip([d for d in sorted(some) if d - dt.timedelta(1) not in some], ends)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()  # before: each day was a group and was sorted
