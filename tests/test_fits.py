"""Exact quantiles and linear fits of all folds against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import linear, quantiles


@pytest.mark.parametrize("accuracy", [10_000, 40])
@pytest.mark.parametrize("q", [0.0, 0.9])
def test_quantiles_are_exact(spark, monkeypatch, accuracy, q):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(int(q * 10))
    groups = {"ties": rng.integers(0, 3, 500).astype(float), "one": np.ones(1), "two": np.array([1.0, 2.0]), "wide": 10.0 ** rng.uniform(-300, 300, 700), "hot": np.append(np.full(900, 7.0), rng.normal(size=300)), "none": np.array([])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None), ("two", None), (None, 3.0)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r["quantile"] for r in quantiles.quantiles(table, ["g"], "x", q).collect()}
    assert set(got) == {"ties", "one", "two", "wide", "hot"}
    for g, value in got.items():
        assert value == pytest.approx(np.quantile(groups[g], q), rel=1e-12)


def test_a_bracket_that_misses_is_opened(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 10)
    real = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, near, n: F.transform(real(c, near, n), lambda x: x * 0 + 1e6))
    table = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    assert {r["g"]: r["quantile"] for r in quantiles.quantiles(table, ["g"], "x", 0.5).collect()} == {0: 499.0, 1: 500.0}


def plain_fit(x, y, truth, c=1.0, alpha=1.0):
    """Standardise, then gradient steps to the end (T1) and a solved system (T2)."""
    missing = np.isnan(x)
    full = np.where(missing, np.nanmedian(x, axis=0), x)
    both = np.concatenate([full, missing.astype(float)], axis=1)
    mean, dev = both.mean(axis=0), both.std(axis=0)
    scale = lambda v: np.where(dev > 0, (v - mean) / np.where(dev > 0, dev, 1), 0)
    a = np.append(scale(both), np.ones((len(x), 1)), axis=1)
    n, p = len(y), y.sum()
    s = c * np.where(y > 0, n / (2 * p), n / (2 * (n - p)))
    pen = np.append(np.ones(a.shape[1] - 1), 0)
    w = np.zeros(a.shape[1])
    for _ in range(20000):
        g = a.T @ (s * (1 / (1 + np.exp(-a @ w)) - y)) + pen * w
        w -= g / (0.25 * s.max() * np.linalg.norm(a, 2) ** 2 + 1)
    ridge = np.linalg.solve(a.T @ a + alpha * np.diag(pen) + 1e-12 * np.eye(len(w)), a.T @ truth)

    def score(v):
        miss = np.isnan(v)
        b = np.append(scale(np.concatenate([np.where(miss, np.nanmedian(x, axis=0), v), miss.astype(float)], axis=1)), np.ones((len(v), 1)), axis=1)
        return 1 / (1 + np.exp(-b @ w)), b @ ridge

    return score


def test_all_folds_are_fitted_together(spark):
    rng = np.random.default_rng(8)
    rows, data = [], {}
    for fold in ("a", "b", "single"):
        x = rng.normal(size=(80, 3)) * [1, 30, 0]  # the last column is constant
        x[rng.random((80, 3)) < 0.1] = np.nan
        y = (np.nan_to_num(x[:, 0]) + rng.normal(size=80) > 1).astype(float) if fold != "single" else np.ones(80)
        truth = np.nan_to_num(x[:, 1]) * 0.1 + rng.normal(size=80)
        data[fold] = x, y, truth
        for k in range(80):
            rows.append((fold, "train" if k < 60 else "test", "e", "m", f"{fold}{k}", y[k], truth[k], *[None if np.isnan(v) else float(v) for v in x[k]], None))
    schema = "fold_id string, part string, event_id string, market string, ticker string, high_impact_label double, abnormal_return double, u double, v double, w double, none double"
    table = spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], schema).repartition(3)
    out, fits = linear.fit_folds(table, ["u", "v", "w", "none"])
    got = {(r["fold_id"], r["ticker"]): (r["t1_score"], r["t2_prediction"]) for r in out.collect()}
    assert len(got) == 60
    for fold, (x, y, truth) in data.items():
        if fold == "single":
            assert all(v[0] == 1.0 for (f, _), v in got.items() if f == fold)
            continue
        t1, t2 = plain_fit(x[:60], y[:60], truth[:60])(x[60:])
        assert [got[fold, f"{fold}{60 + k}"] for k in range(20)] == [(pytest.approx(p, abs=1e-5), pytest.approx(q, abs=1e-6)) for p, q in zip(t1, t2)]
    for r in fits.collect():
        assert r["t1_gradient"] < 1e-8 and r["t2_gradient"] < 1e-6 and r["n_train"] == 60


def plain_boosting(x, y, truth, edges, trees, rate, leaves, depth, least):
    """Level by level over rows, then trimmed by best gain; ``edges`` as the operator has them."""
    bins = np.stack([np.minimum(np.searchsorted(np.array(e), x[:, c]), len(e) - 1) for c, e in enumerate(edges)], 1)
    out = []
    for task, t in (("T1", y), ("T2", truth)):
        score = np.full(len(x), np.log(y.mean() / (1 - y.mean())) if task == "T1" else truth.mean())
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y, p * (1 - p)) if task == "T1" else (score - truth, np.ones(len(x)))

            def best(rows):
                found = (1e-12, None)
                for c in range(x.shape[1]):
                    for b in range(len(edges[c]) - 1):
                        left = rows[bins[rows, c] <= b]
                        right = rows[bins[rows, c] > b]
                        if min(len(left), len(right)) >= least:
                            gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[rows].sum() ** 2 / h[rows].sum()
                            if gain > found[0] + 1e-9:
                                found = (gain, (left, right))
                return found

            heap, ends, n = [(best(np.arange(len(x))), 0, np.arange(len(x)))], [], 1
            while heap:
                heap.sort(key=lambda e: -e[0][0])
                (gain, parts), level, rows = heap.pop(0)
                if parts is None or level >= depth or n >= leaves:
                    ends.append(rows)
                    continue
                n += 1
                heap += [(best(r), level + 1, r) for r in parts]
            for rows in ends:
                score[rows] -= rate * g[rows].sum() / h[rows].sum()
        out.append(1 / (1 + np.exp(-score)) if task == "T1" else score)
    return out


def test_boosted_trees_match_plain_ones(spark):
    from tideline.operators import boosting

    rng = np.random.default_rng(9)
    rows, data = [], {}
    for fold in ("a", "b", "single"):
        x = np.round(rng.normal(size=(150, 2)), 2)
        y = (x[:, 0] + rng.normal(size=150) > 0.5).astype(float) if fold != "single" else np.zeros(150)
        truth = x[:, 1] * (x[:, 0] > 0) + 0.1 * rng.normal(size=150)
        data[fold] = x, y, truth
        for part in ("train", "test"):  # scores of the train rows
            rows += [(fold, part, "e", "m", f"{k}", float(y[k]), float(truth[k]), float(x[k, 0]), float(x[k, 1])) for k in range(150)]
    table = spark.createDataFrame(rows, "fold_id string, part string, event_id string, market string, ticker string, high_impact_label double, abnormal_return double, u double, v double").repartition(3)
    options = {"n_estimators": 3, "learning_rate": 0.5, "num_leaves": 4, "max_depth": 3, "colsample": 1.0, "min_child_samples": 10, "max_bin": 16}
    out, _, edges = boosting.boost_folds(table, ["u", "v"], options)
    got = {(r["fold_id"], r["ticker"]): (r["t1_score"], r["t2_prediction"]) for r in out.collect()}
    for fold, (x, y, truth) in data.items():
        if fold == "single":
            assert all(v[0] == 0.0 for (f, _), v in got.items() if f == fold)
            continue
        t1, t2 = plain_boosting(x, y, truth, [edges[fold, c] for c in range(2)], 3, 0.5, 4, 3, 10)
        assert [got[fold, str(k)] for k in range(150)] == [(pytest.approx(p), pytest.approx(q)) for p, q in zip(t1, t2)]


def test_bins_have_equal_counts_and_medians_for_nulls(spark):
    from tideline.operators import boosting

    rows = [("f", "train", float(k) if k % 5 else None, None) for k in range(100)] + [("f", "test", 1e9, 1.0)]
    table = spark.createDataFrame(rows, "fold_id string, part string, x double, none double")
    got = {r["column"]: r for r in boosting.bin_edges(table, ["x", "none"], 4).collect()}
    full = np.sort([float(k) if k % 5 else 50.0 for k in range(100)])
    assert set(got) == {0} and got[0]["median"] == 50.0 and got[0]["edges"][-1] == 99.0 and full[24] <= got[0]["edges"][0] <= full[26]


def test_tables_of_many_passes_are_spread_and_scores_kept(spark):
    """Before, a small table was one file and each pass over it one task, and each pass applied all trees."""
    from tideline.operators import boosting
    from tideline.operators.tables import written

    rows = spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count()
    assert written(rows, "spread", spread=True).inputFiles().__len__() > 1
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 8, (50, 2)).astype(np.uint8)
    trees = []
    for k in range(3):
        t = boosting.Tree()
        t.split(0, {"nl": 5, "col": k % 2, "bin": 3 + k % 2, "gain": 1.0, "gl": 1.0 + k, "hl": 2.0, "g": -1.0, "h": 5.0}, 0.1)
        trees.append(t)
    some, whole = boosting.Model(0.5, trees=trees[:2]), boosting.Model(0.5, trees=trees)
    assert np.array_equal(whole.score(bins, some.score(bins), 2), whole.score(bins))


def test_prices_of_windows_are_those_of_all_days(spark):
    from tideline.plans import standin

    sf = "/root/testdata/sf0.001"
    windows = standin.input_windows(spark)
    some, every = standin.prices(spark, sf, windows), standin.prices(spark, sf)
    inside = every.join(windows, F.col("date").between(F.col("start"), F.col("end")), "left_semi")
    assert some.exceptAll(inside).isEmpty() and inside.exceptAll(some).isEmpty() and not some.isEmpty() and some.count() < every.count()
