"""Linear models of both tasks for all folds at once, with a certificate.

Rows of every fold lie in one table, keyed by fold.  Medians, means and deviations of all folds come
from one set of aggregates; a pass over the table then sums, within Spark's tasks, each
fold's normal equations: the ridge's (T2) and one step of iteratively reweighted least squares for
the logistic model (T1).  The driver solves the stacked systems, sends the weights out
and asks for the next pass until every fold's gradient is small, so the number of passes is that of
the slowest fold and not of folds.  Folds x (2 columns)^2 numbers are what the driver and a task hold.

Objectives (n rows of train): T1 ``|w|^2 / 2 + C sum s log(1 + exp(-y f))`` with balanced class weights ``s``, T2
``alpha |w|^2 + sum (y - f)^2``; intercepts are free.  Columns are less their mean over their (population)
deviation, constant ones 0; a column without train values is 0, and a column with missing ones has an indicator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import KEY
from .quantiles import quantiles
from .tables import written


def unpivoted(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """A row for each row and column: ``column`` (its place) and ``x``; made within the tasks."""
    cells = F.array(*[F.struct(F.lit(k).alias("column"), F.col(c).cast("double").alias("x")) for k, c in enumerate(columns)])
    return rows.select(*more, F.explode(cells).alias("c")).select(*more, "c.column", "c.x")


def column_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per fold and column of train: ``n``, ``missing``, ``median`` (null: no values), ``mean`` and ``deviation`` with medians filled in."""
    cells = unpivoted(rows.where(F.col("part") == "train"), columns, "fold_id")
    medians = written(quantiles(cells, ["fold_id", "column"], "x", 0.5).withColumnRenamed("quantile", "median"), "medians")
    filled = cells.join(medians, ["fold_id", "column"], "left").withColumn("full", F.coalesce("x", "median"))
    return filled.groupBy("fold_id", "column").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.first("median").alias("median"), F.avg("full").alias("mean"), F.stddev_pop("full").alias("deviation"))


def design(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``x``: standardised columns, then standardised indicators of missing values, by the statistics of the row's fold."""
    s = column_statistics(rows, columns)
    share = F.col("missing") / F.col("n")
    each = F.struct("column", "median", "mean", "deviation", share.alias("share"))
    folds = s.groupBy("fold_id").agg(F.array_sort(F.collect_list(each)).alias("_s"))  # a row for each fold, a cell for each column
    cells = F.arrays_zip("_s", F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    over = lambda x, d: F.when(d > 0, x / d).otherwise(0.0)
    value = F.transform(cells, lambda c: F.when(c["_s"]["median"].isNull(), 0.0).otherwise(over(F.coalesce(c["_x"], c["_s"]["median"]) - c["_s"]["mean"], c["_s"]["deviation"])))
    flag = F.transform(cells, lambda c: F.when(c["_s"]["median"].isNull(), 0.0).otherwise(over(c["_x"].isNull().cast("double") - c["_s"]["share"], F.sqrt(c["_s"]["share"] * (1 - c["_s"]["share"])))))
    return rows.join(F.broadcast(folds), "fold_id").withColumn("x", F.concat(value, flag)).drop("_s", *columns)


@dataclass
class Fold:
    """Where the fit of a fold stands: weights with the intercept last."""

    n: int
    positive: int
    w1: np.ndarray
    w2: np.ndarray
    before: np.ndarray | None = None
    objective: float = np.inf
    gradient1: float = np.inf
    gradient2: float = np.inf
    steps: int = 0
    done: bool = field(default=False)


def sums(folds: dict[str, Fold], c: float, ridge: bool):
    """A task's sums: of each fold that is not done the logistic model's objective, gradient and curvature, and with ``ridge`` the normal equations of T2."""
    now = {name: (f.w1, f.n, f.positive) for name, f in folds.items() if ridge or not f.done}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], np.ndarray] = {}

        def add(fold: str, what: str, value: np.ndarray) -> None:
            key = (fold, what)
            total[key] = total[key] + value if key in total else value

        for batch in batches:
            names = np.array(batch.column("fold_id").to_pylist(), object)
            x = batch.column("x").flatten().to_numpy().reshape(len(names), -1)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            label, truth = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("label", "y"))
            for fold in set(names.tolist()) & now.keys():
                w, n, positive = now[fold]
                mine = names == fold
                a, y = x[mine], label[mine]
                if 0 < positive < n:
                    weight = c * np.where(y > 0, n / (2 * positive), n / (2 * (n - positive)))
                    f = a @ w
                    p = 1 / (1 + np.exp(-np.clip(f, -700, 700)))
                    add(fold, "loss", np.array([[np.sum(weight * (np.logaddexp(0, f) - y * f))]]))
                    add(fold, "slope", (a.T @ (weight * (p - y)))[None, :])
                    add(fold, "curve", a.T @ (a * (weight * p * (1 - p))[:, None]))
                if ridge:
                    add(fold, "gram", a.T @ a)
                    add(fold, "cross", (a.T @ truth[mine])[None, :])
        keys = [(fold, what, i, row) for (fold, what), m in total.items() for i, row in enumerate(m)]
        columns = [pa.array([k[j] for k in keys], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64())))]
        yield pa.RecordBatch.from_arrays(columns, names=["fold_id", "what", "i", "v"])

    return run


def summed(train: DataFrame, folds: dict[str, Fold], c: float, ridge: bool) -> dict[str, dict[str, np.ndarray]]:
    """The sums over all tasks, added up by Spark cell by cell."""
    parts = train.mapInArrow(sums(folds, c, ridge), "fold_id string, what string, i int, v array<double>")
    cells = parts.select("fold_id", "what", "i", F.posexplode("v").alias("j", "v")).groupBy("fold_id", "what", "i", "j").agg(F.sum("v").alias("v"))
    got: dict[str, dict[str, dict]] = {}
    for r in cells.collect():
        got.setdefault(r["fold_id"], {}).setdefault(r["what"], {})[r["i"], r["j"]] = r["v"]
    out: dict[str, dict[str, np.ndarray]] = {}
    for fold, parts_ in got.items():
        for what, values in parts_.items():
            m = np.zeros((1 + max(i for i, _ in values), 1 + max(j for _, j in values)))
            for (i, j), v in values.items():
                m[i, j] = v
            out.setdefault(fold, {})[what] = m
    return out


def fit(rows: DataFrame, width: int, c: float = 1.0, alpha: float = 1.0, tolerance: float = 1e-8, most: int = 100) -> dict[str, Fold]:
    """Weights of both tasks for every fold of ``rows`` (``fold_id``, ``part``, ``x``, ``label``, ``y``); a step that does not lower the objective is halved."""
    train = rows.where((F.col("part") == "train") & F.col("label").isNotNull() & F.col("y").isNotNull()).select("fold_id", "x", F.col("label").cast("double").alias("label"), F.col("y").cast("double").alias("y"))
    counts = train.groupBy("fold_id").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("p")).collect()
    folds = {r["fold_id"]: Fold(r["n"], r["p"], np.zeros(width + 1), np.zeros(width + 1)) for r in counts}
    penalty = np.append(np.ones(width), 0.0)
    for step in range(most):
        got = summed(train, folds, c, ridge=step == 0)
        for name, f in folds.items():
            s = got.get(name, {})
            if step == 0:
                normal = s["gram"] + alpha * np.diag(penalty)
                f.w2 = np.linalg.lstsq(normal, s["cross"][0], rcond=None)[0]
                f.gradient2 = float(np.linalg.norm(normal @ f.w2 - s["cross"][0])) / f.n
                if not 0 < f.positive < f.n:
                    f.done, f.gradient1 = True, 0.0
            if f.done:
                continue
            f.steps = step + 1
            objective = float(s["loss"][0, 0]) + 0.5 * float(f.w1 @ (penalty * f.w1))
            if f.before is not None and objective > f.objective + 1e-12 * abs(f.objective):
                f.w1 = (f.w1 + f.before) / 2
                continue
            slope = s["slope"][0] + penalty * f.w1
            f.objective, f.gradient1 = objective, float(np.linalg.norm(slope)) / f.n
            if f.gradient1 < tolerance:
                f.done = True
                continue
            f.before = f.w1
            f.w1 = f.w1 - np.linalg.lstsq(s["curve"] + np.diag(penalty), slope, rcond=None)[0]
        if all(f.done for f in folds.values()):
            break
    return folds


def fits_table(rows: DataFrame, folds: dict[str, Fold]) -> DataFrame:
    """A row for each fold: train rows and positives, steps, and the norms of both gradients over the number of rows (the certificate)."""
    made = [(name, f.n, f.positive, f.steps, f.gradient1, f.gradient2) for name, f in sorted(folds.items())]
    return rows.sparkSession.createDataFrame(made, "fold_id string, n_train long, n_positive long, steps int, t1_gradient double, t2_gradient double")


def predict(rows: DataFrame, folds: dict[str, Fold]) -> DataFrame:
    """``t1_score`` and ``t2_prediction`` of test rows; a train part of one class gives a constant score."""
    made = [(name, f.w1[:-1].tolist(), float(f.w1[-1]), f.w2[:-1].tolist(), float(f.w2[-1]), None if 0 < f.positive < f.n else float(f.positive > 0)) for name, f in folds.items()]
    weights = rows.sparkSession.createDataFrame(made, "fold_id string, _a array<double>, _a0 double, _b array<double>, _b0 double, _one double")
    dot = lambda w: F.aggregate(F.zip_with("x", w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    out = rows.where(F.col("part") == "test").join(F.broadcast(weights), "fold_id")
    return out.select("fold_id", *KEY, F.coalesce("_one", 1 / (1 + F.exp(-(dot("_a") + F.col("_a0"))))).alias("t1_score"), (dot("_b") + F.col("_b0")).alias("t2_prediction"))


def fit_folds(rows: DataFrame, columns: list[str], options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions for the test rows of all folds, and the fits; ``rows`` has labels, parts and the feature columns."""
    options = options or {}
    made = written(design(rows.select("fold_id", "part", *KEY, F.col("high_impact_label").alias("label"), F.col("abnormal_return").alias("y"), *columns), columns), "design", spread=True)
    folds = fit(made, 2 * len(columns), options.get("C", 1.0), options.get("alpha", 1.0))
    return predict(made, folds), fits_table(made, folds)
