"""Baseline models: linear ones for all folds together (``linear``), others with Spark ML, fold by fold.

Preprocessing is learnt from train rows: medians for missing numbers, columns without any
train value dropped, indicators for columns with missing train values (linear models and
perceptrons), standardisation.  Libraries differ from others in their optimisers, in the
trees' growth (by depth here) and in the perceptron's hidden units (sigmoid here), so
models are compared by how well they score, not by coefficients.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import boost_folds
from .checks import KEY, ValidationError, require_empty, shared_test_rows, unmatched
from .labels import iter_task_frames
from .linear import fit_folds, unpivoted
from .metrics import matched, metric_table
from .quantiles import quantiles
from .reports import fold_summary
from .tables import written


def imputation(train: DataFrame, columns: list[str]) -> tuple[dict[str, float], list[str]]:
    """Exact medians of the columns that have train values, and the columns with missing ones; the columns go through ``quantiles`` together."""
    medians = {columns[r["column"]]: r["quantile"] for r in quantiles(unpivoted(train, columns), ["column"], "x", 0.5).collect()}
    missing = train.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    return {c: medians[c] for c in columns if c in medians}, [c for k, c in enumerate(columns) if c in medians and missing[f"n{k}"]]


def prepared(rows: DataFrame, medians: dict[str, float], missing: list[str]) -> DataFrame:
    """Medians in the place of nulls, and an indicator ``column__missing`` for each of ``missing``."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()}
    flags = {f"{c}__missing": F.col(c).isNull().cast("double") for c in missing}
    return rows.select(*[c for c in rows.columns if c not in filled], *[x.alias(c) for c, x in filled.items()], *[x.alias(c) for c, x in flags.items()])


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``features``: the columns less their mean, over their deviation, as an array."""
    made = VectorAssembler(inputCols=columns, outputCol="raw").transform(rows)
    out = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(made).transform(made)
    return out.withColumn("features", vector_to_array("scaled")).drop("raw", "scaled")


def estimator(task: str, model: str, n: int, width: int, options: dict, spread: float = 1.0):
    """T1 classifies ``high_impact_label``, T2 fits ``abnormal_return``.

    Spark fits the ridge to a label over its deviation (``spread``), so a penalty of ``alpha`` on the label as it is
    has to be multiplied by it.
    """
    target = {"featuresCol": "features", "labelCol": "label"}
    if model == "linear" and task == "T1":
        return LogisticRegression(**target, weightCol="weight", regParam=1 / (options.get("C", 1.0) * n), maxIter=options.get("max_iter", 2000), standardization=False)
    if model == "linear":
        return LinearRegression(**target, elasticNetParam=0.0, regParam=options.get("alpha", 1.0) * spread / n, standardization=False)
    if model == "mlp" and task == "T1":
        return MultilayerPerceptronClassifier(**target, layers=[width, *options.get("hidden", (128, 64)), 2], maxIter=options.get("max_iter", 200), seed=options.get("seed", 42))
    if model == "trees":
        shared = {"maxIter": options.get("n_estimators", 50), "stepSize": options.get("learning_rate", 0.03), "maxDepth": options.get("max_depth", 5), "subsamplingRate": options.get("subsample", 0.85), "featureSubsetStrategy": str(options.get("colsample", 0.85)), "seed": options.get("seed", 42)}
        return GBTClassifier(**target, **shared) if task == "T1" else GBTRegressor(**target, **shared)
    raise ValidationError(f"no model {model} for {task}")


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], task: str, model: str, options: dict) -> DataFrame:
    """``test`` with ``prediction_`` for a task; a train part of one class gives a constant score."""
    label = F.col("high_impact_label" if task == "T1" else "abnormal_return").cast("double")
    train = train.withColumn("label", label).where(F.col("label").isNotNull())
    spread = 1.0
    if task == "T1":
        n, positive = train.agg(F.count("*"), F.sum("label")).first()
        if not positive or positive == n:
            return test.withColumn("prediction_", F.lit(1.0 if positive else 0.0))
        train = train.withColumn("weight", F.when(F.col("label") == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive))))
    else:
        n, spread = train.agg(F.count("*"), F.stddev_pop("label")).first()
    medians, missing = imputation(train, columns)
    missing = missing if model != "trees" else []
    inputs = [*medians, *[f"{c}__missing" for c in missing]]
    if not inputs:
        raise ValidationError("no column has a value in train")
    stages = [VectorAssembler(inputCols=inputs, outputCol="raw" if model != "trees" else "features")]
    if model != "trees":
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    fitted = Pipeline(stages=[*stages, estimator(task, model, n, len(inputs), options, spread or 1.0)]).fit(prepared(train, medians, missing))
    out = fitted.transform(prepared(test, medians, missing))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), vector_to_array("probability")[1])) if task == "T1" else F.col("prediction")
    return out.withColumn("prediction_", score)


def train_reference_model(features: DataFrame, labels: DataFrame, membership: DataFrame, t1_model: str = "linear", t2_model: str = "linear", quantile: float = 0.9, options: dict | None = None) -> dict[str, DataFrame]:
    """Fit both tasks on every fold: ``predictions``, ``metrics``, ``folds`` and, of linear models, ``fits`` tables.

    Linear models of all folds are fitted together (``linear.fit_folds``), and so are trees (``boosting.boost_folds``); the
    loop over folds for other models is a loop over fits, with all data work in DataFrames.
    """
    frames = written(iter_task_frames(labels, membership, quantile), "frames")
    require_empty(shared_test_rows(frames), "samples tested in more than one fold")
    require_empty(unmatched(frames, features, KEY), "labelled samples without features")
    columns = [c for c, k in features.dtypes if c not in KEY and k in ("double", "float", "int", "bigint")]
    rows = written(frames.join(features, KEY), "samples", spread=True)
    out, more = None, {}
    if t1_model == t2_model == "linear":
        out, more["fits"] = fit_folds(rows, columns, options)
    elif t1_model == t2_model == "trees":
        out = boost_folds(rows, columns, options)[0]
    else:
        for fold in sorted(r[0] for r in frames.select("fold_id").distinct().collect()):
            mine = rows.where(F.col("fold_id") == fold)
            train, test = mine.where(F.col("part") == "train"), mine.where(F.col("part") == "test")
            one = fit_predict(train, test, columns, "T1", t1_model, options or {}).select("fold_id", *KEY, F.col("prediction_").alias("t1_score"))
            two = fit_predict(train, test, columns, "T2", t2_model, options or {}).select(*KEY, F.col("prediction_").alias("t2_prediction"))
            both = one.join(two, KEY)
            out = both if out is None else out.unionByName(both)
    return {"predictions": out, "metrics": metric_table(matched(frames, out), quantile=quantile), "folds": fold_summary(frames, len(columns), f"{t1_model}/{t2_model}"), **more}
