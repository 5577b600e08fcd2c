"""Metrics of the three tasks as aggregates: no scores leave the cluster.

Ties share a mean rank (``average_rank``) or are grouped (average precision); where a
top-k has to cut through a tie the smaller ticker goes first.  Groups with one class,
one row or a constant side have no value (null), and means over groups skip them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .checks import GROUP, KEY, base_labels, prediction_table, require_empty
from .labels import task_frames
from .tables import written

TOP_SHARE = 0.10


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 in ascending order; equal values share the mean of their ranks."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def cumulative(rows: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Adds ``column_below``: a column's sum over the rows of the same ``by`` that stand below in ``order``.

    Rows are range-partitioned and written; sums run within the ranges, and the few sums of whole ranges are added, so
    no task holds a whole group.
    """
    ranged = written(rows.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "ranged")
    inside = W.partitionBy(*by, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    zero = F.lit(0)
    parts = ranged.groupBy(*by, "_part").agg(*[F.sum(c).alias(c) for c in columns]).select(*by, "_part", *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"_{c}") for c in columns])
    local = ranged.withColumns({f"{c}_below": F.coalesce(F.sum(c).over(inside), zero) for c in columns}).join(parts, [*by, "_part"])
    return local.withColumns({f"{c}_below": F.col(f"{c}_below") + F.col(f"_{c}") for c in columns}).drop("_part", *[f"_{c}" for c in columns])


def binary_metrics(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """``auprc`` and ``auroc`` of each group, from its distinct scores; null for a single class.

    Average precision sums, over distinct scores from high to low, the gain in recall times the precision.  The area
    under the ROC curve comes from the positives' rank sum, ties shared.
    """
    ties = rows.groupBy(*by, score).agg(F.sum(label).cast("long").alias("pos"), F.count("*").alias("n"))
    return binary_from(cumulative(ties, by, score, ["pos", "n"]), by)


def binary_from(steps: DataFrame, by: list[str]) -> DataFrame:
    """The same from distinct scores with ``pos``, ``n`` and what stands below them."""
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    steps = steps.join(totals, by)
    precision = (F.col("all_pos") - F.col("pos_below")) / (F.col("all_n") - F.col("n_below"))
    rank = F.col("n_below") + (F.col("n") + 1) / 2
    agg = steps.groupBy(*by).agg(F.sum(F.col("pos") * precision).alias("s"), F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    both = (p > 0) & (q > 0)
    return agg.select(*by, F.when(both, F.col("s") / p).alias("auprc"), F.when(both, (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auroc"))


def average_precision(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    return binary_metrics(rows, score, label, by).select(*by, "auprc")


def roc_area(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    return binary_metrics(rows, score, label, by).select(*by, "auroc")


def mean_absolute_error(rows: DataFrame, prediction: str, truth: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.abs(F.col(prediction) - F.col(truth))).alias("mae"))


def spearman(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Pearson correlation of average ranks; null for fewer than two rows or a constant side.  For groups of any size."""
    pairs = rows.groupBy(*by, a, b).agg(F.count("*").alias("m"))
    for name, value in (("_x", a), ("_y", b)):
        ties = pairs.groupBy(*by, value).agg(F.sum("m").alias("n"))
        ranks = cumulative(ties, by, value, ["n"]).select(*by, value, (F.col("n_below") + (F.col("n") + 1) / 2).alias(name))
        pairs = pairs.join(ranks, [*by, value])
    return correlation(pairs, by, F.col("m"))


def classified_and_ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``auprc``, ``auroc`` and ``spearman`` of ``t1_score`` and ``t2_prediction``: the ranks of all three values come from one sorted table."""
    some = lambda k, v, pos: F.struct(F.lit(k).alias("kind"), F.col(v).cast("double").alias("v"), pos.alias("pos"))
    values = F.array(some(0, "t1_score", F.col("high_impact_label").cast("long")), some(1, "t2_prediction", F.lit(0).cast("long")), some(2, "abnormal_return", F.lit(0).cast("long")))
    ties = rows.select(*by, F.explode(values).alias("x")).groupBy(*by, "x.kind", "x.v").agg(F.sum("x.pos").alias("pos"), F.count("*").alias("n"))
    steps = written(cumulative(ties, [*by, "kind"], "v", ["pos", "n"]), "ranks")
    pairs = rows.select(*by, F.col("t2_prediction").cast("double").alias("_a"), F.col("abnormal_return").cast("double").alias("_b"))
    for kind, value, name in ((1, "_a", "_x"), (2, "_b", "_y")):
        ranks = steps.where(F.col("kind") == kind).select(*by, F.col("v").alias(value), (F.col("n_below") + (F.col("n") + 1) / 2).alias(name))
        pairs = pairs.join(ranks, [*by, value])
    return binary_from(steps.where(F.col("kind") == 0), by).join(correlation(pairs, by, F.lit(1)), by)


def group_spearman(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """The same by windows, for groups that fit a task (the firms of an event and market)."""
    return correlation(rows.withColumns({"_x": average_rank(a, by), "_y": average_rank(b, by)}), by, F.lit(1))


def correlation(ranked: DataFrame, by: list[str], m: Column) -> DataFrame:
    x, y = F.col("_x"), F.col("_y")
    sums = ranked.groupBy(*by).agg(F.sum(m).alias("n"), F.sum(m * x).alias("x"), F.sum(m * y).alias("y"), F.sum(m * x * x).alias("xx"), F.sum(m * y * y).alias("yy"), F.sum(m * x * y).alias("xy"))
    n, vx, vy = F.col("n"), F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    return sums.select(*by, F.when((n >= 2) & (vx > 0) & (vy > 0), (n * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(vx * vy)).alias("spearman"))


def ndcg(rows: DataFrame, score: str, truth: str, by: list[str], share: float = TOP_SHARE, tie: str = "ticker") -> DataFrame:
    """Gain of the top share by score against the best gain; relevance is the truth's percentile rank."""
    n = F.count("*").over(W.partitionBy(*by))
    k = F.greatest(F.lit(1), F.ceil(n * F.lit(share)))
    ranked = rows.withColumns(
        {
            "_rel": average_rank(truth, by) / n,
            "_k": k,
            "_i": F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), tie)),
            "_j": F.row_number().over(W.partitionBy(*by).orderBy(F.desc(truth), tie)),
        }
    )
    gain = lambda place: F.sum(F.when(F.col(place) <= F.col("_k"), F.col("_rel") / F.log2(F.col(place) + 1)))
    return ranked.groupBy(*by).agg(gain("_i").alias("got"), gain("_j").alias("best")).select(*by, F.when(F.col("best") > 0, F.col("got") / F.col("best")).alias("ndcg"))


def top_share(rows: DataFrame, score: str, by: list[str], share: float = TOP_SHARE, tie: str = "ticker") -> DataFrame:
    """The rows of the top share (at least one) of each group by score, with their ``place``."""
    k = F.greatest(F.lit(1), F.ceil(F.count("*").over(W.partitionBy(*by)) * F.lit(share)))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), tie))
    return rows.withColumns({"_k": k, "place": place}).where(F.col("place") <= F.col("_k")).drop("_k")


def macro(groups: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean over groups that have a value, and how many do."""
    return groups.groupBy(*by).agg(F.avg(value).alias(value), F.count(value).alias("n_groups"))


def matched(frames: DataFrame, predictions: DataFrame, how: str = "left") -> DataFrame:
    """Test rows with their predictions; ``t3_score`` is the size of the predicted return.  ``inner``: only rows that have one."""
    test = frames.where(F.col("part") == "test")
    on = ["fold_id", *KEY] if "fold_id" in predictions.columns else KEY
    return test.join(predictions, on, how).withColumn("t3_score", F.abs("t2_prediction"))


def metric_table(rows: DataFrame, split_name: str = "split", quantile: float = 0.9, stored: bool = False) -> DataFrame:
    """Six rows per fold, one for each metric; fields of the ranking task are blank elsewhere.  The rows are computed once (``stored``: they are a written table)."""
    fold, group = ["fold_id"], ["fold_id", *GROUP]
    names = ["threshold", "label_protocol", "t1_score", "t2_prediction", "t3_score", "high_impact_label", "abnormal_return", "ranking_target"]
    rows = rows if stored else written(rows.select("fold_id", *KEY, *names), "matched")
    ranked = ndcg(rows, "t3_score", "ranking_target", group).join(group_spearman(rows, "t3_score", "ranking_target", group), group)
    ranked = ranked.groupBy("fold_id").agg(F.avg("ndcg").alias("ndcg"), F.avg("spearman").alias("t3_spearman"), F.count("*").alias("groups"))
    wide = (
        rows.groupBy("fold_id").agg(F.count("*").alias("n_samples"), F.max("threshold").alias("high_impact_threshold"), F.max("label_protocol").alias("label_protocol_version"), F.avg(F.abs(F.col("t2_prediction") - F.col("abnormal_return"))).alias("mae"))
        .join(classified_and_ranked(rows, fold), "fold_id")
        .join(ranked, "fold_id")
    )

    def line(task: str, metric: str, column: str) -> Column:
        ranking = task == "T3"
        return F.struct(
            F.lit(task).alias("task"), F.lit(metric).alias("metric"), F.col(column).alias("value"),
            (F.col("groups") if ranking else F.lit(None).cast("long")).alias("n_groups"),
            F.lit("abs(t2_prediction)" if ranking else "").alias("t3_source"), F.lit("event_id+market" if ranking else "").alias("t3_grouping"),
        )

    lines = F.array(line("T1", "auprc", "auprc"), line("T1", "auroc", "auroc"), line("T2", "mae", "mae"), line("T2", "spearman", "spearman"), line("T3", "ndcg_at_10pct", "ndcg"), line("T3", "spearman", "t3_spearman"))
    long = wide.withColumn("m", F.explode(lines))
    return long.select(
        F.lit(split_name).alias("split_name"), "fold_id", "m.task", "m.metric", "m.value", "n_samples", "m.n_groups",
        F.lit(quantile).alias("high_impact_quantile"), "high_impact_threshold", "label_protocol_version", "m.t3_source", "m.t3_grouping",
    )


def evaluate_predictions(labels: DataFrame, predictions: DataFrame, membership: DataFrame, quantile: float = 0.9, split_name: str = "split", partial: bool = False) -> DataFrame:
    """Check both tables, build the folds' labels, join the predictions and score them.

    The three tables have a row per sample or less; each is computed once.  A test row without a prediction is an error; with
    ``partial`` such rows still count for the labels (means, thresholds) but are not scored, and ``n_samples`` is what was.
    """
    labels, predictions, membership = written(labels, "labels"), written(predictions, "predictions"), written(membership, "membership")
    usable, wrong = base_labels(labels)
    require_empty(wrong, "base labels")
    typed, wrong = prediction_table(predictions)
    require_empty(wrong, "predictions")
    frames = task_frames(usable, membership, quantile)
    on = ["fold_id", *KEY] if "fold_id" in typed.columns else KEY
    there = written(matched(frames, typed.select(*on, "t1_score", "t2_prediction", F.lit(True).alias("_there")), "inner" if partial else "left"), "matched")
    require_empty(there.where(F.col("_there").isNull()).select(*on, F.lit("unmatched").alias("rule")), "test rows without a prediction")
    return metric_table(there, split_name, quantile, stored=True)
