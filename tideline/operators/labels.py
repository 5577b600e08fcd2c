"""Splits, partition-centred returns, and task labels fitted on train alone.

All folds go through one plan: labels meet a membership table (``fold_id``, ``part``,
``event_id``, ``market``, ``ticker``; a null ticker stands for all), and every window
is partitioned by fold and part, so nothing crosses from test to train.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .checks import KEY, base_labels, empty_parts, require_empty

PROTOCOL = "split_part_market_return_v2"


def members(labels: DataFrame, membership: DataFrame) -> DataFrame:
    """Labels with the folds and parts that hold them.

    ``membership`` is the size of a split definition; the join is a hash join on event
    and market, below the windows.
    """
    m = membership.select("fold_id", "part", "event_id", "market", F.col("ticker").alias("_ticker")).distinct()
    one = m.where(F.col("_ticker").isNotNull()).withColumnRenamed("_ticker", "ticker")
    every = m.where(F.col("_ticker").isNull()).drop("_ticker")
    columns, on = ["fold_id", "part", *labels.columns], ["fold_id", "part"]
    return labels.join(one, KEY).select(columns).unionByName(labels.join(every, ["event_id", "market"]).join(one, [*on, *KEY], "left_anti").select(columns))


def centred(rows: DataFrame) -> DataFrame:
    """Return less the mean of its fold, part, event and market; and the same with the sample left out of the mean."""
    w = W.partitionBy("fold_id", "part", "event_id", "market")
    total, n, x = F.sum("event_return").over(w), F.count("event_return").over(w), F.col("event_return")
    return rows.withColumns(
        {
            "abnormal_return": x - F.avg("event_return").over(w),
            "abnormal_return_loo": F.when(n > 1, x - (total - x) / (n - 1)),
            "label_protocol": F.lit(PROTOCOL),
        }
    ).withColumn("abs_abnormal_return", F.abs("abnormal_return"))


def thresholds(rows: DataFrame, quantile: float) -> DataFrame:
    """Per fold the exact interpolated quantile of train's absolute abnormal returns; no task holds a fold."""
    from .quantiles import quantiles

    return quantiles(rows.where(F.col("part") == "train"), ["fold_id"], "abs_abnormal_return", quantile).withColumnRenamed("quantile", "threshold")


def task_frames(labels: DataFrame, membership: DataFrame, quantile: float = 0.9) -> DataFrame:
    """All folds' rows with ``part``, abnormal returns, ``threshold``, ``high_impact_label`` and ``ranking_target``."""
    rows = centred(members(labels, membership))
    return rows.join(thresholds(rows, quantile), "fold_id", "left").withColumns(
        {"high_impact_label": (F.col("abs_abnormal_return") >= F.col("threshold")).cast("tinyint"), "ranking_target": F.col("abs_abnormal_return")}
    )


def iter_task_frames(labels: DataFrame, membership: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Checked labels through ``task_frames``; one table of all folds."""
    usable, wrong = base_labels(labels)
    require_empty(wrong, "base labels")
    require_empty(empty_parts(members(usable, membership), quantile), "a fold lacks train or test rows")
    return task_frames(usable, membership, quantile)


def random_firm(samples: DataFrame, shares: tuple[float, float] = (0.7, 0.1), seed: int = 42) -> DataFrame:
    """Firms of each market dealt to train, validation and test in the order of a seeded hash."""
    firms = samples.select("market", "ticker").distinct()
    order = W.partitionBy("market").orderBy(F.md5(F.concat_ws("/", "ticker", F.lit(str(seed))).cast("binary")), "ticker")
    ranked = firms.withColumns({"r": F.row_number().over(order), "n": F.count("*").over(W.partitionBy("market"))})
    train, validation = F.round(F.col("n") * shares[0]), F.round(F.col("n") * shares[1])
    part = F.when(F.col("r") <= train, "train").when(F.col("r") <= train + validation, "validation").otherwise("test")
    events = samples.select("event_id", "market").distinct()
    return ranked.select("market", "ticker", part.alias("part")).join(events, "market").select(F.lit("random_firm__test").alias("fold_id"), "part", "event_id", "market", "ticker")


def leave_one_out(samples: DataFrame, column: str, name: str) -> DataFrame:
    """A fold for each value of ``event_id`` or ``market``: it is tested, the others train; no validation."""
    groups = samples.select("event_id", "market").distinct()
    held = groups.select(F.col(column).alias("_held")).distinct()  # events or markets: a handful
    pairs = groups.join(held)
    part = F.when(F.col(column) == F.col("_held"), "test").otherwise("train")
    return pairs.select(F.concat(F.lit(f"{name}__"), "_held").alias("fold_id"), part.alias("part"), "event_id", "market", F.lit(None).cast("string").alias("ticker"))


def chronological(samples: DataFrame, events: DataFrame, train: int = 2, validation: int = 1) -> DataFrame:
    """Events in the order of their start: the first train, the next validate, the others test."""
    order = W.orderBy("event_start_date", "event_id")  # one row per event
    ranked = events.select("event_id", F.row_number().over(order).alias("_r"))
    part = F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + validation, "validation").otherwise("test")
    return samples.select("event_id", "market").distinct().join(F.broadcast(ranked), "event_id").select(F.lit("chronological__test").alias("fold_id"), part.alias("part"), "event_id", "market", F.lit(None).cast("string").alias("ticker"))


def membership_counts(labels: DataFrame, membership: DataFrame) -> DataFrame:
    """Samples and firms of each fold, part and market."""
    return members(labels.select(*KEY), membership).groupBy("fold_id", "part", "market").agg(F.count("*").alias("n_samples"), F.count_distinct("ticker").alias("n_firms"))
