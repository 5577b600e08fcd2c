"""Samples' features from their pre-event days: aggregates, embedding means, padded sequences.

Nulls are skipped and NaN counts as null; ``std`` of fewer than two values is 0, a
``sum`` of none is 0, every other aggregate of none is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .checks import DAILY_KEY, KEY, ValidationError, base_labels, bad_keys, number, require_empty, unmatched

# The published daily columns, in their order, by modality.
PRICE = [
    "days_to_event_start", "open", "high", "low", "close", "volume", "price_daily_return", "price_trading_day_flag", "price_missing_flag",
    "close_ffill",
]
NEWS = [
    "source_news_count", "source_count", "title_char_count", "content_char_count", "avg_title_length", "avg_content_length", "title_available_count",
    "content_available_count", "event_source_news_count", "event_source_active_day_count", "source_unavailable_flag",
    "source_available_zero_news_flag", "source_news_missing_flag",
]
FIRM_GDELT = [
    "gdelt_news_count", "gdelt_source_count", "gdelt_source_entropy", "avg_gdelt_tone", "min_gdelt_tone", "max_gdelt_tone", "positive_news_count",
    "negative_news_count", "neutral_news_count", "tone_missing_count", "positive_news_share", "negative_news_share", "gdelt_theme_count",
    "gdelt_entity_count", "gdelt_news_count_3d", "gdelt_news_count_7d", "gdelt_news_count_14d", "gdelt_negative_count_3d", "gdelt_negative_count_7d",
    "gdelt_negative_share_7d", "gdelt_avg_tone_3d", "gdelt_avg_tone_7d", "gdelt_min_tone_7d", "gdelt_news_burst_3d_vs_14d",
    "gdelt_negative_burst_3d_vs_14d", "gdelt_tone_drop_3d_vs_14d", "gdelt_theme_war_conflict_count", "gdelt_theme_war_conflict_share",
    "gdelt_theme_sanction_count", "gdelt_theme_sanction_share", "gdelt_theme_energy_count", "gdelt_theme_energy_share",
    "gdelt_theme_supply_chain_trade_count", "gdelt_theme_supply_chain_trade_share", "gdelt_theme_financial_stress_count",
    "gdelt_theme_financial_stress_share", "gdelt_theme_policy_regulation_count", "gdelt_theme_policy_regulation_share",
    "gdelt_theme_disaster_health_count", "gdelt_theme_disaster_health_share", "gdelt_theme_protest_unrest_count", "gdelt_theme_protest_unrest_share",
    "gdelt_firm_coverage_missing_flag", "gdelt_firm_row_missing_flag",
]
MARKET_GDELT = [
    "eligible_firm_count", "covered_firm_count", "covered_firm_share", "market_gdelt_firm_mention_count", "market_gdelt_unique_article_count",
    "avg_market_gdelt_tone_equal_weighted", "avg_market_gdelt_tone_news_weighted", "min_market_firm_tone", "negative_firm_count",
    "negative_firm_share", "market_negative_news_count", "market_negative_news_share", "market_source_count", "market_source_entropy",
    "market_theme_count", "market_entity_count", "market_gdelt_mentions_3d", "market_gdelt_mentions_7d", "market_gdelt_mentions_14d",
    "market_negative_news_3d", "market_negative_news_7d", "market_negative_share_7d", "market_covered_firm_share_7d", "market_tone_drop_3d_vs_14d",
    "market_negative_burst_3d_vs_14d", "market_coverage_burst_3d_vs_14d", "market_theme_war_conflict_count", "market_theme_war_conflict_share",
    "market_theme_sanction_count", "market_theme_sanction_share", "market_theme_energy_count", "market_theme_energy_share",
    "market_theme_supply_chain_trade_count", "market_theme_supply_chain_trade_share", "market_theme_financial_stress_count",
    "market_theme_financial_stress_share", "market_theme_policy_regulation_count", "market_theme_policy_regulation_share",
    "market_theme_disaster_health_count", "market_theme_disaster_health_share", "market_theme_protest_unrest_count",
    "market_theme_protest_unrest_share", "gdelt_market_coverage_missing_flag", "gdelt_market_row_missing_flag",
]
SETS = {
    "S0": PRICE, "S1": PRICE + NEWS, "S2": PRICE, "S3": PRICE + FIRM_GDELT, "S4": PRICE + MARKET_GDELT,
    "S5": PRICE + FIRM_GDELT + MARKET_GDELT, "S6": PRICE + NEWS + FIRM_GDELT + MARKET_GDELT,
}
WITH_TEXT = {"S2", "S6"}
#: Columns that repeat one value over an event's days; a sum over days means nothing.
REPEATED = {"event_source_news_count", "event_source_active_day_count", "eligible_firm_count"}


def feature_columns(feature_set: str, present: list[str]) -> list[str]:
    """The set's columns that the table has."""
    if feature_set.upper() not in SETS:
        raise ValidationError(f"unknown feature set {feature_set}; known: {', '.join(SETS)}")
    return [c for c in SETS[feature_set.upper()] if c in set(present)]


def summed(column: str) -> bool:
    return column not in REPEATED and (column == "volume" or column.endswith(("_count", "_flag")))


def aggregate_days(daily: DataFrame, columns: list[str], key: list[str] = KEY, order: str = "date") -> DataFrame:
    """Per sample ``column__mean/std/min/max/last`` (and ``__sum``), and ``pre_event_day_count``; one shuffle."""
    work = daily.select(*key, order, *[number(F.col(c)).alias(c) for c in columns])
    aggs: list[Column] = []
    for c in columns:
        x = F.col(c)
        aggs += [F.avg(x).alias(f"{c}__mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
        aggs.append(F.max_by(x, F.when(x.isNotNull(), F.col(order))).alias(f"{c}__last"))
        if summed(c):
            aggs.append(F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{c}__sum"))
    return work.groupBy(*key).agg(*aggs, F.count("*").alias("pre_event_day_count"))


def embedding_columns(columns: list[str]) -> list[str]:
    """``emb_*`` columns in the order of their numbers."""
    mine = [c for c in columns if c.startswith("emb_")]
    if bad := [c for c in mine if not c[4:].isdigit()]:
        raise ValidationError(f"embedding columns without a number: {bad}")
    return sorted(mine, key=lambda c: int(c[4:]))


def as_array(embeddings: DataFrame) -> DataFrame:
    """Wide ``emb_*`` columns as one array ``embedding``."""
    wide = embedding_columns(embeddings.columns)
    return embeddings.select(*[c for c in embeddings.columns if c not in wide], F.array(*[number(F.col(c)) for c in wide]).alias("embedding"))


def mean_vectors(rows: DataFrame, vector: str, key: list[str]) -> DataFrame:
    """Element-wise mean over each key, nulls skipped: exploded by place, so partial sums are combined before the shuffle."""
    parts = rows.select(*key, F.posexplode(vector).alias("place", "x"))
    means = parts.groupBy(*key, "place").agg(F.avg(number(F.col("x"))).alias("x"))
    return means.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias(vector))


def aggregate_embeddings(embeddings: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Per sample the mean vector, the documents behind it, and an availability flag."""
    counts = embeddings.groupBy(*key).agg(F.coalesce(F.sum(number(F.col("text_doc_count"))), F.lit(0.0)).alias("text_embedding_doc_count"))
    return mean_vectors(embeddings, "embedding", key).join(counts, key).withColumn("text_embedding_available_flag", F.lit(1.0))


def build_event_feature_frame(daily: DataFrame, labels: DataFrame, feature_set: str = "S6", embeddings: DataFrame | None = None) -> DataFrame:
    """One row per labelled sample; a sample without days is an error.

    The label keys are joined before the aggregate, so days of unlabelled samples are not aggregated.
    """
    usable, wrong = base_labels(labels)
    require_empty(wrong, "base labels")
    columns = feature_columns(feature_set, daily.columns)
    keys = usable.select(*KEY)
    require_empty(unmatched(keys, daily, KEY), "labelled samples without pre-event features")
    frame = aggregate_days(daily.join(keys, KEY, "left_semi"), columns)
    if feature_set.upper() not in WITH_TEXT:
        return frame
    if embeddings is None:
        raise ValidationError(f"feature set {feature_set} needs text embeddings")
    vectors = embeddings if "embedding" in embeddings.columns else as_array(embeddings)
    joined = frame.join(aggregate_embeddings(vectors.join(keys, KEY, "left_semi")), KEY, "left")
    return joined.fillna(0.0, ["text_embedding_doc_count", "text_embedding_available_flag"])


def padded(rows: DataFrame, key: list[str], order: str, vector: Column, width: int, length: int) -> DataFrame:
    """Per key the last ``length`` vectors in ascending order, padded with null vectors on the left, and the mask."""
    last = W.partitionBy(*key).orderBy(F.desc(order))
    kept = rows.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= length)
    steps = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), vector.alias("v")))).alias("s"))
    gap = F.lit(length) - F.size("s")
    blank = F.array_repeat(F.lit(None).cast("float"), width)
    return steps.select(*key, F.concat(F.array_repeat(blank, gap), F.transform("s", lambda x: x["v"])).alias("values"), F.concat(F.array_repeat(F.lit(False), gap), F.transform("s", lambda x: F.lit(True))).alias("mask"))


def build_sequence_batch(daily: DataFrame, labels: DataFrame, feature_set: str = "S6", embeddings: DataFrame | None = None, max_length: int = 90) -> tuple[DataFrame, list[str]]:
    """Per labelled sample ``values`` (steps × features, float) and ``mask``; and the features' names."""
    if max_length <= 0:
        raise ValidationError("max_length is at least 1")
    usable, wrong = base_labels(labels)
    require_empty(wrong, "base labels")
    keys = usable.select(*KEY)
    require_empty(unmatched(keys, daily, KEY), "labelled samples without a pre-event sequence")
    names = feature_columns(feature_set, daily.columns)
    rows = daily.join(keys, KEY, "left_semi").select(*DAILY_KEY, *[number(F.col(c)).cast("float").alias(c) for c in names])
    vector = F.array(*[F.col(c) for c in names])
    if feature_set.upper() in WITH_TEXT:
        if embeddings is None:
            raise ValidationError(f"feature set {feature_set} needs text embeddings")
        require_empty(bad_keys(embeddings, DAILY_KEY), "embeddings")
        wide = embedding_columns(embeddings.columns)
        text = embeddings.select(*DAILY_KEY, number(F.col("text_doc_count")).cast("float").alias("text_embedding_doc_count"), F.lit(1.0).cast("float").alias("text_embedding_available_flag"), *[number(F.col(c)).cast("float").alias(c) for c in wide])
        more = ["text_embedding_doc_count", "text_embedding_available_flag"]
        rows = rows.join(text, DAILY_KEY, "left").fillna(0.0, more)
        names = [*names, *more, *wide]
        vector = F.array(*[F.col(c) for c in names])
    return padded(rows, KEY, "date", vector, len(names), max_length), names
