"""Daily news pools: duplicates, selection, representatives.

Candidates have ``market``, ``ticker``, ``date``, ``event_id``, ``dedupe_key``, ``article_id``, ``source``, ``source_type``,
``title``, ``content``, ``time``, ``file_name`` and the scores ``alignment_score``, ``quality_score``, ``source_priority``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import DIRECT_SOURCES, MIN_ALIGNMENT
from ..functions.scoring import representative

DAY = ["event_id", "market", "ticker", "date"]


def distinct_news(news: DataFrame) -> DataFrame:
    """Landed rows that repeat time, source, title and content, once."""
    return news.dropDuplicates(["time", "source", "title", "content"])


def best_duplicates(candidates: DataFrame) -> DataFrame:
    """One candidate per firm-day and dedupe key, with the group's size and sorted sources.

    One aggregate: the winner is the maximum of a struct, so copies are combined before the shuffle.  Titles and
    contents stay behind; ``with_texts`` brings those of the winners.
    """
    best = F.struct("quality_score", "source_priority", F.char_length("content").alias("length"), "time", "file_name", "article_id", "source", "source_type", "alignment_score")
    groups = candidates.groupBy(*DAY, "dedupe_key").agg(F.max(best).alias("b"), F.min("file_name").alias("first_file"), F.count("*").alias("duplicate_count"), F.array_sort(F.collect_set(F.nullif("source", F.lit("")))).alias("duplicate_sources"))
    flat = groups.select(*DAY, "dedupe_key", "b.*", "first_file", "duplicate_count", "duplicate_sources")
    return flat.withColumn("representative_score", representative(F.col("alignment_score"), F.col("quality_score"), F.col("source_priority"), F.col("duplicate_count")))


def with_texts(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pool rows with the ``title`` and ``content`` of their articles."""
    texts = candidates.select(*DAY, "article_id", "title", "content").dropDuplicates([*DAY, "article_id"])
    return rows.join(texts, [*DAY, "article_id"], "left")


def daily_pool(candidates: DataFrame, minimum: float = MIN_ALIGNMENT) -> DataFrame:
    """Deduplicated candidates with ``passes``, ``in_pool`` and ``rank`` in the pool.

    A day keeps what passes; a day in which nothing passes keeps everything.  Scores that agree to six digits are equal in the
    order: sums that are equal but for the last bit of a double are told apart by the next score, not by that bit.
    """
    deduped = best_duplicates(candidates)
    passes = F.coalesce(F.col("source_type").isin(*DIRECT_SOURCES), F.lit(False)) | (F.col("alignment_score") >= minimum)
    day = W.partitionBy(*DAY)
    order = day.orderBy(F.desc("in_pool"), F.desc(F.round("representative_score", 6)), F.desc("alignment_score"), F.desc(F.round("quality_score", 6)), F.desc("length"), F.desc("time"), "first_file", "article_id")
    rows = deduped.withColumn("passes", passes).withColumn("in_pool", F.col("passes") | ~F.max("passes").over(day))
    return rows.withColumn("rank", F.when(F.col("in_pool"), F.row_number().over(order)))


def strict_pool(pool: DataFrame, minimum: float = MIN_ALIGNMENT) -> DataFrame:
    """The pool behind a hard threshold, which undoes the fallback; ranks close up."""
    kept = pool.where(F.col("in_pool") & (F.col("alignment_score") >= minimum))
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(*DAY).orderBy("rank")))


def representatives(strict: DataFrame) -> DataFrame:
    """The first of each day's strict pool, with the pool's ids and sources in order."""
    of = F.array_sort(F.collect_list(F.struct("rank", "article_id", "source")))
    first = F.min_by(F.struct("article_id", "source", "representative_score"), "rank").alias("r")
    return strict.groupBy(*DAY).agg(first, of.alias("o"), F.count("*").alias("pool_candidate_count")).select(
        *DAY, "r.*", "pool_candidate_count", F.transform("o", lambda x: x["article_id"]).alias("pool_article_ids"), F.transform("o", lambda x: x["source"]).alias("pool_sources")
    )


def pool_stats(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """Raw, deduplicated and pooled candidates of each firm-day."""
    raw = candidates.groupBy(*DAY).agg(F.count("*").alias("raw_count"))
    kept = pool.groupBy(*DAY).agg(F.count("*").alias("deduped_count"), F.count_if("in_pool").alias("pool_count"))
    return raw.join(kept, DAY, "left")
