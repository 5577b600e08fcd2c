"""Media attention of firms and markets by day: counts, tone, entropy, themes, rolling windows.

Mentions have ``event_id``, ``market``, ``ticker``, ``date``, ``article`` (id), ``url_hash``, ``source``, ``tone``, ``themes`` and
``entities`` (``;``-separated tokens).  The published tables define only the columns; the formulas are this module's:
an article is its url hash, else its id; positive tone is above 1, negative below -1; entropy is natural; shares of none
are 0; a rolling window of n days is n calendar days, the present one included; a burst is mean3 / (mean14 + 1), a tone
drop mean3 - mean14.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIRM_DAY = ["event_id", "market", "ticker", "date"]
MARKET_DAY = ["event_id", "market", "date"]
POSITIVE, NEGATIVE = 1.0, -1.0


def tokens(column: str) -> Column:
    return F.filter(F.split(F.coalesce(column, F.lit("")), ";"), lambda t: t != "")


def articles(mentions: DataFrame) -> DataFrame:
    return mentions.withColumns({"unit": F.coalesce(F.nullif("url_hash", F.lit("")), F.col("article").cast("string")), "tone": F.when(~F.isnan("tone"), F.col("tone"))})


def tone_counts(tone: str = "tone") -> list[Column]:
    t = F.col(tone)
    return [F.count_if(t > POSITIVE).alias("positive_news_count"), F.count_if(t < NEGATIVE).alias("negative_news_count"), F.count_if(t.between(NEGATIVE, POSITIVE)).alias("neutral_news_count"), F.count_if(t.isNull()).alias("tone_missing_count")]


def share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def entropy(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Natural entropy of a value's shares in each group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return sums.select(*by, F.greatest(F.ln("t") - F.col("s") / F.col("t"), F.lit(0.0)).alias(name))


def unit_rows(mentions: DataFrame, by: list[str]) -> DataFrame:
    """One row per article and group: the first source by name, the mean tone."""
    return articles(mentions).groupBy(*by, "unit").agg(F.min("source").alias("source"), F.avg("tone").alias("tone"))


def firm_days(mentions: DataFrame) -> DataFrame:
    """Per firm and day: articles, sources, their entropy, tone, counts and shares by tone, distinct themes and entities."""
    units = unit_rows(mentions, FIRM_DAY)
    base = units.groupBy(*FIRM_DAY).agg(
        F.count("*").alias("gdelt_news_count"), F.count_distinct("source").alias("gdelt_source_count"),
        F.avg("tone").alias("avg_gdelt_tone"), F.min("tone").alias("min_gdelt_tone"), F.max("tone").alias("max_gdelt_tone"), *tone_counts(),
    )
    count = lambda c, name: mentions.select(*FIRM_DAY, F.explode(tokens(c)).alias("t")).groupBy(*FIRM_DAY).agg(F.count_distinct("t").alias(name))
    out = base.join(entropy(units, FIRM_DAY, "source", "gdelt_source_entropy"), FIRM_DAY, "left")
    out = out.join(count("themes", "gdelt_theme_count"), FIRM_DAY, "left").join(count("entities", "gdelt_entity_count"), FIRM_DAY, "left")
    return out.fillna(0, ["gdelt_theme_count", "gdelt_entity_count"]).fillna(0.0, ["gdelt_source_entropy"]).withColumns({"positive_news_share": share("positive_news_count", "gdelt_news_count"), "negative_news_share": share("negative_news_count", "gdelt_news_count")})


def market_days(mentions: DataFrame, firms: DataFrame, eligible: DataFrame) -> DataFrame:
    """Per market and day, from ``firm_days``'s result and the eligible firms of each event and market.

    Mentions count firm by firm, articles once a market; equal-weighted tone is the mean of the firms' means.
    """
    size = eligible.groupBy("event_id", "market").agg(F.count_distinct("ticker").alias("eligible_firm_count"))
    by_firm = firms.groupBy(*MARKET_DAY).agg(
        F.count("*").alias("covered_firm_count"), F.sum("gdelt_news_count").alias("market_gdelt_firm_mention_count"),
        F.avg("avg_gdelt_tone").alias("avg_market_gdelt_tone_equal_weighted"), F.min("avg_gdelt_tone").alias("min_market_firm_tone"),
        F.count_if(F.col("avg_gdelt_tone") < 0).alias("negative_firm_count"), F.sum("negative_news_count").alias("market_negative_news_count"),
    )
    units = unit_rows(mentions, MARKET_DAY)
    by_article = units.groupBy(*MARKET_DAY).agg(F.count("*").alias("market_gdelt_unique_article_count"), F.avg("tone").alias("avg_market_gdelt_tone_news_weighted"), F.count_distinct("source").alias("market_source_count"))
    out = by_firm.join(by_article, MARKET_DAY).join(entropy(units, MARKET_DAY, "source", "market_source_entropy"), MARKET_DAY, "left").join(size, ["event_id", "market"], "left")
    return out.withColumns(
        {
            "covered_firm_share": share("covered_firm_count", "eligible_firm_count"),
            "negative_firm_share": share("negative_firm_count", "covered_firm_count"),
            "market_negative_news_share": share("market_negative_news_count", "market_gdelt_firm_mention_count"),
        }
    )


def top_themes(mentions: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """``TOKEN:n;...`` of each group's most frequent themes, ties by token."""
    counts = mentions.select(*by, F.explode(tokens("themes")).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "token"))).where(F.col("r") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "token", F.col("n").cast("string")).alias("x"))))
    return ranked.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda s: s["x"]), ";").alias("top_gdelt_themes"))


def theme_families(mentions: DataFrame, families: DataFrame, names: list[str], by: list[str], prefix: str) -> DataFrame:
    """Per family the mentions with one of its tokens, and their share.  ``families`` (``token``, ``family``) is broadcast."""
    marked = mentions.select(*by, "article", F.explode(F.array_distinct(tokens("themes"))).alias("token")).join(F.broadcast(families), "token").select(*by, "article", "family").distinct()
    counts = marked.groupBy(*by).agg(*[F.count_if(F.col("family") == n).alias(f"{prefix}_{n}_count") for n in names])
    total = mentions.groupBy(*by).agg(F.count("*").alias("_n"))
    out = total.join(counts, by, "left").fillna(0)
    return out.withColumns({f"{prefix}_{n}_share": share(f"{prefix}_{n}_count", "_n") for n in names}).drop("_n")


def rolling(days: DataFrame, by: list[str]) -> DataFrame:
    """3, 7 and 14 day sums and means of firm attention, and bursts."""
    at = F.datediff("date", F.lit("1970-01-01").cast("date"))
    over = lambda n: W.partitionBy(*by).orderBy(at).rangeBetween(-(n - 1), 0)
    total = lambda c, n: F.sum(c).over(over(n))
    tone = lambda n: F.avg("avg_gdelt_tone").over(over(n))
    count, negative = "gdelt_news_count", "negative_news_count"
    burst = lambda c: (total(c, 3) / 3) / (total(c, 14) / 14 + 1)
    return days.withColumns(
        {
            **{f"gdelt_news_count_{n}d": total(count, n) for n in (3, 7, 14)},
            **{f"gdelt_negative_count_{n}d": total(negative, n) for n in (3, 7)},
            "gdelt_negative_share_7d": F.when(total(count, 7) > 0, total(negative, 7) / total(count, 7)).otherwise(0.0),
            "gdelt_avg_tone_3d": tone(3), "gdelt_avg_tone_7d": tone(7), "gdelt_min_tone_7d": F.min("min_gdelt_tone").over(over(7)),
            "gdelt_news_burst_3d_vs_14d": burst(count), "gdelt_negative_burst_3d_vs_14d": burst(negative), "gdelt_tone_drop_3d_vs_14d": tone(3) - tone(14),
        }
    )


def rolling_market(days: DataFrame) -> DataFrame:
    """The same of a market's days."""
    at = F.datediff("date", F.lit("1970-01-01").cast("date"))
    over = lambda n: W.partitionBy("event_id", "market").orderBy(at).rangeBetween(-(n - 1), 0)
    total = lambda c, n: F.sum(c).over(over(n))
    tone = lambda n: F.avg("avg_market_gdelt_tone_equal_weighted").over(over(n))
    burst = lambda c: (total(c, 3) / 3) / (total(c, 14) / 14 + 1)
    m, bad, cover = "market_gdelt_firm_mention_count", "market_negative_news_count", "covered_firm_count"
    return days.withColumns(
        {
            **{f"market_gdelt_mentions_{n}d": total(m, n) for n in (3, 7, 14)},
            **{f"market_negative_news_{n}d": total(bad, n) for n in (3, 7)},
            "market_negative_share_7d": F.when(total(m, 7) > 0, total(bad, 7) / total(m, 7)).otherwise(0.0),
            "market_covered_firm_share_7d": F.avg("covered_firm_share").over(over(7)),
            "market_tone_drop_3d_vs_14d": tone(3) - tone(14), "market_negative_burst_3d_vs_14d": burst(bad), "market_coverage_burst_3d_vs_14d": burst(cover),
        }
    )


def news_structure(news: DataFrame, panel_days: DataFrame, covered_sources: DataFrame) -> DataFrame:
    """News structure of every firm-day, with event totals and the three kinds of missing.

    ``panel_days`` are the firm-days of the panel; ``covered_sources`` (``market``, ``ticker``) the firms a source covers.
    """
    day = ["event_id", "market", "ticker", "date"]
    n = news.groupBy(*day).agg(
        F.count("*").alias("source_news_count"), F.count_distinct("source").alias("source_count"),
        F.sum(F.char_length("title")).alias("title_char_count"), F.sum(F.char_length("content")).alias("content_char_count"),
        F.avg(F.char_length("title")).alias("avg_title_length"), F.avg(F.char_length("content")).alias("avg_content_length"),
        F.count_if(F.col("title") != "").alias("title_available_count"), F.count_if(F.col("content") != "").alias("content_available_count"),
    )
    full = panel_days.select(*day).join(n, day, "left").join(covered_sources.select("market", "ticker", F.lit(True).alias("_covered")).distinct(), ["market", "ticker"], "left")
    event = W.partitionBy("event_id", "market", "ticker")
    counts = ["source_news_count", "source_count", "title_char_count", "content_char_count", "title_available_count", "content_available_count"]
    seen = F.col("_covered").isNotNull()
    full = full.withColumns({c: F.when(seen, F.coalesce(c, F.lit(0))) for c in counts})
    return full.withColumns(
        {
            "event_source_news_count": F.sum("source_news_count").over(event),
            "event_source_active_day_count": F.count_if(F.col("source_news_count") > 0).over(event),
            "source_unavailable_flag": (~seen).cast("int"),
            "source_available_zero_news_flag": (seen & (F.col("source_news_count") == 0)).cast("int"),
            "source_news_missing_flag": (~seen | (F.col("source_news_count") == 0)).cast("int"),
        }
    ).drop("_covered")
