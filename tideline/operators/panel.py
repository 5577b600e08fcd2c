"""Event windows, calendars, the dense firm-day panel and what is counted over it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import cumulative
from .tables import shared_path

FIRM = ["market", "ticker"]
EVENT_FIRM = ["event_id", "market", "ticker"]


def period(date: Column) -> Column:
    """Before the event's start, during it (its last day included), or after."""
    return F.when(date < F.col("event_start_date"), "pre_event").when(date <= F.col("event_end_date"), "during_event").otherwise("post_event")


def pre_event_inputs(days: DataFrame) -> DataFrame:
    """The days of a panel that may be inputs: those before their event."""
    return days.where(F.col("is_pre_event_input") == 1)


def covered_days(events: DataFrame) -> DataFrame:
    """Distinct days of all event windows."""
    return events.select(F.explode(F.sequence("pre_start_date", "post_end_date")).alias("date")).distinct()


def runs(days: DataFrame, by: list[str]) -> DataFrame:
    """A row for each ``by`` with its ``runs`` of consecutive days, in order: an array of ``start`` and ``end``.

    Days are bits of 64-day words, so a group is a word and not a day, and no day is sorted; null days are left out.
    """
    day = F.unix_date("date")
    some = days.where(F.col("date").isNotNull())
    words = some.groupBy(*by, F.shiftright(day, 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, unix_date(date) & 63)")).alias("_m"))
    each = words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_w", "_m"))).alias("_words"))
    bits = lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(x["_m"], i) == 1), lambda i: x["_w"] * 64 + i)
    sets = each.select(*by, F.flatten(F.transform("_words", bits)).alias("_d"))
    alone = lambda at, n: F.coalesce(F.get("_d", at) != n, F.lit(True))
    starts, ends = F.filter("_d", lambda n, i: alone(i - 1, n - 1)), F.filter("_d", lambda n, i: alone(i + 1, n + 1))
    pairs = F.zip_with(starts, ends, lambda x, y: F.struct(F.date_from_unix_date(x).alias("start"), F.date_from_unix_date(y).alias("end")))
    return sets.select(*by, pairs.alias("runs"))


def islands(days: DataFrame, by: list[str]) -> DataFrame:
    """Runs of consecutive days: ``start`` and ``end`` of each."""
    return runs(days, by).select(*by, F.inline("runs"))


def chunks(ranges: DataFrame, days: int = 365) -> DataFrame:
    """Ranges cut into pieces of at most ``days`` days."""
    starts = F.sequence("start", "end", F.expr(f"interval {days} days"))
    return ranges.withColumn("_s", F.explode(starts)).select(*[c for c in ranges.columns if c not in ("start", "end")], F.col("_s").alias("start"), F.least(F.date_add("_s", days - 1), "end").alias("end"))


def fetch_grid(days: DataFrame, endpoints: DataFrame, landed: DataFrame) -> DataFrame:
    """Every endpoint and source on every day, with what has landed: complete, empty or missing.

    ``endpoints`` (``endpoint``, ``source``) is a short list of feeds.
    """
    grid = days.select("date").crossJoin(F.broadcast(endpoints))
    status = F.when(F.col("row_count").isNull(), "missing").when(F.col("row_count") == 0, "empty").otherwise("complete")
    return grid.join(landed.select("endpoint", "source", "date", "row_count"), ["endpoint", "source", "date"], "left").withColumn("status", status)


def interval_join(points: DataFrame, intervals: DataFrame, day: str, start: str, end: str, on: list[str] | None = None, width: int = 32) -> DataFrame:
    """Pairs of points and intervals that hold their ``day``, for any number of both; null ends are open.

    Days are dealt to buckets of ``width`` days.  An interval stands in each bucket that it touches between the first
    and the last day of the points, so it is copied once for ``width`` of its days, and rows meet by bucket (and ``on``).
    """
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / width)
    reach = points.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))  # one row
    clipped = intervals.join(F.broadcast(reach)).withColumns({"_a": F.greatest(F.coalesce(F.col(start), F.col("_lo")), F.col("_lo")), "_b": F.least(F.coalesce(F.col(end), F.col("_hi")), F.col("_hi"))})
    dealt = clipped.where(F.col("_a") <= F.col("_b")).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_a")), bucket(F.col("_b"))))).drop("_lo", "_hi")
    met = points.withColumn("_bucket", bucket(F.col(day))).join(dealt, [*(on or []), "_bucket"]).where(F.col(day).between(F.col("_a"), F.col("_b")))
    return met.drop("_bucket", "_a", "_b")


def eligible(events: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies whose membership covers an event's start; open ends allowed.  Any number of events."""
    return interval_join(events, companies, "event_start_date", "member_from", "member_to")


def eligible_counts(events: DataFrame, companies: DataFrame) -> DataFrame:
    """``events`` with ``firms``, the number of rows that ``eligible`` has for each; events without any have no row.

    The count of a day is what began up to it less what ended before it, so pairs of events and companies are never made.
    """
    start, end = F.col("member_from"), F.col("member_to")
    lasting = companies.where(F.coalesce(start <= end, F.lit(True)))
    begun = lasting.select(F.coalesce(start, F.lit("0001-01-01").cast("date")).alias("event_start_date"), F.lit(1).alias("n"))
    ended = lasting.where(end.isNotNull()).select(F.date_add(end, 1).alias("event_start_date"), F.lit(-1).alias("n"))
    asked = events.where(F.col("event_start_date").isNotNull()).select("event_start_date", F.lit(0).alias("n"))
    days = begun.unionByName(ended).unionByName(asked).groupBy("event_start_date").agg(F.sum("n").alias("n"))
    counts = cumulative(days, [], "event_start_date", ["n"]).select("event_start_date", (F.col("n_below") + F.col("n")).alias("firms"))
    return events.join(F.broadcast(counts.where(F.col("firms") > 0)), "event_start_date")  # a row for each day


def dense_panel(firms: DataFrame, prices: DataFrame, news: DataFrame) -> DataFrame:
    """Every eligible firm on every day of its event's window, with prices and news where there are any.

    ``firms`` is ``eligible``'s result.  Missing prices stay null; firms without news stay, with 0.  A firm's days are an array, so what is
    shuffled and sorted is a row for each firm; days become rows at the end, where they are.
    """
    date, more = F.col("date"), [c for c in prices.columns if c not in (*FIRM, "date")]
    priced = prices.where(date.isNotNull()).groupBy(*FIRM).agg(F.collect_list(F.struct("date", *more)).alias("_prices"))
    daily = news.where(date.isNotNull()).groupBy(*FIRM, "date").agg(F.count("*").alias("n"))
    told = daily.groupBy(*FIRM).agg(F.map_from_entries(F.collect_list(F.struct("date", "n"))).alias("_news"))
    dates = ["pre_start_date", "event_start_date", "event_end_date", "post_end_date"]
    met = firms.select(*EVENT_FIRM, *dates).join(priced, FIRM, "left").join(told, FIRM, "left")
    met = met.withColumns({"_a": F.least("pre_start_date", "post_end_date"), "_b": F.greatest("pre_start_date", "post_end_date"), "_days": F.sequence("pre_start_date", "post_end_date")})
    inside = lambda d: (d >= F.col("_a")) & (d <= F.col("_b"))
    met = met.withColumn("_prices", F.coalesce(F.filter("_prices", lambda p: inside(p["date"])), F.array().cast(priced.schema["_prices"].dataType)))
    met = met.withColumn("_news", F.map_filter("_news", lambda d, n: inside(d)))
    kinds = prices.schema
    alone = lambda d: F.struct(d.alias("date"), *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in more])
    rest = F.array_except("_days", F.transform("_prices", lambda p: p["date"]))
    full = F.concat("_prices", F.transform(rest, alone))
    told_of = F.transform(full, lambda p: F.struct(*[p[c].alias(c) for c in ("date", *more)], F.try_element_at("_news", p["date"]).alias("news_count")))
    rows = met.select(*EVENT_FIRM, "event_start_date", "event_end_date", F.inline(told_of))
    return flagged(rows.select(*FIRM, "date", "event_id", "event_start_date", "event_end_date", *more, "news_count"))


def flagged(full: DataFrame) -> DataFrame:
    return full.withColumns(
        {
            "news_count": F.coalesce("news_count", F.lit(0)),
            "has_news": (F.coalesce("news_count", F.lit(0)) > 0).cast("int"),
            "has_price": F.col("close").isNotNull().cast("int"),
            "event_period": period(F.col("date")),
            "is_pre_event_input": (F.col("date") < F.col("event_start_date")).cast("int"),
        }
    )


def selected_prices(prices: DataFrame, panel: DataFrame) -> DataFrame:
    """Price rows of any firm-day in the panel."""
    return prices.join(panel.select(*FIRM, "date"), [*FIRM, "date"], "left_semi")


def event_news(events: DataFrame, news: DataFrame, on: list[str] | None = None) -> DataFrame:
    """News of every event whose window holds its day (and that shares ``on``); one row may enter several events, of any number."""
    windows = events.select("event_id", *(on or []), "pre_start_date", "event_start_date", "event_end_date", "post_end_date")
    return interval_join(news, windows, "date", "pre_start_date", "post_end_date", on)


def event_news_counts(events: DataFrame, news: DataFrame, on: list[str]) -> DataFrame:
    """Per event the rows that ``event_news`` has for it: ``rows``, and ``before`` and ``after`` the event; events without any have no row.

    Equal windows (of the same ``on``) count once, over a row for each day's news, so pairs of events and news are never made.
    """
    dates = ["pre_start_date", "event_start_date", "event_end_date", "post_end_date"]
    windows = events.select(*on, *dates).distinct()
    daily = news.groupBy(*on, "date").agg(F.count("*").alias("n"))
    met = interval_join(daily, windows, "date", "pre_start_date", "post_end_date", on).withColumn("p", period(F.col("date")))
    of = lambda p: F.sum(F.when(F.col("p") == p, F.col("n")).otherwise(0))
    counts = met.groupBy(*on, *dates).agg(F.sum("n").alias("rows"), of("pre_event").alias("before"), of("post_event").alias("after"))
    w, e = counts.alias("w"), events.alias("e")
    same = [F.col(f"e.{c}") == F.col(f"w.{c}") for c in on] + [F.col(f"e.{c}").eqNullSafe(F.col(f"w.{c}")) for c in dates]  # an open end is null
    return e.join(w, same).groupBy("e.event_id").agg(*[F.sum(f"w.{c}").alias(c) for c in ("rows", "before", "after")])


def bucketed(df: DataFrame, name: str, buckets: int, by: list[str] = FIRM, order: str = "date") -> DataFrame:
    """The table written once as ``buckets`` files by ``by``, sorted, and read back: joins and groups by these keys need no exchange."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by, order).option("path", shared_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def bucketed_panel(firms: DataFrame, prices: DataFrame, news: DataFrame, buckets: int = 8) -> DataFrame:
    """``dense_panel`` over bucketed tables: prices and daily counts are joined where they lie.

    ``prices`` and ``news`` (daily counts) come from ``bucketed`` with the same number of buckets; only the firms, which become days
    after they are dealt, are shuffled.
    """
    firms.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # keys of the buckets are enough
    dealt = firms.repartition(buckets, *FIRM)
    days = dealt.select(*EVENT_FIRM, "event_start_date", "event_end_date", F.explode(F.sequence("pre_start_date", "post_end_date")).alias("date"))
    return flagged(days.join(prices.hint("merge"), [*FIRM, "date"], "left").join(news.hint("merge"), [*FIRM, "date"], "left"))


def coverage(panel: DataFrame) -> DataFrame:
    """Per event and firm: days with news and prices, matched news, and how it is in the universe."""
    mode = F.when(F.max("has_news") + F.max("has_price") == 0, "no_coverage").when(F.max("has_news") == 0, "price_only").when(F.max("has_price") == 0, "news_only").otherwise("covered")
    return panel.groupBy(*EVENT_FIRM).agg(F.sum("has_news").alias("news_days"), F.sum("has_price").alias("price_days"), F.sum("news_count").alias("matched_news"), mode.alias("universe_mode"))


def event_market_index(panel: DataFrame) -> DataFrame:
    """Companies, days, news and price rows per event and market."""
    return panel.groupBy("event_id", "market").agg(F.count_distinct("ticker").alias("companies"), F.count("*").alias("firm_days"), F.sum("news_count").alias("news_rows"), F.sum("has_price").alias("price_rows"))


def totals(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("firm_days"), F.count_distinct(*EVENT_FIRM).alias("event_firms"), F.sum("news_count").alias("news_rows"), F.sum("has_price").alias("price_rows"), F.sum("is_pre_event_input").alias("pre_event_days"))


def slice_summary(panel: DataFrame) -> DataFrame:
    """Totals of event-markets and of markets in one pass (``event_id`` null: the whole market)."""
    return panel.rollup("market", "event_id").agg(F.count("*").alias("firm_days"), F.count_distinct("ticker").alias("firms"), F.sum("has_price").alias("price_rows"), F.sum("has_news").alias("news_days")).where(F.col("market").isNotNull())


# ---- prices


def outcomes(prices: DataFrame, windows: DataFrame) -> DataFrame:
    """Close of the window's last trading day over its first, less 1.

    ``windows`` has ``event_id``, ``start``, ``end`` (broadcast).  Without two trading days the return is
    null and the flag false.
    """
    inside = prices.join(F.broadcast(windows.select("event_id", "start", "end")), F.col("date").between(F.col("start"), F.col("end")))
    inside = inside.where(F.col("close").isNotNull())
    agg = inside.groupBy(*EVENT_FIRM).agg(F.min_by("close", "date").alias("a"), F.max_by("close", "date").alias("b"), (F.min("date") < F.max("date")).alias("ok"))
    ok = F.col("ok") & (F.col("a") != 0)
    return agg.select(*EVENT_FIRM, F.when(ok, F.col("b") / F.col("a") - 1).alias("event_return"), ok.alias("label_available_flag"))


def price_features(panel: DataFrame) -> DataFrame:
    """Daily return over observed closes, trading-day and missing flags, forward-filled close, days to the event."""
    by = W.partitionBy(*EVENT_FIRM).orderBy("date")
    filled = F.last("close", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    before = F.last("close", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))
    seen = F.col("close").isNotNull()
    return panel.withColumns(
        {
            "price_daily_return": F.when(seen & (before != 0), F.col("close") / before - 1),
            "price_trading_day_flag": seen.cast("int"),
            "price_missing_flag": (~seen).cast("int"),
            "close_ffill": filled,
            "days_to_event_start": F.date_diff("event_start_date", "date"),
        }
    )


def from_chart(charts: DataFrame) -> DataFrame:
    """Daily-chart JSON to price rows.

    ``charts`` has ``market``, ``ticker``, ``chart`` (JSON text), ``from_date``, ``to_date``.  Parallel arrays are
    zipped (short ones give nulls), stamps become local days, days outside the range and without a close go, and of
    several stamps in a day the last counts.
    """
    numbers = "array<double>"
    schema = f"struct<chart:struct<result:array<struct<meta:struct<exchangeTimezoneName:string,currency:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<open:{numbers},high:{numbers},low:{numbers},close:{numbers},volume:{numbers}>>>>>>>"
    parsed = charts.select("market", "ticker", "from_date", "to_date", F.explode(F.from_json("chart", schema)["chart"]["result"]).alias("r"))
    quote = F.col("r.indicators.quote")[0]
    steps = F.arrays_zip(F.col("r.timestamp").alias("ts"), *[quote[c].alias(c) for c in ("open", "high", "low", "close", "volume")])
    rows = parsed.select("market", "ticker", "from_date", "to_date", F.col("r.meta.exchangeTimezoneName").alias("zone"), F.col("r.meta.currency").alias("currency"), F.posexplode(steps).alias("pos", "s"))
    local = F.from_utc_timestamp(F.timestamp_seconds("s.ts"), F.coalesce("zone", F.lit("UTC")))
    rows = rows.select("market", "ticker", F.to_date(local).alias("date"), *[F.col(f"s.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")], "currency", "pos", "from_date", "to_date")
    rows = rows.where(F.col("close").isNotNull() & F.col("date").between(F.col("from_date"), F.col("to_date")))
    last = W.partitionBy("market", "ticker", "date").orderBy(F.desc("pos"))
    return rows.withColumn("_r", F.row_number().over(last)).where(F.col("_r") == 1).drop("_r", "pos", "from_date", "to_date")


def from_vendor(rows: DataFrame) -> DataFrame:
    """Vendor daily rows (``market``, ``ticker``, ``trade_date`` as yyyyMMdd text, OHLC, ``vol``, ``load_order``, window).

    The first load of a day counts; lots of the mainland market are hundreds of shares; an empty volume stays empty.
    """
    first = W.partitionBy("market", "ticker", "trade_date").orderBy("load_order")
    date = F.expr("try_to_date(trade_date, 'yyyyMMdd')")
    one = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).withColumn("date", date)
    one = one.where(F.col("date").between(F.col("from_date"), F.col("to_date")))
    volume = F.when(F.col("market") == "CSI300", F.col("vol") * 100).otherwise(F.col("vol"))
    return one.select("market", "ticker", "date", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], volume.cast("double").alias("volume"))
