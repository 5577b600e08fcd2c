"""Inputs of the event-study operators, derived from the driver's tables, in Spark and in SQL.

Firms are suppliers, markets regions, price days line items by ship date, news the
documents, attention the events.  ``CTE`` has the same definitions for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# event, pre-window start, start, end, post-window end
CALENDAR = [
    ("e1", "1995-10-01", "1996-01-01", "1996-02-15", "1996-05-01"),
    ("e2", "1997-01-01", "1997-04-01", "1997-05-15", "1997-08-01"),
    ("e3", "1998-06-01", "1998-09-01", "1998-10-15", "1999-01-01"),
    ("e4", "2000-03-01", "2000-06-01", "2000-07-15", "2000-10-01"),
]
DATES = ["pre_start_date", "event_start_date", "event_end_date", "post_end_date"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(CALENDAR, "event_id string, pre_start_date string, event_start_date string, event_end_date string, post_end_date string")
    return rows.withColumns({d: F.to_date(d) for d in DATES})


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("r_name").alias("market"), F.col("s_suppkey").cast("string").alias("ticker"), "s_suppkey", F.col("s_name").alias("company_name"))


def prices(spark: SparkSession, sf_dir: str, windows: DataFrame | None = None) -> DataFrame:
    """Days are aggregated by supplier number before the (small) firm table is joined.

    Line items are dealt by supplier first: few share a day, so aggregates before a shuffle would only fill a task's memory.
    With ``windows`` (``start``, ``end``) only the days in some of them: they are chosen before line items are shuffled.
    """
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    if windows is not None:
        lines = lines.join(F.broadcast(windows.select(F.explode(F.sequence("start", "end")).alias("date")).distinct()), "date", "left_semi")  # days of a calendar
    dealt = lines.select("l_suppkey", "date", "l_extendedprice", "l_quantity").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_suppkey")
    days = dealt.groupBy("l_suppkey", "date").agg(F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").alias("volume"))
    return days.join(firms(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")).select("market", "ticker", "date", "high", "low", F.col("high").alias("close"), "volume")


def price_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of ``prices`` by supplier number, a row for each line item, dealt by supplier so that what is counted for one needs no further shuffle."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date")).repartition("l_suppkey")


def outcome_windows(spark: SparkSession) -> DataFrame:
    return calendar(spark).select("event_id", F.col("event_start_date").alias("start"), F.col("event_end_date").alias("end"))


def before_windows(spark: SparkSession) -> DataFrame:
    return calendar(spark).select("event_id", F.date_sub("event_start_date", 45).alias("start"), F.date_sub("event_start_date", 1).alias("end"))


def panel_windows(spark: SparkSession) -> DataFrame:
    return calendar(spark).select("event_id", F.col("pre_start_date").alias("start"), F.col("post_end_date").alias("end"))


def input_windows(spark: SparkSession) -> DataFrame:
    return calendar(spark).select("event_id", F.col("pre_start_date").alias("start"), F.date_sub("event_start_date", 1).alias("end"))


def predictions(before: DataFrame) -> DataFrame:
    t2 = F.coalesce("event_return", F.lit(0.0))
    return before.select("event_id", "market", "ticker", (F.abs(t2) / (1 + F.abs(t2))).alias("t1_score"), t2.alias("t2_prediction"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news of a day: the first line is the title, the rest the content; three or so firms share a document's number."""
    text = F.coalesce("text", F.lit(""))
    cut = F.instr(text, "\n")
    title = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)
    content = F.when(cut > 0, F.substring(text, cut + 1, F.lit(1 << 30))).otherwise("")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"), "source", "lang", title.alias("title"), content.alias("content"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mentions of firms: ``user_id`` picks the firm, ``event_type`` is the source, ``value`` less 50 the tone."""
    n = firms(spark, sf_dir).agg(F.count("*").cast("long").alias("k"))
    order = firms(spark, sf_dir).select("market", "ticker", (F.col("s_suppkey") - 1).alias("place"))
    rows = table(spark, sf_dir, "events").crossJoin(F.broadcast(n)).withColumn("place", F.col("user_id") % F.col("k"))
    rows = rows.join(order, "place")
    theme = F.get_json_object("props", "$.k")
    return rows.select(
        F.lit("e1").alias("event_id"), "market", "ticker", F.to_date("ts").alias("date"), F.col("event_id").alias("article"),
        F.concat(F.lit("u"), (F.col("event_id") % 5000).cast("string")).alias("url_hash"), F.col("event_type").alias("source"), (F.col("value") - 50).alias("tone"),
        F.concat(F.lit("T"), F.coalesce(theme, F.lit("")), F.lit(";"), F.upper("event_type")).alias("themes"), F.concat(F.lit("E"), (F.col("user_id") % 7).cast("string")).alias("entities"),
    )


CTE = f"""
cal AS (SELECT * FROM (VALUES {", ".join(f"('{e}', DATE '{a}', DATE '{b}', DATE '{c}', DATE '{d}')" for e, a, b, c, d in CALENDAR)}) t(event_id, pre_start_date, event_start_date, event_end_date, post_end_date)),
firm AS (SELECT r_name AS market, s_suppkey::VARCHAR AS ticker, s_suppkey, s_name AS company_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
price AS (SELECT market, ticker, l_shipdate::DATE AS date, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  max(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem JOIN firm ON l_suppkey = s_suppkey GROUP BY ALL),
outcome AS (SELECT event_id, market, ticker, CASE WHEN min(date) < max(date) THEN arg_max(close, date) / arg_min(close, date) - 1 END AS event_return,
  min(date) < max(date) AS label_available_flag FROM price JOIN cal ON date BETWEEN event_start_date AND event_end_date GROUP BY ALL),
label AS (SELECT * FROM outcome WHERE label_available_flag),
pred AS (SELECT event_id, market, ticker, abs(x) / (1 + abs(x)) AS t1_score, x AS t2_prediction FROM (
  SELECT event_id, market, ticker, coalesce(CASE WHEN min(date) < max(date) THEN arg_max(close, date) / arg_min(close, date) - 1 END, 0.0) AS x
  FROM price JOIN cal ON date BETWEEN event_start_date - 45 AND event_start_date - 1 GROUP BY ALL)),
news AS (SELECT doc_id, DATE '1996-01-01' + (doc_id % 30)::INTEGER AS date, source, lang,
  CASE WHEN instr(t, chr(10)) > 0 THEN substr(t, 1, instr(t, chr(10)) - 1) ELSE t END AS title,
  CASE WHEN instr(t, chr(10)) > 0 THEN substr(t, instr(t, chr(10)) + 1) ELSE '' END AS content FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
mention AS (SELECT 'e1' AS event_id, market, ticker, ts::DATE AS date, event_id AS article, 'u' || (event_id % 5000)::VARCHAR AS url_hash, event_type AS source, value - 50 AS tone,
  'T' || coalesce(json_extract_string(props, '$.k'), '') || ';' || upper(event_type) AS themes, 'E' || (user_id % 7)::VARCHAR AS entities
  FROM events JOIN firm ON s_suppkey - 1 = user_id % (SELECT count(*) FROM firm))
"""

#: Chronological fold in SQL: the two first events train, the third validates, the last tests.
FRAMES = """
frame0 AS (SELECT 'chronological__test' AS fold_id, CASE WHEN event_id IN ('e1', 'e2') THEN 'train' WHEN event_id = 'e3' THEN 'validation' ELSE 'test' END AS part, * FROM label),
frame1 AS (SELECT *, event_return - avg(event_return) OVER w AS abnormal_return FROM frame0 WINDOW w AS (PARTITION BY fold_id, part, event_id, market)),
thr AS (SELECT fold_id, quantile_cont(abs(abnormal_return), 0.9) AS threshold FROM frame1 WHERE part = 'train' GROUP BY 1),
frame AS (SELECT f.*, abs(abnormal_return) AS abs_abnormal_return, threshold, (abs(abnormal_return) >= threshold)::TINYINT AS high_impact_label FROM frame1 f JOIN thr USING (fold_id))
"""
