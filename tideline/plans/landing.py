"""Queries over sources, sinks, checks, streams and models."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as C
from ..operators import boosting, checks, panel, reports, train
from ..operators.labels import leave_one_out, task_frames
from ..operators.tables import shared_path, written
from ..sources import io
from ..streaming import ingest
from . import standin as S
from .registry import query
from .study import DAILY, KEY, PANEL, WITH, chronological, daily, dense, label_table, outcomes, predictions, r6, stats_sql


scratch = shared_path


# ---- sources and sinks


@query(f"{WITH} SELECT market, ticker, date, close, volume FROM price")
def s1_s8_table_round_trip(spark, sf):
    path = scratch(spark, "prices")
    io.write_table(S.prices(spark, sf).select("market", "ticker", "date", "close", "volume"), path)
    return io.read_frame(spark, path)


@query(f"{WITH}, {DAILY} SELECT event_id, market, count(*) AS n, round(sum(close), 4) AS close FROM daily GROUP BY ALL")
def s9_event_market_slices(spark, sf):
    path = scratch(spark, "slices")
    io.write_slices(daily(spark, sf).select(*KEY, "date", "close"), path)
    return spark.read.parquet(path).groupBy("event_id", "market").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("close"))


@query("SELECT doc_id % 30 AS day, source, count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents) GROUP BY ALL")
def s3_news_pools(spark, sf):
    """Documents landed as JSON envelopes, a day and some thousand records at most each, and read back."""
    path = scratch(spark, "pools")
    docs = S.table(spark, sf, "documents")
    pieces = docs.count() // 30_000 + 1
    day = F.col("doc_id") % 30
    start = F.to_timestamp_ntz(F.date_add(F.lit("1996-01-01").cast("date"), day.cast("int")).cast("string"))
    record = F.struct((start + F.expr("interval 8 hours")).cast("string").alias("datetime"), F.lit(None).cast("string").alias("pub_time"), F.col("doc_id").cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("src"), F.lit("x").alias("source"))
    pools = docs.withColumns({"start_dt": start, "end_dt": start + F.expr("interval 23 hours"), "r": record})
    pools = pools.groupBy(F.lit("news").alias("endpoint"), F.lit("x").alias("source"), "start_dt", "end_dt", F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).alias("piece")).agg(F.count("*").alias("row_count"), F.collect_list("r").alias("records"))
    pools.drop("piece").write.option("compression", "gzip").json(path)
    rows = io.read_pools(spark, path)
    return rows.groupBy(F.pmod(F.datediff(F.to_date("window_start"), F.lit("1996-01-01").cast("date")), F.lit(30)).cast("long").alias("day"), "source").agg(F.count("*").alias("n"), F.count_distinct("content").alias("texts"))


@query(f"{WITH} SELECT market, ticker, date, close, volume FROM price")
def s4_chart_json(spark, sf):
    """Price days as chart JSON (a document per firm and year), and parsed again."""
    rows = S.prices(spark, sf).withColumn("ts", F.unix_timestamp(F.col("date").cast("timestamp")) + 50_000)
    step = F.array_sort(F.collect_list(F.struct("ts", "high", "low", "close", "volume")))
    firms = rows.groupBy("market", "ticker", F.year("date").alias("y")).agg(step.alias("s"), F.min("date").alias("from_date"), F.max("date").alias("to_date"))
    arr = lambda c: F.transform("s", lambda x: x[c])
    quote = F.struct(arr("close").alias("open"), arr("high").alias("high"), arr("low").alias("low"), arr("close").alias("close"), arr("volume").alias("volume"))
    result = F.struct(F.struct(F.lit("UTC").alias("exchangeTimezoneName"), F.lit("USD").alias("currency")).alias("meta"), arr("ts").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    charts = firms.select("market", "ticker", "from_date", "to_date", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("chart"))
    return panel.from_chart(charts).select("market", "ticker", "date", "close", "volume")


@query("""WITH f AS (SELECT s_suppkey::VARCHAR AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN 'CSI300' ELSE 'SP500' END AS market, s_suppkey FROM supplier),
r AS (SELECT market, ticker, l_shipdate::DATE AS date, l_extendedprice AS close, CASE WHEN l_linenumber % 5 > 0 THEN l_quantity END AS vol, row_number() OVER (PARTITION BY market, ticker, l_shipdate::DATE ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem JOIN f ON l_suppkey = s_suppkey)
SELECT market, ticker, date, close, CASE WHEN market = 'CSI300' THEN vol * 100 ELSE vol END AS volume FROM r WHERE r = 1 AND date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'""")
def s5_s6_vendor_rows(spark, sf):
    even = F.col("l_suppkey") % 2 == 0
    line = S.table(spark, sf, "lineitem")
    rows = line.select(
        F.when(even, "CSI300").otherwise("SP500").alias("market"), F.col("l_suppkey").cast("string").alias("ticker"), F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date"),
        *[F.col("l_extendedprice").alias(c) for c in ("open", "high", "low", "close")], F.when(F.col("l_linenumber") % 5 > 0, F.col("l_quantity")).alias("vol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("load_order"),
        F.lit("1995-01-01").cast("date").alias("from_date"), F.lit("1999-12-31").cast("date").alias("to_date"),
    )
    return panel.from_vendor(rows).select("market", "ticker", "date", "close", "volume")


@query(f"{WITH} SELECT DISTINCT 'by_year__test' AS fold_id, CASE WHEN event_id IN ('e1', 'e2') THEN 'train' WHEN event_id = 'e3' THEN 'validation' ELSE 'test' END AS part, event_id, market, ticker FROM label")
def s11_split_json(spark, sf):
    """A split written as JSON, a document for each market and run of its firms, and read as a membership table."""
    path = scratch(spark, "split")
    labels = written(label_table(spark, sf), "labels")
    runs = labels.select("market", "ticker").distinct().groupBy("market", F.pmod(F.xxhash64("ticker"), F.lit(64)).alias("run")).agg(F.array_sort(F.collect_list("ticker")).alias("t"))
    part = lambda events: F.struct(F.array(*[F.lit(e) for e in events]).alias("events"), F.array("market").alias("markets"), F.create_map("market", "t").alias("tickers_by_market"))
    runs.select(F.lit("by_year").alias("split_type"), part(["e1", "e2"]).alias("train"), part(["e3"]).alias("validation"), part(["e4"]).alias("test")).write.option("maxRecordsPerFile", 1).json(path)
    return io.read_split(spark, path).join(labels.select(*KEY), KEY, "left_semi").select("fold_id", "part", *KEY)


@query("""WITH f AS (SELECT c_mktsegment AS path, count(*) AS n FROM customer GROUP BY 1), m AS (SELECT * FROM f WHERE path <> 'MACHINERY')
SELECT f.path, n AS found_rows, CASE WHEN path = 'BUILDING' THEN n + 1 WHEN path <> 'MACHINERY' THEN n END AS listed_rows FROM f WHERE path IN ('BUILDING', 'FURNITURE', 'MACHINERY')
UNION ALL SELECT 'NOWHERE', NULL, 1""")
def v16_release_audit(spark, sf):
    """A release by segment against a manifest with a wrong count, a wrong content, a missing and an unknown entry."""
    path = scratch(spark, "release")
    customers = S.table(spark, sf, "customer")
    io.write_table(customers, path, by=["c_mktsegment"])
    found = reports.fingerprints(spark.read.parquet(path), "c_mktsegment")
    listed = reports.fingerprints(customers, "c_mktsegment").where(F.col("path") != "MACHINERY")
    segment = F.col("path")
    listed = listed.select("path", (F.col("rows") + (segment == "BUILDING").cast("int")).alias("rows"), F.when(segment == "FURNITURE", "another").otherwise(F.col("sha256")).alias("sha256"))
    listed = listed.unionByName(spark.createDataFrame([("NOWHERE", 1, "x")], "path string, rows long, sha256 string"))
    return checks.audit(found, listed).select("path", "found_rows", "listed_rows")


@query("SELECT count(*) AS n, count(*) AS listed FROM customer")
def s16_release_files(spark, sf):
    """Rows and sums of a release's files, each listed once."""
    path = scratch(spark, "files")
    S.table(spark, sf, "customer").write.parquet(path)
    files = io.file_counts(spark, path)
    return files.agg(F.sum("rows").alias("n"), F.sum(F.when(F.length("sha256") == 64, F.col("rows"))).alias("listed"))


@query(f"{WITH}, {DAILY} SELECT event_id, market, ticker, {stats_sql(['days_to_event_start', 'high', 'low', 'close', 'volume'])}, count(*) AS pre_event_day_count FROM daily JOIN label USING (event_id, market, ticker) GROUP BY ALL")
def s2_release_folder(spark, sf):
    """Daily features and labels written in a release's layout, found there and aggregated."""
    root = scratch(spark, "layout")
    days = written(daily(spark, sf), "days")
    io.write_table(days, f"{root}/data/daily_features")
    io.write_table(outcomes(spark, sf).join(days.select(*KEY).distinct(), KEY, "left_semi"), f"{root}/data/labels")
    frame, _ = io.load_event_feature_frame(spark, root, "S0")
    return r6(frame, *[c for c in frame.columns if "__" in c])


@query(f"""{WITH}, a AS (SELECT market, ticker, 'Brand ' || ticker AS alias, CASE WHEN s_suppkey % 3 = 0 THEN 'ticker' ELSE 'short_name' END AS alias_type, CASE WHEN s_suppkey % 2 = 0 THEN 0.5 END AS given FROM firm)
SELECT market, ticker, alias, 'brand' || ticker AS compact, coalesce(given::DOUBLE, CASE WHEN alias_type = 'ticker' THEN 0.95 ELSE 0.82 END::DOUBLE) AS confidence FROM a""")
def s7_alias_file(spark, sf):
    """Explicit aliases as CSV, some without a usable name or number."""
    path = scratch(spark, "aliases")
    n = F.col("s_suppkey")
    firms = S.firms(spark, sf)
    rows = firms.select("market", "ticker", F.concat(F.lit("Brand "), "ticker").alias("alias"), F.when(n % 3 == 0, "ticker").otherwise("short_name").alias("alias_type"), F.when(n % 2 == 0, "0.5").otherwise("high").alias("confidence"))
    rows = rows.unionByName(firms.select("market", "ticker", F.lit("中国").alias("alias"), F.lit("short_name").alias("alias_type"), F.lit("1").alias("confidence")))
    rows.write.option("header", "true").csv(path)
    return io.read_aliases(spark, path).select("market", "ticker", "alias", "compact", "confidence")


@query(f"{WITH} SELECT 'predictions' AS name, count(*) AS n, round(sum(t2_prediction), 4) AS total FROM pred UNION ALL SELECT 'folds', count(*), round(sum(event_return), 4) FROM label")
def s10_run_bundle(spark, sf):
    """A run's tables written together and read back."""
    path = scratch(spark, "run")
    io.write_run({"predictions": predictions(spark, sf), "folds": label_table(spark, sf)}, path)
    one = lambda name, x: spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.round(F.sum(x), 4).alias("total"))
    return one("predictions", "t2_prediction").unionByName(one("folds", "event_return"))


@query("SELECT vec_id, round(list_sum(list_transform(range(len(embedding)), lambda i: (i + 1) * embedding[i + 1]::DOUBLE)), 4) AS weighted FROM embeddings")
def f3_wide_embeddings(spark, sf):
    """Vectors as wide columns in the order of their names' text, brought back in the order of their numbers."""
    from ..operators import features

    e = S.table(spark, sf, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0]  # one number
    wide = e.select("vec_id", *[F.get("embedding", F.lit(int(k))).alias(f"emb_{k}") for k in sorted(map(str, range(width)))])
    weighted = F.aggregate(F.transform("embedding", lambda x, i: (i + 1) * x), F.lit(0.0), lambda a, b: a + b)
    return features.as_array(wide).select("vec_id", F.round(weighted, 4).alias("weighted"))


@query("SELECT false AS unchanged_stale, true AS one_row_less_stale, count(*) > 0 AS has_rows FROM orders")
def v17_stale_lineage(spark, sf):
    """A stored fingerprint against the same table in another order, and against it without its last key."""
    orders = S.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    stored = reports.fingerprint(orders)
    last = orders.agg(F.max("o_orderkey").alias("last"))
    less = reports.fingerprint(orders.join(F.broadcast(last), F.col("o_orderkey") != F.col("last")).drop("last"))
    same = reports.fingerprint(orders.repartition(7, "o_custkey"))
    differs = lambda df, name: stored.alias("a").join(df.alias("b")).select((F.struct("a.*") != F.struct("b.*")).alias(name))  # noqa: E731  one row each
    return differs(same, "unchanged_stale").join(differs(less, "one_row_less_stale")).join(stored.select((F.col("rows") > 0).alias("has_rows")))


# ---- checks


@query("""SELECT user_id, event_type, 'repeated key' AS rule FROM events GROUP BY ALL HAVING count(*) > 1""")
def v2_bad_keys(spark, sf):
    return checks.bad_keys(S.table(spark, sf, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("""WITH r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'maybe' WHEN quality = 1 THEN ' Yes ' ELSE 'NO' END AS raw, CASE WHEN quality = 1 THEN doc_id::VARCHAR || '.50' ELSE 'n' || doc_id::VARCHAR END AS num FROM labels)
SELECT doc_id, CASE lower(trim(raw)) WHEN 'yes' THEN true WHEN 'no' THEN false END AS flag, try_cast(num AS DOUBLE) AS num FROM r""")
def v3_v4_coercions(spark, sf):
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    raw = F.when(bad, "maybe").when(good, " Yes ").otherwise("NO")
    text = F.when(good, F.concat(F.col("doc_id").cast("string"), F.lit(".50"))).otherwise(F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    return S.table(spark, sf, "labels").select("doc_id", checks.as_flag(raw).alias("flag"), checks.number(text).alias("num"))


@query(f"{WITH} SELECT event_id, market, ticker, round(event_return, 6) AS event_return FROM label")
def v5_base_labels(spark, sf):
    return r6(checks.base_labels(outcomes(spark, sf))[0].drop("label_available_flag"), "event_return")


@query(f"{WITH} SELECT event_id, market, ticker, 'score out of range' AS rule FROM (SELECT *, t1_score * 12 AS s FROM pred) WHERE s > 1")
def v6_prediction_range(spark, sf):
    return checks.prediction_table(predictions(spark, sf).withColumn("t1_score", F.col("t1_score") * 12))[1]


@query(f"{WITH} SELECT event_id, market, ticker, date, 'not before the event' AS rule FROM price JOIN cal ON date BETWEEN pre_start_date AND event_end_date WHERE date >= event_start_date")
def v7_leaking_days(spark, sf):
    rows = S.prices(spark, sf).join(F.broadcast(S.calendar(spark)), F.col("date").between(F.col("pre_start_date"), F.col("event_end_date")))
    return checks.leaking_days(rows)


@query(f"""{WITH} SELECT CASE WHEN label % 6 = 5 THEN 'e9' ELSE 'e' || (label % 4 + 1)::VARCHAR END AS event_id, 'M' AS market, vec_id::VARCHAR AS ticker, DATE '1995-12-01' + (vec_id % 2000)::INTEGER AS date,
CASE WHEN vec_id % 11 = 0 THEN 'another width' WHEN label % 6 = 5 THEN 'unknown event' ELSE 'not before the event' END AS rule
FROM embeddings LEFT JOIN cal ON event_id = CASE WHEN label % 6 = 5 THEN 'e9' ELSE 'e' || (label % 4 + 1)::VARCHAR END
WHERE vec_id % 11 = 0 OR label % 6 = 5 OR DATE '1995-12-01' + (vec_id % 2000)::INTEGER >= event_start_date""")
def v8_bad_embeddings(spark, sf):
    e = S.table(spark, sf, "embeddings")
    event = F.when(F.col("label") % 6 == 5, "e9").otherwise(F.concat(F.lit("e"), (F.col("label") % 4 + 1).cast("string")))
    rows = e.select(event.alias("event_id"), F.lit("M").alias("market"), F.col("vec_id").cast("string").alias("ticker"), F.date_add(F.lit("1995-12-01").cast("date"), (F.col("vec_id") % 2000).cast("int")).alias("date"), F.when(F.col("vec_id") % 11 == 0, 63).otherwise(64).alias("embedding_dim"))
    return checks.bad_embeddings(rows, S.calendar(spark), 64)


@query("""SELECT o_orderkey::VARCHAR AS event_id, 'dates not in order' AS rule FROM orders WHERE o_orderkey % 3 = 0""")
def v9_event_calendar(spark, sf):
    """Orders as events; every third has its end before its start."""
    d = F.to_date("o_orderdate")
    end = F.when(F.col("o_orderkey") % 3 == 0, F.date_sub(d, 1)).otherwise(F.date_add(d, 5))
    events = S.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("event_id"), F.date_sub(d, 9).alias("pre_start_date"), d.alias("event_start_date"), end.alias("event_end_date"), F.date_add(d, 30).alias("post_end_date"))
    return checks.bad_calendar(events)


@query(f"""{WITH} SELECT market, ticker, CASE WHEN market = 'ASIA' THEN 'unknown market' WHEN s_suppkey % 10 = 3 THEN 'odd ticker' ELSE 'membership ends before it begins' END AS rule FROM firm WHERE market = 'ASIA' OR s_suppkey % 10 = 3 OR s_suppkey % 4 = 0""")
def v10_companies(spark, sf):
    known = {m: r"^\d*[^3]$" for m in ("AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST")}
    start = F.lit("2000-01-01").cast("date")
    rows = S.firms(spark, sf).withColumns({"member_from": start, "member_to": F.when(F.col("s_suppkey") % 4 == 0, F.date_sub(start, 1))})
    return checks.bad_companies(rows, known)


@query(f"""{WITH}, a AS (SELECT market, ticker, 'Alias' || ticker AS alias, s_suppkey % 13 / 10.0 AS confidence, s_suppkey FROM firm)
SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'nowhere' ELSE market END AS market, ticker, alias, CASE WHEN s_suppkey % 7 = 0 THEN 'unknown company' ELSE 'confidence out of range' END AS rule FROM a WHERE s_suppkey % 7 = 0 OR s_suppkey % 13 > 10""")
def v11_explicit_aliases(spark, sf):
    firms = S.firms(spark, sf)
    day = F.lit(None).cast("date")
    rows = firms.select(F.when(F.col("s_suppkey") % 7 == 0, "nowhere").otherwise(F.col("market")).alias("market"), "ticker", F.concat(F.lit("Alias"), "ticker").alias("alias"), (F.col("s_suppkey") % 13 / 10).alias("confidence"), day.alias("valid_from"), day.alias("valid_to"))
    return checks.bad_aliases(rows, firms, C.usable_alias(F.lower("alias")))


@query(f"""{WITH} SELECT market, ticker, date, CASE WHEN s_suppkey % 5 = 0 THEN 'no task' WHEN s_suppkey % 5 = 1 THEN 'another currency' ELSE 'outside its window' END AS rule FROM price JOIN firm USING (market, ticker) WHERE s_suppkey % 5 < 2 OR date < DATE '1996-01-01'""")
def v13_price_records(spark, sf):
    n = F.col("s_suppkey") % 5
    tasks = S.firms(spark, sf).where(n > 0).select("market", "ticker", F.when(n == 1, "JPY").otherwise("USD").alias("currency"), F.lit("1996-01-01").cast("date").alias("window_start"), F.lit("2100-01-01").cast("date").alias("window_end"))
    return checks.bad_prices(S.prices(spark, sf).withColumn("currency", F.lit("USD")), tasks)


@query("""SELECT l_suppkey, l_shipdate::DATE AS date, count(DISTINCT (l_extendedprice, l_quantity)) AS versions FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_extendedprice, l_quantity)) > 1""")
def v14_disagreeing_prices(spark, sf):
    rows = S.table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    return checks.disagreeing_prices(rows, ["l_suppkey", "date"])


@query(f"{WITH} SELECT DISTINCT unnest(generate_series(pre_start_date, post_end_date, INTERVAL 1 DAY))::DATE AS date FROM cal EXCEPT SELECT o_orderdate::DATE FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def v15_o5_uncovered_days(spark, sf):
    """Days on which no urgent order is in part delivered."""
    landed = S.table(spark, sf, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")).select(F.to_date("o_orderdate").alias("date"))
    return checks.uncovered_days(panel.covered_days(S.calendar(spark)), landed)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def v18_unmatched(spark, sf):
    return checks.unmatched(S.table(spark, sf, "documents"), S.table(spark, sf, "labels"), ["doc_id"])


@query(f"{WITH} SELECT event_id, market, ticker, 2::BIGINT AS folds FROM label WHERE event_id = 'e4'")
def v19_shared_test_rows(spark, sf):
    from ..operators import labels as L

    rows = label_table(spark, sf)
    both = chronological(spark, sf).unionByName(L.leave_one_out(rows, "event_id", "leave_one_event_out"))
    return checks.shared_test_rows(L.members(rows, both)).where("folds > 1")


# ---- registry


@query(f"""{WITH}, m AS (SELECT ticker, (['SP500', 'HSTECH', 'Nikkei225', 'CSI300'])[s_suppkey % 4 + 1] AS market, CASE WHEN s_suppkey % 3 = 0 THEN 'SH' ELSE 'SZ' END AS exchange FROM firm)
SELECT market, ticker, CASE market WHEN 'SP500' THEN ticker WHEN 'HSTECH' THEN lpad(ticker, 4, '0') || '.HK' WHEN 'Nikkei225' THEN ticker || '.T' ELSE ticker || CASE exchange WHEN 'SH' THEN '.SS' ELSE '.SZ' END END AS symbol,
CASE market WHEN 'SP500' THEN 'USD' WHEN 'HSTECH' THEN 'HKD' WHEN 'Nikkei225' THEN 'JPY' ELSE 'CNY' END AS currency FROM m""")
def c29_c30_registry(spark, sf):
    n = F.col("s_suppkey")
    rows = S.firms(spark, sf).select("ticker", F.element_at(F.array(*[F.lit(x) for x in ("SP500", "HSTECH", "Nikkei225", "CSI300")]), (n % 4 + 1).cast("int")).alias("market"), F.when(n % 3 == 0, "SH").otherwise("SZ").alias("exchange"))
    return rows.select("market", "ticker", C.price_symbol(F.col("market"), F.col("ticker"), F.col("exchange")).alias("symbol"), C.market_currency(F.col("market"), F.lit("")).alias("currency"))


@query("SELECT o_orderkey, o_orderdate::DATE AS date FROM orders")
def c28_parse_dates(spark, sf):
    d = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.concat(d.cast("string"), F.lit("T00:00:00Z"))).otherwise(d.cast("string"))
    return S.table(spark, sf, "orders").select("o_orderkey", C.parse_date(text).alias("date"))


# ---- streams and models


def streamed(spark, sf, name, rows):
    """What a stream over the events' file has written when it has caught up."""
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def event_stream(spark, sf):
    """The events, landed as files and read as a stream of them."""
    landing = scratch(spark, "landing")
    events = S.table(spark, sf, "events")
    events.write.parquet(landing)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(landing)


@query("SELECT event_id FROM events GROUP BY 1")
def r2_stream_dedupe(spark, sf):
    """Every event twice, deduplicated as a stream."""
    rows = event_stream(spark, sf).select("event_id", "ts").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return streamed(spark, sf, "dedupe", ingest.dedupe_stream(rows, ["event_id"], delay="400 days")).select("event_id")


@query()
def ml8_train_reference(spark, sf):
    """Linear models of both tasks on the chronological fold, scored."""
    from ..operators.features import aggregate_days

    features = aggregate_days(daily(spark, sf), ["close", "volume"])
    return train.train_reference_model(features, outcomes(spark, sf).join(features.select(*KEY), KEY, "left_semi"), chronological(spark, sf))["metrics"]


@query()
def ml6_boosted_trees(spark, sf):
    """Boosted trees of both tasks: predictions of the test rows."""
    from ..operators.features import aggregate_days

    features = aggregate_days(daily(spark, sf), ["close", "volume"])
    return train.train_reference_model(features, outcomes(spark, sf).join(features.select(*KEY), KEY, "left_semi"), chronological(spark, sf), "trees", "trees")["predictions"]


@query()
def ml5_perceptron(spark, sf):
    """A perceptron for T1 beside a linear T2 (Spark has no perceptron that regresses): predictions of the test rows."""
    from ..operators.features import aggregate_days

    features = aggregate_days(daily(spark, sf), ["close", "volume"])
    return train.train_reference_model(features, outcomes(spark, sf).join(features.select(*KEY), KEY, "left_semi"), chronological(spark, sf), "mlp", "linear")["predictions"]


@query(f"{WITH} SELECT event_id, market, ticker, round(t2_prediction, 6) AS t2_prediction, (row_number() OVER (PARTITION BY event_id, market ORDER BY t2_prediction DESC, ticker))::INTEGER AS place FROM pred")
def o1_sorted_predictions(spark, sf):
    place = F.row_number().over(W.partitionBy("event_id", "market").orderBy(F.desc("t2_prediction"), "ticker"))
    return r6(predictions(spark, sf).select(*KEY, "t2_prediction", place.alias("place")), "t2_prediction")


@query(f"""{WITH}, f AS (SELECT 'e__' || h AS fold_id, CASE WHEN event_id = h THEN 'test' ELSE 'train' END AS part, l.* FROM label l, (SELECT DISTINCT event_id AS h FROM label)),
n AS (SELECT fold_id, count(*) FILTER (part = 'train' AND fold_id <> 'e__e2') AS train, count(*) FILTER (part = 'test' AND fold_id <> 'e__e1') AS test FROM f GROUP BY 1)
SELECT fold_id, train, test, train AS "values" FROM n WHERE train = 0 OR test = 0""")
def v20_empty_parts(spark, sf):
    """Folds of which one has lost its test rows and one its train rows."""
    from ..operators import labels as L

    rows = written(label_table(spark, sf), "labels")
    folds = L.leave_one_out(rows, "event_id", "e")
    lost = ((F.col("fold_id") == "e__e1") & (F.col("part") == "test")) | ((F.col("fold_id") == "e__e2") & (F.col("part") == "train"))
    return checks.empty_parts(L.members(rows, folds.where(~lost)), 0.9)


@query(f"""{WITH}, d AS (SELECT market, ticker, lower(company_name) AS compact, 0.95::DOUBLE AS confidence, s_suppkey FROM firm)
SELECT market, ticker, compact, confidence FROM d WHERE s_suppkey % 3 > 0 UNION ALL SELECT market, ticker, compact, 0.5 FROM d WHERE s_suppkey % 3 = 0""")
def j12_alias_override(spark, sf):
    from ..operators import aliases

    firms = S.firms(spark, sf).withColumn("compact", F.lower("company_name"))
    derived = firms.select("market", "ticker", "compact", F.lit(0.95).alias("confidence"))
    explicit = firms.where(F.col("s_suppkey") % 3 == 0).select("market", "ticker", "compact", F.lit(0.5).alias("confidence"))
    return aliases.override(derived, explicit)


@query(f"{WITH}, {PANEL} SELECT event_id, market, ticker, date, close, news_count FROM panel WHERE is_pre_event_input = 1")
def t5_pre_event_inputs(spark, sf):
    """Of the dense panel, what may be an input."""
    return panel.pre_event_inputs(dense(spark, sf)).select(*KEY, "date", "close", "news_count")


# ---- what models are fitted on, and what can be said of them exactly


POOLED = """CASE WHEN lang = 'es' THEN 'no time' WHEN coalesce(text, '') = '' OR trim(text) = '' THEN 'no content' WHEN lang = 'fr' THEN 'time with a zone' WHEN lang = 'de' THEN 'outside its window' END"""


PIECE = 200


def landed_pools(spark, sf, faulty):
    """Documents as envelopes of some 200 records, a task (hour) each; where ``faulty`` holds, times are wrong in some languages."""
    docs, lang = S.table(spark, sf, "documents"), F.coalesce("lang", F.lit(""))
    piece = F.floor(F.col("doc_id") / PIECE)
    start = F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")) + F.make_dt_interval(hours=piece.cast("int"))
    time = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    right = time(start + F.expr("interval 30 minutes"))
    ts = F.when(~faulty, right).when(lang == "es", F.lit(None)).when(lang == "fr", F.concat(right, F.lit("Z"))).when(lang == "de", time(start + F.expr("interval 40 days"))).otherwise(right)
    record = F.struct(ts.alias("datetime"), F.lit(None).cast("string").alias("pub_time"), F.col("doc_id").cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("src"), F.lit("x").alias("source"))
    rows = docs.select(piece.alias("piece"), start.alias("start_dt"), (start + F.expr("interval 59 minutes")).alias("end_dt"), record.alias("r"))
    pools = rows.groupBy("piece", "start_dt", "end_dt").agg(F.count("*").alias("row_count"), F.collect_list("r").alias("records"))  # an id is on one row, so a piece is bounded
    return pools.select("piece", F.lit("news").alias("endpoint"), F.lit("x").alias("source"), "start_dt", "end_dt", "row_count", "records")


class Stopped(Exception):
    """Raised between an epoch's write and its commit."""


def stop_once():
    calls = []

    def after(epoch):
        calls.append(epoch)
        if len(calls) == 1:
            raise Stopped

    return after


def run_twice(f, *args):
    """A run that stops in its first batch, and one that takes up where it stopped."""
    after = stop_once()
    for _ in range(2):
        try:
            f(*args, after_write=after)
            return
        except StreamingQueryException as e:
            if "Stopped" not in str(e):
                raise


@query(f"SELECT coalesce({POOLED}, 'sound') AS rule, count(*) AS n FROM documents GROUP BY 1")
def r1_v12_ingest_pools(spark, sf):
    """Documents landed as pools, many in a file, in two lots, and ingested by a stream that stops in mid-batch and resumes: every record is sound or a violation."""
    landing, out, checkpoint = scratch(spark, "lots"), scratch(spark, "ingested"), scratch(spark, "ingested-checkpoint")
    pools = landed_pools(spark, sf, F.lit(True))
    for lot in (0, 1):  # the second run takes up only what landed since
        pools.where(F.col("piece") % 2 == lot).drop("piece").write.mode("append").option("compression", "gzip").json(landing)
        run_twice(ingest.ingest_pools, spark, landing, out, checkpoint)
    return ingest.landed(spark, out).groupBy(F.coalesce("rule", F.lit("sound")).alias("rule")).agg(F.count("*").alias("n"))


#: Tasks: every third has wrong times at first, every sixth lands again with right ones; every fifth announces another number of rows.
TASKS = f"""d AS (SELECT doc_id // {PIECE} AS piece, {POOLED.replace("WHEN lang", "WHEN doc_id // " + str(PIECE) + " % 3 = 0 AND lang")} AS rule, CASE WHEN coalesce(text, '') = '' OR trim(text) = '' THEN 'no content' END AS again FROM documents),
p AS (SELECT piece, count(*) AS n, count(rule) AS bad, string_agg(DISTINCT rule, ';' ORDER BY rule) AS rules, count(again) AS bad2, string_agg(DISTINCT again, ';' ORDER BY again) AS rules2 FROM d GROUP BY 1),
t AS (SELECT *, CASE WHEN piece % 5 = 2 THEN 'another number of rows' WHEN bad > 0 THEN rules END AS e1, CASE WHEN bad2 > 0 THEN rules2 END AS e2, piece % 6 = 0 OR piece % 3 = 1 AS twice,
  strftime(TIMESTAMP '1996-01-01 00:00:00' + to_hours(piece), '%Y-%m-%d %H:%M:%S') || '|' || strftime(TIMESTAMP '1996-01-01 00:59:00' + to_hours(piece), '%Y-%m-%d %H:%M:%S') AS w FROM p),
u AS (SELECT 'news|x|' || w AS pool, CASE WHEN twice THEN 2 ELSE 1 END::BIGINT AS attempts, n AS row_count, CASE WHEN twice AND e1 IS NOT NULL THEN bad2 ELSE bad END AS bad, CASE WHEN twice AND e1 IS NOT NULL THEN e2 ELSE e1 END AS error FROM t
UNION ALL SELECT 'major_news|x|' || w, 1, 0, 0, NULL FROM t WHERE piece % 4 = 0)"""


def landed_twice(spark, sf):
    """Lots that stop in mid-batch and resume: records and ledger below the folder that comes back."""
    landing, out = scratch(spark, "tasks"), scratch(spark, "tasks-out")
    piece, few = F.col("piece"), F.floor(F.col("doc_id") / PIECE) % 3 == 0
    first = landed_pools(spark, sf, few).withColumn("row_count", F.when(piece % 5 == 2, F.col("row_count") + 1).otherwise(F.col("row_count")))
    none = first.where(piece % 4 == 0).withColumns({"endpoint": F.lit("major_news"), "row_count": F.lit(0).cast("long"), "records": F.slice("records", 1, 0)})
    again = landed_pools(spark, sf, F.lit(False)).where((piece % 6 == 0) | (piece % 3 == 1))
    for lot in (first.unionByName(none), again):
        lot.drop("piece").write.mode("append").json(landing)
        run_twice(ingest.ingest_pools, spark, landing, out, f"{out}-records")
        run_twice(ingest.keep_ledger, spark, landing, out, f"{out}-ledger")
    return out


@query(f"WITH {TASKS} SELECT pool, CASE WHEN error IS NOT NULL THEN 'error' WHEN row_count = 0 THEN 'empty' ELSE 'complete' END AS status, attempts, row_count, bad, error FROM u")
def r1_task_ledger(spark, sf):
    """Every task's status, attempts and fault after two lots; keyed state survives a stop in mid-batch."""
    return ingest.ledger(spark, landed_twice(spark, sf)).select("pool", "status", "attempts", "row_count", "bad", "error")


@query(f"WITH {TASKS} SELECT pool, row_count - CASE WHEN error = 'another number of rows' THEN row_count ELSE bad END AS n FROM u WHERE n > 0")
def r1_ingested_records(spark, sf):
    """Sound records of each task's attempt; tasks that landed twice count once."""
    out = landed_twice(spark, sf)
    return ingest.ingested(spark, out).groupBy("pool").agg(F.count("*").alias("n"))


MODEL_ROWS = """mrow AS (SELECT o.event_id, o.market, o.ticker, o.event_return AS a, CASE WHEN p.t2_prediction > 0 THEN p.t2_prediction END AS b FROM outcome o LEFT JOIN pred p USING (event_id, market, ticker)),
med AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM mrow)"""


def model_rows(spark, sf):
    """Outcomes with two columns that are null in places."""
    rows = outcomes(spark, sf).select(*KEY, F.col("event_return").alias("a")).join(predictions(spark, sf).select(*KEY, F.when(F.col("t2_prediction") > 0, F.col("t2_prediction")).alias("b")), KEY, "left")
    return written(rows, "model-rows")


@query(f"{WITH}, {MODEL_ROWS} SELECT event_id, market, ticker, round(coalesce(a, ma), 6) AS a, round(coalesce(b, mb), 6) AS b, (b IS NULL)::DOUBLE AS b__missing, (a IS NULL)::DOUBLE AS a__missing FROM mrow, med")
def ml1_imputation(spark, sf):
    """Exact medians for what is missing, and indicators; a column without any value goes."""
    rows = model_rows(spark, sf).withColumn("c", F.lit(None).cast("double"))
    medians, missing = train.imputation(rows, ["a", "b", "c"])
    out = train.prepared(rows, medians, missing).drop("c")
    for c in ("a", "b"):
        out = out.withColumn(f"{c}__missing", F.col(f"{c}__missing") if f"{c}__missing" in out.columns else F.lit(0.0))
    return r6(out, "a", "b")


@query(f"""{WITH}, {MODEL_ROWS}, f AS (SELECT event_id, market, ticker, coalesce(a, ma) AS a, coalesce(b, mb) AS b FROM mrow, med)
SELECT event_id, market, ticker, round((a - avg(a) OVER ()) / stddev_samp(a) OVER (), 5) AS a, round((b - avg(b) OVER ()) / stddev_samp(b) OVER (), 5) AS b FROM f""")
def ml2_standardised(spark, sf):
    """The columns that a linear model sees: less their mean, over their deviation."""
    rows = model_rows(spark, sf)
    medians, _ = train.imputation(rows, ["a", "b"])
    out = train.standardised(train.prepared(rows, medians, []), ["a", "b"])
    return out.select(*KEY, F.round(F.get("features", F.lit(0)), 5).alias("a"), F.round(F.get("features", F.lit(1)), 5).alias("b"))


@query(f"""{WITH}, {S.FRAMES}, {DAILY}, x AS (SELECT event_id, market, ticker, avg(close) AS x FROM daily GROUP BY ALL),
r AS (SELECT f.*, x FROM frame f JOIN x USING (event_id, market, ticker)), s AS (SELECT avg(x) AS m, stddev_samp(x) AS sd, avg(abnormal_return) AS y FROM r WHERE part = 'train'),
b AS (SELECT sum((x - m) / sd * (abnormal_return - y)) / (sum(((x - m) / sd) ** 2) + 1) AS b FROM r, s WHERE part = 'train')
SELECT fold_id, event_id, market, ticker, round(y + b * (x - m) / sd, 5) AS t2_prediction FROM r, s, b WHERE part = 'test'""")
def ml4_ridge(spark, sf):
    """Ridge on one standardised feature, fitted on train and applied to test; its closed form is the oracle."""
    x = written(daily(spark, sf).groupBy(*KEY).agg(F.avg("close").alias("x")), "feature")
    frames = written(task_frames(label_table(spark, sf).join(x.select(*KEY), KEY, "left_semi"), chronological(spark, sf)), "frames").join(x, KEY)
    out = train.fit_predict(frames.where(F.col("part") == "train"), frames.where(F.col("part") == "test"), ["x"], "T2", "linear", {})
    return out.select("fold_id", *KEY, F.round("prediction_", 5).alias("t2_prediction"))


#: Leave-one-event-out folds with two features: the mean close and the mean volume of the days before.
FOLDS = f"""{DAILY}, x AS (SELECT event_id, market, ticker, avg(close) AS u, avg(volume) AS v FROM daily GROUP BY ALL), l AS (SELECT * FROM label SEMI JOIN x USING (event_id, market, ticker)),
g0 AS (SELECT 'loeo__' || h.event_id AS fold_id, CASE WHEN l.event_id = h.event_id THEN 'test' ELSE 'train' END AS part, l.* FROM l, (SELECT DISTINCT event_id FROM l) h),
g1 AS (SELECT *, event_return - avg(event_return) OVER (PARTITION BY fold_id, part, event_id, market) AS ar FROM g0),
gt AS (SELECT fold_id, quantile_cont(abs(ar), 0.9) AS t FROM g1 WHERE part = 'train' GROUP BY 1),
g AS (SELECT g1.*, (abs(ar) >= t)::DOUBLE AS y, u, v FROM g1 JOIN gt USING (fold_id) JOIN x USING (event_id, market, ticker)),
st AS (SELECT fold_id, avg(u) AS mu, stddev_pop(u) AS su, avg(v) AS mv, stddev_pop(v) AS sv, count(*)::DOUBLE AS n, sum(y) AS p, avg(ar) AS ma FROM g WHERE part = 'train' GROUP BY 1),
z AS MATERIALIZED (SELECT fold_id, part, event_id, market, ticker, y, ar, (u - mu) / su AS a, (v - mv) / sv AS b, CASE WHEN y = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS s FROM g JOIN st USING (fold_id)),
r0 AS (SELECT fold_id, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * (ar - ma)) AS ay, sum(b * (ar - ma)) AS yb, any_value(ma) AS ma FROM z JOIN st USING (fold_id) WHERE part = 'train' GROUP BY 1),
r AS (SELECT fold_id, ma, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ra, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS rb FROM r0)"""


def newton_sql(steps: int = 12) -> str:
    """Reweighted least squares with two weights and an intercept, a step in each pair of tables, by Cramer's rule."""
    out = ["w0 AS (SELECT fold_id, 0.0::DOUBLE AS c, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb FROM st)"]
    for k in range(steps):
        out.append(f"""q{k} AS (SELECT fold_id, a, b, s, y, 1 / (1 + exp(-(c + wa * a + wb * b))) AS p FROM z JOIN w{k} USING (fold_id) WHERE part = 'train'),
h{k} AS (SELECT fold_id, sum(s * (p - y)) AS g0, sum(s * (p - y) * a) AS g1, sum(s * (p - y) * b) AS g2, sum(s * p * (1 - p)) AS h00, sum(s * p * (1 - p) * a) AS h01, sum(s * p * (1 - p) * b) AS h02,
  sum(s * p * (1 - p) * a * a) + 1 AS h11, sum(s * p * (1 - p) * a * b) AS h12, sum(s * p * (1 - p) * b * b) + 1 AS h22 FROM q{k} GROUP BY 1),
j{k} AS (SELECT fold_id, c, wa, wb, g0, g1 + wa AS g1, g2 + wb AS g2, h00, h01, h02, h11, h12, h22, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM h{k} JOIN w{k} USING (fold_id)),
w{k + 1} AS MATERIALIZED (SELECT fold_id, c - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS c,
  wa - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS wa, wb - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS wb FROM j{k})""")
    return ", ".join([*out, f"w AS (SELECT * FROM w{steps})"])


def trained_folds(spark, sf):
    """Both linear models on all leave-one-event-out folds."""
    x = written(daily(spark, sf).groupBy(*KEY).agg(F.avg("close").alias("u"), F.avg("volume").alias("v")), "features")
    usable = label_table(spark, sf).join(x.select(*KEY), KEY, "left_semi")
    return train.train_reference_model(x, usable, leave_one_out(usable, "event_id", "loeo"))


@query(f"""{WITH}, {FOLDS}, {newton_sql()} SELECT fold_id, event_id, market, ticker, round(1 / (1 + exp(-(c + wa * a + wb * b))), 6) AS t1_score, round(ma + ra * a + rb * b, 6) AS t2_prediction
FROM z JOIN w USING (fold_id) JOIN r USING (fold_id) WHERE part = 'test'""")
def ml3_j2_ml8_fold_predictions(spark, sf):
    """Test scores of all folds; SQL makes the same steps from closed forms."""
    out = trained_folds(spark, sf)["predictions"]
    return out.select("fold_id", *KEY, F.round("t1_score", 6).alias("t1_score"), F.round("t2_prediction", 6).alias("t2_prediction"))


FOLD_METRICS = """test AS (SELECT fold_id, event_id, market, ticker, y, ar, abs(ar) AS truth, 1 / (1 + exp(-(c + wa * a + wb * b))) AS t1, ma + ra * a + rb * b AS t2 FROM z JOIN w USING (fold_id) JOIN r USING (fold_id) WHERE part = 'test'),
ties AS (SELECT fold_id, t1, sum(y) AS pos, count(*) AS n FROM test GROUP BY ALL),
steps AS (SELECT *, sum(pos) OVER d AS cp, sum(n) OVER d AS cn, sum(n) OVER u - n + (n + 1) / 2.0 AS mr FROM ties WINDOW d AS (PARTITION BY fold_id ORDER BY t1 DESC), u AS (PARTITION BY fold_id ORDER BY t1)),
m1 AS (SELECT fold_id, CASE WHEN sum(pos) > 0 THEN sum(pos * cp / cn) / sum(pos) END AS auprc, CASE WHEN sum(pos) > 0 THEN (sum(pos * mr) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(n) - sum(pos))) END AS auroc FROM steps GROUP BY 1),
m2 AS (SELECT fold_id, avg(abs(t2 - ar)) AS mae, corr(x, v) AS spearman, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY fold_id ORDER BY t2) AS x, rank() OVER (PARTITION BY fold_id ORDER BY ar) AS v FROM test) GROUP BY 1),
rg AS (SELECT fold_id, event_id, market, rank() OVER (g ORDER BY abs(t2)) AS x, rank() OVER (g ORDER BY truth) AS v, count(*) OVER g AS n, row_number() OVER (g ORDER BY abs(t2) DESC, ticker) AS i, row_number() OVER (g ORDER BY truth DESC, ticker) AS j FROM test WINDOW g AS (PARTITION BY fold_id, event_id, market)),
gm AS (SELECT fold_id, event_id, market, CASE WHEN count(*) > 1 THEN corr(x, v) END AS spearman, sum(CASE WHEN i <= greatest(1, ceil(n * 0.1::DOUBLE)) THEN v / n / log2(i + 1) END) / sum(CASE WHEN j <= greatest(1, ceil(n * 0.1::DOUBLE)) THEN v / n / log2(j + 1) END) AS ndcg FROM rg GROUP BY ALL),
m3 AS (SELECT fold_id, avg(ndcg) AS ndcg, avg(spearman) AS spearman FROM gm GROUP BY 1),
lines AS (SELECT fold_id, 'T1' AS task, 'auprc' AS metric, auprc AS value FROM m1 UNION ALL SELECT fold_id, 'T1', 'auroc', auroc FROM m1 UNION ALL SELECT fold_id, 'T2', 'mae', mae FROM m2
  UNION ALL SELECT fold_id, 'T2', 'spearman', spearman FROM m2 UNION ALL SELECT fold_id, 'T3', 'ndcg_at_10pct', ndcg FROM m3 UNION ALL SELECT fold_id, 'T3', 'spearman', spearman FROM m3)"""


@query(f"{WITH}, {FOLDS}, {newton_sql()}, {FOLD_METRICS} SELECT fold_id, task, metric, round(value, 6) AS value, n AS n_samples, round(t, 6) AS high_impact_threshold FROM lines JOIN m2 USING (fold_id) JOIN gt USING (fold_id)")
def ml8_fold_metrics(spark, sf):
    """The six metrics of every leave-one-event-out fold, from labels to fits to scores."""
    out = trained_folds(spark, sf)["metrics"]
    return out.select("fold_id", "task", "metric", F.round("value", 6).alias("value"), "n_samples", F.round("high_impact_threshold", 6).alias("high_impact_threshold"))


@query(f"{WITH}, {FOLDS} SELECT fold_id, n::BIGINT AS n_train, p::BIGINT AS n_positive, true AS t1_certain, true AS t2_certain FROM st")
def ml3_certificates(spark, sf):
    """Every fold's gradients, over its train rows, are below 1e-8 (T1) and 1e-6 (T2)."""
    out = trained_folds(spark, sf)["fits"]
    return out.select("fold_id", "n_train", "n_positive", (F.col("t1_gradient") < 1e-8).alias("t1_certain"), (F.col("t2_gradient") < 1e-6).alias("t2_certain"))


ROOT = """cell AS (SELECT fold_id, 0 AS col, u AS x, y, ar FROM g WHERE part = 'train' UNION ALL SELECT fold_id, 1, v, y, ar FROM g WHERE part = 'train'),
cb AS (SELECT *, (rank() OVER (PARTITION BY fold_id, col ORDER BY x) - 1) * 64 // count(*) OVER (PARTITION BY fold_id, col) AS b FROM cell),
hist AS (SELECT fold_id, col, b, max(x) AS edge, count(*) AS n, sum(y) AS y, sum(ar) AS ar FROM cb GROUP BY ALL),
cum AS (SELECT fold_id, col, edge, sum(n) OVER w AS nl, sum(y) OVER w AS yl, sum(ar) OVER w AS al, sum(n) OVER t AS n, sum(y) OVER t AS p, sum(ar) OVER t AS a FROM hist WINDOW w AS (PARTITION BY fold_id, col ORDER BY b), t AS (PARTITION BY fold_id, col)),
part AS (SELECT fold_id, 'T1' AS task, col, edge, nl, n, (nl * p / n - yl) AS gl, p / n * (1 - p / n) AS h FROM cum UNION ALL SELECT fold_id, 'T2', col, edge, nl, n, nl * a / n - al, 1 FROM cum),
gain AS (SELECT *, gl * gl / (nl * h) + gl * gl / ((n - nl) * h) AS gain FROM part WHERE nl >= 20 AND n - nl >= 20 AND nl * h >= 0.001 AND (n - nl) * h >= 0.001),
top AS (SELECT *, row_number() OVER (PARTITION BY fold_id, task ORDER BY gain DESC, col, edge) AS r FROM gain)"""


@query(f"{WITH}, {FOLDS}, {ROOT} SELECT fold_id, task, col, round(edge, 6) AS edge, nl::BIGINT AS n_left, round(gain, 6) AS gain, true AS improves FROM top WHERE r = 1")
def ml6_first_splits(spark, sf):
    """Of every fold's boosted trees (50 for each task, grown together) the first split and its gain, and that train's loss is lower than a constant's."""
    x = written(daily(spark, sf).groupBy(*KEY).agg(F.avg("close").alias("u"), F.avg("volume").alias("v")), "features")
    usable = label_table(spark, sf).join(x.select(*KEY), KEY, "left_semi")
    frames = written(task_frames(usable, leave_one_out(usable, "event_id", "loeo")).join(x, KEY), "frames")
    train_rows = frames.withColumn("part", F.when(F.col("part") == "train", "test"))  # scores of the rows that the trees were fitted to
    out, models, edges = boosting.boost_folds(frames.unionByName(train_rows.where(F.col("part") == "test").withColumn("event_id", F.concat(F.lit("train "), "event_id"))), ["u", "v"], {"colsample": 1.0})
    fitted = out.where(F.col("event_id").startswith("train ")).withColumn("event_id", F.substring("event_id", 7, 1000)).join(frames.select("fold_id", *KEY, "abnormal_return", "high_impact_label"), ["fold_id", *KEY])
    p = F.avg(F.col("high_impact_label").cast("double"))
    loss = fitted.groupBy("fold_id").agg(
        (F.avg(-F.when(F.col("high_impact_label") == 1, F.log("t1_score")).otherwise(F.log(1 - F.col("t1_score")))) < -(p * F.log(p) + (1 - p) * F.log(1 - p))).alias("T1"),
        (F.avg((F.col("t2_prediction") - F.col("abnormal_return")) ** 2) < F.var_pop("abnormal_return")).alias("T2"),
    )
    improves = loss.select("fold_id", F.explode(F.create_map(F.lit("T1"), "T1", F.lit("T2"), "T2")).alias("task", "improves"))
    rows = [(fold, task, m.trees[0].column[0], edges[fold, m.trees[0].column[0]][m.trees[0].bin[0]], m.trees[0].n_left, m.trees[0].gain[0]) for (fold, task), m in models.items() if m.trees]
    first = spark.createDataFrame(rows, "fold_id string, task string, col int, edge double, n_left long, gain double")
    return first.join(improves, ["fold_id", "task"]).select("fold_id", "task", "col", F.round("edge", 6).alias("edge"), "n_left", F.round("gain", 6).alias("gain"), "improves")



@query(f"{WITH}, {S.FRAMES} SELECT event_id, market, ticker, 0.0::DOUBLE AS none_positive, 1.0::DOUBLE AS all_positive FROM frame WHERE part = 'test'")
def ml7_single_class(spark, sf):
    """A train part of one class gives a constant score."""
    rows = written(task_frames(label_table(spark, sf), chronological(spark, sf)), "frames").withColumn("x", F.col("event_return"))
    fit, test = rows.where(F.col("part") == "train"), rows.where(F.col("part") == "test")
    of = lambda label, name: train.fit_predict(fit.where(F.col("high_impact_label") == label), test, ["x"], "T1", "linear", {}).select(*KEY, F.col("prediction_").alias(name))
    return of(0, "none_positive").join(of(1, "all_positive"), KEY)


@query(f"""{WITH}, {DAILY}, e AS (SELECT market, ticker, embedding FROM embeddings JOIN firm ON s_suppkey - 1 = vec_id % (SELECT count(*) FROM firm)),
v AS (SELECT market, ticker, list(avg_x ORDER BY i) AS vec, any_value(n) AS n FROM (SELECT market, ticker, i, avg(x) AS avg_x, count(*) AS n FROM (SELECT market, ticker, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM e) GROUP BY ALL) GROUP BY 1, 2),
k AS (SELECT DISTINCT event_id, market, ticker FROM daily JOIN label USING (event_id, market, ticker))
SELECT event_id, market, ticker, coalesce(n, 0)::DOUBLE AS text_embedding_doc_count, (n IS NOT NULL)::INTEGER::DOUBLE AS text_embedding_available_flag,
round(list_sum(list_transform(range(len(vec)), lambda i: (i + 1) * vec[i + 1])), 4) AS weighted FROM k LEFT JOIN v USING (market, ticker)""")
def j4_embedding_features(spark, sf):
    """The feature set of all modalities: text vectors join where there are any, counts and flags are 0 elsewhere."""
    from ..operators import features

    firms = S.firms(spark, sf)
    n = firms.agg(F.count("*").cast("long").alias("k"))
    place = firms.select("market", "ticker", (F.col("s_suppkey") - 1).alias("place"))
    vectors = S.table(spark, sf, "embeddings").crossJoin(F.broadcast(n)).withColumn("place", F.col("vec_id") % F.col("k")).join(place, "place")
    days = written(daily(spark, sf), "days")
    keys = days.select(*KEY).distinct()
    vectors = vectors.join(keys, ["market", "ticker"]).select(*KEY, F.col("embedding").cast("array<double>").alias("embedding"), F.lit(1).alias("text_doc_count"))
    usable = outcomes(spark, sf).join(keys, KEY, "left_semi")
    out = features.build_event_feature_frame(days, usable, "S6", vectors)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: (i + 1) * x), F.lit(0.0), lambda a, b: a + b)
    return out.select(*KEY, "text_embedding_doc_count", "text_embedding_available_flag", F.round(weighted, 4).alias("weighted"))


@query(f"""{WITH}, {DAILY}, d AS (SELECT *, row_number() OVER (PARTITION BY event_id, market, ticker ORDER BY date DESC) AS r FROM daily JOIN label USING (event_id, market, ticker)),
s AS (SELECT event_id, market, ticker, count(*) AS n, list((days_to_event_start + round(volume))::BIGINT ORDER BY date) AS v FROM d WHERE r <= 6 GROUP BY ALL)
SELECT event_id, market, ticker, n, array_to_string(list_concat(list_transform(range(6 - n), lambda i: '-'), list_transform(v, lambda x: x::VARCHAR)), ',') AS steps FROM s""")
def q1_sequence_batch(spark, sf):
    """Steps of all features, padded on the left: of each step the days left and the volume are shown."""
    from ..operators import features

    days = written(daily(spark, sf), "days")
    usable = outcomes(spark, sf).join(days.select(*KEY).distinct(), KEY, "left_semi")
    out, names = features.build_sequence_batch(days, usable, "S0", max_length=6)
    left, volume = (F.lit(names.index(c)) for c in ("days_to_event_start", "volume"))
    step = F.transform(F.arrays_zip("values", "mask"), lambda s: F.when(s["mask"], (F.get(s["values"], left) + F.round(F.get(s["values"], volume))).cast("long").cast("string")).otherwise("-"))
    return out.select(*KEY, F.size(F.filter("mask", lambda m: m)).cast("long").alias("n"), F.array_join(step, ",").alias("steps"))
