"""Bucketed panels, interval joins and stored fingerprints."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tideline.operators import panel, reports

DAY = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def test_interval_join_matches_every_pair(spark):
    rng = random.Random(2)
    points = [(k, rng.choice("ab"), day(rng.choice([rng.randint(0, 300), 7]))) for k in range(120)] + [(999, "a", None)]
    spans = []
    for k in range(150):
        a, n = rng.randint(-500, 400), rng.choice([0, 1, 40, 900, -3])
        spans.append((k, rng.choice("ab"), None if rng.random() < 0.1 else day(a), None if rng.random() < 0.1 else day(a + n)))
    p = spark.createDataFrame(points, "p int, g string, d date")
    s = spark.createDataFrame(spans, "s int, g string, a date, b date")
    holds = lambda d, a, b: d is not None and (a is None or a <= d) and (b is None or d <= b)
    for width in (1, 32, 5000):
        got = panel.interval_join(p, s, "d", "a", "b", ["g"], width).select("p", "s").collect()
        assert sorted(map(tuple, got)) == sorted((x, y) for x, g, d in points for y, h, a, b in spans if g == h and holds(d, a, b))
    got = panel.interval_join(p.drop("g"), s.drop("g"), "d", "a", "b").select("p", "s").collect()
    assert sorted(map(tuple, got)) == sorted((x, y) for x, _, d in points for y, _, a, b in spans if holds(d, a, b))
    assert panel.interval_join(p.limit(0), s, "d", "a", "b", ["g"]).count() == 0 == panel.interval_join(p, s.limit(0), "d", "a", "b", ["g"]).count()


def below(plan, name):
    """Lines of the plan from the join's inputs on that name an exchange, above a scan of ``name``."""
    lines = plan.split("\n")
    at = next(k for k, x in enumerate(lines) if "FileScan" in x and name in x)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    out = []
    for x in reversed(lines[:at]):
        d = len(x) - len(x.lstrip(" :+-"))
        if d < depth:
            depth = d
            out.append(x)
            if "Join" in x:
                return out
    return out


def test_bucketed_tables_are_joined_where_they_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(400).select(F.when(F.col("id") % 2 == 0, "M").otherwise("N").alias("market"), (F.col("id") % 20).cast("string").alias("ticker"), F.date_add(F.lit(DAY), (F.col("id") / 20).cast("int")).alias("date"), F.col("id").cast("double").alias("close"))
        events = spark.createDataFrame([("e", day(2), day(5), day(6), day(9))], "event_id string, pre_start_date date, event_start_date date, event_end_date date, post_end_date date")
        firms = panel.eligible(events, rows.select("market", "ticker").distinct().withColumns({"member_from": F.lit(None).cast("date"), "member_to": F.lit(None).cast("date")}))
        news = rows.where("close % 3 = 0").select("market", "ticker", "date")
        counts = news.groupBy("market", "ticker", "date").agg(F.count("*").alias("news_count"))
        out = panel.bucketed_panel(firms, panel.bucketed(rows, "p", 4), panel.bucketed(counts, "n", 4), 4)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        whole = out._jdf.queryExecution().executedPlan().toString()
        for column in ("close", "news_count"):
            assert not any("Exchange" in x for x in below(whole, column)), whole
        assert "Bucketed: true" in plan
        want = panel.dense_panel(firms, rows, news)
        assert sorted(map(str, out.select(want.columns).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dense_panel_shuffles_firms_not_days(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = spark.createDataFrame([("e", day(2), day(5), day(6), day(9)), ("f", day(8), day(9), day(9), day(11))], "event_id string, pre_start_date date, event_start_date date, event_end_date date, post_end_date date")
        ends = {"e": (2, 9), "f": (8, 11)}
        firms = spark.createDataFrame([("M", str(k), None, None) for k in range(5)], "market string, ticker string, member_from date, member_to date")
        have = [("M", str(k % 4), day(n), float(n)) for k in range(4) for n in range(k, 14, k + 1)] + [("M", "0", day(8), -1.0)]  # a day with two prices
        told = [("M", str(k), day(n)) for k in range(5) for n in (1, 3, 3, 8)]
        prices = spark.createDataFrame([*have, ("M", "1", None, 5.0), ("X", "1", day(3), 5.0)], "market string, ticker string, date date, close double")
        news = spark.createDataFrame([*told, ("M", "1", None), (None, "1", day(3))], "market string, ticker string, date date")
        out = panel.dense_panel(panel.eligible(events, firms), prices, news)
        lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
        first = [next(i for i, x in enumerate(lines) if word in x) for word in ("Generate", "Exchange")]
        assert first[0] < first[1], lines  # days become rows above all shuffles
        want = []
        for e, (a, b) in ends.items():
            for k in range(5):
                for n in range(a, b + 1):
                    for close in [p[3] for p in have if p[1:3] == (str(k), day(n))] or [None]:
                        want.append((e, str(k), day(n), close, told.count(("M", str(k), day(n)))))
        assert sorted(map(str, map(tuple, out.select("event_id", "ticker", "date", "close", "news_count").collect()))) == sorted(map(str, want))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fingerprints_are_brought_up_to_date(spark, tmp_path):
    path, stored_at = f"file://{tmp_path}/t", f"file://{tmp_path}/f"
    rows = spark.range(60).select("id", (F.col("id") % 3).cast("string").alias("p"))
    rows.write.partitionBy("p").parquet(path)
    reports.partition_fingerprints(spark, path, "p").write.parquet(stored_at)
    stored = spark.read.parquet(stored_at)
    unchanged = reports.partition_fingerprints(spark, path, "p", stored)
    assert not unchanged.where("read").count() and unchanged.count() == 3
    rows.where("p = '1'").withColumn("id", F.col("id") + 1000).union(spark.createDataFrame([(7, "9")], "id long, p string")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p").parquet(path)
    new = reports.partition_fingerprints(spark, path, "p", stored)
    assert {r["path"]: r["read"] for r in new.collect()} == {"0": False, "1": True, "2": False, "9": True}
    again = reports.partition_fingerprints(spark, path, "p")
    assert reports.total_fingerprint(new).first() == reports.total_fingerprint(again).first()
    assert reports.total_fingerprint(new).first() != reports.total_fingerprint(stored).first()


def test_counts_agree_with_pairs(spark):
    rng = random.Random(5)
    firms = [(k, None if rng.random() < 0.2 else day(a), None if rng.random() < 0.2 else day(a + rng.choice([-3, -1, 0, 1, 50]))) for k in range(80) for a in [rng.randint(-20, 90)]]
    events = [(k, rng.choice("ab"), day(rng.choice([7, rng.randint(0, 80)]))) for k in range(90)] + [(999, "a", None)]
    f = spark.createDataFrame(firms, "firm int, member_from date, member_to date")
    e = spark.createDataFrame(events, "event_id int, g string, event_start_date date")
    want = {r[0]: r[1] for r in panel.eligible(e, f).groupBy("event_id").count().collect()}
    assert {r["event_id"]: r["firms"] for r in panel.eligible_counts(e, f).collect()} == want and want
    w = e.select("event_id", "g", F.when(F.col("event_id") % 7 > 0, F.date_sub("event_start_date", 3)).alias("pre_start_date"), "event_start_date", F.date_add("event_start_date", 2).alias("event_end_date"), F.when(F.col("event_id") % 5 > 0, F.date_add("event_start_date", 5)).alias("post_end_date"))
    news = spark.createDataFrame([(rng.choice("ab"), day(rng.randint(-5, 90))) for _ in range(300)] + [("a", None)], "g string, date date")
    p = F.col("p")
    pairs = panel.event_news(w, news, ["g"]).withColumn("p", panel.period(F.col("date"))).groupBy("event_id").agg(F.count("*").alias("rows"), F.count_if(p == "pre_event").alias("before"), F.count_if(p == "post_event").alias("after"))
    assert sorted(map(tuple, panel.event_news_counts(w, news, ["g"]).collect())) == sorted(map(tuple, pairs.collect()))


def test_counted_queries_make_no_pairs(spark):
    """Rows of the largest join: before, as many as there are pairs."""
    from tideline.plans import depth

    sf = "/root/testdata/sf0.001"
    for query in (depth.j9_order_events, depth.j14_order_windows):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        over = [x for x in plan.split("\n") if "Generate explode" in x]
        assert query is depth.j14_order_windows or not over  # no membership is dealt to buckets
        assert "sum(n" in plan
