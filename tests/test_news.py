"""Text cleaning, aliases, pools, panels, prices and ingestion on small tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tideline.functions import scoring, text
from tideline.operators import aliases, panel, pool, reports
from tideline.sources import io
from tideline.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.normalize_text, " a&amp;b\xa0\n c ", "a&b c"),
        (text.normalize_text, None, ""),
        (text.clean_content, "x<SCRIPT a>1\n2</script>y<b>z</b>", "x y z"),
        (text.normalize_article, "中文".encode().decode("latin-1"), "中文"),
        (text.normalize_article, "a\r\n\n\n\nb　 c<br>", "a\n\nb c"),
        (text.compact_text, " A b　C ", "abc"),
        (text.compact_alias, " A-b.（C）/d ", "abcd"),
        (text.normalize_url, "HTTPS://Ex.COM/A/b/?q=1#f", "https://ex.com/A/b"),
        (text.normalize_url, "no url", "no url"),
        (scoring.without_suffix, "甲乙集团股份有限公司", "甲乙"),
        (scoring.without_suffix, "甲乙控股股份有限公司", "甲乙控股"),
        (scoring.without_suffix, "集团公司", "集团"),
        (scoring.without_suffix, "甲乙" + "公司股份集团有限公司" * 6, "甲乙"),
        (scoring.without_suffix, "甲乙 公司 股份 集团 公司 股份 集团 公司 股份", "甲乙"),
        (scoring.without_suffix, None, ""),
        (scoring.alias_values, "a; b|、c／d", ["a", "b", "c／d"]),
        (scoring.parse_date, "2020-01-03T08:00:00Z", dt.date(2020, 1, 3)),
        (scoring.parse_date, "20200103", dt.date(2020, 1, 3)),
        (scoring.parse_date, " ", None),
    ],
)
def test_expressions(spark, f, value, want):
    assert one(spark, value, f) == want


def test_risk_rules(spark):
    rows = spark.createDataFrame(
        [("main_tushare", "full_text", "strong", "", "event_direct", "ok"), ("main_tushare", "full_text", "weak_or_ambiguous", "", "event_direct", "exclude_candidate"),
         ("main_tushare", "title_only", "strong", "", "event_direct", "needs_attention"), ("other", "short_text", "strong", "", "event_direct", "needs_attention"),
         ("main_tushare", "full_text", "strong", "source_name_collision", "event_direct", "exclude_candidate")], "g string, a string, s string, r string, e string, want string")
    for r in rows.withColumn("got", scoring.risk(*[F.col(c) for c in "gasre"])).collect():
        assert r["got"] == r["want"]


def dictionary(spark, rows):
    schema = "ticker string, alias string, alias_type string, confidence double, valid_from date, valid_to date"
    return spark.createDataFrame(rows, schema).withColumns({"compact": text.compact_alias(F.col("alias")), "market": F.lit("M")})


def hits_of(spark, title, content, day, rows):
    words = dictionary(spark, rows)
    texts = spark.createDataFrame([(1, day, title, content)], "id int, day date, title string, content string")
    return {(r["ticker"], r["location"]): r for r in aliases.hits(aliases.scan(texts, words), words).collect()}


def test_alias_rules(spark):
    a, b = dt.date(2020, 1, 4), dt.date(2020, 1, 5)
    cat, brand = ("CAT", "CAT", "ticker", 0.95, None, None), ("X", "AliasBrand", "manual_alias", 0.9, a, b)
    assert not hits_of(spark, "concatenate numbers 2020", "", a, [cat])
    assert not hits_of(spark, "AliasBrand up", "", dt.date(2020, 1, 3), [brand])
    assert hits_of(spark, "AliasBrand up", "", a, [brand])["X", "title"]["score"] == pytest.approx(37.8)
    both = hits_of(spark, "AliasBrand up", "", a, [brand, ("Y", *brand[1:])])
    assert all(r["ambiguous"] for r in both.values()) and len(both) == 2
    longer = hits_of(spark, "甲乙丙丁", "", a, [("P", "甲乙丙", "short_name", 0.7, None, None), ("Q", "甲乙", "short_name", 0.45, None, None)])
    assert set(longer) == {("P", "title")}


def test_markets_have_dictionaries_of_their_own(spark):
    schema = "market string, ticker string, alias string, alias_type string, confidence double, valid_from date, valid_to date"
    words = spark.createDataFrame([("A", "1", "alpha", "manual_alias", 0.9, None, None), ("B", "2", "alpha beta", "manual_alias", 0.9, None, None), ("B", "1", "gamma", "manual_alias", 0.9, None, None), ("A", "3", "gamma", "manual_alias", 0.9, None, None)], schema)
    words = words.withColumn("compact", text.compact_alias(F.col("alias")))
    texts = spark.createDataFrame([(1, None, "alpha beta rises, gamma falls", "")], "id int, day date, title string, content string")
    found = {(r["market"], r["ticker"], r["compact"]): r["ambiguous"] for r in aliases.hits(aliases.scan(texts, words), words).collect()}
    assert found == {("A", "1", "alpha"): False, ("B", "2", "alphabeta"): False, ("B", "1", "gamma"): False, ("A", "3", "gamma"): False}
    mine = aliases.hits(aliases.scan(texts.withColumn("market", F.lit("A")), words), words)
    assert {(r["market"], r["ticker"]) for r in mine.collect()} == {("A", "1"), ("A", "3")}
    assert {r["market"]: r["tickers"] for r in aliases.match_tickers(mine).collect()} == {"A": ["1", "3"]}


def plain_scan(text, forms):
    """At each place the longest form, then on from its end."""
    out, at = set(), 0
    while at < len(text):
        best = max((f for f in forms if text.startswith(f, at)), key=len, default="")
        out |= {best} - {""}
        at += len(best) or 1
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 5])
def test_scan_is_leftmost_longest_in_any_number_of_parts(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(aliases, "PART_BYTES", part_bytes)
    rng = random.Random(part_bytes)
    forms = ["that", "thatin", "tion", "on", "hat", "abab", "ba", "bb", "aabb", "a.b"]
    words = dictionary(spark, [(str(k), w, "short_name", 0.8, None, None) for k, w in enumerate(forms)])
    given = ["thatination on that", "nothatin tion", "", None, "xx thatthation", *["".join(rng.choice("ab") for _ in range(30)) for _ in range(20)]]
    texts = spark.createDataFrame([(k, None, t, (t or "")[::-1]) for k, t in enumerate(given)], "id int, day date, title string, content string")
    want = {(k, p, f) for k, t in enumerate(given) for p, x in (("title", t or ""), ("content", (t or "")[::-1])) for f in plain_scan(x.replace(" ", ""), [w.replace(".", "") for w in forms])}
    got = aliases.scan(texts, words)
    assert {(r["id"], r["location"], r["compact"]) for r in got.collect()} == want
    assert aliases.scan(texts.limit(0), words).count() == 0 == aliases.scan(texts, words.limit(0)).count()


@pytest.mark.parametrize(("text", "alias", "free"), [("a cat.", "cat", True), ("concat cat1", "cat", False), ("concat cat", "cat", True), ("écat", "cat", True), ("cat", "cat", True), ("", "cat", False)])
def test_aliases_stand_free(text, alias, free):
    assert aliases.stands_free(text, alias) is free


CANDIDATE = "event_id string, market string, ticker string, date date, dedupe_key string, article_id string, source string, source_type string, title string, content string, time string, file_name string, alignment_score double, quality_score double, source_priority double"


def test_pool_keeps_everything_when_nothing_passes(spark):
    d = dt.date(2020, 1, 1)
    base = lambda t, key, i, align: ("e", "m", t, d, key, i, "s", "other", "t", "c", "08:00", i, align, 1.0, 10.0)
    rows = spark.createDataFrame([base("A", "k1", "1", 5.0), base("A", "k1", "2", 5.0), base("A", "k2", "3", 1.0), base("B", "k1", "4", 50.0), base("B", "k2", "5", 1.0)], CANDIDATE)
    got = pool.daily_pool(rows)
    assert {(r["ticker"], r["article_id"]) for r in got.where("in_pool").collect()} == {("A", "2"), ("A", "3"), ("B", "4")}
    assert {r["ticker"] for r in pool.strict_pool(got).collect()} == {"B"}
    first = pool.representatives(pool.strict_pool(got))
    assert first.first()["pool_article_ids"] == ["4"]
    assert [(r["article_id"], r["title"], r["content"]) for r in pool.with_texts(first, rows).collect()] == [("4", "t", "c")]


def test_dense_panel(spark):
    d = dt.date
    events = spark.createDataFrame([("ev", d(2020, 1, 3), d(2020, 1, 4), d(2020, 1, 4), d(2020, 1, 5))], "event_id string, pre_start_date date, event_start_date date, event_end_date date, post_end_date date")
    firms = spark.createDataFrame([("CSI300", "000001", None, None), ("SP500", "VOID", None, None), ("SP500", "LATE", d(2021, 1, 1), None)], "market string, ticker string, member_from date, member_to date")
    prices = spark.createDataFrame([("CSI300", "000001", d(2020, 1, 3), 11.0)], "market string, ticker string, date date, close double")
    news = spark.createDataFrame([("CSI300", "000001", d(2020, 1, 4))], "market string, ticker string, date date")
    rows = {(r["ticker"], r["date"].day): r for r in panel.dense_panel(panel.eligible(events, firms), prices, news).collect()}
    assert len(rows) == 6 and rows["VOID", 4]["news_count"] == 0 and rows["000001", 4]["close"] is None and rows["000001", 4]["has_news"] == 1
    assert {k[1] for k, r in rows.items() if r["is_pre_event_input"]} == {3}


def test_vendor_and_chart_rows(spark):
    d = dt.date
    vendor = spark.createDataFrame([("CSI300", "000001", "20200103", 10.0, 12.0, 9.0, 11.0, 2.0, k, d(2020, 1, 1), d(2020, 1, 5)) for k in (1, 2)], "market string, ticker string, trade_date string, open double, high double, low double, close double, vol double, load_order int, from_date date, to_date date")
    assert [r["volume"] for r in panel.from_vendor(vendor).collect()] == [200.0]
    chart = {"chart": {"result": [{"meta": {"exchangeTimezoneName": "America/New_York", "currency": "USD"}, "timestamp": [1578056400, 1578060000, 1578142800], "indicators": {"quote": [{"open": [10.0, 10.5], "high": [12.0, 12.0], "low": [9.0, 9.0], "close": [11.0, 11.5, None], "volume": [200.0]}]}}]}}
    charts = spark.createDataFrame([("SP500", "X", json.dumps(chart), d(2020, 1, 1), d(2020, 1, 9))], "market string, ticker string, chart string, from_date date, to_date date")
    assert [(r["date"], r["close"], r["volume"]) for r in panel.from_chart(charts).collect()] == [(d(2020, 1, 3), 11.5, None)]


def test_fingerprint_ignores_order_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    stored = reports.fingerprint(a).first().asDict()
    assert not reports.stale(a.orderBy(F.desc("k")), stored) and reports.stale(a.distinct(), stored)


WINDOW = {"endpoint": "news", "source": "x", "start_dt": "2020-01-01 00:00:00", "end_dt": "2020-01-01 23:59:59"}


def envelope(stamps, announced=None, **other):
    records = [{"datetime": s, "title": "t", "content": f"c{k}", "src": "s"} if not isinstance(s, dict) else s for k, s in enumerate(stamps)]
    return json.dumps(WINDOW | {"row_count": len(records) if announced is None else announced, "records": records} | other)


@pytest.fixture
def lots(spark, tmp_path):
    """Land files, run both streams (stopping in mid-batch if asked), and count."""
    (tmp_path / "landing").mkdir()
    out = f"file://{tmp_path}/out"

    class Lots:
        def land(self, name, *texts):
            (tmp_path / "landing" / name).write_text("\n".join(texts))

        def run(self, stop=False, lines=True):
            def after(epoch):
                if stop:
                    raise OSError("stopped")

            for f, checkpoint in ((ingest.ingest_pools, "c1"), (ingest.keep_ledger, "c2")):
                args = (spark, f"file://{tmp_path}/landing", out, f"file://{tmp_path}/{checkpoint}", lines, after)
                if stop:
                    with pytest.raises(StreamingQueryException, match="stopped"):
                        f(*args)
                else:
                    f(*args)
            return ingest.records(spark, out).count(), ingest.violations(spark, out).count()

        def tasks(self):
            return {r["pool"]: (r["status"], r["attempts"], r["row_count"], r["bad"], r["error"]) for r in ingest.ledger(spark, out).collect()}

        def sound(self):
            return sorted(r["content"] for r in ingest.ingested(spark, out).collect())

    yield Lots()


TASK = "news|x|2020-01-01 00:00:00|2020-01-01 23:59:59"


def test_ingestion_stops_and_resumes(lots):
    good, late = ["2020-01-01 08:00:00"] * 3, "2020-01-02 08:00:00"
    lots.land("a.json", envelope([good[0], late]), envelope(good, source="y"), envelope(good, source="y"), envelope([], source="z"), "{no json", "")
    assert lots.run(stop=True)  # the epoch is written, not marked as done
    assert lots.run() == (4, 1) == lots.run()
    other = TASK.replace("|x|", "|y|"), TASK.replace("|x|", "|z|")
    tasks = lots.tasks()
    assert tasks[TASK] == ("error", 1, 2, 1, "outside its window") and tasks[other[0]] == ("complete", 1, 3, 0, None) and tasks[other[1]] == ("empty", 1, 0, 0, None)
    assert [v[4] for k, v in tasks.items() if k.endswith("a.json")] == ["unreadable"]
    assert lots.sound() == ["c0", "c0", "c1", "c2"]
    lots.land("b.json", envelope(good), envelope(good, source="y"))  # the failed task lands again, and one that was complete
    lots.run(stop=True)
    assert lots.run() == (10, 1)
    assert lots.tasks()[TASK] == ("complete", 2, 3, 0, None) and lots.tasks()[other[0]] == ("complete", 2, 3, 0, None)
    assert lots.sound() == ["c0", "c0", "c1", "c1", "c2", "c2"]


def test_nothing_has_landed(lots):
    assert lots.run() == (0, 0) and lots.tasks() == {} and lots.sound() == []


def test_ingestion_parts_records_of_one_time(spark, lots):
    given = [("2020-01-01 08:00:00", "a"), ("2020-01-01 08:00:00", ""), ("2020-01-01 08:00:00", "b"), (None, "c")]
    lots.land("a.json", envelope([{"datetime": ts, "title": "t", "content": c, "src": "s"} for ts, c in given]))
    assert lots.run() == (2, 2) and lots.sound() == ["a", "b"]
    assert lots.tasks()[TASK] == ("error", 1, 4, 2, "no content;no time")


def test_documents_over_many_lines_and_missing_tasks(spark, lots):
    lots.land("a.json", json.dumps(json.loads(envelope(["2020-01-01 08:00:00"], announced=7)), indent=1))
    assert lots.run(lines=False) == (0, 1) and lots.tasks()[TASK] == ("error", 1, 1, 0, "another number of rows")
    tasks = spark.createDataFrame([("news", "x", "2020-01-01 00:00:00", "2020-01-01 23:59:59"), ("news", "q", "2020-01-01 00:00:00", "2020-01-01 23:59:59")], "endpoint string, source string, start_dt string, end_dt string")
    states = spark.createDataFrame([(k, v[0], v[4]) for k, v in lots.tasks().items()], "pool string, status string, error string")
    assert sorted(r["rule"] for r in ingest.failed_or_missing(tasks, states).collect()) == ["another number of rows", "missing"]


def test_tables_keep_keys_as_text(spark, tmp_path):
    rows = spark.createDataFrame([("e", "m", "000001", 1.0)], "event_id string, market string, ticker string, close double")
    io.write_table(rows, f"file://{tmp_path}/t.csv", "csv")
    assert io.read_frame(spark, f"file://{tmp_path}/t.csv").first()["ticker"] == "000001"
    io.write_slices(rows, f"file://{tmp_path}/slices")
    assert spark.read.parquet(f"file://{tmp_path}/slices/event_id=e/market=m").count() == 1


def test_pool_order_ignores_the_last_bit_of_sums(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 are equal scores; before, the greater double went first."""
    low, high = (0.3, 0.2, 0.1), (0.1, 0.2, 0.3)
    assert low[0] + low[1] + low[2] < high[0] + high[1] + high[2]
    rows = [("e", "m", "1", dt.date(2020, 1, 1), f"k{i}", f"a{i}", "s", "hkexnews_announcement", "t", "c", "", f"a{i}.json", *scores) for i, scores in enumerate((low, high))]
    c = spark.createDataFrame(rows, "event_id string, market string, ticker string, date date, dedupe_key string, article_id string, source string, source_type string, title string, content string, time string, file_name string, alignment_score double, quality_score double, source_priority double")
    ranks = {r["article_id"]: r["rank"] for r in pool.daily_pool(c).collect()}
    assert ranks == {"a0": 1, "a1": 2}  # by alignment


def test_joined_dictionary_finds_what_automata_find(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("abé中 -") for _ in range(rng.randint(a, b)))
    rows = [(rng.choice("MN"), w, str(k % 5)) for k, w in enumerate([word(2, 5) for _ in range(60)] + ["ab", "aba", "b-a"])]
    words = spark.createDataFrame(rows, "market string, alias string, ticker string").withColumn("compact", text.compact_alias(F.col("alias")))
    news = [(k, None, word(0, 12), word(0, 60)) for k in range(80)] + [(3, None, "ab aba", None)]
    texts = spark.createDataFrame(news, "id int, day date, title string, content string")
    monkeypatch.setattr(aliases, "BEGINNINGS", 12)
    monkeypatch.setattr(aliases, "FILTER_BITS", 256)
    show = lambda df: sorted({(r["id"], r["market"], r["location"], r["compact"], tuple(sorted(r["free"]))) for r in df.collect()})
    for t in (texts, texts.withColumn("market", F.when(F.col("id") % 3 > 0, "M").otherwise("N"))):
        plain = show(aliases.scan(t, words))
        assert plain == show(aliases.scan_joined(t, words)) and plain
    monkeypatch.setattr(aliases, "PART_BYTES", 64)
    monkeypatch.setattr(aliases, "dictionary_parts", None)  # before: as many parts as the dictionary needs, all built for each batch
    assert show(aliases.scan(texts, words))


def test_hits_of_a_great_dictionary_are_those_of_a_small_one(spark, monkeypatch):
    rng = random.Random(11)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    number = lambda: "no#" + "".join(rng.choice("123") for _ in range(rng.randint(1, 5)))
    rows = [(rng.choice("MN"), number() if k % 8 else rng.choice(["no 1", "o-1", "1#no#", "#2no"]), str(k % 9), rng.choice(["manual_alias", "ticker"]), day(rng.randint(0, 3)) if k % 4 == 0 else None, day(rng.randint(2, 6)) if k % 5 == 0 else None) for k in range(150)]
    words = spark.createDataFrame(rows, "market string, alias string, ticker string, alias_type string, valid_from date, valid_to date").withColumn("compact", text.compact_alias(F.col("alias")))
    words = words.withColumn("confidence", F.lit(0.9)).dropDuplicates(["market", "ticker", "compact"])
    line = lambda n: ", ".join(number() for _ in range(n))
    news = [(k // 2 if k % 9 == 0 else k, day(rng.randint(0, 8)) if k % 3 else None, line(rng.randint(0, 3)), line(rng.randint(0, 9))) for k in range(90)] + [(None, None, "no#1 no 1", None)]
    texts = spark.createDataFrame(news, "id int, day date, title string, content string")
    monkeypatch.setattr(aliases, "BEGINNINGS", 40)
    monkeypatch.setattr(aliases, "HASHED", 50)
    show = lambda df: sorted(map(str, df.select("id", "market", "ticker", "compact", "location", "alias", "ambiguous", "score").collect()))
    for part, shared, bits in ((words, 1, 1 << 20), (words, 20, 64), (words.where("alias not like '% %' and alias not like '%-%'"), 5, 1 << 20)):
        monkeypatch.setattr(aliases, "SHARED", shared)
        monkeypatch.setattr(aliases, "FILTER_BITS", bits)
        for t in (texts, texts.withColumn("market", F.when(F.col("id") % 3 > 0, "M").otherwise("N"))):
            plain = show(aliases.hits(aliases.scan(t, part), part))
            assert plain == show(aliases.hits_joined(t, part)) and plain


def test_places_are_shuffled_once_and_texts_not_at_all(spark, monkeypatch):
    from tideline.plans import newsroom

    plain = newsroom.j10_large_dictionary(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(aliases, "PART_BYTES", 1)
    out = newsroom.j10_large_dictionary(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Join" in x and "_text" in x]  # before: matches met their texts again
    assert sorted(out.collect()) == sorted(plain) and plain
    forms = ["no#1", "no#12", "no#123", "no#1234"]
    words = aliases.entry_table(spark.createDataFrame([("M", f, "1") for f in forms], "market string, alias string, ticker string").withColumn("compact", F.col("alias")))
    texts = spark.createDataFrame([(1, None, "no#1234, no#12345, no#13", "")], "id int, day date, title string, content string")
    places = aliases.placed(texts, words, aliases.Plan(words), False).where("spot > 0")
    assert sorted(r["compact"] for r in places.collect()) == ["no#1", "no#1234"]  # before: a row for each form that a place begins with, nine


def test_alignment_passes_over_a_text_before_it_meets_its_companies(spark):
    from tideline.plans import newsroom

    plan = newsroom.c19_alias_alignment(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    met, below = plan.split("Join Inner", 1)
    assert "regexp_replace(content" not in met and "regexp_replace(title" not in met  # before: for each company, and again for each reason
    assert met.lower().count("contains(content_compact") == 2 and "regexp_replace(content" in below


def test_places_are_held_for_one_text_at_a_time():
    import tracemalloc
    from io import BytesIO

    import pyarrow as pa

    buffer = BytesIO()
    words = pa.table({"market": ["M", "M"], "compact": ["ab", "cd"], "latin": pa.array([None, "cd"])})
    with pa.ipc.new_stream(buffer, words.schema) as writer:
        writer.write_table(words)
    forms = aliases.Forms(buffer.getvalue())

    def most(n):
        text = "abcd" * 2000
        batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "day": pa.nulls(n, pa.date32()), "title": ["ab cd"] * n, "content": [text] * n, "title_flat": ["abcd"] * n, "content_flat": [text] * n})
        tracemalloc.start()
        found = [x for out in aliases.found_in(iter([batch]), forms, False) for x in out.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 4 * n and {x["compact"]: x["free"] for x in found if x["location"] == "title"} == {"ab": [], "cd": ["cd"]}
        return peak

    assert most(80) < 2 * most(20)  # before: a batch's places, 4,000 for each of these texts
