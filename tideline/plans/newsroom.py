"""Queries over news text, aliases, pools and media attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as C
from ..functions import text as T
from ..operators import aliases, attention, pool, reports
from . import standin as S
from .registry import query
from .study import KEY, PANEL, WITH, dense, eligible, firm_news, r6

WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
GAPS = r"[-\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}·・.。．,，、()（）\\/]+"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def compact(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '{WS}', '', 'g'))"


def compact_alias(x: str) -> str:
    return f"lower(regexp_replace({squeeze(x)}, '{GAPS}', '', 'g'))"


def layout(x: str) -> str:
    """``article_layout`` in SQL."""
    t = f"regexp_replace(regexp_replace(translate({x}, chr(13) || chr(12288) || chr(160), chr(10) || '  '), '<[^>]+>', '', 'g'), '[ \\t]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}|{WS}$', '', 'g')"


@query(f"SELECT doc_id, md5({squeeze('coalesce(text, \'\')')}) AS clean_md5, length({squeeze('coalesce(text, \'\')')})::INTEGER AS n FROM documents")
def c1_normalize_text(spark, sf):
    t = T.normalize_text(F.col("text"))
    return S.table(spark, sf, "documents").select("doc_id", F.md5(t.cast("binary")).alias("clean_md5"), F.char_length(t).alias("n"))


def stripped(x: str) -> str:
    return squeeze(rf"regexp_replace(regexp_replace({x}, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')")


STRIPPED = stripped("coalesce(html, '')")


@query(f"SELECT page_id, md5({STRIPPED}) AS clean_md5, length({STRIPPED})::INTEGER AS n FROM pages")
def c2_strip_markup(spark, sf):
    t = T.without_scripts(F.coalesce("html", F.lit("")))
    return S.table(spark, sf, "pages").select("page_id", F.md5(t.cast("binary")).alias("clean_md5"), F.char_length(t).alias("n"))


#: The entities of the pages, ampersands put aside first so that nothing is resolved twice.
RESOLVED = "replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '&amp;?', chr(1), 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), chr(1), '&')"


@query(f"SELECT page_id, md5({stripped(RESOLVED)}) AS clean_md5, length({stripped(RESOLVED)})::INTEGER AS n FROM pages")
def c2_u1_clean_content(spark, sf):
    t = T.clean_content(F.col("html"))
    return S.table(spark, sf, "pages").select("page_id", F.md5(t.cast("binary")).alias("clean_md5"), F.char_length(t).alias("n"))


@query(f"SELECT doc_id, md5({layout('coalesce(text, \'\')')}) AS clean_md5 FROM documents")
def c3_c4_normalize_article(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_article(F.col("text")).cast("binary")).alias("clean_md5"))


HIGH = r"length(regexp_replace(coalesce(text, ''), '[^\x{80}-\x{FF}]', '', 'g'))"
HAN = r"length(regexp_replace(coalesce(text, ''), '[^\x{4e00}-\x{9fff}]', '', 'g'))"


@query(f"SELECT doc_id, md5({compact('coalesce(text, \'\')')}) AS compact_md5, {HAN}::INTEGER AS cjk, {HIGH} >= 4 AND {HAN} = 0 AND {HIGH} / greatest(length(coalesce(text, '')), 1) >= 0.15::DOUBLE AS looks_mojibake FROM documents")
def c4_c5_c14_text_profile(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return S.table(spark, sf, "documents").select("doc_id", F.md5(T.compact_text(F.col("text")).cast("binary")).alias("compact_md5"), T.cjk_count(t).alias("cjk"), T.looks_mojibake(t).alias("looks_mojibake"))


@query(f"SELECT doc_id, md5({compact_alias('title')}) AS title_alias FROM (WITH {S.CTE} SELECT * FROM news)")
def c6_compact_alias(spark, sf):
    return S.news(spark, sf).select("doc_id", F.md5(T.compact_alias(F.col("title")).cast("binary")).alias("title_alias"))


HEAD = "'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'"


@query(f"""SELECT page_id, CASE WHEN regexp_matches(url, {HEAD}) THEN regexp_replace(lower(regexp_extract(url, {HEAD})) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+$', '') ELSE url END AS clean_url FROM pages""")
def c12_normalize_url(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", T.normalize_url(F.col("url")).alias("clean_url"))


@query(f"""{WITH} SELECT doc_id, left(sha256(to_json([date::VARCHAR, title, content])::VARCHAR), 24) AS article_id,
  left(sha1(concat_ws('||', nullif(trim(title), ''), nullif(trim(source), ''), nullif(trim(content), ''))), 16) AS row_hash FROM news""")
def c13_content_ids(spark, sf):
    return S.news(spark, sf).select("doc_id", T.article_id(F.col("date"), F.col("title"), F.col("content")).alias("article_id"), T.stable_hash(F.col("title"), F.col("source"), F.col("content")).alias("row_hash"))


@query(f"""{WITH}, c AS (SELECT doc_id, {layout("CASE WHEN lang = 'en' THEN '' ELSE title END")} AS a, {layout('content')} AS b, {layout('title')} AS t FROM news)
SELECT doc_id, md5(CASE WHEN a <> '' THEN a ELSE b END) AS first_md5,
md5(CASE WHEN a <> '' THEN a WHEN {compact('b')} = '' OR ({compact('t')} <> '' AND (contains({compact('t')}, {compact('b')}) OR contains({compact('b')}, {compact('t')}))) OR length(b) < 80 THEN '' ELSE b END) AS choice_md5 FROM c""")
def c15_c16_content_choice(spark, sf):
    """The first filled field; and an article's text, else its summary where that says more than the title."""
    rows = S.news(spark, sf).withColumn("a", F.when(F.col("lang") == "en", "").otherwise(F.col("title")))
    rows = rows.select("doc_id", T.first_filled(F.col("a"), F.col("content")).alias("f"), *[T.normalize_article(F.col(x)).alias(y) for x, y in (("a", "x"), ("content", "s"), ("title", "t"))])
    return rows.select("doc_id", F.md5(F.col("f").cast("binary")).alias("first_md5"), F.md5(C.content_or_summary(F.col("x"), F.col("s"), F.col("t")).cast("binary")).alias("choice_md5"))


GARBLED = "中国石油天然气".encode().decode("latin-1")


@query("""WITH d AS (SELECT doc_id, lang, replace(coalesce(source, ''), '&', '') AS s FROM documents)
SELECT doc_id, CASE WHEN lang = 'en' THEN s ELSE '<b> ' || s || ' & é "中"' END AS plain, CASE WHEN lang = 'de' THEN s ELSE '中国石油天然气' || doc_id::VARCHAR END AS repaired FROM d""")
def u1_u2_entities_and_mojibake(spark, sf):
    """Entities in texts of all languages but one, and UTF-8 read as Latin-1 in all but another."""
    s = F.replace(F.coalesce("source", F.lit("")), F.lit("&"), F.lit(""))
    coded = F.when(F.col("lang") == "en", s).otherwise(F.concat(F.lit("&lt;b&gt; "), s, F.lit(" &amp; &#233; &quot;&#x4e2d;&quot;")))
    broken = F.when(F.col("lang") == "de", s).otherwise(F.concat(F.lit(GARBLED), F.col("doc_id").cast("string")))
    return S.table(spark, sf, "documents").select("doc_id", T.unescape(coded).alias("plain"), T.repair(broken).alias("repaired"))


# ---- candidates

KINDS = ["hkexnews_announcement", "google_news_rss", "gdelt_doc_api_company_query", "sina_finance_company_news", "other"]
NAMES = ["Reuters Asia", "Bloomberg", "新浪财经", "local"]
STATUSES = ["success", "skip_success", "summary_only", "title_only", "not_requested", "detail_failed", "fetch_failed", "empty", "strange"]
WORDS = ["that", "with", "this", "from", "rewh", "orre", "thatin", "tion"]


def pick(names, n):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % n + 1).cast("int"))


def pick_sql(names, n):
    return f"([{', '.join(repr(x) for x in names)}])[doc_id % {n} + 1]"


def raw_candidates(spark, sf):
    """News of firms with a source type, a source name, an extraction status, a company name, and often a URL."""
    rows = firm_news(spark, sf)
    return rows.select(
        F.lit("e1").alias("event_id"), "market", "ticker", "date", "doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("article_id"), "title", "content",
        pick(KINDS, 5).alias("source_type"), pick(NAMES, 4).alias("source"), pick(STATUSES, 9).alias("status"), pick(WORDS, 8).alias("company_name"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("HTTPS://News.Example.COM/a/"), (F.col("doc_id") % 300).cast("string"), F.lit("/?x=1#y"))).alias("url"),
        F.concat(F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0"), F.lit(":00")).alias("time"),
    )


def scored_candidates(spark, sf):
    rows = C.with_alignment(C.with_compact_forms(raw_candidates(spark, sf))).drop("title_compact", "content_compact", "clean_name")
    quality = C.quality(F.col("status"), F.col("content"), F.col("title"), F.col("source"), F.col("url"), F.col("time"), F.lit(None).cast("string"))
    rows = rows.withColumns({"reasons": F.array_join("reasons", ";"), "quality_score": quality, "source_priority": C.source_priority(F.col("source_type"), F.col("source"))})
    return rows.withColumns({"dedupe_key": C.dedupe_key(F.col("url"), F.col("title"), F.col("content"), F.col("date"), F.col("article_id")), "file_name": F.concat(F.col("article_id"), F.lit(".json"))})


CAND = f"""cand0 AS (SELECT 'e1' AS event_id, market, ticker, date, doc_id, lpad(doc_id::VARCHAR, 12, '0') AS article_id, title, content, {pick_sql(KINDS, 5)} AS source_type, {pick_sql(NAMES, 4)} AS source,
  {pick_sql(STATUSES, 9)} AS status, {pick_sql(WORDS, 8)} AS company_name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://news.example.com/a/' || (doc_id % 300)::VARCHAR END AS url, lpad((doc_id % 24)::VARCHAR, 2, '0') || ':00' AS time,
  {compact('title')} AS tc, {compact('content')} AS cc, {compact('substr(content, 1, 400)')} AS c4 FROM news JOIN firm ON s_suppkey - 1 = doc_id % (SELECT count(*) FROM firm)),
cand AS (SELECT *, least(100.0::DOUBLE, CASE WHEN source_type IN ('hkexnews_announcement', 'sina_finance_company_news') THEN 45.0 ELSE 0.0 END + CASE WHEN contains(tc, ticker) THEN 20.0 WHEN contains(cc, ticker) THEN 10.0 ELSE 0.0 END
  + CASE WHEN contains(tc, company_name) THEN 25.0 WHEN contains(cc, company_name) THEN 12.0 ELSE 0.0 END)::DOUBLE AS alignment_score,
  concat_ws(';', CASE WHEN source_type IN ('hkexnews_announcement', 'sina_finance_company_news') THEN 'direct_company_source' END, CASE WHEN contains(tc, ticker) THEN 'ticker_in_title' WHEN contains(cc, ticker) THEN 'ticker_in_content' END,
  CASE WHEN contains(tc, company_name) THEN 'name_in_title' WHEN contains(cc, company_name) THEN 'name_in_content' END,
  CASE WHEN source_type NOT IN ('hkexnews_announcement', 'sina_finance_company_news') AND NOT contains(cc || tc, ticker) AND NOT contains(tc, ticker) AND NOT contains(cc, company_name) AND NOT contains(tc, company_name) THEN 'no_alignment_signal' END) AS reasons,
  (CASE status WHEN 'success' THEN 30.0 WHEN 'skip_success' THEN 24.0 WHEN 'summary_only' THEN 16.0 WHEN 'title_only' THEN 10.0 WHEN 'not_requested' THEN 6.0 WHEN 'detail_failed' THEN 4.0 WHEN 'fetch_failed' THEN 0.0 WHEN 'empty' THEN -6.0
    ELSE CASE WHEN content <> '' THEN 6.0 ELSE 0.0 END END)::DOUBLE + least(length(content) / 220.0::DOUBLE, 24.0::DOUBLE) + CASE WHEN title <> '' THEN 6 ELSE 0 END + 3 + CASE WHEN url <> '' THEN 4 ELSE 0 END + 2 AS quality_score,
  (CASE source_type WHEN 'hkexnews_announcement' THEN 36 WHEN 'google_news_rss' THEN 18 WHEN 'gdelt_doc_api_company_query' THEN 16 WHEN 'sina_finance_company_news' THEN 32 ELSE 10 END
   + CASE source WHEN 'Reuters Asia' THEN 6 WHEN 'Bloomberg' THEN 6 WHEN '新浪财经' THEN 4 ELSE 0 END)::DOUBLE AS source_priority,
  CASE WHEN url <> '' THEN 'url::' || url WHEN tc <> '' THEN 'title::' || tc || '::' || date::VARCHAR WHEN c4 <> '' THEN 'content::' || c4 || '::' || date::VARCHAR ELSE 'id::' || article_id END AS dedupe_key, article_id || '.json' AS file_name FROM cand0)"""


@query(f"{WITH}, {CAND} SELECT doc_id, alignment_score, reasons, round(quality_score, 6) AS quality_score, source_priority, md5(dedupe_key) AS dedupe_md5 FROM cand")
def c17_c21_c27_candidate_scores(spark, sf):
    rows = scored_candidates(spark, sf).select("doc_id", "alignment_score", "reasons", "quality_score", "source_priority", F.md5(F.col("dedupe_key").cast("binary")).alias("dedupe_md5"))
    return r6(rows, "quality_score")


DUP = f"""{CAND}, best AS (SELECT *, row_number() OVER g AS r, count(*) OVER k AS duplicate_count, min(file_name) OVER k AS first_file FROM cand
  WINDOW k AS (PARTITION BY event_id, market, ticker, date, dedupe_key), g AS (PARTITION BY event_id, market, ticker, date, dedupe_key ORDER BY quality_score DESC, source_priority DESC, length(content) DESC, time DESC, file_name DESC)),
dedup AS (SELECT *, length(content) AS length, alignment_score + quality_score + source_priority + 3.0 * least(greatest(duplicate_count - 1, 0), 3) AS representative_score,
  source_type IN ('hkexnews_announcement', 'sina_finance_company_news') OR alignment_score >= 18 AS passes FROM best WHERE r = 1),
pool0 AS (SELECT *, passes OR NOT bool_or(passes) OVER (PARTITION BY event_id, market, ticker, date) AS in_pool FROM dedup),
pool AS (SELECT *, CASE WHEN in_pool THEN row_number() OVER (PARTITION BY event_id, market, ticker, date ORDER BY in_pool DESC, round(representative_score, 6) DESC, alignment_score DESC, round(quality_score, 6) DESC, length DESC, time DESC, first_file, article_id) END AS rank FROM pool0)"""


@query(f"{WITH}, {DUP} SELECT market, ticker, date, article_id, duplicate_count, round(representative_score, 6) AS representative_score FROM dedup")
def w4_a20_best_duplicates(spark, sf):
    return r6(pool.best_duplicates(scored_candidates(spark, sf)).select("market", "ticker", "date", "article_id", "duplicate_count", "representative_score"), "representative_score")


@query(f"{WITH}, {DUP} SELECT market, ticker, date, article_id, passes, in_pool, rank FROM pool")
def w5_daily_pool(spark, sf):
    return pool.daily_pool(scored_candidates(spark, sf)).select("market", "ticker", "date", "article_id", "passes", "in_pool", "rank")


@query(f"{WITH}, {DUP} SELECT market, ticker, date, article_id, row_number() OVER (PARTITION BY event_id, market, ticker, date ORDER BY rank) AS rank FROM pool WHERE in_pool AND alignment_score >= 18")
def w6_strict_pool(spark, sf):
    return pool.strict_pool(pool.daily_pool(scored_candidates(spark, sf))).select("market", "ticker", "date", "article_id", "rank")


@query(f"""{WITH}, {DUP} SELECT market, ticker, date, arg_min(article_id, rank) AS article_id, arg_min(source, rank) AS source, count(*) AS pool_candidate_count, string_agg(article_id, ';' ORDER BY rank) AS pool_article_ids, string_agg(source, ';' ORDER BY rank) AS pool_sources
FROM pool WHERE in_pool AND alignment_score >= 18 GROUP BY ALL""")
def w7_representatives(spark, sf):
    out = pool.representatives(pool.strict_pool(pool.daily_pool(scored_candidates(spark, sf))))
    return out.select("market", "ticker", "date", "article_id", "source", "pool_candidate_count", F.array_join("pool_article_ids", ";").alias("pool_article_ids"), F.array_join("pool_sources", ";").alias("pool_sources"))


@query(f"""{WITH}, {DUP} SELECT c.event_id, c.market, c.ticker, c.date, raw_count, deduped_count, pool_count FROM (SELECT event_id, market, ticker, date, count(*) AS raw_count FROM cand GROUP BY ALL) c
JOIN (SELECT event_id, market, ticker, date, count(*) AS deduped_count, count(*) FILTER (in_pool) AS pool_count FROM pool GROUP BY ALL) p USING (event_id, market, ticker, date)""")
def a4_pool_stats(spark, sf):
    rows = scored_candidates(spark, sf)
    return pool.pool_stats(rows, pool.daily_pool(rows))


@query(f"{WITH} SELECT count(*) AS n FROM (SELECT DISTINCT date, source, title, content FROM news)")
def a21_distinct_news(spark, sf):
    return pool.distinct_news(S.news(spark, sf).withColumn("time", F.col("date"))).agg(F.count("*").alias("n"))


CLASS = "CASE WHEN length(content) >= 200 THEN 'full_text' WHEN length(content) >= 20 THEN 'short_text' WHEN title <> '' THEN 'title_only' ELSE 'missing_content' END"
GROUP = "CASE WHEN doc_id % 2 = 0 THEN 'main_tushare' ELSE 'supplement_announcements' END"


@query(f"""{WITH}, c AS (SELECT *, {CLASS} AS availability, {GROUP} AS grp, ([ 'title', 'content', 'none' ])[doc_id % 3 + 1] AS location, {compact_alias("title || ' ' || content")} AS t FROM news),
r AS (SELECT *, CASE WHEN contains(t, 'thatin') OR contains(t, 'rewh') THEN 'event_direct' WHEN contains(t, 'tion') THEN 'market_impact_context' WHEN grp = 'supplement_announcements' THEN 'non_event_corporate_disclosure' ELSE 'event_unrelated' END AS relevance FROM c)
SELECT doc_id, availability, relevance, CASE location WHEN 'title' THEN 'strong' WHEN 'content' THEN 'medium' ELSE 'weak_or_ambiguous' END AS strength,
CASE WHEN location = 'none' THEN 'exclude_candidate' WHEN availability IN ('missing_content', 'title_only') OR relevance IN ('event_unrelated', 'non_event_corporate_disclosure') OR (grp <> 'main_tushare' AND availability <> 'full_text') THEN 'needs_attention' ELSE 'ok' END AS risk FROM r""")
def c22_c25_classify_news(spark, sf):
    rows = S.news(spark, sf).withColumns({"grp": F.when(F.col("doc_id") % 2 == 0, "main_tushare").otherwise("supplement_announcements"), "location": pick(["title", "content", "none"], 3)})
    rows = rows.withColumns({"availability": C.content_class(F.col("title"), F.col("content")), "strength": C.match_strength(F.col("location")), "relevance": C.event_relevance(F.lit("e1"), F.col("grp"), F.col("title"), F.col("content"), None, {"e1": ["thatin", "rewh"]}, ["tion"])})
    risk = C.risk(F.col("grp"), F.col("availability"), F.col("strength"), F.lit(""), F.col("relevance"))
    return rows.select("doc_id", "availability", "relevance", "strength", risk.alias("risk"))


# ---- aliases

# market, word, ticker, type, confidence; "thatin" and "that" are of different markets
ALIASES = [
    ("M", "that", "1", "short_name", 0.82), ("M", "with", "2", "short_name", 0.82), ("M", "this", "3", "manual_alias", 0.9), ("M", "from", "4", "legal_or_stock_name", 0.95), ("M", "rewh", "5", "ticker", 0.95),
    ("M", "orre", "6", "manual_alias", 0.9), ("M", "tion", "8", "manual_alias", 0.9), ("M", "with", "9", "manual_alias", 0.9),
    ("N", "thatin", "7", "short_name", 0.82), ("N", "that", "1", "manual_alias", 0.9), ("N", "with", "2", "short_name", 0.82), ("N", "and", "5", "short_name", 0.7),
]
ALIAS_CTE = f"alias AS (SELECT * FROM (VALUES {', '.join(str(a) for a in ALIASES)}) t(market, compact, ticker, alias_type, confidence))"
HITS = f"""{ALIAS_CTE}, spot AS (SELECT doc_id AS id, 'title' AS location, title AS raw FROM news UNION ALL SELECT doc_id, 'content', content FROM news),
flat AS (SELECT *, {compact_alias('raw')} AS flat FROM spot),
found AS (SELECT DISTINCT id, location, raw, 'M' AS market, unnest(regexp_extract_all(flat, 'from|orre|rewh|that|this|tion|with')) AS compact FROM flat UNION ALL
  SELECT DISTINCT id, location, raw, 'N', unnest(regexp_extract_all(flat, 'thatin|that|with|and')) FROM flat),
amb AS (SELECT market, compact, count(DISTINCT ticker) > 1 AS ambiguous FROM alias GROUP BY ALL),
hit AS (SELECT id, market, ticker, compact, location, alias_type, ambiguous, round((CASE WHEN location = 'title' THEN 42.0::DOUBLE ELSE 20.0::DOUBLE END * confidence::DOUBLE + CASE WHEN alias_type = 'ticker' THEN 4 ELSE 0 END)
  * CASE WHEN NOT ambiguous THEN 1 WHEN location = 'title' THEN 0.55::DOUBLE ELSE 0.35::DOUBLE END, 3) AS score
  FROM found JOIN alias USING (market, compact) JOIN amb USING (market, compact) WHERE regexp_matches(raw, '(?i)(^|[^A-Za-z0-9])' || compact || '($|[^A-Za-z0-9])'))"""


def dictionary(spark):
    rows = spark.createDataFrame(ALIASES, "market string, alias string, ticker string, alias_type string, confidence double")
    return rows.withColumns({"compact": T.compact_alias(F.col("alias")), "valid_from": F.lit(None).cast("date"), "valid_to": F.lit(None).cast("date")})


def alias_hits(spark, sf):
    texts = S.news(spark, sf).select(F.col("doc_id").alias("id"), F.col("date").alias("day"), "title", "content")
    words = dictionary(spark)
    return aliases.text_hits(texts, words)


@query(f"{WITH}, {HITS} SELECT id, market, ticker, compact, location, ambiguous, score FROM hit")
def j10_alias_hits(spark, sf):
    return alias_hits(spark, sf).select("id", "market", "ticker", "compact", "location", "ambiguous", "score")


@query(f"""{WITH}, {HITS} SELECT id, market, ticker, compact, location, score, NOT ambiguous AND score >= 18 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY id, market, ticker ORDER BY score DESC, length(compact) DESC, location DESC, compact) AS r FROM hit) WHERE r = 1""")
def w3_best_hits(spark, sf):
    return aliases.accepted(aliases.best_hits(alias_hits(spark, sf))).select("id", "market", "ticker", "compact", "location", "score", "accepted")


@query(f"{WITH}, {HITS} SELECT count(*) AS hits, count(*) FILTER (NOT (NOT ambiguous AND score >= 18)) AS rejected FROM hit")
def a8_rejected_hits(spark, sf):
    return aliases.accepted(alias_hits(spark, sf)).agg(F.count("*").alias("hits"), F.count_if(~F.col("accepted")).alias("rejected"))


@query(f"{WITH}, {HITS} SELECT id, market, string_agg(ticker, ';' ORDER BY ticker) AS tickers FROM (SELECT id, market, ticker FROM hit GROUP BY ALL HAVING max(score) >= 18) GROUP BY ALL")
def j10_match_tickers(spark, sf):
    return aliases.match_tickers(alias_hits(spark, sf)).select("id", "market", F.array_join("tickers", ";").alias("tickers"))


DIRECT = "source_type IN ('hkexnews_announcement', 'sina_finance_company_news')"


@query(f"""{WITH}, {HITS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, market, ticker ORDER BY score DESC, length(compact) DESC, location DESC, compact) AS r FROM hit) WHERE r = 1),
c AS (SELECT b.*, {pick_sql(KINDS, 5)} AS source_type, {pick_sql(WORDS, 8)} AS company_name, {compact('title')} AS tc, {compact('content')} AS cc FROM b JOIN news ON id = doc_id)
SELECT id, market, ticker, least(100.0::DOUBLE, CASE WHEN {DIRECT} THEN 45.0 ELSE 0.0 END + CASE WHEN contains(tc, ticker) THEN 20.0 WHEN contains(cc, ticker) THEN 10.0 ELSE 0.0 END + score + CASE WHEN contains(tc, company_name) THEN 25.0 WHEN contains(cc, company_name) THEN 12.0 ELSE 0.0 END)::DOUBLE AS alignment_score,
  concat_ws(';', CASE WHEN {DIRECT} THEN 'direct_company_source' END, CASE WHEN contains(tc, ticker) THEN 'ticker_in_title' WHEN contains(cc, ticker) THEN 'ticker_in_content' END,
  'alias_' || location || ':' || compact || ':' || alias_type || ':score=' || score::VARCHAR, CASE WHEN ambiguous THEN 'alias_ambiguous_downweighted' END,
  CASE WHEN contains(tc, company_name) THEN 'name_in_title' WHEN contains(cc, company_name) THEN 'name_in_content' END) AS reasons FROM c""")
def c19_alias_alignment(spark, sf):
    """Alignment of texts with the companies whose aliases they hold: the best hit counts and is named in the reasons."""
    best = aliases.best_hits(alias_hits(spark, sf)).select("id", "market", "ticker", F.struct("location", "alias", "alias_type", "score", "ambiguous").alias("hit"))
    texts = C.with_compact_forms(S.news(spark, sf).withColumns({"source_type": pick(KINDS, 5), "company_name": pick(WORDS, 8)}))
    rows = best.join(texts.select("doc_id", "source_type", "title_compact", "content_compact", "clean_name"), F.col("id") == F.col("doc_id"))
    return C.with_alignment(rows, F.col("hit")).select("id", "market", "ticker", "alignment_score", F.array_join("reasons", ";").alias("reasons"))


#: A form for each order that is not open, and one for its customer's orders of that priority; texts name the orders of line items.
LARGE = """form AS (SELECT 'R' || (o_custkey % 3)::VARCHAR AS market, 'order#' || o_orderkey::VARCHAR AS compact, o_custkey::VARCHAR AS ticker FROM orders WHERE o_orderstatus <> 'O' OR o_orderkey % 2 = 0),
line AS (SELECT l_partkey AS id, string_agg('Order# ' || l_orderkey::VARCHAR, ', ' ORDER BY l_orderkey, l_linenumber) AS title FROM lineitem GROUP BY 1),
word AS (SELECT id, unnest(string_split(title, ', ')) AS w FROM line),
flat AS (SELECT DISTINCT id, replace(lower(w), ' ', '') AS f FROM word), m AS (SELECT DISTINCT market FROM form),
best AS (SELECT id, m.market, f, max(n) AS n FROM flat, m, range(7, 24) r(n) WHERE n <= length(f) AND EXISTS (SELECT 1 FROM form WHERE form.market = m.market AND compact = left(f, n)) GROUP BY ALL)"""


@query(f"WITH {LARGE} SELECT DISTINCT id, best.market, left(f, n) AS compact, ticker FROM best JOIN form ON form.market = best.market AND compact = left(f, n)")
def j10_large_dictionary(spark, sf):
    """More than ten thousand forms, many the beginning of others: the longest counts."""
    orders = S.table(spark, sf, "orders").where((F.col("o_orderstatus") != "O") | (F.col("o_orderkey") % 2 == 0))
    words = orders.select(F.concat(F.lit("R"), (F.col("o_custkey") % 3).cast("string")).alias("market"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("alias"), F.col("o_custkey").cast("string").alias("ticker"), F.lit("manual_alias").alias("alias_type"), F.lit(0.9).alias("confidence"))
    words = words.withColumns({"compact": T.compact_alias(F.col("alias")), "valid_from": F.lit(None).cast("date"), "valid_to": F.lit(None).cast("date")})
    title = F.array_join(F.transform(F.array_sort(F.collect_list("l_orderkey")), lambda k: F.concat(F.lit("Order# "), k.cast("string"))), ", ")
    texts = S.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(title.alias("title")).select("id", F.lit(None).cast("date").alias("day"), "title", F.lit("").alias("content"))
    return aliases.text_hits(texts, words).select("id", "market", "compact", "ticker")


@query(f"""{WITH}, {HITS}, company AS (SELECT market, ticker, market || ':' || ticker AS company_id, count(*) AS forms FROM alias GROUP BY ALL)
SELECT id, company_id, forms, count(*) AS hits, max(score) AS score FROM hit JOIN company USING (market, ticker) GROUP BY ALL""")
def j13_hit_companies(spark, sf):
    companies = dictionary(spark).groupBy("market", "ticker").agg(F.concat_ws(":", F.first("market"), F.first("ticker")).alias("company_id"), F.count("*").alias("forms"))
    return aliases.with_company(alias_hits(spark, sf), companies).groupBy("id", "company_id", "forms").agg(F.count("*").alias("hits"), F.max("score").alias("score"))


@query(f"""{WITH}, raw AS (SELECT market, ticker, 0 AS pos, company_name AS alias, 'legal_or_stock_name' AS alias_type FROM firm UNION ALL SELECT market, ticker, 1, company_name, 'short_name' FROM firm
UNION ALL SELECT market, ticker, 2, lower(company_name), 'english_or_code_alias' FROM firm UNION ALL SELECT market, ticker, 3, 'Alpha ' || ticker, 'manual_alias' FROM firm UNION ALL SELECT market, ticker, 4, '中国', 'manual_alias' FROM firm
UNION ALL SELECT market, ticker, 5, ticker, 'ticker' FROM firm UNION ALL SELECT market, ticker, 6, 'S' || ticker, 'ticker' FROM firm),
c AS (SELECT *, {compact_alias('alias')} AS compact FROM raw), u AS (SELECT *, row_number() OVER (PARTITION BY market, ticker, compact ORDER BY pos) AS r FROM c WHERE NOT regexp_matches(compact, '^[0-9]+$') AND length(compact) >= 2 AND compact <> '中国')
SELECT market, ticker, alias, compact, alias_type, CASE alias_type WHEN 'ticker' THEN 0.95::DOUBLE WHEN 'legal_or_stock_name' THEN 0.95::DOUBLE WHEN 'manual_alias' THEN 0.9::DOUBLE ELSE CASE WHEN length(compact) >= 4 THEN 0.82::DOUBLE WHEN length(compact) = 3 THEN 0.7::DOUBLE ELSE 0.45::DOUBLE END END AS confidence FROM u WHERE r = 1""")
def c7_c11_alias_dimension(spark, sf):
    companies = S.firms(spark, sf).withColumns({"query_name": F.lower("company_name"), "raw_code": F.concat(F.lit("S"), "ticker"), "aliases": F.concat(F.lit("Alpha "), "ticker", F.lit("；中国")), "valid_from": F.lit(None).cast("date"), "valid_to": F.lit(None).cast("date")})
    return aliases.derive_aliases(companies).drop("valid_from", "valid_to")


# ---- attention

FIRMDAY = """unit AS (SELECT event_id, market, ticker, date, url_hash AS unit, min(source) AS source, avg(tone) AS tone FROM mention GROUP BY ALL),
ent AS (SELECT event_id, market, ticker, date, greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0) AS e FROM (SELECT event_id, market, ticker, date, source, count(*) AS n FROM unit GROUP BY ALL) GROUP BY ALL),
tok AS (SELECT event_id, market, ticker, date, count(DISTINCT t) AS n FROM (SELECT event_id, market, ticker, date, unnest(list_filter(string_split(themes, ';'), lambda x: x <> '')) AS t FROM mention) GROUP BY ALL),
fd AS (SELECT u.event_id, u.market, u.ticker, u.date, count(*) AS gdelt_news_count, count(DISTINCT source) AS gdelt_source_count, avg(tone) AS avg_gdelt_tone, min(tone) AS min_gdelt_tone, max(tone) AS max_gdelt_tone,
  count(*) FILTER (tone > 1) AS positive_news_count, count(*) FILTER (tone < -1) AS negative_news_count, count(*) FILTER (tone BETWEEN -1 AND 1) AS neutral_news_count, count(*) FILTER (tone IS NULL) AS tone_missing_count FROM unit u GROUP BY ALL)"""
ROUND = "round({0}, 6) AS {0}"


@query(f"""{WITH}, {FIRMDAY} SELECT fd.event_id, fd.market, fd.ticker, fd.date, gdelt_news_count, gdelt_source_count, round(e, 6) AS gdelt_source_entropy, {ROUND.format('avg_gdelt_tone')}, {ROUND.format('min_gdelt_tone')}, {ROUND.format('max_gdelt_tone')},
positive_news_count, negative_news_count, neutral_news_count, tone_missing_count, coalesce(tok.n, 0) AS gdelt_theme_count, round(positive_news_count / gdelt_news_count, 6) AS positive_news_share, round(negative_news_count / gdelt_news_count, 6) AS negative_news_share
FROM fd LEFT JOIN ent USING (event_id, market, ticker, date) LEFT JOIN tok USING (event_id, market, ticker, date)""")
def a10_a12_firm_attention(spark, sf):
    out = attention.firm_days(S.mentions(spark, sf)).drop("gdelt_entity_count")
    return r6(out, "gdelt_source_entropy", "avg_gdelt_tone", "min_gdelt_tone", "max_gdelt_tone", "positive_news_share", "negative_news_share")


@query(f"""{WITH}, {FIRMDAY}, mu AS (SELECT event_id, market, date, url_hash, min(source) AS source, avg(tone) AS tone FROM mention GROUP BY ALL),
ma AS (SELECT event_id, market, date, count(*) AS u, avg(tone) AS nw, count(DISTINCT source) AS s FROM mu GROUP BY ALL), el AS (SELECT market, count(DISTINCT ticker) AS n FROM firm GROUP BY 1)
SELECT fd.event_id, fd.market, fd.date, count(*) AS covered_firm_count, any_value(el.n) AS eligible_firm_count, round(count(*) / any_value(el.n), 6) AS covered_firm_share, sum(gdelt_news_count)::BIGINT AS market_gdelt_firm_mention_count, any_value(u) AS market_gdelt_unique_article_count,
round(avg(avg_gdelt_tone), 6) AS avg_market_gdelt_tone_equal_weighted, round(any_value(nw), 6) AS avg_market_gdelt_tone_news_weighted, round(min(avg_gdelt_tone), 6) AS min_market_firm_tone, count(*) FILTER (avg_gdelt_tone < 0) AS negative_firm_count,
round(count(*) FILTER (avg_gdelt_tone < 0) / count(*), 6) AS negative_firm_share, any_value(s) AS market_source_count FROM fd JOIN ma USING (event_id, market, date) JOIN el USING (market) GROUP BY ALL""")
def a11_market_attention(spark, sf):
    m = S.mentions(spark, sf)
    out = attention.market_days(m, attention.firm_days(m), eligible(spark, sf).where(F.col("event_id") == "e1"))
    names = ["event_id", "market", "date", "covered_firm_count", "eligible_firm_count", "covered_firm_share", "market_gdelt_firm_mention_count", "market_gdelt_unique_article_count", "avg_market_gdelt_tone_equal_weighted", "avg_market_gdelt_tone_news_weighted", "min_market_firm_tone", "negative_firm_count", "negative_firm_share", "market_source_count"]
    return r6(out.select(*names), "covered_firm_share", "avg_market_gdelt_tone_equal_weighted", "avg_market_gdelt_tone_news_weighted", "min_market_firm_tone", "negative_firm_share")


@query(f"""{WITH}, t AS (SELECT market, date, token, count(*) AS n FROM (SELECT market, date, unnest(list_filter(string_split(themes, ';'), lambda x: x <> '')) AS token FROM mention) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY market, date ORDER BY n DESC, token) AS r FROM t) SELECT market, date, string_agg(token || ':' || n::VARCHAR, ';' ORDER BY r) AS top_gdelt_themes FROM r WHERE r <= 10 GROUP BY ALL""")
def a13_top_themes(spark, sf):
    return attention.top_themes(S.mentions(spark, sf), ["market", "date"])


FAMILIES = ["war_conflict", "sanction", "energy", "supply_chain_trade", "financial_stress", "policy_regulation", "disaster_health", "protest_unrest"]
FAMILY = [("CLICK", "energy"), ("VIEW", "policy_regulation"), ("PURCHASE", "supply_chain_trade"), ("SIGNUP", "war_conflict"), *[(f"T{k}", FAMILIES[k % 8]) for k in range(100)]]


@query(f"""{WITH}, fam AS (SELECT * FROM (VALUES {', '.join(str(f) for f in FAMILY)}) t(token, family)), m AS (SELECT DISTINCT market, date, article, family FROM (SELECT market, date, article, unnest(string_split(themes, ';')) AS token FROM mention) JOIN fam USING (token)),
c AS (SELECT market, date, {', '.join(f"count(*) FILTER (family = '{f}') AS {f}" for f in FAMILIES)} FROM m GROUP BY ALL), n AS (SELECT market, date, count(*) AS n FROM mention GROUP BY ALL)
SELECT market, date, {', '.join(f"coalesce({f}, 0) AS gdelt_theme_{f}_count, round(coalesce({f}, 0) / n, 6) AS gdelt_theme_{f}_share" for f in FAMILIES)} FROM n LEFT JOIN c USING (market, date)""")
def a14_theme_families(spark, sf):
    out = attention.theme_families(S.mentions(spark, sf), spark.createDataFrame(FAMILY, "token string, family string"), FAMILIES, ["market", "date"], "gdelt_theme")
    return r6(out, *[f"gdelt_theme_{n}_share" for n in FAMILIES])


def over(c, n, f="sum"):
    return f"{f}({c}) OVER (PARTITION BY event_id, market, ticker ORDER BY date RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)"


def r9(df, *columns):
    """Nine digits, so that means of numbers with two do not end on a half; and no negative zero."""
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in columns})


@query(f"""{WITH}, {FIRMDAY} SELECT event_id, market, ticker, date, {over('gdelt_news_count', 3)}::BIGINT AS gdelt_news_count_3d, {over('gdelt_news_count', 7)}::BIGINT AS gdelt_news_count_7d, {over('gdelt_news_count', 14)}::BIGINT AS gdelt_news_count_14d,
{over('negative_news_count', 3)}::BIGINT AS gdelt_negative_count_3d, {over('negative_news_count', 7)}::BIGINT AS gdelt_negative_count_7d, round({over('negative_news_count', 7)} / {over('gdelt_news_count', 7)}, 9) + 0.0 AS gdelt_negative_share_7d,
round({over('avg_gdelt_tone', 3, 'avg')}, 9) + 0.0 AS gdelt_avg_tone_3d, round({over('avg_gdelt_tone', 7, 'avg')}, 9) + 0.0 AS gdelt_avg_tone_7d, round({over('min_gdelt_tone', 7, 'min')}, 9) + 0.0 AS gdelt_min_tone_7d,
round(({over('gdelt_news_count', 3)} / 3) / ({over('gdelt_news_count', 14)} / 14 + 1), 9) + 0.0 AS gdelt_news_burst_3d_vs_14d, round(({over('negative_news_count', 3)} / 3) / ({over('negative_news_count', 14)} / 14 + 1), 9) + 0.0 AS gdelt_negative_burst_3d_vs_14d,
round({over('avg_gdelt_tone', 3, 'avg')} - {over('avg_gdelt_tone', 14, 'avg')}, 9) + 0.0 AS gdelt_tone_drop_3d_vs_14d FROM fd""")
def w10_w11_rolling_attention(spark, sf):
    out = attention.rolling(attention.firm_days(S.mentions(spark, sf)), KEY)
    names = [c for c in out.columns if c.endswith(("_3d", "_7d", "_14d"))]
    return r9(out.select(*KEY, "date", *names), *[c for c in names if "count" not in c])


def market_over(c, n, f="sum"):
    return f"{f}({c}) OVER (PARTITION BY event_id, market ORDER BY date RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)"


def market_burst(c):
    return f"round(({market_over(c, 3)} / 3) / ({market_over(c, 14)} / 14 + 1), 9) + 0.0"


@query(f"""{WITH}, {FIRMDAY}, el AS (SELECT market, count(DISTINCT ticker) AS n FROM firm GROUP BY 1),
md AS (SELECT fd.event_id, fd.market, fd.date, sum(gdelt_news_count)::BIGINT AS m, sum(negative_news_count)::BIGINT AS neg, count(*) AS cover, count(*) / any_value(el.n) AS share, avg(avg_gdelt_tone) AS tone FROM fd JOIN el USING (market) GROUP BY ALL)
SELECT event_id, market, date, {market_over('m', 3)}::BIGINT AS market_gdelt_mentions_3d, {market_over('m', 7)}::BIGINT AS market_gdelt_mentions_7d, {market_over('m', 14)}::BIGINT AS market_gdelt_mentions_14d,
{market_over('neg', 3)}::BIGINT AS market_negative_news_3d, {market_over('neg', 7)}::BIGINT AS market_negative_news_7d, round({market_over('neg', 7)} / {market_over('m', 7)}, 9) + 0.0 AS market_negative_share_7d,
round({market_over('share', 7, 'avg')}, 9) + 0.0 AS market_covered_firm_share_7d, round({market_over('tone', 3, 'avg')} - {market_over('tone', 14, 'avg')}, 9) + 0.0 AS market_tone_drop_3d_vs_14d,
{market_burst('neg')} AS market_negative_burst_3d_vs_14d, {market_burst('cover')} AS market_coverage_burst_3d_vs_14d FROM md""")
def w10_w11_rolling_market(spark, sf):
    m = S.mentions(spark, sf)
    out = attention.rolling_market(attention.market_days(m, attention.firm_days(m), eligible(spark, sf).where(F.col("event_id") == "e1")))
    names = [c for c in out.columns if c.endswith(("_3d", "_7d", "_14d"))]
    return r9(out.select("event_id", "market", "date", *names), *[c for c in names if "share" in c or "burst" in c or "drop" in c])


@query(f"""{WITH}, {PANEL}, fn AS (SELECT market, ticker, n.* FROM news n JOIN firm ON s_suppkey - 1 = doc_id % (SELECT count(*) FROM firm)),
a AS (SELECT market, ticker, date, count(*) AS c, count(DISTINCT source) AS s, sum(length(title)) AS tl, sum(length(content)) AS cl, avg(length(title)) AS mt, avg(length(content)) AS mc, count(*) FILTER (title <> '') AS ta, count(*) FILTER (content <> '') AS ca FROM fn GROUP BY ALL),
p AS (SELECT event_id, market, ticker, date, s_suppkey % 2 = 0 AS seen FROM panel JOIN firm USING (market, ticker)),
f AS (SELECT p.*, CASE WHEN seen THEN coalesce(c, 0) END AS c, CASE WHEN seen THEN coalesce(s, 0) END AS s, CASE WHEN seen THEN coalesce(tl, 0) END AS tl, CASE WHEN seen THEN coalesce(cl, 0) END AS cl, mt, mc, CASE WHEN seen THEN coalesce(ta, 0) END AS ta, CASE WHEN seen THEN coalesce(ca, 0) END AS ca FROM p LEFT JOIN a USING (market, ticker, date))
SELECT event_id, market, ticker, date, c AS source_news_count, s AS source_count, tl::BIGINT AS title_char_count, cl::BIGINT AS content_char_count, round(mt, 6) AS avg_title_length, round(mc, 6) AS avg_content_length, ta AS title_available_count, ca AS content_available_count,
(sum(c) OVER w)::BIGINT AS event_source_news_count, count(*) FILTER (c > 0) OVER w AS event_source_active_day_count, (NOT seen)::INTEGER AS source_unavailable_flag, (seen AND coalesce(c, 0) = 0)::INTEGER AS source_available_zero_news_flag, (NOT seen OR c = 0)::INTEGER AS source_news_missing_flag
FROM f WINDOW w AS (PARTITION BY event_id, market, ticker)""")
def a15_news_structure(spark, sf):
    days = dense(spark, sf).select(*KEY, "date")
    news = days.join(firm_news(spark, sf), ["market", "ticker", "date"])
    covered = S.firms(spark, sf).where(F.col("s_suppkey") % 2 == 0)
    return r6(attention.news_structure(news, days, covered), "avg_title_length", "avg_content_length")


# ---- reports


@query(f"""{WITH}, b AS (SELECT market, ticker, {pick_sql(WORDS, 8)} AS company_name, 'e' || (doc_id % 4 + 1)::VARCHAR AS event_id, source AS alias_source, (length(content) > 3000)::INTEGER AS has_news FROM news JOIN firm ON s_suppkey - 1 = doc_id % (SELECT count(*) FROM firm)),
n AS (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY c DESC, company_name) AS r FROM (SELECT market, ticker, company_name, count(*) AS c FROM b GROUP BY ALL))
SELECT market, ticker, market || ':' || ticker AS company_id, any_value(n.company_name) AS company_name, array_to_string(list_sort(list(DISTINCT event_id)), ';') AS events, array_to_string(list_sort(list(DISTINCT alias_source)), ';') AS alias_sources,
CASE WHEN max(has_news) > 0 THEN 'source_covered' ELSE 'source_not_covered' END AS coverage FROM b JOIN n USING (market, ticker) WHERE r = 1 GROUP BY market, ticker""")
def a16_company_registry(spark, sf):
    rows = firm_news(spark, sf).select("market", "ticker", pick(WORDS, 8).alias("company_name"), F.concat(F.lit("e"), (F.col("doc_id") % 4 + 1).cast("string")).alias("event_id"), F.col("source").alias("alias_source"), (F.char_length("content") > 3000).cast("int").alias("has_news"))
    return reports.company_registry(rows)


@query(f"""{WITH}, b AS (SELECT source, 'e' || (doc_id % 4 + 1)::VARCHAR AS event_id, lang AS file, date, ([ 'ok', 'needs_attention', 'exclude_candidate' ])[doc_id % 3 + 1] AS risk FROM news)
SELECT source, event_id, count(DISTINCT file) AS files, count(*) AS rows, count(*) FILTER (risk <> 'exclude_candidate') AS candidate_rows, count(*) FILTER (risk = 'ok') AS ok_rows, count(*) FILTER (risk = 'exclude_candidate') AS bad_rows, min(date) AS first_date, max(date) AS last_date FROM b GROUP BY ALL""")
def a17_source_inventory(spark, sf):
    rows = S.news(spark, sf).select("source", F.concat(F.lit("e"), (F.col("doc_id") % 4 + 1).cast("string")).alias("event_id"), F.col("lang").alias("file"), "date", pick(["ok", "needs_attention", "exclude_candidate"], 3).alias("risk"))
    return reports.source_inventory(rows)


@query("""WITH h AS (SELECT sha256(to_json({'conv_id': conv_id, 'role': role, 'text': text, 'turn': turn})::VARCHAR) AS s FROM conversations)
SELECT count(*) AS rows, sum(('0x' || substr(s, 1, 12))::UBIGINT)::VARCHAR AS hash_a, sum(('0x' || substr(s, 13, 12))::UBIGINT)::VARCHAR AS hash_b FROM h""")
def a19_fingerprint(spark, sf):
    out = reports.fingerprint(S.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("hash_a", "hash_b")})
