"""Scores and classes of news candidates, as column expressions; the alignment in steps over a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C
from .text import compact_alias, compact_plain, filled, normalize_article, normalize_text, normalize_url


def any_of(text: Column, words: list[str]) -> Column:
    """Whether ``text`` has one of the words; a handful of substring tests."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def lookup(value: Column, table: dict[str, float], default: Column | float) -> Column:
    out = default if isinstance(default, Column) else F.lit(default)
    for key, x in table.items():
        out = F.when(value == key, F.lit(x)).otherwise(out)
    return out


def name_variants(cleaned: Column, ticker: Column) -> Column:
    """The cleaned name, the name without stopwords (two characters at least), the ticker; sorted."""
    stripped = F.trim(reduce(lambda t, w: F.replace(t, F.lit(w), F.lit("")), C.NAME_STOPWORDS, cleaned))
    kept = F.array(F.nullif(cleaned, F.lit("")), F.when(F.char_length(compact_plain(stripped)) >= 2, stripped), F.nullif(filled(ticker), F.lit("")))
    return F.array_sort(F.array_distinct(F.array_compact(kept)))


def source_priority(source_type: Column, source_name: Column) -> Column:
    name = F.lower(normalize_article(source_name))
    boosts = [F.when(name.contains(part), F.lit(x)).otherwise(0.0) for part, x in C.SOURCE_NAME_BOOST.items()]
    return reduce(lambda a, b: a + b, boosts, lookup(source_type, C.SOURCE_PRIORITY, 10.0))


def with_compact_forms(rows: DataFrame) -> DataFrame:
    """Texts with what ``with_alignment`` reads of their normalised ``title`` and ``content`` and their ``company_name``.

    These are passes over whole texts: for a text with several companies they belong before the join with these.
    """
    return rows.withColumns({"title_compact": compact_plain(F.col("title")), "content_compact": compact_plain(F.col("content")), "clean_name": normalize_article(F.col("company_name"))})


def with_alignment(rows: DataFrame, hit: Column | None = None) -> DataFrame:
    """``alignment_score``, 0 to 100, that an article is about a company, and the ``reasons``.

    ``rows`` has ``ticker``, ``source_type`` and the columns of ``with_compact_forms``; ``hit`` is the best alias hit of the
    company (``location``, ``alias``, ``alias_type``, ``score``, ``ambiguous``; null for none).  Each test of a text is a
    column of its own, so it is made once a row however often score and reasons name it.
    """
    t, c, code = F.col("title_compact"), F.col("content_compact"), F.col("_code")
    forms = rows.withColumns({"_code": F.lower(filled(F.col("ticker"))), "_names": F.transform(name_variants(F.col("clean_name"), F.col("ticker")), compact_plain)})
    variants = forms.withColumn("_names", F.filter("_names", lambda v: (v != "") & (v != code)))
    in_any = lambda text: F.exists("_names", lambda v: text.contains(v))
    tested = variants.withColumns({"_code_title": (code != "") & t.contains(code), "_code_content": (code != "") & c.contains(code), "_name_title": in_any(t), "_name_content": in_any(c)})
    direct = F.coalesce(F.col("source_type").isin(*C.DIRECT_SOURCES), F.lit(False))
    parts = [
        (direct, 45.0, "direct_company_source"),
        (F.col("_code_title"), 20.0, "ticker_in_title"),
        (~F.col("_code_title") & F.col("_code_content"), 10.0, "ticker_in_content"),
        (F.col("_name_title"), 25.0, "name_in_title"),
        (~F.col("_name_title") & F.col("_name_content"), 12.0, "name_in_content"),
    ]
    points = [F.when(p, F.lit(x)).otherwise(0.0) for p, x, _ in parts]
    of_alias = F.lit(0.0) if hit is None else F.coalesce(hit["score"], F.lit(0.0))
    score = reduce(lambda a, b: a + b, [*points[:3], of_alias, *points[3:]])
    by_alias = []
    if hit is not None:
        named = F.concat(F.lit("alias_"), F.concat_ws(":", hit["location"], hit["alias"], hit["alias_type"]), F.lit(":score="), hit["score"].cast("string"))
        by_alias = [F.when(hit.isNotNull(), named), F.when(hit["ambiguous"], F.lit("alias_ambiguous_downweighted"))]
    reasons = F.array_compact(F.array(*[F.when(p, F.lit(r)) for p, _, r in parts[:3]], *by_alias, *[F.when(p, F.lit(r)) for p, _, r in parts[3:]], F.when(~direct & (score == 0), F.lit("no_alignment_signal"))))
    out = tested.withColumns({"alignment_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), "reasons": reasons})
    return out.drop("_code", "_names", "_code_title", "_code_content", "_name_title", "_name_content")


def quality(status: Column, content: Column, title: Column, source: Column, url: Column, time: Column, mode: Column) -> Column:
    some = lambda x, points: F.when(filled(x) != "", F.lit(points)).otherwise(0.0)
    base = lookup(F.lower(normalize_article(status)), C.STATUS_SCORE, F.when(filled(content) != "", 6.0).otherwise(0.0))
    length = F.least(F.char_length(filled(content)) / 220.0, F.lit(24.0))
    return base + length + some(title, 6.0) + some(source, 3.0) + some(url, 4.0) + some(time, 2.0) + F.when(normalize_article(mode) == "markdown", 2.0).otherwise(0.0)


def representative(alignment: Column, quality: Column, priority: Column, duplicates: Column) -> Column:
    return alignment + quality + priority + 3.0 * F.least(F.greatest(duplicates - 1, F.lit(0)), F.lit(3))


def content_or_summary(article: Column, summary: Column, title: Column) -> Column:
    """The article's text; else its summary, unless that repeats the title or has under 80 characters.  All normalised."""
    t, s = compact_plain(title), compact_plain(summary)
    repeats = (t != "") & (t.contains(s) | s.contains(t))
    return F.when(article != "", article).when((s == "") | repeats | (F.char_length(summary) < 80), "").otherwise(summary)


def content_class(title: Column, body: Column) -> Column:
    n, some = F.char_length(body), filled(title) != ""
    return F.when(n >= 200, "full_text").when(n >= 20, "short_text").when(some, "title_only").otherwise("missing_content")


def event_relevance(event_id: Column, source_group: Column, title: Column, body: Column, scan: int | None = None, events: dict[str, list[str]] | None = None, market: list[str] | None = None) -> Column:
    """By keywords in the compact title and body (its first ``scan`` characters, if given)."""
    text = compact_alias(F.concat_ws(" ", title, body if scan is None else F.left(body, F.lit(scan))))
    direct = F.lit(False)
    for event, words in (C.EVENT_KEYWORDS if events is None else events).items():
        direct = direct | ((event_id == event) & any_of(text, words))
    context = any_of(text, C.MARKET_KEYWORDS if market is None else market)
    return F.when(direct, "event_direct").when(context, "market_impact_context").when(source_group == "supplement_announcements", "non_event_corporate_disclosure").otherwise("event_unrelated")


def risk(source_group: Column, availability: Column, strength: Column, reason: Column, relevance: Column) -> Column:
    attention = (
        availability.isin("missing_content", "title_only")
        | (strength == "sector_or_market_context")
        | relevance.isin("event_unrelated", "non_event_corporate_disclosure")
        | ((source_group != "main_tushare") & (availability != "full_text"))
    )
    return F.when((strength == "weak_or_ambiguous") | (reason == "source_name_collision"), "exclude_candidate").when(attention, "needs_attention").otherwise("ok")


def match_strength(location: Column) -> Column:
    return F.when(location == "title", "strong").when(location == "content", "medium").otherwise("weak_or_ambiguous")


def dedupe_key(url: Column, title: Column, content: Column, date: Column, article: Column) -> Column:
    """By URL, else title and day, else the content's beginning and day, else the article's id."""
    u, t, c = normalize_url(url), compact_plain(title), compact_plain(F.left(content, F.lit(400)))
    day = date.cast("string")
    return F.when(u != "", F.concat(F.lit("url::"), u)).when(t != "", F.concat_ws("::", F.lit("title"), t, day)).when(c != "", F.concat_ws("::", F.lit("content"), c, day)).otherwise(F.concat(F.lit("id::"), article))


# ---- aliases


def without_suffix(name: Column) -> Column:
    """Legal suffixes removed, in order and again until none is left, as long as two characters remain."""

    def once(out: Column) -> Column:
        for suffix in C.COMPANY_SUFFIXES:
            out = F.rtrim(F.regexp_replace(out, f"(?s)(?<=.{{2}}){suffix}$", ""))
        return out

    # A pass that changes the name takes two characters at least, so half its length is passes enough.
    whole = normalize_text(name)
    ends = whole.rlike("(?:" + "|".join(C.COMPANY_SUFFIXES) + ")$")
    passes = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.char_length(whole) / 2).cast("int")))
    return F.when(ends, F.aggregate(passes, whole, lambda out, _: once(out))).otherwise(whole)


def alias_values(raw: Column) -> Column:
    return F.filter(F.transform(F.split(filled(raw), "[|;；,，、/]+"), lambda x: F.trim(F.regexp_replace(x, r"(?U)[\s\x{1C}-\x{1F}]+", " "))), lambda x: x != "")


def alias_type(alias: Column, name: Column, ticker: Column, code: Column) -> Column:
    a = normalize_text(alias)
    return F.when((a == ticker) | (F.lower(a) == F.lower(code)), "ticker").when(a == normalize_text(name), "legal_or_stock_name").when(a.rlike("[A-Za-z]"), "english_or_code_alias").otherwise("short_name")


def alias_confidence(compact: Column, kind: Column) -> Column:
    n = F.char_length(compact)
    return lookup(kind, C.ALIAS_CONFIDENCE, F.when(n >= 4, 0.82).when(n == 3, 0.70).otherwise(0.45))


def usable_alias(compact: Column) -> Column:
    return ~compact.rlike(r"^(?U)\d+$") & (F.char_length(compact) >= 2) & ~compact.isin(*C.AMBIGUOUS_ALIASES)


# ---- registry


def parse_date(value: Column) -> Column:
    """ISO dates and times (``Z`` allowed) and yyyyMMdd; empty or unreadable gives null."""
    v = F.trim(filled(value))
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), v.substr(1, 10).try_cast("date"))
    return F.coalesce(iso, F.when(v.rlike(r"^\d{8}$"), F.try_to_date(v, "yyyyMMdd")))


def price_symbol(market: Column, ticker: Column, exchange: Column) -> Column:
    """The chart vendor's symbol of a ticker."""
    mainland = F.when(exchange == "SH", ".SS").when(exchange == "SZ", ".SZ").otherwise(F.concat(F.lit("."), exchange))
    return (
        F.when(market == "SP500", F.replace(ticker, F.lit("."), F.lit("-")))
        .when(market == "HSTECH", F.concat(F.lpad(F.ltrim(ticker, F.lit("0")), 4, "0"), F.lit(".HK")))
        .when(market == "Nikkei225", F.concat(ticker, F.lit(".T")))
        .when(market == "CSI300", F.concat(ticker, mainland))
    )


def market_currency(market: Column, given: Column) -> Column:
    out = F.lit(None).cast("string")
    for m, c in C.CURRENCY.items():
        out = F.when(market == m, c).otherwise(out)
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), out)
