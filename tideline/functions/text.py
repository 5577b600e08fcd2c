"""Column expressions over news text.  Each expects a string column and treats null as empty."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, and the four separators that only some engines count.
SPACE = r"(?U)[\s\x{1C}-\x{1F}]+"
CJK = "[\\u4e00-\\u9fff]"
#: What an alias is stripped of: dashes, white space, dots, commas, brackets, slashes.
ALIAS_GAPS = r"(?U)[-\s\x{1C}-\x{1F}·・.。．,，、()（）\\/]+"


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape)


def _is_mojibake(t: str) -> bool:
    high = sum("\x80" <= c <= "\xff" for c in t)
    return high >= 4 and not any("一" <= c <= "鿿" for c in t) and high / len(t) >= 0.15


@F.pandas_udf(T.StringType())
def _repaired(text: pd.Series) -> pd.Series:
    def once(t: str) -> str:
        again = t.encode("latin-1", "ignore").decode("utf-8", "ignore").strip()
        return again if any("一" <= c <= "鿿" for c in again) else t

    def fix(t: str) -> str:
        for _ in range(2):
            new = once(t) if _is_mojibake(t) else t
            if new == t:
                break
            t = new
        return t

    return text.map(fix)


def filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def unescape(text: Column) -> Column:
    """HTML entities resolved.  All rows pass the Python stage, those without ``&`` as empty strings."""
    return F.when(text.contains("&"), _unescaped(F.when(text.contains("&"), text).otherwise(""))).otherwise(text)


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK))


def looks_mojibake(text: Column) -> Column:
    """Four or more characters U+0080 to U+00FF, 15 per cent of the text at least, and no CJK."""
    high = F.regexp_count(text, F.lit(r"[\x{80}-\x{FF}]"))
    return (high >= 4) & (cjk_count(text) == 0) & (high / F.greatest(F.char_length(text), F.lit(1)) >= 0.15)


def repair(text: Column) -> Column:
    odd = looks_mojibake(text)
    return F.when(odd, _repaired(F.when(odd, text).otherwise(""))).otherwise(text)


def squeezed(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_text(text: Column) -> Column:
    return squeezed(unescape(filled(text)))


def without_scripts(text: Column) -> Column:
    """``<script>`` elements dropped, other tags a space, white space collapsed."""
    return squeezed(F.regexp_replace(F.regexp_replace(text, r"(?is)<script\b[^>]*>.*?</script>", " "), r"(?s)<[^>]+>", " "))


def clean_content(text: Column) -> Column:
    return without_scripts(unescape(filled(text)))


def article_layout(text: Column) -> Column:
    """Line ends, ideographic and no-break spaces, tags, blanks and empty lines put in order."""
    t = F.translate(text, "\r　\xa0", "\n  ")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", ""), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^(?U)[\s\x{1C}-\x{1F}]+|(?U)[\s\x{1C}-\x{1F}]+$", "")


def normalize_article(text: Column) -> Column:
    return article_layout(repair(unescape(filled(text))))


def compact_text(text: Column) -> Column:
    """An article text without white space, in lower case."""
    return F.lower(F.regexp_replace(normalize_article(text), SPACE, ""))


def compact_plain(text: Column) -> Column:
    """``compact_text`` for a column that is already normal."""
    return F.lower(F.regexp_replace(text, SPACE, ""))


def compact_alias(text: Column) -> Column:
    """White space needs no collapsing first: the gaps hold all of it."""
    return F.lower(F.regexp_replace(unescape(filled(text)), ALIAS_GAPS, ""))


def first_filled(*texts: Column) -> Column:
    """The first that is not empty once normalised."""
    return F.coalesce(*[F.nullif(normalize_article(t), F.lit("")) for t in texts], F.lit(""))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no query or fragment, no slash at the end; what is no URL stays."""
    u = normalize_article(url)
    rest = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)", 3)
    whole = F.concat(F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), F.lower(F.regexp_extract(u, r"://([^/?#]+)", 1)), rest)
    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.regexp_replace(whole, "/+$", "")).otherwise(u)


def digest(*parts: Column) -> Column:
    """sha256 of the parts as a compact JSON array."""
    return F.sha2(F.to_json(F.array(*[filled(p) for p in parts])).cast("binary"), 256)


def article_id(day: Column, title: Column, content: Column) -> Column:
    return F.left(digest(day.cast("string"), title, content), F.lit(24))


def stable_hash(*parts: Column) -> Column:
    """16 hex digits of the sha1 of the non-empty trimmed parts."""
    kept = [F.nullif(F.trim(filled(p)), F.lit("")) for p in parts]
    return F.left(F.sha1(F.concat_ws("||", *kept).cast("binary")), F.lit(16))
