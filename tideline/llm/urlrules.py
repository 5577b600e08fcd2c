"""URL filtering by association rules, in DataFrame operations only.

Given rules (a host and a path prefix) judge some pages.  Their verdicts are the
labels: the tokens of a judged URL and its verdict form a transaction, Spark's
FP-growth mines frequent combinations, and rules ``tokens -> verdict`` are kept
that reach ``confidence`` and that no rule with fewer of the tokens equals.  The
other pages are matched by an inverted index: each mined rule stands under one of
its tokens (the rarest), a page looks its tokens up and keeps the rules whose
tokens it has all of.  The most confident decides (then the one with the most
support, then with more tokens, then by name); a page that none matches is allowed.

Tokens that the same judged pages hold are one item: they would only multiply the
combinations (all subsets of k tokens that always occur together are frequent), and a
rule that needs one of them holds for any.  A page has the item if it has one of them.

Tokens are the host's labels with their place from the end, host suffixes, words
of the path with digits made ``#``, and names of query parameters.

Cases: a null url or one without ``://`` has an empty host and path, no rule and no
tokens, and is allowed; null ``page_id`` and repeated rows are judged like others (repeated
pages count again as support); without judged pages nothing is mined; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import UPPER, keep

#: Mined rules up to this number are broadcast; more are joined by shuffle.
SMALL = 20_000
VERDICT = "verdict="


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule whose host is the url's or above it, and whose path begins its path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    places = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), x))
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda n: F.concat(F.lit("under:"), F.array_join(F.reverse(F.slice(labels, 1, n)), ".")))
    words = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "[/._-]+"), lambda x: x != "")
    steps = F.transform(words, lambda x: F.concat(F.lit("path:"), x))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    return F.array_distinct(F.concat(places, F.when(F.size(labels) >= 2, above).otherwise(F.array().cast("array<string>")), steps, names))


def items_of(judged: DataFrame) -> DataFrame:
    """``token`` and its ``item``: the first of the tokens that stand in the same rows of ``judged`` (different ``tokens``)."""
    # Two sums of 64-bit hashes stand for the set of a token's rows.
    rows = judged.select(F.xxhash64("tokens").alias("one"), F.xxhash64(F.lit("two"), "tokens").alias("two"), F.explode("tokens").alias("token"))
    where = rows.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
    first = where.groupBy("n", "one", "two").agg(F.min("token").alias("item"))
    return keep(where.join(first, ["n", "one", "two"]).select("token", "item"), "items")


def with_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows with an array ``tokens``, each with its ``items`` (those without any are left out)."""
    pairs = rows.select("tokens", F.explode("tokens").alias("token")).join(items, "token")
    return pairs.groupBy("tokens").agg(F.sort_array(F.collect_set("item")).alias("items"))


def mine(judged: DataFrame, support: float, confidence: float) -> DataFrame:
    """Rules (``need``, ``verdict``, ``confidence``, ``support``) from rows with ``items`` and ``verdict``."""
    baskets = judged.select(F.concat("items", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(VERDICT) & ~F.exists("antecedent", lambda x: x.startswith(VERDICT)))
    rules = rules.select(F.array_sort("antecedent").alias("need"), F.substring(F.element_at("consequent", 1), len(VERDICT) + 1, 100).alias("verdict"), "confidence", "support")
    rules = keep(rules, "rules")
    # A rule goes if taking one token away leaves a rule for the verdict that is as sure.
    shorter = rules.where(F.size("need") > 1).select("need", "verdict", "confidence", F.explode("need").alias("gone"))
    shorter = shorter.select("need", "verdict", "confidence", F.array_except("need", F.array("gone")).alias("less"))
    general = rules.select(F.col("need").alias("less"), "verdict", F.col("confidence").alias("as_sure"))
    needless = shorter.join(general, ["less", "verdict"]).where(F.col("as_sure") >= F.col("confidence")).select("need", "verdict").distinct()
    return rules.join(needless, ["need", "verdict"], "left_anti")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], support: float = 0.01, confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """Per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined`` (the mined rule that decided, else null).

    ``rules`` are (verdict, host, path prefix).
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("given", given_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    judged = rows.where(F.col("given").isNotNull()).select("tokens", F.col("given.verdict").alias("verdict"))
    shapes = judged.select("tokens").distinct()
    items = items_of(shapes)
    baskets = judged.join(keep(with_items(shapes, items), "baskets"), "tokens").select("items", "verdict")
    mined = keep(mine(baskets, support, confidence), "mined")
    # The inverted index: a mined rule stands under its rarest token among the mined rules.
    spread = mined.select("*", F.explode("need").alias("token"))
    often = spread.groupBy("token").agg(F.count("*").alias("n"))
    index = spread.join(often, "token").groupBy("need", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = F.broadcast(index) if mined.count() <= SMALL else index
    # Distinct token sets are looked up once; pages of one shape share the answer.
    open_ = with_items(rows.where(F.col("given").isNull() & (F.size("tokens") > 0)).select("tokens").distinct(), items)
    hits = open_.select("tokens", "items", F.explode("items").alias("token")).join(index, "token").where(F.size(F.array_except("need", "items")) == 0)
    best = keep(hits.groupBy("tokens").agg(F.max_by(F.struct("verdict", "need"), F.struct("confidence", "support", F.size("need"), "need", "verdict")).alias("best")), "best")
    settled = rows.where(F.col("given").isNotNull() | (F.size("tokens") == 0)).withColumn("best", F.lit(None).cast("struct<verdict:string,need:array<string>>"))
    looked = rows.where(F.col("given").isNull() & (F.size("tokens") > 0)).join(best, "tokens", "left").select(*settled.columns)
    return settled.unionByName(looked).select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "best.verdict", F.lit(default)).alias("verdict"),
        F.array_join("best.need", " ").alias("mined"),
    )
