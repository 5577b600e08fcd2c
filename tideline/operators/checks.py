"""Validation: every rule is a table of violations; ``require_empty`` turns one into an error.

A violation table has the offending keys and a ``rule``.  Rules compose by union, so
one run reports all that is wrong with a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["event_id", "market", "ticker"]
DAILY_KEY = [*KEY, "date"]
GROUP = ["event_id", "market"]


class ValidationError(ValueError):
    """A table breaks a rule; the message has up to five examples."""


def examples_of(violations: DataFrame, n: int = 5) -> DataFrame:
    """The first violations in the order of their columns."""
    return violations.orderBy(*violations.columns).limit(n)


def require_empty(violations: DataFrame, what: str, examples: int = 5) -> None:
    found = examples_of(violations, examples).collect()
    if found:
        raise ValidationError(f"{what}: " + "; ".join(str(r.asDict()) for r in found))


def bad_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are null in a part, or occur more than once."""
    null = df.where(F.greatest(*[F.col(k).isNull() for k in key], F.lit(False))).select(*key, F.lit("null key").alias("rule"))
    again = df.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(*key, F.lit("repeated key").alias("rule"))
    return null.unionByName(again)


def as_flag(value: Column) -> Column:
    """true/1/yes and false/0/no in any case, and null as false; others give null."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(value.isNull(), False).when(text.isin("true", "1", "1.0", "yes"), True).when(text.isin("false", "0", "0.0", "no"), False)


def bad_flags(df: DataFrame, column: str, key: list[str]) -> DataFrame:
    return df.where(as_flag(F.col(column)).isNull()).select(*key, F.lit(f"{column} is no flag").alias("rule"))


def number(value: Column) -> Column:
    """A double; null where it cannot be read as one or is NaN."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x), x)


def base_labels(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The usable labels, and violations of the label contract.

    A materialised ``high_impact_label`` is refused outright: it depends on the split.
    """
    if "high_impact_label" in labels.columns:
        raise ValidationError("high_impact_label depends on the split; base labels hold returns only")
    typed = labels.select(*[F.col(k).cast("string").alias(k) for k in KEY], number(F.col("event_return")).alias("event_return"), as_flag(F.col("label_available_flag")).alias("label_available_flag"))
    no_return = typed.where(F.col("label_available_flag") & F.col("event_return").isNull()).select(*KEY, F.lit("available without a return").alias("rule"))
    wrong = bad_keys(typed, KEY).unionByName(bad_flags(labels, "label_available_flag", KEY)).unionByName(no_return)
    return typed.where("label_available_flag"), wrong


def prediction_table(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed predictions, and violations: scores must be finite, ``t1_score`` in 0..1."""
    extra = [c for c in ("fold_id",) if c in predictions.columns]
    typed = predictions.select(*extra, *[F.col(k).cast("string").alias(k) for k in KEY], number(F.col("t1_score")).alias("t1_score"), number(F.col("t2_prediction")).alias("t2_prediction"))
    inf = float("inf")
    bad = F.col("t1_score").isNull() | ~F.col("t1_score").between(0, 1) | F.col("t2_prediction").isNull() | (F.abs("t2_prediction") == inf)
    return typed, bad_keys(typed, [*extra, *KEY]).select(*KEY, "rule").unionByName(typed.where(bad).select(*KEY, F.lit("score out of range").alias("rule")))


def leaking_days(daily: DataFrame) -> DataFrame:
    """Daily inputs at or after their event's start."""
    return daily.where(F.col("date") >= F.col("event_start_date")).select(*DAILY_KEY, F.lit("not before the event").alias("rule"))


def bad_embeddings(embeddings: DataFrame, starts: DataFrame, width: int) -> DataFrame:
    """Embedding rows of another width, of an unknown event, or not before the event's start."""
    joined = embeddings.join(starts.select("event_id", F.col("event_start_date").alias("_start")), "event_id", "left")
    rule = (
        F.when(F.col("embedding_dim") != width, "another width")
        .when(F.col("_start").isNull(), "unknown event")
        .when(F.col("date") >= F.col("_start"), "not before the event")
    )
    return joined.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(*DAILY_KEY, "rule")


def bad_calendar(events: DataFrame) -> DataFrame:
    """Events given twice, or whose four dates are missing or decrease."""
    dates = ["pre_start_date", "event_start_date", "event_end_date", "post_end_date"]
    unordered = F.greatest(*[F.col(d).isNull() for d in dates], *[F.coalesce(F.col(a) > F.col(b), F.lit(True)) for a, b in zip(dates, dates[1:])])
    return bad_keys(events, ["event_id"]).unionByName(events.where(unordered).select("event_id", F.lit("dates not in order").alias("rule")))


def bad_companies(companies: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Companies of an unknown market, with an odd ticker, a membership that ends before it begins, or given twice.

    ``patterns`` gives each market's form of a ticker.
    """
    fits = F.lit(None).cast("boolean")
    for market, pattern in patterns.items():
        fits = F.when(F.col("market") == market, F.col("ticker").rlike(pattern)).otherwise(fits)
    rule = (
        F.when(~F.coalesce(F.col("market").isin(*patterns), F.lit(False)), "unknown market")
        .when(~F.coalesce(fits, F.lit(False)), "odd ticker")
        .when(F.col("member_from") > F.col("member_to"), "membership ends before it begins")
    )
    wrong = companies.withColumn("rule", rule).where(F.col("rule").isNotNull()).select("market", "ticker", "rule")
    return wrong.unionByName(bad_keys(companies, ["market", "ticker"]))


def bad_aliases(aliases: DataFrame, companies: DataFrame, usable: Column) -> DataFrame:
    """Explicit aliases of unknown companies, with a confidence outside 0..1, an inverted interval, or unusable."""
    known = companies.select("market", "ticker", F.lit(1).alias("_known")).distinct()
    rule = (
        F.when(F.col("_known").isNull(), "unknown company")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range")
        .when(F.col("valid_from") > F.col("valid_to"), "inverted interval")
        .when(~F.coalesce(usable, F.lit(False)), "unusable")
    )
    return aliases.join(known, ["market", "ticker"], "left").withColumn("rule", rule).where(F.col("rule").isNotNull()).select("market", "ticker", "alias", "rule")


def news_rule(ts: Column | str = "ts", content: Column | str = "content", start: Column | str = "window_start", end: Column | str = "window_end", announced: Column | str = "row_count", found: Column | str = "n_records") -> Column:
    """The rule that a landed record breaks, null for a sound one; columns as in ``bad_news``, or fields of an array's element."""
    ts, content, start, end, announced, found = (F.col(x) if isinstance(x, str) else x for x in (ts, content, start, end, announced, found))
    ts = F.trim(ts)
    when = ts.try_cast("timestamp_ntz")
    return (
        F.when(F.coalesce(ts, F.lit("")) == "", "no time")
        .when(F.coalesce(F.trim(content), F.lit("")) == "", "no content")
        .when(ts.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & ts.rlike(r"\d:\d"), "time with a zone")
        .when(when.isNull(), "no time")
        .when((when < start) | (when > end), "outside its window")
        .when(announced != found, "another number of rows")
    )


def bad_news(records: DataFrame) -> DataFrame:
    """Landed news without a time or content, with a zone in its time, or outside its pool's window.

    Rows have ``pool``, ``ts`` (text), ``content``, ``window_start``, ``window_end`` (timestamps),
    ``row_count`` and ``n_records`` (announced and found).
    """
    return records.withColumn("rule", news_rule()).where(F.col("rule").isNotNull()).select("pool", "ts", "rule")


def bad_prices(prices: DataFrame, tasks: DataFrame) -> DataFrame:
    """Landed prices without a task, in another currency than it says, or outside its window."""
    t = tasks.select("market", "ticker", F.col("currency").alias("_currency"), "window_start", "window_end")
    rule = (
        F.when(F.col("_currency").isNull(), "no task")
        .when(~F.coalesce(F.col("currency") == F.col("_currency"), F.lit(False)), "another currency")
        .when(~F.col("date").between(F.col("window_start"), F.col("window_end")), "outside its window")
    )
    return prices.join(t, ["market", "ticker"], "left").withColumn("rule", rule).where(F.col("rule").isNotNull()).select("market", "ticker", "date", "rule")


def disagreeing_prices(prices: DataFrame, key: list[str] = ["market", "ticker", "date"]) -> DataFrame:  # noqa: B006
    """Keys that overlapping windows give different values for."""
    rest = F.struct(*[c for c in sorted(prices.columns) if c not in key])
    return prices.groupBy(*key).agg(F.count_distinct(rest).alias("versions")).where(F.col("versions") > 1)


def uncovered_days(days: DataFrame, pool: DataFrame) -> DataFrame:
    """Event days that no landed pool covers."""
    return days.select("date").distinct().join(pool.select("date"), "date", "left_anti")


def audit(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose row count or sha256 differs from the manifest, or that only one side has."""
    left = counts.select("path", F.col("rows").alias("found_rows"), F.col("sha256").alias("found_sha256"))
    right = manifest.select("path", F.col("rows").alias("listed_rows"), F.col("sha256").alias("listed_sha256"))
    both = left.join(right, "path", "full")
    same = F.col("found_rows").eqNullSafe(F.col("listed_rows")) & F.col("found_sha256").eqNullSafe(F.col("listed_sha256"))
    return both.where(~same)


def unmatched(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner: labelled samples without features, test rows without predictions."""
    return left.join(right.select(*key).distinct(), key, "left_anti").select(*key)


def shared_test_rows(folds: DataFrame) -> DataFrame:
    """Samples that are test rows in more than one fold."""
    return folds.where(F.col("part") == "test").groupBy(*KEY).agg(F.count_distinct("fold_id").alias("folds")).where(F.col("folds") > 1)


def empty_parts(folds: DataFrame, quantile: float) -> DataFrame:
    """Folds without train or test rows, or without a value to take the threshold from."""
    if not 0 < quantile < 1:
        raise ValidationError("the quantile lies strictly between 0 and 1")
    n = folds.groupBy("fold_id").agg(*[F.count_if(F.col("part") == p).alias(p) for p in ("train", "test")], F.count_if((F.col("part") == "train") & F.col("event_return").isNotNull()).alias("values"))
    return n.where((F.col("train") == 0) | (F.col("test") == 0) | (F.col("values") == 0))
