"""Exact quantiles of groups of any size: counts, then one pass over what is near.

A sketch brackets the quantile; one aggregate counts what lies below the bracket and the
distinct values in it; ranks come from sums over ranges of those (``cumulative``), so no
task holds a group.  A bracket that misses, which the sketch's bound makes rare, is
opened to the whole group, so the result is exact whatever the sketch says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import cumulative
from .tables import written

#: Ranks of the sketch are off by one in so many rows at most; groups of no more rows have no narrower bracket.
ACCURACY = 10_000


def quantiles(rows: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """Per group ``by`` its linearly interpolated quantile ``quantile`` of ``value`` (a double; nulls do not count, groups without values have no row)."""
    some = rows.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    near = [max(0.0, q - 3 / ACCURACY), min(1.0, q + 3 / ACCURACY)]
    sketch = some.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", near, ACCURACY).alias("_near"))
    small = F.col("_n") <= ACCURACY
    bracket = sketch.withColumns({"_low": F.when(small, F.col("_least")).otherwise(F.col("_near")[0]), "_high": F.when(small, F.col("_most")).otherwise(F.col("_near")[1])})
    bracket = written(bracket.drop("_near"), "brackets")
    found = written(within(some, bracket, by, q), "quantiles")
    missed = found.where(F.col("quantile").isNull()).select(*by)
    if not missed.isEmpty():
        wide = bracket.join(missed, by, "left_semi").withColumns({"_low": F.col("_least"), "_high": F.col("_most")})
        found = found.where(F.col("quantile").isNotNull()).unionByName(within(some, wide, by, q))
    return found


def within(some: DataFrame, bracket: DataFrame, by: list[str], q: float) -> DataFrame:
    """The quantile of each group of ``bracket``, null where it is not between ``_low`` and ``_high``."""
    inside = F.when(F.col("_v") >= F.col("_low"), F.col("_v"))  # null, which sorts first: all that is below
    counts = some.join(bracket.select(*by, "_low", "_high"), by).where(F.col("_v") <= F.col("_high")).groupBy(*by, inside.alias("_v")).agg(F.count("*").alias("_c"))
    ranked = cumulative(counts, by, "_v", ["_c"]).join(bracket.select(*by, "_n"), by)
    place = F.lit(q) * (F.col("_n") - 1)
    at = lambda rank: F.max(F.when((F.col("_c_below") <= rank) & (rank < F.col("_c_below") + F.col("_c")), F.col("_v")))
    ends = ranked.groupBy(*by).agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"), F.max(place - F.floor(place)).alias("_t"))
    return ends.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias("quantile"))
