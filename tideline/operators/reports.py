"""Registries, inventories, fingerprints and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def company_registry(rows: DataFrame) -> DataFrame:
    """One row per company: its most common name (ties by text), events seen, alias sources, and whether a source covers it.

    ``rows`` has ``market``, ``ticker``, ``company_name``, ``event_id``, ``alias_source``, ``has_news``.
    """
    names = rows.groupBy("market", "ticker", "company_name").agg(F.count("*").alias("n"))
    top = names.withColumn("_r", F.row_number().over(W.partitionBy("market", "ticker").orderBy(F.desc("n"), "company_name"))).where(F.col("_r") == 1)
    lists = rows.groupBy("market", "ticker").agg(
        F.array_join(F.sort_array(F.collect_set("event_id")), ";").alias("events"),
        F.array_join(F.sort_array(F.collect_set("alias_source")), ";").alias("alias_sources"),
        F.when(F.max("has_news") > 0, "source_covered").otherwise("source_not_covered").alias("coverage"),
    )
    return lists.join(top.select("market", "ticker", "company_name"), ["market", "ticker"]).withColumn("company_id", F.concat_ws(":", "market", "ticker"))


def source_inventory(rows: DataFrame) -> DataFrame:
    """Per source and event: files, rows, candidate, ok and bad rows, first and last day.

    ``rows`` has ``source``, ``event_id``, ``file``, ``date``, ``risk``.
    """
    return rows.groupBy("source", "event_id").agg(
        F.count_distinct("file").alias("files"), F.count("*").alias("rows"), F.count_if(F.col("risk") != "exclude_candidate").alias("candidate_rows"),
        F.count_if(F.col("risk") == "ok").alias("ok_rows"), F.count_if(F.col("risk") == "exclude_candidate").alias("bad_rows"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def row_hashes(df: DataFrame) -> list[Column]:
    """Sums of two parts of each row's sha256, over decimals, so that repeated rows count."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    part = lambda lo: F.conv(F.substring(row, lo, 12), 16, 10).cast("decimal(20,0)")
    return [F.sum(part(1)).alias("hash_a"), F.sum(part(13)).alias("hash_b")]


def fingerprints(df: DataFrame, by: str) -> DataFrame:
    """For each value of ``by`` (as ``path``): rows, and a sha256 of the sums of its rows' hashes."""
    out = df.groupBy(F.col(by).cast("string").alias("path")).agg(F.count("*").alias("rows"), *row_hashes(df.drop(by)))
    return out.select("path", "rows", F.sha2(F.concat_ws(":", "hash_a", "hash_b").cast("binary"), 256).alias("sha256"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows, and a hash of the content that does not depend on order; one aggregate, no sort."""
    return df.agg(F.count("*").alias("rows"), *row_hashes(df))


def stale(df: DataFrame, stored: dict) -> bool:
    """Whether a table is no longer what its stored fingerprint says."""
    return fingerprint(df).first().asDict() != stored


def file_states(spark: SparkSession, path: str, by: str) -> DataFrame:
    """Of a table partitioned by ``by`` each partition's files as one digest (``state``): names, sizes and times, no content."""
    rows = spark.read.parquet(path).select(F.col(by).cast("string").alias("path"), "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = rows.distinct()
    return files.groupBy("path").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("file_path", "file_size", "file_modification_time")))), 256).alias("state"))


def partition_fingerprints(spark: SparkSession, path: str, by: str, stored: DataFrame | None = None) -> DataFrame:
    """Per partition ``rows`` and the sums of its rows' hashes, its files' ``state``, and whether it was ``read``.

    Sums add up, so with what an earlier call has ``stored`` only partitions whose files changed are read; those that are
    gone drop out.
    """
    now = file_states(spark, path, by)
    if stored is None:
        changed, same = now.select("path"), None
    else:
        same = stored.join(now, ["path", "state"], "left_semi").withColumn("read", F.lit(False))
        changed = now.join(stored, ["path", "state"], "left_anti").select("path")
    names = [r["path"] for r in changed.collect()]  # partitions' names, by which the others are pruned
    table = spark.read.parquet(path)
    own = F.col(by).cast("string")
    some = table.where(own.isin([n for n in names if n is not None]) | (own.isNull() if None in names else F.lit(False)))
    fresh = some.groupBy(own.alias("path")).agg(F.count("*").alias("rows"), *row_hashes(table.drop(by)))
    fresh = fresh.withColumn("_p", F.col("path")).join(now.withColumnRenamed("path", "_q"), F.col("_p").eqNullSafe(F.col("_q"))).select("path", "rows", "hash_a", "hash_b", "state", F.lit(True).alias("read"))
    return fresh if same is None else fresh.unionByName(same.select(fresh.columns))


def total_fingerprint(parts: DataFrame) -> DataFrame:
    """The table's fingerprint from its partitions'."""
    return parts.agg(F.sum("rows").alias("rows"), F.sum("hash_a").alias("hash_a"), F.sum("hash_b").alias("hash_b"))


def fold_summary(frames: DataFrame, features: int, models: str) -> DataFrame:
    """Per fold the rows of each part, the threshold, and what was fitted."""
    n = frames.groupBy("fold_id").agg(*[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("train", "validation", "test")], F.max("threshold").alias("threshold"))
    return n.withColumns({"n_features": F.lit(features), "models": F.lit(models)})
