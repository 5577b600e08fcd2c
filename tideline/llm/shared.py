"""Written intermediate tables in the folder that all executors share.

An operator cuts its lineage by writing a table below ``spark.checkpoint.dir``
and reading it back, so a lost executor costs a reread and not a recomputation,
and values that depend on task placement (partition numbers, sampled range
bounds) are frozen once written.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Characters that separate words: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of a batch that goes to Python at once, about.
BATCH = "4m"


def release() -> None:
    """Give memory that a task has freed back to the system: Python workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary one; on a cluster that
    is an error, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return what was written."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long, null kept) and ``text`` (null as empty); all other columns go.

    Batches of texts for Python are bounded in bytes from here on.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def chosen_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` (as a struct ``row``) whose (``doc_id``, ``h``) ``chosen`` holds, with its other columns.

    ``h`` is the text's hash.  No column of ``docs`` meets one of ``chosen``, whatever it is called.
    """
    more = [c for c in chosen.columns if c not in ("doc_id", "h")]
    right = chosen.select(F.col("doc_id").alias("right_id"), F.col("h").alias("right_h"), *more)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    left = docs.select(row, F.col("doc_id").cast("long").alias("left_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("left_h"))
    on = F.col("left_id").eqNullSafe(F.col("right_id")) & (F.col("left_h") == F.col("right_h"))
    return left.join(right, on, "inner" if more else "left_semi").select("row", *more)


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (``doc_id``, ``h``) ``chosen`` holds."""
    return chosen_rows(docs, chosen.select("doc_id", "h")).select("row.*")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case; every other character stays as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def with_starts(df: DataFrame, group: list[str], value: str, start: str) -> DataFrame:
    """Turn running sums within partitions into running sums over the table.

    ``df`` is a written table with ``part`` (the range partition a row was in),
    ``value`` and ``local`` (sum of ``value`` over the rows of the same group
    that stand before it in its partition).  Partitions are in range order.  The
    sums of each (group, partition) are small; only they go through a window.
    """
    sums = df.groupBy(*group, "part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_before"))
    on = F.col("part") == F.col("_part")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    gone = ["_part", "_before", *[f"_{g}" for g in group]]
    return df.join(offsets, on).withColumn(start, (F.col("_before") + F.col("local")).cast("long")).drop(*gone)
