"""Written intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary one; on a cluster it is
    an error, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """The table written as Parquet and read back: computed once, and a lost executor costs a reread.

    ``spread``: in a file for each core at least.  Small tables otherwise become one file, and each of the many passes of a fit one task.
    """
    path = shared_path(df.sparkSession, name)
    if spread:
        df = df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
