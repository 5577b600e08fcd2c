"""Exact deduplication by sorting contents.

Normalised texts are range-partitioned by sampled splitters and sorted inside
each partition by Spark's spilling sort, which puts equal texts side by side; a
pass over neighbours compares them in full and closes a run where they differ.

The splitters are short: the first characters, a 64-bit hash, the row's id and its
place in the input.  The hash parts texts with a common beginning; the id and the
place spread the copies of one text over as many partitions as their number asks for,
equal or null ids too.  A run that stands at a
partition's edge may go on in the next one, so runs whose splitter key equals
that of the first or last row carry their text along once and are joined, in
full, with each other (at most a few rows for each partition).

Cases: null text counts as empty; null ``doc_id`` is smaller than any other and
its ``keep_id`` is null only if its whole group has null ids; of rows with equal
text and ``doc_id`` one is kept; an empty table gives no rows; very long texts
are compared whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, keep, release, texts

#: Characters of the text in a splitter.
HEAD = 48


OUT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("last_id", pa.int64()), ("size", pa.int64()), ("tail", pa.bool_()), ("sha", pa.binary()), ("edge_text", pa.string())])


def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts among sorted rows: each row with its run's last id, size and digest.

    Runs are held until the hash changes, so that a run is known to be at an edge
    (its hash is the partition's first or last) when its rows leave.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first = h = text = None
    runs: list[tuple[str, list]] = []  # of the present hash
    rows: list[tuple] = []
    n = -1

    def leave(edge: bool) -> None:
        for k, (t, ids) in enumerate(runs, n - len(runs) + 1):
            raw = t.encode("utf-8", "surrogatepass")
            sha, last, size = hashlib.sha256(raw).digest(), ids[-1][0], len(ids)
            rows.extend((i, x, part, k, last, size, j == size, sha, t if edge and j == 1 else None) for j, (i, x) in enumerate(ids, 1))

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)

    for batch in batches:
        for i, x, t, k in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "norm", "h"))):
            if k != h or n < 0:
                leave(h == first)
                runs, h, text = [], k, None
                first = k if n < 0 else first
            if t != text:
                n, text = n + 1, t
                runs.append((t, []))
            runs[-1][1].append((i, x))
        if rows:
            yield batch_of()
            rows.clear()
    leave(True)
    if rows:
        yield batch_of()
    release()


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of the normalised text, and ``h``, a hash of the text as it is.

    ``kept`` marks one row of each group, of those with its largest ``doc_id``.
    """
    keyed = texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), ascii_lower(F.col("text")).alias("norm"))
    keyed = keyed.withColumns({"head": F.substring("norm", 1, HEAD), "h": F.xxhash64("norm"), "place": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange("head", "h", "doc_id", "place").sortWithinPartitions("head", "h", "norm", "doc_id")
    found = ranged.select("doc_id", "text_hash", "norm", "h").mapInArrow(find_runs, "doc_id long, text_hash long, part int, run long, last_id long, size long, tail boolean, sha binary, edge_text string")
    runs = keep(found, "runs")
    at = F.struct("last_id", "part", "run")
    edges = runs.where(F.col("edge_text").isNotNull())
    joined = edges.groupBy("edge_text").agg(F.sum("size").alias("all_size"), F.max(at).alias("end"), F.collect_list(F.struct("part", "run")).alias("of"))  # a few runs for each partition
    joined = joined.where(F.size("of") > 1).select("all_size", "end", F.explode("of").alias("of")).select("all_size", "end", "of.part", "of.run")
    whole = runs.drop("edge_text").join(joined, ["part", "run"], "left")
    ends_here = F.col("end").isNull() | ((F.col("end.part") == F.col("part")) & (F.col("end.run") == F.col("run")))
    return whole.select(
        "doc_id",
        F.when(F.col("end").isNull(), F.col("last_id")).otherwise(F.col("end.last_id")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("tail") & ends_here).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("text_hash").alias("h"),
    )
