"""Mixing sources to target weights by blocks.

The words of each source, in ``doc_id`` order, are one stream, cut into blocks of
``block`` words.  The mix is a number of output shards made of block slots:

* targets per source come from the weights by raising a common level until the
  wanted total is met, no source above ``most`` times its size;
* each output shard has a region of every source's slots of its own, and takes as many of
  them as it draws: counts of the sources are multinomial, with means that follow the
  weights, moved on where a region has no more, so that the sums over the shards are the
  targets to within a block;
* a source has ``most`` slots for each block; every pass over its blocks is a pseudorandom
  permutation of the block indices (a Feistel network with cycle walking), so slot j
  stands for block ``permutation(j mod blocks)``, and the draw decides which blocks are taken;
* slots are grouped by (source, block) and joined with the documents' blocks.

Sources are a table like any other; the driver sees sums over them only.  Everything
is seeded: reruns agree.

Cases: null text has size 0 and takes nothing; a null source is a source of its
own, last in the order of weights; null or repeated ``doc_id`` rows are documents
of their own, ordered by text; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, keep, with_starts


#: Slots in a range that is permuted at once.
STEP = 4096
#: Sources up to this number are broadcast.
SMALL = 100_000


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``target`` for each row (``source_size``, ``weight``): shares by weight; none above ``most`` times its size, what is over reshared by weight."""
    size, cap = F.col("source_size"), F.col("source_size") * most
    wanted, level, closed = None, 0.0, -1
    while True:
        over = F.col("weight") * level > cap
        # One row of sums for each round; a round closes sources or is the last.
        r = sources.agg(F.sum(size).alias("size"), F.sum(F.when(over, cap)).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("closed")).first()
        wanted = share * (r["size"] or 0)
        if r["closed"] == closed or not r["weight"]:
            break
        closed, left, weight = r["closed"], wanted - (r["cap"] or 0.0), r["weight"]
        level = left / weight
    open_ = F.lit(left) * F.col("weight") / F.lit(float(weight)) if r["weight"] else cap
    return sources.withColumn("target", F.when(F.col("weight") * level > cap, cap).otherwise(open_).cast("double"))


def ranked(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources with their place ``k`` in code point order, null last, and their weight."""
    rows = sources.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    place = F.monotonically_increasing_id()
    rows = keep(rows.select("*", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("local"), F.lit(1).cast("long").alias("one")), "sources")
    rows = with_starts(rows, [], "one", "k").drop("part", "local", "one")
    return rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))


def counts(slots: int, rooms: np.ndarray, seed: list[int]) -> np.ndarray:
    """How many of a source's slots each output shard takes: a multinomial draw; what is above a shard's room goes to the next that have some."""
    drawn = np.random.default_rng(seed).multinomial(slots, rooms / max(1, rooms.sum()))
    out = np.minimum(drawn, rooms)
    free = rooms - out
    before = np.cumsum(free) - free
    return out + np.clip(slots - out.sum() - before, 0, free)


def slot_ranges(sources: DataFrame, shards: int, seed: int, most: float = 2.0) -> DataFrame:
    """The drawn slots of every (source, output shard) in ranges: ``k``, ``blocks``, ``lo``, ``hi``."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, slots, blocks in frame[["k", "slots", "blocks"]].itertuples(index=False):
                edges = np.arange(shards + 1) * int(blocks * most) // shards
                taken = counts(slots, np.diff(edges), [seed, k])
                yield pd.DataFrame({"k": k, "blocks": blocks, "first": edges[:-1], "end": edges[:-1] + taken})

    drawn = sources.where(F.col("slots") > 0).select("k", "slots", "blocks").mapInPandas(draw, "k long, blocks long, first long, end long").where(F.col("first") < F.col("end"))
    lo = F.explode(F.sequence("first", F.col("end") - 1, F.lit(STEP).cast("long"))).alias("lo")
    return drawn.select("k", "blocks", lo, "end").select("k", "blocks", "lo", F.least(F.col("lo") + STEP, "end").alias("hi"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: six Feistel rounds, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(6):
            h = (right + key[todo] + np.uint64(r * 0x9E3779B9)) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((h >> np.uint64(29)) & mask[todo])
        out[todo] = left << half[todo] | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def streams(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their source's number and their place in its stream; and a row for each source."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("h"), size.alias("size"), F.monotonically_increasing_id().alias("place"))
    out = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("h", pa.int64()), ("size", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), {}
        for batch in batches:
            frame = batch.to_pandas()
            by = frame.groupby("source", dropna=False)["size"]
            local = by.cumsum() - frame["size"] + frame["source"].map(lambda s: before.get(s if isinstance(s, str) else None, 0))
            for s, n in by.sum().items():
                s = s if isinstance(s, str) else None
                before[s] = before.get(s, 0) + int(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(frame), part, np.int32)), pa.array(local.to_numpy(np.int64))], schema=out)

    ranged = rows.repartitionByRange("source", "doc_id", "h", "place").sortWithinPartitions("source", "doc_id", "h").drop("place")
    placed = keep(ranged.mapInArrow(running, "doc_id long, source string, h long, size long, part int, local long"), "streams")
    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    return with_starts(placed, ["source"], "size", "start"), sources


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, shards: int = 64, seed: int = 11) -> DataFrame:
    """Per document: ``doc_id``, ``source``, ``h`` (hash of the text), ``size``, ``source_size``, ``target``, ``taken``, and ``blocks``.

    ``blocks`` lists what is taken: the first word and the end in the document, and
    how often (``from``, ``until``, ``times``), in order.
    """
    placed, sources = streams(docs)
    goal = targets(ranked(sources, weights), share, most)
    blocks = F.ceil(F.col("source_size") / block)
    slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * blocks / F.col("source_size")), F.floor(blocks * most))).otherwise(0)
    named = keep(goal.withColumn("blocks", blocks.cast("long")).withColumn("slots", slots.cast("long")), "targets")
    sums = named.agg(F.count("*").alias("n"), F.sum("slots").alias("slots")).first()
    of = named.select(F.col("source").alias("of"), "k", "source_size", "target")
    placed = placed.join(F.broadcast(of) if sums["n"] <= SMALL else of, placed["source"].eqNullSafe(F.col("of"))).drop("of")

    # Slots of every (shard, source), numbered within the source, mapped to blocks.  The ranges are dealt to a
    # given number of tasks, each with some 64 ranges; their number grows with the corpus, the blocks' too, so
    # they are merged and never broadcast.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sums["slots"] or 0) // (64 * STEP)))
    ranges = slot_ranges(named, shards, seed, most).repartition(parts, "k", "lo")

    def to_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, n, lo, hi in frame[["k", "blocks", "lo", "hi"]].itertuples(index=False):
                j = np.arange(lo, hi)
                size = np.full(len(j), n)
                yield pd.DataFrame({"k": k, "block": permuted(j % size, size, (j // size) * 1_000_003 + k * 7919 + seed)})

    taken = ranges.mapInPandas(to_blocks, "k long, block long").groupBy("k", "block").agg(F.count("*").alias("times"))
    size = F.col("size")
    own = placed.where(size > 0).withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    key = ["k", "start"]  # a document with words begins where no other of its source does
    piece = F.struct(F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).alias("from"), F.least((F.col("block") + 1) * block - F.col("start"), size).alias("until"), "times")
    part = own.join(taken.hint("merge"), ["k", "block"]).select(*key, piece.alias("b"))
    gathered = part.groupBy(*key).agg(F.sum((F.col("b.until") - F.col("b.from")) * F.col("b.times")).alias("taken"), F.array_sort(F.collect_list("b")).alias("blocks"))
    some = placed.where(size > 0).join(gathered, key, "left")
    none = placed.where(size == 0).withColumns({"taken": F.lit(None).cast("long"), "blocks": F.lit(None).cast("array<struct<from:bigint,until:bigint,times:bigint>>")})
    columns = ["doc_id", "source", "h", "size", "source_size", "target"]
    return some.select(*columns, "taken", "blocks").unionByName(none.select(*columns, "taken", "blocks")).withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
