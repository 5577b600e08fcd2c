"""Exact top-k inner products by sorted lists without random access.

Candidates are dealt into blocks, queries too; a task holds one block of each.  A
block keeps, for every component, its list of candidates sorted by value.  The
lists are read from both ends in growing steps, each entry once: a query reads a
component's list from the top where its own component is positive, from the bottom
where it is negative.  What has been read gives each candidate a sum; what has not been read
lies between the value at the reading position and the far end of its list.  That
gives lower and upper bounds.  A candidate whose upper bound is below the k-th best
lower bound cannot qualify and leaves; a query stops when few candidates are left (a
sixteenth of the block, or four times the answers) or all lists are read.  Then the
scores of those that remain are resolved.  Bounds of all queries are matrix products, so a step costs the
same few products whatever the queries are.

Copies of a vector are one candidate with its smallest ids (``k`` of them and those
of the query's own id are enough).  Blocks give ``k`` answers a query; the best
``k`` of them all win.

Bounds are floating-point numbers with their rounding error added; final scores are
whole numbers, and those beyond 64 bits stop at the largest (or smallest) such number.

Cases: vectors that are null or hold nulls, NaN or infinities take no part, and neither
do rows with a null id; of vectors of different lengths the missing components count as
0 (so an empty vector scores 0); an id given twice is two rows (as a query, the one
with the smaller vector); a query is never its own answer, and rows with its id are not
either; equal scores go to the smaller id; with fewer than ``k`` others all are
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that a task searches at once.
QUERIES = 1024
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, held within 64 bits."""
    if float(np.abs(rows.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).sum()) < 2.0**62:
        return rows @ query
    least, most = -(1 << 63), (1 << 63) - 1
    return np.array([min(most, max(least, sum(map(int.__mul__, r, query.tolist())))) for r in rows.tolist()], np.int64)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, stops: list[float] | None = None) -> pd.DataFrame:
    """The best ``k`` of a block for each query; ``stops`` gets the share of the lists that each has read."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    distinct, member = np.unique(x, axis=0, return_inverse=True)
    member = member.ravel()
    by_vector = np.argsort(member, kind="stable")  # ids ascend within a vector
    first = np.searchsorted(member[by_vector], np.arange(len(distinct)))
    count = np.diff(np.append(first, len(member)))
    n, dims = distinct.shape
    value = distinct.astype(np.float64)
    lists = np.argsort(value, axis=0, kind="stable")
    rank = np.empty((n, dims), np.int32)  # place of each candidate in each list, from the bottom
    np.put_along_axis(rank, lists, np.arange(n, dtype=np.int32)[:, None], axis=0)
    ordered = np.take_along_axis(value, lists, axis=0)
    low, high = ordered[0], ordered[-1]
    slack = 2.0**-50 * (dims + 4) * (np.abs(q.astype(np.float64)) @ np.maximum(np.abs(low), np.abs(high)))  # more than rounding adds
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    deep = k + int(np.unique(ids, return_counts=True)[1].max(initial=0))  # so many hold k others than the query
    want = np.minimum(deep, count)  # answers a candidate can give

    live = np.arange(len(q))
    left: dict[int, np.ndarray] = {}
    kept = np.arange(n)  # candidates that some live query still needs
    read = np.zeros((len(q), n))  # what each query has read of each of them
    before, depth = 0, max(1, n // 8)
    while len(live):
        depth = min(n, depth)
        top, bottom = ordered[n - depth], ordered[depth - 1]  # values at the reading positions
        place, v, u, d = rank[kept], value[kept], up[live], down[live]
        from_top, from_bottom = place >= n - depth, place < depth
        read += u @ (v * (from_top & (place < n - before))).T + d @ (v * (from_bottom & (place >= before))).T
        not_top, not_bottom = (~from_top).T.astype(np.float64), (~from_bottom).T.astype(np.float64)
        most = read + (u * top) @ not_top + (d * bottom) @ not_bottom
        least = read + (u * low) @ not_top + (d * high) @ not_bottom
        still, needed = [], np.zeros(len(kept), bool)
        weight, few = want[kept], min(deep, len(kept))
        near = np.argpartition(least, len(kept) - few, axis=1)[:, len(kept) - few :]
        for j, query in enumerate(live):
            # A lower bound that k others than the query reach, copies counted.
            best = near[j][np.argsort(-least[j, near[j]], kind="stable")]
            enough = np.searchsorted(np.cumsum(weight[best]), deep)
            bound = least[j, best[enough]] if enough < few else -np.inf
            can = most[j] >= bound - slack[query]
            if depth >= n or int(np.count_nonzero(can)) <= max(4 * k, n // 16):
                left[query] = kept[can]
                if stops is not None:
                    stops.append(depth / n)
            else:
                still.append(j)
                needed |= can
        read = read[np.ix_(still, np.flatnonzero(needed))]
        kept, live, before, depth = kept[needed], live[still], depth, depth * 3 // 2 + 1

    out = []
    for j, candidates in left.items():
        scores = inner(distinct[candidates], q[j])
        mine = [by_vector[first[c] : first[c] + want[c]] for c in candidates]
        at = np.concatenate(mine) if mine else np.zeros(0, np.int64)
        score = np.repeat(scores, [len(m) for m in mine])
        other = ids[at] != query_ids[j]
        at, score = at[other], score[other]
        best = np.lexsort((ids[at], ~score))[:k]  # ~ falls as the score rises, without overflow
        out.append(pd.DataFrame({"query_id": query_ids[j], "vec_id": ids[at][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def as_rows(vectors: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows of ``dims`` whole numbers, zeros where one is shorter."""
    out = np.zeros((len(vectors), dims), np.int64)
    size = np.array([len(v) for v in vectors])
    out[np.arange(dims) < size[:, None]] = np.concatenate(vectors.to_list()) if size.any() else []
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, candidates_per_block: int = 8192, queries_per_block: int = 8192) -> DataFrame:
    """Per query and rank: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Of n candidates and m queries, a candidate is copied m / ``queries_per_block`` times and
    a query n / ``candidates_per_block`` times; a task searches ``QUERIES`` at once.
    """
    vector = F.col("embedding")
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(vector, scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.max(F.size("x")).alias("d")).first()
    blocks, sets = max(1, -(-size["n"] // candidates_per_block)), max(1, -(-size["q"] // queries_per_block))
    dims = max(1, size["d"] or 0)
    pick = F.xxhash64("vec_id")
    candidates = rows.select("vec_id", "x", F.pmod(pick, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"))
    asked = rows.where("is_query").groupBy("vec_id").agg(F.min("x").alias("x"))
    queries = asked.select("vec_id", "x", F.pmod(F.shiftright(pick, 20), F.lit(sets)).cast("int").alias("set"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        x, q, names = as_rows(left["x"], dims), as_rows(right["x"], dims), right["vec_id"].to_numpy()
        return pd.concat([search_block(left["vec_id"].to_numpy(), x, names[lo : lo + QUERIES], q[lo : lo + QUERIES], k) for lo in range(0, len(q), QUERIES)])

    found = candidates.groupBy("block", "set").cogroup(queries.groupBy("block", "set")).applyInPandas(search, FOUND)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def by_id(divisor: int = 100) -> Column:
    """The rows whose id is divisible by ``divisor``."""
    return F.col("vec_id") % divisor == 0
