"""Best-fit packing of documents into sequences by exact-complement hashing.

Only lengths decide a packing, so it is planned on the histogram of piece lengths
(at most ``capacity`` counts, however large the corpus) and carried out on the
rows in parallel:

1. Tasks encode documents, cut the long ones, and number the pieces of each
   length within their partition.
2. The histogram goes to the planner, which indexes the sums of pairs and triples of
   lengths by hash (``Complements``).  For the longest length left it looks up the
   gap among single lengths, then pair sums, then triple sums, and consumes a
   combination that fills the gap exactly, as often as the counts allow.  A gap
   that nothing fills exactly takes the longest length that fits (best fit) and
   is looked up again.
3. A pattern used ``c`` times owns ``c`` sequences and, of each of its lengths, a
   run of ranks.  Pieces get their rank by prefix sums over (length, partition)
   and find their run by bisection, so no group of equal lengths meets in a task.

Cases: null text is empty (one piece with the end id); null or repeated
``doc_id`` rows are packed like any other; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, texts, with_starts
from .tokens import encoder, slices


class Complements:
    """A hash index from sums to the pairs and triples of lengths in stock that have them; ``left`` counts the stock."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs: dict[int, list[tuple[int, int]]] = {}  # the best, with the longest part, stands last
        self.firsts: dict[int, list[int]] = {}  # of triples: the longest part; the others are a pair
        lengths = np.flatnonzero(left).tolist()
        for k, a in enumerate(lengths):
            for b in lengths[: k + 1]:
                if a + b >= len(left):
                    break
                self.pairs.setdefault(a + b, []).append((a, b))
        for total in range(3, len(left)):
            self.firsts[total] = [a for a in lengths if 3 * a >= total and total - a in self.pairs]

    def pair(self, total: int, top: int, taken: int = 0) -> tuple[int, int] | None:
        """Two lengths in stock, none above ``top``, when one of ``taken`` is in use already."""
        found = self.pairs.get(total, [])
        while found and not self.there(found[-1]):  # stock only shrinks: what is gone stays gone
            found.pop()
        for p in reversed(found):
            if p[0] <= top and self.there(p, taken):
                return p
        return None

    def there(self, pair: tuple[int, int], taken: int = 0) -> bool:
        a, b = pair
        return self.left[a] > (a == taken) and self.left[b] > (b == taken) + (a == b)

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths in stock that sum to ``gap``, longest first."""
        if self.left[gap]:
            return (gap,)
        if two := self.pair(gap, gap):
            return two
        firsts = self.firsts.get(gap, [])
        while firsts and not self.left[firsts[-1]]:
            firsts.pop()
        for a in reversed(firsts):
            if self.left[a] and (rest := self.pair(gap - a, a, a)):
                return (a, *rest)
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that sum to at most ``capacity``, and how often each is used."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    index = Complements(left)
    out: list[tuple[tuple[int, ...], int]] = []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            left[longest] -= 1
            pattern, gap = [longest], capacity - longest
            while gap:
                more = index.fill(gap)
                if more is None:
                    fits = np.flatnonzero(left[1 : gap + 1])
                    if not len(fits):
                        break
                    more = (int(fits[-1]) + 1,)
                for x in more:
                    left[x] -= 1
                pattern += more
                gap -= sum(more)
            lengths, need = np.unique(pattern, return_counts=True)
            again = int((left[lengths] // need).min())
            left[lengths] -= again * need
            out.append((tuple(sorted(pattern, reverse=True)), again + 1))
    return out


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Per pattern and length: the ranks it owns, and where they go."""
    rows, sequence, used = [], 0, {}
    for pattern, times in patterns:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            m = pattern.count(length)
            lo = used.get(length, 0)
            used[length] = lo + m * times
            rows.append((length, lo, m, sequence, at))
            at += m * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "lo", "each", "sequence", "offset"]).sort_values(["length", "lo"])


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids, numbered by length within their partition (``local``)."""
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("one", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            ids, each = code.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(each), end_id).astype("<u4")
            each = each + 1
            n = -(-each // capacity)
            doc = np.repeat(np.arange(len(each)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            head = each - (n - 1) * capacity  # the first piece takes what the full ones leave
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            lo = (np.cumsum(each) - each)[doc] + start
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist())]
            order = np.argsort(length, kind="stable")
            count = np.bincount(length, minlength=capacity + 1)
            local = np.empty(len(doc), np.int64)
            local[order] = np.arange(len(doc)) - (np.cumsum(count) - count)[length[order]] + seen[length[order]]
            seen += count
            names = batch.column("doc_id").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([names, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(local), pa.array(np.ones(len(doc), np.int64))], schema=out)

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long, one long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    pieces = keep(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    owned = runs(plan(histogram, capacity))
    by = {k: (g["lo"].to_numpy(), g["each"].to_numpy(), g["sequence"].to_numpy(), g["offset"].to_numpy()) for k, g in owned.groupby("length")}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        kinds, first = np.unique(n[order], return_index=True)
        for k, rows in zip(kinds.tolist(), np.split(order, first[1:])):
            lo, each, base, at = by[k]
            run = np.searchsorted(lo, r[rows], side="right") - 1
            inside = r[rows] - lo[run]
            sequence[rows] = base[run] + inside // each[run]
            offset[rows] = at[run] + inside % each[run] * k
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = with_starts(pieces, ["length"], "one", "rank")
    return ranked.withColumn("at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id"), F.col("at.offset"))
