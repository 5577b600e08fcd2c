"""Product codes of vectors; nearest entries are found in geometric near-neighbour access trees (GNAT).

Components become integers (the floor of ``scale`` times the component), a vector is cut
into ``parts`` equal consecutive parts, and each part position has a codebook.  Codebooks
start as the parts of the vectors with the smallest ids; in each round Spark tasks assign
their rows' parts to the nearest entries and send sums and counts (at most parts x entries
rows a task), which Spark adds up; entries become the floors of the means.

An inner node of a ``Gnat`` has split points and, for each child and split point, the range
of distances from the split point to the child's entries.  A query measures its distance to
the split points; a child none of whose points can be as near as the best so far is left
out with all that is below it.  Square roots are rounded outwards and a child goes only if
it lies strictly outside, so ties always survive; what decides in the end are integer squared
distances, ties to the lower index.

Cases: vectors that are null or hold null or non-finite components take no part; repeated
and null ids are rows like any other (null ids come after all, equal ones in the order of
their components); shorter vectors are filled up with zeros, and so is a width that does not
divide by ``parts``; with fewer vectors than ``entries`` codebooks are as short; no rows give
no rows and empty codebooks; other columns are ignored.  Integers of more than 27 bits are an
error, as their squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, release

#: Split points of an inner node, and most entries of a leaf.
DEGREE, LEAF = 6, 6
#: Vectors that are assigned at once.
ROWS = 4096
FAR = np.iinfo(np.int64).max


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer squared distances of the rows of ``a`` to those of ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


def root_below(d: np.ndarray) -> np.ndarray:
    """A float at or below the square root; conversion and root may each be off by one step."""
    return np.nextafter(np.nextafter(np.sqrt(d.astype(np.float64)), -1.0), -1.0)


def root_above(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(d.astype(np.float64)), np.inf), np.inf)


class Gnat:
    """A tree over entries (integer points and their indexes)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.children: list[Gnat | None] = []
        self.points, self.ids = points, ids
        if len(points) <= LEAF:
            return
        chosen, near = [0], squared(points, points[:1])[:, 0]
        while len(chosen) < DEGREE and near.max() > 0:  # the point farthest from all chosen ones
            chosen.append(int(near.argmax()))
            near = np.minimum(near, squared(points, points[chosen[-1:]])[:, 0])
        rest = np.setdiff1d(np.arange(len(points)), chosen)
        d = squared(points[chosen], points[rest])
        home = d.argmin(axis=0)
        self.points, self.ids = points[chosen], ids[chosen]
        self.low, self.high = np.zeros((2, len(chosen), len(chosen)))
        for j in range(len(chosen)):
            mine = np.flatnonzero(home == j)
            self.children.append(Gnat(points[rest[mine]], ids[rest[mine]]) if len(mine) else None)
            if len(mine):
                self.low[:, j], self.high[:, j] = root_below(d[:, mine].min(axis=1)), root_above(d[:, mine].max(axis=1))

    def search(self, queries: np.ndarray, best: np.ndarray, who: np.ndarray, rows: np.ndarray) -> int:
        """Improve ``best`` (squared distance) and ``who`` (index) of the queries ``rows``; how many distances were measured."""
        mine = queries[rows]
        d = squared(mine, self.points)
        measured = d.size
        for k, name in enumerate(self.ids.tolist()):
            better = (d[:, k] < best[rows]) | ((d[:, k] == best[rows]) & (name < who[rows]))
            best[rows[better]], who[rows[better]] = d[better, k], name
        below, above = root_below(d), root_above(d)
        for j, child in enumerate(self.children):
            if child is not None:
                reach = root_above(best[rows])[:, None]
                open_ = ((below - reach <= self.high[:, j]) & (above + reach >= self.low[:, j])).all(axis=1)
                if open_.any():
                    measured += child.search(queries, best, who, rows[open_])
        return measured

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each query, its squared distance, and how many distances were measured."""
        best, who = np.full(len(queries), FAR), np.full(len(queries), FAR)
        measured = self.search(queries, best, who, np.arange(len(queries)))
        return who, best, measured


@dataclass
class Codebooks:
    """``entries[p][e]`` is the integer point of entry ``e`` of part position ``p``."""

    entries: np.ndarray

    def trees(self) -> list[Gnat]:
        return [Gnat(part, np.arange(len(part))) for part in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The point that a code stands for."""
        return np.concatenate([self.entries[p][int(code[2 * p : 2 * p + 2], 16)] for p in range(len(self.entries))])


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows that take part, with the vector as integers ``v``."""
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    rows = rows.where(F.col("x").isNotNull() & ~F.exists("x", wrong))
    large = F.exists("x", lambda x: F.abs(x * scale) >= 1 << 27)
    x = F.when(large, F.raise_error(F.lit("a component has more than 27 bits"))).otherwise(F.col("x"))
    return rows.select("vec_id", "label", F.transform(x, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, shorter rows filled up with zeros."""
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (length == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(length), width), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def assigned(batches: Iterator[pa.RecordBatch], entries: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches with their parts, the nearest entries and the squared distances, by row and part position."""
    trees = Codebooks(entries).trees()
    parts, _, size = entries.shape
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            some = batch.slice(lo, ROWS)
            cut = matrix(some.column("v"), parts * size).reshape(-1, parts, size)
            found = [tree.nearest(cut[:, p]) for p, tree in enumerate(trees)]
            yield some, cut, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)
    release()


def summing(entries: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts and sums of the parts that each entry has got in a task."""
    parts, n, size = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, n, size), np.int64), np.zeros((parts, n), np.int64)
        for _, cut, who, _ in assigned(batches, entries):
            for p in range(parts):
                np.add.at(sums[p], who[:, p], cut[:, p])
                counts[p] += np.bincount(who[:, p], minlength=n)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e]), "sums": pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))})

    return run


def coding(entries: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = 2 * len(entries)
        for some, _, who, far in assigned(batches, entries):
            text = who.astype(np.uint8).tobytes().hex()
            codes = [text[k : k + digits] for k in range(0, len(text), digits)]
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(codes, pa.string()), pa.array(far.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def fit(rows: DataFrame, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks for the integer vectors ``rows``; the driver holds them (parts x entries points) and no row beside the first ``entries``."""
    widest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-widest // parts) * parts
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    start = np.zeros((len(first), width), np.int64)
    for k, r in enumerate(first):
        start[k, : len(r["v"])] = r["v"]
    book = start.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        got = rows.select("v").mapInArrow(summing(book), "part int, entry int, n long, sums array<long>")
        wide = F.transform(F.col("sums"), lambda x: x.cast("decimal(38,0)"))
        each = got.select("part", "entry", "n", F.posexplode_outer(wide).alias("k", "x"))
        summed = each.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for r in summed.where(F.col("k").isNotNull()).collect():  # one row for each number of the codebooks
            book[r["part"], r["entry"], r["k"]] = int(r["x"]) // r["n"]
    return Codebooks(book)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """``vec_id``, ``label``, ``code`` (two hex digits a part), ``error`` (squared distance) of each vector that takes part; and the codebooks."""
    rows = integers(vectors, scale)
    label = rows.schema["label"].dataType.simpleString()
    book = fit(rows, parts, entries, rounds)
    if not book.entries.shape[1]:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), book
    return rows.mapInArrow(coding(book.entries), f"vec_id long, label {label}, code string, error long"), book


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``label_error``: the errors summed over the rows of equal label, null being one; a label's rows never meet, only its sums."""
    codes = keep(codes, "codes")
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
