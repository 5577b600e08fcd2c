"""Stretches of words that repeat with a period, and texts with what repeats taken out.

A run is a stretch with smallest period q of at least ``exponent`` q and ``least`` words
that no neighbouring word extends.  Where it holds, words q apart are the same at
(exponent - 1) q places in a row or more, so one of them is a multiple of that number: for
every q only these places are looked at (n log n in all), first at a few words around
them, then by longest common extensions to both sides.

Extensions (``Lce``) come from a difference cover: of any two places some small step leads to
two places whose residues are in the cover.  Only suffixes at such places are sorted, by
doubling; adjacent ones get the number of blocks they share, and a sparse table answers
minima.  A question compares the few words up to the covered places, asks the table, and
compares the words of one block more.

Spark deals the documents; tasks take them up in slices of a few megabytes.  Equal words
have equal numbers in a slice, from their bytes (up to 16) or 128-bit digests.

Cases: null text has no words, no runs and an empty rest; null and repeated ids are rows like
any other (a null id is never rewritten by ``echo``); an empty table gives no rows; other
columns are ignored.  A long text is one slice of its own, with memory in proportion to its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import texts
from .tokens import gather, slices
from .words import identities, numbered, word_spans

#: Every number is a difference of two of these modulo 7.
COVER, V = (0, 1, 3), 7
#: Places looked at together.
CHUNK = 1 << 20


def few(x: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray | int) -> np.ndarray:
    """How many words from ``i`` and from ``j`` on are the same, up to ``limit`` (below 2 V)."""
    out, open_ = np.zeros(len(i), np.int64), np.ones(len(i), bool)
    for k in range(int(np.max(limit, initial=0))):
        open_ &= (k < limit) & (x[i + k] == x[j + k])
        out += open_
    return out


class Lce:
    """Longest common extensions to the right in ``x`` (numbers, none below 0)."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x = x = np.concatenate([x.astype(np.int64), -1 - np.arange(4 * V)])  # what follows equals nothing
        covered = np.concatenate([np.arange(r, n + V, V) for r in COVER])  # chain by chain: the next of a chain is V places on
        chain = np.repeat(np.arange(len(COVER)), [len(range(r, n + V, V)) for r in COVER])
        self.index = np.full(n + V, -1, np.int64)
        self.index[covered] = np.arange(len(covered))
        # Names of blocks of 2, then 4 words everywhere, of V words at covered places.
        name = np.unique(x, return_inverse=True)[1]
        for h in (1, 2):
            ahead = np.concatenate([name[h:], np.zeros(h, np.int64)])
            name = np.unique(name * (len(name) + 1) + ahead, return_inverse=True)[1]
        rank = np.unique(name[covered] * (len(name) + 1) + name[covered + V - 4], return_inverse=True)[1]
        levels, h, m = [rank], 1, len(covered)
        while rank.max(initial=0) < m - 1:
            ahead = np.zeros(m, np.int64)
            same = chain[h:] == chain[: m - h]
            ahead[: m - h][same] = rank[h:][same] + 1
            rank = np.unique(rank * (m + 1) + ahead, return_inverse=True)[1]
            levels.append(rank)
            h *= 2
        self.rank = rank
        # Blocks that neighbours in the order share, from the longest names down.
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, m - 1), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            names, step = levels[k], 1 << k
            inside = (a < m) & (b < m)
            same = np.zeros(len(a), bool)
            same[inside] = names[a[inside]] == names[b[inside]]
            shared[same] += step
            a[same] += step
            b[same] += step
        self.table = [shared.astype(np.int32)]
        while (h := 1 << len(self.table) - 1) * 2 <= len(shared):
            self.table.append(np.minimum(self.table[-1][:-h], self.table[-1][h:]))
        self.first = np.array([next(r for r in COVER if (r + d) % V in COVER) for d in range(V)])

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of places ``i`` and ``j`` that differ."""
        step = (self.first[(j - i) % V] - i) % V
        out = few(self.x, i, j, step)
        on = np.flatnonzero(out == step)
        a, b = i[on] + step[on], j[on] + step[on]
        here = np.flatnonzero((a < len(self.index)) & (b < len(self.index)))
        on, a, b = on[here], a[here], b[here]
        ra, rb = self.rank[self.index[a]], self.rank[self.index[b]]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        blocks = np.empty(len(on), np.int64)
        for k in np.unique(level):
            mine = np.flatnonzero(level == k)
            blocks[mine] = np.minimum(self.table[k][lo[mine]], self.table[k][hi[mine] - (1 << int(k))])
        out[on] += V * blocks
        out[on] += few(self.x, a + V * blocks, b + V * blocks, V)
        return out


def places(sizes: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place and period of what has to be looked at, a chunk at a time."""
    most = sizes // exponent
    text = np.repeat(np.arange(len(sizes)), most)
    q = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    counts = (sizes[text] - q - 1) // ((exponent - 1) * q) + 1
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, side="right")))
        c = counts[lo:hi]
        row = np.repeat(np.arange(lo, hi), c)
        yield text[row], (np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)) * (exponent - 1) * q[row], q[row]
        lo = hi


def find_runs(codes: np.ndarray, edges: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in that order; ``edges`` are the texts' bounds in ``codes``."""
    sizes = np.diff(edges)
    sizes = np.where(sizes >= max(least, exponent), sizes, 0)
    if not sizes.any():
        return np.zeros((0, 4), np.int64)
    # Between texts stands what equals nothing.
    x = np.insert(codes.astype(np.int64), edges[:-1], codes.max() + 1 + np.arange(len(edges) - 1))
    x = np.append(x, [-1, -2, -3])
    begin = edges[:-1] + np.arange(len(edges) - 1) + 1
    found = []
    for text, at, q in places(sizes, exponent):
        i = begin[text] + at
        hit = np.flatnonzero(x[i] == x[i + q])
        text, i, q = text[hit], i[hit], q[hit]
        need = np.minimum(2, np.maximum(least - q, (exponent - 1) * q) // 2)
        right, left = x[i + 1] == x[i + 1 + q], x[i - 1] == x[i - 1 + q]
        right = right.astype(np.int8) + (right & (x[i + 2] == x[i + 2 + q]))
        left = left.astype(np.int8) + (left & (x[np.maximum(i - 2, 0)] == x[np.maximum(i - 2, 0) + q]))
        hit = np.flatnonzero((right >= need) | (left >= need))
        found.append((text[hit], i[hit], q[hit]))
    text, i, q = (np.concatenate(c) for c in zip(*found))
    if not len(i):
        return np.zeros((0, 4), np.int64)
    # Extensions are prepared for the texts that have such places.
    used = np.unique(text)
    length = sizes[used] + 1  # with the separator before
    own = gather(x, begin[used] - 1, length)
    own = np.unique(np.append(own, -1), return_inverse=True)[1]  # the end stands for what follows
    shift = np.zeros(len(sizes), np.int64)
    shift[used] = np.cumsum(length) - length - (begin[used] - 1)
    i = i + shift[text]
    right = Lce(own)(i, i + q)
    back = len(own) - 1
    left = Lce(own[::-1].copy())(back - (i - 1), back - (i - 1 + q))
    total = left + right + q
    hit = np.flatnonzero(total >= np.maximum(least, exponent * q))
    text, start, total, q = text[hit], (i - left)[hit], total[hit], q[hit]
    order = np.lexsort((q, total, start))
    runs = np.stack([text, start - shift[text] - begin[text], total, q], 1)[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def echoed(doc_ids: list[int | None], edges: np.ndarray) -> np.ndarray:
    """The word that stands at each place when every tenth text, by the CRC of its id, goes round from some word on."""
    out = np.arange(edges[-1])
    for doc_id, lo, hi in zip(doc_ids, edges[:-1].tolist(), edges[1:].tolist()):
        if doc_id is None or lo == hi or (h := zlib.crc32(str(doc_id).encode())) % 10:
            continue
        n, g = hi - lo, h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[lo + a : hi] = lo + a + np.arange(n - a) % p
    return out


def joined(raw: np.ndarray, starts: np.ndarray, length: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Words joined by one space; ``edges`` are the texts' bounds."""
    sizes = length + 1
    last = edges[1:][np.diff(edges) > 0] - 1
    sizes[last] -= 1
    data = gather(np.append(raw, np.uint8(0)), starts, sizes)
    ends = np.cumsum(sizes)
    spaced = np.ones(len(sizes), bool)
    spaced[last] = False
    data[ends[spaced] - 1] = 0x20
    offsets = np.concatenate([[0], ends])[edges]
    return pa.Array.from_buffers(pa.large_utf8(), len(edges) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.utf8())


RUNS = "array<struct<start: long, length: long, period: long>>"


def collapse(docs: DataFrame, least: int = 6, exponent: int = 4, echo: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (by start, then period) and ``kept_text``: the words that are in no run after its first period, joined by one space.

    With ``echo`` texts are rewritten first (``echoed``).  ``exponent`` is 2 or more.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, starts, length, edges = word_spans(batch.column("text"), False)
            codes = numbered(*identities(raw, starts, length))[0]
            if echo:
                at = echoed(batch.column("doc_id").to_pylist(), edges)
                codes, starts, length = codes[at], starts[at], length[at]
            runs = find_runs(codes, edges, least, exponent)
            marks = np.zeros(len(codes) + 1, np.int64)
            begin = edges[runs[:, 0]] + runs[:, 1]
            np.add.at(marks, begin + runs[:, 3], 1)
            np.add.at(marks, begin + runs[:, 2], -1)
            keep = np.cumsum(marks[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[edges]
            text = joined(raw, starts[keep], length[keep], kept)
            each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in (1, 2, 3)], names=["start", "length", "period"])
            bounds = np.searchsorted(runs[:, 0], np.arange(len(edges)))
            columns = [batch.column("doc_id"), pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each), text]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "kept_text"])

    return texts(docs).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, kept_text string")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def longest_runs(rows: DataFrame) -> DataFrame:
    """Per row of ``collapse``: ``n_runs``, the longest run (ties: smallest start, then period; nulls without runs) and digests of all runs and of the rest."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c"))))
    length, period = -best["a"], best["c"]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["b"].alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        sha256(F.array_join(lines, "")).alias("runs_sha256"), sha256(F.col("kept_text")).alias("collapsed_sha256"),
    )
