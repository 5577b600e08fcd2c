"""Token ids of a corpus as wavelet matrices, one compressed file per shard.

A shard holds the ids of whole consecutive documents.  Its ids are renumbered
densely (``alphabet``) and stored as bit planes from the highest bit down: in
each plane the ids of a zero bit move before those of a one bit, in order.  A
directory of counts every ``BLOCK`` bits makes rank one addition and a small
popcount.  With rank (and select for the way back) one file answers: the id at a
place, how often an id occurs before a place, and where its k-th occurrence is.

Each shard is one row and one Parquet file with zstd compression, so writing
goes through Spark's commit protocol, works on any store Spark can write, and
survives lost executors.

Cases: null text is an empty document (only the end id); null ``doc_id`` sorts
first; repeated ``doc_id`` rows all stay, ordered by text; an empty table gives
no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_path, texts, with_starts
from .tokens import encoder, slices

BLOCK = 512
SHARD = (
    "part int, local long, n_docs long, n_tokens long, doc_ids binary, doc_null binary, doc_tokens binary, alphabet binary, zeros array<bigint>, planes array<binary>, ranks array<binary>"
)


class WaveletMatrix:
    """Rank and select over the bit planes of one shard."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.alphabet, self.zeros, self.planes, self.ranks = n, alphabet, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        there = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
        there[ids] = True
        alphabet = np.flatnonzero(there)
        rows = (np.cumsum(there) - 1)[ids].astype(np.uint16 if len(alphabet) <= 65536 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(max(0, len(alphabet) - 1).bit_length() - 1, -1, -1):
            one = (rows & rows.dtype.type(1 << level)) != 0
            packed = np.packbits(one, bitorder="little")
            rows = np.concatenate([rows.compress(~one), rows.compress(one)])  # several times as fast as by a mask
            planes.append(packed)
            ranks.append(directory(packed))
            zeros.append(len(ids) - int(np.count_nonzero(one)))
        return cls(len(ids), alphabet.astype("<u4"), zeros, planes, ranks)

    def ids(self) -> np.ndarray:
        """All ids in order: the planes' moves undone from the lowest up."""
        rows = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 65536 else np.uint32)
        for level, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            back = np.empty_like(rows)
            back[np.flatnonzero(~one)] = rows[:zeros]
            back[np.flatnonzero(one)] = rows[zeros:] | rows.dtype.type(1 << level)
            rows = back
        return self.alphabet[rows] if self.n else np.zeros(0, "<u4")

    def rank1(self, level: int, at: int) -> int:
        """Ones before place ``at`` of a plane."""
        block = at // BLOCK
        lo, bits = block * BLOCK // 8, at - block * BLOCK
        part = self.planes[level][lo : lo + (bits + 7) // 8]
        return int(self.ranks[level][block]) + int(np.unpackbits(part, count=bits, bitorder="little").sum())

    def access(self, at: int) -> int:
        """The id at a place."""
        row = 0
        for level in range(len(self.planes)):
            ones = self.rank1(level, at)
            bit = self.rank1(level, at + 1) - ones
            row = row << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return int(self.alphabet[row])

    def _row(self, token: int) -> int | None:
        row = int(np.searchsorted(self.alphabet, token))
        return row if row < len(self.alphabet) and self.alphabet[row] == token else None

    def count(self, token: int, before: int | None = None) -> int:
        """Occurrences of an id before a place (everywhere, if none is given)."""
        row = self._row(token)
        if row is None:
            return 0
        lo, hi = 0, self.n if before is None else before
        for level in range(len(self.planes)):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            bit = row >> (len(self.planes) - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if bit else (lo - a, hi - b)
        return hi - lo

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of an id (from 0); -1 if there are fewer."""
        row = self._row(token)
        if row is None or not 0 <= k < self.count(token):
            return -1
        lo, levels = 0, len(self.planes)
        for level in range(levels):
            ones = self.rank1(level, lo)
            lo = self.zeros[level] + ones if row >> (levels - 1 - level) & 1 else lo - ones
        at = lo + k
        for level in range(levels - 1, -1, -1):
            bit = row >> (levels - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if bit else at, bit)
        return at

    def _select(self, level: int, k: int, bit: int) -> int:
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        lo = block * BLOCK // 8
        bits = np.unpackbits(self.planes[level][lo : lo + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])


def directory(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of ``BLOCK`` bits."""
    padded = np.zeros(-(-max(1, len(packed)) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
    padded[: len(packed)] = packed
    ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)[:-1]])


def shard_row(part: int, local: int, docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> dict:
    w = WaveletMatrix.build(ids)
    return {
        "part": part, "local": local, "n_docs": len(docs), "n_tokens": len(ids),
        "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "doc_null": np.array([d is None for d in docs], bool).tobytes(),
        "doc_tokens": lengths.astype("<i8").tobytes(), "alphabet": w.alphabet.tobytes(), "zeros": w.zeros,
        "planes": [p.tobytes() for p in w.planes], "ranks": [r.astype("<u4").tobytes() for r in w.ranks],
    }


def matrix(row: dict) -> WaveletMatrix:
    """The wavelet matrix in a shard's row."""
    return WaveletMatrix(
        row["n_tokens"], np.frombuffer(row["alphabet"], "<u4"), row["zeros"],
        [np.frombuffer(p, np.uint8) for p in row["planes"]], [np.frombuffer(r, "<u4") for r in row["ranks"]],
    )


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, tokens_per_shard: int = 1 << 20) -> DataFrame:
    """Encode ``docs`` in ``doc_id`` order into wavelet shards below ``path``; returns the shard rows.

    Documents are dealt by ranges of ``doc_id``; a task encodes its range batch by
    batch and closes a shard at the first document end at or after
    ``tokens_per_shard`` ids, so it holds one shard and one batch.
    """
    out = pa.schema([("part", pa.int32()), ("local", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), *[(n, pa.binary()) for n in ("doc_ids", "doc_null", "doc_tokens", "alphabet")], ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        docs, lengths, ids, held, local = [], [], [], 0, 0
        for batch in slices(batches):
            got, each = code.encode(batch.column("text"))
            ends = np.cumsum(each)
            got = np.insert(got, ends, end_id)
            each = each + 1
            ends = np.cumsum(each)
            names, lo = batch.column("doc_id").to_pylist(), 0
            while lo < len(names):  # close shards inside the batch
                start = ends[lo] - each[lo]
                hi = min(len(names), int(np.searchsorted(ends, start + tokens_per_shard - held)) + 1)
                docs += names[lo:hi]
                lengths.append(each[lo:hi])
                ids.append(got[start : ends[hi - 1]])
                held += int(ends[hi - 1] - start)
                lo = hi
                if held >= tokens_per_shard:
                    yield pa.RecordBatch.from_pylist([shard_row(part, local, docs, np.concatenate(lengths), np.concatenate(ids))], out)
                    local, docs, lengths, ids, held = local + held, [], [], [], 0
        if docs:
            yield pa.RecordBatch.from_pylist([shard_row(part, local, docs, np.concatenate(lengths), np.concatenate(ids))], out)

    ranged = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(build, SHARD).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)
    return read_shards(docs.sparkSession, path)


def read_shards(spark, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def shard_documents(shards: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and its ``part``."""
    starts = with_starts(shards.select("part", "local", "n_tokens"), [], "n_tokens", "first").select("part", "local", "first")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = matrix(row).ids()
                each = np.frombuffer(row["doc_tokens"], "<i8")
                ends = np.cumsum(each)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = np.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), each.tolist())], np.int64)
                null = np.frombuffer(row["doc_null"], bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null), pa.array(ends - each), pa.array(each), pa.array(crc), pa.array(np.full(len(each), row["part"], np.int32)), pa.array(np.full(len(each), row["local"], np.int64))], schema=out
                )

    found = shards.mapInArrow(read, ("doc_id long, start long, n_tokens long, ids_crc32 long, part int, local long"))
    return found.join(starts, ["part", "local"]).select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "part")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """Occurrences of the given ids in each shard, by rank on its bit planes alone."""
    out = pa.schema([("part", pa.int32()), ("local", pa.int64()), ("token", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                w = matrix(row)
                yield pa.RecordBatch.from_pylist([{"part": row["part"], "local": row["local"], "token": t, "n": w.count(t)} for t in tokens], out)

    return shards.mapInArrow(count, ("part int, local long, token long, n long"))


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int = 0, tokens_per_shard: int = 1 << 20) -> DataFrame:
    """Write the shards into the shared folder and return what they hold per document."""
    path = shared_path(docs.sparkSession, "wavelet")
    return shard_documents(write_shards(docs, tokenizer, path, end_id, tokens_per_shard))
