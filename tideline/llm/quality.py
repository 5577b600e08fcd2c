"""Quality scores from random Fourier features, ridge regression and isotonic calibration.

Every document becomes a short vector of statistics of its whole text.  Random
Fourier features of the standardised vector approximate a Gaussian kernel; ridge
regression on them is fitted from the normal equations, whose rows each partition
sums up for itself (Spark's ``Summarizer`` adds the partial sums in a tree, so the
driver sees one matrix of fixed size).  The raw scores of labelled rows that the
ridge fit has not used are counted in ``BINS`` equal bins, and isotonic regression
over these bins turns a raw score into the chance of label 1.

Statistics of all labelled rows are used; there is no sample.

Cases: null text counts as empty, and an empty text gets the score of its (zero)
statistics; rows with a null ``doc_id`` are scored, not learnt from, and not held
out; a document labelled more than once counts once for each label; labels that
are null or other than 0 and 1 are left out; equal texts have equal scores; very long
texts are measured whole; without any label of either kind the
share of label 1 (0.5 without labels) is the score; an empty table gives no rows;
other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep, texts
from .tokens import slices

#: Bins of raw scores for the calibration.
BINS = 2048
STATISTICS = [
    "log_chars", "log_words", "word_length", "distinct_words", "repeated_next", "letters", "upper", "digits", "punctuation", "symbols",
    "spaces", "lines", "line_words", "distinct_lines", "words_upper", "words_symbol", "words_digit", "words_end", "sentences", "top_word", "short_words", "pipes", "bang_words", "non_ascii",
]
_SYMBOL = frozenset(b"#$%&*<>=@^_{}[]\\|~+/`")
_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 upper, 3 digit, 4 punctuation, 5 symbol, 6 space, 7 line end, 8 other bytes
for _c in range(256):
    _CLASS[_c] = 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 7 if _c == 10 else 6 if _c in b" \t\r\x0b\x0c" else 5 if _c in _SYMBOL else 4 if 33 <= _c <= 126 else 8


def statistics(text: bytes) -> list[float]:
    """What ``STATISTICS`` names, for one text."""
    if not text.strip():
        return [0.0] * len(STATISTICS)
    n = len(text)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9) / n
    words = text.split()
    w = len(words)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = sum(map(bytes.isupper, words))
    alpha = sum(map(bytes.isalpha, words))
    return [
        np.log1p(n), np.log1p(w), n / w, len(counts) / w, repeated / w, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5],
        kinds[6], np.log1p(len(lines)), np.log1p(w / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), upper / w,
        sum(x[-1] in _SYMBOL for x in words) / w, sum(x[0] in b"0123456789" for x in words) / w, alpha / w, sum(x[-1] == 46 for x in words) / w,
        max(counts.values()) / w, sum(len(x) <= 3 for x in words) / w, counts.get(b"|", 0) / w, sum(x[-1] == 33 for x in words) / w, kinds[8],
    ]


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id``, the text's hash ``h`` and the vector ``stats`` of every document."""
    out = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("stats", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [statistics(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(rows, out.field("stats").type)], schema=out)

    return texts(docs).select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, stats array<double>")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


class Features:
    """Standardise, then ``size`` cosines of random projections, and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, size: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / width, (len(mean), size))
        self.b = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.std, -6, 6)
        rows = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([rows, np.ones((len(z), 1))])


def matrix_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy()
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(STATISTICS)))


def fit_ridge(rows: DataFrame, features: Features, alpha: float) -> np.ndarray:
    """Weights for ``label`` from the summed normal equations of (``stats``, ``label``)."""
    size = len(features.b) + 1
    out = pa.schema([("i", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = features(matrix_of(part, "stats"))
                total += x.T @ np.hstack([x, part.column("label").to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), out.field("sums").type)], schema=out)

    parts = rows.select("stats", "label").mapInArrow(sums, "i int, sums array<double>")
    total = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("sums")).alias("s")).orderBy("i").collect()  # size rows
    a = np.array([r["s"].toArray() for r in total]) if total else np.zeros((size, size + 1))
    return np.linalg.solve(a[:, :size] + alpha * np.eye(size), a[:, size])


def raw_scores(rows: DataFrame, features: Features, weights: np.ndarray) -> DataFrame:
    """Adds ``raw``, the ridge score, in place of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.concatenate([np.zeros(0), *[features(matrix_of(batch.slice(lo, 2048), "stats")) @ weights for lo in range(0, batch.num_rows, 2048)]])
            others = [k for k, n in enumerate(batch.schema.names) if n != "stats"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in others], pa.array(raw)], names=[*[batch.schema.names[k] for k in others], "raw"])

    kept = ", ".join(f"{n} {k}" for n, k in rows.dtypes if n != "stats")
    return rows.mapInArrow(run, f"{kept}, raw double")


def bin_of(raw: Column) -> Column:
    return F.least(F.greatest(F.floor((raw + 0.5) / 2 * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, threshold: float = 0.3, size: int = 256, width: float = 5.0, alpha: float = 1e-3, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted``, and ``h``, the hash of its text.

    Rows whose id's crc32 leaves the remainder 0 are held out, ``folds - 1``
    calibrates, and the others fit the ridge.
    """
    spark = docs.sparkSession
    measured = keep(measure(docs), "stats")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0))
    known = measured.join(given.where(~held_out(F.col("doc_id"), folds)), "doc_id").withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds)
    known = keep(known, "labelled")
    fitting = known.where(F.col("fold") != folds - 1)
    share = known.agg(F.avg("label")).first()[0]
    if share in (0.0, 1.0, None) or fitting.isEmpty():
        constant = 0.5 if share is None else float(share)
        scored = measured.select("doc_id", "h", F.lit(constant).alias("score"))
    else:
        stats = fitting.select(array_to_vector("stats").alias("v")).agg(Summarizer.metrics("count", "mean", "std").summary(F.col("v")).alias("s")).first()["s"]
        features = Features(stats["mean"].toArray(), stats["std"].toArray(), size, width, seed)
        weights = fit_ridge(fitting, features, alpha * stats["count"])
        calibrating = known.where(F.col("fold") == folds - 1)
        if calibrating.isEmpty():
            calibrating = fitting
        bins = raw_scores(calibrating.select("label", "stats"), features, weights).groupBy(bin_of(F.col("raw")).alias("bin")).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
        bins = spark.createDataFrame(bins.collect(), bins.schema)  # at most BINS rows
        model = IsotonicRegression(labelCol="label", featuresCol="bin", weightCol="weight").fit(bins.withColumn("bin", F.col("bin").cast("double")))
        chance = np.interp(np.arange(BINS), model.boundaries.toArray(), model.predictions.toArray())
        table = F.array(*[F.lit(float(x)) for x in np.clip(chance, 0, 1)])
        scored = raw_scores(measured, features, weights).select("doc_id", "h", F.element_at(table, bin_of(F.col("raw")) + 1).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "h")
