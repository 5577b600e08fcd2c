"""Boosted trees of both tasks for all folds at once, on histograms that Spark sums.

Values become bins of equal counts (exact, from ranks over ranges).  For each level of each tree a
pass over the binned rows sums gradients, curvatures and counts by (fold, task, node, column,
bin) within the tasks; Spark brings the partial histograms of a (fold, task, node, column) together, a
small array from each task, and returns its best split.  The driver holds the trees, a few hundred numbers
each.  Every ``KEPT`` trees the train rows are written with their scores, so a pass applies those few trees that came since,
not all, and a lost executor costs a reread.

As in the published defaults: 50 trees, rate 0.03, 31 leaves by best gain (within ``depth`` levels), 85 per cent of the
columns for a tree, leaves of 20 rows at least; T1 logistic loss from the log odds, T2 squared error from the mean.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import KEY
from .linear import unpivoted
from .metrics import cumulative
from .quantiles import quantiles
from .tables import written

TASKS = ("T1", "T2")
#: Trees whose scores a row gets anew in each pass; then the table is written with them.
KEPT = 5
SPLIT = "fold_id string, task string, node int, col int, gain double, bin int, gl double, hl double, nl long, g double, h double, n long"


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf's ``column`` is -1."""

    column: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])
    n_left: int = 0  # rows of train on the first split's left

    def split(self, node: int, r: dict, rate: float) -> None:
        self.n_left = self.n_left or r["nl"]
        self.column[node], self.bin[node], self.gain[node] = r["col"], r["bin"], r["gain"]
        for side, g, h in (("left", r["gl"], r["hl"]), ("right", r["g"] - r["gl"], r["h"] - r["hl"])):
            getattr(self, side)[node] = len(self.column)
            for values, x in ((self.column, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, -rate * g / h), (self.gain, 0.0)):
                values.append(x)

    def trim(self, leaves: int) -> None:
        """Keep the splits that a growth by best gain makes first, up to so many leaves."""
        kept, heap, n = set(), [(-self.gain[0], 0)] if self.column[0] >= 0 else [], 1
        while heap and n < leaves:
            _, node = heapq.heappop(heap)
            kept.add(node)
            n += 1
            for child in (self.left[node], self.right[node]):
                if self.column[child] >= 0:
                    heapq.heappush(heap, (-self.gain[child], child))
        for node in range(len(self.column)):
            if node not in kept:
                self.column[node] = -1

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row."""
        column, cut, left, right = (np.array(x) for x in (self.column, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := column[node] >= 0).any():
            at = node[inner]
            node[inner] = np.where(bins[rows[inner], column[at]] <= cut[at], left[at], right[at])
        return node


@dataclass
class Model:
    """One fold's and task's trees; ``constant`` where train has one class."""

    start: float
    constant: bool = False
    trees: list[Tree] = field(default_factory=list)

    def score(self, bins: np.ndarray, known: np.ndarray | None = None, done: int = 0) -> np.ndarray:
        """Scores by all trees; ``known`` are those by the first ``done``."""
        out = np.full(len(bins), self.start) if known is None else known.copy()
        for t in self.trees[done:]:
            out += np.array(t.value)[t.places(bins)]
        return out


def scored(train: DataFrame, models: dict[tuple[str, str], Model], done: dict[tuple[str, str], int]) -> DataFrame:
    """Train rows, written with ``s1`` and ``s2``, the scores of both tasks by the trees so far; ``done`` trees are in the scores that they have."""
    names = ["fold_id", "label", "y", "bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = np.array(batch.column("fold_id").to_pylist(), object)
            codes = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(folds), -1)
            out = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("s1", "s2")]
            for fold in set(folds.tolist()):
                mine = folds == fold
                for task, s in zip(TASKS, out):
                    first = done.get((fold, task), 0)
                    s[mine] = models[fold, task].score(codes[mine], s[mine] if first else None, first)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(s) for s in out]], names=[*names, "s1", "s2"])

    kinds = dict(train.dtypes)
    return written(train.select(*names, "s1", "s2").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", s1 double, s2 double"), "scored")


def bin_edges(rows: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Per fold and column the largest train value of each bin; a value's bin comes from how many are smaller.  Null values count as the median."""
    train = rows.where(F.col("part") == "train")
    cells = unpivoted(train, columns, "fold_id")
    medians = written(quantiles(cells, ["fold_id", "column"], "x", 0.5).withColumnRenamed("quantile", "median"), "medians")
    full = cells.join(medians, ["fold_id", "column"]).select("fold_id", "column", F.coalesce("x", "median").alias("x"))
    counts = full.groupBy("fold_id", "column", "x").agg(F.count("*").alias("c"))
    totals = counts.groupBy("fold_id", "column").agg(F.sum("c").alias("n"))
    ranked = cumulative(counts, ["fold_id", "column"], "x", ["c"]).join(totals, ["fold_id", "column"])
    edges = ranked.groupBy("fold_id", "column", F.expr(f"(c_below * {bins}) div n").alias("b")).agg(F.max("x").alias("edge"))
    each = edges.groupBy("fold_id", "column").agg(F.array_sort(F.collect_list("edge")).alias("edges"))  # ``bins`` at most
    return each.join(medians, ["fold_id", "column"])


def binned(rows: DataFrame, columns: list[str], bins: int) -> tuple[DataFrame, dict[tuple[str, int], list[float]]]:
    """``fold_id``, ``part``, keys, ``label``, ``y`` and ``bins`` (a byte for each column; one without train values is 0); and the edges."""
    made = bin_edges(rows, columns, bins).collect()  # folds x columns rows
    edges = {(r["fold_id"], r["column"]): (r["edges"], r["median"]) for r in made}
    names = ["fold_id", "part", *KEY, "label", "y"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = np.array(batch.column(0).to_pylist(), object)
            out = np.zeros((len(folds), len(columns)), np.uint8)
            for k in range(len(columns)):
                x = batch.column(len(names) + k).to_numpy(zero_copy_only=False).astype(np.float64)
                for fold in set(folds.tolist()):
                    if (fold, k) in edges:
                        cut, median = edges[fold, k]
                        mine = folds == fold
                        v = np.where(np.isnan(x[mine]), median, x[mine])
                        out[mine, k] = np.minimum(np.searchsorted(np.array(cut), v), len(cut) - 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array([r.tobytes() for r in out], pa.binary())], names=[*names, "bins"])

    some = rows.select(*names, *[F.col(c).cast("double").alias(c) for c in columns])
    return some.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", bins binary"), {k: v[0] for k, v in edges.items()}


def slopes(task: str, score: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if task == "T2":
        return score - truth, np.ones(len(score))
    p = 1 / (1 + np.exp(-score))
    return p - truth, p * (1 - p)


def best_splits(train: DataFrame, models: dict, growing: dict, used: list[int], bins: int, least: int, done: dict) -> list:
    """For every open node of the growing trees and column the best split over all rows; rows have scores by ``done`` trees of each model."""
    now = {key: models[key] for key in growing}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            folds = np.array(batch.column("fold_id").to_pylist(), object)
            codes = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(folds), -1)
            truth, known = ({t: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for t, c in zip(TASKS, pair)} for pair in (("label", "y"), ("s1", "s2")))
            for (fold, task), tree in growing.items():
                mine = np.flatnonzero(folds == fold)
                if not len(mine):
                    continue
                own = codes[mine]
                g, h = slopes(task, now[fold, task].score(own, known[task][mine], done[fold, task]), truth[task][mine])
                node = tree.places(own)
                for k in tree.open:
                    at = node == k
                    for c in used:
                        b = own[at, c]
                        made = np.stack([np.bincount(b, w, bins) for w in (g[at], h[at], None)])
                        key = (fold, task, k, c)
                        total[key] = total[key] + made if key in total else made
        columns = [pa.array([k[j] for k in total], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))], names=["fold_id", "task", "node", "col", "sums"])

    def best(table: pa.Table) -> pa.Table:
        g, h, n = np.sum([np.array(v) for v in table.column("sums").to_pylist()], axis=0).reshape(3, -1)
        gl, hl, nl = (np.cumsum(x)[:-1] for x in (g, h, n))
        gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
        fits = (nl >= least) & (nr >= least) & (hl >= 1e-3) & (hr >= 1e-3)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, gl**2 / hl + gr**2 / hr - g.sum() ** 2 / h.sum(), -1.0)
        k = int(gain.argmax()) if len(gain) else 0
        key = {c: [table.column(c)[0].as_py()] for c in ("fold_id", "task", "node", "col")}
        row = [float(gain[k]), k, float(gl[k]), float(hl[k]), int(round(nl[k])), float(g.sum()), float(h.sum()), int(round(n.sum()))]
        schema = pa.schema([("fold_id", pa.string()), ("task", pa.string()), ("node", pa.int32()), ("col", pa.int32()), ("gain", pa.float64()), ("bin", pa.int32()), ("gl", pa.float64()), ("hl", pa.float64()), ("nl", pa.int64()), ("g", pa.float64()), ("h", pa.float64()), ("n", pa.int64())])
        return pa.Table.from_pydict(key | dict(zip(schema.names[4:], [[x] for x in row])), schema=schema)

    parts = train.mapInArrow(partial, "fold_id string, task string, node int, col int, sums array<double>")
    return parts.groupBy("fold_id", "task", "node", "col").applyInArrow(best, SPLIT).collect()


def fit(train: DataFrame, columns: int, trees: int = 50, rate: float = 0.03, leaves: int = 31, depth: int = 5, share: float = 0.85, least: int = 20, bins: int = 64, seed: int = 42) -> dict[tuple[str, str], Model]:
    """Models by fold and task; all grow together, a pass for each level of each tree."""
    counts = train.groupBy("fold_id").agg(F.count("*").alias("n"), F.sum("label").alias("p"), F.avg("y").alias("m")).collect()
    models: dict[tuple[str, str], Model] = {}
    for r in counts:
        p = float(r["p"]) / r["n"]
        models[r["fold_id"], "T1"] = Model(float(np.log(p / (1 - p))) if 0 < p < 1 else p, not 0 < p < 1)
        models[r["fold_id"], "T2"] = Model(float(r["m"]))
    done: dict[tuple[str, str], int] = {}
    train = train.withColumns({"s1": F.lit(0.0), "s2": F.lit(0.0)})
    for k in range(trees):
        if k % KEPT == 0:
            train = scored(train, models, done)
            done = {key: len(m.trees) for key, m in models.items()}
        used = sorted(np.random.default_rng([seed, k]).permutation(columns)[: max(1, int(columns * share + 0.5))].tolist())
        growing = {key: Tree() for key, m in models.items() if not m.constant}
        everything = dict(growing)
        for _ in range(depth):
            if not growing:
                break
            found: dict[tuple, dict] = {}
            for r in best_splits(train, models, growing, used, bins, least, done):
                key = (r["fold_id"], r["task"], r["node"])
                if r["gain"] > 1e-12 and (key not in found or (-r["gain"], r["col"]) < (-found[key]["gain"], found[key]["col"])):
                    found[key] = r.asDict()
            for (fold, task), tree in growing.items():
                now, tree.open = tree.open, []
                for node in now:
                    if (fold, task, node) in found:
                        tree.split(node, found[fold, task, node], rate)
                        tree.open += [tree.left[node], tree.right[node]]
            growing = {key: t for key, t in growing.items() if t.open}
        for key, tree in everything.items():
            tree.trim(leaves)
            if tree.column[0] >= 0:
                models[key].trees.append(tree)
    return models


def predict(rows: DataFrame, models: dict[tuple[str, str], Model]) -> DataFrame:
    """``t1_score`` and ``t2_prediction`` of binned rows."""
    names = ["fold_id", *KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = np.array(batch.column("fold_id").to_pylist(), object)
            codes = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(folds), -1)
            out = np.full((2, len(folds)), np.nan)
            for fold in set(folds.tolist()):
                mine = folds == fold
                for k, task in enumerate(TASKS):
                    m = models[fold, task]
                    score = m.score(codes[mine])
                    out[k, mine] = score if task == "T2" or m.constant else 1 / (1 + np.exp(-score))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out[0]), pa.array(out[1])], names=[*names, "t1_score", "t2_prediction"])

    return rows.select(*names, "bins").mapInArrow(run, "fold_id string, event_id string, market string, ticker string, t1_score double, t2_prediction double")


def boost_folds(rows: DataFrame, columns: list[str], options: dict | None = None) -> tuple[DataFrame, dict, dict]:
    """Predictions for the test rows of all folds, the models, and the bins' edges."""
    o = options or {}
    bins = o.get("max_bin", 64)
    made, edges = binned(rows.select("fold_id", "part", *KEY, F.col("high_impact_label").cast("double").alias("label"), F.col("abnormal_return").cast("double").alias("y"), *columns), columns, bins)
    made = written(made, "binned", spread=True)
    train = made.where((F.col("part") == "train") & F.col("label").isNotNull() & F.col("y").isNotNull())
    models = fit(train, len(columns), o.get("n_estimators", 50), o.get("learning_rate", 0.03), o.get("num_leaves", 31), o.get("max_depth", 5), o.get("colsample", 0.85), o.get("min_child_samples", 20), bins, o.get("seed", 42))
    return predict(made.where(F.col("part") == "test"), models), models, edges
