"""Gradient-boosted trees for any number of classes, with probabilities: softmax gradients of all classes share one tree a
round, whose leaves hold a value for each class.

Features are cut at quantiles. A tree grows level by level: tasks sum gradients and second derivatives by node, feature and
cut, as whole numbers of a fixed unit so that the order of rows decides nothing; sums are combined before they are
shuffled, and nodes * features * cuts * classes numbers reach the driver, which picks the splits. Rows keep their cuts
and the scores of the trees so far in the shared folder, written anew every REFRESH trees; between, tasks apply the
trees that are newer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidegrid.functions.folders import discard, exists
from slidegrid.operators.regions import settled

#: Cuts of a feature, trees between two writings of the scores, and units of gradients in 1.
CUTS, REFRESH, UNIT = 63, 25, 1 << 24


@dataclass
class Tree:
    """Nodes in order of growth: a feature (-1 for a leaf), the cut above which rows go right, left child, values."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[list[float]] = field(default_factory=list)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(bins), dtype=np.int64)
        while len(inner := np.flatnonzero(feature[at] >= 0)):
            node = at[inner]
            at[inner] = left[node] + (bins[inner, feature[node]] > cut[node])
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Boosted:
    """A fitted model; written as JSON beside whatever Hadoop file system the path names."""

    labels: list[str]
    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls(raw["labels"], raw["features"], raw["cuts"], [Tree(**t) for t in raw["trees"]])


def _binned(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """The number of cuts below each value; nulls and NaN go below all."""
    out = np.empty(values.shape, dtype=np.int64)
    for k, c in enumerate(cuts):
        out[:, k] = np.searchsorted(np.array(c), values[:, k], side="left")
        out[np.isnan(values[:, k]), k] = 0
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(scores: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of each row the classes' first and then second derivatives of the log loss, in units."""
    p = softmax(scores)
    g = p.copy()
    g[np.arange(len(label)), label] -= 1
    return np.rint(np.hstack([g, p * (1 - p)]) * UNIT).astype(np.int64)


def best_splits(sums: dict[int, np.ndarray], penalty: float, least: float) -> dict[int, tuple[int, int]]:
    """(feature, cut) of each node that gains by a split: sums by node as (features, cuts + 1, 2 * classes) units."""
    out = {}
    for node, h in sums.items():
        up = np.cumsum(h, axis=1).astype(np.float64) / UNIT
        whole, k = up[:, -1:, :], h.shape[2] // 2
        gain_of = lambda s: (s[..., :k] ** 2 / (s[..., k:] + penalty)).sum(axis=-1)  # noqa: B023, E731
        gain = gain_of(up) + gain_of(whole - up) - gain_of(whole)
        enough = (up[..., k:].sum(axis=-1) >= least) & ((whole - up)[..., k:].sum(axis=-1) >= least)
        gain = np.where(enough, gain, -np.inf)[:, :-1]
        if gain.size and gain.max() > 1e-6:
            out[node] = tuple(int(x) for x in np.unravel_index(gain.argmax(), gain.shape))
    return out


def leaf_values(sums: np.ndarray, penalty: float, rate: float) -> list[float]:
    k = len(sums) // 2
    return (-rate * sums[:k] / (sums[k:] + penalty * UNIT)).tolist()


def fit(train: DataFrame, features: list[str], label: str, rounds: int = 100, depth: int = 6, rate: float = 0.3, penalty: float = 1.0, least: float = 1.0) -> Boosted:
    """Rows without a label take no part. The defaults are those that boosted classifiers commonly have."""
    spark = train.sparkSession
    rows = train.where(F.col(label).isNotNull())
    labels = sorted(r[0] for r in rows.select(F.col(label).cast("string")).distinct().collect())  # a row for each class
    quantiles = F.array(*[F.lit(k / (CUTS + 1)) for k in range(1, CUTS + 1)])
    found = rows.select(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), quantiles, F.lit(10_000)).alias(f) for f in features]).first()
    cuts = [sorted(set(found[f] or [])) for f in features]
    classes, n_bins = len(labels), max((len(c) for c in cuts), default=0) + 1
    model = Boosted(labels, features, cuts, [])
    if classes < 2:
        return model
    index = F.array_position(F.array(*map(F.lit, labels)), F.col(label).cast("string")).cast("int") - 1
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    fresh: list[Tree] = []

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _binned(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(features)), cuts)
            bins = pa.array([b.tobytes() for b in bins.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), bins, batch.column(2)], names=["y", "b", "s"])

    shape = "y int, b binary, s array<double>"
    state = settled(rows.select(index.alias("y"), values.alias("x"), F.array(*[F.lit(0.0)] * classes).alias("s")).mapInArrow(cut_up, shape))

    def arrays(batch: pa.RecordBatch, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = batch.num_rows
        bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(n, len(features))
        s = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, classes).copy()
        for t in trees:
            s += t.scores(bins)
        return batch.column(0).to_numpy(), bins, s

    def histogram(trees: list[Tree], tree: Tree, open_: list[int]) -> dict[int, np.ndarray]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(open_), len(features), n_bins, 2 * classes), dtype=np.int64)
            place = np.full(len(tree.feature), -1)
            place[open_] = np.arange(len(open_))
            for batch in batches:
                y, bins, s = arrays(batch, trees)
                at = place[tree.leaves(bins)]
                held = at >= 0
                at, g = at[held] * n_bins, gradients(s, y)[held]
                for f in range(len(features)):
                    cell = at + bins[held, f]
                    for k in range(2 * classes):  # a batch's sums are whole numbers that doubles hold
                        total[:, f, :, k] += np.bincount(cell, g[:, k], len(open_) * n_bins).astype(np.int64).reshape(len(open_), n_bins)
            at = np.nonzero(total.any(axis=3))
            yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int32()) for a in at), *(pa.array(v) for v in total[at].T)], names=["node", "f", "i", *parts])

        parts = [f"v{k}" for k in range(2 * classes)]
        added = state.mapInArrow(sums, ", ".join(["node int, f int, i int", *(f"{v} long" for v in parts)]))
        added = added.groupBy("node", "f", "i").agg(*[F.sum(v).alias(v) for v in parts]).toArrow()
        out = np.zeros((len(open_), len(features), n_bins, 2 * classes), dtype=np.int64)  # nodes of a level * features * cuts * classes
        out[tuple(added[c].to_numpy() for c in ("node", "f", "i"))] = np.stack([added[v].to_numpy() for v in parts], axis=1)
        return dict(zip(open_, out, strict=True))

    for _ in range(rounds):
        tree, open_ = Tree(), [0]
        tree.value = [[0.0] * classes]
        for _level in range(depth):
            sums = histogram(fresh, tree, open_)
            if tree.feature == [-1]:
                tree.value[0] = leaf_values(sums[0][0].sum(axis=0), penalty, rate)
            splits, open_ = best_splits(sums, penalty, least), []
            for node, (f, cut) in sorted(splits.items()):
                tree.feature[node], tree.cut[node], tree.left[node] = f, cut, len(tree.feature)
                low = sums[node][f, : cut + 1].sum(axis=0)
                for side in (low, sums[node][f].sum(axis=0) - low):
                    if side[classes:].sum() >= 2 * least * UNIT:  # else it can't be split
                        open_.append(len(tree.feature))
                    for column, new in ((tree.feature, -1), (tree.cut, 0), (tree.left, 0), (tree.value, leaf_values(side, penalty, rate))):
                        column.append(new)
            if not open_:
                break
        model.trees.append(tree)
        fresh.append(tree)
        if len(tree.feature) == 1:
            break  # no split gains anything any more
        if len(fresh) == REFRESH:
            trees = list(fresh)

            def renewed(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    _, _, s = arrays(batch, trees)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(s), pa.list_(pa.float64()))], names=["y", "b", "s"])

            before, state = state, settled(state.mapInArrow(renewed, shape))
            discard(spark, before.settled_path)
            fresh = []
    discard(spark, state.settled_path)
    return model


def predict(rows: DataFrame, model: Boosted) -> DataFrame:
    """Adds predictions (the likeliest class, ties to the first in order) and a probability for each class, named by it. A model
    of one class predicts that; one of none predicts null."""
    schema = rows.select("*", F.lit(None).cast("string").alias("predictions"), *[F.lit(None).cast("double").alias(v) for v in model.labels]).schema
    columns = rows.columns
    kept = rows.withColumn("_x", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in model.features]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(columns)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(model.features))
            bins, s = _binned(x, model.cuts), np.zeros((batch.num_rows, max(1, len(model.labels))))
            for t in model.trees:
                s += t.scores(bins)
            p = softmax(s)
            said = [model.labels[k] if model.labels else None for k in p.argmax(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.string()), *[pa.array(p[:, k]) for k in range(len(model.labels))]], names=[*columns, "predictions", *model.labels])

    return kept.mapInArrow(run, schema)


def fit_or_load(train: DataFrame, features: list[str], label: str, path: str | None = None, retrain: bool = False, **how) -> Boosted:
    """The model saved at path, if there is one and retrain is not asked for; else a fitted one, saved at path."""
    spark = train.sparkSession
    if path and not retrain and exists(spark, path):
        return Boosted.load(spark, path)
    model = fit(train, features, label, **how)
    if path:
        model.save(spark, path)
    return model
