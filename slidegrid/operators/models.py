"""Scoring of patches by user-supplied models, slide classifiers, and tile augmentation as coordinate transforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidegrid.functions.draws import draw
from slidegrid.functions.folders import exists


def score_patches(rows: DataFrame, scorer_factory: Callable[[], Callable], schema: str) -> DataFrame:
    """Applies a scorer to Arrow-batched pandas frames; the factory runs once a partition, so a model is loaded once."""

    def run(batches: Iterator) -> Iterator:
        scorer = scorer_factory()
        for batch in batches:
            yield scorer(batch)

    return rows.mapInPandas(run, schema)


def linear_softmax_scorer() -> Callable:
    """A demonstration model: logits are sums of every tenth component."""
    import numpy as np
    import pandas as pd

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(batch["embedding"].to_numpy()).astype(np.float64)
        logits = np.stack([x[:, k::2].sum(axis=1) for k in range(2)], axis=1)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return pd.DataFrame({"vec_id": batch["vec_id"], "normal": p[:, 0], "tumor": p[:, 1]})

    return score


def _pipeline(learner, features: list[str], label: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    def fit(rows: DataFrame):
        indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
        names = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), indexer, learner, names]).fit(rows), indexer.labels

    return fit


def slide_forest(train: DataFrame, rows: DataFrame, features: list[str], label: str, trees: int = 100, seed: int = 7, path: str | None = None, retrain: bool = False) -> DataFrame:
    """Random forest of slide features: predictions and a probability for each class, named by the class. With a path, the model
    saved there is used, unless retrain is asked for or there is none; then the fitted one is saved there."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    if path and not retrain and exists(rows.sparkSession, path):
        model = PipelineModel.load(path)
    else:
        learner = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, featureSubsetStrategy="sqrt", seed=seed)
        model, _ = _pipeline(learner, features, label)(train)
        if path:
            model.write().overwrite().save(path)
    names = model.stages[-1].getLabels()
    bare = rows.drop(label) if label in rows.columns else rows
    out = model.transform(bare).withColumn("_p", vector_to_array("probability"))
    kept = [c for c in bare.columns if c not in features]
    return out.select(*kept, F.col("predicted").alias("predictions"), *[F.get("_p", F.lit(k)).alias(name) for k, name in enumerate(names)])


def slide_boosted(train: DataFrame, rows: DataFrame, features: list[str], label: str, path: str | None = None, retrain: bool = False, **how) -> DataFrame:
    """Boosted trees of slide features: predictions and a probability for each class, named by the class; path as in
    slide_forest, other arguments as in boosting.fit."""
    from slidegrid.operators.boosting import fit_or_load, predict

    model = fit_or_load(train, features, label, path, retrain, **how)
    bare = rows.drop(label) if label in rows.columns else rows
    return predict(bare, model).drop(*features)


def rotate(tiles: DataFrame, angle: Column, side: int) -> DataFrame:
    """Turns square tiles anticlockwise by 0, 90, 180 or 270 degrees."""
    r, c, last = F.col("row"), F.col("col"), F.lit(side - 1)
    pick = lambda zero, q1, q2, q3: F.when(angle == 0, zero).when(angle == 90, q1).when(angle == 180, q2).otherwise(q3)
    return tiles.withColumns({"row": pick(r, last - c, last - r, c), "col": pick(c, r, last - c, last - r)})


def flip(tiles: DataFrame, side: int) -> DataFrame:
    return tiles.withColumn("col", F.lit(side - 1) - F.col("col"))


def random_angle(seed: int, angles: tuple[int, ...], *keys: str) -> Column:
    return F.get(F.array(*map(F.lit, angles)), (draw(seed, *keys) % len(angles)).cast("int"))


def random_crop(tiles: DataFrame, side: int, diff: int, seed: int) -> DataFrame:
    """Cuts diff rows and columns; one drawn offset below diff for both axes of a tile."""
    at = draw(seed, "slide_idx") % max(diff, 1)
    size = side - diff
    moved = tiles.withColumn("_o", at.cast("int")).withColumns({"row": F.col("row") - F.col("_o"), "col": F.col("col") - F.col("_o")}).drop("_o")
    return moved.where((F.col("row") >= 0) & (F.col("row") < size) & (F.col("col") >= 0) & (F.col("col") < size))


#: Angle and flip of the transforms that patch rows name, from 1.
TRANSFORMS = [(0, False), (90, False), (180, False), (270, False), (0, True), (90, True), (180, True), (270, True)]


def by_index(tiles: DataFrame, side: int) -> DataFrame:
    """Applies each tile's own transform (column transform, from 1): an optional flip, then a turn."""
    spec = F.get(F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(f).alias("flip")) for a, f in TRANSFORMS]), F.col("transform") - 1)
    rows = tiles.withColumn("_t", spec).withColumn("col", F.when(F.col("_t.flip"), F.lit(side - 1) - F.col("col")).otherwise(F.col("col")))
    return rotate(rows, F.col("_t.angle"), side).drop("_t")


def normalise(tiles: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), mean: float = 0.5, deviation: float = 0.5) -> DataFrame:
    return tiles.withColumns({c: (F.col(c) / 255.0 - mean) / deviation for c in channels})
