"""FROC curves, and their bounds over resampled lesions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.operators.metrics import running
from slidegrid.operators.regions import lesion_places, settled
from slidegrid.operators.resampling import drawn, first_drawn, spans


def froc_curve(false: DataFrame, regions: DataFrame, images: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """total_fps (false positives an image) and sensitivity at each distinct probability but the smallest, and the end (0, 0)."""
    w = F.col("weight") if "weight" in false.columns else F.lit(1)
    points = false.select(*by, "prob", w.alias("fp"), F.lit(0).alias("tp")).union(regions.where("not is_itc").select(*by, "prob", F.lit(0), (F.col("weight") if "weight" in regions.columns else F.lit(1))))
    counts = points.groupBy(*by, "prob").agg(F.sum("fp").alias("fp"), F.sum("tp").alias("tp"))
    sums = running(counts, by, [F.desc("prob")], ["fp", "tp"])
    n = images.agg(F.count("*").alias("n_images"))
    # The smallest probability is the one at which all points are in.
    before = sums.where("to_fp + to_tp < all_fp + all_tp")
    curve = before.crossJoin(n).select(*by, F.col("prob").alias("threshold"), (F.col("to_fp") / F.col("n_images")).alias("total_fps"), (F.col("to_tp") / F.nullif("all_tp", F.lit(0))).alias("sensitivity"))  # one row
    end = (counts.select(*by).distinct() if by else n.select()).select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("total_fps"), F.lit(0.0).alias("sensitivity"))
    return curve.unionByName(end)


def froc_score(curve: DataFrame, levels: tuple[float, ...] = (8, 4, 2, 1, 0.5, 0.25), by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over the levels of the best sensitivity at no more false positives an image."""
    best = [F.coalesce(F.max(F.when(F.col("total_fps") <= x, F.col("sensitivity"))), F.lit(0.0)) for x in levels]
    return curve.groupBy(*by).agg((sum(best[1:], best[0]) / len(levels)).alias("froc"))


def froc_samples(lesions: DataFrame, mask: DataFrame, itc: DataFrame, images: DataFrame, level: int, reps: int, seed: int) -> DataFrame:
    """FROC curves (rep, threshold, total_fps, sensitivity) of resampled lesions. Only lesions are drawn: a region that no drawn
    lesion hits counts as missed, with probability 0, so each replicate has all regions. False positives of one probability
    are one group of the draw, as are a region's hits of one probability and all lesions on isolated cells; of a region's groups,
    which fall in probability, the first drawn one counts."""
    at = lesion_places(lesions, mask, itc, level)
    false, lost = F.col("label") == 0, F.col("is_itc")
    kinds = at.select(F.when(false | lost, None).otherwise(F.col("slide_idx")).alias("slide_idx"), F.when(lost, -1).otherwise(F.col("label")).alias("label"), F.when(~lost, F.col("prob")).alias("prob"))
    groups = kinds.groupBy("slide_idx", "label", "prob").agg(F.count("*").alias("n"))
    order = [F.asc_nulls_first("slide_idx"), F.asc("label"), F.desc_nulls_first("prob")]
    whole = [*order[:2], F.desc_nulls_first(F.when(F.col("label") == 0, F.col("prob")))]  # a region's hits lie in one range
    placed, n = spans(groups, order, "n", whole)
    wrong = drawn(placed.where("label = 0"), n, reps, seed, "n", ["prob"])
    found = first_drawn(placed.where("label > 0"), n, reps, seed, "n", ["slide_idx", "label"], "prob")
    found = settled(found.groupBy("rep", "prob").agg(F.sum("weight").alias("weight")))
    every = mask.where("label > 0").select("slide_idx", "label").distinct().join(itc, ["slide_idx", "label"], "left_anti").agg(F.count("*").alias("all"))
    hits = found.groupBy("rep").agg(F.sum("weight").alias("hit"))
    missed = images.sparkSession.range(reps).select(F.col("id").cast("int").alias("rep")).crossJoin(every).join(hits, "rep", "left")  # one row
    missed = missed.select("rep", F.lit(0.0).alias("prob"), (F.col("all") - F.coalesce("hit", F.lit(0))).alias("weight")).where("weight > 0")
    regions = found.unionByName(missed).withColumn("is_itc", F.lit(False))
    return froc_curve(wrong.select("rep", "prob", "weight"), regions, images, ("rep",))
