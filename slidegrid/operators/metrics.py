"""Evaluation of patch, slide and patient predictions: confusion counts, curves, areas, bootstrap intervals, staging, kappa.

Curves need running sums over all rows in order of score. They are taken in two steps: rows are counted by score and cut
into ranges at sampled places, the ranges' totals (few) are summed in order, and a range's rows are summed in one task, so
no task sees all rows. Areas and interpolation go through ranges of the points in the same way. Bootstrap replicates are a
column, not a loop; rows that a report can't tell apart are counted first, and each replicate's share of them is drawn
where they lie (operators/resampling.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidegrid.operators.regions import settled
from slidegrid.operators.resampling import resample, resampled_curves

STAGES = ("negative", "itc", "micro", "macro")
PATIENT_STAGES = ("pN0", "pN0(i+)", "pN1mi", "pN1", "pN2")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def patch_metrics(rows: DataFrame, positive: int = 2, score: str = "tumor", threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, tn, fp, fn, tp, recall, specificity and precision of score >= threshold, in one pass."""
    said, is_ = F.col(score) >= threshold, F.col("label") == positive
    w = F.col("weight") if "weight" in rows.columns else F.lit(1)
    count = lambda c: F.sum(F.when(c, w).otherwise(0))
    out = rows.groupBy(*by).agg(count(~said & ~is_).alias("tn"), count(said & ~is_).alias("fp"), count(~said & is_).alias("fn"), count(said & is_).alias("tp"))
    c = F.col
    return out.select(
        *by, ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"), "tn", "fp", "fn", "tp",
        ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(c("tn"), c("tn") + c("fp")).alias("specificity"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
    )


def confusion_matrix(rows: DataFrame, vocabulary: tuple, true: str = "label", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of all pairs of a vocabulary, zeros included, other values ignored; groups of by each have all pairs."""
    values = F.explode(F.array(*[F.lit(v) for v in vocabulary]))
    counts = rows.groupBy(*by, F.col(true).alias("true_label"), F.col(predicted).alias("pred_label")).agg(F.sum("weight" if "weight" in rows.columns else F.lit(1)).alias("n"))
    base = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    pairs = base.select("*", values.alias("true_label")).select("*", values.alias("pred_label"))
    return pairs.join(counts, [*by, "true_label", "pred_label"], "left").fillna(0, ["n"])


def confusion_normalised(matrix: DataFrame, over: str = "true") -> DataFrame:
    """Adds share, of the row's total (true), the column's (pred) or all (percent)."""
    keys = {"true": ["true_label"], "pred": ["pred_label"], "percent": []}[over]
    total = F.sum("n").over(Window.partitionBy(*keys))  # a vocabulary's square of rows
    return matrix.withColumn("share", ratio(F.col("n"), total))


def metrics_multi(rows: DataFrame, vocabulary: tuple, true: str = "label", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """One row: accuracy and a column true_X_pred_Y for each pair."""
    w = F.col("weight") if "weight" in rows.columns else F.lit(1)
    cells = [F.sum(F.when((F.col(true) == a) & (F.col(predicted) == b), w).otherwise(0)).alias(f"true_{a}_pred_{b}") for a in vocabulary for b in vocabulary]
    return rows.groupBy(*by).agg(ratio(F.sum(F.when(F.col(true) == F.col(predicted), w).otherwise(0)), F.sum(w)).alias("accuracy"), *cells)


def running(counts: DataFrame, by: tuple[str, ...], order: list[Column], columns: list[str]) -> DataFrame:
    """Adds to_X, the sum of X up to a row in the order, and all_X, the sum over all rows of a group of by, for each column. Rows
    are cut into ranges of the order at sampled places, so that ranges are alike however the values lie; a range's rows
    are summed on their own and moved by the totals of the ranges before."""
    ranged = _ranged(counts, by, order)
    before, whole = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)  # a row for each range
    sums = ranged.groupBy(*by, "_p").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    sums = sums.select(*by, "_p", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns], *[F.sum(f"_sum_{c}").over(whole).alias(f"all_{c}") for c in columns])
    inside = Window.partitionBy(*by, "_p").orderBy(*order)
    joined = ranged.join(sums, [*by, "_p"])
    return joined.select(*counts.columns, *[(F.col(f"_before_{c}") + F.sum(c).over(inside)).alias(f"to_{c}") for c in columns], *[f"all_{c}" for c in columns])


def binary_curve(rows: DataFrame, score: str, positive: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """One point for each distinct score, highest first: threshold, tp and fp so far, precision, recall, fpr. Ties are one
    point."""
    w = F.col("weight") if "weight" in rows.columns else F.lit(1)
    counts = rows.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(F.when(positive, w).otherwise(0)).alias("p"), F.sum(F.when(positive, 0).otherwise(w)).alias("n"))
    run = running(counts, by, [F.desc("threshold")], ["p", "n"]).withColumns({"tp": F.col("to_p"), "fp": F.col("to_n")})
    return run.select(*by, "threshold", "tp", "fp", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("all_p")).alias("recall"), ratio(F.col("fp"), F.col("all_n")).alias("fpr"))


def _ranged(points: DataFrame, by: tuple[str, ...], order: list[Column]) -> DataFrame:
    """points with _p, the range of the order that a row lies in; written, so that ranges hold when read again."""
    return settled(points.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))


def curve_auc(curve: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Trapezoid area under the points in order of x, then of falling threshold: areas within ranges of the order, and
    between the last point of a range and the first of the next."""
    order = [F.asc(x), F.desc("threshold")]
    points = _ranged(curve.select(*by, "threshold", x, y), by, order)
    inside, between = Window.partitionBy(*by, "_p").orderBy(*order), Window.partitionBy(*by).orderBy("_p")  # a row for each range
    area = lambda x0, y0, x1, y1: (x1 - x0) * (y1 + y0) / 2
    within = points.select(*by, area(F.lag(x).over(inside), F.lag(y).over(inside), F.col(x), F.col(y)).alias("area"))
    end = F.struct(F.col(x).alias("x"), (-F.col("threshold")).alias("t"), F.col(y).alias("y"))
    ends = points.groupBy(*by, "_p").agg(F.min(end).alias("a"), F.max(end).alias("z")).withColumn("z", F.lag("z").over(between))
    gaps = ends.select(*by, area(F.col("z.x"), F.col("z.y"), F.col("a.x"), F.col("a.y")).alias("area"))
    return within.unionByName(gaps).groupBy(*by).agg(F.sum("area").alias("auc"))


def interp_curve(curve: DataFrame, levels: DataFrame, x: str, y: str, by: tuple[str, ...] = (), tie: str = "threshold") -> DataFrame:
    """Linear interpolation of a curve at levels (by, level), ends held: an as-of join of both sorted together, within
    ranges of the order, which take over the last point of the ranges before and the first of those after."""
    points = curve.select(*by, F.col(x).alias("x"), F.lit(0).alias("is_level"), F.col(tie).alias("tie"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("pt"))
    asked = levels.select(*by, F.col("level").alias("x"), F.lit(1).alias("is_level"), F.lit(None).cast("double").alias("tie"), F.lit(None).cast(points.schema["pt"].dataType).alias("pt"))
    order = [F.asc("x"), F.asc("is_level"), F.desc("tie")]
    both = _ranged(points.unionByName(asked), by, order)
    place = F.when(F.col("is_level") == 0, F.struct("x", F.col("tie").isNull().alias("last"), (-F.col("tie")).alias("t"), "pt"))
    ends = both.groupBy(*by, "_p").agg(F.min(place)["pt"].alias("first"), F.max(place)["pt"].alias("last"))
    ranges = Window.partitionBy(*by).orderBy("_p")  # a row for each range
    ends = ends.select(*by, "_p", F.last("last", True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", True).over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    w = Window.partitionBy(*by, "_p").orderBy(*order)
    back = Window.partitionBy(*by, "_p").orderBy(F.desc("x"), F.desc("is_level"), F.asc("tie"))  # a frame that follows would be read anew for each row
    both = both.withColumn("lo", F.last("pt", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.last("pt", True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    both = both.where("is_level = 1").join(ends, [*by, "_p"]).withColumn("lo", F.coalesce("lo", "earlier")).withColumn("hi", F.coalesce("hi", "later"))
    lo, hi = F.col("lo"), F.col("hi")
    between = lo["y"] + (F.col("x") - lo["x"]) * (hi["y"] - lo["y"]) / F.nullif(hi["x"] - lo["x"], F.lit(0.0))
    value = F.when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).otherwise(F.coalesce(between, lo["y"]))
    return both.select(*by, F.col("x").alias("level"), value.alias("value"))


def bootstrap(rows: DataFrame, key: list[str], reps: int, seed: int) -> DataFrame:
    """reps resamples of the size of rows, with replacement: rep and weight (how often the row was drawn). The key orders rows
    and is one row's own."""
    return resample(rows, [F.asc(k) for k in key], reps, seed)


def percentile_ci(samples: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows ci_lower_bound and ci_upper_bound: exact 2.5 and 97.5 percentiles of each column."""
    aggregated = samples.groupBy(*by).agg(*[F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(c) for c in columns])
    names = F.explode(F.array(F.struct(F.lit("ci_lower_bound").alias("row_name"), F.lit(0).alias("i")), F.struct(F.lit("ci_upper_bound").alias("row_name"), F.lit(1).alias("i"))))
    return aggregated.select("*", names.alias("r")).select(*by, "r.row_name", *[F.get(c, F.col("r.i")).alias(c) for c in columns])


def by_score(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """threshold (each distinct score), p and n, its positive and negative rows."""
    return rows.groupBy(F.col(score).alias("threshold")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))


def _sampled(rows: DataFrame, reps: int, seed: int, x: str, y: str, levels: int, skip: int, **how) -> tuple[DataFrame, DataFrame]:
    """Figures of all samples (counts, and the area under y over the levels of x from number `skip` on), and y at the levels."""
    at = [k / levels for k in range(levels + 1)]
    figures, values = resampled_curves(by_score(rows, "score", F.col("label") == 1), reps, seed, x, y, at, **how)
    ends = F.when((F.col("k") == skip) | (F.col("k") == levels), F.col("value") / 2).otherwise(F.col("value"))
    areas = values.where(F.col("k") >= skip).groupBy("rep").agg((F.sum(ends) / levels).alias("auc"))
    return settled(figures.join(areas, "rep", "left")), values


def slide_report(rows: DataFrame, reps: int, seed: int, cutoff: float = 0.9, levels: int = 100) -> DataFrame:
    """The whole report of two-class slides (label 0 or 1, score in [0, 1]; positive is a score above the cutoff), told apart
    by row_name: results and each sample_i with accuracy, tn, fp, fn, tp and auc; their ci_lower_bound and ci_upper_bound;
    curve, the ROC points (threshold, fpr, tpr); curve_ci, bounds of tpr at levels of fpr. Areas and levels count from the
    curve's origin, so that a tie at the highest score has its area; a sample's area is that of its levels. Samples of one
    class have no curve."""
    names = ["accuracy", "tn", "fp", "fn", "tp", "auc"]
    rows = settled(rows)
    points = settled(binary_curve(rows, "score", F.col("label") == 1).where("fpr is not null and recall is not null").select("threshold", "fpr", "recall"))
    origin = rows.agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("recall"), F.min("label").alias("a"), F.max("label").alias("b"))
    whole = points.unionByName(origin.where("a <> b").drop("a", "b"))
    said = rows.withColumn("said", (F.col("score") > cutoff).cast("int"))
    results = patch_metrics(said, positive=1, score="said").select(*names[:-1]).crossJoin(curve_auc(whole, "fpr", "recall"))  # one row each
    samples, values = _sampled(rows, reps, seed, "fpr", "recall", levels, 0, threshold=cutoff, strict=True, origin=True)
    out = named_rows(results, with_accuracy(samples), names)
    out = out.unionByName(points.select(F.lit("curve").alias("row_name"), "threshold", "fpr", F.col("recall").alias("tpr")), True)
    return out.unionByName(band(values, "fpr", "tpr").withColumn("row_name", F.lit("curve_ci")), True)


def with_accuracy(counts: DataFrame) -> DataFrame:
    """Adds accuracy, recall, specificity and precision to tn, fp, fn and tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp)})


def named_rows(results: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """Figures as doubles by row_name: results, the bounds of their samples (by rep), and each sample_i."""
    out = results.withColumn("row_name", F.lit("results")).unionByName(percentile_ci(samples, columns), True)
    out = out.unionByName(samples.withColumn("row_name", F.concat(F.lit("sample_"), "rep")).drop("rep"), True)
    return out.select("row_name", *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])


def band(at: DataFrame, level: str, out: str) -> DataFrame:
    """Bounds out_lower and out_upper over the replicates of the values at each level."""
    bounds = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return at.groupBy("level").agg(bounds.alias("b")).select(F.col("level").alias(level), F.get("b", F.lit(0)).alias(f"{out}_lower"), F.get("b", F.lit(1)).alias(f"{out}_upper"))


def levels_of(reps: DataFrame, first: int, last: int, scale: float) -> DataFrame:
    """Levels k / scale, k from first to last, of each row of reps."""
    return reps.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("k")).select(*reps.columns, (F.col("k") / float(scale)).alias("level"))


PATCH_FIGURES = ["accuracy", "tn", "fp", "fn", "tp", "recall", "specificity", "precision", "auc"]


def patch_report(rows: DataFrame, reps: int, seed: int, threshold: float = 0.5, levels: int = 1000) -> DataFrame:
    """The whole report of patches (label 0 or 1, score in [0, 1]), told apart by row_name: results and samples with their
    bounds; curve, the precision-recall points (threshold, recall, precision); curve_ci, bounds of precision at levels of
    recall. A sample's area is that of its levels but the first. Samples without a positive row have no curve."""
    rows = settled(rows)
    points = settled(binary_curve(rows, "score", F.col("label") == 1).where("recall is not null").select("threshold", "recall", "precision"))
    samples, values = _sampled(rows, reps, seed, "recall", "precision", levels, 1, threshold=threshold)
    results = patch_metrics(rows, positive=1, score="score", threshold=threshold).crossJoin(curve_auc(points, "recall", "precision"))  # one row each
    out = named_rows(results, with_accuracy(samples), PATCH_FIGURES)
    out = out.unionByName(points.select(F.lit("curve").alias("row_name"), "threshold", F.col("recall").alias("level"), F.col("precision").alias("value")), True)
    return out.unionByName(band(values, "level", "value").withColumn("row_name", F.lit("curve_ci")), True)


def cells(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """n, the rows of each pair of a true and a predicted value."""
    return rows.groupBy(true, predicted).agg(F.count("*").alias("n"))


def resampled_cells(rows: DataFrame, reps: int, seed: int, true: str, predicted: str) -> DataFrame:
    """rep, weight and the pairs: how many rows of each pair a replicate drew."""
    return resample(cells(rows, true, predicted), [F.asc_nulls_first(true), F.asc_nulls_first(predicted)], reps, seed, "n").drop("n")


def multi_report(rows: DataFrame, reps: int, seed: int, vocabulary: tuple, true: str, predicted: str, kappa: bool = False) -> DataFrame:
    """results, bounds and samples by row_name: accuracy, or the weighted kappa with the vocabulary in its order, and the
    cells true_X_pred_Y."""
    rows = settled(rows.select(true, predicted))
    drawn = settled(resampled_cells(rows, reps, seed, true, predicted))

    def of(r: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        counted = metrics_multi(r, vocabulary, true, predicted, by)
        if not kappa:
            return counted
        weighed = kappa_quadratic(r, true, predicted, vocabulary, by)
        return (weighed.join(counted, list(by)) if by else weighed.crossJoin(counted)).drop("accuracy")  # one row each

    figures = ["kappa" if kappa else "accuracy", *[f"true_{a}_pred_{b}" for a in vocabulary for b in vocabulary]]
    return named_rows(of(rows), settled(of(drawn, ("rep",))), figures)


def slide_metrics(rows: DataFrame, classes: tuple[str, ...], reps: int, seed: int, cutoff: float = 0.9) -> DataFrame:
    """The report that the number of classes asks for. Two classes (the second is positive): slide_report of label and score.
    More: multi_report of label and prediction, classes in their order."""
    if len(classes) == 2:
        return slide_report(rows.select((F.col("label") == classes[1]).cast("int").alias("label"), "score"), reps, seed, cutoff)
    return multi_report(rows, reps, seed, classes, "label", "prediction")


def patient_stage(slides: DataFrame, predicted: str = "prediction", per_patient: int = 5) -> DataFrame:
    """Stages patients by their slides: pN2 for a macro and at least four positive slides, pN1 for a macro, pN1mi for a
    micro, pN0(i+) for isolated cells, pN0 if all are negative; none (null) where a slide's prediction is not a known stage and
    no rule above holds. complete: the patient has all slides; unknown: some prediction is not a stage."""
    is_ = lambda v: F.count_if(F.col(predicted) == v)
    n = slides.groupBy("patient").agg(F.count("*").alias("n_slides"), is_("macro").alias("macro"), is_("micro").alias("micro"), is_("itc").alias("itc"), is_("negative").alias("negative"), F.min("patient_stage").alias("true_stage"))
    stage = F.when((F.col("macro") > 0) & (F.col("macro") + F.col("micro") >= 4), "pN2").when(F.col("macro") > 0, "pN1").when(F.col("micro") > 0, "pN1mi").when(F.col("itc") > 0, "pN0(i+)").when(F.col("negative") == F.col("n_slides"), "pN0")
    known = F.col("macro") + F.col("micro") + F.col("itc") + F.col("negative")
    return n.select("patient", stage.alias("predicted_stage"), "true_stage", (F.col("n_slides") == per_patient).alias("complete"), (known < F.col("n_slides")).alias("unknown"))


def kappa_quadratic(rows: DataFrame, true: str = "true_stage", predicted: str = "predicted_stage", order: tuple[str, ...] = PATIENT_STAGES, by: tuple[str, ...] = ()) -> DataFrame:
    """Quadratically weighted kappa, classes in clinical order. Its sums need the classes' moments only: with places i and j,
    sum w O = n (mean of (i - j)^2) and sum w E = n (var i + var j + (mean i - mean j)^2)."""
    place = lambda c: (F.array_position(F.array(*map(F.lit, order)), F.col(c)) - 1).cast("double")
    w = F.col("weight") if "weight" in rows.columns else F.lit(1)
    p = rows.select(*by, place(true).alias("i"), place(predicted).alias("j"), w.cast("double").alias("w")).where("i >= 0 and j >= 0")
    mean = lambda c: F.sum(c * F.col("w")) / F.sum("w")
    i, j = F.col("i"), F.col("j")
    sums = p.groupBy(*by).agg(mean((i - j) * (i - j)).alias("o"), mean(i * i).alias("ii"), mean(j * j).alias("jj"), mean(i).alias("mi"), mean(j).alias("mj"))
    expected = F.col("ii") + F.col("jj") - 2 * F.col("mi") * F.col("mj")
    return sums.select(*by, (1 - ratio(F.col("o"), expected)).alias("kappa"))


def kappa_validated(reference: DataFrame, submission: DataFrame, order: tuple[str, ...] = PATIENT_STAGES) -> DataFrame:
    """Kappa of stage tables (patient, stage): rows of patients (.zip) only, case ignored, unknown stages an error."""
    low = tuple(s.lower() for s in order)

    def clean(rows: DataFrame, name: str) -> DataFrame:
        stage = F.lower("stage")
        known = F.when(stage.isin(*low), stage).otherwise(F.raise_error(F.concat(F.lit("unknown stage "), F.coalesce(stage, F.lit("null")))).cast("string"))
        return rows.where(F.lower("patient").endswith(".zip")).select(F.lower("patient").alias("patient"), known.alias(name))

    both = clean(reference, "true_stage").join(clean(submission, "predicted_stage"), "patient")
    return kappa_quadratic(both, order=low)
