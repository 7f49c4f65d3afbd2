"""Patch-index algebra: construction of patch rows, summaries, set operations, samples and splits.

Functions take and return DataFrames keyed by slide_idx; nothing is collected. Draws are md5-keyed, so a sample or a
split is the same in any partitioning and any run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidegrid.functions.draws import draw
from slidegrid.functions.folders import exists
from slidegrid.operators.regions import settled

#: High bits of a draw by which rows are dealt to buckets.
DRAW_BITS = 14
#: Draws that one task makes at a time.
STRETCH = 65_536
LABELS = {"background": 0, "normal": 1, "tumor": 2}


def grid_melt(grids: DataFrame, column: str = "grid") -> DataFrame:
    """Nested arrays as (row, col, value) rows beside the other columns."""
    others = [c for c in grids.columns if c != column]
    rows = grids.select(*others, F.posexplode(column).alias("row", "line"))
    return rows.select(*others, "row", F.posexplode("line").alias("col", "value"))


def pool2d(cells: DataFrame, kernel: int, stride: int, how: str = "max", keys: tuple[str, ...] = ("slide_idx",), value: str = "value", padding: int = 0) -> DataFrame:
    """Window maximum or mean, the grid enlarged by `padding` rows and columns of zeros on every side. Each cell is sent to the
    windows that cover it, one axis after the other, and combined before the shuffle; windows beyond the grid's last
    whole one are dropped, and of windows that reach beyond the grid the zeros count, too. Grids are not in a plan's estimate, so
    their sides are not to be broadcast."""
    sides = cells.groupBy(*keys).agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    first = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) + padding - kernel + 1) / stride)).cast("int")
    last = lambda c, side: F.least(F.floor((F.col(side) + 2 * padding - kernel) / stride), F.floor((F.col(c) + padding) / stride)).cast("int")
    rows = cells.join(sides.hint("merge"), list(keys)).where((first("row") <= last("row", "_h")) & (first("col") <= last("col", "_w")))
    rows = rows.select(*keys, F.explode(F.sequence(first("row"), last("row", "_h"))).alias("_r"), "col", "_h", "_w", value).select(*keys, "_r", F.explode(F.sequence(first("col"), last("col", "_w"))).alias("_c"), "_h", "_w", value)
    combined = F.max(value) if how == "max" else F.sum(value) / (kernel * kernel)
    if how == "max" and padding:
        beyond = lambda w, side: (F.col(w) * stride < padding) | (F.col(w) * stride + kernel > F.col(side) + padding)
        combined = F.max(F.when(beyond("_r", "_h") | beyond("_c", "_w"), F.greatest(F.col(value), F.lit(0))).otherwise(F.col(value)))
    return rows.groupBy(*keys, F.col("_r").alias("row"), F.col("_c").alias("col")).agg(combined.alias(value))


def grid_patches(labels: DataFrame, labels_level: int, patch_level: int, patch_size: int, stride: int, value: str = "label") -> DataFrame:
    """Patch rows of a label grid: each window of patch_size at patch_level gets its largest label."""
    scale = 1 << (labels_level - patch_level)
    kernel, step = -(-patch_size // scale), max(1, stride // scale)
    pooled = pool2d(labels, kernel, step, "max", value=value)
    return pooled.select("slide_idx", (F.col("col") * stride).alias("x"), (F.col("row") * stride).alias("y"), F.col(value).alias("label"))


def border_shift(patches: DataFrame, border: int, jitter: int, patch_size: int) -> DataFrame:
    """Moves patches up and left by half the border (rounded up) and the jitter; adds the output size."""
    shift = -(-border // 2) + jitter
    return patches.withColumn("x", F.col("x") - shift).withColumn("y", F.col("y") - shift).withColumn("patch_size", F.lit(patch_size + border + jitter))


def drop_background(patches: DataFrame) -> DataFrame:
    return patches.where(F.col("label") != 0)


def clip(patches: DataFrame, width: Column, height: Column) -> DataFrame:
    """Coordinates at least 0, then at most the slide's size less the patch's."""
    inside = lambda c, side: F.least(F.greatest(F.col(c), F.lit(0)), side - F.col("patch_size"))
    return patches.withColumn("x", inside("x", width)).withColumn("y", inside("y", height))


def transform_single(patches: DataFrame) -> DataFrame:
    return patches.withColumn("transform", F.lit(1))


def transform_multi(patches: DataFrame, n: int) -> DataFrame:
    return patches.withColumn("transform", F.explode(F.sequence(F.lit(1), F.lit(n))))


def transform_label(patches: DataFrame, label: int, n: int) -> DataFrame:
    """Rows of one label n times, numbered; others once."""
    turns = F.when(F.col("label") == label, F.sequence(F.lit(1), F.lit(n))).otherwise(F.array(F.lit(1)))
    return patches.withColumn("transform", F.explode(turns))


def patch_summary(patches: DataFrame, labels: dict[str, int] = LABELS) -> DataFrame:
    """One row: patches of each label, 0 where there are none."""
    return patches.agg(*[F.count_if(F.col("label") == k).alias(name) for name, k in labels.items()])


def slide_summary(slides: DataFrame, patches: DataFrame, labels: dict[str, int] = LABELS) -> DataFrame:
    """Counts of each label by slide; slides without patches stay."""
    counts = patches.groupBy("slide_idx").agg(*[F.count_if(F.col("label") == k).alias(name) for name, k in labels.items()])
    return slides.select("slide_idx", "slide_name", F.col("label").alias("slide_label")).join(counts, "slide_idx", "left").fillna(0, list(labels))


def index_union(indexes: list[DataFrame]) -> DataFrame:
    """UNION ALL of indexes, numbered by cps_idx."""
    out = indexes[0].withColumn("cps_idx", F.lit(0))
    for k, index in enumerate(indexes[1:], 1):
        out = out.unionByName(index.withColumn("cps_idx", F.lit(k)))
    return out


def subset_by_index(manifest: DataFrame, index: DataFrame) -> DataFrame:
    return manifest.join(index.select("slide_idx"), "slide_idx", "left_semi")


def filter_annotated(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.array_contains(F.transform(F.split("tags", ";"), F.trim), "annotated"))


def hard_negatives(patches: DataFrame, n: int, threshold: float = 0.5, normal_label: int = 1) -> DataFrame:
    """The n normal patches that the classifier is surest are tumor."""
    wrong = patches.where((F.col("tumor") > threshold) & (F.col("label") == normal_label))
    return wrong.orderBy(F.desc("tumor"), "slide_idx", "patch_seq").limit(n)


def _ranked(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _ranked_in_buckets(rows: DataFrame, bucket: Column, order: list[Column | str], by: list[str], cap: Column, caps: DataFrame | None = None) -> DataFrame:
    """Rows of rank up to cap, as _ranked gives it, for a bucket that grows with the order: a bucket's rows are sorted by
    themselves and numbered from the sum of the buckets before, and buckets past the cap are left out unsorted. cap may
    name a column of caps, one row."""
    keyed = rows.withColumn("_b", bucket)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    firsts = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n")).select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    firsts = (firsts.crossJoin(caps) if caps is not None else firsts).withColumn("_cap", cap).where("_first < _cap").select(*by, "_b", "_first", "_cap")
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    ranked = keyed.join(firsts, [*by, "_b"]).withColumn("rank", inside + F.col("_first"))
    return ranked.where("rank <= _cap").select(*rows.columns, "rank")


def _least_drawn(patches: DataFrame, seed: int, by: list[str], cap: Column, caps: DataFrame | None = None) -> DataFrame:
    """The rows of least draw of each class, in buckets by the high bits of the draw."""
    drawn = patches.withColumn("h", draw(seed, "slide_idx", "patch_seq"))
    return _ranked_in_buckets(drawn, F.shiftright("h", 32 - DRAW_BITS), ["h", "slide_idx", "patch_seq"], by, cap, caps).drop("h", "rank")


def sample_simple(patches: DataFrame, n: int, seed: int, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """n rows of each class without replacement: those of least draw."""
    return _least_drawn(patches, seed, list(by), F.lit(n))


def _stretches(counts: DataFrame, n: int) -> DataFrame:
    """Rows of counts (by label) with each k below n, made in stretches that are dealt to tasks first."""
    stretches = counts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // STRETCH)))).repartition("label", "_s")
    within = F.sequence(F.col("_s") * STRETCH, F.least((F.col("_s") + 1) * STRETCH, F.lit(n)) - 1)
    return stretches.withColumn("k", F.explode(within)).drop("_s")


def sample_replace(patches: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws of each class with replacement: draw k takes the row numbered by its hash modulo the class's count. Rows are
    numbered slide by slide, draws are made in stretches that are dealt to tasks first."""
    counts = patches.groupBy("label").agg(F.count("*").alias("n"))
    everything = F.lit(2**62)
    numbered = _ranked_in_buckets(patches, F.col("slide_idx"), ["patch_seq"], ["label"], everything)
    draws = _stretches(counts, n).select("label", "k", (draw(seed, "label", "k") % F.col("n") + 1).alias("rank"))
    return draws.join(numbered, ["label", "rank"]).select("label", "k", "slide_idx", "patch_seq", "tumor")


def sample_weighted(patches: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws of each class with replacement, weighted by one over the patches of the slide: a slide evenly, then one of its
    patches evenly."""
    inside = _ranked(patches, ["label", "slide_idx"], ["patch_seq"])
    per_slide = patches.groupBy("label", "slide_idx").agg(F.count("*").alias("n_patches"))
    slides_ = _ranked(per_slide, ["label"], ["slide_idx"]).withColumnRenamed("rank", "slide_rank")
    counts = per_slide.groupBy("label").agg(F.count("*").alias("n_slides"))
    draws = _stretches(counts, n).withColumn("slide_rank", (draw(f"{seed}s", "label", "k") % F.col("n_slides") + 1).cast("int"))
    hit = draws.join(slides_, ["label", "slide_rank"]).withColumn("rank", (draw(f"{seed}p", "label", "k") % F.col("n_patches") + 1).cast("int"))
    return hit.join(inside, ["label", "slide_idx", "rank"]).select("label", "k", "slide_idx", "patch_seq")


def balanced_sample(patches: DataFrame, most: int, least: int, seed: int) -> DataFrame:
    """Every class cut to the max(min(smallest class, most), least) rows of least draw."""
    counts = patches.groupBy("label").agg(F.count("*").alias("n"))
    cap = counts.agg(F.greatest(F.least(F.min("n"), F.lit(most)), F.lit(least)).alias("cap"))
    return _least_drawn(patches, seed, ["label"], F.col("cap"), cap)


def split_stratified(slides: DataFrame, share: float, seed: int, stratum: str = "label") -> DataFrame:
    """Adds split: of each stratum the whole part of count * share goes to train, in order of draw."""
    drawn = _ranked(slides.withColumn("h", draw(seed, "slide_idx")), [stratum], ["h", "slide_idx"])
    counted = drawn.withColumn("n", F.count("*").over(Window.partitionBy(stratum)))
    return counted.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("n") * share), "train").otherwise("valid")).drop("h", "rank", "n")


def split_grouped(slides: DataFrame, share: float, seed: int) -> DataFrame:
    """Splits by patient, with the share held among patients that have an annotated slide and among all: whole parts of both
    counts, so train gets floor(all * share) - floor(annotated * share) patients without annotations."""
    patients = slides.groupBy("patient").agg(F.max("annotated").alias("has"))
    totals = patients.agg(F.count("*").alias("everyone"), F.count_if("has").alias("having"))
    drawn = _ranked(patients.withColumn("h", draw(seed, "patient")), ["has"], ["h", "patient"]).crossJoin(totals)  # one row
    having = F.floor(F.col("having") * share)
    quota = F.when(F.col("has"), having).otherwise(F.floor(F.col("everyone") * share) - having)
    named = drawn.select("patient", F.when(F.col("rank") <= quota, "train").otherwise("valid").alias("split"))
    return slides.join(named, "patient")


def split_by_tag(slides: DataFrame, place: int = 2, names: tuple[str, ...] = ("train", "valid")) -> DataFrame:
    """The tag at a place of the tags as split; rows with other tags there are left out."""
    tag = F.get(F.split("tags", ";"), F.lit(place - 1))
    return slides.withColumn("split", tag).where(F.col("split").isin(*names))


def split_balance_check(split: DataFrame, patches: DataFrame, share: float, positive: int = 2, tolerance: float = 0.05) -> DataFrame:
    """One row: positive patches in train and in all, whether the share is kept within tolerance, and whether train has a
    positive slide."""
    per_slide = patches.groupBy("slide_idx").agg(F.count_if(F.col("label") == positive).alias("n"))
    joined = split.select("slide_idx", "split").join(per_slide, "slide_idx", "left").fillna(0, ["n"])
    sums = joined.agg(F.sum(F.when(F.col("split") == "train", F.col("n")).otherwise(0)).alias("train_positive"), F.sum("n").alias("all_positive"), (F.count_if((F.col("split") == "train") & (F.col("n") > 0)) > 0).alias("has_positive_slide"))
    low, high = share * (1 - tolerance), share * (1 + tolerance)
    return sums.withColumn("balanced", (F.col("train_positive") >= F.col("all_positive") * low) & (F.col("train_positive") <= F.col("all_positive") * high))


def split_class_matrix(split: DataFrame, classes: tuple[str, ...], column: str = "label") -> DataFrame:
    """Slides of each class in train, valid and total, and whether a class is empty."""
    counts = split.rollup("split").agg(*[F.count_if(F.col(column) == c).alias(c) for c in classes])
    empty = F.array_min(F.array(*[F.col(c) for c in classes])) < 1
    return counts.select(F.coalesce("split", F.lit("total")).alias("split"), *classes, empty.alias("has_empty_class"))


def softmax(logits: Column) -> Column:
    """Of an array of logits, shifted by their maximum."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x))


def score_attach(patches: DataFrame, scores: DataFrame) -> DataFrame:
    return patches.join(scores, ["slide_idx", "patch_seq"])


LEDGER = "slide_idx long, expected long, written long, run string"


def score_resume(index: DataFrame, folder: str, score: Callable[[DataFrame], DataFrame], run: str) -> DataFrame:
    """Results of all patches of an index, in folder/results: scores those that are missing and adds them. What is done is
    told by folder/ledger (slide_idx, expected, written, run), to which a run adds its slides only after their results
    are there; slides that the ledger has in full are not looked at again. Of others, a run that died may have left
    some patches, in finished files only: these are kept, and the missing ones are scored. score gives slide_idx,
    patch_seq and what else results hold."""
    spark = index.sparkSession
    results, ledger = f"{folder}/results", f"{folder}/ledger"
    wanted = index.groupBy("slide_idx").agg(F.count("*").alias("expected"))
    if exists(spark, ledger):
        noted = spark.read.schema(LEDGER).parquet(ledger).groupBy("slide_idx").agg(F.max("written").alias("noted"))
        wanted = wanted.join(noted, "slide_idx", "left").where("noted is null or noted < expected").drop("noted")
    wanted = settled(wanted)
    todo = index.join(wanted.select("slide_idx"), "slide_idx", "left_semi")
    if exists(spark, results):
        todo = todo.join(spark.read.parquet(results).select("slide_idx", "patch_seq"), ["slide_idx", "patch_seq"], "left_anti")
    score(settled(todo)).write.mode("append").parquet(results)
    found = spark.read.parquet(results)
    written = found.join(wanted.select("slide_idx"), "slide_idx", "left_semi").groupBy("slide_idx").agg(F.count_distinct("patch_seq").alias("written"))
    entry = wanted.join(written, "slide_idx", "left").select("slide_idx", "expected", F.coalesce("written", F.lit(0)).cast("long").alias("written"), F.lit(run).alias("run"))
    entry.write.mode("append").parquet(ledger)
    return found


def tta_average(scored: DataFrame, classes: tuple[str, ...] = ("normal", "tumor")) -> DataFrame:
    """Mean probabilities over the transforms of a patch; its label stays."""
    return scored.groupBy("slide_idx", "x", "y").agg(F.max("label").alias("label"), *[F.avg(c).alias(c) for c in classes])


def argmax_class(scored: DataFrame, classes: tuple[str, ...] = ("normal", "tumor")) -> DataFrame:
    """Adds predicted, the class of largest probability, first of ties."""
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("p"), F.lit(-k).alias("o"), F.lit(c).alias("name")) for k, c in enumerate(classes)]))
    return scored.withColumn("predicted", best["name"])
