"""Pixel tables (slide_idx, row, col and channels): colour, thresholds, masks, morphology, filters and features.

Separable filters turn the lines of an axis to arrays, a shuffle for each axis; medians go by tiles (operators/tiles.py). Borders reflect (d c b a | a b c d | d c b a) unless said otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidegrid.operators.regions import CELL, components
from slidegrid.operators.tiles import picture_features


def downsample(pixels: DataFrame, factor: int, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Block means; partial edge blocks count what they have."""
    at = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return pixels.groupBy("slide_idx", at("row"), at("col")).agg(*[F.avg(c).alias(c) for c in channels])


def level_shape(levels: DataFrame, wanted: int) -> DataFrame:
    """Height and width at a level: of the highest stored level not above it, halved for what is missing."""
    usable = levels.where(F.col("level") <= wanted)
    best = usable.groupBy("slide_idx").agg(F.max_by(F.struct("level", "height", "width"), "level").alias("s"))
    shrink = F.lit(1).cast("long") * F.pow(F.lit(2.0), wanted - F.col("s.level"))
    return best.select("slide_idx", F.col("s.level").alias("from_level"), F.floor(F.col("s.height") / shrink).alias("height"), F.floor(F.col("s.width") / shrink).alias("width"))


def hsv(pixels: DataFrame) -> DataFrame:
    """Adds h, s and v in [0, 1]."""
    r, g, b = (F.col(c) / 255.0 for c in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, 0.0).when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, 2.0 + (b - r) / d).otherwise(4.0 + (r - g) / d) / 6.0
    return pixels.withColumn("h", h).withColumn("s", F.when(top == 0, 0.0).otherwise(d / F.nullif(top, F.lit(0.0)))).withColumn("v", top)


def gray(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("gray", (F.col("r") * 0.2125 + F.col("g") * 0.7154 + F.col("b") * 0.0721) / 255.0)


def black_to_white(pixels: DataFrame) -> DataFrame:
    black = (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)
    return pixels.select("slide_idx", "row", "col", *[F.when(black, 255).otherwise(F.col(c)).alias(c) for c in "rgb"])


def otsu(pixels: DataFrame, channel: str, bins: int = 256) -> DataFrame:
    """(slide_idx, threshold): the centre of the first histogram bin that maximises the variance between what is up to it and
    above it. A constant channel's threshold is its value."""
    return _otsu(pixels, {channel: "threshold"}, bins)


def _otsu(pixels: DataFrame, outs: dict[str, str], bins: int = 256) -> DataFrame:
    """Thresholds {channel: out} of a slide, of all channels in one pass of ends and one of counts. Only bins that hold a pixel
    are made: an empty one has the variance of the bin before it, so it is never the first with the greatest, and the first
    bin holds the least value."""
    kinds = list(outs)
    ends = pixels.groupBy("slide_idx").agg(*[f(c).cast("double").alias(f"_{n}{k}") for k, c in enumerate(kinds) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = pixels.select("slide_idx", *kinds).join(ends, "slide_idx")
    lo, hi = F.col("lo"), F.col("hi")
    width = (hi - lo) / float(bins)
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_lo{k}").alias("lo"), F.col(f"_hi{k}").alias("hi"), F.col(c).cast("double").alias("v")) for k, c in enumerate(kinds)]))
    rows = rows.select("slide_idx", value.alias("s")).select("slide_idx", "s.*")
    bin_ = F.when(hi == lo, 0).otherwise(F.least(F.floor((F.col("v") - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    h = rows.groupBy("slide_idx", "k", "lo", "hi", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n")).withColumn("centre", lo + (F.col("bin") + 0.5) * width)
    whole, up = Window.partitionBy("slide_idx", "k"), Window.partitionBy("slide_idx", "k").orderBy("bin")
    m = F.col("n") * (F.col("bin") + 0.5)
    h = h.withColumn("w1", F.sum("n").over(up)).withColumn("m1", F.sum(m).over(up)).withColumn("w", F.sum("n").over(whole)).withColumn("m", F.sum(m).over(whole))
    w2 = F.col("w") - F.col("w1")
    gap = F.col("m1") / F.nullif("w1", F.lit(0)) - (F.col("m") - F.col("m1")) / F.nullif(w2, F.lit(0))
    between = F.coalesce(F.round(F.col("w1") * w2 * gap * gap, 6), F.lit(-1.0))
    at = F.when(hi == lo, lo).otherwise(F.col("centre"))
    best = [F.max_by(F.when(F.col("k") == k, at), F.when(F.col("k") == k, F.struct(between, -F.col("bin")))).alias(out) for k, out in enumerate(outs.values())]
    return h.groupBy("slide_idx").agg(*best)


def mask_otsu(pixels: DataFrame, compat: bool = False) -> DataFrame:
    """Tissue where saturation is above its threshold or hue above its own; compat holds saturation against both."""
    p = hsv(pixels).select(*CELL, "h", "s")
    joined = p.join(_otsu(p, {"h": "th", "s": "ts"}), "slide_idx")
    return joined.select(*CELL, ((F.col("s" if compat else "h") > F.col("th")) | (F.col("s") > F.col("ts"))).alias("mask"))


def mask_grey(pixels: DataFrame, level: float = 0.8) -> DataFrame:
    return gray(pixels).select(*CELL, (F.col("gray") <= level).alias("mask"))


def mask_all(pixels: DataFrame) -> DataFrame:
    return pixels.select(*CELL, F.lit(True).alias("mask"))


def _sides(cells: DataFrame) -> DataFrame:
    return cells.groupBy("slide_idx").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))


def _mirrored(at: Column, n: Column) -> Column:
    """A place reflected at the borders 0 and n, the border cells repeated."""
    place = F.pmod(at, 2 * n)
    return F.when(place < n, place).otherwise(2 * n - 1 - place)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [(k - radius, w / sum(raw)) for k, w in enumerate(raw)]


def convolve_lines(cells: DataFrame, along: str, outs: dict[str, tuple[str, list[tuple[int, float]]]], border: str = "reflect") -> DataFrame:
    """Adds (or replaces) columns of weighted sums along one axis, {out: (value, weights by step)}: a slide's line becomes an
    array, so all sums of an axis take one shuffle and no cell is sent twice. Pixel tables are full rectangles, a line is
    bounded by the slide's side. Borders reflect, or repeat the border cell (nearest)."""
    fixed = "col" if along == "row" else "row"
    others = [c for c in cells.columns if c not in ("slide_idx", fixed)]
    ordered = F.array_sort(F.collect_list(F.struct(along, *[c for c in others if c != along])))
    lines = cells.groupBy("slide_idx", fixed).agg(ordered.alias("_line")).withColumn("_n", F.size("_line"))
    field = lambda c: F.transform("_line", lambda p: p[c])
    lines = lines.select("*", *[field(v).cast("array<double>").alias(f"_of_{v}") for v in dict.fromkeys(v for v, _ in outs.values())])

    def summed(value: str, weights: list[tuple[int, float]]):
        def at(_, i: Column) -> Column:
            place = lambda k: _mirrored(i + k, F.col("_n")) if border == "reflect" else F.greatest(F.lit(0), F.least(i + k, F.col("_n") - 1))
            taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in weights])
            return F.aggregate(taps, F.lit(0.0), lambda total, t: total + t["w"] * F.get(f"_of_{value}", place(t["k"]).cast("int")))

        return F.transform(f"_of_{value}", at)

    kept = [c for c in others if c not in outs]
    lines = lines.select("slide_idx", fixed, *[field(c).alias(c) for c in kept], *[summed(*how).alias(out) for out, how in outs.items()])
    zipped = lines.select("slide_idx", fixed, F.explode(F.arrays_zip(*kept, *outs)).alias("_z"))
    return zipped.select("slide_idx", fixed, *[F.col("_z")[c].alias(c) for c in (*kept, *outs)])


def gaussian(cells: DataFrame, sigma: float, value: str, border: str = "reflect") -> DataFrame:
    """Gaussian blur as two passes of one axis each."""
    w = gaussian_weights(sigma)
    return convolve_lines(convolve_lines(cells.select(*CELL, value), "row", {value: (value, w)}, border), "col", {value: (value, w)}, border)


def _spread(mask: DataFrame, steps: list[tuple[int, int]], how: Callable[[str], Column]) -> DataFrame:
    """Each cell's maximum or minimum over its neighbours at the steps; what is beyond the border has no say."""
    moved = F.explode(F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j")) for i, j in steps]))
    rows = mask.select("slide_idx", "row", "col", "mask", moved.alias("s")).select("slide_idx", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), "mask")
    return mask.select(*CELL).join(rows.groupBy(*CELL).agg(how("mask").alias("mask")), CELL)


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def dilate(mask: DataFrame, steps: list[tuple[int, int]] = CROSS) -> DataFrame:
    return _spread(mask, steps, F.max)


def erode(mask: DataFrame, steps: list[tuple[int, int]] = CROSS) -> DataFrame:
    """Cells beyond the border count as set."""
    return _spread(mask, [(-i, -j) for i, j in steps], F.min)


def mask_close(mask: DataFrame) -> DataFrame:
    """Closing by a cross: dilation, then erosion."""
    return erode(dilate(mask))


def mask_close_sized(mask: DataFrame, level: int, expand: float = 50.0, level_zero_size: float = 0.25) -> DataFrame:
    """Closing by a square of ceil(expand / (2^level * level_zero_size)) cells, one axis after the other, by window ranges."""
    k = math.ceil(expand / (2**level * level_zero_size))
    before, after = k // 2, k - 1 - k // 2

    def pass_(m: DataFrame, how, lo: int, hi: int) -> DataFrame:
        for fixed, moving in (("row", "col"), ("col", "row")):
            w = Window.partitionBy("slide_idx", fixed).orderBy(moving).rangeBetween(-lo, hi)
            m = m.withColumn("mask", how("mask").over(w))
        return m

    return pass_(pass_(mask, F.max, before, after), F.min, after, before)


def mask_fill_holes(mask: DataFrame, level: int, hole: float = 250.0, level_zero_size: float = 0.25) -> DataFrame:
    """Background regions of fewer cells than hole / (2^level * level_zero_size) become tissue."""
    most = hole / (2**level * level_zero_size)
    holes = components(mask.where("not mask").select(*CELL))
    small = holes.groupBy("slide_idx", "comp").agg(F.count("*").alias("n")).where(F.col("n") < most)
    filled = holes.join(small, ["slide_idx", "comp"]).select(*CELL, F.lit(True).alias("fill"))
    return mask.join(filled, CELL, "left").select(*CELL, (F.col("mask") | F.coalesce("fill", F.lit(False))).alias("mask"))


def mask_maxpool(mask: DataFrame, level_in: int, level_out: int) -> DataFrame:
    p = 2 ** (level_out - level_in)
    at = lambda c: F.floor(F.col(c) / p).cast("int").alias(c)
    return mask.groupBy("slide_idx", at("row"), at("col")).agg(F.max("mask").alias("mask"))


def he_deconvolution(pixels: DataFrame) -> DataFrame:
    """Adds hematoxylin and eosin, whole numbers: optical densities times the inverse of the matrix of unit stain vectors,
    of which the third stands upright on the other two, clipped to 0 to 255."""
    # The stain vectors of hematoxylin and eosin over red, green, blue.
    h, e = (0.650, 0.704, 0.286), (0.072, 0.990, 0.105)
    upright = (h[1] * e[2] - h[2] * e[1], h[2] * e[0] - h[0] * e[2], h[0] * e[1] - h[1] * e[0])
    inverse = inverted([[x / math.hypot(*v) for x in v] for v in (h, e, upright)])
    density = [-F.log((F.col(c) + 1) / 256.0) * 255.0 / math.log(256.0) for c in "rgb"]
    for k, name in ((0, "hematoxylin"), (1, "eosin")):
        amount = sum((density[i] * inverse[i][k] for i in range(1, 3)), density[0] * inverse[0][k])
        pixels = pixels.withColumn(name, F.floor(F.least(F.greatest(amount, F.lit(0.0)), F.lit(255.0))).cast("int"))
    return pixels


def inverted(m) -> list[list[float]]:
    """Inverse of a 3 x 3 matrix by cofactors."""
    minor = lambda i, j: [m[a][b] for a in range(3) if a != i for b in range(3) if b != j]
    cof = [[(-1) ** (i + j) * (minor(i, j)[0] * minor(i, j)[3] - minor(i, j)[1] * minor(i, j)[2]) for j in range(3)] for i in range(3)]
    det = sum(m[0][j] * cof[0][j] for j in range(3))
    return [[cof[j][i] / det for j in range(3)] for i in range(3)]


SMOOTH, SLOPE = [(-1, 0.25), (0, 0.5), (1, 0.25)], [(-1, -1.0), (1, 1.0)]


def with_edges(cells: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Adds {value}_edge for each value: root of the mean of the squared horizontal and vertical gradients (weights 1 2 1
    over 4), of all values in one pass of each axis."""
    both = convolve_lines(cells, "col", {f"{v}_{name}": (v, w) for v in values for name, w in (("gy", SMOOTH), ("gx", SLOPE))})
    both = convolve_lines(both, "row", {f"{v}_{name}": (f"{v}_{name}", w) for v in values for name, w in (("gy", SLOPE), ("gx", SMOOTH))})
    edge = lambda v: F.sqrt((F.col(f"{v}_gx") * F.col(f"{v}_gx") + F.col(f"{v}_gy") * F.col(f"{v}_gy")) / 2)
    return both.select(*cells.columns, *[edge(v).alias(f"{v}_edge") for v in values])


def sobel(cells: DataFrame, value: str) -> DataFrame:
    """Edge strength of one channel."""
    return with_edges(cells.select(*CELL, F.col(value).alias("v")), ("v",)).select(*CELL, F.col("v_edge").alias("edge"))


def _gradients(cells: DataFrame, along: str, outs: dict[str, str]) -> DataFrame:
    """Adds {out: value}: central differences, one-sided at the ends."""
    w = Window.partitionBy("slide_idx", "col" if along == "row" else "row").orderBy(along)

    def step(value: str) -> Column:
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2.0)

    return cells.select("*", *[step(value).alias(out) for out, value in outs.items()])


def with_eigenvalues(cells: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Adds {value}_eig1 and {value}_eig2, eigenvalues of the matrix of second differences, greater first, of all values."""
    c = cells
    for along, steps in (("row", {"_gr": ""}), ("row", {"_hrr": "_gr"}), ("col", {"_hrc": "_gr", "_gc": ""}), ("col", {"_hcc": "_gc"})):
        c = _gradients(c, along, {f"{v}{out}": f"{v}{of}" for v in values for out, of in steps.items()})
    d = lambda v, name: F.col(f"{v}_{name}")
    mean = lambda v: (d(v, "hrr") + d(v, "hcc")) / 2
    half = lambda v: F.sqrt((d(v, "hrr") - d(v, "hcc")) * (d(v, "hrr") - d(v, "hcc")) / 4 + d(v, "hrc") * d(v, "hrc"))
    return c.select(*cells.columns, *[e.alias(f"{v}_{name}") for v in values for name, e in (("eig1", mean(v) + half(v)), ("eig2", mean(v) - half(v)))])


def hessian_eigenvalues(cells: DataFrame, value: str) -> DataFrame:
    """Both eigenvalues of one channel."""
    return with_eigenvalues(cells.select(*CELL, F.col(value).alias("v")), ("v",)).select(*CELL, F.col("v_eig1").alias("eig1"), F.col("v_eig2").alias("eig2"))


def feature_stack(pixels: DataFrame, sigma_min: float = 1.0, sigma_max: float = 16.0, n_sigma: int | None = None, h_e: bool = False, raw: bool = False) -> DataFrame:
    """A row for each cell, channel and scale (0 is raw, where asked for): intensity, edge, eig1 and eig2. Channels are red,
    green and blue, with h_e hematoxylin and eosin too, over 255; scales are spaced evenly in log2; blurs repeat the border
    cell. All of a tile's pictures are made where its pixels are."""
    lo, hi = math.log2(sigma_min), math.log2(sigma_max)
    n = int(hi - lo + 1) if n_sigma is None else n_sigma
    sigmas = [0.0] * raw + [2 ** (lo + (hi - lo) * k / max(1, n - 1)) for k in range(n)]
    channels = ("r", "g", "b") + ("hematoxylin", "eosin") * h_e
    cells = (he_deconvolution(pixels) if h_e else pixels).select(*CELL, *[(F.col(c) / 255.0).alias(c) for c in channels])
    weights = [gaussian_weights(s) if s else [(0, 1.0)] for s in sigmas]
    return picture_features(cells, list(channels), weights, long=True)


def mask_confusion(found: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, accuracy, recall and precision of a slide's mask; cells that one lacks count as unset there."""
    joined = found.select(*CELL, F.col("mask").alias("m")).join(truth.select(*CELL, F.col("mask").alias("t")), CELL, "full").fillna(False, ["m", "t"])
    n = joined.groupBy("slide_idx").agg(F.count_if(F.expr("m and t")).alias("tp"), F.count_if(F.expr("m and not t")).alias("fp"), F.count_if(F.expr("not m and t")).alias("fn"), F.count_if(F.expr("not m and not t")).alias("tn"))
    c = F.col
    return n.select("slide_idx", "tp", "fp", "fn", "tn", F.try_divide(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"), F.try_divide(c("tp"), c("tp") + c("fn")).alias("recall"), F.try_divide(c("tp"), c("tp") + c("fp")).alias("precision"))


def mask_outcome_map(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Each cell's outcome and a colour for it."""
    joined = found.select(*CELL, F.col("mask").alias("m")).join(truth.select(*CELL, F.col("mask").alias("t")), CELL)
    outcome = F.when(F.expr("m and t"), "tp").when(F.expr("m and not t"), "fp").when(F.expr("t"), "fn").otherwise("tn")
    is_ = lambda *names: F.when(F.col("outcome").isin(*names), 255).otherwise(0)
    return joined.select(*CELL, outcome.alias("outcome")).select(*CELL, "outcome", is_("fp").alias("red"), is_("tp").alias("green"), is_("fn").alias("blue"))


def boundary(mask: DataFrame) -> DataFrame:
    """Set cells with an unset or missing neighbour among four."""
    inner = erode_inside(mask).hint("merge")
    return mask.where("mask").select(*CELL).join(inner, CELL, "left_anti")


def erode_inside(mask: DataFrame) -> DataFrame:
    """Set cells whose four neighbours are all set; beyond the border nothing is."""
    set_ = mask.where("mask").select(*CELL)
    moved = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in CROSS]))
    votes = set_.select(*CELL, moved.alias("s")).select("slide_idx", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    return votes.groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") == len(CROSS)).select(*CELL)


def edge_band(mask: DataFrame, width: int) -> DataFrame:
    """Cells within width of a boundary cell along both axes (a square about it). Squares are not in a plan's estimate of its
    size, so neither they nor the band are to be broadcast."""
    around = lambda c: F.explode(F.sequence(F.col(c) - width, F.col(c) + width)).alias(c)
    near = boundary(mask).select("slide_idx", around("row"), "col").select("slide_idx", "row", around("col")).distinct().hint("merge")
    return mask.select(*CELL).join(near, CELL, "left_semi").hint("merge")
