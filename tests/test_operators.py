"""Operators on small grids and tables with answers worked out by hand."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid.operators import annotations as an
from slidegrid.operators import boosting as bo
from slidegrid.operators import contours as ct
from slidegrid.operators import froc as fr
from slidegrid.operators import index as ix
from slidegrid.operators import metrics as mt
from slidegrid.operators import models as ml
from slidegrid.operators import pixels as px
from slidegrid.operators import regions as rg
from slidegrid.operators import resampling as rs
from slidegrid.operators import tiles as tl
from slidegrid.plans import QUERIES
from slidegrid.plans.fixtures import eval_mask
from slidegrid.sources import tables as src

SMALL = "/root/testdata/sf0.001"


def grid(spark, text, slide=1, value=None):
    rows = [(slide, r, c, 0.0 if ch == "." else float(value or 1.0)) for r, line in enumerate(text.split()) for c, ch in enumerate(line)]
    return spark.createDataFrame(rows, "slide_idx long, row int, col int, value double")


def as_grid(rows, column):
    return {(r["row"], r["col"]): r[column] for r in rows.collect()}


def test_pool2d(spark):
    cells = spark.createDataFrame([(1, r, c, 4 * r + c + 1) for r in range(4) for c in range(4)], "slide_idx long, row int, col int, value int")
    assert as_grid(ix.pool2d(cells, 2, 2), "value") == {(0, 0): 6, (0, 1): 8, (1, 0): 14, (1, 1): 16}
    assert len(as_grid(ix.pool2d(cells, 2, 1), "value")) == 9
    assert as_grid(ix.pool2d(cells, 3, 2), "value") == {(0, 0): 11}
    mean = as_grid(ix.pool2d(cells, 2, 2, "avg"), "value")
    assert all(mean[k] <= v for k, v in as_grid(ix.pool2d(cells, 2, 2), "value").items())


def test_components(spark):
    assert {r.comp for r in rg.components(grid(spark, "#.. .#. ..#").where("value > 0")).collect()} == {1}
    two = rg.components(grid(spark, "##..## ##..##").where("value > 0"))
    assert as_grid(two, "comp")[0, 0] == 1 and as_grid(two, "comp")[1, 5] == 2
    props = {r.comp: r for r in rg.region_props(two).collect()}
    assert (props[1].area, props[1].centroid_row, props[2].centroid_col, props[1].extent) == (4, 0.5, 4.5, 1.0)
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("##...") for _ in range(12)) for _ in range(12))
    cells = grid(spark, text).where("value > 0")
    one, other = as_grid(rg.components(cells), "comp"), as_grid(rg.components(cells.repartition(7).orderBy(F.rand(3))), "comp")
    assert one == other
    for (r, c), k in one.items():
        assert all(one[n] == k for n in one if max(abs(n[0] - r), abs(n[1] - c)) == 1)


def test_components_across_squares(spark, monkeypatch):
    """Small squares, so that regions wind through many of them, give the regions of one large square."""
    rng = random.Random(8)
    spiral = "######### ........# #######.# #.....#.# #.###.#.# #.#...#.# #.#####.# #.......# #########"
    for text, side in ((spiral, 4), (" ".join("".join(rng.choice("##..") for _ in range(17)) for _ in range(15)), 3)):
        cells = grid(spark, text).unionByName(grid(spark, text[::-1], slide=2)).where("value > 0")
        named = lambda: sorted((r.slide_idx, r["row"], r["col"], r.comp) for r in rg.components(cells).collect())  # noqa: B023, E731
        whole = named()
        monkeypatch.setattr(rg, "SQUARE", side)
        assert named() == whole
        monkeypatch.undo()
    assert rg.components(cells.where("false")).count() == 0


def test_solidity(spark):
    cells = grid(spark, "###...## ###..##. .....#.. #.......").where("value > 0")
    got = {r.comp: r.solidity for r in rg.region_solidity(rg.components(cells)).collect()}
    assert got == pytest.approx({1: 1.0, 2: 5 / 6.5, 3: 1.0})  # the hull (6,0) (8,0) (8,1) (6,3) (5,3) (5,1) has 6.5


def test_aspect_ratio_is_rows_over_columns(spark):
    assert rg.region_props(grid(spark, "##### #####").withColumn("comp", F.lit(1))).first().aspect_ratio == 2 / 5


NESTED = "#########.. #.......#.# #.#####.#.. #.#...#.#.# #.#.#.#.### #.#...#.#.# #.#####.#.. #.......#.. #########.. .........#."


def test_contours_nest_and_fill(spark, monkeypatch):
    """Rings within rings, a corner join and an arch: parents, depth, corners worked out by hand, and the mask again by
    parity; the same where every ring crosses squares of three cells."""
    rng = random.Random(9)
    noise = " ".join("".join(rng.choice("##..") for _ in range(19)) for _ in range(17))
    mask = grid(spark, NESTED).unionByName(grid(spark, noise, slide=2)).withColumn("mask", F.col("value") > 0)
    results = []
    for side in (512, 3):
        monkeypatch.setattr(rg, "SQUARE", side)
        found = ct.contours(mask)
        rows = {(r.slide_idx, r.comp): r for r in found.collect()}
        filled = sorted((r.slide_idx, r["row"], r["col"], r.comp) for r in ct.filled(found).collect())
        assert filled == sorted((r.slide_idx, r["row"], r["col"], r.comp) for r in rg.components(mask.where("mask")).collect())
        results.append({k: (r.parent, r.depth, r.area, r.outer, r.holes) for k, r in rows.items()})
    assert results[0] == results[1]
    big, dot, inner, core = (rows[1, k] for k in (1, 2, 3, 4))
    assert [(r.parent, r.depth, len(r.holes)) for r in (big, dot, inner, core)] == [(None, 0, 1), (None, 0, 0), (1, 1, 1), (3, 2, 0)]
    assert [(p.x, p.y) for p in core.outer] == [(4, 4), (5, 4), (5, 5), (4, 5)]
    assert [(p.x, p.y) for p in inner.holes[0]] == [(3, 3), (3, 6), (6, 6), (6, 3)]
    assert (9, 9) in [(p.x, p.y) for p in big.outer] and big.area == 37
    texts = {r.slide_idx: json.loads(r.json) for r in ct.regions_json(found, "tissue", 2).collect()}
    assert texts[1]["tissue"][0] == [[[20, 2], [22, 2], [22, 4], [20, 4]]] and texts[1]["tissue"][-1][0][0] == [0, 0]
    assert len(texts[2]["tissue"]) == len([k for k in rows if k[0] == 2])
    assert ct.contours(mask.where("false")).count() == 0


def test_dbscan(spark):
    rows = [(1, r, c, 1.0) for r in range(3) for c in range(4)] + [(1, 1, 7, 1.0), (1, 1, 20, 1.0)]
    got = as_grid(tl.dbscan(spark.createDataFrame(rows, "slide_idx long, row int, col int, value double"), 5, 10), "comp")
    assert {got[1, 0], got[1, 7]} == {1} and got[1, 20] == 2


def plain_dbscan(cells, eps, least):
    near = {p: [q for q in cells if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in cells}
    core = {p for p in cells if len(near[p]) >= least}
    first = {}
    for p in sorted(core):
        if p not in first:
            todo = [p]
            while todo:
                q = todo.pop()
                if q not in first:
                    first[q] = p
                    todo += [x for x in near[q] if x in core]
    key = {p: (False, first[p]) if p in core else min(((False, first[q]) for q in near[p] if q in core), default=(True, p)) for p in cells}
    places = {k: i + 1 for i, k in enumerate(sorted(set(key.values())))}
    return {p: places[k] for p, k in key.items()}


def test_tiles_give_what_one_square_gives(spark, monkeypatch):
    """Squares much smaller than regions and neighbourhoods: clusters, suppression and medians are those of plain loops."""
    rng = random.Random(12)
    cells = [(r, c, rng.randint(0, 20) / 20) for r in range(26) for c in range(23) if rng.random() < (0.6 if (r // 6 + c // 7) % 2 else 0.12)]
    df = spark.createDataFrame([(7, *x) for x in cells], "slide_idx long, row int, col int, value double")
    full = [(7, r, c, rng.randrange(256)) for r in range(26) for c in range(23)]
    picture = spark.createDataFrame(full, "slide_idx long, row int, col int, value int")
    grid_ = np.array([v for *_, v in full]).reshape(26, 23)
    for side in (512, 9, 4):
        monkeypatch.setattr(rg, "SQUARE", side)
        for eps, least in ((3, 7), (5, 10)):
            assert as_grid(tl.dbscan(df, eps, least), "comp") == plain_dbscan([x[:2] for x in cells], eps, least)
        got = sorted((r["row"], r["col"], r.prob_score, r.pixels) for r in tl.lesions_nms(df, 5, 0.4).collect())
        assert got == greedy(cells, 5, 0.4)
        for size in (3, 4, 9):
            padded = np.pad(grid_, ((size // 2, size - 1 - size // 2),) * 2, mode="symmetric")
            want = np.median(np.lib.stride_tricks.sliding_window_view(padded, (size, size)), axis=(2, 3))
            assert as_grid(tl.median(picture, size, "value"), "value") == {(r, c): want[r, c] for r in range(26) for c in range(23)}
    empty = df.where("false")
    assert [f.count() for f in (tl.dbscan(empty), tl.lesions_nms(empty), tl.median(empty, 3, "value"))] == [0, 0, 0]


def greedy(cells, radius, cutoff):
    live = sorted(((v, -(r * 2**31 + c), r, c) for r, c, v in cells if v >= cutoff), reverse=True)
    out = []
    while live:
        v, _, r, c = live[0]
        near = lambda a, b: (a - r) ** 2 + (b - c) ** 2 < radius**2  # noqa: B023, E731
        out.append((r, c, v, sum(near(a, b) for a, b, _ in cells)))
        live = [x for x in live if not near(x[2], x[3])]
    return sorted(out)


def test_lesions_nms(spark):
    rng = random.Random(2)
    cells = [(r, c, rng.randint(0, 10) / 10) for r in range(14) for c in range(14) if rng.random() < 0.5]
    df = spark.createDataFrame([(1, *x) for x in cells], "slide_idx long, row int, col int, value double")
    assert sorted((r["row"], r["col"], r.prob_score, r.pixels) for r in tl.lesions_nms(df, 4, 0.5).collect()) == greedy(cells, 4, 0.5)
    assert tl.lesions_nms(df.where("value < 0.5"), 4, 0.5).count() == 0


def test_froc(spark):
    false = spark.createDataFrame([(1, 0.9), (2, 0.4), (3, 0.7)], "slide_idx long, prob double")
    regions = spark.createDataFrame([(1, 1, False, 0.8), (2, 1, False, 0.0), (2, 2, True, 0.0)], "slide_idx long, label int, is_itc boolean, prob double")
    curve = fr.froc_curve(false, regions, spark.range(3))
    points = sorted((r.total_fps, r.sensitivity) for r in curve.collect())
    assert points == [(0.0, 0.0), (1 / 3, 0.0), (1 / 3, 0.5), (2 / 3, 0.5), (1.0, 0.5)]
    assert fr.froc_score(curve).first().froc == pytest.approx(5 * 0.5 / 6)


def test_froc_samples(spark):
    """Samples draw lesions only: a region hit twice keeps its best drawn hit, one that no drawn lesion hits is missed, and
    the number of regions never changes. Held against plain loops over the same draws."""
    rng = random.Random(6)
    mask = spark.createDataFrame([(s, 4 * k, c, k + 1) for s in range(2) for k in range(3) for c in range(3)], "slide_idx long, row int, col int, label int")
    itc = spark.createDataFrame([(1, 3)], "slide_idx long, label int")
    lesions = [(0, 0.9, 0.0, 0.0), (0, 0.7, 1.0, 0.0)]  # one region hit twice
    lesions += [(rng.randrange(2), rng.choice([0.2, 0.5, 0.6, 0.7, 0.8]), float(rng.randrange(5)), float(rng.randrange(9))) for _ in range(22)]
    df = spark.createDataFrame(lesions, "slide_idx long, prob_score double, centre_x double, centre_y double")
    reps, images = 25, 2
    curve = fr.froc_samples(df, mask, itc, spark.range(images), 0, reps, 11).collect()

    def region(s, x, y):
        return (y // 4 + 1 if y in (0, 4, 8) and x < 3 else 0) if s < 2 else 0

    placed = []
    for s, p, x, y in lesions:
        k = int(region(s, x, y))
        placed.append((None, -1, None) if (s, k) == (1, 3) else (None, 0, p) if k == 0 else (s, k, p))
    placed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], 0 if r[2] is None else 1 - r[2]))
    draws = rs.Draws(len(placed), reps, 11)
    for rep in range(reps):
        weights = [int(draws.below(i + 1)[rep] - draws.below(i)[rep]) for i in range(len(placed))]
        assert sum(weights) == len(lesions)
        false, best = [], {(s, k): 0.0 for s in range(2) for k in (1, 2, 3) if (s, k) != (1, 3)}
        for (s, k, p), w in zip(placed, weights):
            if w and k == 0:
                false += [p] * w
            elif w and k > 0:
                best[s, k] = max(best[s, k], p)
        at = sorted(set(false) | set(best.values()), reverse=True)[:-1]
        want = sorted([(t, sum(p >= t for p in false) / images, sum(p >= t for p in best.values()) / 5) for t in at] + [(-1.0, 0.0, 0.0)])
        got = sorted((-1.0 if r.threshold is None else r.threshold, r.total_fps, r.sensitivity) for r in curve if r.rep == rep)
        assert got == [pytest.approx(w) for w in want]


def test_draws_are_multinomial(monkeypatch):
    """Whatever the leaves, each replicate has n draws, a place's count does not depend on who asks, and first and second
    moments are those of the multinomial."""
    n, reps = 97, 4000
    for leaf in (8, 32, 1024):
        draws = rs.Draws(n, reps, 5, leaf)
        upto = np.stack([draws.below(x) for x in range(n + 1)], axis=1)
        weights = np.diff(upto, axis=1)
        assert (upto[:, 0] == 0).all() and (upto[:, -1] == n).all() and (weights >= 0).all()
        again = rs.Draws(n, reps, 5, leaf)
        assert all((again.below(x) == upto[:, x]).all() for x in (96, 3, 64, 50, 8, 97))
        assert abs(weights.mean(axis=0) - 1).max() < 0.08 and abs(weights.var(axis=0) - (1 - 1 / n)).max() < 0.15
        covariance = np.cov(weights.T)
        assert abs((covariance - np.diag(np.diag(covariance))).mean() * n * n / (n - 1) * -1 - 1 + 1 / n) < 0.1
        halves = weights[:, :40].sum(axis=1)
        assert abs(halves.mean() - 40) < 0.3 and abs(halves.var() / (97 * (40 / 97) * (57 / 97)) - 1) < 0.12


def test_resampled_curves(spark, monkeypatch):
    """Curves of samples at levels, and counts, against plain loops over the drawn rows; many ranges and small leaves."""
    monkeypatch.setattr(rs, "LEAF", 16)
    monkeypatch.setattr(rs, "_GROUPS", 5)
    rng = random.Random(4)
    rows = [(int(rng.random() < s / 12), s / 10) for s in (rng.randrange(11) for _ in range(120))]
    df = spark.createDataFrame(rows, "label int, score double").repartition(3)
    counts = mt.by_score(df, "score", F.col("label") == 1)
    ordered = sorted(rows, key=lambda r: (-r[1], -r[0]))
    reps, levels = 30, [k / 20 for k in range(21)]
    draws = rs.Draws(len(rows), reps, 3, 16)
    weights = np.diff(np.stack([draws.below(x) for x in range(len(rows) + 1)], axis=1), axis=1)
    for x, y, origin, strict in (("recall", "precision", False, False), ("fpr", "recall", True, True)):
        figures, values = rs.resampled_curves(counts, reps, 3, x, y, levels, 0.5, strict, origin)
        figures = {r.rep: (r.tn, r.fp, r.fn, r.tp) for r in figures.collect()}
        got = {(r.rep, r.k): r.value for r in values.collect()}
        assert len(got) == reps * len(levels)
        for rep in range(reps):
            drawn = [(label, score, int(w)) for (label, score), w in zip(ordered, weights[rep]) if w]
            said = lambda s: s > 0.5 if strict else s >= 0.5  # noqa: B023, E731
            count = lambda is_, pos: sum(w for label, s, w in drawn if label == is_ and said(s) == pos)  # noqa: B023, E731
            assert figures[rep] == (count(0, False), count(0, True), count(1, False), count(1, True))
            all_p, all_n = (sum(w for label, _, w in drawn if label == v) for v in (1, 0))
            points = [(0.0, 0.0)] if origin else []
            for t in sorted({s for _, s, _ in drawn}, reverse=True):
                tp, fp = (sum(w for label, s, w in drawn if label == v and s >= t) for v in (1, 0))
                of = {"recall": tp / all_p, "precision": tp / (tp + fp), "fpr": fp / all_n}
                points.append((of[x], of[y]))
            for k, level in enumerate(levels):
                before = [i for i, p in enumerate(points) if p[0] <= level]
                if not before:
                    want = points[0][1]
                elif before[-1] == len(points) - 1:
                    want = points[-1][1]
                else:
                    (x0, y0), (x1, y1) = points[before[-1]], points[before[-1] + 1]
                    want = y0 + (level - x0) * (y1 - y0) / (x1 - x0)
                assert got[rep, k] == pytest.approx(want), (rep, k)


def test_curves_are_cut_evenly(spark):
    """99 of 100 scores lie below 0.001, and no range of the running sums has more than twice its share."""
    rows = spark.range(40_000).select((F.rand(3) * F.when(F.rand(4) < 0.99, 0.001).otherwise(1.0)).alias("prob"), F.lit(1).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = mt._ranged(rows, (), [F.desc("prob")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ranged.groupBy("_p").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) > 1
    run = mt.running(rows, (), [F.desc("prob")], ["n"])
    assert sorted(r.to_n for r in run.collect()) == list(range(1, 40_001))


def test_patient_stage_and_kappa(spark):
    kinds = {"g": ["negative"] * 4 + ["what"], "h": ["micro", "what"], "a": ["negative"] * 5, "b": ["itc"] + ["negative"] * 4, "c": ["micro"] * 3 + ["itc"] * 2, "d": ["macro", "micro", "micro", "itc", "itc"], "e": ["macro", "micro", "micro", "micro", "itc"], "f": ["macro"] * 2}
    rows = [(p, s, "pN0") for p, ss in kinds.items() for s in ss]
    got = {r.patient: r for r in mt.patient_stage(spark.createDataFrame(rows, "patient string, prediction string, patient_stage string")).collect()}
    assert [got[p].predicted_stage for p in "abcdef"] == ["pN0", "pN0(i+)", "pN1mi", "pN1", "pN2", "pN1"]
    assert [got[p].complete for p in "af"] == [True, False]
    assert [(got[p].predicted_stage, got[p].unknown) for p in "gha"] == [(None, True), ("pN1mi", True), ("pN0", False)]
    pairs = [("pN0", "pN0")] * 3 + [("pN0", "pN0(i+)")] + [("pN0(i+)", "pN0(i+)")] * 2 + [("pN1mi", "pN0")] * 2 + [("pN1mi", "pN1mi")] * 4
    k = mt.kappa_quadratic(spark.createDataFrame(pairs, "true_stage string, predicted_stage string")).first().kappa
    n, order = len(pairs), mt.PATIENT_STAGES
    i, j = [order.index(a) for a, _ in pairs], [order.index(b) for _, b in pairs]
    assert k == pytest.approx(1 - sum((a - b) ** 2 for a, b in zip(i, j)) * n / sum((a - b) ** 2 for a in i for b in j))
    with pytest.raises(Exception, match="unknown stage"):
        bad = spark.createDataFrame([("p.zip", "pN9")], "patient string, stage string")
        mt.kappa_validated(bad, bad).collect()


def test_morphology(spark):
    ring = grid(spark, "..... .###. .#.#. .###. .....").withColumn("mask", F.col("value") > 0).drop("value")
    assert as_grid(px.mask_close(ring), "mask")[2, 2]
    assert as_grid(px.mask_fill_holes(ring, 5, hole=50.0), "mask")[2, 2] and not as_grid(px.mask_fill_holes(ring, 5, hole=50.0), "mask")[0, 0]


def test_curves(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0)], "score double, y int")
    curve = mt.binary_curve(rows, "score", F.col("y") == 1)
    assert sorted((r.threshold, r.tp, r.fp) for r in curve.collect()) == [(0.3, 2, 2), (0.8, 2, 1), (0.9, 1, 0)]
    cells = mt.confusion_matrix(rows.select(F.col("y").alias("label"), F.lit(1).alias("predicted")), (0, 1, 2)).collect()
    assert len(cells) == 9 and sum(r.n for r in cells) == 4


def test_splits_partition(spark):
    slides = spark.createDataFrame([(k, f"p{k // 5}", "tumor" if k % 3 else "normal", k % 4 == 0) for k in range(60)], "slide_idx long, patient string, label string, annotated boolean")
    for split in (ix.split_stratified(slides, 0.7, 1), ix.split_grouped(slides, 0.7, 1)):
        rows = split.collect()
        assert sorted(r.slide_idx for r in rows) == list(range(60)) and {r.split for r in rows} == {"train", "valid"}
        assert sorted(map(str, rows)) == sorted(map(str, split.repartition(5).collect()))
    assert len({(r.patient, r.split) for r in ix.split_grouped(slides, 0.7, 1).collect()}) == 12


def test_slide_report(spark):
    """A slide's best patch counts whatever its patch_seq, and the report is held against plain loops over the same draws."""
    from slidegrid.plans import QUERIES
    from slidegrid.plans.fixtures import patches, slides
    from tests.conftest import DATA

    d = f"{DATA}/sf0.001"
    best = {}
    for r in patches(spark, d).collect():
        best[r.slide_idx] = max(best.get(r.slide_idx, 0.0), r.tumor)
    rows = [(s.label == "tumor", best.get(s.slide_idx, 0.0)) for s in slides(spark, d).orderBy("slide_idx").collect()]
    got = QUERIES["slide_metrics_binary"](spark, d).collect()
    check_report(rows, got, 1000)

    rng = random.Random(4)
    rows = [(rng.random() < 0.4, rng.choice([0.1, 0.3, 0.5, 0.92, 0.95, 1.0])) for _ in range(40)]
    df = spark.createDataFrame([(int(y), v) for y, v in rows], "label int, score double")
    check_report(rows, mt.slide_report(df, 60, 3).collect(), 60)


def check_report(rows, got, reps):
    def measures(rows):
        n = [sum(y == a and (v > 0.9) == b for y, v in rows) for a in (False, True) for b in (False, True)]
        return [(n[0] + n[3]) / len(rows), *n]

    def roc(rows):
        p, n = sum(y for y, _ in rows), sum(not y for y, _ in rows)
        return [(t, sum(v >= t and not y for y, v in rows) / n, sum(v >= t and y for y, v in rows) / p) for t in sorted({v for _, v in rows}, reverse=True)] if p and n else None

    names = ("accuracy", "tn", "fp", "fn", "tp", "auc")
    of = {r.row_name: [r[c] for c in names] for r in got}
    area = lambda x, y: sum((b - a) * (u + v) / 2 for a, b, u, v in zip(x, x[1:], y, y[1:]))
    points = roc(rows)
    x, y = [0, *[p[1] for p in points]], [0, *[p[2] for p in points]]
    assert of["results"] == pytest.approx([*measures(rows), area(x, y)])
    assert sorted((r.threshold, r.fpr, r.tpr) for r in got if r.row_name == "curve") == [pytest.approx(p) for p in sorted(points)]
    levels, samples, bands = np.linspace(0, 1, 101), [], []
    draws, ordered = rs.Draws(len(rows), reps, 3), sorted(rows, key=lambda r: (-r[1], -r[0]))
    weights = np.diff(np.stack([draws.below(x) for x in range(len(rows) + 1)], axis=1), axis=1)
    for rep in range(reps):
        drawn = [r for r, w in zip(ordered, weights[rep]) for _ in range(w)]
        auc = None
        if points := roc(drawn):
            bands.append(np.interp(levels, [0, *[p[1] for p in points]], [0, *[p[2] for p in points]]))
            auc = area(levels, bands[-1])
        samples.append([*measures(drawn), auc])
        assert of[f"sample_{rep}"][:5] == pytest.approx(samples[-1][:5]) and of[f"sample_{rep}"][5] == (pytest.approx(auc) if auc is not None else None)
    for name, q in (("ci_lower_bound", 0.025), ("ci_upper_bound", 0.975)):
        assert of[name] == pytest.approx([np.quantile([s[k] for s in samples if s[k] is not None], q) for k in range(6)])
    band = sorted((r.fpr, r.tpr_lower, r.tpr_upper) for r in got if r.row_name == "curve_ci")
    assert band == [pytest.approx(b) for b in zip(levels, *np.quantile(bands, [0.025, 0.975], axis=0))]


def test_slide_results(spark):
    """Both classifiers learn from slide features and say of every slide its name, label, tags and probabilities."""
    from slidegrid.plans import QUERIES
    from slidegrid.plans.fixtures import slides
    from tests.conftest import DATA

    d = f"{DATA}/sf0.001"
    known = {r.slide_name: r for r in slides(spark, d).collect()}
    for name, label in (("slide_rf", "label"), ("slide_gbt", "stage")):
        rows = QUERIES[name](spark, d).collect()
        classes = sorted({r[label] for r in known.values()})
        assert rows[0].asDict().keys() == {"slide_names", "true_label", "tags", "predictions", *classes}
        assert {r.slide_names for r in rows} == known.keys()
        assert all(r.true_label == known[r.slide_names][label] and r.tags == known[r.slide_names].tags for r in rows)
        assert all(sum(r[c] for c in classes) == pytest.approx(1) and r[r.predictions] == max(r[c] for c in classes) for r in rows)


def plain_boost(x, y, classes, cuts, rounds, depth):
    """Trees by recursion over lists of rows, with the gains written out."""
    scores = np.zeros((len(y), classes))
    for _ in range(rounds):
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g, h = np.rint((p - np.eye(classes)[y]) * bo.UNIT) / bo.UNIT, np.rint(p * (1 - p) * bo.UNIT) / bo.UNIT
        step = np.zeros_like(scores)

        def grow(rows, left):
            G, H = g[rows].sum(axis=0), h[rows].sum(axis=0)
            best = (1e-6, None)
            for f in range(x.shape[1]) if left else ():
                for c in cuts[f]:
                    low, high = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if h[low].sum() >= 1 and h[high].sum() >= 1:
                        gain = sum((g[r].sum(axis=0) ** 2 / (h[r].sum(axis=0) + 1)).sum() for r in (low, high)) - (G**2 / (H + 1)).sum()
                        if gain > best[0] + 1e-12:
                            best = (gain, (low, high))
            if best[1]:
                grow(best[1][0], left - 1)
                grow(best[1][1], left - 1)
            else:
                step[rows] = -0.3 * G / (H + 1)

        grow(np.arange(len(y)), depth)
        scores = scores + step
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_boosting_against_plain_loops(spark, monkeypatch):
    """200 rows of three classes: probabilities are those of plain loops, whatever the partitions and writings of scores."""
    rng = random.Random(5)
    x = np.array([[rng.randrange(12), rng.random().__round__(1), rng.randrange(3)] for _ in range(200)], dtype=float)
    y = np.array([int((a > 5) + (b > 0.5 and c > 0)) if rng.random() < 0.85 else rng.randrange(3) for a, b, c in x])
    df = spark.createDataFrame([(k, *map(float, r), "abc"[v]) for k, (r, v) in enumerate(zip(x, y))], "slide_idx long, f0 double, f1 double, f2 double, y string")
    monkeypatch.setattr(bo, "REFRESH", 3)
    model = bo.fit(df.repartition(3), ["f0", "f1", "f2"], "y", rounds=7, depth=3)
    got = {r.slide_idx: [r.a, r.b, r.c] for r in bo.predict(df.drop("y"), model).collect()}
    want = plain_boost(x, y, 3, model.cuts, 7, 3)
    assert np.allclose(np.array([got[k] for k in range(200)]), want, atol=1e-9)
    other = bo.fit(df.orderBy(F.desc("slide_idx")).repartition(2), ["f0", "f1", "f2"], "y", rounds=7, depth=3)
    assert other == model
    odd = df.limit(3).select("slide_idx", F.lit(None).cast("double").alias("f0"), F.lit(float("nan")).alias("f1"), "f2")
    assert bo.predict(odd, model).count() == 3
    assert bo.fit(df.where("y = 'a'"), ["f0"], "y").trees == [] and bo.predict(df.limit(2), bo.fit(df.where("false"), ["f0"], "y")).first().predictions is None


def test_saved_slide_models(spark, tmp_path):
    """A saved model says the same of rows without labels as it did when it was fitted, and is used until it is fitted anew."""
    rows = spark.createDataFrame([(k, float(k % 7), float(k % 3), "normal" if k % 7 < 3 else "tumor") for k in range(60)], "slide_idx long, f0 double, f1 double, y string")
    other = rows.withColumn("y", F.when(F.col("y") == "normal", "tumor").otherwise("normal"))
    for learn, how in ((ml.slide_forest, {"trees": 5}), (ml.slide_boosted, {"rounds": 4, "depth": 2})):
        said = lambda train, of, **more: {r.slide_idx: (r.predictions, r.tumor) for r in learn(train, of, ["f0", "f1"], "y", path=f"file://{tmp_path}/{learn.__name__}", **how, **more).collect()}  # noqa: B023, E731
        fitted = said(rows, rows)
        assert {k: v[0] for k, v in fitted.items()} == {r.slide_idx: r.y for r in rows.collect()}
        assert said(other, rows.drop("y")) == fitted
        assert {k: v[0] for k, v in said(other, rows, retrain=True).items()} == {r.slide_idx: r.y for r in other.collect()}


def test_resume_after_a_run_that_died(spark, tmp_path):
    """A run that dies leaves half a slide, and one that fails leaves nothing: the next ends with every patch once, and a slide
    that the ledger has in full is not scored again."""
    folder = f"file://{tmp_path}/scores"
    index = spark.createDataFrame([(s, p) for s in range(4) for p in range(10)], "slide_idx long, patch_seq long")
    named = lambda run: lambda left: left.select("slide_idx", "patch_seq", F.lit(run).alias("by"))
    ix.score_resume(index.where("slide_idx = 0"), folder, named("first"), "first")
    named("died")(index.where("slide_idx = 1 and patch_seq < 5")).write.mode("append").parquet(f"{folder}/results")  # no ledger entry
    broken = lambda left: named("broken")(left).where(F.raise_error(F.lit("no model")).isNull())
    with pytest.raises(Exception, match="no model"):
        ix.score_resume(index, folder, broken, "broken")
    rows = ix.score_resume(index, folder, named("last"), "last").collect()
    assert sorted((r.slide_idx, r.patch_seq) for r in rows) == [(s, p) for s in range(4) for p in range(10)]
    assert {(r.slide_idx, r.by) for r in rows} == {(0, "first"), (1, "died"), (1, "last"), (2, "last"), (3, "last")}
    noted = sorted((r.slide_idx, r.expected, r.written, r.run) for r in spark.read.parquet(f"{folder}/ledger").collect())
    assert noted == [(0, 10, 10, "first"), *((s, 10, 10, "last") for s in (1, 2, 3))]
    assert len(ix.score_resume(index, folder, named("again"), "again").where("by = 'again'").collect()) == 0


def test_index_files_are_alike(spark, tmp_path):
    """One slide has half of all rows: files differ by a factor of 3 at most, and a slide's rows are read from its files only."""
    rows = spark.range(40_000).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id") % 900 + 8).cast("long").alias("slide_idx"), F.col("id").cast("int").alias("patch_seq"))
    path = f"file://{tmp_path}/index"
    src.write_index(rows, path, file_rows=5_000)
    files = spark.read.parquet(f"{path}/files").collect()
    assert len(files) == 8 and max(f.n for f in files) <= 3 * min(f.n for f in files)
    some = src.read_index(spark, path, "slide_idx long, patch_seq int", slides=(20, 30))
    assert len(some.inputFiles()) <= 2 and some.count() == rows.where("slide_idx between 20 and 30").count()
    assert src.read_index(spark, path, "slide_idx long, patch_seq int").count() == 40_000
    assert src.read_index(spark, path, "slide_idx long, patch_seq int", slides=(-5, -1)).count() == 0


def test_listing(spark, tmp_path):
    paths = spark.createDataFrame([("a/b/tumor_1.tif",), ("a/normal_2.tif",), ("a/x.xml",)], "path string")
    assert src.touch(paths, f"file://{tmp_path}/tree") == 3
    assert sorted(r.path for r in src.list_files(spark, f"file://{tmp_path}/tree", "*.tif").collect()) == ["a/b/tumor_1.tif", "a/normal_2.tif"]


def test_hulls_merge(spark, monkeypatch):
    """Solidity of regions in one square and in many, of an L, a full box and noise, against the polygon's area by hand."""
    rng = random.Random(3)
    cells = grid(spark, "####.... #....... #....##. .......#").withColumn("comp", F.when((F.col("col") < 4) & (F.col("row") < 3), 1).otherwise(2))
    cells = cells.where("value > 0").unionByName(grid(spark, " ".join("".join(rng.choice("#.") for _ in range(40)) for _ in range(40)), slide=2).where("value > 0").withColumn("comp", F.lit(1)))
    named = lambda: {(r.slide_idx, r.comp): r.solidity for r in rg.region_solidity(cells).collect()}
    whole = named()
    assert whole[1, 1] == pytest.approx(6 / 9) and whole[1, 2] == pytest.approx(3 / 4.5)
    for side in (16, 2):
        monkeypatch.setattr(rg, "SQUARE", side)
        assert named() == whole


def test_picture_features_in_tiles(spark):
    """Blurs, edges and eigenvalues of tiles smaller than the blur's width equal those along whole lines."""
    rng = random.Random(2)
    rows = [(k, r, c, float(rng.randrange(256))) for k in (1, 2) for r in range(13) for c in range(9 + k)]
    cells = spark.createDataFrame(rows, "slide_idx long, row int, col int, v double")
    w = px.gaussian_weights(1.5)
    blurred = px.convolve_lines(px.convolve_lines(cells, "row", {"v": ("v", w)}, "nearest"), "col", {"v": ("v", w)}, "nearest")
    want = {(r.slide_idx, r["row"], r["col"]): (r.v, r.v_edge, r.v_eig1, r.v_eig2) for r in px.with_eigenvalues(px.with_edges(blurred, ("v",)), ("v",)).collect()}
    for side in (4, 256):
        got = {(r.slide_idx, r["row"], r["col"]): (r.v_0, r.v_0_edge, r.v_0_eig1, r.v_0_eig2) for r in tl.picture_features(cells, ["v"], [w], side).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_scope_deletes_its_tables(spark):
    import os

    from slidegrid.functions.folders import scope, shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    cells = grid(spark, "##.## .#.#. #####").where("value > 0")
    with scope(spark):
        assert tl.dbscan(rg.components(cells).drop("comp"), 2, 3).count() == 11
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_render_fills_paints_and_cuts(spark):
    """Every cell of an image has a label: later places paint over earlier ones whatever was drawn last, the fill label is also the
    last place, slide 2 has no annotation, and what lies outside is cut off."""
    shapes = spark.createDataFrame([(1, 2, 3), (2, 1, 2), (3, 0, 4)], "slide_idx long, n_rows int, n_cols int")
    drawn = [(1, 0, 0, "tumor", 5), (1, 0, 1, "tumor", 5), (1, 0, 1, "normal", 1), (1, 1, 0, "background", 9), (1, 1, 1, "background", 9), (1, 1, 1, "tumor", 2), (1, 1, 3, "tumor", 5), (1, -1, 0, "tumor", 5), (4, 0, 0, "tumor", 5)]
    cells = spark.createDataFrame(drawn, "slide_idx long, row int, col int, label string, seq int")
    numbers = {"background": 0, "normal": 1, "tumor": 2}
    image = an.render(shapes, cells, ("background", "tumor", "normal"), numbers, "normal").collect()
    want = {(1, 0, 0): "tumor", (1, 0, 1): "normal", (1, 0, 2): "normal", (1, 1, 0): "background", (1, 1, 1): "tumor", (1, 1, 2): "normal", (2, 0, 0): "normal", (2, 0, 1): "normal"}
    assert len(image) == len(want) and {(r.slide_idx, r["row"], r.col): (r.label, r.value) for r in image} == {k: (v, numbers[v]) for k, v in want.items()}


@pytest.mark.parametrize("label", ["stroma", None])
def test_no_annotation_is_dropped(spark, label):
    """A label that has no place in the order is an error, not a cell less."""
    cells = spark.createDataFrame([(1, 0, 0, "tumor", 0), (1, 0, 1, label, 1)], "slide_idx long, row int, col int, label string, seq int")
    with pytest.raises(Exception, match="labels_order"):
        an.paint(cells, ("normal", "tumor")).collect()


def test_annot_paint_gives_every_cell(spark):
    """Cells that no annotation covers have the fill label; with those without tissue at 0 it is the label grid."""
    got = QUERIES["annot_paint"](spark, SMALL).collect()
    tissue = {(r.slide_idx, r["row"], r.col) for r in eval_mask(spark, SMALL).where("(row + col) % 3 <> 0").collect()}
    image = {(r.slide_idx, r["row"], r.col): r.value for r in got}
    assert len(got) == len(image) == 10 * 32 * 32 and {r.label for r in got} == {"background", "normal", "tumor"}
    assert {k: v if k in tissue else 0 for k, v in image.items()} == {(r.slide_idx, r["row"], r.col): r.label for r in QUERIES["label_grid"](spark, SMALL).collect()}


def _line_items(spark, folder, slides):
    """Line items whose cells have these pictures as heatmaps: # is 0.8, others 0.4."""
    rows = [(k, r, c, 0.08 if ch == "#" else 0.04) for k, text in slides.items() for r, line in enumerate(text.split()) for c, ch in enumerate(line)]
    items = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_partkey long, l_discount double")
    items.select("*", F.lit(0.0).alias("l_tax"), F.lit("R").alias("l_returnflag")).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_top_two_regions_have_all_ten_features(spark, tmp_path):
    """Solidity with the others, and zeros for a slide that has patches but no region."""
    found = QUERIES["slide_features_top2"](spark, _line_items(spark, tmp_path / "a", {1: "###...## ###..##. .....#.. #.......", 2: "... ...", 3: "#.. #.."}))
    names = ["area", "eccentricity", "extent", "bbox_area", "major_axis", "max_value", "mean_value", "min_value", "aspect_ratio", "solidity"]
    assert found.columns == ["slide_idx", *[f"{c}_{k}" for k in (1, 2) for c in names]]
    rows = {r.slide_idx: r for r in found.collect()}
    assert (rows[1].area_1, rows[1].solidity_1, rows[1].area_2, rows[1].solidity_2) == (6.0, 1.0, 5.0, round(5 / 6.5, 6))
    assert set(rows) == {1, 2, 3} and set(rows[2][1:]) == {0.0}
    assert (rows[3].area_1, rows[3].solidity_1, rows[3].aspect_ratio_1) == (2.0, 1.0, 2.0) and set(rows[3][11:]) == {0.0}
    empty = QUERIES["slide_features_top2"](spark, _line_items(spark, tmp_path / "b", {7: ".. .."})).collect()
    assert [r.slide_idx for r in empty] == [7] and set(empty[0][1:]) == {0.0}
