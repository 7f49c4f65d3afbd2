"""What larger tables rest on: no broadcast of tables that are estimated too small, and work dealt over tasks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slidegrid.operators import boosting as bo
from slidegrid.operators import contours as ct
from slidegrid.operators import froc as fr
from slidegrid.operators import pixels as px
from slidegrid.operators import regions as rg
from slidegrid.operators import resampling as rs
from slidegrid.operators import tiles as tl
from slidegrid.operators.resampling import Draws
from slidegrid.plans import QUERIES
from slidegrid.plans.fixtures import eval_mask, patches, pixels
from slidegrid.plans.pixel_queries import em

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["label_grid", "lesion_hits", "mask_edge_band", "froc_curve"])
def test_masks_are_not_broadcast(spark, name):
    """A mask has 1,024 cells for each row of the file that its size is estimated by."""
    assert "BroadcastHashJoin" not in plan_of(QUERIES[name](spark, SMALL))


def test_masks_are_made_by_many_tasks(spark):
    parts = {r.p for r in eval_mask(spark, SMALL).select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(parts) > 1


def test_bands_are_not_broadcast(spark):
    """The band of a mask without a hint has none of its own plan's estimate either."""
    some = em(spark, SMALL).where("col < 9")
    assert "BroadcastHashJoin" not in plan_of(spark.range(9).withColumnRenamed("id", "slide_idx").join(px.edge_band(some, 1), "slide_idx"))


def test_settled_tables_are_not_broadcast(spark):
    """Files of like values are small, the rows of their table are not."""
    cells = spark.range(100).select(F.lit(1).cast("long").alias("slide_idx"), "id")
    assert "BroadcastHashJoin" not in plan_of(rg.settled(cells).join(rg.settled(cells.limit(3)), ["slide_idx", "id"]))


def test_pictures_of_a_block_are_told_apart(spark, monkeypatch):
    """Slides of unlike shapes share a block, blocks cut between tiles; the long rows are the wide ones."""
    monkeypatch.setattr(tl, "BLOCK", 40)
    sizes = {1: (3, 5), 2: (1, 4), 3: (6, 6), 4: (3, 5)}
    rows = [(s, r, c, float((7 * s + 3 * r * r + c) % 11)) for s, (h, w) in sizes.items() for r in range(h) for c in range(w)]
    cells = spark.createDataFrame(rows, "slide_idx long, row int, col int, v double")
    weights = [[(0, 1.0)], px.gaussian_weights(0.5)]
    together = {tuple(r[:3]): r.asDict() for r in tl.picture_features(cells.coalesce(1), ["v"], weights, side=4).collect()}
    assert set(together) == {r[:3] for r in rows}
    for slide in sizes:
        for r in tl.picture_features(cells.where(F.col("slide_idx") == slide), ["v"], weights, side=4).collect():
            assert together[r.slide_idx, r.row, r.col] == pytest.approx(r.asDict())
    long = tl.picture_features(cells, ["v"], weights, side=4, long=True).collect()
    assert len(long) == 2 * len(rows)
    assert all((r.intensity, r.eig2) == pytest.approx((together[tuple(r[:3])][f"v_{r.scale}"], together[tuple(r[:3])][f"v_{r.scale}_eig2"])) for r in long)


def test_pixels_are_made_by_many_tasks_and_not_broadcast(spark):
    assert {r.p for r in pixels(spark, SMALL).select(F.spark_partition_id().alias("p")).distinct().collect()} != {0}
    plan = plan_of(QUERIES["mask_otsu"](spark, SMALL))
    assert "BroadcastHashJoin" not in plan and "sequence(0, 255" not in plan


def test_otsu_with_empty_bins(spark):
    """Against all 256 bins, for gaps wide enough that many bins hold nothing."""
    values = {1: [0, 0, 1, 9, 200, 210, 255], 2: [5, 5, 5], 3: [1, 2], 4: [3, 50, 51, 52, 90]}
    rows = [(s, 0, c, v) for s, vs in values.items() for c, v in enumerate(vs)]
    found = {r.slide_idx: r.threshold for r in px.otsu(spark.createDataFrame(rows, "slide_idx long, row int, col int, r int"), "r").collect()}
    for slide, vs in values.items():
        lo, hi = min(vs), max(vs)
        if lo == hi:
            assert found[slide] == lo
            continue
        width, counts, best = (hi - lo) / 256.0, [0] * 256, (-1.0, 0)
        for v in vs:
            counts[min(int((v - lo) / width), 255)] += 1
        n, m = sum(counts), sum(k * (i + 0.5) for i, k in enumerate(counts))
        for i in range(255):
            w1, m1 = sum(counts[: i + 1]), sum(k * (j + 0.5) for j, k in enumerate(counts[: i + 1]))
            between = round(w1 * (n - w1) * (m1 / w1 - (m - m1) / (n - w1)) ** 2, 6)
            best = max(best, (between, -i))
        assert found[slide] == pytest.approx(lo + (0.5 - best[1]) * width)


def test_clusters_of_slides_on_one_canvas(spark, monkeypatch):
    """Slides that are laid out together give the clusters that each gives alone, on one canvas or on several."""
    rng = random.Random(4)
    rows = [(s, r + 7 * s, c, 1.0) for s in range(1, 6) for r in range(12) for c in range(9 + s) if rng.random() < 0.4]
    cells = spark.createDataFrame(rows, "slide_idx long, row int, col int, value double")
    block = pa.table({"slide_idx": [r[0] for r in rows], "row": [r[1] for r in rows], "col": [r[2] for r in rows], "own": [True] * len(rows)})
    starts = np.array([k for k, r in enumerate(rows) if k == 0 or r[0] != rows[k - 1][0]])
    assert len(list(tl._laid_out(block, starts, 2))) == 1
    alone = {(r.slide_idx, r.row, r.col): r.comp for s in range(1, 6) for r in tl.dbscan(cells.where(F.col("slide_idx") == s), 2, 5).collect()}
    for canvas in (tl.CANVAS, 600):
        monkeypatch.setattr(tl, "CANVAS", canvas)
        assert {(r.slide_idx, r.row, r.col): r.comp for r in tl.dbscan(cells.coalesce(1), 2, 5).collect()} == alone
    assert len(list(tl._laid_out(block, starts, 2))) > 1


@pytest.mark.parametrize("name", ["froc_score", "froc_evaluate", "index_dataset"])
def test_no_mask_of_an_evaluation_is_broadcast(spark, name):
    """Nor does a plan broadcast more than its one-row totals."""
    assert "BroadcastHashJoin" not in plan_of(QUERIES[name](spark, SMALL))


def test_no_draw_of_lesions_is_broadcast(spark, monkeypatch):
    """Neither by froc_ci's own plan nor by those that write what it reads."""
    plans = []

    def kept(df, settled=rg.settled):
        plans.append(plan_of(df))
        return settled(df)

    monkeypatch.setattr(fr, "settled", kept)
    monkeypatch.setattr(rg, "settled", kept)
    plans.append(plan_of(QUERIES["froc_ci"](spark, SMALL)))
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)


def _froc_curves(spark):
    """Samples' curves of 40 slides with three regions each, hit twice or thrice; and the rows of each table that is written."""
    mask = spark.createDataFrame([(s, 4 * k, c, k + 1) for s in range(40) for k in range(3) for c in range(3)], "slide_idx long, row int, col int, label int")
    itc = spark.createDataFrame([(1, 3)], "slide_idx long, label int")
    lesions = [(s, (5 + (s + c) % 3) / 10, float(c), float(r)) for s in range(40) for r in (0, 4, 5, 8) for c in range(2 + s % 2)]
    df = spark.createDataFrame(lesions, "slide_idx long, prob_score double, centre_x double, centre_y double")
    curve = fr.froc_samples(df, mask, itc, spark.range(40), 0, 50, 11)
    return sorted((r.rep, r.threshold or -1.0, r.total_fps, r.sensitivity) for r in curve.collect())


def test_draws_of_lesions_are_not_written(spark, monkeypatch):
    """Only counts of regions by replicate and probability are, however many regions there are."""
    written = []

    def kept(df, settled=rg.settled):
        out = settled(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(fr, "settled", kept)
    assert _froc_curves(spark)
    assert written and max(written) <= 50 * 3


def test_first_draws_of_runs_that_parts_cut(spark, monkeypatch):
    """A run that goes on in the next part remembers which replicates have drawn it."""
    whole = _froc_curves(spark)
    monkeypatch.setattr(rs, "_GROUPS", 2)
    assert _froc_curves(spark) == whole


def test_draws_are_made_by_many_tasks(spark, monkeypatch):
    """As many as there are leaves and a shuffle has tasks, though the groups are few bytes."""
    monkeypatch.setattr(rs, "LEAF", 8)
    rows = rs.resample(spark.range(100), [F.asc("id")], 20, 3)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert rows.agg(F.sum("weight")).first()[0] == 20 * 100


def test_patches_are_summed_in_as_many_tasks_as_a_shuffle_has(spark):
    """Not in as many as their compressed bytes would ask for, nor before the shuffle."""
    plan = plan_of(patches(spark, SMALL))
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1


def _cells_of_squares(side):
    """Cells of several slides and squares, sorted by square, with the rim of one cell around each, and where squares begin."""
    rng, rows = random.Random(8), []
    for slide in (1, 2, 3):
        cells = {(r, c) for r in range(2 * side) for c in range(2 * side) if rng.random() < 0.6}
        for i in (0, 1):
            for j in (0, 1):
                near = [(r, c) for r, c in sorted(cells) if i * side - 1 <= r <= (i + 1) * side and j * side - 1 <= c <= (j + 1) * side]
                rows += [(slide, r, c, i, j, r // side == i and c // side == j) for r, c in near]
    table = pa.table(dict(zip(("slide_idx", "row", "col", "srow", "scol", "own"), map(list, zip(*rows)))))
    places = [(r[0], r[3], r[4]) for r in rows]
    return table, np.array([k for k, p in enumerate(places) if k == 0 or p != places[k - 1]])


def _together_and_alone(run, table, starts):
    alone = [t for lo, hi in zip(starts, [*starts[1:], table.num_rows]) for t in run(table.slice(lo, hi - lo), np.array([0]))]
    rows = lambda ts: sorted((tuple(map(str, r.values())) for t in ts for r in t.to_pylist()))
    return rows(run(table, starts)), rows(alone)


def test_contour_paths_of_squares_that_share_a_call(spark):
    together, alone = _together_and_alone(lambda t, s: ct._paths_of_squares(7, t, s), *_cells_of_squares(7))
    assert together == alone and len(together) > 30


def test_regions_and_hulls_of_squares_that_share_a_call(spark):
    table, starts = _cells_of_squares(7)
    own = table["own"].to_numpy()
    square = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(own))))[own]
    table, starts = table.filter(pa.array(own)), np.flatnonzero(np.diff(square, prepend=-1))
    placed = table.rename_columns(["slide_idx", "row", "col", "_row", "_col", "own"])
    together, alone = _together_and_alone(lambda t, s: rg._regions_of_squares(7, t, s), placed, starts)
    assert together == alone and len(together) == table.num_rows
    comps = table.drop_columns(["own"]).rename_columns(["slide_idx", "row", "col", "trow", "tcol"]).append_column("comp", pa.array(table["row"].to_numpy() % 3, pa.int32()))
    together, alone = _together_and_alone(rg._hulls, comps, starts)
    assert together == alone and len(together) > 12


def test_draws_kept_do_not_keep_their_leaf():
    draws = Draws(1000, 10, 5, leaf=64)
    assert all(draws.below(x).base is None for x in (3, 64, 70, 999, 1000))


def test_boosting_keeps_a_byte_for_each_cut(spark, monkeypatch):
    """And sums of a level are a row for each node, feature and cut, with a column for each class's derivatives."""
    written = []
    monkeypatch.setattr(bo, "settled", lambda df: written.append(dict(df.dtypes)) or rg.settled(df))
    rows = spark.range(60).select((F.col("id") * 7 % 11).cast("double").alias("a"), F.when(F.col("id") * 7 % 11 < 5, "x").otherwise("y").alias("k"))
    model = bo.fit(rows, ["a"], "k", rounds=3, depth=2)
    assert written[0]["b"] == "binary"
    assert bo.predict(rows, model).where("predictions <> k").isEmpty()
