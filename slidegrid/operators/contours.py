"""Contours of mask regions: closed rings along the sides of cells, nested by regions and their holes.

A cell side with nothing beyond it is a directed edge with the region on its right; at its end it goes on to the left where
a cell lies there (so cells that touch at a corner are one region), else straight on, else to the right. Edges are followed
within squares of a bounded number of cells; a ring that stays in one square is done there. What leaves its square is a
path, and rings of paths are put in order by pointer doubling: each round a path learns the least path id among twice as
many successors, and how many steps away it is. Rounds follow the logarithm of the squares that a ring crosses.

Corners are given as (x, y) in cells, from the ring's topmost, then leftmost one on; corners on a straight line are left
out. Outer rings run clockwise on the screen, holes the other way round, so a region's signed areas add up to its cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidegrid.functions.folders import discard
from slidegrid.operators import regions as rg
from slidegrid.operators.regions import CELL, components, settled
from slidegrid.operators.tiles import by_blocks

_LINE = 2**31


def _paths_of_squares(side: int, cells: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
    """Rings and paths along the squares' own cells; the cells around them (not own) only say where edges go on. Squares are laid
    out below one another with the line and the column of cells around each, and their edges are put in order together: in
    rounds of doubling, each learns the first edge of its path (the least one of its ring), then its distance from it."""
    row, col, srow, scol = (cells[c].to_numpy().astype(np.int64) for c in ("row", "col", "srow", "scol"))
    square, wide = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row)))), side + 2
    top, left, slide = srow[starts] * side - 1, scol[starts] * side - 1, cells["slide_idx"].take(pa.array(starts))
    laid = (square * wide + row - top[square]) * wide + col - left[square]
    own, every = np.unique(laid[cells["own"].to_numpy()]), np.unique(laid)
    has = lambda p: every[np.minimum(np.searchsorted(every, p), len(every) - 1)] == p
    step = [1, wide, -1, -wide]  # along the top side, the right one, the bottom, the left one
    ids, following = [], []
    for d in range(4):
        at = own[~has(own + step[d - 1])]
        ahead, beside = at + step[d], at + step[d] + step[d - 1]
        turn = np.where(has(beside), beside * 4 + (d + 3) % 4, np.where(has(ahead), ahead * 4 + d, at * 4 + (d + 1) % 4))
        ids.append(at * 4 + d)
        following.append(turn)
    ids, following = np.concatenate(ids), np.concatenate(following)
    if not len(ids):
        return
    order = np.argsort(ids)
    ids, following = ids[order], following[order]
    count, at = len(ids), np.minimum(np.searchsorted(ids, following), len(ids) - 1)
    inside = np.flatnonzero(ids[at] == following)
    back, entered = np.arange(count), np.zeros(count, dtype=bool)
    back[at[inside]], entered[at[inside]] = inside, True
    first, jump = np.where(entered, np.arange(count) + count, np.arange(count)), back  # edges that paths begin with come before all others
    while ((least := np.minimum(first, first[jump])) != first).any():
        first, jump = least, jump[jump]
    ring = first >= count
    first = first % count
    jump = np.where(first == np.arange(count), first, back)
    away = (jump != np.arange(count)).astype(np.int64)
    while (jump != first).any():
        away, jump = away + away[jump], jump[jump]
    order = np.lexsort((away, first))
    direction = ids[order] % 4
    begins = np.flatnonzero(away[order] == 0)
    ends = np.append(begins[1:], count) - 1
    corner = np.append(True, direction[1:] != direction[:-1])
    closed = ring[order[begins]]
    corner[begins] = ~closed | (direction[ends] != direction[begins])

    def line(edges: np.ndarray) -> np.ndarray:
        return edges // 4 // wide % wide + top[edges // 4 // (wide * wide)]

    def column(edges: np.ndarray) -> np.ndarray:
        return edges // 4 % wide + left[edges // 4 // (wide * wide)]

    def named(edges: np.ndarray) -> pa.Array:
        return pa.array((line(edges) * _LINE + column(edges)) * 4 + edges % 4)

    turns = ids[order[corner]]
    x, y = column(turns) + np.isin(turns % 4, (1, 2)), line(turns) + np.isin(turns % 4, (2, 3))
    points = pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=["x", "y"])
    points = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.add.reduceat(corner.astype(np.int64), begins))), pa.int32()), points)
    heads, tails = ids[order[begins]], order[ends]
    yield pa.table({
        "slide_idx": slide.take(pa.array(heads // 4 // (wide * wide))), "id": named(heads), "next": named(following[tails]), "closed": pa.array(closed),
        "d0": pa.array(direction[begins], pa.int32()), "d1": pa.array(direction[ends], pa.int32()), "points": points,
    })


def _paths(mask: DataFrame) -> DataFrame:
    """slide_idx, id (first edge), next (the edge that follows), closed, d0 and d1 (first and last direction), points."""
    side = rg.SQUARE
    cells = mask.where("mask").select(*CELL)
    square = [F.floor(F.col(c) / side).cast("int").alias(f"s{c}") for c in ("row", "col")]
    # A cell on the rim of its square is sent to the squares beyond, too.
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    touches = lambda c, k: (k == 0) | ((k == -1) & (F.pmod(c, F.lit(side)) == 0)) | ((k == 1) & (F.pmod(c, F.lit(side)) == side - 1))
    sent = cells.select(*CELL, *square, F.explode(F.filter(near, lambda s: touches(F.col("row"), s["i"]) & touches(F.col("col"), s["j"]))).alias("s"))
    sent = sent.select(*CELL, (F.col("srow") + F.col("s.i")).alias("srow"), (F.col("scol") + F.col("s.j")).alias("scol"), ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own"))
    schema = "slide_idx long, id long, next long, closed boolean, d0 int, d1 int, points array<struct<x: int, y: int>>"
    return by_blocks(sent, ["slide_idx", "srow", "scol"], partial(_paths_of_squares, side), schema)


def _ordered(paths: DataFrame) -> DataFrame:
    """slide_idx, id, ring (least path id of the ring), place (from 0 at that path) of paths (slide_idx, id, next)."""
    spark = paths.sparkSession
    state = settled(paths.select("slide_idx", "id", "next", F.col("next").alias("far"), F.col("id").alias("least"), F.lit(0).alias("off"), F.lit(1).alias("span")))
    while True:
        beyond = state.select("slide_idx", F.col("id").alias("next"), F.col("least").alias("after"))
        if state.join(beyond, ["slide_idx", "next"]).where("least <> after").isEmpty():
            break
        beyond = state.select("slide_idx", F.col("id").alias("far"), F.col("far").alias("f2"), F.col("least").alias("l2"), F.col("off").alias("o2"))
        nearer = F.col("l2") < F.col("least")
        joined = state.join(beyond, ["slide_idx", "far"])
        following = settled(
            joined.select("slide_idx", "id", "next", F.col("f2").alias("far"), F.least("least", "l2").alias("least"), F.when(nearer, F.col("o2") + F.col("span")).otherwise(F.col("off")).alias("off"), (F.col("span") * 2).alias("span"))
        )
        discard(spark, state.settled_path)
        state = following
    n = state.groupBy("slide_idx", "least").agg(F.count("*").alias("n"))
    return state.join(n, ["slide_idx", "least"]).select("slide_idx", "id", F.col("least").alias("ring"), F.pmod(F.col("n") - F.col("off"), F.col("n")).alias("place"))


def _turned(points: Column) -> Column:
    """A ring's corners from the topmost, then leftmost one on."""
    order = F.transform(points, lambda p, i: F.struct(p["y"].alias("y"), p["x"].alias("x"), i.alias("i")))
    first = F.array_min(order)["i"]
    return F.concat(F.slice(points, first + 1, F.size(points)), F.slice(points, 1, first))


def rings(mask: DataFrame) -> DataFrame:
    """slide_idx, ring (an edge of it), row and col (the cell of that edge), area (signed, in cells) and points of each ring."""
    paths = settled(_paths(mask))
    done = paths.where("closed").select("slide_idx", F.col("id").alias("ring"), "points")
    open_ = paths.where("not closed")
    if not open_.isEmpty():
        part = F.struct("place", "d0", "d1", "points")
        joined = open_.join(_ordered(open_), ["slide_idx", "id"]).groupBy("slide_idx", "ring").agg(F.array_sort(F.collect_list(part)).alias("ps"))
        before = lambda i: F.element_at("ps", F.when(i == 0, F.size("ps")).otherwise(i).cast("int"))
        kept = F.transform("ps", lambda p, i: F.when(p["d0"] == before(i)["d1"], F.slice(p["points"], 2, F.size(p["points"]))).otherwise(p["points"]))
        done = done.unionByName(joined.select("slide_idx", "ring", F.flatten(kept).alias("points")))
    done = done.withColumn("points", _turned(F.col("points")))
    cross = lambda p, i: p["x"].cast("long") * _after(i)["y"] - _after(i)["x"].cast("long") * p["y"]
    area = F.aggregate(F.transform("points", cross), F.lit(0).cast("long"), lambda a, b: a + b) / 2
    at = F.shiftright("ring", 2)
    return done.select("slide_idx", "ring", F.shiftright(at, 31).cast("int").alias("row"), at.bitwiseAND(_LINE - 1).cast("int").alias("col"), area.cast("long").alias("area"), "points")


def _after(i: Column) -> Column:
    return F.element_at("points", F.when(i + 1 == F.size("points"), 1).otherwise(i + 2).cast("int"))


def _uprights(of: DataFrame, *keep: str) -> DataFrame:
    """slide_idx, row and x of each vertical side of a cell on the rings, with the columns to keep."""
    ends = F.transform("points", lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("a"), _after(i)["x"].alias("x2"), _after(i)["y"].alias("b")))
    lines = of.select("slide_idx", *keep, F.explode(F.filter(ends, lambda s: s["x"] == s["x2"])).alias("s"))
    rows = F.explode(F.sequence(F.least("s.a", "s.b"), F.greatest("s.a", "s.b") - 1))
    return lines.select("slide_idx", *keep, rows.alias("row"), F.col("s.x").alias("x"))


def contours(mask: DataFrame) -> DataFrame:
    """slide_idx, comp (as `components` numbers regions), parent (the region whose hole it lies in, null for none), depth (regions
    around it), area, outer (points) and holes (arrays of points, by first corner) of each region of a mask.
    What lies left of a region's first cell in scan order tells where it is: beyond the nearest side to the left there is
    another region, and the side is on one of its holes, which then holds the region, or on its outer ring, and
    then both lie in the same hole or in none."""
    cells = components(mask.where("mask").select(*CELL))
    found = settled(rings(mask).join(cells, CELL).select("slide_idx", "comp", "ring", "area", "points"))
    outer = found.where("area > 0")
    first = outer.select("slide_idx", "comp", F.col("points")[0]["y"].alias("row"), F.col("points")[0]["x"].alias("x"))
    asked = first.select("slide_idx", "row").distinct()
    sides = _uprights(found, "comp", "area").join(asked, ["slide_idx", "row"], "left_semi")
    left = Window.partitionBy("slide_idx", "row").orderBy("x")  # a line of the mask
    beside = sides.select("slide_idx", "row", "x", F.lag("comp").over(left).alias("other"), (F.lag("area").over(left) < 0).alias("within"))
    link = first.join(beside, ["slide_idx", "row", "x"]).select("slide_idx", "comp", "other", F.coalesce("within", F.lit(True)).alias("known"))
    # A region beside another one has that one's parent: follow until a hole's region, or nothing, is reached.
    link = settled(link)
    while not link.where("not known").isEmpty():
        up = link.select("slide_idx", F.col("comp").alias("other"), F.col("other").alias("o2"), F.col("known").alias("k2"))
        moved = link.join(up, ["slide_idx", "other"], "left")
        following = settled(moved.select("slide_idx", "comp", F.when(F.col("known"), F.col("other")).otherwise(F.col("o2")).alias("other"), (F.col("known") | F.col("k2")).alias("known")))
        discard(mask.sparkSession, link.settled_path)
        link = following
    parents = link.select("slide_idx", "comp", F.col("other").alias("parent"))
    depth = settled(parents.select("slide_idx", "comp", F.col("parent").alias("above"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")))
    while not depth.where("above is not null").isEmpty():  # doubling: the depth up to `above`, then above's own
        up = depth.select("slide_idx", F.col("comp").alias("above"), F.col("above").alias("a2"), F.col("depth").alias("d2"))
        following = settled(depth.join(up, ["slide_idx", "above"], "left").select("slide_idx", "comp", F.col("a2").alias("above"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")))
        discard(mask.sparkSession, depth.settled_path)
        depth = following
    order = F.struct(F.col("points")[0]["y"].alias("y"), F.col("points")[0]["x"].alias("x"), "points")
    grouped = found.groupBy("slide_idx", "comp").agg(
        F.sum("area").alias("area"), F.max_by("points", "area").alias("outer"), F.array_sort(F.collect_list(F.when(F.col("area") < 0, order))).alias("hs")
    )
    return grouped.join(parents, ["slide_idx", "comp"]).join(depth.drop("above"), ["slide_idx", "comp"]).select(
        "slide_idx", "comp", "parent", "depth", "area", "outer", F.transform("hs", lambda h: h["points"]).alias("holes")
    )


def polygon(scale: int = 1) -> Column:
    """A region's rings as nested lists [outer, hole, ...] of points [x, y], in pixels of a level `scale` times as fine."""
    flat = lambda ps: F.transform(ps, lambda p: F.array(p["x"] * scale, p["y"] * scale))
    return F.concat(F.array(flat(F.col("outer"))), F.transform("holes", flat))


def regions_json(found: DataFrame, label: str, scale: int = 1, two_levels: bool = False) -> DataFrame:
    """slide_idx and json, the text {label: [polygon, ...]} of a slide, each region a polygon of its own. The two-level form
    takes regions in the order of their numbers; the tree form first outermost regions without holes, then those within
    holes of others, then outermost ones with holes."""
    group = F.when(F.col("depth") > 0, 1).when(F.size("holes") > 0, 2).otherwise(0)
    place = F.struct((F.lit(0) if two_levels else group).alias("g"), "comp", polygon(scale).alias("rings"))
    listed = found.groupBy("slide_idx").agg(F.array_sort(F.collect_list(place)).alias("ps"))
    return listed.select("slide_idx", F.to_json(F.create_map(F.lit(label), F.transform("ps", lambda p: p["rings"]))).alias("json"))


def filled(found: DataFrame) -> DataFrame:
    """slide_idx, row, col and comp of the cells within each region's rings, by parity along each line."""
    all_rings = found.select("slide_idx", "comp", F.explode(F.concat(F.array("outer"), F.col("holes"))).alias("points"))
    lines = _uprights(all_rings, "comp").groupBy("slide_idx", "comp", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2 - 1).cast("int")), lambda i: F.sequence(F.get("xs", 2 * i), F.get("xs", 2 * i + 1) - 1))
    return lines.select("slide_idx", "comp", "row", F.explode(F.flatten(pairs)).alias("col"))
