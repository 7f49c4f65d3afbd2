"""Resampling with replacement without a table of draws.

The n rows of a table, in a fixed order, are the places 0 to n - 1; a replicate throws n draws at them. How many of a
range's draws fall in its first half is binomial, so halving ranges of places down to leaves gives every leaf its exact
share of each replicate, and within a leaf the draws are single ones, from a hash of replicate, leaf and number. Whoever holds
some places works out the draws on them alone, from the seed, whatever the partitions are: nothing is drawn that another
task needs, and nothing drawn is shuffled. Rows that a figure can't tell apart (patches of one score and label, slides of
one cell of a confusion table) are one group of consecutive places, however many they are: what falls below its end less
what falls below its beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidegrid.operators.regions import settled

#: Places of a leaf, replicates whose single draws are made at a time, and groups whose curves are built at a time.
LEAF, _AT_ONCE, _GROUPS = 8192, 64, 1024
_A, _B = np.uint64(6364136223846793005), np.uint64(1442695040888963407)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of unsigned 64-bit numbers; mixed_sql is the same."""
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def mixed_sql(value: str, name: str) -> str:
    """Columns name_0 to name_5 of a select list, the last of which is the hash of value."""
    n, whole = name, "18446744073709551616::hugeint"
    return f"(({value}) % {whole}) as {n}_0, xor({n}_0, {n}_0 >> 32) * {_A}::hugeint % {whole} as {n}_1, xor({n}_1, {n}_1 >> 29) * {_B}::hugeint % {whole} as {n}_2, xor({n}_2, {n}_2 >> 32) as {n}_5"


class Draws:
    """The draws of all replicates on n places; below(x) counts those on places before x, a number for each replicate."""

    def __init__(self, n: int, reps: int, seed: int, leaf: int = LEAF):
        self.n, self.reps, self.seed, self.leaf = n, reps, seed, leaf
        self.leaves = -(-n // self.leaf)
        self.keys = mixed((np.uint64(seed) << np.uint64(32)) + np.arange(reps, dtype=np.uint64))
        self.ranges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0))

    def _share(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Draws before a leaf and on it, by halving the range of all leaves."""
        lo, hi = 0, self.leaves
        before, own = np.zeros(self.reps, dtype=np.int64), np.full(self.reps, self.n, dtype=np.int64)
        places = lambda k: min(k * self.leaf, self.n)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if (lo, hi) not in self.ranges:
                if len(self.ranges) > 500:
                    self.ranges.clear()
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence((self.seed, lo, hi))))
                first = rng.binomial(own, (places(mid) - places(lo)) / (places(hi) - places(lo)))
                self.ranges[lo, hi] = first, own - first
            first, rest = self.ranges[lo, hi]
            if leaf < mid:
                hi, own = mid, first
            else:
                lo, before, own = mid, before + first, rest
        return before, own

    def _on_leaf(self, leaf: int) -> np.ndarray:
        """(reps, places + 1): draws before the leaf or on its first places."""
        if self.held[0] != leaf:
            self.held = -1, np.empty(0)
            before, own = self._share(leaf)
            size = min(self.leaf, self.n - leaf * self.leaf)
            keys = mixed(self.keys + np.uint64(leaf))
            out = np.zeros((self.reps, size + 1), dtype=np.int64)
            for at in range(0, self.reps, _AT_ONCE):
                part = own[at : at + _AT_ONCE]
                rep = np.repeat(np.arange(len(part)), part)
                number = np.arange(len(rep)) - np.repeat(np.cumsum(part) - part, part)
                place = ((mixed(keys[at : at + _AT_ONCE][rep] + number.astype(np.uint64)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
                out[at : at + _AT_ONCE, 1:] = np.bincount(rep * size + place, minlength=len(part) * size).reshape(len(part), size)
            np.cumsum(out, axis=1, out=out)
            out += before[:, None]
            self.held = leaf, out
        return self.held[1]

    def below(self, x: int) -> np.ndarray:
        """A copy: a view would hold the whole leaf for as long as the caller keeps it."""
        if x >= self.n:
            return np.full(self.reps, self.n, dtype=np.int64)
        leaf, place = divmod(x, self.leaf)
        return self._on_leaf(leaf)[:, place].copy() if place else self._share(leaf)[0]


def spans(groups: DataFrame, order: list[Column], count: str, ranges: list[Column] | None = None) -> tuple[DataFrame, int]:
    """Adds _first, the places before a group, in a total order of the groups, and _p, the range of the order that a group lies
    in; and gives the number of all places. Ranges are summed on their own and then moved by the sums of those before.
    With `ranges`, columns that the order agrees with, there are as many ranges as a shuffle has tasks, and groups that
    agree in these columns share one."""
    dealt = groups.repartitionByRange(*order) if ranges is None else groups.repartitionByRange(_tasks(groups), *ranges)
    ranged = settled(dealt.withColumn("_p", F.spark_partition_id()))
    totals = ranged.groupBy("_p").agg(F.sum(count).alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = settled(totals.select("_p", "_t", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_in", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(totals.select("_p", "_before"), "_p")
    n = totals.agg(F.sum("_t")).first()[0] or 0
    return placed.withColumn("_first", F.col("_in") + F.col("_before")).drop("_in", "_before"), int(n)


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_ranges(placed: DataFrame, n: int) -> DataFrame:
    """Neighbouring ranges in one task, in order: as many tasks as a shuffle has, but no more than leaves, since a task makes
    whole ones. Groups are few bytes, their draws many rows, so the bytes must not say how many tasks there are."""
    return placed.repartitionByRange(max(1, min(_tasks(placed), -(-n // LEAF))), "_p").sortWithinPartitions("_first")


def _weights(draws: Draws, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(reps, groups): draws on each group."""
    return np.stack([draws.below(b) - draws.below(a) for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)], axis=1)


def drawn(placed: DataFrame, n: int, reps: int, seed: int, count: str, columns: list[str]) -> DataFrame:
    """rep, weight and the columns of groups that spans() has placed: how often each replicate drew a row of the group,
    where it did."""
    leaf, at_once = LEAF, _GROUPS
    rows = _by_ranges(placed, n).select("_first", count, *[F.col(c) for c in columns])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = Draws(n, reps, seed, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                weights = _weights(draws, part.column(0).to_numpy(), part.column(1).to_numpy())
                for lo in range(0, reps, _AT_ONCE):
                    rep, row = np.nonzero(weights[lo : lo + _AT_ONCE])
                    taken = pa.RecordBatch.from_arrays(part.columns[2:], names=columns).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(rep + lo, pa.int32()), pa.array(weights[rep + lo, row]), *taken.columns], names=["rep", "weight", *columns])

    schema = ", ".join(["rep int", "weight long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])])
    return rows.mapInArrow(draw, schema)


def first_drawn(placed: DataFrame, n: int, reps: int, seed: int, count: str, run: list[str], value: str) -> DataFrame:
    """rep, weight and value: in how many runs of groups that agree in `run` each replicate's first drawn group has the value (a
    double). spans() must have placed the groups by an order that begins with `run`, and by ranges that keep runs whole.
    Tasks count their own runs, so that no row for each draw is written or shuffled; the counts of a value are to be summed."""
    leaf, at_once = LEAF, _GROUPS
    begins = ~F.struct(*run).eqNullSafe(F.lag(F.struct(*run)).over(Window.partitionBy("_p").orderBy("_first")))
    rows = _by_ranges(placed.withColumn("_begins", begins), n).select("_first", count, "_begins", F.col(value).alias("value"))

    def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, done = Draws(n, reps, seed, leaf), np.zeros(reps, dtype=bool)  # done: the run that goes on has been drawn
        totals: dict[float, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            values, weights = np.array(list(totals)), np.stack(list(totals.values()))
            which, rep = np.nonzero(weights)
            return pa.RecordBatch.from_arrays([pa.array(rep, pa.int32()), pa.array(weights[which, rep], pa.int64()), pa.array(values[which], pa.float64())], names=["rep", "weight", "value"])

        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                hit = _weights(draws, part.column(0).to_numpy(), part.column(1).to_numpy()) > 0
                starts = part.column(2).to_numpy(zero_copy_only=False)
                upto = np.cumsum(hit, axis=1, dtype=np.int32)
                # Drawn groups before each group's run; what the run had before this part counts too.
                head = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), -1))
                before = np.where(head[None] > 0, upto[:, np.maximum(head, 1) - 1], np.where(head[None] < 0, -done[:, None].astype(np.int32), 0))
                first = hit & (upto - before == 1)
                done = upto[:, -1] > before[:, -1]
                values, code = np.unique(part.column(3).to_numpy(), return_inverse=True)
                order = np.argsort(code, kind="stable")
                sums = np.add.reduceat(first[:, order], np.searchsorted(code[order], np.arange(len(values))), axis=1, dtype=np.int64)
                for k, v in enumerate(values.tolist()):
                    totals[v] = totals[v] + sums[:, k] if v in totals else sums[:, k].copy()
                if len(totals) > at_once:
                    yield out()
                    totals.clear()
        if totals:
            yield out()

    return rows.mapInArrow(count_runs, "rep int, weight long, value double").withColumnRenamed("value", value)


def resample(groups: DataFrame, order: list[Column], reps: int, seed: int, count: str | None = None) -> DataFrame:
    """rep, weight and the groups' columns: how often each replicate drew a row of the group, where it did. Groups are rows, or
    `count` equal rows; the order must be total."""
    counted = groups.withColumn("_n", F.col(count).cast("long") if count else F.lit(1).cast("long"))
    placed, n = spans(counted, order, "_n", order)
    return drawn(placed, n, reps, seed, "_n", groups.columns)


def resampled_curves(
    counts: DataFrame, reps: int, seed: int, x: str, y: str, levels: list[float], threshold: float, strict: bool = False, origin: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Curves of all replicates in two passes over the distinct scores in falling order; counts has threshold (a score), p and
    n (its positive and negative rows). Gives
    figures (rep, tn, fp, fn, tp) of scores at or above (strict: above) `threshold`, and
    values (rep, k, level, value) of the measure y at levels of x, between its points in a straight line, ends held.
    Measures: recall, precision and fpr; origin adds the point (0, 0). Replicates that lack positive rows, or negative
    ones where fpr is asked for, have no values.
    The first pass sums a range's positive draws; with those of the ranges before, a range knows the point it begins at,
    and each level is settled in the range where the curve passes it."""
    rows = counts.select("threshold", F.col("p").cast("long").alias("p"), F.col("n").cast("long").alias("n")).withColumn("_n", F.col("p") + F.col("n"))
    placed, total = spans(rows, [F.desc("threshold")], "_n")
    placed = settled(placed.select("_p", "_first", "p", "n", "threshold"))
    asked, leaf, at_once = np.array(levels), LEAF, _GROUPS

    def runs(batch: pa.RecordBatch, places: Column) -> Iterator[pa.RecordBatch]:
        cuts = [0, *(np.flatnonzero(np.diff(batch.column(places).to_numpy())) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            for at in range(lo, hi, at_once):
                yield batch.slice(at, min(at_once, hi - at))

    def positives(part: pa.RecordBatch, draws: Draws, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(groups, reps): positive draws of each group, and all draws up to its end."""
        first, p, n = (part.column(at + i).to_numpy().tolist() for i in range(3))
        own, end = [], []
        for a, b, c in zip(first, p, n, strict=True):  # in the order of places, so that each leaf is drawn once
            begun = draws.below(a)
            own.append(draws.below(a + b) - begun)
            end.append(draws.below(a + b + c))
        return np.stack(own), np.stack(end)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = Draws(total, reps, seed, leaf)
        for batch in batches:
            for part in runs(batch, 0):
                own, _ = positives(part, draws, 1)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0)[0].as_py()] * reps, pa.int32()), pa.array(np.arange(reps), pa.int32()), pa.array(own.sum(axis=0))], names=["_p", "rep", "tp"])

    of_range = placed.repartition("_p").sortWithinPartitions("_p", "_first").mapInArrow(sums, "_p int, rep int, tp long").groupBy("_p", "rep").agg(F.sum("tp").alias("tp"))
    up, all_ = Window.partitionBy("rep").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("rep")  # a row for each range
    begin = of_range.select("_p", "rep", F.coalesce(F.sum("tp").over(up), F.lit(0)).alias("tp"), F.sum("tp").over(all_).alias("all"), (F.max("_p").over(all_) == F.col("_p")).alias("last"))
    held = F.array_sort(F.collect_list(F.struct("rep", "tp", "all")))
    heads = begin.groupBy("_p").agg(held.alias("held"), F.max("last").alias("last"))
    heads = heads.select("_p", F.lit(-1).cast("long").alias("_first"), *[F.lit(0).cast("long").alias(c) for c in "pn"], F.lit(None).cast("double").alias("threshold"), F.col("held.tp").alias("tp"), F.col("held.all").alias("all"), "last")
    body = placed.select("*", *[F.lit(None).cast("array<bigint>").alias(c) for c in ("tp", "all")], F.lit(None).cast("boolean").alias("last"))
    both = heads.unionByName(body).repartition("_p").sortWithinPartitions("_p", "_first")

    def measure(name: str, tp: np.ndarray, fp: np.ndarray, all_p: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return {"recall": lambda: tp / all_p, "precision": lambda: tp / (tp + fp), "fpr": lambda: fp / (total - all_p)}[name]()

    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = Draws(total, reps, seed, leaf)
        tp = fp = all_p = usable = said = last = None

        def out(rep: np.ndarray, k: np.ndarray, value: np.ndarray, counted: np.ndarray | None = None) -> pa.RecordBatch:
            figures = [pa.array(c, pa.int64()) for c in counted] if counted is not None else [pa.nulls(len(rep), pa.int64())] * 3
            return pa.RecordBatch.from_arrays([pa.array(rep, pa.int32()), pa.array(k, pa.int32()), pa.array(value, pa.float64()), *figures], names=["rep", "k", "value", "tp", "fp", "all"])

        def closed() -> Iterator[pa.RecordBatch]:
            if tp is None:
                return
            yield out(np.arange(reps), np.full(reps, -1), np.full(reps, np.nan), np.stack([*said, all_p]))
            if last:
                end_x, end_y = measure(x, tp, fp, all_p), measure(y, tp, fp, all_p)
                rep, k = np.nonzero(usable[:, None] & (asked[None] >= end_x[:, None]))
                yield out(rep, k, end_y[rep])

        for batch in batches:
            for part in runs(batch, 0):
                if part.column(1)[0].as_py() < 0:
                    yield from closed()
                    tp, all_p = (np.array(part.column(i)[0].as_py()) for i in (5, 6))
                    last, fp, said = part.column(7)[0].as_py(), None, np.zeros((2, reps), dtype=np.int64)
                    usable = (all_p > 0) & ((all_p < total) | ("fpr" not in (x, y)))
                    part = part.slice(1)
                    if not part.num_rows:
                        continue
                own, end = positives(part, draws, 1)
                if fp is None:
                    fp = draws.below(part.column(1)[0].as_py()) - tp
                run = np.vstack([tp, tp + np.cumsum(own, axis=0)])
                false = np.vstack([fp, end - run[1:]])
                score = part.column(4).to_numpy(zero_copy_only=False)
                counts_here = (score > threshold) if strict else (score >= threshold)
                said += np.stack([np.diff(a, axis=0)[counts_here].sum(axis=0) for a in (run, false)])
                xs, ys = measure(x, run, false, all_p), measure(y, run, false, all_p)
                empty = run + false == 0
                if origin:
                    xs[empty], ys[empty] = 0.0, 0.0
                else:
                    xs[empty] = -np.inf
                found = []
                for r in np.flatnonzero(usable):
                    lo = np.searchsorted(xs[:, r], asked, side="right") - 1
                    k = np.flatnonzero((lo >= 0) & (lo < len(xs) - 1))
                    lo = lo[k]
                    x0, x1, y0, y1 = xs[lo, r], xs[lo + 1, r], ys[lo, r], ys[lo + 1, r]
                    with np.errstate(invalid="ignore"):
                        found.append((np.full(len(k), r), k, np.where(np.isinf(x0), y1, y0 + (asked[k] - x0) * (y1 - y0) / (x1 - x0))))
                if found:
                    yield out(*(np.concatenate(c) for c in zip(*found, strict=True)))
                tp, fp = run[-1], false[-1]
        yield from closed()

    every = settled(both.mapInArrow(curves, "rep int, k int, value double, tp long, fp long, all long"))
    counted = every.where("k < 0").groupBy("rep").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.max("all").alias("all"))
    figures = counted.select("rep", (F.lit(total) - F.col("all") - F.col("fp")).alias("tn"), "fp", (F.col("all") - F.col("tp")).alias("fn"), "tp")
    level = F.get(F.array(*[F.lit(float(v)) for v in levels]), F.col("k"))
    return figures, every.where("k >= 0").select("rep", "k", level.alias("level"), "value")
