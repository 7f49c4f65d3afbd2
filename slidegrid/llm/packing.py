"""Packing of documents into sequences of bounded length by bin completion over the table of lengths.

Lengths are integers up to the capacity, so equal lengths are interchangeable: Spark counts pieces by length (at most
`capacity` rows, whatever the input), the search fills bins from these counts, and Spark deals the pieces to the
places that the plan gives their length. The search is bin completion by branch and bound: around the largest length
left it enumerates the undominated fillings of the rest of the bin, least waste first, along a table of the sums that
the lengths left can reach, so that no branch of the enumeration ends without a filling. A filling is tried as often as the
counts allow, then less often, then the next; a branch ends where its waste so far leaves no room to beat the incumbent, and
the search goes back. Best-fit decreasing is the first incumbent. Before it goes back anywhere, the search goes down from the
root a number of times along fillings of greatest value instead of least waste: a length is worth more the more was wasted
where it was packed the last time, so lengths that leave bad rests are used while others can still complete their bins, and
each descent corrects the values for the next. The search ends when a lower bound of the bins proves the incumbent best
or when all is tried; `descents` and `nodes` (fillings looked at, None for all) bound it for callers that want a plan in bounded
time, with the best one found until then.

Rows: null texts are empty documents (their end id remains); rows that share an id are packed each for itself; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidegrid.llm.encoding import TABLE_BYTES, encoder
from slidegrid.llm.shared import stash, tidied
from slidegrid.llm.token_shards import slices_of

#: Buckets by which pieces of one length are numbered side by side.
RANK_BUCKETS = 512
#: Budgets of the search where the caller names none: descents along values, and fillings looked at while going back. They
#: bound its time on the driver to a minute or two for any number of documents; most tables need neither.
DESCENTS, SEARCH_NODES = 16, 1_000
#: Cells of the descents' tables (steps of lengths times room) after which they end, half a minute; none with descents=None.
CELLS = 2_000_000_000
#: Power of its length that a length is worth at first.
WORTH = 1.02


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Encodes each document, appends end_id and cuts what is longer than the capacity, the first piece taking the
    remainder: doc_id, piece, start, length, ids_crc32, row_key (of the row, for ties) and, if asked for, ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, row_key long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(tokenizer_path, table_bytes), end_id.to_bytes(4, "little")
        for batch in batches:
            doc_ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for at, piece in slices_of(batch.column(1)):
                for k, raw in enumerate(tokens.encode(piece), at):
                    raw += end
                    n = len(raw) // 4
                    stops = range((n - 1) % capacity + 1, n + 1, capacity)
                    for p, stop in enumerate(stops):
                        start = max(0, stop - capacity) if p else 0
                        ids = raw[4 * start : 4 * stop]
                        for column, value in zip(out, (doc_ids[k], p, start, stop - start, zlib.crc32(ids), keys[k], ids if with_ids else None), strict=True):
                            column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)][: 6 + with_ids]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "row_key", "ids"][: 6 + with_ids])

    return rows.withColumn("row_key", F.xxhash64("doc_id", "text")).mapInArrow(tidied(cut), schema)


def _reachable(room: int, lengths: list[int], counts: list[int]) -> list[int]:
    """For each k the sums up to `room` that lengths[k:] reach within their counts, as bits of a number."""
    out, sums, mask = [1], 1, (1 << room + 1) - 1
    for length, n in zip(reversed(lengths), reversed(counts)):
        step, n = 1, min(n, room // length)
        while n:
            step = min(step, n)
            sums |= sums << step * length & mask
            n, step = n - step, 2 * step
        out.append(sums)
    return out[::-1]


def _dominated(filling: dict[int, int], waste: int, lengths: list[int], counts: list[int]) -> bool:
    """Whether another length that is left would still fit, or would fit in the place of one or two smaller ones: what
    is then free is no harder to place than the other length."""
    free = sum(1 << length for k, (length, n) in enumerate(zip(lengths, counts, strict=True)) if n > filling.get(k, 0))
    held = [lengths[k] for k, n in filling.items() for _ in range(min(n, 2))]
    sums = {*held, *(held[i] + held[j] for i in range(len(held)) for j in range(i))}
    single, among = set(held), lambda lo, hi: free >> lo & (1 << hi - lo + 1) - 1  # free lengths from lo to hi
    return bool(among(0, waste)) or any(among(x + (x in single), x + waste) for x in sums)


def _fillings(room: int, lengths: list[int], counts: list[int], most_waste: int) -> Iterator[dict[int, int] | None]:
    """Undominated fillings {place in lengths: number} of `room` by lengths (descending), least waste first, then the
    largest lengths first; None for each that is dominated."""
    reach = _reachable(room, lengths, counts)

    def go(at: int, rest: int, chosen: dict[int, int]) -> Iterator[dict[int, int]]:
        if not rest:
            yield dict(chosen)
            return
        for k in range(at, len(lengths)):
            if not reach[k] >> rest & 1:
                return
            for n in range(min(counts[k], rest // lengths[k]), 0, -1):
                if reach[k + 1] >> rest - n * lengths[k] & 1:
                    chosen[k] = n
                    yield from go(k + 1, rest - n * lengths[k], chosen)
                    del chosen[k]

    for waste in range(min(most_waste, room) + 1):
        if reach[0] >> room - waste & 1:
            for filling in go(0, room - waste, {}):
                yield None if _dominated(filling, waste, lengths, counts) else filling


def least_bins(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A lower bound: pieces above half the capacity need a bin each, and those from some length to the half fill what such
    bins leave or need bins of their own; the best over all such lengths."""
    total = math.ceil(int((lengths * counts).sum()) / capacity)
    large = lengths * 2 > capacity
    best = max(total, int(counts[large].sum()))
    for k in np.unique(np.append(lengths[~large], capacity - lengths[large])).tolist():
        alone, beside, small = lengths > capacity - k, large & (lengths <= capacity - k), ~large & (lengths >= k)
        free = int(counts[beside].sum()) * capacity - int((lengths * counts)[beside].sum())
        more = max(0, math.ceil((int((lengths * counts)[small].sum()) - free) / capacity))
        best = max(best, int(counts[alone].sum()) + int(counts[beside].sum()) + more)
    return best


def _best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: the largest length left, then again and again the largest that still fits."""
    left, plan = counts.copy(), []
    for i in range(len(lengths)):
        while left[i]:
            rest, bin_, use = capacity, [], {}
            for j in range(i, len(lengths)):
                n = min(int(left[j]) - use.get(j, 0), rest // int(lengths[j]))
                if n > 0:
                    bin_ += [int(lengths[j])] * n
                    use[j] = n
                    rest -= n * int(lengths[j])
                if rest < lengths[-1]:
                    break
            times = min(int(left[j]) // n for j, n in use.items())
            for j, n in use.items():
                left[j] -= n * times
            plan.append((tuple(bin_), times))
    return plan


def _most_worth(room: int, lengths: list[int], counts: list[int], worth: np.ndarray) -> dict[int, int]:
    """The filling {place in lengths: number} of at most `room` that is worth most, by a table over the room."""
    steps = []
    for k, (length, n) in enumerate(zip(lengths, counts, strict=True)):
        n, size = min(n, room // length), 1
        while n > 0:
            size = min(size, n)
            steps.append((k, size))
            n, size = n - size, 2 * size
    best, took = np.zeros(room + 1), np.zeros((len(steps), room + 1), dtype=bool)
    for row, (k, size) in enumerate(steps):
        need = size * lengths[k]
        with_it = best[: room + 1 - need] + size * worth[k]
        took[row, need:] = with_it > best[need:] + 1e-9
        best[need:] = np.where(took[row, need:], with_it, best[need:])
    out: dict[int, int] = {}
    for row in range(len(steps) - 1, -1, -1):
        if took[row, room]:
            k, size = steps[row]
            out[k] = out.get(k, 0) + size
            room -= size * lengths[k]
    return out


def _descent(lengths: np.ndarray, counts: np.ndarray, capacity: int, worth: np.ndarray, cells: list[float]) -> list[tuple[dict[int, int], int]] | None:
    """Bins around the largest length left, each completed by the filling of most worth, as often as the counts allow; None if the
    cells that are left do not suffice."""
    left, plan = counts.copy(), []
    for top in range(len(lengths)):
        while left[top]:
            left[top] -= 1
            some = np.flatnonzero(left)
            room = capacity - int(lengths[top])
            cells[0] -= room * float(np.log2(np.minimum(left[some], room // lengths[some]) + 1).sum())
            if cells[0] < 0:
                return None
            filling = _most_worth(room, lengths[some].tolist(), left[some].tolist(), worth[some])
            left[top] += 1
            bin_ = {int(some[k]): n for k, n in filling.items()}
            bin_[top] = bin_.get(top, 0) + 1
            times = min(int(left[k]) // n for k, n in bin_.items())
            for k, n in bin_.items():
                left[k] -= n * times
            plan.append((bin_, times))
    return plan


def _descents(lengths: np.ndarray, counts: np.ndarray, capacity: int, least: int, most: int, descents: int | None) -> list[tuple[dict[int, int], int]] | None:
    """The best plan of fewer than `most` bins that descents find, None if there is none; without a budget, until `least` is
    reached or the values come round to nothing new."""
    worth, best, seen = lengths.astype(np.float64) ** WORTH, None, set()
    cells = [float("inf") if descents is None else float(CELLS)]
    while most > least and (descents is None or descents > 0) and worth.tobytes() not in seen:
        seen.add(worth.tobytes())
        descents = None if descents is None else descents - 1
        plan = _descent(lengths, counts, capacity, worth, cells)
        if plan is None:
            break
        if (bins := sum(t for _, t in plan)) < most:
            most, best = bins, plan
        dearer = np.zeros(len(lengths))
        for bin_, times in plan:
            used = sum(int(lengths[k]) * n for k, n in bin_.items())
            for k, n in bin_.items():
                dearer[k] += times * n * capacity / used
        worth = (worth + lengths.astype(np.float64) ** WORTH * dearer / counts) / 2
    return best


def plan_bins(histogram: dict[int, int], capacity: int, nodes: int | None = SEARCH_NODES, descents: int | None = DESCENTS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, how many such bins) for all pieces counted: the best plan that the search finds within its budgets,
    the best there is with nodes=None."""
    lengths = sorted((k for k, n in histogram.items() if n), reverse=True)
    if not lengths:
        return []
    left = [histogram[k] for k in lengths]
    incumbent = _best_fit(np.array(lengths, dtype=np.int64), np.array(left, dtype=np.int64), capacity)
    most = sum(n for _, n in incumbent)
    least = least_bins(np.array(lengths), np.array(left), capacity)
    if (found := _descents(np.array(lengths), np.array(left), capacity, least, most, descents)) is not None:
        most = sum(n for _, n in found)
        incumbent = [(tuple(lengths[k] for k in sorted(b) for _ in range(b[k])), t) for b, t in found]
    total, used, plan = sum(a * b for a, b in zip(lengths, left)), 0, []

    def moves(tried: frozenset) -> Iterator[tuple[int, dict[int, int], int, frozenset] | None]:
        """Bins around the largest length left and how often: a filling as often as counts allow, then less often.
        What has been tried around this length is not tried again further down."""
        top = next(k for k, n in enumerate(left) if n)
        left[top] -= 1
        counts = list(left)
        left[top] += 1
        for filling in _fillings(capacity - lengths[top], lengths, counts, (most - 1 - used) * capacity - total):
            name = (top, *sorted(filling.items())) if filling is not None else None
            if name is None or name in tried:
                yield None
                continue
            bin_ = dict(filling)
            bin_[top] = bin_.get(top, 0) + 1
            tried = frozenset(x for x in tried if x[0] == top) | {name}
            for times in range(min(left[k] // n for k, n in bin_.items()), 0, -1):
                yield top, bin_, times, tried

    stack, done = [moves(frozenset())], 0
    while stack and most > least and (nodes is None or done < nodes):
        move = next(stack[-1], ())
        if move is None:
            done += 1
            continue
        if not move:
            stack.pop()
            if plan:
                bin_, times = plan.pop()
                for k, n in bin_.items():
                    left[k] += n * times
                    total += lengths[k] * n * times
                used -= times
            continue
        _, bin_, times, tried = move
        done += 1
        for k, n in bin_.items():
            left[k] -= n * times
            total -= lengths[k] * n * times
        used += times
        plan.append((bin_, times))
        if not total and used < most:
            most = used
            incumbent = [(tuple(lengths[k] for k in sorted(b) for _ in range(b[k])), t) for b, t in plan]
        if total and used + math.ceil(total / capacity) < most:
            stack.append(moves(tried))
        else:
            stack.append(iter(()))
    return incumbent


def pack(pieces: DataFrame, capacity: int, nodes: int | None = SEARCH_NODES, descents: int | None = DESCENTS) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, row_key, piece and more): as few sequences as the search finds within its
    budgets (plan_bins).
    Pieces of one length are numbered within hash buckets, and bucket totals give each bucket its first number, so no
    length, however frequent, meets in one task."""
    spark = pieces.sparkSession
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots, first, used = [], 0, dict.fromkeys(counted, 0)
    for bin_, times in plan_bins(counted, capacity, nodes, descents):
        for length in sorted(set(bin_), reverse=True):
            offsets = [sum(bin_[:k]) for k, x in enumerate(bin_) if x == length]
            slots.append((length, used[length], used[length] + times * len(offsets), first, offsets))
            used[length] += times * len(offsets)
        first += times
    plan = spark.createDataFrame(slots, "length int, low long, high long, first long, offsets array<int>")
    # Each length's runs of numbers, cut at fixed borders, so that a piece finds its run by an equality.
    spread = plan.withColumn("block", F.explode(F.sequence(F.shiftright("low", 16), F.shiftright(F.col("high") - 1, 16))))

    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("row_key", "piece"), F.lit(RANK_BUCKETS)).cast("int"))
    totals = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("row_key", "piece", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(totals, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("earlier")).withColumn("block", F.shiftright("rank", 16))
    placed = ranked.join(spread, ["length", "block"]).where("rank >= low and rank < high")
    at = F.col("rank") - F.col("low")
    return placed.select(
        *pieces.columns,
        (F.col("first") + F.floor(at / F.size("offsets"))).cast("long").alias("sequence_id"),
        F.element_at("offsets", (F.pmod(at, F.size("offsets")) + 1).cast("int")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False, table_bytes: int = TABLE_BYTES,
    nodes: int | None = SEARCH_NODES, descents: int | None = DESCENTS,
) -> DataFrame:
    """pieces_of() with a word table of table_bytes in each worker, kept in the shared folder because counting and dealing both
    read it, then pack() within the search's budgets."""
    return pack(stash(pieces_of(docs, tokenizer_path, end_id, capacity, with_ids, table_bytes), "pieces"), capacity, nodes, descents)


def sequences(packed: DataFrame) -> DataFrame:
    """The token rows themselves, from pack_documents(with_ids=True): sequence_id, ids (little-endian 32-bit)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most `capacity` pieces
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select("sequence_id", F.aggregate("parts", F.expr("X''"), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"))
