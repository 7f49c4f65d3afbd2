r"""Near-duplicate documents by fast similarity sketching, banding and exact confirmation.

Sketch: round i places every shingle by a hash of (i, shingle). In the first t rounds the hash also picks the bin, in
the last t rounds bin i - t takes all shingles, so every coordinate fills, after about t log t placements, and two
sketches agree in a share of coordinates concentrated about the Jaccard similarity. 240 coordinates in 40 bands of 6
miss a pair of similarity 0.8 with probability (1 - 0.8^6)^40 = 5.3e-6.

Documents of the same shingle set form one class before anything is paired, so copies cost a grouped minimum. Classes
that share a band form a bucket; pairs are never written out, they are found in two passes:

* Hubs. A class is as central as the buckets it is in are large. Edited copies of a text lie around that text and seldom
  close to one another, so each class is held against the most central class that it shares a bucket with: a pair for
  each class, which links most of a group.
* Families. Buckets whose members are in one component by now need nothing more. The others are gathered by their most
  central member, since a text's bands share the same centre: a pair that shares a bucket shares a family, and is compared once
  for the family, not once for each band. A family's largest component needs no comparison inside itself; members
  of the others are dealt in blocks against blocks of all, each cell of two blocks a key of its own. A cell counts
  all common shingles of its members exactly, by a product of their membership matrices, and gives only the links that
  join components, fewer than it has members.

So rows and shuffled bytes follow the members of unsettled families and the number of their blocks, and the verdict on
every pair of a bucket rests on the full sets.

Words are `[^\x20\x09-\x0D]+` after lowering A-Z. A document's set is its distinct word shingles of the given width; with
fewer words the whole sequence is its one shingle; null, empty and blank texts have no shingles and no links. Rows with a
null doc_id can't be named: they take no part, get a null component and are kept. Rows that share a doc_id count as one
document with all links of its texts. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.llm.components import connected_components
from slidegrid.llm.shared import CACHES, discard, release, stash, tidied

COORDINATES, BAND_ROWS = 240, 6
#: Members and shingles of a block of a family; a cell holds two blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 1 << 17
#: Members that are held against one hub in one cell.
MEMBERS = 64
#: Columns of the membership matrix that are multiplied at a time.
COLUMNS = 2048
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64
#: Entries of the word table of a worker process, some 200 bytes each.
_WORD_TABLE = 150_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_TABLE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()
CACHES.append(_hashes)


def shingle_set(text: str, width: int = 2) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width_ = min(width, len(words))
    out = _mix(h[: len(h) - width_ + 1] + _U(width_))
    for k in range(1, width_):
        out = _mix(out + h[k : len(h) - width_ + 1 + k])
    return np.unique(out)


_SEEDS = _mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LAST = _U((1 << 48) - 1)


def sketch(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Coordinates as (round, 48 bits of the placed hash); earlier rounds are smaller, so a bin keeps its first fill."""
    t, n = coordinates, len(shingles)
    bins = np.full(t, ~_U(0))
    at, step = 0, max(1, -(-4 * t // n))
    while at < t:
        rounds = np.arange(at, min(t, at + step), dtype=np.uint64)
        v = _mix(shingles[None, :] ^ _SEEDS[rounds.astype(np.int64), None])
        place = ((v >> _U(32)) * _U(t)) >> _U(32)
        np.minimum.at(bins, place.ravel().astype(np.int64), ((rounds[:, None] << _U(48)) | (_mix(v) & _LAST)).ravel())
        at += step
        if bins.max() != ~_U(0):
            return bins
    for b in np.flatnonzero(bins == ~_U(0)):
        bins[b] = (_U(t + b) << _U(48)) | (_mix(shingles ^ _SEEDS[t + b]) & _LAST).min()
    return bins


def _bands(bins: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, of its coordinates and its number."""
    rows = bins.reshape(-1, BAND_ROWS)
    key = np.arange(len(rows), dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set) and bands, a row for each document; one pass over the texts."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                sizes, sets, bands = [], [], []
                for text in part.column(1):
                    s = shingle_set(text.as_py() or "", width)
                    sizes.append(len(s))
                    sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    bands.append(_bands(sketch(s)) if len(s) else None)
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_hash", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidied(sign), "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def _buckets(classes: DataFrame) -> DataFrame:
    """(band, node, n) for bands that more than one class has, n their number. Bands are sorted by range of (band, node), so a bucket of
    any size is spread over tasks; a task keeps what repeats in its range, and its first and last band, whose other
    members may be a neighbour's; a count over what is kept settles those."""
    rows = classes.select(F.explode("bands").alias("band"), F.col("node"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, held = ["band", "node"], None, None  # held: the last row so far, and whether it is to be kept
        for batch in batches:
            band, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(band):
                continue
            if first is None:
                first = band[0]
            if held is not None:
                band, node = np.append(held[0], band), np.append(held[1], node)
            same = band[1:] == band[:-1]
            keep = band == first
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= held is not None and held[2]
            held = (band[-1:], node[-1:], keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(band[:-1][keep[:-1]]), pa.array(node[:-1][keep[:-1]])], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=names)

    sorted_ = rows.repartitionByRange("band", "node").sortWithinPartitions("band", "node")
    kept = stash(sorted_.mapInArrow(tidied(shared), "band long, node long"), "shared-bands")
    many = stash(kept.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    return stash(kept.join(many, "band").select("band", "node", "n"), "buckets")


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, tokens): the shingles of the texts of nodes as bytes, repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                tokens = [shingle_set(t.as_py(), width).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node is not null and text is not null")
    sets = texts.join(nodes, "node", "left_semi").mapInArrow(tidied(run), "node long, tokens binary").where("octet_length(tokens) > 0")
    return sets.groupBy("node", F.xxhash64("tokens").alias("h"), F.octet_length("tokens").alias("n")).agg(F.first("tokens").alias("tokens")).select("node", "tokens")


def _joining(sides: list[int], nodes: list[int], components: list[int], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links between members of different components with 100 * intersection >= percent * union, none between members
    that the links before have joined. With two sides only pairs of both are compared."""
    size = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # by another member: the tokens of one set are distinct
    column, owner = (np.cumsum(count > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    side = np.array(sides)
    rows = np.flatnonzero(side == 0)
    others = np.flatnonzero(side == 1) if side.any() else rows
    both = np.zeros((len(rows), len(others)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[owner[lo:hi], column[lo:hi] - first] = 1
        both += held[rows] @ held[others].T
    names, component = np.unique(components, return_inverse=True)
    hit = (100 * both >= percent * (size[rows][:, None] + size[others][None, :] - both)) & (both > 0)
    hit &= component[rows][:, None] != component[others][None, :]
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in np.argwhere(hit).tolist():
        i, j = rows[i], others[j]
        u, v = find(component[i]), find(component[j])
        if u != v:
            parent[u] = v
            yield nodes[i], nodes[j]


def confirmed(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cells (key, i, j, side, node, component): links (u, v) within each cell (key, i, j), on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, ([], [], [], [])

        def close() -> pa.RecordBatch:
            links = list(_joining(*cell, percent)) if len(cell[1]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            *columns, tokens = batch.columns
            for k, i, j, side, node, component, own in zip(*(c.to_pylist() for c in columns), tokens, strict=True):
                if (k, i, j) != key:
                    yield close()
                    key, cell = (k, i, j), ([], [], [], [])
                for held, value in zip(cell, (side, node, component, np.frombuffer(own.as_py(), np.uint64)), strict=True):
                    held.append(value)
        yield close()

    joined = cells.join(sets, "node").select("key", "i", "j", "side", "node", "component", "tokens")
    return joined.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidied(run), "u long, v long")


def _hub_cells(buckets: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each class beside the most central one of its buckets, if that is another; MEMBERS to a cell, about."""
    best = buckets.join(hubs, "band").groupBy("node").agg(F.max(F.struct("c", "hub")).alias("best"))
    pairs = stash(best.select("node", F.col("best.hub").alias("key")).where("node != key"), "pairs")
    sizes = stash(pairs.groupBy("key").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "hub-sizes")
    members = pairs.join(sizes, "key").select("key", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("i"), "node", F.lit(1).alias("side"))
    leads = sizes.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("key").alias("node"), F.lit(0).alias("side"))
    return leads.union(members).select("key", "i", F.lit(0).alias("j"), "side", "node", F.col("node").alias("component"))


def _family_cells(buckets: DataFrame, hubs: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Families of more than one component, in cells of two blocks; blocks of the largest component come last."""
    named = buckets.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    named = stash(named, "named")
    mixed = named.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("band")
    mixed = stash(mixed.join(hubs, "band").select("band", F.col("hub").alias("key")), "mixed")
    members = stash(named.join(mixed, "band").select("key", "node", "component").distinct().join(sizes, "node"), "members")
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    family = parts.groupBy("key").agg(F.max(F.struct("n", "component", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK_MEMBERS, s / BLOCK_SHINGLES)).cast("int")
    one = blocks(F.col("n"), F.col("s")) <= 1
    family = family.select(
        "key", F.when(one, F.lit(None)).otherwise(F.col("top.component")).alias("top"),
        F.when(one, 1).otherwise(blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"))).alias("few"),
        F.when(one, 0).otherwise(blocks(F.col("top.n"), F.col("top.s"))).alias("many"),
    )
    placed = members.join(stash(family, "families"), "key")
    block = F.when(F.col("component") == F.col("top"), F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few"))).cast("int")
    placed = placed.withColumn("block", block).withColumn("last", F.when(F.col("block") < F.col("few"), F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1).cast("int"))
    dealt = placed.select("key", "node", "component", "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return dealt.select("key", i.alias("i"), j.alias("j"), F.when(F.col("block") == i, 0).otherwise(1).alias("side"), "node", "component")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included), kept (it is that one)."""
    spark = docs.sparkSession
    signed = stash(signatures(docs, width), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stash(usable.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    buckets = _buckets(classes)
    central = stash(buckets.groupBy("node").agg(F.sum("n").alias("c")), "central")
    ranked = buckets.join(central, "node").groupBy("band").agg(F.max(F.struct("c", -F.col("node"))).alias("top"))
    hubs = stash(ranked.select("band", F.col("top.c").alias("c"), (-F.col("top.col2")).alias("hub")), "hubs")
    sets = stash(_sets(docs, central.select("node"), width), "sets")
    release(spark)
    links = stash(confirmed(stash(_hub_cells(buckets, hubs), "cells"), sets, percent), "links")
    release(spark)
    labels = stash(connected_components(links), "labels")
    sizes = stash(classes.groupBy("node").agg(F.sum("n_shingles").alias("n_shingles")), "sizes")
    more = stash(confirmed(stash(_family_cells(buckets, hubs, labels, sizes), "cells"), sets, percent), "links")
    discard(buckets, central, hubs, sets)
    release(spark)
    # Rows that share an id and not a text hold their classes together.
    several = usable.groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("b")).where("a < b").select("doc_id")
    twice = usable.join(stash(several, "several"), "doc_id").select("doc_id", "set_hash").join(classes, "set_hash").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    labels = stash(connected_components(links.union(more).union(twice)), "labels")
    named = classes.select("set_hash", "node").join(labels, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    named = stash(named, "named")
    discard(classes)
    out = signed.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
