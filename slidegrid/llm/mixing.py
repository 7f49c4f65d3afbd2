r"""A mix of sources to target weights, drawn as blocks of words.

Each source's words, its documents one after another, are packed into blocks of a fixed length. The mix is written in
output shards of a fixed number of blocks. How many blocks of each source a shard gets is drawn multinomially, given
that all shards together take each source's quota: the draw for a range of shards is split between its halves by a
multivariate hypergeometric draw seeded by the range, so any task finds its shards' counts, and how many of each source
went before, in log(shards) draws, and totals are exact. A source's slots in that order are its pass over the data: slot
j takes block pi(j mod n) of the (j div n)-th pseudorandom permutation of its n blocks, a Feistel network, so a block is
taken floor(slots / n) or one more times. Slots meet blocks by a join on (source, block).

Sources are ordered by code point, null last, and weigh WEIGHTS in turn; together they share SHARE of all words. No
source takes more than LIMIT times its own words; what it can't take is shared again by weight.

Words are `[^\x20\x09-\x0D]+`; null and empty texts have none, are never taken and keep their rows. Rows that share a
doc_id are documents of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidegrid.llm.shared import stash, tidied

WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2.0
#: Words in a block, blocks in an output shard.
BLOCK, SHARD = 64, 4096
#: Parts of a source that are numbered side by side.
PARTS = 1024
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Source:
    """place: in the order of sources; blocks: that it has; quota: blocks that the mix takes."""

    place: int
    name: str | None
    size: int
    target: float
    blocks: int
    quota: int


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Words to take of each source, in their order: what is above the limit is shared again until nothing is."""
    total, free = share * sum(sizes), [k for k, n in enumerate(sizes) if n]
    out = [0.0] * len(sizes)
    while free:
        weight = sum(weights[k % len(weights)] for k in free)
        shares = {k: total * weights[k % len(weights)] / weight for k in free}
        over = [k for k in free if shares[k] > limit * sizes[k]]
        for k in over or free:
            out[k] = limit * sizes[k] if over else shares[k]
        total -= sum(out[k] for k in over)
        free = [k for k in free if k in shares and k not in over] if over else []
    return out


def _log_factorial_change(n: int, by: int) -> float:
    """log (n + by)! - log n!, without the loss of digits that the difference of two large logarithms has."""
    if n + min(by, 0) < 64:
        return math.lgamma(n + by + 1) - math.lgamma(n + 1)
    x = n + 1.0
    return (x + by - 0.5) * math.log1p(by / x) + by * (math.log(x) - 1) + (1 / (x + by) - 1 / x) / 12


def hypergeometric(good: int, bad: int, taken: int, rng: np.random.Generator) -> int:
    """How many of the good are among `taken` draws from an urn of any size: a ratio of uniforms over the probabilities
    relative to the likeliest number, which log_factorial_change gives to nine digits for counts to 10^15."""
    total, least, most = good + bad, max(0, taken - bad), min(good, taken)
    if least == most:
        return least
    mode = min(most, max(least, (taken + 1) * (good + 1) // (total + 2)))
    mean = taken * (good / total)
    spread = mean * (bad / total) * ((total - taken) / max(1, total - 1))
    # Fixed values of the method: 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e).
    width = 1.7155277699214135 * math.sqrt(spread + 0.5) + 0.8989161620588988
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if not least <= k <= most:
            continue
        d = k - mode
        log_ratio = -_log_factorial_change(mode, d) - _log_factorial_change(good - mode, -d) - _log_factorial_change(taken - mode, -d) - _log_factorial_change(bad - taken + mode, d)
        if 2 * math.log(u) <= log_ratio:
            return k


def _split(counts: np.ndarray, taken: int, seed: tuple[int, ...]) -> np.ndarray:
    """Of an urn with counts of each source, how many of each are among `taken` draws: source by source, each against
    all that follow."""
    rng, rest = np.random.default_rng(seed), int(counts.sum())
    out = np.zeros(len(counts), dtype=np.int64)
    for k, own in enumerate(counts.tolist()):
        rest -= own
        out[k] = hypergeometric(own, rest, taken, rng)
        taken -= int(out[k])
    return out


def shard_counts(quotas: np.ndarray, shards: int, wanted: range, shard_blocks: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, blocks of each source before it, blocks of each source in it) for a range of shards."""
    total = int(quotas.sum())

    def go(first: int, last: int, before: np.ndarray, here: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if last <= wanted.start or first >= wanted.stop:
            return
        if last - first == 1:
            yield first, before, here
            return
        middle = (first + last) // 2
        left = _split(here, min(total, middle * shard_blocks) - first * shard_blocks, (seed, first, last))
        yield from go(first, middle, before, left)
        yield from go(middle, last, before + left, here - left)

    if total:
        yield from go(0, shards, np.zeros(len(quotas), dtype=np.int64), quotas.astype(np.int64))


def permuted(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the given places: a four-round Feistel network over the next even
    number of bits, applied again to what falls outside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = slots.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & low
        for k in range(4):
            mixed = (b + np.uint64((key * 8 + k) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            a, b = b, a ^ ((mixed >> np.uint64(32)) & low)
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """docs (of which doc_id, source and text are read) with size, place in hash order and row_hash."""
    return docs.withColumn("size", F.size(F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), "")).cast("long"))


def sources_of(documents: DataFrame, block: int = BLOCK) -> list[Source]:
    """One entry for each source, of documents with source and size; the table of sources is small whatever the corpus."""
    found = documents.groupBy("source").agg(F.sum("size").alias("size")).collect()
    ordered = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in ordered]
    out = []
    for k, (r, target) in enumerate(zip(ordered, targets(sizes), strict=True)):
        n = -(-r["size"] // block)
        # Blocks have the fixed length but for a source's last, so the quota counts them by their mean length.
        out.append(Source(k, r["source"], r["size"], target, n, min(int(LIMIT * n), round(target * n / r["size"])) if n else 0))
    return out


def located(documents: DataFrame) -> DataFrame:
    """Adds start, the words of the source before each document. Documents of a source lie in hash order in PARTS
    parts; the parts' totals, a bounded table for each source, give every part its first word."""
    keyed = documents.withColumn("part", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(PARTS)).cast("int"))
    totals = keyed.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("source", "part").orderBy("doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return joined.withColumn("start", F.col("first") + F.col("inside")).drop("s", "p", "part", "first", "inside")


def draw(spark, sources: list[Source], shard_blocks: int = SHARD, seed: int = 1) -> DataFrame:
    """The mix itself: (shard, slot, source_place, block), a row for each block that is taken, in order of output."""
    quotas = np.array([s.quota for s in sources], dtype=np.int64)
    blocks = [s.blocks for s in sources]
    shards = -(-int(quotas.sum()) // shard_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard_ in batch.column(0).to_pylist():
                for shard, before, here in shard_counts(quotas, shards, range(shard_, shard_ + 1), shard_blocks, seed):
                    place = np.repeat(np.arange(len(here)), here)
                    rank = np.arange(len(place)) - np.repeat(np.cumsum(here) - here, here) + before[place]
                    block = np.empty(len(place), dtype=np.int64)
                    for k in np.flatnonzero(here):
                        own = place == k
                        turn = rank[own] // blocks[k]
                        part = np.empty(int(own.sum()), dtype=np.int64)
                        for t in np.unique(turn):
                            part[turn == t] = permuted(rank[own][turn == t] % blocks[k], blocks[k], hash((seed, int(k), int(t))) % (1 << 61))
                        block[own] = part
                    order = np.random.default_rng((seed, shard, 7)).permutation(len(place))
                    columns = [np.full(len(place), shard, dtype=np.int64), np.arange(len(place), dtype=np.int32), place[order].astype(np.int32), block[order]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "slot", "source_place", "block"])

    return spark.range(0, shards, 1, max(1, min(shards, 10_000))).mapInArrow(tidied(run), "shard long, slot int, source_place int, block long")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """doc_id, row_hash (of the text), size, source_size, target, taken and ranges, the word ranges of the document with
    the times that each is taken."""
    spark = docs.sparkSession
    rows = sized(docs.select("doc_id", "source", "text")).withColumn("row_hash", F.xxhash64("text")).select("doc_id", "source", "row_hash", "size")
    rows = stash(rows, "sizes")
    sources = sources_of(rows, block)
    table = spark.createDataFrame([(s.place, s.name, s.size, s.target) for s in sources], "source_place int, s string, source_size long, target double")
    placed = located(rows).join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = stash(placed, "placed")
    times = draw(spark, sources, seed=seed).groupBy("source_place", "block").agg(F.count("*").alias("times"))
    parts = placed.where("size > 0").select(
        "doc_id", "row_hash", "source_place", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"),
    )
    # Both sides grow with the words, so neither may be sent to all tasks, however well it compresses.
    met = parts.hint("merge").join(times.hint("merge"), ["source_place", "block"]).select(
        "doc_id", "row_hash", "source_place", "start", "times",
        F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).alias("lo"),
        F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")).alias("hi"),
    )
    taken = met.groupBy("doc_id", "row_hash", "source_place", "start").agg(
        F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"), F.collect_list(F.struct("lo", "hi", "times")).alias("ranges")
    )
    key = ["row_hash", "source_place", "start"]
    other = taken.select(F.col("doc_id").alias("d"), *[F.col(k).alias(f"_{k}") for k in key], F.when(F.col("taken") > 0, F.col("taken")).alias("t"), "ranges")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("row_hash").eqNullSafe(F.col("_row_hash")) & (F.col("source_place") == F.col("_source_place")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    out = placed.hint("merge").join(other.hint("merge"), same, "left")
    return out.select("doc_id", "row_hash", "source", "size", "source_size", "target", F.coalesce("t", F.lit(0)).cast("long").alias("taken"), "ranges")


def take_words(text: str, ranges: list[dict]) -> list[str]:
    """The texts of a mixed document: its words that are taken at least once, at least twice and so on, each run of
    words with the blanks between them."""
    spots = [m.span() for m in _WORD.finditer(text)]
    out = []
    for turn in range(1, max((r["times"] for r in ranges), default=0) + 1):
        runs: list[list[int]] = []
        for r in sorted((r for r in ranges if r["times"] >= turn), key=lambda r: r["lo"]):
            if runs and runs[-1][1] == r["lo"]:
                runs[-1][1] = r["hi"]
            else:
                runs.append([r["lo"], r["hi"]])
        out.append("\n".join(text[spots[a][0] : spots[b - 1][1]] for a, b in runs))
    return out
