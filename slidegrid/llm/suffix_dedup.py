r"""Removal of every byte that lies in a string of `length` bytes which also starts somewhere else in the corpus.

External induced sorting, spread over Spark tasks:

* Sampled suffixes. As induced sorting starts from the local minima of the text, only those positions are sampled whose
  hashed string of `name` bytes is the smallest within some window of `length` bytes, the first of ties. Which they are
  depends on the window's own bytes alone, so equal windows have their sampled position at the same place, about one
  position in (length - name) / 2 is sampled, and every window holds one.
* Sorting by names. Suffix tuples (name, context name, document, position) are sorted by range over all tasks, an
  external merge sort whose runs and queues are Spark's and go to disk as needed. The context is all bytes of the
  windows that have this sampled position; each window is in one context. Tuples that agree in it repeat in all their
  windows: these are decided. A name that is followed by several contexts is left over, one tuple for each
  context; names that occur once are dropped.
* Induction. Left-over suffixes of a name are sorted by their bytes, with the lengths of their common prefixes. The order
  of the suffixes one byte further left is induced from it: a stable sort by that byte, the common prefixes one longer
  or cut to nothing, with the least value in between carried along. A window repeats where a neighbour in its order
  shares `length` bytes. Suffixes without a neighbour that shares their bytes so far leave the queue.
* Recursion. A name with more left-over contexts than one task should hold is not gathered: its contexts are sampled
  again with longer names, which splits them, until the name is the whole window and equal names decide.

So no group of copies or shared passage meets in one task, a task holds one name's few contexts at a time, and texts
are shuffled twice, for the contexts of left-over tuples and for the removal.

Texts are UTF-8 bytes; null is empty. Rows are told apart by doc_id and a hash of the text: repeated rows are copies of
one another and lose all that is long enough; their tuples and spans are kept once. Null ids are allowed. An empty table gives no rows; other columns are
ignored. Names are 64-bit hashes, contexts 128-bit ones together with their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidegrid.llm.shared import discard, release, stash, tidied

LENGTH = 400
#: Bytes of a name in the first sampling.
NAME = 100
#: Left-over contexts of one name that are sorted together; names with more are sampled again.
TOGETHER = 64
#: Bytes of a text that are sampled at a time.
PIECE = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_KEYS = ["doc_id", "text_hash"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


_LETTERS = _mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(0x94D049BB133111EB))
_powers = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _names(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of `width` bytes."""
    up, down = _power(len(data))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[data] * up)])
    return _mix((sums[width:] - sums[:-width]) * down[: len(data) - width + 1])


#: Low bits of a packed name hold its place, so that the first of ties is least.
_PLACE = _U((1 << 21) - 1)


def _sampled(names: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the smallest name, first of ties, in any `window` neighbouring names, and the first window that each is
    smallest in; the next one's first window ends that. Fixed blocks give the minima."""
    n = len(names)
    packed = np.full(-(-n // window) * window, ~_U(0))
    packed[:n] = (names & ~_PLACE) | np.arange(n, dtype=np.uint64)
    grid = packed.reshape(-1, window)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    places = (np.minimum(backward[: n - window + 1], forward[window - 1 : n]) & _PLACE).astype(np.int64)
    starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    return places[starts], np.append(starts, len(places))


_TUPLE = pa.schema([
    ("name", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()),
    ("lo", pa.int32()), ("hi", pa.int32()), ("copies", pa.int32()), ("bytes", pa.binary()),
])
_TUPLE_SQL = "name long, context long, doc_id long, text_hash long, pos int, lo int, hi int, copies int, bytes binary"


def _suffix_tuples(raw: bytes, width: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(name, context, place, low, high) of a text's sampled suffixes. The context is all bytes of the windows in which the
    place is smallest, so every window of the text is in one context. A text is taken in pieces of windows."""
    size, window = len(raw), length - width + 1
    for at in range(0, size - length + 1, PIECE):
        data = np.frombuffer(raw, np.uint8, min(size, at + PIECE + length - 1) - at, at)
        names = _names(data, width)
        places, starts = _sampled(names, window)
        lows = (starts + at).tolist()
        for name, place, lo, after in zip(names.view(np.int64)[places].tolist(), (places + at).tolist(), lows, lows[1:]):
            hi = after - 1 + length
            yield name, xxhash.xxh3_64_intdigest(raw[lo:hi], place - lo) - (1 << 63), place, lo, hi


def _once_each(tuples, doc_id, text_hash, shift: int, raw: bytes | None) -> Iterator[tuple]:
    """Rows of one text: a tuple for each name and context with its number of copies in the text, and for contexts that
    repeat in the text itself the decided spans (rows without a name), touching ones joined."""
    seen: dict[tuple[int, int], list] = {}
    spans: list[list[int]] = []
    for name, context, place, lo, hi in tuples:
        if (row := seen.get((name, context))) is None:
            seen[name, context] = [place, lo, hi, 1]
            continue
        if row[3] == 1:
            spans.append(row[1:3])
        row[3] += 1
        if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
            spans[-1] = [spans[-1][0], max(hi, spans[-1][1])]
        else:
            spans.append([lo, hi])
    for (name, context), (place, lo, hi, copies) in seen.items():
        yield name, context, doc_id, text_hash, place + shift, lo + shift, hi + shift, copies, raw[lo:hi] if raw else None
    for lo, hi in spans:
        yield None, None, doc_id, text_hash, lo + shift, lo + shift, hi + shift, 0, None


def _batches(rows: Iterator[tuple], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _TUPLE, strict=True)], schema=_TUPLE)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _TUPLE, strict=True)], schema=_TUPLE)


def _sample_texts(texts: DataFrame, width: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
            yield from _batches(row for doc_id, h, t in keys for row in _once_each(_suffix_tuples(t.as_py(), width, length), doc_id, h, 0, None))

    long_enough = texts.where(F.octet_length("text") >= length)
    return long_enough.select(*_KEYS, F.col("text").cast("binary").alias("text")).mapInArrow(tidied(run), _TUPLE_SQL)


def _sample_contexts(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """Samples the bytes of contexts again, with longer names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield from _batches(row for doc_id, h, lo, raw in keys for row in _once_each(_suffix_tuples(raw, width, length), doc_id, h, lo, raw))

    return contexts.select(*_KEYS, "lo", "bytes").mapInArrow(tidied(run), _TUPLE_SQL)


def _sort_names(tuples: DataFrame) -> DataFrame:
    """Sorted tuples, reduced to what is decided (name is null, lo to hi repeat) and what is left over. A row is decided if
    a neighbour has its context; it is left over if a neighbour has its name and another context, or if it is the
    first or last of its task, whose neighbour another task has."""
    order = ["name", "context", "doc_id", "text_hash", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, and what its earlier neighbour says of it: decided, left over
        for batch in batches:
            if not batch.num_rows:
                continue
            first = held is None
            rows = pa.Table.from_batches([batch] if first else [held[0], batch]).combine_chunks().to_batches()[0]
            name, context, copies = (rows.column(k).to_numpy() for k in ("name", "context", "copies"))
            named = name[1:] == name[:-1]
            same = named & (context[1:] == context[:-1])
            decided, left = copies > 1, np.zeros(len(name), dtype=bool)
            left[0] = True if first else held[2]
            decided[0] |= False if first else held[1]
            decided[1:] |= same
            left[1:] |= named & ~same
            decided[:-1] |= same
            left[:-1] |= named & ~same
            # Of repeated rows, whose tuples are equal and stand together, the last one speaks for all.
            for value in (rows.column(k).to_numpy() for k in range(2, 5)):
                same = same & (value[1:] == value[:-1])
            starts = np.flatnonzero(np.append(True, ~same))
            ends, once = np.append(starts[1:], len(name)) - 1, np.zeros(len(name), dtype=bool)
            once[ends] = True
            left[ends] = np.logical_or.reduceat(left, starts)
            held = (rows.slice(rows.num_rows - 1), decided[-1], left[-1])
            yield from emit(rows.slice(0, rows.num_rows - 1), (decided & once)[:-1], (left & once)[:-1])
        if held is not None:
            yield from emit(held[0], np.array([held[1]]), np.array([True]))

    def emit(rows: pa.RecordBatch, decided: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        if left.any():
            yield pa.RecordBatch.from_arrays(rows.filter(pa.array(left)).columns, schema=_TUPLE)
        if decided.any():
            found = rows.filter(pa.array(decided))
            none, nothing = pa.nulls(found.num_rows, pa.int64()), pa.nulls(found.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([none, none, *found.columns[2:8], nothing], schema=_TUPLE)

    return tuples.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(run), _TUPLE_SQL)


def _induce(names: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (name, right): the least and the greatest number of bytes to the left at which a string of
    `length` bytes begins that another row of the name has too; -1 where none does. Those strings overlap, so
    everything between is covered."""
    n = len(names)
    low, high = np.full(n, -1), np.full(n, -1)
    n_left, n_right = np.array(list(map(len, lefts))), np.array(list(map(len, rights)))
    right = np.frombuffer(b"".join(r.ljust(length, b"\0") for r in rights), np.uint8).reshape(n, length)
    reach = max(1, int(n_left.max()))
    left = np.frombuffer(b"".join(x[::-1].ljust(reach, b"\0") for x in lefts), np.uint8).reshape(n, reach)
    differ = right[1:] != right[:-1]
    lcp = np.zeros(n, dtype=np.int64)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(n_right[1:], n_right[:-1]))
    group = np.cumsum(np.append(True, names[1:] != names[:-1]))
    lcp[1:][group[1:] != group[:-1]] = 0
    rows = np.arange(n)
    for d in range(reach + 1):
        after = np.append(lcp[1:], 0)
        found = rows[np.maximum(lcp, after) >= length]
        low[found] = np.where(low[found] < 0, d, low[found])
        high[found] = d
        going = np.flatnonzero(n_left[rows] > d)
        if not len(going):
            break
        # Least common prefixes over 1, 2, 4 ... places, for the least between any two rows of a group.
        tables, span = [lcp], 1
        widest = int(np.bincount(group).max())
        while span < widest:
            shifted = np.append(tables[-1][span:], np.zeros(min(span, len(lcp)), dtype=np.int64))
            tables.append(np.minimum(tables[-1], shifted))
            span *= 2
        table = np.stack(tables)
        key = group[going] * 256 + left[rows[going], d]
        order = np.argsort(key, kind="stable")
        place, key = going[order], key[order]
        kin = np.append(False, key[1:] == key[:-1])
        i, j = place[:-1][kin[1:]] + 1, place[1:][kin[1:]]
        level = np.frexp((j - i + 1).astype(np.float64))[1] - 1
        lcp = np.zeros(len(place), dtype=np.int64)
        lcp[kin] = 1 + np.minimum(table[level, i], table[level, j - (1 << level) + 1])
        stays = kin | np.append(kin[1:], False)
        rows, lcp = rows[place][stays], lcp[stays]
        group = np.cumsum(~kin[stays])
        if not len(rows):
            break
    return low, high


def _induced_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Decided spans of left-over contexts, each name's contexts in one task, sorted by their suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            at = 0
            while rows.num_rows - at > 4096 + TOGETHER:
                names = rows.column(0).slice(at, 4096 + TOGETHER).to_numpy()
                cut = int(np.flatnonzero(names != names[-1])[-1]) + 1 if (names != names[-1]).any() else len(names)
                yield decide(rows.slice(at, cut))
                at += cut
            held = rows.slice(at)
        if held is not None and held.num_rows:
            yield decide(held)

    def decide(rows: pa.RecordBatch) -> pa.RecordBatch:
        name, doc_id, text_hash, pos, left, right = rows.columns
        low, high = _induce(name.to_numpy(), left.to_pylist(), right.to_pylist(), length)
        hit, place = low >= 0, pos.to_numpy()
        mask = pa.array(hit)
        spans = [pa.array((place - high)[hit], pa.int32()), pa.array((place - low + length)[hit], pa.int32())]
        return pa.RecordBatch.from_arrays([doc_id.filter(mask), text_hash.filter(mask), *spans], names=[*_KEYS, "lo", "hi"])

    parts = contexts.select("name", *_KEYS, "pos", F.expr("substring(bytes, 1, pos - lo)").alias("left"), F.expr("substring(bytes, pos - lo + 1)").alias("right"))
    return parts.repartition("name").sortWithinPartitions("name", "right").mapInArrow(tidied(run), "doc_id long, text_hash long, lo int, hi int")


def _with_hash(docs: DataFrame) -> DataFrame:
    """Rows without an id share one, the least long; equal texts have equal spans, so it takes nothing from a real one."""
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_hash", F.xxhash64("text"))
    return keyed.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, name: int = NAME) -> DataFrame:
    """doc_id, text_hash, lo, hi: byte spans, overlapping ones among them, whose union is what is to be removed."""
    spark = docs.sparkSession
    texts = _with_hash(docs.select("doc_id", "text"))
    tuples, spans, width = stash(_sample_texts(texts, name, length), "suffixes"), [], name
    while True:
        decided_here = tuples.where("name is null").select(*_KEYS, "lo", "hi")
        ordered = stash(_sort_names(tuples.where("name is not null")), "sorted")
        spans.append(stash(decided_here.union(ordered.where("name is null").select(*_KEYS, "lo", "hi")), "spans"))
        discard(tuples)
        release(spark)
        left = ordered.where("name is not null")
        names = stash(left.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "names")
        left = left.join(names, "name").select("name", "n", *_KEYS, "pos", "lo", "hi", "bytes")
        if width == name:
            once = texts.groupBy(*_KEYS).agg(F.first("text").alias("text"))
            left = left.drop("bytes").join(once, _KEYS).withColumn("bytes", F.expr("substring(cast(text as binary), lo + 1, hi - lo)"))
            left = left.select("name", "n", *_KEYS, "pos", "lo", "hi", "bytes")
        contexts = stash(left, "contexts")
        spans.append(stash(_induced_spans(contexts.where(F.col("n") <= TOGETHER), length), "spans"))
        crowded = contexts.where(F.col("n") > TOGETHER)
        discard(ordered, names)
        release(spark)
        if width == length or crowded.isEmpty():
            break
        width = length - (length - width) // 2
        tuples = stash(_sample_contexts(crowded, width, length), "suffixes")
        discard(contexts)
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out


def remove_spans(docs: DataFrame, spans: DataFrame, decode: bool = False) -> DataFrame:
    """doc_id, row (all columns of docs but text), n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes
    that remain, concatenated; a row for each of docs. With decode kept is text: what is left of a character that a
    removal has cut goes too."""
    gathered = spans.groupBy(*_KEYS).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # bounded by the text itself
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"])
    rows = _with_hash(docs.select("doc_id", F.col("doc_id").cast("long").alias("id"), rest.alias("row"), "text"))
    joined = rows.join(gathered, _KEYS, "left")
    joined = joined.select(F.col("id").alias("doc_id"), "row", F.col("text").cast("binary").alias("text"), "spans")
    figures = ["n_bytes", "n_removed", "n_spans"]
    kind = (T.StringType(), pa.string()) if decode else (T.BinaryType(), pa.binary())
    schema = T.StructType([*joined.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in figures), T.StructField("kept", kind[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for text, spans_ in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw, runs = text.as_py(), []
                if spans_.is_valid:
                    starts, ends = (spans_.values.field(k).to_numpy() for k in ("lo", "hi"))
                    order = np.argsort(starts, kind="stable")
                    starts, reach = starts[order], np.maximum.accumulate(ends[order])
                    cut = np.append(True, starts[1:] > reach[:-1])
                    runs = list(zip(starts[cut].tolist(), reach[np.append(np.flatnonzero(cut)[1:] - 1, len(reach) - 1)].tolist(), strict=True))
                kept = [raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)], strict=True)]
                whole = b"".join(kept)
                for column, value in zip(out, (len(raw), sum(b - a for a, b in runs), len(runs), whole.decode("utf-8", "ignore") if decode else whole), strict=True):
                    column.append(value)
            columns = [batch.column("doc_id"), batch.column("row"), *(pa.array(c, kind[1] if k == 3 else pa.int64()) for k, c in enumerate(out))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", *figures, "kept"])

    return joined.mapInArrow(tidied(run), schema)
