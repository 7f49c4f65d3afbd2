"""Product codes of vectors: each part of a vector becomes the index of its nearest codebook entry, found by
equal-average search.

The components of a codebook entry sum to some number; for two vectors of n components the squared gap of their sums,
divided by n, is at most their squared distance. Entries are sorted by sum; a part starts at the place of its own sum
and looks outwards on both sides, and a side is closed as soon as its squared gap over n strictly exceeds the best
distance so far (an entry at an equal distance may still have the lower index). All parts of a batch walk at once, and
those with both sides closed leave, so a step costs what is still open.

Codebooks are learnt by rounds: an assignment of all parts, and for each entry the floor of the mean of the parts that
it got. A task adds up its own parts, so a round shuffles parts * entries rows a task, and only the codebooks
themselves (parts * entries * width numbers) reach the driver and go out again with the next round's tasks. All sums are
of whole numbers, so the result does not depend on the order of rows or on partitions.

Rows whose vector is null or holds null or non-finite components take no part. Vectors shorter than the longest, or whose
length the parts do not divide, count as filled up with zeros. Rows without an id are encoded, but come last in the choice
of first entries; rows that share an id are ordered by their vectors, and each is a row of the result. Of fewer rows than
entries each is an entry. An empty table gives no rows. Columns other than the three named are ignored. Components beyond
2^30 / n in amount, after scaling, for parts of n components, are an error: their distances would not fit whole numbers of
64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.llm.shared import discard, stash, tidied

#: Rows whose parts are searched at a time.
_ROWS = 4096


class Codebook:
    """Entries of one part position, sorted by component sum for the search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = np.argsort(entries.sum(axis=1), kind="stable")
        self.sums = entries.sum(axis=1)[self.order]
        self.sorted = entries[self.order]
        self.compared = 0  # distances worked out so far

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each part's nearest entry, ties to the lower index, and its squared distance."""
        rows, n = parts.shape
        own = parts.sum(axis=1)
        best, distance = np.full(rows, -1), np.full(rows, np.iinfo(np.int64).max)
        start = np.searchsorted(self.sums, own)
        for_side = {-1: start - 1, 1: start.copy()}
        open_ = {-1: np.arange(rows), 1: np.arange(rows)}
        while len(open_[-1]) or len(open_[1]):
            for side, at in for_side.items():
                who = open_[side]
                who = who[(at[who] >= 0) & (at[who] < len(self.sums))]
                gap = self.sums[at[who]] - own[who]
                # gap * gap / n > distance, without the division and without leaving whole numbers
                who = who[-(-gap * gap // n) <= distance[who]] if n else who
                place = at[who]
                off = self.sorted[place] - parts[who]
                found = np.einsum("ij,ij->i", off, off)
                self.compared += len(who)
                index = self.order[place]
                better = (found < distance[who]) | ((found == distance[who]) & (index < best[who]))
                distance[who[better]], best[who[better]] = found[better], index[better]
                at[who] += side
                open_[side] = who
        return best, distance


def whole_vectors(vectors: DataFrame, scale: float, vector_col: str) -> DataFrame:
    """Rows whose vectors are usable, the components as floor(scale * x), and all other columns."""
    usable = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(usable).withColumn(vector_col, whole)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _batches(batches: Iterator[pa.RecordBatch], place: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, _matrix(part.column(place), width)


def _round(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The entries that follow from one assignment of all parts."""
    parts, (entries, n) = len(books), books[0].shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, n), dtype=np.int64)
        for _, v in _batches(batches, 0, parts * n):
            for p in range(parts):
                own = v[:, p * n : (p + 1) * n]
                best, _ = search[p].nearest(own)
                counts[p] += np.bincount(best, minlength=entries)
                np.add.at(sums[p], best, own)
        p, e = np.nonzero(counts)
        out = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, names=["part", "entry", "n", "sums"])

    each = rows.select("v").mapInArrow(tidied(assign), "part int, entry int, n long, sums array<long>")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n)])
    following = [b.copy() for b in books]
    for row in total.collect():  # parts * entries rows at most
        following[row["part"]][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(n)]
    return following


def learn_codebooks(rows: DataFrame, width: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """Codebooks by part position from rows (id, v): the first entries are those of the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()  # a codebook's rows
    n = width // parts
    start = np.array([list(r.v) + [0] * (width - len(r.v)) for r in first], dtype=np.int64).reshape(-1, width)
    books = [start[:, p * n : (p + 1) * n] for p in range(parts)]
    for _ in range(rounds if len(start) else 0):
        books = _round(rows, books)
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows with a column v: code, two hex digits a part (four where codebooks have more than 256 entries), and error."""
    parts, (entries, n) = len(books), books[0].shape
    kept = [c for c in rows.columns if c != "v"]
    digits = "{:02x}" if entries <= 256 else "{:04x}"
    names = np.array([digits.format(e) for e in range(entries)], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for part, v in _batches(batches, len(kept), parts * n):
            code, error = np.full(len(v), "", dtype=object), np.zeros(len(v), dtype=np.int64)
            for p in range(parts):
                best, distance = search[p].nearest(v[:, p * n : (p + 1) * n])
                code, error = code + names[best], error + distance
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(code, pa.string()), pa.array(error)], names=[*kept, "code", "error"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "code string, error long"])
    return rows.select(*kept, "v").mapInArrow(tidied(run), schema)


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame, scale: float = 1024.0, parts: int = 4, entries: int = 256, rounds: int = 4,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, label, code, error, label_error) of all usable vectors, and the codebooks by part position. label_error
    is the error summed over the rows of an equal label, nulls together."""
    named = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = stash(whole_vectors(named, scale, "v"), "whole-vectors")
    size = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most")).first()
    width = -(-max(size["width"] or 0, 1) // parts) * parts
    if (size["most"] or 0) * (width // parts) > 1 << 30:
        raise ValueError("components too large for distances in whole numbers of 64 bits")
    books = learn_codebooks(rows, width, parts, entries, rounds)
    # Written first: both sides of the join with the totals are plain exchanges then, which are split where a label is hot.
    coded = stash(encode(rows, books), "vector-codes")
    discard(rows)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """The registered query's columns, with the codebooks' digest beside each row."""
    coded, books = compress(vectors)
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def decode(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """coded with v, the vector that its code stands for: the entries of the code, joined in the order of parts."""
    digits = 2 if len(books[0]) <= 256 else 4
    tables = [F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books]
    index = [F.conv(F.substring("code", 1 + digits * p, digits), 16, 10).cast("int") for p in range(len(books))]
    return coded.withColumn("v", F.concat(*[F.element_at(t, i + 1) for t, i in zip(tables, index, strict=True)]))


def _sql() -> str:
    """The contract in SQL: four rounds over all pairs of a part and an entry."""
    steps = [
        "v as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings"
        " where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "w as (select cast(ceil(max(len(v)) / 4.0) as bigint) as n from v)",
        "p as materialized (select row_number() over () as rid, vec_id, label, v from v)",
        "x as materialized (select rid, vec_id, part, list_transform(range(part * n + 1, part * n + n + 1), lambda i: coalesce(v[i], 0)) as x from p, w, range(4) t(part))",
        "b0 as materialized (select part, row_number() over (partition by part order by vec_id nulls last, (select v from p where p.rid = x.rid)) - 1 as entry, x as e from x"
        " qualify entry < 256)",
    ]
    near = "select rid, part, arg_min(entry, d * 256 + entry) as entry, min(d) as d from (select rid, x.part, entry, cast(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i]))) as bigint) as d from x join {b} b on x.part = b.part) group by rid, part"
    for r in range(4):
        steps += [
            f"a{r} as materialized ({near.format(b=f'b{r}')})",
            f"m{r} as (select part, entry, list(m order by i) as e from (select a.part, entry, i, cast(floor(sum(x[i]) / count(*)) as bigint) as m from a{r} a join x using (rid, part), w, range(1, 1000) t(i)"
            " where i <= n group by a.part, entry, i) group by part, entry)",
            f"b{r + 1} as materialized (select b.part, b.entry, coalesce(m.e, b.e) as e from b{r} b left join m{r} m on b.part = m.part and b.entry = m.entry)",
        ]
    steps += [
        f"f as materialized ({near.format(b='b4')})",
        "g as (select rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, cast(sum(d) as bigint) as error from f group by rid)",
        "h as (select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) as digest from b4)",
    ]
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, digest as codebooks_sha256 from g join p using (rid), h"


SQL = _sql()
