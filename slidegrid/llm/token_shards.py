"""Token ids of documents in binary shard files with Elias-Fano document boundaries.

A shard file holds one concatenated id array (16-bit ids where the vocabulary allows, else 32-bit). The places where
documents begin are a monotone sequence, kept as Elias-Fano code: low bits packed, high bits in unary, and every
256th set bit's position as select structure, about 2 + log2(ids / documents) bits a document and no 64-bit table.
Document ids, ascending in a shard, are kept the same way as distances from the first (modulo 2^64).

Rows: null texts are empty documents; null document ids come first; rows that share an id are ordered by their text's
hash and then text; columns other than the two named are ignored; an empty table gives no rows. Writers put a shard
under a temporary name and rename it, so a task that is run again leaves the same files.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidegrid.llm.encoding import encoder, slices
from slidegrid.llm.shared import tidied

MAGIC = b"SGTOK01\n"
SELECT_EVERY = 256
#: Bytes of the encoder's word table here, where encoding is all that a task does.
TABLE_BYTES = 128 << 20
#: Place of the k-th set bit of each byte.
_IN_BYTE = np.array([([b for b in range(8) if byte >> b & 1] + [0] * 8)[:8] for byte in range(256)], dtype=np.int64)


class EliasFano:
    """A non-decreasing sequence of unsigned integers; select(k) is its k-th member."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SELECT_EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_buffer(cls, raw: memoryview) -> EliasFano:
        n, low_bits, n_low, n_high, n_samples = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        low = np.frombuffer(raw, np.uint8, n_low, at)
        high = np.frombuffer(raw, np.uint8, n_high, at + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(raw, "<u4", n_samples, at + n_low + n_high))

    def _low(self, k: int) -> int:
        first = k * self.low_bits
        word = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return word >> first % 8 & (1 << self.low_bits) - 1

    def select(self, k: int) -> int:
        """Starts at the last sampled set bit before the k-th and counts on byte by byte."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = int(self.samples[k // SELECT_EVERY])
        left = k % SELECT_EVERY
        byte, mask = at // 8, 0xFF << at % 8 & 0xFF
        while (ones := (word := int(self.high[byte]) & mask).bit_count()) <= left:
            left, byte, mask = left - ones, byte + 1, 0xFF
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return one - k << self.low_bits | self._low(k)

    def select_many(self, places: np.ndarray) -> np.ndarray:
        """select() of many places at once, each from the sampled set bit before it on, byte by byte, all together."""
        k = np.asarray(places, dtype=np.int64)
        if not len(k):
            return np.empty(0, dtype=np.uint64)
        if not (0 <= k.min() and k.max() < self.n):
            raise IndexError(places)
        ones = np.bitwise_count(self.high)
        at = self.samples[k // SELECT_EVERY].astype(np.int64)
        byte, left = at // 8, k % SELECT_EVERY
        left += np.bitwise_count(self.high[byte] & ((1 << at % 8) - 1).astype(np.uint8))  # bits of that byte before the sampled one
        open_ = np.flatnonzero(ones[byte] <= left)
        while len(open_):
            left[open_] -= ones[byte[open_]]
            byte[open_] += 1
            open_ = open_[ones[byte[open_]] <= left[open_]]
        high = (byte * 8 + _IN_BYTE[self.high[byte], left] - k).astype(np.uint64) << np.uint64(self.low_bits)
        first = k * self.low_bits
        # The low bits, 63 at most, lie in nine bytes.
        around = np.append(self.low, np.zeros(9, dtype=np.uint8))[(first // 8)[:, None] + np.arange(9)]
        word, last, shift = around[:, :8].copy().view("<u8").ravel(), around[:, 8].astype(np.uint64), (first % 8).astype(np.uint64)
        low = word >> shift | np.where(shift > 0, last << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return high | low & np.uint64((1 << self.low_bits) - 1)


def shard_bytes(doc_ids: list[int | None], counts: list[int], ids: list[bytes], width: int) -> bytes:
    """doc_ids ascending, None first; ids: of each document, as unsigned integers of `width` bytes."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    starts = np.concatenate([[0], np.cumsum(counts, dtype=np.uint64)]).astype(np.uint64)
    parts = [EliasFano.of(starts).to_bytes(), EliasFano.of(np.array([d - first for d in known], dtype=np.uint64)).to_bytes()]
    head = struct.pack("<8sBQQqQQ", MAGIC, width, len(doc_ids), len(doc_ids) - len(known), first, *map(len, parts))
    return b"".join([head, *parts, *ids])


class Shard:
    """A shard file's content: boundaries, document ids and the id array, without copying the latter."""

    def __init__(self, raw: bytes | memoryview):
        form = "<8sBQQqQQ"
        magic, width, self.n_docs, n_null, first, a, b = struct.unpack_from(form, raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw, at = memoryview(raw), struct.calcsize(form)
        self.bounds = EliasFano.from_buffer(raw[at : at + a])
        known = EliasFano.from_buffer(raw[at + a : at + a + b])
        keys = known.select_many(np.arange(known.n)).astype(np.int64) + first
        self.doc_ids: list[int | None] = [None] * n_null + keys.tolist()
        self.ids = np.frombuffer(raw, {2: "<u2", 4: "<u4"}[width], offset=at + a + b)

    def document(self, k: int) -> np.ndarray:
        """Ids of the shard's k-th document, found by select."""
        return self.ids[self.bounds.select(k) : self.bounds.select(k + 1)]


def _store(path: str):
    """pyarrow's file system of a qualified path, and the path in it; an error where pyarrow knows no such file system."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of Hadoop's default file system, where it names none: a path without a scheme means the shared
    default, not the disk of the machine that a task runs on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    full = full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    _store(full)
    return full


def write_token_shards(
    docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    shard_ids: int = 8_000_000,
) -> DataFrame:
    """Encodes all documents and writes shard files of about `shard_ids` ids in ascending id order, each document
    followed by end_id. Returns the manifest (part, seq, file, n_docs, n_ids), one row a file, kept beside the shards."""
    out_dir = qualified(docs.sparkSession, out_dir)
    order = [F.asc_nulls_first("k"), F.asc("h"), F.asc("t")]
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ordered = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path, TABLE_BYTES)
        width = 2 if max(tokens.vocab_size, end_id + 1) <= 1 << 16 else 4
        end = end_id.to_bytes(width, "little")
        store, folder = _store(out_dir)
        store.create_dir(folder, recursive=True)
        task, part, seq = TaskContext.get(), TaskContext.get().partitionId(), 0
        keys, counts, ids, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}.ids"
            passing = posixpath.join(folder, f".{name}.{task.taskAttemptId()}")
            with store.open_output_stream(passing) as f:
                f.write(shard_bytes(keys, counts, ids, width))
            store.move(passing, posixpath.join(folder, name))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "n_docs": [len(keys)], "n_ids": [total]}, schema=manifest)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, piece in slices_of(texts):
                for k, raw in enumerate(tokens.encode(piece)):
                    keys.append(doc_ids[at + k])
                    counts.append(len(raw) // 4 + 1)
                    ids += [raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes(), end]
                    total += counts[-1]
                    if total >= shard_ids:
                        yield flush()
                        seq, keys, counts, ids, total = seq + 1, [], [], [], 0
        if keys:
            yield flush()

    manifest = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    ordered.select("k", "t").mapInArrow(tidied(write), "part int, seq int, file string, n_docs long, n_ids long").write.parquet(f"{out_dir}/manifest")
    return docs.sparkSession.read.schema("part int, seq int, file string, n_docs long, n_ids long").parquet(f"{out_dir}/manifest")


def slices_of(texts: pa.Array, rows: int = 256):
    """slices() of an Arrow column, with a bounded number of Python strings at a time."""
    for at in range(0, len(texts), rows):
        for first, piece in slices(texts.slice(at, rows).to_pylist()):
            yield at + first, piece


def read_token_shards(out_dir: str, manifest: DataFrame) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    The only global figure, ids in the shards before, is a running sum over the manifest, a row for each file."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files, out_dir = max(1, manifest.count()), qualified(manifest.sparkSession, out_dir)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(out_dir)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(posixpath.join(folder, name)) as f:
                    shard = Shard(f.read())
                bounds = shard.bounds.select_many(np.arange(shard.n_docs + 1)).astype(np.int64)
                crcs = [zlib.crc32(shard.ids[i:j].astype("<u4").tobytes()) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = placed.select("file", "start").repartition(files)
    return placed.mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
