"""A corpus pipeline: quality rules, near-duplicates, shared passages, source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it again as the next stage's docs. All but the last return the columns that they were given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidegrid.llm import mixing, near_dedup, packing, quality, suffix_dedup
from slidegrid.llm.queries import tokenizer_path
from slidegrid.llm.shared import stash, tidied


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current version of the policy rejects go."""
    return quality.kept_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: of word shingles of five words, at a similarity of 0.8."""
    gone = near_dedup.near_duplicates(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone"))
    return docs.join(stash(gone.distinct(), "gone"), F.col("doc_id") == F.col("gone"), "left_anti")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that the corpus holds more than once are cut out; texts of which nothing is left go."""
    removed = suffix_dedup.remove_spans(docs, suffix_dedup.repeated_spans(docs, length=400), decode=True).where("n_bytes > n_removed or n_bytes = 0")
    return removed.select("row.*", F.col("kept").alias("text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row with those taken at least once, another with those taken twice."""
    copy = Window.partitionBy("doc_id", "row_hash").orderBy("source")
    rows = docs.withColumn("row_hash", F.xxhash64("text")).select("doc_id", "row_hash", "source", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("copy", F.row_number().over(copy)).select("doc_id", "row_hash", "copy", "row")
    mixed = mixing.mix(docs).where("taken > 0").withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "row_hash").orderBy("source", "taken", "ranges")))
    mixed = mixed.select(F.col("doc_id").alias("d"), F.col("row_hash").alias("h"), F.col("copy").alias("c"), "ranges")
    joined = rows.join(mixed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("h")) & (F.col("copy") == F.col("c")))
    joined = joined.select("row", "ranges")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            places, texts = [], []
            for k, (text, ranges) in enumerate(zip(batch.column(0).field("text"), batch.column(1), strict=True)):
                for taken in mixing.take_words(text.as_py() or "", ranges.as_py()):
                    places.append(k)
                    texts.append(taken)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(texts, pa.string())], names=["row", "taken"])

    out = joined.mapInArrow(tidied(take), f"row {joined.schema['row'].dataType.simpleString()}, taken string").select("row.*", "taken")
    return out.withColumn("text", F.col("taken")).withColumn("n_chars", F.length("taken").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with the sequence and the place that each gets."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenizing and drawing can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
