"""Manifests, annotation and index files: readers with explicit schemas, and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATCH_SCHEMA = "slide_idx long, patch_seq long, x int, y int, label int, transform int, level int, patch_size int"
ANNOTATION_SCHEMA = "_Name string, _Type string, _PartOfGroup string, Coordinates struct<Coordinate: array<struct<_Order: string, _X: string, _Y: string>>>"


def stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, relative to root, of each file below it whose name fits the pattern; contents are not read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    # Listings name file:/x as file:///x.
    path = F.regexp_replace("path", "^file:/*", "file:/")
    return found.select(F.substring(path, len(re.sub("^file:/*", "file:/", whole)) + 2, 1 << 20).alias("path"))


def touch(paths: DataFrame, root: str) -> int:
    """Makes a file of one byte below root for each row of paths (path, relative), in the tasks that hold the rows; the number
    of files. Listings leave out files without any. root must name a file system that pyarrow knows, with its scheme."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                whole = f"{folder}/{path}"
                store.create_dir(whole.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(whole) as f:
                    f.write(b"\0")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return paths.select("path").mapInArrow(make, "n long").agg(F.sum("n")).first()[0] or 0


def manifest_train(paths: DataFrame, annotations: DataFrame) -> DataFrame:
    """slide, label (from the path) and the annotation of the same name."""
    slides = paths.select(F.col("path").alias("slide"), stem(F.col("path")).alias("name"), F.regexp_extract("path", "(tumor|normal)", 1).alias("label"))
    found = annotations.select(F.col("path").alias("annotation"), stem(F.col("path")).alias("name"))
    return slides.join(found, "name", "left")


def manifest_test(paths: DataFrame, annotations: DataFrame, reference: DataFrame) -> DataFrame:
    """Labels from a reference table (name, label); of several annotations that start with a slide's name, the last."""
    found = annotations.select(F.substring_index(stem(F.col("path")), "-", 1).alias("name"), F.col("path").alias("annotation"))
    last = found.groupBy("name").agg(F.max("annotation").alias("annotation"))
    slides = paths.select(F.col("path").alias("slide"), stem(F.col("path")).alias("name"))
    return slides.join(reference, "name", "left").join(last, "name", "left")


def manifest_staged(paths: DataFrame, stages: DataFrame, annotations: DataFrame | None = None, labels=("negative", "itc", "micro", "macro"), patient_stages=("pN0", "pN0(i+)", "pN1mi", "pN1", "pN2")) -> DataFrame:
    """One stage table holds slides' labels and patients' stages; both are taken from it by their vocabularies, patients
    joined by the part of the slide's name before -node. tags: patient;stage[;annotated]."""
    slides = paths.select(F.col("path").alias("slide"), stem(F.col("path")).alias("name"))
    of_slide = stages.where(F.col("stage").isin(*labels)).select(stem(F.col("patient")).alias("name"), F.col("stage").alias("label"))
    of_patient = stages.where(F.col("stage").isin(*patient_stages)).select(F.regexp_replace("patient", r"\.zip$", "").alias("patient"), "stage")
    rows = slides.join(of_slide, "name").withColumn("patient", F.substring_index("name", "-node", 1)).join(of_patient, "patient")
    if annotations is None:
        return rows.withColumn("annotation", F.lit(None).cast("string")).withColumn("tags", F.concat_ws(";", "patient", "stage"))
    found = annotations.select(F.col("path").alias("annotation"), stem(F.col("path")).alias("name"))
    rows = rows.join(found, "name", "left")
    return rows.withColumn("tags", F.concat_ws(";", "patient", "stage", F.when(F.col("annotation").isNotNull(), "annotated")))


def manifest_row(manifest: DataFrame, root: str) -> DataFrame:
    """Absolute paths below a root; an empty annotation is none; and the relative path again."""
    whole = lambda c: F.concat_ws("/", F.lit(root), c)
    slide, annotation = whole("slide"), F.when(F.nullif("annotation", F.lit("")).isNotNull(), whole("annotation"))
    return manifest.select("slide_idx", slide.alias("slide_path"), annotation.alias("annotation_path"), F.regexp_replace(slide, F.concat(F.lit("^"), F.lit(root), F.lit("/")), F.lit("")).alias("relative"), "label")


def annotation_scan(spark: SparkSession, path: str, groups: dict[str, str]) -> DataFrame:
    """Annotations of XML documents: name, type, label (of the group; an unknown one is an error) and ordered vertices."""
    rows = spark.read.format("xml").option("rowTag", "Annotation").schema(ANNOTATION_SCHEMA).load(path)
    known = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    label = F.coalesce(F.try_element_at(known, F.col("_PartOfGroup")), F.raise_error(F.concat(F.lit("unknown group "), F.col("_PartOfGroup"))).cast("string"))
    vertices = F.array_sort(F.transform("Coordinates.Coordinate", lambda c: F.struct(c["_Order"].cast("int").alias("ord"), c["_X"].cast("double").alias("x"), c["_Y"].cast("double").alias("y"))))
    return rows.select(F.col("_Name").alias("name"), F.lower("_Type").alias("type"), label.alias("label"), vertices.alias("vertices"))


def tile_region(x: Column, y: Column, size: int, level: int) -> Column:
    return F.struct(F.lit(level).alias("level"), F.struct(x.alias("x"), y.alias("y")).alias("location"), F.struct(F.lit(size).alias("w"), F.lit(size).alias("h")).alias("size"))


#: Rows of a file of a stored index or of results.
FILE_ROWS = 1_000_000
FILES = "file string, first long, last long, n long"


def write_index(patches: DataFrame, path: str, form: str = "parquet", file_rows: int = FILE_ROWS) -> None:
    """Patch rows in files of alike size, whatever the slides' sizes: rows are cut into ranges of slide and patch, so a large slide
    has several files and small ones share one. path/files says which slides a file has (first, last)."""
    spark, columns = patches.sparkSession, [c for c in patches.columns if c != "slide_idx"]
    n = max(1, -(-patches.count() // file_rows))
    ordered = patches.select("slide_idx", *columns).repartitionByRange(n, "slide_idx", "patch_seq").sortWithinPartitions("slide_idx", "patch_seq")
    ordered.write.format(form).option("header", "true").save(f"{path}/rows")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    stored = spark.read.schema(schema).format(form).option("header", "true").load(f"{path}/rows")
    files = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("slide_idx").alias("first"), F.max("slide_idx").alias("last"), F.count("*").alias("n"))
    files.coalesce(1).write.parquet(f"{path}/files")  # a row for each file


def read_index(spark: SparkSession, path: str, schema: str, form: str = "parquet", slides: tuple[int, int] | None = None) -> DataFrame:
    """Rows of a stored index, of slides from the first to the last where asked for: then only the files that have any of them are
    opened."""
    where, rows = f"{path}/rows", spark.read.schema(schema).format(form).option("header", "true")
    if slides is None:
        return rows.load(where)
    files = spark.read.schema(FILES).parquet(f"{path}/files").where((F.col("first") <= slides[1]) & (F.col("last") >= slides[0]))
    names = [r.file for r in files.select("file").collect()]  # names of the files that are read
    some = rows.load([f"{where}/{f}" for f in names]) if names else rows.load(where).where("false")
    return some.where(F.col("slide_idx").between(*slides))


def index_table(patches: DataFrame) -> DataFrame:
    """One row a slide: level and patch size, and its patches."""
    return patches.groupBy("slide_idx").agg(F.min("level").alias("level"), F.min("patch_size").alias("patch_size"), F.count("*").alias("n_patches"))


def tile_manifest(patches: DataFrame, slides: DataFrame, affix: str = "") -> DataFrame:
    """Where each tile's picture goes: <label>/<slide>-<x>-<y><affix>.png, and the transform that makes it."""
    named = patches.join(slides.select("slide_idx", "slide_name"), "slide_idx")
    label = F.when(F.col("label") == 2, "tumor").when(F.col("label") == 1, "normal").otherwise("background")
    slide = F.regexp_replace("slide_name", "[^A-Za-z0-9]+", "_")
    return named.select("slide_idx", "patch_seq", "transform", label.alias("label_name"), F.concat(label, F.lit("/"), slide, F.lit("-"), F.col("x"), F.lit("-"), F.col("y"), F.lit(f"{affix}.png")).alias("path"))
