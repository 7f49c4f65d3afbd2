"""The analysis tables as views over the star schema: slides are suppliers, patches are line items on a 32 x 32 grid.

Each view is given twice, as a DataFrame plan and as a SQL common table for the oracle. Probabilities are ratios of whole
numbers, so both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("negative", "itc", "micro", "macro")
PATIENT_STAGES = ("pN0", "pN0(i+)", "pN1mi", "pN1", "pN2")
GRID, PATCH = 32, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over as many tasks as a shuffle has, however few bytes they take there: a row may be about to become many, and
    like values take far less room in a shuffle than in a task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide_idx, col, row, patch_seq, x, y, label (1 normal, 2 tumor), tumor, normal, tumor_b (a second model's)."""
    hundredths = lambda c: F.round(F.col(c) * 100).cast("int").alias(c)
    cell = F.col("l_suppkey").alias("slide_idx"), (F.col("l_partkey") % GRID).cast("int").alias("col"), (F.col("l_orderkey") % GRID).cast("int").alias("row")
    rows = table(spark, sf_dir, "lineitem").select(*cell, (F.col("l_returnflag") == "R").alias("returned"), hundredths("l_discount"), hundredths("l_tax"))
    # Few rows share a cell, so sums before the shuffle would only hold a file's rows in a task.
    rows = _dealt(rows, "slide_idx", "col", "row").groupBy("slide_idx", "col", "row").agg(
        F.max(F.when(F.col("returned"), 2).otherwise(1)).alias("label"),
        (F.sum("l_discount") / (F.lit(10.0) * F.count("*"))).alias("tumor"),
        (F.sum("l_tax") / (F.lit(8.0) * F.count("*"))).alias("tumor_b"),
    )
    return rows.select("slide_idx", "col", "row", (F.col("row") * GRID + F.col("col")).alias("patch_seq"), (F.col("col") * PATCH).alias("x"), (F.col("row") * PATCH).alias("y"), "label", "tumor", (1 - F.col("tumor")).alias("normal"), "tumor_b")


PATCHES = """p0 as (select l_suppkey as slide_idx, cast(l_partkey % 32 as int) as col, cast(l_orderkey % 32 as int) as "row",
  max(case when l_returnflag = 'R' then 2 else 1 end) as label,
  sum(cast(round(l_discount * 100) as int)) / (10.0::double * count(*)) as tumor,
  sum(cast(round(l_tax * 100) as int)) / (8.0::double * count(*)) as tumor_b
  from lineitem group by 1, 2, 3),
patches as (select slide_idx, col, "row", "row" * 32 + col as patch_seq, col * 256 as x, "row" * 256 as y, label, tumor, 1 - tumor as normal, tumor_b from p0)"""


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide_idx, slide_name, label, patient_no, patient, stage, prediction, patient_stage, annotated, tags."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    patient = F.floor(F.col("s_suppkey") / 5.0)
    balance = F.abs("s_acctbal")
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("slide_idx"), F.col("s_name").alias("slide_name"),
        F.when(F.col("s_nationkey") % 2 == 0, "tumor").otherwise("normal").alias("label"),
        patient.alias("patient_no"), F.concat(F.lit("patient_"), patient.cast("string")).alias("patient"),
        pick(STAGES, F.floor(balance) % 4).alias("stage"), pick(STAGES, F.floor(balance / 7.0) % 4).alias("prediction"),
        pick(PATIENT_STAGES, patient % 5).alias("patient_stage"), (F.col("s_nationkey") % 3 == 0).alias("annotated"),
    )
    return rows.withColumn("tags", F.concat_ws(";", "patient", "patient_stage", F.when(F.col("annotated"), "annotated")))


SLIDES = """slides0 as (select s_suppkey as slide_idx, s_name as slide_name, case when s_nationkey % 2 = 0 then 'tumor' else 'normal' end as label,
  cast(floor(s_suppkey / 5.0::double) as bigint) as patient_no,
  ['negative', 'itc', 'micro', 'macro'][1 + cast(floor(abs(s_acctbal)) as bigint) % 4] as stage,
  ['negative', 'itc', 'micro', 'macro'][1 + cast(floor(abs(s_acctbal) / 7.0::double) as bigint) % 4] as prediction,
  s_nationkey % 3 = 0 as annotated from supplier),
slides1 as (select *, 'patient_' || patient_no as patient, ['pN0', 'pN0(i+)', 'pN1mi', 'pN1', 'pN2'][1 + patient_no % 5] as patient_stage from slides0),
slides as (select *, concat_ws(';', patient, patient_stage, case when annotated then 'annotated' end) as tags from slides1)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide_idx, row, col, r, g, b: 8 x 8 images, one for each vector. Like masks, they are larger than a plan estimates."""
    vectors = _dealt(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slide_idx"), "embedding"), "slide_idx")
    rows = vectors.select("slide_idx", F.posexplode("embedding").alias("pos", "v")).hint("merge")
    band = lambda k: (F.floor(F.abs(F.col("v").cast("double")) * k) % 256).cast("int")
    return rows.select("slide_idx", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"), band(1000).alias("r"), band(3000).alias("g"), band(7000).alias("b"))


PIXELS = """px0 as (select vec_id as slide_idx, unnest(embedding) as v, unnest(range(len(embedding))) as pos from embeddings),
pixels as (select slide_idx, cast(floor(pos / 8) as int) as "row", cast(pos % 8 as int) as col,
  cast(cast(floor(abs(cast(v as double)) * 1000) as bigint) % 256 as int) as r, cast(cast(floor(abs(cast(v as double)) * 3000) as bigint) % 256 as int) as g,
  cast(cast(floor(abs(cast(v as double)) * 7000) as bigint) % 256 as int) as b from px0)"""


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality, toxic, score, with ties among the scores."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("score")).join(labels, "doc_id").select("doc_id", "quality", "toxic", "score")


DOC_SCORES = """doc_scores as (select d.doc_id, l.quality, l.toxic, (d.n_chars % 1000) / 1000.0::double as score from documents d join labels l on d.doc_id = l.doc_id)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide_idx, ord, x, y: a quadrilateral for each slide on the patch grid."""
    k = F.col("slide_idx")
    corners = F.array(
        F.struct(F.lit(0).alias("ord"), (2 + k % 5).alias("x"), (3 + k % 4).alias("y")), F.struct(F.lit(1).alias("ord"), (20 + k % 7).alias("x"), (1 + k % 6).alias("y")),
        F.struct(F.lit(2).alias("ord"), (24 + k % 3).alias("x"), (22 + k % 5).alias("y")), F.struct(F.lit(3).alias("ord"), (4 + k % 4).alias("x"), (18 + k % 7).alias("y")),
    )
    return _dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slide_idx")), "slide_idx").select("slide_idx", F.explode(corners).alias("c")).select("slide_idx", "c.*")


POLYGONS = """polygons as (select s_suppkey as slide_idx, v.ord,
  case v.ord when 0 then 2 + s_suppkey % 5 when 1 then 20 + s_suppkey % 7 when 2 then 24 + s_suppkey % 3 else 4 + s_suppkey % 4 end as x,
  case v.ord when 0 then 3 + s_suppkey % 4 when 1 then 1 + s_suppkey % 6 when 2 then 22 + s_suppkey % 5 else 18 + s_suppkey % 7 end as y
  from supplier cross join (values (0), (1), (2), (3)) as v(ord))"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide_idx, n_rows, n_cols: of each slide's patch grid."""
    return _dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slide_idx")), "slide_idx").select("slide_idx", F.lit(GRID).alias("n_rows"), F.lit(GRID).alias("n_cols"))


def eval_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slide_idx, row, col, label: 8 x 8 blocks of a 32 x 32 mask, a third of them lesions 1 to 16, else 0. Its size is estimated by
    that of the slides' file, a thousandth of what it is, so it is never to be broadcast."""
    side = lambda: F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))
    rows = _dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slide_idx")), "slide_idx").select("slide_idx", side().alias("row")).select("slide_idx", "row", side().alias("col")).hint("merge")
    a, b = F.floor(F.col("row") / 8.0).cast("int"), F.floor(F.col("col") / 8.0).cast("int")
    return rows.withColumn("label", F.when((F.col("slide_idx") + 3 * a + b) % 3 == 0, 1 + 4 * a + b).otherwise(0))


EVAL_MASK = """eval_mask as (select s_suppkey as slide_idx, rr.i as "row", cc.i as col,
  case when (s_suppkey + 3 * cast(floor(rr.i / 8.0::double) as int) + cast(floor(cc.i / 8.0::double) as int)) % 3 = 0
  then 1 + 4 * cast(floor(rr.i / 8.0::double) as int) + cast(floor(cc.i / 8.0::double) as int) else 0 end as label
  from supplier cross join (select cast(range as int) as i from range(32)) rr cross join (select cast(range as int) as i from range(32)) cc)"""
