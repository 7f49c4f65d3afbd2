"""Queries over manifests, annotations, stored indexes, models and augmentation."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidegrid.functions.draws import draw, draw_sql
from slidegrid.functions.folders import fresh_path
from slidegrid.operators import annotations as an
from slidegrid.operators import index as ix
from slidegrid.operators import metrics as mt
from slidegrid.operators import models as ml
from slidegrid.operators import regions as rg
from slidegrid.plans.fixtures import EVAL_MASK, PATCHES, PIXELS, POLYGONS, SLIDES, eval_mask, patches, pixels, polygons, shapes, slides, table
from slidegrid.plans.registry import query
from slidegrid.plans.region_queries import WIDE_VIEWS, dbscan3_features, wide_features, wide_sql
from slidegrid.sources import tables as src

P, S, X, G = (PATCHES,), (SLIDES,), (PIXELS,), (POLYGONS,)


def _listed(spark: SparkSession, *trees: DataFrame) -> list[DataFrame]:
    """The paths, found again by listing a folder in which a file was made for each."""
    root, out = fresh_path(spark, "tree"), []
    for k, paths in enumerate(trees):
        src.touch(paths, f"{root}/{k}")
        out.append(src.list_files(spark, f"{root}/{k}", "*.tif" if k == 0 else "*.xml"))
    return out


def _paths(spark, d) -> tuple[DataFrame, DataFrame]:
    """Slide and annotation paths, of which tumor slides have one."""
    s = slides(spark, d)
    name = F.concat("label", F.lit("_"), F.col("slide_idx").cast("string"))
    return _listed(spark, s.select(F.concat(F.lit("data/"), "label", F.lit("/"), name, F.lit(".tif")).alias("path")), s.where("label = 'tumor'").select(F.concat(F.lit("annotations/"), name, F.lit(".xml")).alias("path")))


@query("manifest_train", "select label || '_' || slide_idx as name, 'data/' || label || '/' || label || '_' || slide_idx || '.tif' as slide, label, case when label = 'tumor' then 'annotations/tumor_' || slide_idx || '.xml' end as annotation from slides", S)
def _(spark, d):
    return src.manifest_train(*_paths(spark, d))


@query("manifest_test", "select 'test_' || slide_idx as name, 'test/test_' || slide_idx || '.tif' as slide, label, case when label = 'tumor' then 'annotations/test_' || slide_idx || '-2.xml' end as annotation from slides", S)
def _(spark, d):
    s = slides(spark, d).withColumn("name", F.concat(F.lit("test_"), F.col("slide_idx").cast("string")))
    notes = s.where("label = 'tumor'").select("name", F.explode(F.array(F.lit("-1.xml"), F.lit("-2.xml"))).alias("k")).select(F.concat(F.lit("annotations/"), "name", "k").alias("path"))
    return src.manifest_test(*_listed(spark, s.select(F.concat(F.lit("test/"), "name", F.lit(".tif")).alias("path")), notes), s.select("name", "label"))


def _staged(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = slides(spark, d).withColumn("name", F.concat("patient", F.lit("-node_"), (F.col("slide_idx") % 5).cast("string")))
    stages = s.select(F.concat("name", F.lit(".tif")).alias("patient"), "stage").union(s.select(F.concat("patient", F.lit(".zip")), F.col("patient_stage")).distinct())
    paths, notes = _listed(spark, s.select(F.concat(F.lit("slides/"), "name", F.lit(".tif")).alias("path")), s.where("annotated").select(F.concat(F.lit("annotations/"), "name", F.lit(".xml")).alias("path")))
    return paths, stages, notes


_STAGED = "select patient || '-node_' || slide_idx % 5 as name, stage as label, {tags} as tags, {note} as annotation from slides"


@query("manifest_staged", _STAGED.format(tags="tags", note="case when annotated then 'annotations/' || patient || '-node_' || slide_idx % 5 || '.xml' end"), S)
def _(spark, d):
    return src.manifest_staged(*_staged(spark, d)).select("name", "label", "tags", "annotation")


@query("manifest_staged_test", _STAGED.format(tags="patient || ';' || patient_stage", note="cast(null as varchar)"), S)
def _(spark, d):
    return src.manifest_staged(*_staged(spark, d)[:2]).select("name", "label", "tags", "annotation")


@query("manifest_small", f"select slide_idx, slide_name from slides order by {draw_sql(777, 'slide_idx')}, slide_idx limit 12", S)
def _(spark, d):
    return slides(spark, d).orderBy(draw(777, "slide_idx"), "slide_idx").limit(12).select("slide_idx", "slide_name")


@query("manifest_row", "select slide_idx, '/data/' || slide_name as slide_path, case when annotated then '/data/' || slide_name || '.xml' end as annotation_path, slide_name as relative, label from slides", S)
def _(spark, d):
    s = slides(spark, d).select("slide_idx", F.col("slide_name").alias("slide"), F.when(F.col("annotated"), F.concat("slide_name", F.lit(".xml"))).otherwise("").alias("annotation"), "label")
    return src.manifest_row(s, "/data")


@query("annotation_scan", "select 'A' || slide_idx as name, 'polygon' as type, 'tumor' as label, cast(count(*) as int) as n_vertices, cast(min(x) filter (where ord = 0) as double) as first_x from polygons group by slide_idx", (POLYGONS,))
def _(spark, d):
    """Writes the polygons as XML documents and scans them."""
    corner = F.struct(F.col("ord").cast("string").alias("_Order"), F.col("x").cast("string").alias("_X"), F.col("y").cast("string").alias("_Y"))
    corners = F.transform(F.array_sort(F.collect_list(F.struct("ord", corner.alias("c")))), lambda x: x["c"])
    rows = polygons(spark, d).groupBy("slide_idx").agg(F.struct(corners.alias("Coordinate")).alias("Coordinates"))
    rows = rows.select(F.concat(F.lit("A"), "slide_idx").alias("_Name"), F.lit("Polygon").alias("_Type"), F.lit("Tumor").alias("_PartOfGroup"), "Coordinates")
    path = fresh_path(spark, "xml")
    rows.write.format("xml").option("rootTag", "Annotations").option("rowTag", "Annotation").save(path)
    return src.annotation_scan(spark, path, {"Tumor": "tumor", "_2": "normal"}).select("name", "type", "label", F.size("vertices").alias("n_vertices"), F.element_at("vertices", 1)["x"].alias("first_x"))


@query("annot_label_map", "select slide_idx, case when label = 'tumor' then 'tumor' else 'normal' end as label from slides where annotated", S)
def _(spark, d):
    groups = slides(spark, d).where("annotated").select("slide_idx", F.when(F.col("label") == "tumor", "Tumor").otherwise("_2").alias("part_of_group"))
    return an.label_map(groups, {"Tumor": "tumor", "_0": "tumor", "_1": "tumor", "_2": "normal"}).drop("part_of_group")


@query("annot_vertices", "select slide_idx, ord, x::double as x, y::double as y from polygons", G)
def _(spark, d):
    nested = polygons(spark, d).groupBy("slide_idx").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("vs"))
    return nested.select("slide_idx", F.posexplode("vs").alias("ord", "v")).select("slide_idx", "ord", "v.x", "v.y")


RASTER = """ed as (select slide_idx, x::int as x0, y::int as y0, coalesce(lead(x) over w, first(x) over a)::int as x1, coalesce(lead(y) over w, first(y) over a)::int as y1 from polygons
  window w as (partition by slide_idx order by ord), a as (partition by slide_idx order by ord rows between unbounded preceding and unbounded following)),
 cr as (select slide_idx, unnest(range(least(y0, y1), greatest(y0, y1)))::int as "row", x0, y0, x1, y1 from ed where y0 <> y1),
 sp as (select slide_idx, "row", x0 + ("row" - y0) * (x1 - x0) / (y1 - y0)::double as x from cr),
 pr as (select slide_idx, "row", x, row_number() over w as k, lead(x) over w as to_ from sp window w as (partition by slide_idx, "row" order by x)),
 li as (select slide_idx, x0, y0, x1, y1, unnest(range(0, greatest(abs(x1 - x0), abs(y1 - y0)) + 1)) as t from ed),
 ras as (select slide_idx, "row", unnest(range(ceil(x)::bigint, floor(to_)::bigint + 1))::int as col from pr where k % 2 = 1
  union select slide_idx, floor(y0 + t * (y1 - y0) / nullif(greatest(abs(x1 - x0), abs(y1 - y0)), 0)::double + 0.5)::int, floor(x0 + t * (x1 - x0) / nullif(greatest(abs(x1 - x0), abs(y1 - y0)), 0)::double + 0.5)::int from li)"""


@query("annot_rasterise", f'/*and*/ {RASTER} select slide_idx, "row", col from ras', G)
def _(spark, d):
    return an.rasterise(polygons(spark, d))


def _drawn(spark, d) -> DataFrame:
    """Cells of all annotations."""
    tumor = an.rasterise(polygons(spark, d)).select(*rg.CELL, F.lit("tumor").alias("label"), F.lit(0).alias("seq"))
    normal = eval_mask(spark, d).where("label > 0").select(*rg.CELL, F.lit("normal").alias("label"), F.lit(1).alias("seq"))
    return tumor.unionByName(normal)


ORDER = ("normal", "tumor")


def _painted(spark, d) -> DataFrame:
    return an.paint(_drawn(spark, d), ORDER)


PAINT = f"{RASTER}, pa as (select slide_idx, \"row\", col, max(label) as label from (select slide_idx, \"row\", col, 'tumor' as label from ras union all select slide_idx, \"row\", col, 'normal' from eval_mask where label > 0) group by 1, 2, 3)"
V_PAINT = (POLYGONS, EVAL_MASK)


#: All cells of the grid, each with the label whose place in the order is last.
RENDER = f"""{RASTER}, dr as (select slide_idx, "row", col, 'tumor' as label from ras union all select slide_idx, "row", col, 'normal' from eval_mask where label > 0),
 la as (select slide_idx, "row", col, arg_max(label, list_position({list(ORDER)}, label)) as label from dr group by 1, 2, 3)"""


@query("annot_paint", f"""/*and*/ {RENDER} select e.slide_idx, e."row", e.col, coalesce(la.label, 'background') as label, case la.label when 'tumor' then 2 when 'normal' then 1 else 0 end as value
 from eval_mask e left join la using (slide_idx, "row", col)""", V_PAINT)
def _(spark, d):
    return an.render(shapes(spark, d), _drawn(spark, d), ORDER, ix.LABELS, "background")


def _grid(spark, d) -> DataFrame:
    tissue = eval_mask(spark, d).select(*rg.CELL, ((F.col("row") + F.col("col")) % 3 != 0).alias("mask"))
    return an.label_grid(tissue, _painted(spark, d), ix.LABELS, "background")


GRID = f"""{PAINT}, lg as (select e.slide_idx, e."row", e.col, case when (e."row" + e.col) % 3 = 0 then 0 when pa.label = 'tumor' then 2 when pa.label = 'normal' then 1 else 0 end as label from eval_mask e left join pa using (slide_idx, "row", col))"""


@query("label_grid", f"/*and*/ {GRID} select * from lg", V_PAINT)
def _(spark, d):
    return _grid(spark, d)


@query("index_dataset", f"""/*and*/ {GRID}, po as (select slide_idx, cast(floor(col / 2) as bigint) * 64 as x, cast(floor("row" / 2) as bigint) * 64 as y, max(label) as label from lg group by 1, 2, 3)
 select slide_idx, least(greatest(x - 10, 0), 1024 - 84)::bigint as x, least(greatest(y - 10, 0), 1024 - 84)::bigint as y, label, t::int as transform from (select *, unnest(case when label = 2 then range(1, 9) else [1] end) as t from po where label <> 0)""", V_PAINT)
def _(spark, d):
    p = ix.grid_patches(_grid(spark, d), labels_level=5, patch_level=0, patch_size=64, stride=64)
    p = ix.clip(ix.drop_background(ix.border_shift(ix.transform_label(p, 2, 8), 16, 2, 66)), F.lit(1024), F.lit(1024))
    return p.select("slide_idx", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "label", "transform")


def _index(spark, d) -> DataFrame:
    return ix.transform_single(patches(spark, d)).select("slide_idx", "patch_seq", "x", "y", "label", "transform", F.lit(0).alias("level"), F.lit(256).alias("patch_size"))


_IDX = "slide_idx, min(0) as level, min(256) as patch_size, count(*) as n_patches"


_IDX_SCHEMA = "slide_idx long, patch_seq int, x int, y int, label int, transform int, level int, patch_size int"


@query("patch_index_write", f"select {_IDX} from patches group by 1", P)
def _(spark, d):
    path = fresh_path(spark, "index")
    src.write_index(_index(spark, d), path)
    return src.index_table(src.read_index(spark, path, _IDX_SCHEMA))


@query("patch_index_read", "select slide_idx, patch_seq, x, y, label, 1 as transform from patches", P)
def _(spark, d):
    path = fresh_path(spark, "index-csv")
    src.write_index(_index(spark, d), path, "csv")
    return src.read_index(spark, path, _IDX_SCHEMA, "csv").select("slide_idx", "patch_seq", "x", "y", "label", "transform")


@query("patch_index_slides", "select slide_idx, patch_seq, label from patches where slide_idx between 7 and 31", P)
def _(spark, d):
    path = fresh_path(spark, "index")
    src.write_index(_index(spark, d), path, file_rows=5_000)
    return src.read_index(spark, path, _IDX_SCHEMA, slides=(7, 31)).select("slide_idx", "patch_seq", "label")


@query("combined_index_write", "select cps_idx::int as cps_idx, slide_idx, patch_seq::int as patch_seq, x::int as x, y::int as y, label::int as label, 1 as transform from patches, (values (0), (1)) t(cps_idx)", P)
def _(spark, d):
    path = fresh_path(spark, "combined")
    ix.index_union([_index(spark, d), _index(spark, d)]).write.option("header", "true").csv(path)
    read = spark.read.option("header", "true").csv(path)
    return read.select(F.col("cps_idx").cast("int").alias("cps_idx"), F.col("slide_idx").cast("long").alias("slide_idx"), *[F.col(c).cast("int").alias(c) for c in ("patch_seq", "x", "y", "label", "transform")])


_RESULTS = "slide_idx long, patch_seq int, normal double, tumor double"


@query("results_write", "select slide_idx, count(*) as n, round(sum(tumor), 6) as tumor from patches group by 1", P)
def _(spark, d):
    path = fresh_path(spark, "results")
    src.write_index(patches(spark, d).select("slide_idx", "patch_seq", "normal", "tumor"), path)
    return src.read_index(spark, path, _RESULTS).groupBy("slide_idx").agg(F.count("*").alias("n"), F.round(F.sum("tumor"), 6).alias("tumor"))


@query("results_read", "select slide_idx, patch_seq, normal, tumor from patches", P)
def _(spark, d):
    path = fresh_path(spark, "results")
    src.write_index(patches(spark, d).select("slide_idx", "patch_seq", "normal", "tumor"), path)
    return src.read_index(spark, path, _RESULTS)


_LABEL_COUNTS = "count(*) filter (where label = 2 and tumor >= 0.5) as tp, count(*) filter (where label <> 2 and tumor >= 0.5) as fp, count(*) filter (where label = 2 and tumor < 0.5) as fn, count(*) filter (where label <> 2 and tumor < 0.5) as tn"


@query("metric_tables_write", f"""/*and*/ c as (select label::int as label, {_LABEL_COUNTS} from patches group by 1),
 m as (select 'true_' || t as name, case when t = p then n else 0 end::double as value from (select label as t, label as p, count(*) as n from patches group by 1))
 select 'patch_' || label || '_' || name as name, round(value, 9) as value from (unpivot (select label, ((tp + tn) / (tp + tn + fp + fn)::double)::double as accuracy, tn::double as tn, fp::double as fp, fn::double as fn, tp::double as tp from c) on accuracy, tn, fp, fn, tp into name name value value)
 union all select 'stage_' || true_label || '_' || pred_label, n::double from (select stage as true_label, prediction as pred_label, count(*) as n from slides group by 1, 2)""", P + S)
def _(spark, d):
    """Writes two tables of metrics as CSV and reads all their values again."""
    path = fresh_path(spark, "metrics")
    mt.patch_metrics(patches(spark, d), by=("label",)).write.option("header", "true").csv(f"{path}/patch")
    mt.confusion_matrix(slides(spark, d), mt.STAGES, "stage", "prediction").write.option("header", "true").csv(f"{path}/stage")
    read = lambda name: spark.read.option("header", "true").csv(f"{path}/{name}")
    figures = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("accuracy", "tn", "fp", "fn", "tp")]))
    patch = read("patch").select("label", figures.alias("f")).select(F.concat(F.lit("patch_"), "label", F.lit("_"), "f.name").alias("name"), F.round("f.value", 9).alias("value"))
    stage = read("stage").where("n > 0").select(F.concat(F.lit("stage_"), "true_label", F.lit("_"), "pred_label").alias("name"), F.col("n").cast("double").alias("value"))
    return patch.unionByName(stage)


@query("tile_export_manifest", "select slide_idx, patch_seq, 1 as transform, case label when 2 then 'tumor' else 'normal' end as label_name, case label when 2 then 'tumor' else 'normal' end || '/' || regexp_replace(slide_name, '[^A-Za-z0-9]+', '_', 'g') || '-' || x || '-' || y || '_a.png' as path from patches join (select slide_idx, slide_name from slides) using (slide_idx)", P + S)
def _(spark, d):
    return src.tile_manifest(_index(spark, d), slides(spark, d), "_a")


@query("score_patches", """/*and*/ z as (select vec_id, list_sum(list_filter(embedding::double[], lambda x, i: i % 2 = 1)) as a, list_sum(list_filter(embedding::double[], lambda x, i: i % 2 = 0)) as b from embeddings)
 select vec_id, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) as normal, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) as tumor from z""", ("one as (select 1)",))
def _(spark, d):
    out = ml.score_patches(table(spark, d, "embeddings").select("vec_id", "embedding"), ml.linear_softmax_scorer, "vec_id long, normal double, tumor double")
    return out.select("vec_id", F.round("normal", 6).alias("normal"), F.round("tumor", 6).alias("tumor"))


def _predicted(learner, found: DataFrame, names: DataFrame, label: str) -> DataFrame:
    """Results of all slides by a model that is fitted to them: slide_names, true_label, tags, predictions and a probability for
    each class. found holds a slide's features."""
    features = [c for c in found.columns if c != "slide_idx"]
    rows = names.select("slide_idx", F.col("slide_name").alias("slide_names"), F.lower(label).alias("true_label"), "tags", F.lower(label).alias("y")).join(found, "slide_idx").fillna(0.0, features)
    rows = rg.settled(rows)
    return learner(rows, rows, features, "y").drop("slide_idx")


@query("slide_rf")
def _(spark, d):
    wide = wide_features(spark, d).drop("slide_name", "slide_label", "tags")
    return _predicted(ml.slide_forest, wide, slides(spark, d), "label")


@query("slide_gbt")
def _(spark, d):
    return _predicted(ml.slide_boosted, dbscan3_features(spark, d), slides(spark, d), "stage")


@query("slide_features_all", wide_sql(tags=False), WIDE_VIEWS)
def _(spark, d):
    return wide_features(spark, d).drop("tags")


def _tiles(spark, d) -> DataFrame:
    return pixels(spark, d).withColumn("transform", (F.col("slide_idx") % 8 + 1).cast("int"))


_TURN = {0: ('"row"', "col"), 90: ("7 - col", '"row"'), 180: ('7 - "row"', "7 - col"), 270: ("col", '7 - "row"')}


def _turn_sql(angle: str, rows: str = "pixels", extra: str = "") -> str:
    at = lambda k: "case " + " ".join(f"when {angle} = {a} then {v[k]}" for a, v in _TURN.items()) + " end"
    return f'select slide_idx, {at(0)} as "row", {at(1)} as col, r, g, b{extra} from {rows}'


@query("aug_rotate", _turn_sql("90"), X)
def _(spark, d):
    return ml.rotate(_tiles(spark, d), F.lit(90), 8).drop("transform")


@query("aug_flip_rotate", "/*and*/ fl as (select slide_idx, \"row\", 7 - col as col, r, g, b from pixels) " + _turn_sql("270", "fl"), X)
def _(spark, d):
    return ml.rotate(ml.flip(_tiles(spark, d), 8), F.lit(270), 8).drop("transform")


@query("aug_random_rotate", _turn_sql(f"[0, 90, 180, 270][1 + {draw_sql(5, 'slide_idx')} % 4]"), X)
def _(spark, d):
    return ml.rotate(_tiles(spark, d), ml.random_angle(5, (0, 90, 180, 270), "slide_idx"), 8).drop("transform")


@query("aug_random_crop", f"""/*and*/ o as (select *, ({draw_sql(6, 'slide_idx')} % 3)::int as o from pixels) select slide_idx, "row" - o as "row", col - o as col, r, g, b from o where "row" - o between 0 and 4 and col - o between 0 and 4""", X)
def _(spark, d):
    return ml.random_crop(_tiles(spark, d).drop("transform"), 8, 3, 6)


@query("aug_by_index", "/*and*/ fl as (select slide_idx, \"row\", case when slide_idx % 8 >= 4 then 7 - col else col end as col, r, g, b from pixels) " + _turn_sql("((slide_idx % 4) * 90)", "fl"), X)
def _(spark, d):
    return ml.by_index(_tiles(spark, d), 8).drop("transform")


@query("px_normalise", f"""select slide_idx, "row", col, {', '.join(f"round(({c} / 255.0::double - 0.5) / 0.5, 9) as {c}" for c in 'rgb')} from pixels""", X)
def _(spark, d):
    return ml.normalise(_tiles(spark, d).drop("transform")).withColumns({c: F.round(c, 9) for c in "rgb"})

