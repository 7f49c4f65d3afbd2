"""Queries over heatmaps, regions, lesions and slide features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.operators import froc as fr
from slidegrid.operators import metrics as mt
from slidegrid.operators import regions as rg
from slidegrid.operators import tiles as tl
from slidegrid.plans.fixtures import EVAL_MASK, PATCHES, SLIDES, eval_mask, patches, slides
from slidegrid.plans.metric_queries import boot_sql, named_sql, rounded
from slidegrid.plans.registry import query

P, S, M = (PATCHES,), (SLIDES,), (EVAL_MASK,)
#: The slide whose lesions the FROC queries score lies on the 32 x 32 mask at this level (cells of 256 pixels).
LEVEL = 8


def heat(spark, d, value: str = "tumor") -> DataFrame:
    return rg.heatmap(patches(spark, d), cell=256, value=value)


def cells_at(spark, d, threshold: float, strict: bool = False) -> DataFrame:
    return heat(spark, d).where(F.col("value") > threshold if strict else F.col("value") >= threshold)


HEAT = """hm as (select slide_idx, "row", col, tumor as value from patches), hb as (select slide_idx, "row", col, tumor_b as value from patches)"""


def comps_sql(where: str, name: str = "comps") -> str:
    """Common table of cells with their region, by walks that never go below their first cell."""
    return f"""c_{name} as (select slide_idx, "row", col, value, "row"::bigint * 2147483648 + col as id from hm where {where}),
 w_{name} as (select slide_idx, id as root, id, "row", col from c_{name} union select w.slide_idx, w.root, c.id, c."row", c.col from w_{name} w join c_{name} c on c.slide_idx = w.slide_idx and c."row" between w."row" - 1 and w."row" + 1 and c.col between w.col - 1 and w.col + 1 and c.id > w.root),
 m_{name} as (select slide_idx, id, min(root) as root from w_{name} group by 1, 2),
 {name} as (select c.slide_idx, c."row", c.col, c.value, cast(dense_rank() over (partition by c.slide_idx order by m.root) as int) as comp from c_{name} c join m_{name} m on c.slide_idx = m.slide_idx and c.id = m.id)"""


def dbscan_sql(where: str, eps: int, least: int, name: str = "comps") -> str:
    return f"""c_{name} as (select slide_idx, "row", col, value, "row"::bigint * 2147483648 + col as id from hm where {where}),
 n_{name} as (select a.slide_idx, a.id as a, b.id as b from c_{name} a join c_{name} b on a.slide_idx = b.slide_idx and (a."row" - b."row") * (a."row" - b."row") + (a.col - b.col) * (a.col - b.col) <= {eps * eps}),
 k_{name} as (select slide_idx, a as id from n_{name} group by 1, 2 having count(*) >= {least}),
 e_{name} as (select n.slide_idx, n.a, n.b from n_{name} n join k_{name} x on x.slide_idx = n.slide_idx and x.id = n.a join k_{name} y on y.slide_idx = n.slide_idx and y.id = n.b),
 w_{name} as (select slide_idx, id as root, id from k_{name} union select w.slide_idx, w.root, e.b from w_{name} w join e_{name} e on e.slide_idx = w.slide_idx and e.a = w.id and e.b > w.root),
 m_{name} as (select slide_idx, id, min(root) as root from w_{name} group by 1, 2),
 b_{name} as (select n.slide_idx, n.a as id, min(m.root) as root from n_{name} n join m_{name} m on m.slide_idx = n.slide_idx and m.id = n.b where not exists (select 1 from k_{name} k where k.slide_idx = n.slide_idx and k.id = n.a) group by 1, 2),
 l_{name} as (select * from m_{name} union all select * from b_{name}),
 {name} as (select c.slide_idx, c."row", c.col, c.value, cast(dense_rank() over (partition by c.slide_idx order by l.root is null, coalesce(l.root, c.id)) as int) as comp from c_{name} c left join l_{name} l on c.slide_idx = l.slide_idx and c.id = l.id)"""


PROPS = """sums as (select slide_idx, comp, count(*) as area, avg("row") as centroid_row, avg(col) as centroid_col, min("row") as min_row, min(col) as min_col, max("row") + 1 as max_row, max(col) + 1 as max_col,
 max(value) as max_value, sum(value::decimal(20, 12))::double / count(*) as mean_value, min(value) as min_value, sum(value::decimal(20, 12))::double as sum_value, var_pop("row") + 1 / 12.0::double as mrr, var_pop(col) + 1 / 12.0::double as mcc, covar_pop("row", col) as mrc from comps group by 1, 2),
 eig as (select *, (mrr + mcc) / 2 + sqrt((mrr - mcc) * (mrr - mcc) / 4 + mrc * mrc) as l1, greatest((mrr + mcc) / 2 - sqrt((mrr - mcc) * (mrr - mcc) / 4 + mrc * mrc), 0) as l2 from sums),
 props as (select *, (max_row - min_row) * (max_col - min_col) as bbox_area, 4 * sqrt(l1) as major_axis, 4 * sqrt(l2) as minor_axis, sqrt(1 - l2 / l1) as eccentricity from eig)"""
R = "/*recursive*/ "


@query("heatmap", 'select slide_idx, "row", col, value from hm', (PATCHES, HEAT))
def _(spark, d):
    return heat(spark, d)


@query("heatmap_dense", """/*and*/ s as (select distinct slide_idx from hm), g as (select slide_idx, cast(r.range as int) as "row", cast(c.range as int) as col from s, range(32) r, range(32) c)
 select g.slide_idx, g."row", g.col, coalesce(value, 0) as value from g left join hm using (slide_idx, "row", col)""", (PATCHES, HEAT))
def _(spark, d):
    return rg.heatmap_dense(heat(spark, d), 32, 32)


@query("heatmap_export", 'select slide_idx, "row", col, cast(floor(value * 255) as smallint) as value from hm', (PATCHES, HEAT))
def _(spark, d):
    return heat(spark, d).withColumn("value", F.floor(F.col("value") * 255).cast("smallint"))


@query("components", f'{R}{comps_sql("value >= 0.5")} select slide_idx, "row", col, comp from comps', (PATCHES, HEAT))
def _(spark, d):
    return rg.components(cells_at(spark, d, 0.5)).select(*rg.CELL, "comp")


@query("dbscan", f'{R}{dbscan_sql("value > 0.5", 5, 10)} select slide_idx, "row", col, comp from comps', (PATCHES, HEAT))
def _(spark, d):
    return tl.dbscan(cells_at(spark, d, 0.5, True), 5, 10).select(*rg.CELL, "comp")


_BASIC = "slide_idx, comp, area, centroid_row, centroid_col, min_row, min_col, max_row, max_col, max_value, round(mean_value, 9) as mean_value, min_value, round(sum_value, 9) as sum_value, bbox_area, area / bbox_area::double as extent, (max_row - min_row) / (max_col - min_col)::double as aspect_ratio, 1 / area::double as density"


@query("region_props", f"{R}{comps_sql('value >= 0.5')}, {PROPS} select {_BASIC} from props", (PATCHES, HEAT))
def _(spark, d):
    props = rg.region_props(rg.components(cells_at(spark, d, 0.5)))
    return props.drop("major_axis", "minor_axis", "eccentricity").withColumn("mean_value", F.round("mean_value", 9)).withColumn("sum_value", F.round("sum_value", 9))


_AXES = ("major_axis", "minor_axis", "eccentricity")


@query("region_moments", f"{R}{comps_sql('value >= 0.5')}, {PROPS} select slide_idx, comp, {', '.join(f'round({c}, 6) as {c}' for c in _AXES)} from props", (PATCHES, HEAT))
def _(spark, d):
    props = rg.region_props(rg.components(cells_at(spark, d, 0.5)))
    return props.select("slide_idx", "comp", *[F.round(c, 6).alias(c) for c in _AXES])


#: Hull areas: a directed pair of outer points is a side where no other point lies right of it or further along it.
HULL = """ends as (select slide_idx, comp, y, min(c0) as a, max(c1) as b from (select slide_idx, comp, "row" + v as y, min(col) as c0, max(col) + 1 as c1 from comps, (values (0), (1)) as t(v) group by 1, 2, 3, "row") group by 1, 2, 3),
 outer_points as (select slide_idx, comp, a as x, y from ends union select slide_idx, comp, b, y from ends),
 sides as (select p.slide_idx, p.comp, p.x as px, p.y as py, q.x as qx, q.y as qy from outer_points p join outer_points q on p.slide_idx = q.slide_idx and p.comp = q.comp and (p.x <> q.x or p.y <> q.y) join outer_points s on s.slide_idx = p.slide_idx and s.comp = p.comp
  group by all having bool_and((q.x - p.x) * (s.y - p.y) - (q.y - p.y) * (s.x - p.x) > 0 or ((q.x - p.x) * (s.y - p.y) = (q.y - p.y) * (s.x - p.x) and (s.x - p.x) * (s.x - q.x) + (s.y - p.y) * (s.y - q.y) <= 0))),
 solid as (select slide_idx, comp, n * 2 / sum(px * qy - qx * py)::double as solidity from sides join (select slide_idx, comp, count(*) as n from comps group by 1, 2) using (slide_idx, comp) group by slide_idx, comp, n)"""


@query("region_solidity", f"{R}{comps_sql('value >= 0.5')}, {HULL} select slide_idx, comp, solidity from solid", (PATCHES, HEAT))
def _(spark, d):
    return rg.region_solidity(rg.components(cells_at(spark, d, 0.5)))


_LESION = "slide_idx, round(sum_value, 9) as prob_score, round(centroid_col * 256, 6) as centre_x, round(centroid_row * 256, 6) as centre_y, area as pixels"


def _rounded(lesions: DataFrame) -> DataFrame:
    return lesions.withColumn("prob_score", F.round("prob_score", 9)).withColumn("centre_x", F.round("centre_x", 6)).withColumn("centre_y", F.round("centre_y", 6))


@query("lesions_dbscan", f"{R}{dbscan_sql('value > 0.5', 5, 10)}, {PROPS} select {_LESION} from props", (PATCHES, HEAT))
def _(spark, d):
    return _rounded(rg.lesions_of(rg.region_props(tl.dbscan(cells_at(spark, d, 0.5, True), 5, 10)), 256))


@query("lesions_two_model", f"""{R}{comps_sql('value >= 0.9')} select slide_idx, round(sum(a.value + coalesce(b.value, 0)) / 2, 9) as prob_score, round(avg(col) * 256, 6) as centre_x, round(avg("row") * 256, 6) as centre_y, count(*) as pixels
 from comps a left join hb b using (slide_idx, "row", col) group by slide_idx, comp""", (PATCHES, HEAT))
def _(spark, d):
    return _rounded(rg.lesions_two_model(rg.components(cells_at(spark, d, 0.9)), heat(spark, d, "tumor_b"), 256))


@query("lesions_nms", f"""{R}live as (select slide_idx, list({{v: value, r: "row", c: col}} order by value desc, "row", col) as l from hm where value >= 0.5 group by 1),
 greedy as (select slide_idx, l[1] as top, list_filter(l, lambda x: (x.r - l[1].r) * (x.r - l[1].r) + (x.c - l[1].c) * (x.c - l[1].c) >= 36) as l from live
  union all select slide_idx, l[1], list_filter(l, lambda x: (x.r - l[1].r) * (x.r - l[1].r) + (x.c - l[1].c) * (x.c - l[1].c) >= 36) from greedy where len(l) > 0)
 select g.slide_idx, g.top.r as "row", g.top.c as col, g.top.v as prob_score, count(*) as pixels from greedy g join hm on hm.slide_idx = g.slide_idx and (hm."row" - g.top.r) * (hm."row" - g.top.r) + (hm.col - g.top.c) * (hm.col - g.top.c) < 36 group by all""", (PATCHES, HEAT))
def _(spark, d):
    return tl.lesions_nms(heat(spark, d), radius=6, cutoff=0.5)


def _froc_parts(spark, d):
    """Lesions of the cells at 0.9, each cell a detection with its probability, against the mask."""
    lesions = cells_at(spark, d, 0.9).select("slide_idx", F.col("value").alias("prob_score"), (F.col("col") * 256.0).alias("centre_x"), (F.col("row") * 256.0).alias("centre_y"))
    mask = eval_mask(spark, d)
    tall = mask.where("label > 0 and (label % 5 <> 0 or row % 8 < 2) and (label % 10 <> 0 or col % 8 < 2)")  # some regions are only two rows high, some of them two cells wide
    return lesions, tall, rg.itc_regions(tall, LEVEL, 0.243, 275.0)


MASK = """mask as (select * from eval_mask where label > 0 and (label % 5 <> 0 or "row" % 8 < 2) and (label % 10 <> 0 or col % 8 < 2)),
 mom as (select slide_idx, label, var_pop("row") + 1 / 12.0::double as mrr, var_pop(col) + 1 / 12.0::double as mcc, covar_pop("row", col) as mrc from mask group by 1, 2),
 itc as (select slide_idx, label from mom where 4 * sqrt((mrr + mcc) / 2 + sqrt((mrr - mcc) * (mrr - mcc) / 4 + mrc * mrc)) < 275.0::double / (0.243::double * 256)),
 les as (select slide_idx, "row", col, value as prob from hm where value >= 0.9),
 fpl as (select l.slide_idx, prob from les l left join mask m using (slide_idx, "row", col) where m.label is null),
 tpl as (select r.slide_idx, r.label, r.is_itc, coalesce(max(l.prob), 0) as prob from (select distinct m.slide_idx, m.label, i.label is not null as is_itc from mask m left join itc i on m.slide_idx = i.slide_idx and m.label = i.label) r
  left join (select m.slide_idx, m.label, prob from les join mask m using (slide_idx, "row", col)) l on r.slide_idx = l.slide_idx and r.label = l.label group by 1, 2, 3)"""
FROC = """pts as (select prob, 1 as fp, 0 as tp from fpl union all select prob, 0, 1 from tpl where not is_itc), cnt as (select prob, sum(fp) as fp, sum(tp) as tp from pts group by 1),
 cum as (select prob, sum(fp) over (order by prob desc) as fps, sum(tp) over (order by prob desc) as tps, sum(tp) over () as all_tp, min(prob) over () as least from cnt),
 froc as (select prob as threshold, fps / (select count(*) from slides)::double as total_fps, tps / nullif(all_tp, 0)::double as sensitivity from cum where prob > least union all select null, 0, 0)"""
F_VIEWS = (PATCHES, HEAT, EVAL_MASK, SLIDES)
_SCORE = "round((" + " + ".join(f"coalesce(max(case when total_fps <= {x} then sensitivity end), 0)" for x in (8, 4, 2, 1, 0.5, 0.25)) + ") / 6, 9)"


@query("eval_mask_scan", "select s.slide_idx, count(distinct m.label) as n_lesions, count(m.label) > 0 as has_tumor from slides s left join (select * from eval_mask where label > 0) m using (slide_idx) group by 1", S + M)
def _(spark, d):
    found = eval_mask(spark, d).where("label > 0").groupBy("slide_idx").agg(F.count_distinct("label").alias("n"))
    return slides(spark, d).select("slide_idx").join(found, "slide_idx", "left").select("slide_idx", F.coalesce("n", F.lit(0)).alias("n_lesions"), F.col("n").isNotNull().alias("has_tumor"))


@query("itc_regions", f"/*and*/ {MASK} select slide_idx, label from itc", F_VIEWS)
def _(spark, d):
    return _froc_parts(spark, d)[2]


@query("lesion_hits", f"/*and*/ {MASK} select slide_idx, label, is_itc, prob from tpl union all select slide_idx, 0, false, prob from fpl", F_VIEWS)
def _(spark, d):
    false, regions = rg.lesion_hits(*_froc_parts(spark, d), LEVEL)
    return regions.unionByName(false.select("slide_idx", F.lit(0).alias("label"), F.lit(False).alias("is_itc"), "prob"))


def _froc(spark, d) -> DataFrame:
    false, regions = rg.lesion_hits(*_froc_parts(spark, d), LEVEL)
    return fr.froc_curve(false, regions, slides(spark, d))


@query("froc_curve", f"/*and*/ {MASK}, {FROC} select threshold, total_fps, sensitivity from froc", F_VIEWS)
def _(spark, d):
    return _froc(spark, d)


@query("froc_score", f"/*and*/ {MASK}, {FROC} select {_SCORE} as froc from froc", F_VIEWS)
def _(spark, d):
    return fr.froc_score(_froc(spark, d)).select(F.round("froc", 9).alias("froc"))


@query("froc_evaluate", f"""/*and*/ {MASK} select (select count(*) from slides) as n_images, (select count(*) from fpl) as n_false, count(*) filter (where not is_itc and prob > 0) as n_found, count(*) filter (where not is_itc) as n_regions, count(*) filter (where is_itc) as n_itc from tpl""", F_VIEWS)
def _(spark, d):
    false, regions = rg.lesion_hits(*_froc_parts(spark, d), LEVEL)
    sums = regions.agg(F.count_if(F.expr("not is_itc and prob > 0")).alias("n_found"), F.count_if(~F.col("is_itc")).alias("n_regions"), F.count_if("is_itc").alias("n_itc"))
    one = slides(spark, d).agg(F.count("*").alias("n_images")).crossJoin(false.agg(F.count("*").alias("n_false")))  # one row each
    return one.crossJoin(sums)


REPS = 1000
#: Lesions by what they hit, in the order of the draw; then each sample's curve, score and sensitivities at 800 levels.
FROC_SAMPLES = f"""lk as (select case when m.label is null or i.label is not null then null else l.slide_idx end as s, case when i.label is not null then -1 else coalesce(m.label, 0) end as label, case when i.label is null then prob end as prob
  from les l left join mask m using (slide_idx, "row", col) left join itc i on i.slide_idx = m.slide_idx and i.label = m.label),
 {boot_sql('lk', 's nulls first, label, prob desc nulls first', 11)},
 sf as (select rep, prob, sum(weight) as fp, 0 as tp from boot where label = 0 group by 1, 2), st as (select rep, prob, count(*) as tp from (select rep, s, label, max(prob) as prob from boot where label > 0 group by 1, 2, 3) group by 1, 2),
 sr as (select unnest(range(0, {REPS}))::int as rep), nr as (select count(*) as n from tpl where not is_itc),
 sm as (select rep, 0.0::double as prob, (select n from nr) - coalesce(sum(tp), 0) as tp from sr left join st using (rep) group by 1 having (select n from nr) > coalesce(sum(tp), 0)),
 sp as (select rep, prob, sum(fp) as fp, sum(tp) as tp from (select * from sf union all select rep, prob, 0, tp from st union all select rep, prob, 0, tp from sm) group by 1, 2),
 su as (select rep, prob, sum(fp) over w as fps, sum(tp) over w as tps, sum(tp) over (partition by rep) as all_tp, min(prob) over (partition by rep) as least from sp window w as (partition by rep order by prob desc)),
 sc as (select rep, prob as threshold, fps / (select count(*) from slides)::double as total_fps, tps / nullif(all_tp, 0)::double as sensitivity from su where prob > least union all select distinct rep, null, 0, 0 from sp),
 fs as (select rep, {_SCORE.replace('round(', '(').replace(', 9)', ')')} as froc from sc group by 1),
 so as (select *, row_number() over (partition by rep order by total_fps, threshold desc nulls first) as i from sc where sensitivity is not null),
 sx as (select rep, total_fps, arg_max(struct_pack(y := sensitivity, x1 := x1, y1 := y1), i) as p from (select *, lead(total_fps) over w as x1, lead(sensitivity) over w as y1 from so window w as (partition by rep order by i)) group by 1, 2),
 sl as (select rep, (1 + k) / 100.0::double as level from (select distinct rep from so), unnest(range(800)) t(k)),
 sv as (select sl.rep, level, case when x.p.x1 is null or x.p.x1 = x.total_fps then x.p.y else x.p.y + (level - x.total_fps) * (x.p.y1 - x.p.y) / (x.p.x1 - x.total_fps) end as v from sl asof join sx x on sl.rep = x.rep and sl.level >= x.total_fps),
 sb as (select level as total_fps, round(quantile_cont(v, 0.025), 6) as sensitivity_lower, round(quantile_cont(v, 0.975), 6) as sensitivity_upper from sv group by 1)"""


def _froc_samples(spark, d) -> tuple[DataFrame, DataFrame]:
    """FROC score of each resample of lesions, and bounds of sensitivity at 800 numbers of false positives."""
    lesions, mask, itc = _froc_parts(spark, d)
    curve = rg.settled(fr.froc_samples(lesions, mask, itc, slides(spark, d), LEVEL, REPS, 11))
    at = mt.interp_curve(curve.where("sensitivity is not null"), mt.levels_of(curve.select("rep").distinct(), 1, 800, 100.0), "total_fps", "sensitivity", ("rep",))
    return rg.settled(fr.froc_score(curve, by=("rep",))), mt.band(at, "total_fps", "sensitivity")


@query("froc_ci", f"""/*and*/ {MASK}, {FROC_SAMPLES} select row_name, froc, null::double as total_fps, null::double as sensitivity_lower, null::double as sensitivity_upper
 from ({named_sql('fs', ['froc'])}) where row_name like 'ci_%' union all by name select 'curve_ci' as row_name, * from sb""", F_VIEWS)
def _(spark, d):
    samples, curve = _froc_samples(spark, d)
    return rounded(mt.percentile_ci(samples, ["froc"]).unionByName(curve.withColumn("row_name", F.lit("curve_ci")), True), ("row_name", "total_fps"))


@query("lesion_results", f"""/*and*/ {MASK}, {FROC}, {FROC_SAMPLES}, fa as (select * from fs union all select -1, {_SCORE.replace('round(', '(').replace(', 9)', ')')} from froc)
 select *, null::double as threshold, null::double as total_fps, null::double as sensitivity, null::double as sensitivity_lower, null::double as sensitivity_upper from ({named_sql('fa', ['froc'])})
 union all by name select 'curve' as row_name, threshold, total_fps, round(sensitivity, 6) as sensitivity from froc union all by name select 'curve_ci' as row_name, * from sb""", F_VIEWS)
def _(spark, d):
    samples, curve = _froc_samples(spark, d)
    out = mt.named_rows(fr.froc_score(_froc(spark, d)), samples, ["froc"])
    out = out.unionByName(_froc(spark, d).select(F.lit("curve").alias("row_name"), "threshold", "total_fps", "sensitivity"), True)
    return rounded(out.unionByName(curve.withColumn("row_name", F.lit("curve_ci")), True), ("row_name", "threshold", "total_fps"))


_GLOBAL = ", ".join(f"count(*) filter (where value >= {t / 10}) / count(*)::double as area_ratio_{t}, round(sum(case when value >= {t / 10} then value else 0 end) / count(*), 9) as prob_score_{t}" for t in range(5, 10))


@query("slide_features_global", f"select slide_idx, {_GLOBAL} from hm group by 1", (PATCHES, HEAT))
def _(spark, d):
    out = rg.global_features(heat(spark, d))
    return out.select(*[F.round(c, 9).alias(c) if c.startswith("prob") else c for c in out.columns])


_TOP = ["area", "eccentricity", "extent", "bbox_area", "major_axis", "max_value", "mean_value", "min_value", "aspect_ratio", "solidity"]


def _top_sql(n: int, columns: list[str], regions: str = "props", slides: str | None = None) -> str:
    cells = ", ".join(f"round(coalesce(max(case when rank = {k} then {c} end), 0)::double, 6) as {c}_{k}" for k in range(1, n + 1) for c in columns)
    rows = f"{slides} left join (select * from top where rank <= {n}) using (slide_idx)" if slides else f"top where rank <= {n}"
    return f"top as (select *, area / bbox_area::double as extent, (max_row - min_row) / (max_col - min_col)::double as aspect_ratio, 1 / area::double as density, row_number() over (partition by slide_idx order by area desc, comp desc) as rank from {regions}) select slide_idx, {cells} from {rows} group by 1"


def _round_all(df: DataFrame) -> DataFrame:
    return df.select("slide_idx", *[F.round(c, 6).alias(c) for c in df.columns[1:]])


@query("slide_features_top2", f"{R}{comps_sql('value >= 0.5')}, {PROPS}, {HULL}, {_top_sql(2, _TOP, 'props join solid using (slide_idx, comp)', '(select distinct slide_idx from hm)')}", (PATCHES, HEAT))
def _(spark, d):
    hm = rg.settled(heat(spark, d))
    found = rg.settled(rg.components(hm.where("value >= 0.5")))
    return _round_all(rg.top_regions(rg.region_features(found), 2, _TOP, hm.select("slide_idx").distinct()))


_DB3 = ["area", "major_axis", "minor_axis", "density", "mean_value", "max_value", "min_value"]


@query("slide_features_dbscan3", f"{R}{dbscan_sql('value > 0.58', 3, 20)}, {PROPS}, {_top_sql(3, _DB3)}", (PATCHES, HEAT))
def dbscan3_features(spark, d):
    return _round_all(rg.top_regions(rg.region_props(tl.dbscan(cells_at(spark, d, 0.58, True), 3, 20)), 3, _DB3))


def wide_features(spark, d) -> DataFrame:
    found = rg.settled(rg.components(cells_at(spark, d, 0.5)))
    top = rg.top_regions(rg.region_features(found), 2, _TOP)
    named = slides(spark, d).select("slide_idx", "slide_name", F.col("label").alias("slide_label"), "tags")
    named = named.join(rg.global_features(heat(spark, d)), "slide_idx", "left").join(top, "slide_idx", "left").fillna(0.0)
    return named.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in named.dtypes])


WIDE_VIEWS = (SLIDES, PATCHES, HEAT)


def wide_sql(tags: bool) -> str:
    shares = {f"area_ratio_{t}": f"count(*) filter (where value >= {t / 10}) / count(*)::double" for t in range(5, 10)} | {f"prob_score_{t}": f"sum(case when value >= {t / 10} then value else 0 end) / count(*)" for t in range(5, 10)}
    cells = {f"{c}_{k}": f"max(case when rank = {k} then {c} end)::double" for k in (1, 2) for c in _TOP}
    listed = lambda of: ", ".join(f"{v} as {k}" for k, v in of.items())
    return f"""{R}{comps_sql('value >= 0.5')}, {PROPS}, {HULL}, every as (select *, area / bbox_area::double as extent, (max_row - min_row) / (max_col - min_col)::double as aspect_ratio, row_number() over (partition by slide_idx order by area desc, comp desc) as rank from props join solid using (slide_idx, comp)),
 best as (select slide_idx, {listed(cells)} from every where rank <= 2 group by 1), shares as (select slide_idx, {listed(shares)} from hm group by 1)
 select slide_idx, slide_name, label as slide_label, {"tags, " if tags else ""}{", ".join(f"round(coalesce({c}, 0), 6) as {c}" for c in [*shares, *cells])} from slides left join shares using (slide_idx) left join best using (slide_idx)"""


@query("slide_features_wide", wide_sql(tags=True), WIDE_VIEWS)
def _(spark, d):
    return wide_features(spark, d)


@query("slide_max_prob", "select slide_idx, max(value) as max_prob from hm group by 1", (PATCHES, HEAT))
def _(spark, d):
    return heat(spark, d).groupBy("slide_idx").agg(F.max("value").alias("max_prob"))


@query("slide_threshold", "select slide_idx, 1 - p as normal, p as tumor, case when p > 0.998 then 'tumor' else 'normal' end as predictions from (select slide_idx, max(value) as p from hm group by 1)", (PATCHES, HEAT))
def _(spark, d):
    p = heat(spark, d).groupBy("slide_idx").agg(F.max("value").alias("tumor"))
    return p.select("slide_idx", (1 - F.col("tumor")).alias("normal"), "tumor", F.when(F.col("tumor") > 0.998, "tumor").otherwise("normal").alias("predictions"))
