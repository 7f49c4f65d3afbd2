"""Queries over the patch index: summaries, set operations, transforms, samples, splits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidegrid.functions.draws import draw_sql
from slidegrid.functions.folders import fresh_path
from slidegrid.operators import index as ix
from slidegrid.plans.fixtures import PATCHES, PIXELS, SLIDES, patches, pixels, slides, table
from slidegrid.plans.registry import query

P, S = (PATCHES,), (SLIDES,)
KEYS = ["slide_idx", "patch_seq"]


@query("patch_summary", "select 0::bigint as background, count(*) filter (where label = 1) as normal, count(*) filter (where label = 2) as tumor from patches", P)
def _(spark, d):
    return ix.patch_summary(patches(spark, d))


@query("slide_summary", """select s.slide_idx, slide_name, s.label as slide_label, 0::bigint as background, count(*) filter (where p.label = 1) as normal,
 count(*) filter (where p.label = 2) as tumor from slides s left join patches p on s.slide_idx = p.slide_idx group by 1, 2, 3""", P + S)
def _(spark, d):
    return ix.slide_summary(slides(spark, d), patches(spark, d))


@query("index_union", """select slide_idx, patch_seq, label, 0 as cps_idx from patches where label = 2 union all select slide_idx, patch_seq, label, 1 from patches where tumor > 0.5""", P)
def _(spark, d):
    p = patches(spark, d).select(*KEYS, "label", "tumor")
    return ix.index_union([p.where("label = 2").drop("tumor"), p.where("tumor > 0.5").drop("tumor")])


@query("label_vocab_minus", "select l as label, count(*) as n from (select case label when 1 then 'normal' when 2 then 'tumor' end as l from patches) group by 1", P)
def _(spark, d):
    vocab = {k: v for k, v in ix.LABELS.items() if k != "background"}
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in vocab.items() for x in (v, k)]), F.col("label"))
    return patches(spark, d).select(name.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


@query("subset_by_index", "select slide_idx, slide_name from slides where slide_idx in (select slide_idx from patches where tumor >= 0.9)", P + S)
def _(spark, d):
    return ix.subset_by_index(slides(spark, d), patches(spark, d).where("tumor >= 0.9")).select("slide_idx", "slide_name")


@query("filter_annotated", "select slide_idx, tags from slides where list_contains(string_split(tags, ';'), 'annotated')", S)
def _(spark, d):
    return ix.filter_annotated(slides(spark, d)).select("slide_idx", "tags")


@query("hard_negatives", "select slide_idx, patch_seq, tumor from patches where tumor > 0.5 and label = 1 order by tumor desc, slide_idx, patch_seq limit 340", P)
def _(spark, d):
    return ix.hard_negatives(patches(spark, d), 340).select(*KEYS, "tumor")


@query("grid_melt", 'select slide_idx, "row", col, r as value from pixels', (PIXELS,))
def _(spark, d):
    lines = pixels(spark, d).groupBy("slide_idx", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "r"))), lambda x: x["r"]).alias("line"))
    grids = lines.groupBy("slide_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("grid"))
    return ix.grid_melt(grids)


_POOL = """select slide_idx, w as "row", v as col, {agg}(r) as value from (select slide_idx, "row", col, r, unnest(range(0, 4)) as w from pixels) a,
 (select unnest(range(0, 4)) as v) b where "row" between w * {s} and w * {s} + {k} - 1 and col between v * {s} and v * {s} + {k} - 1 and w <= {m} and v <= {m} group by 1, 2, 3"""


@query("pool2d", _POOL.format(agg="max", s=2, k=3, m=2), (PIXELS,))
def _(spark, d):
    return ix.pool2d(pixels(spark, d).withColumnRenamed("r", "value"), 3, 2, "max")


@query("pool2d_mean", _POOL.format(agg="avg", s=2, k=2, m=3), (PIXELS,))
def _(spark, d):
    return ix.pool2d(pixels(spark, d).withColumnRenamed("r", "value"), 2, 2, "avg")


@query("pool2d_padded", f"""/*and*/ z as (select s.slide_idx, a.i as "row", b.j as col, coalesce(p.r, 0) as r from (select distinct slide_idx from pixels) s cross join (select unnest(range(-1, 9))::int as i) a cross join (select unnest(range(-1, 9))::int as j) b
 left join pixels p on p.slide_idx = s.slide_idx and p."row" = a.i and p.col = b.j)
 select z.slide_idx, w.i as "row", v.j as col, max(z.r - 100 * (z."row" between 0 and 7 and z.col between 0 and 7)::int) as value, from z join (select unnest(range(0, 4))::int as i) w on z."row" + 1 between 2 * w.i and 2 * w.i + 2 join (select unnest(range(0, 4))::int as j) v on z.col + 1 between 2 * v.j and 2 * v.j + 2 group by 1, 2, 3""", (PIXELS,))
def _(spark, d):
    cells = pixels(spark, d).withColumn("value", F.col("r") - 100)
    return ix.pool2d(cells, 3, 2, "max", padding=1)


@query("grid_patches", 'select slide_idx, cast(floor(col / 2.0::double) as bigint) * 64 as x, cast(floor("row" / 2.0::double) as bigint) * 64 as y, max(r % 3) as label from pixels group by 1, 2, 3', (PIXELS,))
def _(spark, d):
    labels = pixels(spark, d).withColumn("label", F.col("r") % 3)
    out = ix.grid_patches(labels, labels_level=5, patch_level=0, patch_size=64, stride=64)
    return out.withColumn("x", F.col("x").cast("long")).withColumn("y", F.col("y").cast("long"))


@query("patch_border_shift", "select slide_idx, patch_seq, x - 94 as x, y - 94 as y, 435 as patch_size from patches", P)
def _(spark, d):
    return ix.border_shift(patches(spark, d), 171, 8, 256).select(*KEYS, "x", "y", "patch_size")


@query("patch_drop_background", "select slide_idx, patch_seq, label - 1 as label from patches where label - 1 <> 0", P)
def _(spark, d):
    return ix.drop_background(patches(spark, d).withColumn("label", F.col("label") - 1)).select(*KEYS, "label")


@query("patch_clip", "select slide_idx, patch_seq, least(greatest(x - 94, 0), 8192 - 435) as x, least(greatest(y - 94, 0), 8192 - 435) as y from patches", P)
def _(spark, d):
    return ix.clip(ix.border_shift(patches(spark, d), 171, 8, 256), F.lit(8192), F.lit(8192)).select(*KEYS, "x", "y")


@query("transform_single", "select slide_idx, patch_seq, 1 as transform from patches", P)
def _(spark, d):
    return ix.transform_single(patches(spark, d)).select(*KEYS, "transform")


@query("transform_label", "select slide_idx, patch_seq, label, cast(t as int) as transform from (select *, unnest(case when label = 2 then range(1, 9) else [1] end) as t from patches)", P)
def _(spark, d):
    return ix.transform_label(patches(spark, d), 2, 8).select(*KEYS, "label", "transform")


@query("transform_multi", "select slide_idx, patch_seq, cast(t as int) as transform from (select *, unnest(range(1, 5)) as t from patches)", P)
def _(spark, d):
    return ix.transform_multi(patches(spark, d), 4).select(*KEYS, "transform")


@query("tile_region", "select slide_idx, patch_seq, 0 as level, x, y, 256 as width, 256 as height from patches", P)
def _(spark, d):
    from slidegrid.sources.tables import tile_region

    r = tile_region(F.col("x"), F.col("y"), 256, 0)
    return patches(spark, d).select(*KEYS, r.alias("r")).select(*KEYS, "r.level", "r.location.x", "r.location.y", F.col("r.size.w").alias("width"), F.col("r.size.h").alias("height"))


_H = draw_sql(17, "slide_idx", "patch_seq")


@query("sample_simple", f"select slide_idx, patch_seq, label from patches qualify row_number() over (partition by label order by {_H}, slide_idx, patch_seq) <= 500", P)
def _(spark, d):
    return ix.sample_simple(patches(spark, d), 500, 17).select(*KEYS, "label")


@query("sample_replace", f"""/*and*/ n as (select *, row_number() over (partition by label order by slide_idx, patch_seq) as rank, count(*) over (partition by label) as cnt from patches),
 c as (select distinct label, cnt from n), k as (select label, cnt, unnest(range(0, 500)) as k from c)
 select k.label, cast(k as int) as k, slide_idx, patch_seq, tumor from (select label, k, {draw_sql(17, 'label', 'k')} % cnt + 1 as rank from k) k join n on k.label = n.label and k.rank = n.rank""", P)
def _(spark, d):
    return ix.sample_replace(patches(spark, d), 500, 17)


@query("sample_weighted", f"""/*and*/ i as (select label, slide_idx, patch_seq, row_number() over (partition by label, slide_idx order by patch_seq) as rank from patches),
 s as (select label, slide_idx, count(*) as n_patches, row_number() over (partition by label order by slide_idx) as slide_rank from patches group by 1, 2),
 c as (select label, count(*) as n_slides from s group by 1), k as (select label, n_slides, unnest(range(0, 500)) as k from c),
 h as (select k.label, k, s.slide_idx, {draw_sql('17p', 'k.label', 'k')} % n_patches + 1 as rank from k join s on s.label = k.label and s.slide_rank = {draw_sql('17s', 'k.label', 'k')} % n_slides + 1)
 select h.label, cast(k as int) as k, h.slide_idx, patch_seq from h join i on h.label = i.label and h.slide_idx = i.slide_idx and h.rank = i.rank""", P)
def _(spark, d):
    return ix.sample_weighted(patches(spark, d), 500, 17)


@query("balanced_sample", f"""/*and*/ c as (select greatest(least(min(n), 4000), 1000) as cap from (select count(*) as n from patches group by label))
 select slide_idx, patch_seq, label from patches, c qualify row_number() over (partition by label order by {_H}, slide_idx, patch_seq) <= cap""", P)
def _(spark, d):
    return ix.balanced_sample(patches(spark, d), 4000, 1000, 17).select(*KEYS, "label")


def _split_sql(stratum: str, share: float) -> str:
    return f"""select slide_idx, {stratum}, case when row_number() over (partition by {stratum} order by {draw_sql(7, 'slide_idx')}, slide_idx) <= floor(count(*) over (partition by {stratum}) * {share}::double) then 'train' else 'valid' end as split from slides"""


@query("split_stratified", _split_sql("label", 0.8), S)
def _(spark, d):
    return ix.split_stratified(slides(spark, d), 0.8, 7).select("slide_idx", "label", "split")


@query("split_strata_4", _split_sql("stage", 0.7), S)
def _(spark, d):
    return ix.split_stratified(slides(spark, d), 0.7, 7, "stage").select("slide_idx", "stage", "split")


@query("split_strata_3", _split_sql("stage", 0.6) + " where stage <> 'itc'", S)
def _(spark, d):
    return ix.split_stratified(slides(spark, d).where("stage <> 'itc'"), 0.6, 7, "stage").select("slide_idx", "stage", "split")


@query("split_grouped", f"""/*and*/ p as (select patient, bool_or(annotated) as has from slides group by 1), t as (select count(*) as everyone, count(*) filter (where has) as having_ from p),
 r as (select patient, has, row_number() over (partition by has order by {draw_sql(7, 'patient')}, patient) as rank, everyone, having_ from p, t)
 select slide_idx, s.patient, case when rank <= case when has then floor(having_ * 0.8::double) else floor(everyone * 0.8::double) - floor(having_ * 0.8::double) end then 'train' else 'valid' end as split
 from slides s join r on s.patient = r.patient""", S)
def _(spark, d):
    return ix.split_grouped(slides(spark, d), 0.8, 7).select("slide_idx", "patient", "split")


@query("split_by_tag", "select slide_idx, case when patient_no % 3 = 0 then 'train' else 'valid' end as split from slides where patient_no % 3 < 2", S)
def _(spark, d):
    tag = F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), (F.col("patient_no") % 3 + 1).cast("int"))
    return ix.split_by_tag(slides(spark, d).withColumn("tags", F.concat_ws(";", "patient", tag))).select("slide_idx", "split")


@query("split_balance_check", f"""/*and*/ s as ({_split_sql('label', 0.8)}), n as (select slide_idx, count(*) filter (where label = 2) as n from patches group by 1),
 j as (select split, coalesce(n, 0) as n from s left join n using (slide_idx)),
 a as (select sum(case when split = 'train' then n else 0 end)::bigint as train_positive, sum(n)::bigint as all_positive, count(*) filter (where split = 'train' and n > 0) > 0 as has_positive_slide from j)
 select *, train_positive >= all_positive * (0.8::double * (1 - 0.05::double)) and train_positive <= all_positive * (0.8::double * (1 + 0.05::double)) as balanced from a""", P + S)
def _(spark, d):
    return ix.split_balance_check(ix.split_stratified(slides(spark, d), 0.8, 7), patches(spark, d), 0.8)


@query("split_class_matrix", f"""/*and*/ s as ({_split_sql('label', 0.8)}) select coalesce(split, 'total') as split, count(*) filter (where label = 'normal') as normal, count(*) filter (where label = 'tumor') as tumor,
 least(count(*) filter (where label = 'normal'), count(*) filter (where label = 'tumor')) < 1 as has_empty_class from s group by rollup (split)""", S)
def _(spark, d):
    return ix.split_class_matrix(ix.split_stratified(slides(spark, d), 0.8, 7), ("normal", "tumor"))


@query("softmax", """/*and*/ e as (select vec_id, unnest(range(0, 64)) as k, unnest(embedding)::double as z from embeddings), x as (select vec_id, k, exp(z - max(z) over (partition by vec_id)) as e from e)
 select vec_id, cast(k as int) as k, round(e / sum(e) over (partition by vec_id), 6) as p from x""", ("one as (select 1)",))
def _(spark, d):
    p = ix.softmax(F.col("embedding").cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(p).alias("k", "p")).withColumn("p", F.round("p", 6))


@query("score_attach", "select slide_idx, patch_seq, label, tumor_b, 1 - tumor_b as normal_b from patches", P)
def _(spark, d):
    p = patches(spark, d)
    return ix.score_attach(p.select(*KEYS, "label"), p.select(*KEYS, "tumor_b", (1 - F.col("tumor_b")).alias("normal_b")))


@query("score_resume", "select slide_idx, patch_seq, case when slide_idx % 3 = 0 then tumor else tumor_b end as tumor from patches", P)
def _(spark, d):
    """A first run has scored some slides when it ends; the second, with another model, does the others."""
    p, folder = patches(spark, d), fresh_path(spark, "scores")
    ix.score_resume(p.where("slide_idx % 3 = 0"), folder, lambda left: left.select(*KEYS, "tumor"), "first")
    return ix.score_resume(p, folder, lambda left: left.select(*KEYS, F.col("tumor_b").alias("tumor")), "second")


@query("tta_average", """select slide_idx, x, y, max(label) as label, round(avg((1 - tumor) * t / 8), 9) as normal, round(avg(tumor * t / 8), 9) as tumor from (select *, unnest(range(1, 9)) as t from patches) group by 1, 2, 3""", P)
def _(spark, d):
    t = ix.transform_multi(patches(spark, d), 8)
    t = t.withColumn("normal", F.col("normal") * F.col("transform") / 8).withColumn("tumor", F.col("tumor") * F.col("transform") / 8)
    return ix.tta_average(t).withColumn("normal", F.round("normal", 9)).withColumn("tumor", F.round("tumor", 9))


@query("argmax_class", "select slide_idx, patch_seq, case when normal >= tumor then 'normal' else 'tumor' end as predicted from patches", P)
def _(spark, d):
    return ix.argmax_class(patches(spark, d)).select(*KEYS, "predicted")
