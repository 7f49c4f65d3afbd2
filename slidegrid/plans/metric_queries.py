"""Queries of the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidegrid.operators import metrics as mt
from slidegrid.operators.resampling import LEAF, mixed_sql
from slidegrid.plans.fixtures import DOC_SCORES, PATCHES, SLIDES, doc_scores, patches, slides
from slidegrid.plans.registry import query

P, S, D = (PATCHES,), (SLIDES,), (DOC_SCORES,)
REPS = 1000

_METRICS = """tn, fp, fn, tp, (tp + tn) / (tp + tn + fp + fn)::double as accuracy, tp / nullif(tp + fn, 0)::double as recall, tn / nullif(tn + fp, 0)::double as specificity, tp / nullif(tp + fp, 0)::double as precision"""
_COUNTS = """sum(case when not said and not is_ then w else 0 end)::bigint as tn, sum(case when said and not is_ then w else 0 end)::bigint as fp, sum(case when not said and is_ then w else 0 end)::bigint as fn, sum(case when said and is_ then w else 0 end)::bigint as tp"""


@query("patch_metrics", f"/*and*/ s as (select tumor >= 0.5 as said, label = 2 as is_, 1 as w from patches), c as (select {_COUNTS} from s) select {_METRICS} from c", P)
def _(spark, d):
    return mt.patch_metrics(patches(spark, d))


_VOCAB = "v(x) as (values ('negative'), ('itc'), ('micro'), ('macro')), m as (select a.x as true_label, b.x as pred_label, count(s.slide_idx) as n from v a cross join v b left join slides s on s.stage = a.x and s.prediction = b.x group by 1, 2)"


@query("confusion_matrix", f"/*and*/ {_VOCAB} select * from m", S)
def _(spark, d):
    return mt.confusion_matrix(slides(spark, d), mt.STAGES, "stage", "prediction")


for _over, _keys in (("true", "partition by true_label"), ("pred", "partition by pred_label"), ("percent", "")):

    @query(f"confusion_normalised_{_over}", f"/*and*/ {_VOCAB} select *, n / nullif(sum(n) over ({_keys}), 0)::double as share from m", S)
    def _(spark, d, over=_over):
        return mt.confusion_normalised(mt.confusion_matrix(slides(spark, d), mt.STAGES, "stage", "prediction"), over)


_CELLS = ", ".join(f"count(*) filter (where stage = '{a}' and prediction = '{b}') as true_{a}_pred_{b}" for a in mt.STAGES for b in mt.STAGES)


@query("patch_metrics_multi", "select avg(case when (label = 2) = (tumor > normal) then 1.0::double else 0 end) as accuracy, " + ", ".join(f"count(*) filter (where label = {a} and (tumor > normal) = {b == 2}) as true_{a}_pred_{b}" for a in (1, 2) for b in (1, 2)) + " from patches", P)
def _(spark, d):
    return mt.metrics_multi(patches(spark, d).withColumn("predicted", F.when(F.col("tumor") > F.col("normal"), 2).otherwise(1)), (1, 2))


def _curve_sql(rows: str, score: str, positive: str, by: str = "", weight: str = "1") -> str:
    """Common tables g (by score) and curve."""
    part, lead = (f"partition by {by} " if by else ""), (f"{by}, " if by else "")
    return f"""g as (select {lead}{score} as threshold, sum(case when {positive} then {weight} else 0 end) as p, sum(case when {positive} then 0 else {weight} end) as n from {rows} group by {lead}{score}),
 r as (select {lead}threshold, sum(p) over ({part}order by threshold desc) as tp, sum(n) over ({part}order by threshold desc) as fp, sum(p) over ({part}) as all_p, sum(n) over ({part}) as all_n from g),
 curve as (select {lead}threshold, tp::bigint as tp, fp::bigint as fp, tp / (tp + fp)::double as precision, tp / nullif(all_p, 0)::double as recall, fp / nullif(all_n, 0)::double as fpr from r)"""


_DOCS = _curve_sql("doc_scores", "score", "toxic = 1")


@query("binary_curve", f"/*and*/ {_curve_sql('patches', 'tumor', 'label = 2')} select * from curve", P)
def _(spark, d):
    return mt.binary_curve(patches(spark, d), "tumor", F.col("label") == 2)


@query("binary_curve_documents", f"/*and*/ {_DOCS} select * from curve", D)
def _(spark, d):
    return mt.binary_curve(doc_scores(spark, d), "score", F.col("toxic") == 1)


def _auc_sql(x: str, y: str, by: str = "") -> str:
    part, lead = (f"partition by {by} " if by else ""), (f"{by}, " if by else "")
    return f"select {lead}round(sum(dx * my), 6) as auc from (select {lead}{x} - lag({x}) over ({part}order by {x}, threshold desc) as dx, ({y} + lag({y}) over ({part}order by {x}, threshold desc)) / 2 as my from curve) {'group by ' + by if by else ''}"


for _name, _x, _y in (("curve_auc", "recall", "precision"), ("roc_auc", "fpr", "recall")):

    @query(_name, f"/*and*/ {_DOCS} {_auc_sql(_x, _y)}", D)
    def _(spark, d, x=_x, y=_y):
        return mt.curve_auc(mt.binary_curve(doc_scores(spark, d), "score", F.col("toxic") == 1), x, y).select(F.round("auc", 6).alias("auc"))


def _interp_sql(x: str, y: str, levels: int) -> str:
    return f"""l as (select range / {levels}.0::double as level from range({levels + 1})),
 c as (select {x} as x, {y} as y, row_number() over (order by {x}, threshold desc) as i from curve),
 j as (select level, max(i) as i from l left join c on c.x <= level group by 1),
 k as (select level, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from j left join c a on a.i = j.i left join c b on b.i = coalesce(j.i, 0) + 1)
 select level, round(case when x0 is null then y1 when x1 is null then y0 when x1 = x0 then y0 else y0 + (level - x0) * (y1 - y0) / (x1 - x0) end, 6) as value from k"""


for _name, _x, _y, _n in (("interp_curve", "recall", "precision", 1000), ("interp_roc", "fpr", "recall", 100)):

    @query(_name, f"/*and*/ {_DOCS}, {_interp_sql(_x, _y, _n)}", D)
    def _(spark, d, x=_x, y=_y, n=_n):
        levels = spark.range(n + 1).select((F.col("id") / float(n)).alias("level"))
        curve = mt.binary_curve(doc_scores(spark, d), "score", F.col("toxic") == 1)
        return mt.interp_curve(curve, levels, x, y).withColumn("value", F.round("value", 6))


def boot_sql(rows: str, order: str, seed: int) -> str:
    """Common table boot: rows with rep and weight. All rows are one leaf of places here (LEAF of them at most, as in
    the tables that oracles read), so that each draw is a single one."""
    return f"""bn as (select *, row_number() over (order by {order}) - 1 as i_ from {rows}), bs as (select case when count(*) > {LEAF} then error('more rows than a leaf') else count(*) end as n_ from {rows}),
 bk as (select rep, {mixed_sql(f'{seed}::hugeint * 4294967296 + rep', 'a')}, {mixed_sql('a_5', 'b')} from (select unnest(range(0, {REPS})) as rep)),
 bd as (select rep, unnest(range(0, (select n_ from bs))) as k_, b_5 from bk),
 bi as (select rep, {mixed_sql('b_5 + k_', 'c')}, ((c_5 >> 32) * (select n_ from bs)) >> 32 as i_ from bd),
 bc as (select rep, i_::bigint as i_, count(*) as weight from bi group by 1, 2),
 boot as (select cast(rep as int) as rep, weight, bn.* exclude (i_) from bc join bn using (i_))"""


@query("bootstrap", f"/*and*/ {boot_sql('slides', 'slide_idx', 3)} select rep, slide_idx, weight from boot", S)
def _(spark, d):
    return mt.bootstrap(slides(spark, d), ["slide_idx"], REPS, 3).select("rep", "slide_idx", "weight")


def _ci_sql(samples: str, columns: list[str]) -> str:
    at = lambda q: ", ".join(f"quantile_cont({c}, {q}) as {c}" for c in columns)
    return f"select 'ci_lower_bound' as row_name, {at(0.025)} from {samples} union all select 'ci_upper_bound', {at(0.975)} from {samples}"


@query("percentile_ci", f"/*and*/ {boot_sql('slides', 'stage, prediction', 3)}, a as (select rep, sum(case when stage = prediction then weight else 0 end) / sum(weight)::double as accuracy from boot group by 1) {_ci_sql('a', ['accuracy'])}", S)
def _(spark, d):
    samples = mt.metrics_multi(mt.resampled_cells(slides(spark, d), REPS, 3, "stage", "prediction"), mt.STAGES, "stage", "prediction", by=("rep",))
    return mt.percentile_ci(samples, ["accuracy"])


def named_sql(samples: str, columns: list[str]) -> str:
    """results (rep -1), bounds and samples of a table of figures by rep."""
    figures = ", ".join(f'round("{c}"::double, 6) as "{c}"' for c in columns)
    bounds = [f"select '{name}' as row_name, " + ", ".join(f'round(quantile_cont("{c}"::double, {q}), 6) as "{c}"' for c in columns) + f" from {samples} where rep >= 0" for name, q in (("ci_lower_bound", 0.025), ("ci_upper_bound", 0.975))]
    return f"select case when rep < 0 then 'results' else 'sample_' || rep end as row_name, {figures} from {samples} union all " + " union all ".join(bounds)


def rounded(report, keep: tuple[str, ...] = ("row_name", "threshold")):
    return report.select(*[c if c in keep else F.round(F.col(f"`{c}`"), 6).alias(c) for c in report.columns])


_PATCH_SQL = f"""/*and*/ {boot_sql('doc_scores', 'score desc, toxic desc', 5)}, al as (select rep, weight, score, toxic from boot union all select -1, 1, score, toxic from doc_scores),
 ct as (select rep, {_METRICS} from (select rep, {_COUNTS} from (select rep, score >= 0.5 as said, toxic = 1 as is_, weight as w from al) group by 1)),
 {_curve_sql('al', 'score', 'toxic = 1', 'rep', 'weight')},
 pt as (select rep, threshold, recall, precision, row_number() over (partition by rep order by recall, threshold desc) as i from curve where recall is not null),
 nx as (select *, lead(recall) over (partition by rep order by i) as r1, lead(precision) over (partition by rep order by i) as p1 from pt),
 lt as (select rep, recall, arg_max(struct_pack(p := precision, r1 := r1, p1 := p1), i) as s from nx where rep >= 0 group by 1, 2),
 lv as (select rep, range / 1000.0::double as level from (select distinct rep from pt where rep >= 0), range(1001)),
 f0 as (select rep, arg_min(precision, i) as p from pt group by 1),
 av as (select lv.rep, level, case when lt.s is null then f0.p when lt.s.r1 is null or lt.s.r1 = lt.recall then lt.s.p else lt.s.p + (level - lt.recall) * (lt.s.p1 - lt.s.p) / (lt.s.r1 - lt.recall) end as v
  from lv asof left join lt on lv.rep = lt.rep and lv.level >= lt.recall join f0 on f0.rep = lv.rep),
 ar as (select rep, sum((level - x0) * (v + v0) / 2) as auc from (select *, lag(level) over (partition by rep order by level) as x0, lag(v) over (partition by rep order by level) as v0 from av where level > 0) group by 1
  union all select -1, sum((recall - x0) * (precision + y0) / 2) from (select *, lag(recall) over (order by i) as x0, lag(precision) over (order by i) as y0 from pt where rep = -1)),
 sm as (select ct.*, auc from ct left join ar using (rep)), fig as ({named_sql('sm', mt.PATCH_FIGURES)})
 select *, null::double as threshold, null::double as level, null::double as value, null::double as value_lower, null::double as value_upper from fig
 union all by name select 'curve' as row_name, threshold, round(recall, 6) as level, round(precision, 6) as value from pt where rep = -1
 union all by name select 'curve_ci' as row_name, level, round(quantile_cont(v, 0.025), 6) as value_lower, round(quantile_cont(v, 0.975), 6) as value_upper from av group by level"""


@query("patch_report", _PATCH_SQL, D)
def _(spark, d):
    rows = doc_scores(spark, d).select(F.col("toxic").alias("label"), "score")
    return rounded(mt.patch_report(rows, REPS, 5))


def _cells_sql(vocabulary: tuple[str, ...], true: str, predicted: str) -> tuple[str, list[str]]:
    named = [(f"true_{a}_pred_{b}", f"sum(case when {true} = '{a}' and {predicted} = '{b}' then w else 0 end)") for a in vocabulary for b in vocabulary]
    return ", ".join(f'{e} as "{n}"' for n, e in named), [n for n, _ in named]


_STAGE_CELLS, _STAGE_NAMES = _cells_sql(mt.STAGES, "stage", "prediction")


@query("slide_metrics_multi", f"""/*and*/ {boot_sql('slides', 'stage, prediction', 3)}, al as (select rep, weight as w, stage, prediction from boot union all select -1, 1, stage, prediction from slides),
 sm as (select rep, sum(case when stage = prediction then w else 0 end) / sum(w)::double as accuracy, {_STAGE_CELLS} from al group by 1) {named_sql('sm', ['accuracy', *_STAGE_NAMES])}""", S)
def _(spark, d):
    return rounded(mt.multi_report(slides(spark, d), REPS, 3, mt.STAGES, "stage", "prediction"))


_NAMES = ("accuracy", "tn", "fp", "fn", "tp", "auc")


def _report_sql() -> str:
    """The report by plain joins: each level meets all points below it."""
    rest = "null::double as threshold, null::double as fpr, null::double as tpr, null::double as tpr_lower, null::double as tpr_upper"
    none = ", ".join(f"null::double as {c}" for c in _NAMES)
    figures = ", ".join(f"round({c}::double, 6) as {c}" for c in _NAMES)
    return f"""/*and*/ sl as (select slide_idx, (label = 'tumor')::int as label, coalesce(max(tumor), 0) as score from (select slide_idx, label from slides) left join (select slide_idx, tumor from patches) using (slide_idx) group by 1, 2),
 s1 as (select *, (score > 0.9)::int as said from sl), {boot_sql('s1', 'score desc, label desc', 3)},
 al as (select rep, weight, label, score, said from boot union all select -1, 1, label, score, said from s1),
 ct as (select rep, sum(case when said = label then weight else 0 end) / sum(weight)::double as accuracy, sum(case when said = 0 and label = 0 then weight else 0 end) as tn, sum(case when said = 1 and label = 0 then weight else 0 end) as fp,
  sum(case when said = 0 and label = 1 then weight else 0 end) as fn, sum(case when said = 1 and label = 1 then weight else 0 end) as tp from al group by 1),
 {_curve_sql('al', 'score', 'label = 1', 'rep', 'weight')},
 pt as (select rep, threshold, fpr, recall as tpr from curve where fpr is not null and recall is not null),
 og as (select rep, threshold, fpr, tpr from pt union all select distinct rep, 'inf'::double, 0::double, 0::double from pt),
 nr as (select *, row_number() over (partition by rep order by fpr, threshold desc) as i from og),
 lv as (select rep, range / 100.0::double as level from (select distinct rep from pt where rep >= 0), range(101)),
 lo as (select lv.rep, level, max(i) as i from lv join nr on nr.rep = lv.rep and nr.fpr <= level group by 1, 2),
 av as (select lo.rep, level, case when b.fpr is null or b.fpr = a.fpr then a.tpr else a.tpr + (level - a.fpr) * (b.tpr - a.tpr) / (b.fpr - a.fpr) end as v
  from lo join nr a on a.rep = lo.rep and a.i = lo.i left join nr b on b.rep = lo.rep and b.i = lo.i + 1),
 ar as (select rep, sum((level - x0) * (v + v0) / 2) as auc from (select *, lag(level) over (partition by rep order by level) as x0, lag(v) over (partition by rep order by level) as v0 from av) group by 1),
 a0 as (select -1 as rep, sum((fpr - x0) * (tpr + y0) / 2) as auc from (select *, lag(fpr) over (order by i) as x0, lag(tpr) over (order by i) as y0 from nr where rep = -1)),
 sm as (select ct.*, auc from ct left join (select * from ar union all select * from a0) using (rep)),
 ss as (select * from sm where rep >= 0),
 ci as ({_ci_sql('ss', list(_NAMES))})
 select case when rep < 0 then 'results' else 'sample_' || rep end as row_name, {figures}, {rest} from sm
 union all select row_name, {figures}, {rest} from ci
 union all select 'curve', {none}, threshold, round(fpr, 6), round(tpr, 6), null, null from pt where rep = -1
 union all select 'curve_ci', {none}, null, level, null, round(quantile_cont(v, 0.025), 6), round(quantile_cont(v, 0.975), 6) from av group by level"""


@query("slide_metrics_binary", _report_sql(), S + P)
def _(spark, d):
    best = patches(spark, d).groupBy("slide_idx").agg(F.max("tumor").alias("score"))
    rows = slides(spark, d).select("slide_idx", "label").join(best, "slide_idx", "left").fillna(0.0, ["score"])
    report = mt.slide_report(rows.select((F.col("label") == "tumor").cast("int").alias("label"), "score"), REPS, 3)
    return report.select(*[c if c in ("row_name", "threshold") else F.round(c, 6).alias(c) for c in report.columns])


_MULTI_SQL = f"""{boot_sql('slides', 'stage, prediction', 3)}, al as (select rep, weight as w, stage, prediction from boot union all select -1, 1, stage, prediction from slides),
 sm as (select rep, sum(case when stage = prediction then w else 0 end) / sum(w)::double as accuracy, {_STAGE_CELLS} from al group by 1) {named_sql('sm', ['accuracy', *_STAGE_NAMES])}"""


@query("slide_metrics", f"""/*and*/ multi as (select 'multi' as kind, row_name, figure, value from (unpivot (with {_MULTI_SQL}) on columns(* exclude (row_name)) into name figure value value)),
 two as (select 'binary' as kind, row_name, figure, value from (unpivot (select row_name, {', '.join(_NAMES)} from (with {_report_sql().removeprefix('/*and*/')})) on {', '.join(_NAMES)} into name figure value value)) select * from multi union all select * from two""", S + P)
def _(spark, d):
    long = lambda kind, report, names: report.select(F.lit(kind).alias("kind"), "row_name", F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in names])).alias("f")).select("kind", "row_name", "f.figure", "f.value").where("value is not null")
    staged = slides(spark, d).select(F.col("stage").alias("label"), "prediction")
    best = patches(spark, d).groupBy("slide_idx").agg(F.max("tumor").alias("score"))
    two = slides(spark, d).select("slide_idx", "label").join(best, "slide_idx", "left").fillna(0.0, ["score"]).select("label", "score")
    multi = mt.slide_metrics(staged, mt.STAGES, REPS, 3)
    return long("multi", multi, ["accuracy", *_STAGE_NAMES]).unionByName(long("binary", mt.slide_metrics(two, ("normal", "tumor"), REPS, 3), _NAMES))


_PATIENTS = """pt as (select patient, count(*) as n_slides, count(*) filter (where prediction = 'macro') as macro, count(*) filter (where prediction = 'micro') as micro, count(*) filter (where prediction = 'itc') as itc, count(*) filter (where prediction = 'negative') as negative, min(patient_stage) as true_stage from slides group by 1),
 ps as (select patient, case when macro > 0 and macro + micro >= 4 then 'pN2' when macro > 0 then 'pN1' when micro > 0 then 'pN1mi' when itc > 0 then 'pN0(i+)' when negative = n_slides then 'pN0' end as predicted_stage, true_stage, n_slides = 5 as complete, macro + micro + itc + negative < n_slides as unknown from pt)"""
_ORDER = "['pN0', 'pN0(i+)', 'pN1mi', 'pN1', 'pN2']"


def _kappa_sql(rows: str, by: str = "", weight: str = "1") -> str:
    lead, group = (f"{by}, ", f"group by {by}") if by else ("", "")
    return f"""select {lead}1 - sum(w * (i - j) * (i - j)) / nullif(sum(w * i * i) + sum(w * j * j) - 2 * sum(w * i) * sum(w * j) / sum(w), 0) as kappa
 from (select {lead}{weight}::double as w, list_position({_ORDER}, true_stage)::double as i, list_position({_ORDER}, predicted_stage)::double as j from {rows}) {group}"""


@query("patient_stage", f"/*and*/ {_PATIENTS} select * from ps", S)
def _(spark, d):
    return mt.patient_stage(slides(spark, d))


@query("kappa_quadratic", f"/*and*/ {_PATIENTS}, k as ({_kappa_sql('ps')}) select round(kappa, 9) as kappa from k", S)
def _(spark, d):
    return mt.kappa_quadratic(mt.patient_stage(slides(spark, d))).select(F.round("kappa", 9).alias("kappa"))


@query("kappa_validated", f"/*and*/ {_PATIENTS}, k as ({_kappa_sql('ps')}) select round(kappa, 9) as kappa from k", S)
def _(spark, d):
    p = mt.patient_stage(slides(spark, d)).withColumn("zip", F.concat("patient", F.lit(".ZIP")))
    nodes = slides(spark, d).select(F.col("slide_name").alias("patient"), "stage")
    tab = lambda c: p.select(F.col("zip").alias("patient"), F.upper(c).alias("stage")).unionByName(nodes)
    return mt.kappa_validated(tab("true_stage"), tab("predicted_stage")).select(F.round("kappa", 9).alias("kappa"))


_PATIENT_CELLS, _PATIENT_NAMES = _cells_sql(mt.PATIENT_STAGES, "true_stage", "predicted_stage")


@query("patient_metrics", f"""/*and*/ {_PATIENTS}, {boot_sql('ps', 'true_stage nulls first, predicted_stage nulls first', 9)}, al as (select rep, weight as w, true_stage, predicted_stage from boot union all select -1, 1, true_stage, predicted_stage from ps),
 k as ({_kappa_sql('al', 'rep', 'w')}), sm as (select rep, any_value(kappa) as kappa, {_PATIENT_CELLS} from al join k using (rep) group by rep) {named_sql('sm', ['kappa', *_PATIENT_NAMES])}""", S)
def _(spark, d):
    return rounded(mt.multi_report(mt.patient_stage(slides(spark, d)), REPS, 9, mt.PATIENT_STAGES, "true_stage", "predicted_stage", kappa=True))
