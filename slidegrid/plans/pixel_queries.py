"""Queries over pixel tables and masks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.functions.draws import draw_sql
from slidegrid.operators import index as ix
from slidegrid.operators import pixels as px
from slidegrid.operators import tiles as tl
from slidegrid.plans.fixtures import EVAL_MASK, PATCHES, PIXELS, eval_mask, patches, pixels, table
from slidegrid.plans.registry import query

X = (PIXELS,)
C = px.CELL
K = 'slide_idx, "row", col'
HSV = """hsv0 as (select *, greatest(r, g, b) / 255.0::double as top, least(r, g, b) / 255.0::double as low from pixels),
 hsv as (select slide_idx, "row", col, top as v, case when top = 0 then 0 else (top - low) / top end as s,
 case when top = low then 0 when r >= g and r >= b then (((g - b) / 255.0::double / (top - low)) + case when g < b then 6 else 0 end) when g >= b then 2 + (b - r) / 255.0::double / (top - low) else 4 + (r - g) / 255.0::double / (top - low) end / 6.0::double as h from hsv0)"""
GRAY = "(r * 0.2125::double + g * 0.7154::double + b * 0.0721::double) / 255.0::double"


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


@query("px_downsample", 'select slide_idx, cast(floor("row" / 2) as int) as "row", cast(floor(col / 2) as int) as col, avg(r) as r, avg(g) as g, avg(b) as b from pixels group by 1, 2, 3', X)
def _(spark, d):
    return px.downsample(pixels(spark, d), 2)


@query("px_level_shape", """select s_suppkey as slide_idx, cast(least(5, 3 + s_suppkey % 4) as int) as from_level,
 cast(floor(floor(8192 / pow(2, least(5, 3 + s_suppkey % 4))) / pow(2, 5 - least(5, 3 + s_suppkey % 4))) as bigint) as height, cast(floor(floor(4096 / pow(2, least(5, 3 + s_suppkey % 4))) / pow(2, 5 - least(5, 3 + s_suppkey % 4))) as bigint) as width from supplier""")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slide_idx"), F.explode(F.sequence(F.lit(0), (3 + F.col("s_suppkey") % 4).cast("int"))).alias("level"))
    side = lambda n: F.floor(n / F.pow(F.lit(2.0), "level"))
    return px.level_shape(s.select("slide_idx", "level", side(8192).alias("height"), side(4096).alias("width")), 5)


@query("px_hsv", f"/*and*/ {HSV} select {K}, round(h, 6) as h, round(s, 6) as s, round(v, 6) as v from hsv", X)
def _(spark, d):
    return _r(px.hsv(pixels(spark, d)).drop("r", "g", "b"), "h", "s", "v")


@query("px_gray", f"select {K}, round({GRAY}, 6) as gray from pixels", X)
def _(spark, d):
    return _r(px.gray(pixels(spark, d)).drop("r", "g", "b"), "gray")


@query("px_black_to_white", f"select {K}, case when r % 9 = 0 then 255 else r end as r, case when r % 9 = 0 then 255 else g end as g, case when r % 9 = 0 then 255 else b end as b from pixels", X)
def _(spark, d):
    dark = pixels(spark, d)
    dark = dark.select(*C, *[F.when(F.col("r") % 9 == 0, 0).otherwise(F.col(c)).alias(c) for c in "rgb"])
    return px.black_to_white(dark)


def otsu_sql(rows: str, value: str, name: str) -> str:
    return f"""{name}_e as (select slide_idx, min({value}) as lo, max({value}) as hi from {rows} group by 1),
 {name}_c as (select x.slide_idx, case when hi = lo then 0 else cast(least(floor(({value} - lo) / ((hi - lo) / 256.0::double)), 255) as int) end as bin, count(*) as n from {rows} x join {name}_e e on x.slide_idx = e.slide_idx group by 1, 2),
 {name}_h as (select e.slide_idx, lo, hi, b.range as bin, coalesce(n, 0) as n from {name}_e e cross join range(256) b left join {name}_c c on c.slide_idx = e.slide_idx and c.bin = b.range),
 {name}_s as (select *, sum(n) over up as w1, sum(n * (bin + 0.5::double)) over up as m1, sum(n) over al as w, sum(n * (bin + 0.5::double)) over al as m from {name}_h window up as (partition by slide_idx order by bin), al as (partition by slide_idx)),
 {name}_v as (select *, coalesce(round(w1 * (w - w1) * (m1 / nullif(w1, 0) - (m - m1) / nullif(w - w1, 0)) * (m1 / nullif(w1, 0) - (m - m1) / nullif(w - w1, 0)), 6), -1) as between_ from {name}_s),
 {name} as (select slide_idx, case when hi = lo then lo::double else lo + (bin + 0.5::double) * ((hi - lo) / 256.0::double) end as threshold from {name}_v qualify row_number() over (partition by slide_idx order by between_ desc, bin) = 1)"""


@query("px_otsu", f"/*and*/ {otsu_sql('pixels', 'r', 'o')} select slide_idx, round(threshold, 6) as threshold from o", X)
def _(spark, d):
    return _r(px.otsu(pixels(spark, d), "r"), "threshold")


MASK_OTSU = f"{HSV}, {otsu_sql('hsv', 'h', 'oh')}, {otsu_sql('hsv', 's', 'os')}, mo as (select p.slide_idx, p.\"row\", p.col, h > oh.threshold or s > os.threshold as mask from hsv p join oh on p.slide_idx = oh.slide_idx join os on p.slide_idx = os.slide_idx)"


@query("mask_otsu", f"/*and*/ {MASK_OTSU} select {K}, mask from mo", X)
def _(spark, d):
    return px.mask_otsu(pixels(spark, d))


MG = f"mg as (select {K}, {GRAY} <= 0.5 as mask from pixels)"


def grey(spark, d) -> DataFrame:
    return px.mask_grey(pixels(spark, d), 0.5)


@query("mask_grey", f"/*and*/ {MG} select * from mg", X)
def _(spark, d):
    return grey(spark, d)


@query("mask_all", f"select {K}, true as mask from pixels", X)
def _(spark, d):
    return px.mask_all(pixels(spark, d))


def _mirror(e: str) -> str:
    return f"case when (({e}) % 16 + 16) % 16 < 8 then (({e}) % 16 + 16) % 16 else 15 - (({e}) % 16 + 16) % 16 end"


def stencil_sql(rows: str, value: str, name: str, steps: str) -> str:
    """steps: rows (i, j, w)."""
    return f"""{name} as (select a.slide_idx, a."row", a.col, s.w, b.{value} as v from {rows} a cross join ({steps}) s(i, j, w) join {rows} b on b.slide_idx = a.slide_idx and b."row" = {_mirror('a."row" + s.i')} and b.col = {_mirror('a.col + s.j')})"""


def _steps(weights) -> str:
    return "values " + ", ".join(f"({i}, {j}, {w!r}::double)" for (i, j), w in weights.items())


def _median_sql(size: int) -> str:
    at = range(-(size // 2), size - size // 2)
    steps = _steps({(i, j): 1.0 for i in at for j in at})
    ways = [stencil_sql("pixels", c, f"st_{c}", steps) for c in "rgb"]
    means = [f"m_{c} as (select {K}, quantile_cont(v, 0.5) as {c} from st_{c} group by 1, 2, 3)" for c in "rgb"]
    return f"/*and*/ {', '.join(ways + means)} select * from m_r join m_g using ({K}) join m_b using ({K})"


for _name, _size in (("px_median", 3), ("px_median_4", 4), ("px_median_9", 9)):

    @query(_name, _median_sql(_size), X)
    def _(spark, d, size=_size):
        rows = pixels(spark, d)
        red, green, blue = (tl.median(rows, size, c) for c in "rgb")
        return red.join(green, C).join(blue, C)


_G = px.gaussian_weights(1.0)


@query("px_gaussian", f"/*and*/ {stencil_sql('pixels', 'r', 'st', _steps({(i, j): a * b for i, a in _G for j, b in _G}))} select {K}, round(sum(w * v), 6) as r from st group by 1, 2, 3", X)
def _(spark, d):
    return _r(px.gaussian(pixels(spark, d).select(*C, F.col("r").cast("double").alias("r")), 1.0, "r"), "r")


def morph_sql(rows: str, how: str, steps: list, out: str) -> str:
    return f"""{out} as (select a.slide_idx, a."row", a.col, {how}(b.mask) as mask from {rows} a cross join (values {', '.join(f'({i}, {j})' for i, j in steps)}) s(i, j) join {rows} b on b.slide_idx = a.slide_idx and b."row" = a."row" + s.i and b.col = a.col + s.j group by 1, 2, 3)"""


@query("mask_close", f"/*and*/ {MG}, {morph_sql('mg', 'bool_or', px.CROSS, 'd1')}, {morph_sql('d1', 'bool_and', px.CROSS, 'd2')} select * from d2", X)
def _(spark, d):
    return px.mask_close(grey(spark, d))


_SQ = [(i, j) for i in range(-2, 2) for j in range(-2, 2)]


@query("mask_close_sized", f"/*and*/ {MG}, {morph_sql('mg', 'bool_or', _SQ, 'd1')}, {morph_sql('d1', 'bool_and', [(-i, -j) for i, j in _SQ], 'd2')} select * from d2", X)
def _(spark, d):
    return px.mask_close_sized(grey(spark, d), level=6, expand=50.0 * 1.28)


HOLES = """hc as (select slide_idx, "row", col, "row" * 100 + col as id from mg where not mask),
 hw as (select slide_idx, id as root, id, "row", col from hc union select w.slide_idx, w.root, c.id, c."row", c.col from hw w join hc c on c.slide_idx = w.slide_idx and c."row" between w."row" - 1 and w."row" + 1 and c.col between w.col - 1 and w.col + 1 and c.id > w.root),
 hm as (select slide_idx, id, min(root) as root from hw group by 1, 2), hs as (select slide_idx, root, count(*) as n from hm group by 1, 2)"""


@query("mask_fill_holes", f"""/*recursive*/ {MG}, {HOLES} select m.slide_idx, m."row", m.col, m.mask or coalesce(n < 250.0 / (64 * 0.25), false) as mask from mg m left join hm on hm.slide_idx = m.slide_idx and hm.id = m."row" * 100 + m.col left join hs on hs.slide_idx = hm.slide_idx and hs.root = hm.root""", X)
def _(spark, d):
    return px.mask_fill_holes(grey(spark, d), level=6)


@query("mask_maxpool", f'/*and*/ {MG} select slide_idx, cast(floor("row" / 4) as int) as "row", cast(floor(col / 4) as int) as col, bool_or(mask) as mask from mg group by 1, 2, 3', X)
def _(spark, d):
    return px.mask_maxpool(grey(spark, d), 4, 6)


@query("mask_chain", f"/*and*/ {MG}, {morph_sql('mg', 'bool_or', px.CROSS, 'd1')}, {morph_sql('d1', 'bool_and', px.CROSS, 'd2')} select slide_idx, cast(floor(\"row\" / 2) as int) as \"row\", cast(floor(col / 2) as int) as col, bool_or(mask) as mask from d2 group by 1, 2, 3", X)
def _(spark, d):
    return grey(spark, d).transform(px.mask_close).transform(lambda m: px.mask_maxpool(m, 5, 6))


#: Worked out apart from the operator: the first two rows of the inverse of the unit stain vectors' matrix.
_HE = {"hematoxylin": (1.4890718525579727, -0.16264789957531617, 0.5124594970989429), "eosin": (-1.0822788021983998, 1.1179258957292455, -0.2920930390364648)}
_HE_SQL = ", ".join(f"cast(floor(least(greatest({' + '.join(f'(-ln(({c} + 1) / 256.0::double)) * 45.985904::double * {w!r}::double' for c, w in zip('rgb', row))}, 0), 255)) as int) as {name}" for name, row in _HE.items())


@query("px_he_deconv", f"select {K}, {_HE_SQL.replace('45.985904', repr(255 / math.log(256)))} from pixels", X)
def _(spark, d):
    return px.he_deconvolution(pixels(spark, d)).drop("r", "g", "b")


_3 = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


@query("px_sobel", f"""/*and*/ {stencil_sql('pixels', 'r', 'sy', _steps({(i, j): i * (2 - abs(j)) / 4.0 for i, j in _3}))}, {stencil_sql('pixels', 'r', 'sx', _steps({(i, j): j * (2 - abs(i)) / 4.0 for i, j in _3}))},
 gy as (select {K}, sum(w * v) as gy from sy group by 1, 2, 3), gx as (select {K}, sum(w * v) as gx from sx group by 1, 2, 3) select {K}, round(sqrt((gx * gx + gy * gy) / 2), 6) as edge from gx join gy using (slide_idx, "row", col)""", X)
def _(spark, d):
    return _r(px.sobel(pixels(spark, d), "r"), "edge")


def _grad(value: str, along: str, out: str, src: str, name: str) -> str:
    other = "col" if along == '"row"' else '"row"'
    w = f"over (partition by slide_idx, {other} order by {along})"
    return f"{name} as (select *, case when lag({value}) {w} is null then lead({value}) {w} - {value} when lead({value}) {w} is null then {value} - lag({value}) {w} else (lead({value}) {w} - lag({value}) {w}) / 2.0::double end as {out} from {src})"


@query("px_hessian_eig", f"""/*and*/ {_grad('r', '"row"', 'gr', 'pixels', 'h1')}, {_grad('r', 'col', 'gc', 'h1', 'h2')}, {_grad('gr', '"row"', 'hrr', 'h2', 'h3')}, {_grad('gr', 'col', 'hrc', 'h3', 'h4')}, {_grad('gc', 'col', 'hcc', 'h4', 'h5')}
 select {K}, round((hrr + hcc) / 2 + sqrt((hrr - hcc) * (hrr - hcc) / 4 + hrc * hrc), 6) as eig1, round((hrr + hcc) / 2 - sqrt((hrr - hcc) * (hrr - hcc) / 4 + hrc * hrc), 6) as eig2 from h5""", X)
def _(spark, d):
    return _r(px.hessian_eigenvalues(pixels(spark, d), "r"), "eig1", "eig2")


def _long_grad(value: str, along: str, out: str, src: str, name: str) -> str:
    return _grad(value, along, out, src, name).replace("partition by slide_idx,", "partition by slide_idx, channel, scale,")


_ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in ("intensity", "edge", "eig1", "eig2"))


def _sobel_pass(value: str, axis: str, weights: tuple[float, float, float], out: str) -> str:
    """Three weights along an axis; beyond the border the border cell counts, as it does when reflected by one step."""
    w = f"over (partition by slide_idx, channel, scale, {'col' if axis == 'row' else chr(34) + 'row' + chr(34)} order by \"{axis}\")"
    return f"{weights[0]}::double * coalesce(lag({value}) {w}, {value}) + {weights[1]}::double * {value} + {weights[2]}::double * coalesce(lead({value}) {w}, {value}) as {out}"


_STACK_SQL = f"""/*and*/ he as (select *, {_HE_SQL.replace('45.985904', repr(255 / math.log(256)))} from pixels),
 ch as (unpivot (select {K}, r / 255.0::double as r, g / 255.0::double as g, b / 255.0::double as b, hematoxylin / 255.0::double as hematoxylin, eosin / 255.0::double as eosin from he) on r, g, b, hematoxylin, eosin into name channel value v),
 kr as (select s.range + 1 as scale, pow(2, s.range) as sigma, k.range as k, exp(-0.5::double * pow(k.range / pow(2, s.range), 2)) as w from range(5) s, range(-64, 65) k where abs(k.range) <= floor(4 * pow(2, s.range) + 0.5) union all select 0, 0, 0, 1),
 kn as (select scale, k, w / sum(w) over (partition by scale) as w from kr),
 sd as (select slide_idx, max("row") as h, max(col) as wd from pixels group by 1),
 b1 as (select a.slide_idx, a."row", a.col, a.channel, scale, sum(w * n.v) as v from ch a join sd using (slide_idx) cross join kn join ch n on n.slide_idx = a.slide_idx and n.channel = a.channel and n.col = a.col and n."row" = greatest(0, least(h, a."row" + k)) group by all),
 b2 as (select a.slide_idx, a."row", a.col, a.channel, a.scale, sum(w * n.v) as v from b1 a join sd using (slide_idx) join kn on kn.scale = a.scale join b1 n on n.slide_idx = a.slide_idx and n.channel = a.channel and n.scale = a.scale and n."row" = a."row" and n.col = greatest(0, least(wd, a.col + k)) group by all),
 e1 as (select *, {_sobel_pass('v', 'col', (0.25, 0.5, 0.25), 'sc')}, {_sobel_pass('v', 'col', (-1, 0, 1), 'dc')} from b2),
 e2 as (select *, {_sobel_pass('sc', 'row', (-1, 0, 1), 'gy')}, {_sobel_pass('dc', 'row', (0.25, 0.5, 0.25), 'gx')} from e1),
 {_long_grad('v', '"row"', 'gr', 'e2', 'h1')}, {_long_grad('v', 'col', 'gc', 'h1', 'h2')}, {_long_grad('gr', '"row"', 'hrr', 'h2', 'h3')}, {_long_grad('gr', 'col', 'hrc', 'h3', 'h4')}, {_long_grad('gc', 'col', 'hcc', 'h4', 'h5')},
 st as (select {K}, channel, cast(scale as int) as scale, v as intensity, sqrt((gx * gx + gy * gy) / 2) as edge, (hrr + hcc) / 2 + sqrt((hrr - hcc) * (hrr - hcc) / 4 + hrc * hrc) as eig1, (hrr + hcc) / 2 - sqrt((hrr - hcc) * (hrr - hcc) / 4 + hrc * hrc) as eig2 from h5)
 select {K}, channel, scale, {_ROUNDED} from st"""


@query("px_feature_stack", _STACK_SQL, X)
def _(spark, d):
    return _r(px.feature_stack(pixels(spark, d), h_e=True, raw=True), "intensity", "edge", "eig1", "eig2")


MT = f"mt as (select {K}, r > 128 as t from pixels)"
_J = f"{MG}, {MT}, j as (select {K}, mask as m, t from mg join mt using (slide_idx, \"row\", col))"


def truth(spark, d) -> DataFrame:
    return pixels(spark, d).select(*C, (F.col("r") > 128).alias("mask"))


@query("mask_confusion", f"""/*and*/ {_J}, n as (select slide_idx, count(*) filter (where m and t) as tp, count(*) filter (where m and not t) as fp, count(*) filter (where not m and t) as fn, count(*) filter (where not m and not t) as tn from j group by 1)
 select *, (tp + tn) / (tp + fp + fn + tn)::double as accuracy, tp / nullif(tp + fn, 0)::double as recall, tp / nullif(tp + fp, 0)::double as precision from n""", X)
def _(spark, d):
    return px.mask_confusion(grey(spark, d), truth(spark, d))


@query("mask_outcome_map", f"/*and*/ {_J} select {K}, case when m and t then 'tp' when m then 'fp' when t then 'fn' else 'tn' end as outcome, case when m and not t then 255 else 0 end as red, case when m and t then 255 else 0 end as green, case when t and not m then 255 else 0 end as blue from j", X)
def _(spark, d):
    return px.mask_outcome_map(grey(spark, d), truth(spark, d))


EM = 'em as (select slide_idx, "row", col, label > 0 as mask from eval_mask)'
BAND = f"""{EM}, ei as (select a.slide_idx, a."row", a.col from (select * from em where mask) a cross join (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(i, j) join (select * from em where mask) b on b.slide_idx = a.slide_idx and b."row" = a."row" + s.i and b.col = a.col + s.j group by 1, 2, 3 having count(*) = 5),
 eb as (select slide_idx, "row", col from em where mask except select * from ei),
 band as (select distinct b.slide_idx, b."row" + i.range - 2 as "row", b.col + j.range - 2 as col from eb b cross join range(5) i cross join range(5) j)"""


def em(spark, d) -> DataFrame:
    return eval_mask(spark, d).select(*C, (F.col("label") > 0).alias("mask"))


@query("mask_edge_band", f'/*and*/ {BAND} select {K} from em where exists (select 1 from band b where b.slide_idx = em.slide_idx and b."row" = em."row" and b.col = em.col)', (EVAL_MASK,))
def _(spark, d):
    return px.edge_band(em(spark, d), 2)


_NEAR = BAND.replace("- 2", "- 1").replace("range(5)", "range(3)").replace("band as", "near as")


@query("edge_patch_sample", f"""/*and*/ {_NEAR} select slide_idx, patch_seq, label from patches join near using (slide_idx, "row", col) join em using (slide_idx, "row", col)
 qualify row_number() over (partition by label order by {draw_sql(23, 'slide_idx', 'patch_seq')}, slide_idx, patch_seq) <= 1000""", (EVAL_MASK, PATCHES))
def _(spark, d):
    near = patches(spark, d).join(px.edge_band(em(spark, d), 1), C, "left_semi")
    return ix.sample_simple(near, 1000, 23).select("slide_idx", "patch_seq", "label")
