"""Queries over contours of masks. Their SQL walks the cells' sides one by one, asks each region for the outer rings
around it, and rebuilds the mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.operators import contours as ct
from slidegrid.plans.fixtures import PATCHES
from slidegrid.plans.region_queries import HEAT, R, cells_at, comps_sql
from slidegrid.plans.registry import query

#: Pixels of a cell.
SCALE = 256
#: A side is (row, col, direction) of a cell with nothing beyond it; w walks from each side to those after it, never below its first.
RINGS = f"""{comps_sql('value >= 0.5')},
 dirs(d, fr, fc, sr, sc, cx, cy) as (values (0, 0, 1, -1, 0, 0, 0), (1, 1, 0, 0, 1, 1, 0), (2, 0, -1, 1, 0, 1, 1), (3, -1, 0, 0, -1, 0, 1)),
 sides as materialized (select c.slide_idx, c.comp, c."row", c.col, d, c.col + cx as x, c."row" + cy as y, (c."row" * 1024 + c.col) * 4 + d as id,
   case when l.comp is not null then ((c."row" + fr + sr) * 1024 + c.col + fc + sc) * 4 + (d + 3) % 4 when a.comp is not null then ((c."row" + fr) * 1024 + c.col + fc) * 4 + d else (c."row" * 1024 + c.col) * 4 + (d + 1) % 4 end as nx
   from comps c cross join dirs left join comps b on b.slide_idx = c.slide_idx and b."row" = c."row" + sr and b.col = c.col + sc
   left join comps a on a.slide_idx = c.slide_idx and a."row" = c."row" + fr and a.col = c.col + fc
   left join comps l on l.slide_idx = c.slide_idx and l."row" = c."row" + fr + sr and l.col = c.col + fc + sc where b.comp is null),
 w as (select slide_idx, id as root, nx as id, 1 as k from sides union all select w.slide_idx, w.root, s.nx, w.k + 1 from w join sides s using (slide_idx, id) where w.id > w.root),
 heads as (select slide_idx, root, k as n from w where id = root),
 ring as (select h.slide_idx, h.root, h.n, 0 as k, h.root as id from heads h union all select w.slide_idx, w.root, h.n, w.k, w.id from w join heads h using (slide_idx, root) where w.k < h.n),
 pts as (select r.slide_idx, r.root, s.comp, r.n, k, x, y, s.d, lag(s.d, 1, null) over o as d1, last_value(s.d) over (partition by r.slide_idx, r.root order by k rows between unbounded preceding and unbounded following) as dz, s."row" from ring r join sides s using (slide_idx, id) window o as (partition by r.slide_idx, r.root order by k)),
 begins as (select slide_idx, root, arg_min(k, y * 1024 + x) as k0, sum(case d when 1 then x when 3 then -x else 0 end) as area from pts group by 1, 2),
 lines as (select p.slide_idx, p.root, any_value(p.comp) as comp, any_value(area) as area, count(*) as n, list([x * {SCALE}, y * {SCALE}] order by (k - k0 + p.n) % p.n) as l, min(y * 1024 + x) as first
   from pts p join begins b using (slide_idx, root) where d <> coalesce(d1, dz) group by 1, 2),
 outs as (select slide_idx, comp, first // 1024 as "row", first % 1024 as x from lines where area > 0),
 around as (select o.slide_idx, o.comp, b.comp as other from outs o join begins g on g.slide_idx = o.slide_idx and g.area > 0 join pts b on b.slide_idx = g.slide_idx and b.root = g.root and b.d in (1, 3) and b."row" = o."row" and b.x <= o.x and b.comp <> o.comp group by all having count(*) % 2 = 1),
 deep as (select o.slide_idx, o.comp, count(other) as depth from outs o left join around using (slide_idx, comp) group by 1, 2),
 up as (select a.slide_idx, a.comp, arg_max(a.other, d.depth) as parent from around a join deep d on d.slide_idx = a.slide_idx and d.comp = a.other group by 1, 2),
 text as (select slide_idx, comp, cast(sum(area) as bigint) as area, count(*) - 1 as n_holes, cast(sum(n) as bigint) as n_points,
   '[' || string_agg('[' || list_aggregate(list_transform(l, lambda p: '[' || p[1] || ',' || p[2] || ']'), 'string_agg', ',') || ']', ',' order by area < 0, first, l) || ']' as contour from lines group by 1, 2)"""
SQL = f"{R}{RINGS} select slide_idx, comp, parent, depth, area, n_holes, n_points, contour from text join deep using (slide_idx, comp) left join up using (slide_idx, comp)"


def _contours(spark, d) -> DataFrame:
    return ct.contours(cells_at(spark, d, 0.5).select("slide_idx", "row", "col", F.lit(True).alias("mask")))


@query("mask_boundary_json", SQL, (PATCHES, HEAT))
def _(spark, d):
    points = F.size("outer") + F.aggregate("holes", F.lit(0), lambda n, h: n + F.size(h))
    return _contours(spark, d).select("slide_idx", "comp", "parent", "depth", "area", F.size("holes").alias("n_holes"), points.alias("n_points"), F.to_json(ct.polygon(SCALE)).alias("contour"))


_JSON = """'{{"tumor":[' || string_agg(contour, ',' order by {order}comp) || ']}}'"""

for _name, _two, _order in (("mask_contours_tree", False, "case when depth > 0 then 1 when n_holes > 0 then 2 else 0 end, "), ("mask_contours_two_levels", True, "")):

    @query(_name, f"{R}{RINGS} select slide_idx, {_JSON.format(order=_order)} as json from text join deep using (slide_idx, comp) group by 1", (PATCHES, HEAT))
    def _(spark, d, two=_two):
        return ct.regions_json(_contours(spark, d), "tumor", SCALE, two)


@query("mask_contour_fill", f'{R}{comps_sql("value >= 0.5")} select slide_idx, "row", col, comp from comps', (PATCHES, HEAT))
def _(spark, d):
    return ct.filled(_contours(spark, d))
