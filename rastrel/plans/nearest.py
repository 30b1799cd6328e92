"""Queries of nearest sources and spaced peaks, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nearest as NE
from ..operators import neighbourhood as N
from . import inputs as I
from .catalog import query, sql
from .inputs import H, W


@query(sql(f", top as (select y, x from px where v > (select quantile_cont(v, 0.95e0) from px)), n as (select g.y, h.x, f.y as sy, f.x as sx, row_number() over (partition by g.y, h.x order by (g.y - f.y) * (g.y - f.y) + (h.x - f.x) * (h.x - f.x), f.y, f.x) as k from range(48) g(y) cross join range(64) h(x) cross join top f) select y, x, (y - sy) * (y - sy) + (x - sx) * (x - sx) as d2, sy, sx from n where k = 1", "px"))
def nearest_source(spark, d):
    """The nearest of the brightest pixels, for every pixel."""
    px = I.px(spark, d)
    limit = px.agg(F.percentile("v", F.lit(0.95)).alias("limit"))  # one row
    return NE.nearest_source(px.crossJoin(F.broadcast(limit)).where("v > limit"), H, W)


@query(sql(", s as (select label, label % 7 - 3e0 as dy, label % 5 - 2e0 as dx from cells group by label having count(*) >= 15), f as (select c.y, c.x, dy, dx from cells c join s on s.label = c.label), n as (select g.y, h.x, f.dy, f.dx, row_number() over (partition by g.y, h.x order by (g.y - f.y) * (g.y - f.y) + (h.x - f.x) * (h.x - f.x), f.y, f.x) as k from range(48) g(y) cross join range(64) h(x) cross join f) select y, x, dy, dx from n where k = 1", "cells"))
def dense_field(spark, d):
    """Every pixel takes the shift of its region or of the nearest one that has a shift: regions of 15 pixels have."""
    cells = I.cells(spark, d)
    label = F.col("label")
    shifts = cells.groupBy("label").agg(F.count("*").alias("n")).where("n >= 15").select("label", (label % 7 - 3).cast("double").alias("dy"), (label % 5 - 2).cast("double").alias("dx"))
    return NE.dense_field(cells, shifts, H, W)


@query(sql(""", r as (select y, x, v, row_number() over (order by v desc, y, x) as k from (select p.y, p.x, p.v from px p join px q on abs(p.y - q.y) <= 1 and abs(p.x - q.x) <= 1 group by 1, 2, 3 having p.v = max(q.v))),
g as (select cast(0 as bigint) as k, cast([] as struct(y bigint, x bigint)[]) as kept, cast(null as bigint) as y, cast(null as bigint) as x, cast(null as bigint) as v, false as taken
union all select r.k, case when t.near = 0 then list_append(g.kept, {'y': r.y, 'x': r.x}) else g.kept end, r.y, r.x, r.v, t.near = 0 from g join r on r.k = g.k + 1, lateral (select count(*) as near from (select unnest(g.kept) as s) where abs(s.y - r.y) <= 4 and abs(s.x - r.x) <= 4) t)
select y, x, v from g where taken""", "px", recursive=True))
def spaced_peaks(spark, d):
    """Local peaks of which greedy choice keeps those that are five rows or columns apart."""
    return NE.spaced_peaks(N.local_peaks(I.px(spark, d), 1, H, W), 4)
