"""Queries of nuclei that touch and of cells that keep out of the background, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import by_sort
from ..operators import markers as MK
from ..operators.neighbourhood import gaussian_kernel
from . import inputs as I
from .catalog import query, sql
from .inputs import W


def _twins(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """A plane of two discs that overlap for each supplier, and its height."""
    k = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    height = ((k.agg(F.max("k")).first()[0] or 0) // 3 + 1) * 16
    spot = k.select(F.expr("8 + 16 * (k div 3)").alias("cy"), F.expr("6 + 21 * (k % 3)").alias("cx"), F.expr("4 + k % 2").alias("r"))
    rows = spot.withColumn("y", F.explode(F.expr("sequence(cy - r, cy + r)"))).withColumn("x", F.explode(F.expr("sequence(cx - r, cx + 2 * r + 2)")))
    gap = F.col("y") - F.col("cy")
    inside = rows.where(gap * gap + F.pow(F.col("x") - F.col("cx"), 2) <= F.col("r") * F.col("r")).unionByName(rows.where(gap * gap + F.pow(F.col("x") - F.col("cx") - F.col("r") - 2, 2) <= F.col("r") * F.col("r")))
    grid = spark.range(height).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(W - 1).cast("long"))).alias("x"))
    return grid.join(by_sort(inside.select("y", "x", F.lit(0.9).alias("p")).distinct()), ["y", "x"], "left").select("y", "x", F.coalesce("p", F.lit(0.1)).alias("p")), height


def _smooth_sql() -> str:
    kernel = ", ".join(f"({k}, {w!r}::double)" for k, w in gaussian_kernel(1.0))
    mirror = lambda c, n: f"case when {c} < 0 then -({c}) - 1 when {c} >= {n} then 2 * {n} - 1 - ({c}) else {c} end"
    return f"""s as (select cast(s_suppkey as bigint) as k, 8 + 16 * (s_suppkey // 3) as cy, 6 + 21 * (s_suppkey % 3) as cx, 4 + s_suppkey % 2 as r from supplier), h as (select max(k) // 3 * 16 + 16 as h from s),
g as (select y, x from (select unnest(range(h)) as y from h), range({W}) t(x)),
ins as (select distinct g.y, g.x from g join s on g.y between cy - r and cy + r and g.x between cx - r and cx + 2 * r + 2 where (g.y - cy) ** 2 + (g.x - cx) ** 2 <= r * r or (g.y - cy) ** 2 + (g.x - cx - r - 2) ** 2 <= r * r),
p as (select g.y, g.x, case when ins.y is null then 0.1e0 else 0.9e0 end as p from g left join ins on ins.y = g.y and ins.x = g.x),
ker(o, w) as (values {kernel}),
sy as (select a.y, a.x, sum(p.p * w) as p from (select g.y, g.x, w, {mirror('y + o', 'h')} as m from g, ker, h) a join p on p.y = a.m and p.x = a.x group by 1, 2),
sm as (select a.y, a.x, round(sum(p.p * w), 9) as p from (select g.y, g.x, w, {mirror('x + o', W)} as m from g, ker) a join sy p on p.y = a.y and p.x = a.m group by 1, 2)"""


OFF = "(values (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(a, b)"
SEEDS = f"""with recursive {_smooth_sql()}, m0 as (select y, x from sm where p >= 0.35e0),
e as (select y + a as y, x + b as x from m0, {OFF} group by 1, 2 having count(*) = 5), o as (select distinct y + a as y, x + b as x from e, {OFF}),
c as (select distinct y + a as y, x + b as x from o, {OFF}), m as (select y + a as y, x + b as x from c, {OFF} group by 1, 2 having count(*) = 5),
out_ as (select y, x from g anti join m using (y, x)),
d as (select m.y, m.x, min((m.y - q.y) ** 2 + (m.x - q.x) ** 2)::bigint as d2 from m join out_ q on q.y between m.y - 9 and m.y + 9 and abs(q.x - m.x) <= 9 group by 1, 2),
u as (select * from d where sqrt(d2) >= (select quantile_cont(sqrt(d2), 0.7e0) from d)),
t as (select a.y, a.x, a.d2, a.y // 16 as cy, a.x // 21 as cx from u a join u b on b.y between a.y - 3 and a.y + 3 and abs(b.x - a.x) <= 3 group by 1, 2, 3 having a.d2 = max(b.d2)),
r as (select *, row_number() over (partition by cy, cx order by d2 desc, y, x) as k from t),
w as (select cy, cx, cast(0 as bigint) as k, cast([] as struct(y bigint, x bigint)[]) as kept, cast(null as bigint) as y, cast(null as bigint) as x, cast(null as bigint) as d2, false as taken from (select distinct cy, cx from r)
union all select r.cy, r.cx, r.k, case when t.near = 0 then list_append(w.kept, {{'y': r.y, 'x': r.x}}) else w.kept end, r.y, r.x, r.d2, t.near = 0 from w join r on r.cy = w.cy and r.cx = w.cx and r.k = w.k + 1, lateral (select count(*) as near from (select unnest(w.kept) as s) where abs(s.y - r.y) <= 3 and abs(s.x - r.x) <= 3) t)
select y, x, d2 from w where taken"""


@query(SEEDS)
def nucleus_seeds(spark, d):
    """Seeds of discs that overlap in pairs: peaks of the depth of the smoothed mask, above the depth of 70 % of it."""
    plane, height = _twins(spark, d)
    mask = MK.nucleus_mask(MK.smoothed(plane, "p", 1.0, height, W), height, W, 0.35, 30)
    return MK.seeds(MK.upper(MK.depths(mask, height, W), 0.7), height, W)


@query()
def nuclei_touching(spark, d):
    """The pixels of both discs of each pair, as nuclei of their own."""
    plane, height = _twins(spark, d)
    return MK.nucleus_markers(plane, height, W)


@query(sql(""", g as (select y, x from (select unnest(range(hd)) as y from hd), range(64) t(x) where y % 12 <> 0 and x % 13 <> 12),
n as (select distinct g.y, g.x from g join discs d on d.y between g.y - 3 and g.y + 3 and (d.y - g.y) ** 2 + (d.x - g.x) ** 2 <= 9)
select c + 1 as label, count(*) as area from (select y // 12 * 5 + x // 13 as c from n) join k on k.k = c group by 1""", "discs", "hd"))
def cells_kept_apart(spark, d):
    """Areas of cells that grow three pixels from their discs, between lines of background."""
    line = (F.col("y") % 12 == 0) | (F.col("x") % 13 == 12)
    probs = I.disc_plane(spark, d).select("y", "x", F.when(F.col("v") > 1000, F.lit(0.9)).otherwise(F.lit(0.5)).alias("p"), F.when(line, F.lit(0.8)).otherwise(F.lit(0.1)).alias("background"))
    found = MK.cells(I.discs(spark, d).select("y", "x", "label"), probs, I.disc_height(spark, d), W, reach=3, least=20)
    # Labels are dense in the order of the discs; the least key is the first.
    first = I.table(spark, d, "supplier").agg(F.min("s_suppkey").alias("k0"))  # one row
    return found.groupBy("label").agg(F.count("*").alias("area")).crossJoin(F.broadcast(first)).select((F.col("label") + F.col("k0")).alias("label"), "area")
