"""The registered queries of the raster operators, each with SQL where it can be expressed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.joins import by_sort
from ..operators import aggregates as A
from ..operators import edits as E
from ..operators import geometry as G
from ..operators import graph as GR
from ..operators import learning as L
from ..operators import metadata as M
from ..operators import mosaic as MO
from ..operators import neighbourhood as N
from ..operators import registration as R
from ..operators import segmentation as SEG
from ..streaming import progress as P
from . import inputs as I
from .inputs import H, W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Derived tables as SQL.
CTES = {
    "px": "select cast(l_orderkey % 48 as bigint) as y, cast(l_partkey % 64 as bigint) as x, cast(sum(cast(l_quantity as bigint)) * 37 % 65536 as bigint) as v from lineitem group by 1, 2",
    "px2": "select l_linestatus as cycle, l_returnflag as channel, cast(l_orderkey % 48 as bigint) as y, cast(l_partkey % 64 as bigint) as x, cast(sum(cast(l_quantity as bigint)) * 37 % 65536 as bigint) as v from lineitem group by 1, 2, 3, 4",
    "fg": "select y, x, v from px where v > (select quantile_cont(v, 0.7e0) from px)",
    "cells": "select y, x, (y // 8) * 8 + x // 8 + 1 as label from fg",
    "k": "select cast(s_suppkey as bigint) as k, 6 + 12 * (s_suppkey // 5) as cy, 6 + 13 * (s_suppkey % 5) as cx, 3 + s_suppkey % 3 as r from supplier",
    "hd": "select max(k) // 5 * 12 + 12 as hd from k",
    "discs": "select y, x, min(k) + 1 as label, min(k) * 100 + 20000 as v from (select k, cy, cx, r, y, unnest(range(cx - r, cx + r + 1)) as x from (select *, unnest(range(cy - r, cy + r + 1)) as y from k)) where (y - cy) * (y - cy) + (x - cx) * (x - cx) <= r * r group by 1, 2",
    "e0": "select o_custkey % 6 as gx, o_orderkey % 5 as gy, o_orderkey % 2 as ax, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as s from orders group by 1, 2, 3",
    "edges": "select case when ax = 0 then 'x' else 'y' end as axis, gy * 6 + gx as src, gy * 6 + gx + case when ax = 0 then 1 else 6 end as dst, cast(case when ax = 0 then s % 7 - 3 else 90 + s % 9 end as double) as dy, cast(case when ax = 0 then 90 + s % 9 else s % 5 - 2 end as double) as dx, cast(s % 40 as double) as overlap, 1e0 - (s % 16) / 1e2 as score, s % 11 = 0 as fallback, s % 7 = 0 as unmasked, s % 1000 as fg_px, (s % 100) / 1e2 as fg_frac from e0 where (ax = 0 and gx < 5) or (ax = 1 and gy < 4)",
    "we": "select *, greatest(overlap, 1e0) * (0.25e0 + 0.75e0 * greatest(least((score + 1e0) / 2e0, 1e0), 0e0)) * case when score < -0.5e0 then 0.1e0 else 1e0 end * case when unmasked then 0.85e0 else 1e0 end * case when fallback then 0.05e0 else 1e0 end as w from edges",
    "links": "select src, dst, dy, dx, w from we union all select dst, src, -dy, -dx, w from we",
    "et": "select tile, island, y0, x0, y0 + 5e0 as cy, x0 + 5e0 as cx, cast(c % 41 - 20 as double) as dy, cast(c % 31 - 15 as double) as dx, (c % 50) / 1e2 as gain, case when c % 4 = 0 then 'accepted' when c % 4 = 1 then 'stable_zero' else 'borrowed' end as state from (select cast(s_suppkey as bigint) as tile, cast(s_nationkey % 3 as bigint) as island, cast(s_suppkey // 10 * 10 as bigint) as y0, cast(s_suppkey % 10 * 10 as bigint) as x0, cast(floor(abs(s_acctbal) * 100) as bigint) as c from supplier)",
    "seeds": "select tile as st, island, cy as sy, cx as sx, case when state = 'accepted' then dy else 0e0 end as sdy, case when state = 'accepted' then dx else 0e0 end as sdx, gain, state from et where state in ('accepted', 'stable_zero')",
}
#: What each derived table is made from.
NEEDS = {"fg": ["px"], "cells": ["px", "fg"], "discs": ["k"], "hd": ["k"], "edges": ["e0"], "we": ["e0", "edges"], "links": ["e0", "edges", "we"], "seeds": ["et"]}


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    need = list(dict.fromkeys(n for c in ctes for n in [*NEEDS.get(c, []), c]))
    more = body.startswith(",")
    head = ("with recursive " if recursive else "with ") + ", ".join(f"{n} as ({CTES[n]})" for n in need) if need else ""
    return head + (body if more else " " + body)


def query(oracle: str | None = None):
    """Register a query under its function's name; integers are widened, so that both engines agree on types."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# ---------------------------------------------------------------- scans and geometry


@query(sql("select y, x, v from px2 where channel = 'A' and cycle = 'F'", "px2"))
def channel_read(spark, d):
    return I.px2(spark, d).where("channel = 'A' and cycle = 'F'").select("y", "x", "v")


@query(sql("select y, x, v from px where y >= 10 and y < 20", "px"))
def strip_read(spark, d):
    return I.px(spark, d).where("y >= 10 and y < 20")


@query(sql("select g.y, h.x, coalesce(v, 0) as v from range(-4, 12) g(y) cross join range(50, 70) h(x) left join px on px.y = g.y and px.x = h.x", "px"))
def roi_read_padded(spark, d):
    return G.roi(I.px(spark, d), -4, 12, 50, 70)


GRID = "select y0 // 20 as tile_y, x0 // 20 as tile_x, y0, x0, least(20, 48 - y0) as h, least(20, 64 - x0) as w from range(0, 48, 20) a(y0), range(0, 64, 20) b(x0)"


@query(GRID)
def tile_grid(spark, d):
    return G.tile_grid(spark, H, W, 20)


@query(sql("select ty as tile_y, tx as tile_x, count(*) as n, cast(sum(v) as bigint) as total from px, range(6) a(ty), range(8) b(tx) where y between ty * 8 and ty * 8 + 15 and x between tx * 8 and tx * 8 + 15 group by 1, 2", "px"))
def overlap_lattice(spark, d):
    return G.on_lattice(I.px(spark, d), 16, 8).groupBy("tile_y", "tile_x").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"select y0, x0, (y0 + h / 2e0 - 20e0) ** 2 + (x0 + w / 2e0 - 30e0) ** 2 as d2, row_number() over (order by d2, y0, x0) as rank from ({GRID})")
def tiles_by_focus(spark, d):
    from pyspark.sql import Window

    # one row for each tile of one image
    return G.tiles_by_focus(G.tile_grid(spark, H, W, 20), 20.0, 30.0).select("y0", "x0", "d2", F.row_number().over(Window.orderBy("d2", "y0", "x0")).alias("rank"))


HALF = "select y // 2 as y, x // 2 as x, cast(round_even(avg(v), 0) as bigint) as v from {} group by 1, 2"


@query(sql(HALF.format("px"), "px"))
def pyramid_level1(spark, d):
    return G.block_mean(I.px(spark, d))


@query(sql(HALF.format("(" + HALF.format("px") + ")"), "px"))
def pyramid_level2(spark, d):
    return G.block_mean(G.block_mean(I.px(spark, d)))


@query(sql("select y // 5 as y, x // 5 as x, round(avg(v), 6) as mean from px where y < 45 and x < 60 group by 1, 2", "px"))
def block_mean_trim(spark, d):
    return G.block_mean_trimmed(I.px(spark, d), 5, H, W).withColumn("mean", F.round("mean", 6))


@query(sql("select y // 10 as y, x // 10 as x, cast(sum(v) as bigint) as total from px group by 1, 2", "px"))
def block_sum_pad(spark, d):
    return G.block_sum(I.px(spark, d), 10)


@query(sql("select y + 6 as y, x - 2 as x, v from px where x - 2 between 0 and 59", "px"))
def pad_to_canvas(spark, d):
    return G.to_canvas(I.px(spark, d), H, W, 60, 60)


@query(sql("select y + 3 as y, x - 5 as x, v from px where y + 3 < 48 and x - 5 >= 0", "px"))
def shift_int(spark, d):
    return G.shift(I.px(spark, d), 3, -5, H, W)


@query(sql("select y + 1 + a as y, x - 1 + b as x, round(sum(v * 0.5e0 * case when b = 1 then 0.75e0 else 0.25e0 end), 6) as v from px, range(2) p(a), range(2) q(b) where y + 1 + a between 0 and 47 and x - 1 + b between 0 and 63 group by 1, 2", "px"))
def shift_bilinear(spark, d):
    return G.shift_bilinear(I.px(spark, d), 1.5, -0.25, H, W).withColumn("v", F.round("v", 6))


@query(sql("select greatest(min(y) - 2, 0) as y0, least(max(y) + 3, (select hd from hd)) as y1, greatest(min(x) - 2, 0) as x0, least(max(x) + 3, 64) as x1 from discs", "discs", "hd"))
def bbox_mask(spark, d):
    return G.bounding_box(I.discs(spark, d), I.disc_height(spark, d), W, 2)


FIELD = "select y, x, case when n_nationkey is null then 1.5e0 else (n_nationkey * 7) % 11 - 5e0 end as dy, case when n_nationkey is null then -2e0 else (n_nationkey * 5) % 9 - 4e0 end as dx from (select y, x, (y // 8) * 8 + x // 8 as label from px) t left join nation on n_nationkey = label"


def _field(spark, d):
    labels = I.px(spark, d).select("y", "x", F.expr("(y div 8) * 8 + x div 8").alias("label"))
    key = F.col("n_nationkey").cast("long")
    regions = I.table(spark, d, "nation").select(key.alias("label"), (key * 7 % 11 - 5.0).alias("shift_y"), (key * 5 % 9 - 4.0).alias("shift_x"))
    return G.piecewise_field(labels, regions, 1.5, -2.0)


@query(sql(FIELD, "px"))
def piecewise_field(spark, d):
    return _field(spark, d)


@query(sql(f"select y // 8 as strip, cast(greatest(floor(min(y - dy)) - 4, 0) as bigint) as row0, cast(least(ceil(max(y - dy)) + 5, 48) as bigint) as row1 from ({FIELD}) group by 1", "px"))
def source_row_bounds(spark, d):
    return G.source_rows(_field(spark, d), 8, H)


@query(sql("select y * 3 + 2 + a as y, x * 3 - 4 + b as x, label from cells, range(3) p(a), range(3) q(b) where y * 3 + 2 + a between 0 and 47 and x * 3 - 4 + b between 0 and 63", "cells"))
def upsample_labels(spark, d):
    return G.upsample(I.cells(spark, d), 3, 2, -4, H, W)


# ---------------------------------------------------------------- scalar functions

LIMITS = "(select quantile_cont(v, {}e0) as lo, quantile_cont(v, {}e0) as hi from px)"


@query(sql(f"select y, x, round((greatest(least(v, hi), lo) - lo) / (hi - lo), 6) as n from px, {LIMITS.format(0.01, 0.99)}", "px"))
def normalize_p1_p99(spark, d):
    return A.with_limits(I.px(spark, d), 0.01, 0.99).select("y", "x", F.round(S.rescale(F.col("v"), F.col("lo"), F.col("hi")), 6).alias("n"))


@query(sql(f"select y, x, round(greatest(least((v - lo) / (hi - lo + 1e-6), 1e0), 0e0), 6) as n from px, {LIMITS.format(0.005, 0.995)}", "px"))
def normalize_tile(spark, d):
    return A.with_limits(I.px(spark, d), 0.005, 0.995).select("y", "x", F.round(S.rescale_soft(F.col("v"), F.col("lo"), F.col("hi")), 6).alias("n"))


@query(sql("select y, x, cast(round_even(greatest(least(v / 2e0 - 3000, 65535e0), 0e0), 0) as bigint) as v16, cast(round_even(greatest(least(v / 2e0 - 3000, 255e0), 0e0), 0) as bigint) as v8 from px", "px"))
def cast_clamp(spark, d):
    v = F.col("v") / 2.0 - 3000
    return I.px(spark, d).select("y", "x", S.to_pixel(v, 16).alias("v16"), S.to_pixel(v, 8).alias("v8"))


@query(sql(f"select y, x, cast(floor((greatest(least(v, hi), lo) - lo) / (hi - lo) * 255e0) as bigint) as u from px, {LIMITS.format(0.01, 0.995)}", "px"))
def stretch_u8(spark, d):
    return A.with_limits(I.px(spark, d), 0.01, 0.995).select("y", "x", S.stretch_u8(F.col("v"), F.col("lo"), F.col("hi")).alias("u"))


@query("select y, x, case when y >= 5 and x < 35 then least(y + 1, 32 - y) * least(x + 1, 40 - x) else 0 end as w from range(32) a(y), range(40) b(x)")
def tent_weights(spark, d):
    grid = G.tile_grid(spark, 32, 40, 1).select(F.col("y0").cast("long").alias("y"), F.col("x0").cast("long").alias("x"))
    return grid.select("y", "x", S.tent_weight(F.col("y"), F.col("x"), F.lit(32), F.lit(40), 5, (True, False, False, True)).alias("w"))


@query(sql("select y, x, round(h + r, 6) as e1, round(h - r, 6) as e2 from (select y, x, (v + y) / 2e0 as h, sqrt((v - y) * (v - y) / 4e0 + x * x) as r from px)", "px"))
def eig2x2(spark, d):
    big, small = S.symmetric_eigenvalues(F.col("v").cast("double"), F.col("x").cast("double"), F.col("y").cast("double"))
    return I.px(spark, d).select("y", "x", F.round(big, 6).alias("e1"), F.round(small, 6).alias("e2"))


@query("select p_partkey, round(p_retailprice * case p_size % 4 when 0 then 1e3 when 1 then 1e-3 when 2 then 1e0 end, 6) as um from part")
def unit_convert(spark, d):
    unit = F.get(F.array(*map(F.lit, [" Millimeter", "nm", "µm", "furlong"])), (F.col("p_size") % 4).cast("int"))
    return I.table(spark, d, "part").select("p_partkey", F.round(S.to_micrometres(F.col("p_retailprice"), unit), 6).alias("um"))


@query("select i, case when i < 26 then chr(cast(97 + i as int)) when i < 702 then chr(cast(96 + i // 26 as int)) || chr(cast(97 + i % 26 as int)) else chr(cast(97 + (i - 702) // 676 as int)) || chr(cast(97 + (i - 702) // 26 % 26 as int)) || chr(cast(97 + (i - 702) % 26 as int)) end as suffix from range(800) t(i)")
def letter_suffix(spark, d):
    return spark.range(800).select(F.col("id").alias("i"), S.letter_suffix(F.col("id")).alias("suffix"))


@query(sql("select src, dst, round(w, 9) as w from we", "we"))
def edge_weights(spark, d):
    return _weighted(spark, d).select("src", "dst", F.round("w", 9).alias("w"))


def _weighted(spark, d):
    return I.edges(spark, d).withColumn("w", S.edge_weight(F.col("overlap"), F.col("score"), F.col("unmasked"), F.col("fallback")))


@query("select p_partkey, ['DAPI'] || list_slice(t, greatest(len(t) - 2, 1), len(t)) || list_transform(range(greatest(3 - len(t), 0)), lambda i: '') as markers from (select p_partkey, list_filter(string_split('C' || p_size || '_' || replace(p_type, ' ', '_'), '_'), lambda z: z <> '') as t from part)")
def marker_names(spark, d):
    folder = F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("_"), F.replace(F.col("p_type"), F.lit(" "), F.lit("_")))
    return I.table(spark, d, "part").select("p_partkey", S.folder_markers(folder, 4).alias("markers"))


@query("select p_partkey, case when lower(p_brand) = lower(m) then 0 when contains(lower(p_brand), lower(m)) then 0 when lower(p_type) = lower(m) then 1 when contains(lower(p_type), lower(m)) then 1 end as place from (select *, substr(p_type, 1, 3) as m from part)")
def channel_lookup(spark, d):
    names = F.array("p_brand", "p_type")
    return I.table(spark, d, "part").select("p_partkey", S.find_channel(names, F.substring("p_type", 1, 3)).alias("place"))


# ---------------------------------------------------------------- aggregates


@query(sql("select cycle, channel, round(quantile_cont(v, 0.01e0), 6) as p1, round(quantile_cont(v, 0.5e0), 6) as p50, round(quantile_cont(v, 0.75e0), 6) as p75, round(quantile_cont(v, 0.99e0), 6) as p99 from px2 group by 1, 2", "px2"))
def percentiles(spark, d):
    return I.px2(spark, d).groupBy("cycle", "channel").agg(*[F.round(F.percentile("v", F.lit(p)), 6).alias(n) for n, p in (("p1", 0.01), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99))])


@query(sql(""", s as (select min(v) as lo, max(v) as hi from px), hist as (select least(cast(floor((v - lo) / ((hi - lo) / 256e0)) as bigint), 255) as bin, lo, hi, count(*) as n from px, s group by all),
c as (select bin, n, lo + (bin + 0.5e0) * ((hi - lo) / 256e0) as centre from hist),
a as (select bin, centre, cast(sum(n) over u as double) as w0, sum(n * centre) over u as s0, cast(sum(n) over () as double) as w, sum(n * centre) over () as s from c window u as (order by bin rows unbounded preceding))
select bin, round(centre, 6) as threshold from a where w > w0 order by round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) ** 2, 3) desc, bin limit 1""", "px"))
def otsu_threshold(spark, d):
    return A.otsu(I.px(spark, d)).withColumn("threshold", F.round("threshold", 6))


@query(sql("select y // 16 as ty, x // 16 as tx, round(avg(case when v > 20000 then 1e0 else 0e0 end), 9) as frac from px group by 1, 2", "px"))
def fg_fraction_by_tile(spark, d):
    return I.px(spark, d).groupBy(F.expr("y div 16").alias("ty"), F.expr("x div 16").alias("tx")).agg(F.round(F.avg((F.col("v") > 20000).cast("double")), 9).alias("frac"))


@query(sql("select cy, cx, frac from (select p.y // 4 as cy, p.x // 4 as cx, round(avg(case when f.v is null then 0e0 else 1e0 end), 9) as frac from px p left join fg f on p.y = f.y and p.x = f.x group by 1, 2) where frac > 0.005e0", "fg"))
def active_cells(spark, d):
    limit = I.px(spark, d).agg(F.percentile("v", F.lit(0.7)).alias("limit"))
    rows = I.px(spark, d).crossJoin(F.broadcast(limit))  # one row
    return rows.groupBy(F.expr("y div 4").alias("cy"), F.expr("x div 4").alias("cx")).agg(F.round(F.avg((F.col("v") > F.col("limit")).cast("double")), 9).alias("frac")).where("frac > 0.005")


PAIRS = "(select f.y, f.x, f.v as a, g.v as b from px2 f join px2 g on f.y = g.y and f.x = g.x where f.cycle = 'F' and f.channel = 'A' and g.cycle = 'O' and g.channel = 'N')"
CORR = "case when n >= {} and vx > 1e-8 and vy > 1e-8 then (sxy - sx * sy / n) / sqrt(vx * vy) else -1e0 end"
SUMS = "cast(count(*) as double) as n, cast(sum(a) as double) as sx, cast(sum(b) as double) as sy, cast(sum(a * a) as double) as sxx, cast(sum(b * b) as double) as syy, cast(sum(a * b) as double) as sxy, sxx - sx * sx / n as vx, syy - sy * sy / n as vy"


def _pairs(spark, d):
    p = I.px2(spark, d)
    a = p.where("cycle = 'F' and channel = 'A'").select("y", "x", F.col("v").alias("a"))
    return a.join(p.where("cycle = 'O' and channel = 'N'").select("y", "x", F.col("v").alias("b")), ["y", "x"])


@query(sql(f"select cast(n as bigint) as n, cast(sxy as bigint) as sxy, round({CORR.format(32)}, 9) as corr from (select {SUMS} from {PAIRS})", "px2"))
def ncc_moments(spark, d):
    return A.correlation(_pairs(spark, d), [], 32).select("n", "sxy", F.round("corr", 9).alias("corr"))


@query(sql(f"select ty, tx, cast(n as bigint) as n, round({CORR.format(32)}, 9) as corr from (select y // 16 as ty, x // 16 as tx, {SUMS} from {PAIRS} group by 1, 2)", "px2"))
def ncc_by_tile(spark, d):
    return A.correlation(_pairs(spark, d), [F.expr("y div 16").alias("ty"), F.expr("x div 16").alias("tx")], 32).select("ty", "tx", "n", F.round("corr", 9).alias("corr"))


@query(sql(f"select count(*) filter (a > 2000 and b > 2000) as fg_px, round(avg(case when a > 2000 and b > 2000 then 1e0 else 0e0 end), 9) as fg_frac from {PAIRS}", "px2"))
def fg_overlap(spark, d):
    both = (F.col("a") > 2000) & (F.col("b") > 2000)
    return _pairs(spark, d).agg(F.count_if(both).alias("fg_px"), F.round(F.avg(both.cast("double")), 9).alias("fg_frac"))


@query(sql(f"select dy, dx, cast(n as bigint) as n, round({CORR.format(32)}, 9) as corr from (select dy, dx, {SUMS} from (select u.dy, t.dx, f.v as a, g.v as b from px f, px g, range(-2, 3) u(dy), range(-2, 3) t(dx) where f.y = g.y + u.dy and f.x = g.x + t.dx) group by 1, 2)", "px"))
def shift_grid_search(spark, d):
    p = I.px(spark, d)
    return A.best_shift(p, p, 2, 32, H, W).select("dy", "dx", "n", F.round("corr", 9).alias("corr"))


@query(sql("select y // 4 as y, x // 4 as x, round(sum(v * w) / sum(w), 6) as v from (select y, x, v, least(y % 8 + 1, 8 - y % 8) * least(x % 8 + 1, 8 - x % 8) as w from px) group by 1, 2", "px"))
def weighted_field_mean(spark, d):
    w = S.tent(F.col("y") % 8, F.lit(8)) * S.tent(F.col("x") % 8, F.lit(8))
    rows = I.px(spark, d).select(F.expr("y div 4").alias("y2"), F.expr("x div 4").alias("x2"), "v", w.alias("w"))
    return A.weighted_mean(rows, ["y2", "x2"], ["v"], "w").select(F.col("y2").alias("y"), F.col("x2").alias("x"), F.round("v", 6).alias("v"))


@query(sql("select label, count(*) as area from cells group by 1", "cells"))
def label_areas(spark, d):
    return I.cells(spark, d).groupBy("label").agg(F.count("*").alias("area"))


@query(sql("select cy, label, n from (select y // 16 as cy, label, count(*) as n, row_number() over (partition by y // 16 order by count(*) desc, label) as k from cells group by 1, 2) where k = 1", "cells"))
def label_mode(spark, d):
    return A.mode(I.cells(spark, d).select(F.expr("y div 16").alias("cy"), "label"), ["cy"], "label")


@query(sql("select cycle, channel, count(*) as n, case when max(v) = 0 then 'all_zero' when max(v) - min(v) <= 1 then 'constant' else 'ok' end as state, max(v) <> 0 and min(v) <> max(v) as written from px2 group by 1, 2", "px2"))
def written_data(spark, d):
    return A.plane_health(I.px2(spark, d), ["cycle", "channel"]).select("cycle", "channel", "n", "state", "written")


@query(sql("select label, channel, count(*) as area, cast(sum(p.v) as bigint) as total, round(avg(p.v), 6) as mean, min(p.v) as low, max(p.v) as high, round(avg(p.y), 6) as cy, round(avg(p.x), 6) as cx, min(p.y) as y0, max(p.y) as y1, min(p.x) as x0, max(p.x) as x1 from discs d join px2 p on p.y = d.y and p.x = d.x group by 1, 2", "discs", "px2"))
def marker_quant(spark, d):
    planes = I.px2(spark, d).select("channel", "y", "x", "v")
    return A.label_statistics(I.discs(spark, d).select("y", "x", "label"), planes).withColumns({c: F.round(c, 6) for c in ("mean", "cy", "cx")})


# ---------------------------------------------------------------- neighbourhoods

MIRROR = "case when {0} < 0 then -({0}) - 1 when {0} >= {1} then 2 * {1} - 1 - ({0}) else {0} end"
BINOMIAL = [(-2, 1 / 16), (-1, 4 / 16), (0, 6 / 16), (1, 4 / 16), (2, 1 / 16)]


@query(sql(f""", k(o, w) as (values (-2, 0.0625e0), (-1, 0.25e0), (0, 0.375e0), (1, 0.25e0), (2, 0.0625e0)),
a as (select p.y, p.x, sum(s.v * w) as v from px p, k, px s where s.x = p.x and s.y = {MIRROR.format("p.y + o", 48)} group by 1, 2)
select p.y, p.x, round(sum(s.v * w), 4) as v from a p, k, a s where s.y = p.y and s.x = {MIRROR.format("p.x + o", 64)} group by 1, 2""", "px"))
def gauss5(spark, d):
    return N.convolve(N.convolve(I.px(spark, d), BINOMIAL, "y", H), BINOMIAL, "x", W).select("y", "x", F.round("v", 4).alias("v"))


@query(sql("select p.y, p.x, round(sqrt(((b.v - a.v) / 2e0) ** 2 + ((r.v - l.v) / 2e0) ** 2), 5) as g from px p join px a on a.y = greatest(p.y - 1, 0) and a.x = p.x join px b on b.y = least(p.y + 1, 47) and b.x = p.x join px l on l.y = p.y and l.x = greatest(p.x - 1, 0) join px r on r.y = p.y and r.x = least(p.x + 1, 63)", "px"))
def grad_mag(spark, d):
    return N.gradient(I.px(spark, d), H, W).select("y", "x", F.round(F.hypot("gy", "gx"), 5).alias("g"))


def _gauss_sql(name: str, source: str, sigma: float) -> str:
    rows = ", ".join(f"({k}, {w!r}{'e0' if 'e' not in repr(w) else ''})" for k, w in N.gaussian_kernel(sigma))
    return f"""{name}_k(o, w) as (values {rows}), {name}_a as (select p.y, p.x, sum(s.v * w) as v from {source} p, {name}_k, {source} s where s.x = p.x and s.y = {MIRROR.format("p.y + o", 48)} group by 1, 2),
{name} as (select p.y, p.x, sum(s.v * w) as v from {name}_a p, {name}_k, {name}_a s where s.y = p.y and s.x = {MIRROR.format("p.x + o", 64)} group by 1, 2)"""


@query(sql(f""", {_gauss_sql("n", "px", 1.0)}, {_gauss_sql("m", "px", 1.6)} select n.y, n.x, round(n.v - m.v, 4) as v from n join m on n.y = m.y and n.x = m.x""", "px"))
def dog(spark, d):
    p = I.px(spark, d)
    wide = N.gaussian(p, 1.6, H, W).withColumnRenamed("v", "m")
    return N.gaussian(p, 1.0, H, W).join(wide, ["y", "x"]).select("y", "x", F.round(F.col("v") - F.col("m"), 4).alias("v"))


def _kernel_sql(sigma: float) -> str:
    rows = zip(*(N.derivative_kernel(sigma, order) for order in range(3)))
    return ", ".join(f"({r[0][0]}, {', '.join(f'cast({w!r} as double)' for _, w in r)})" for r in rows)


@query(sql(f""", k(o, w0, w1, w2) as (values {_kernel_sql(1.0)}),
a as (select p.y, p.x, sum(s.v * w0) as d0, sum(s.v * w1) as d1, sum(s.v * w2) as d2 from px p, k, px s where s.x = p.x and s.y = {MIRROR.format("p.y + o", 48)} group by 1, 2),
b as (select p.y, p.x, sum(s.d2 * w0) as hyy, sum(s.d1 * w1) as hyx, sum(s.d0 * w2) as hxx from a p, k, a s where s.y = p.y and s.x = {MIRROR.format("p.x + o", 64)} group by 1, 2)
select y, x, round(hyy + hxx, 4) as laplace, round((hyy + hxx) / 2 + sqrt((hyy - hxx) * (hyy - hxx) / 4 + hyx * hyx), 4) as big, round((hyy + hxx) / 2 - sqrt((hyy - hxx) * (hyy - hxx) / 4 + hyx * hyx), 4) as small from b""", "px"))
def hessian_eigs(spark, d):
    got = N.gaussian_derivatives(I.px(spark, d), 1.0, H, W)
    big, small = S.symmetric_eigenvalues(F.col("hyy"), F.col("hyx"), F.col("hxx"))
    return got.select("y", "x", F.round(F.col("hyy") + F.col("hxx"), 4).alias("laplace"), F.round(big, 4).alias("big"), F.round(small, 4).alias("small"))


@query(sql(f""", g as (select p.y, p.x, (b.v - a.v) / 2e0 as gy, (r.v - l.v) / 2e0 as gx from px p join px a on a.y = greatest(p.y - 1, 0) and a.x = p.x join px b on b.y = least(p.y + 1, 47) and b.x = p.x join px l on l.y = p.y and l.x = greatest(p.x - 1, 0) join px r on r.y = p.y and r.x = least(p.x + 1, 63)),
k(o, w) as (values {", ".join(f"({k}, cast({w!r} as double))" for k, w in N.gaussian_kernel(1.0))}),
a as (select p.y, p.x, sum(s.gy * s.gy * w) as yy, sum(s.gy * s.gx * w) as yx, sum(s.gx * s.gx * w) as xx from g p, k, g s where s.x = p.x and s.y = {MIRROR.format("p.y + o", 48)} group by 1, 2),
b as (select p.y, p.x, sum(s.yy * w) as yy, sum(s.yx * w) as yx, sum(s.xx * w) as xx from a p, k, a s where s.y = p.y and s.x = {MIRROR.format("p.x + o", 64)} group by 1, 2)
select y, x, round((yy + xx) / 2 + sqrt((yy - xx) * (yy - xx) / 4 + yx * yx), 2) as big, round((yy + xx) / 2 - sqrt((yy - xx) * (yy - xx) / 4 + yx * yx), 2) as small from b""", "px"))
def structure_eigs(spark, d):
    big, small = S.symmetric_eigenvalues(F.col("ayy"), F.col("ayx"), F.col("axx"))
    return N.structure_tensor(I.px(spark, d), 1.0, H, W).select("y", "x", F.round(big, 2).alias("big"), F.round(small, 2).alias("small"))


OFF = "(values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(a, b)"


@query(sql(f"select distinct y + a as y, x + b as x from fg, {OFF} where y + a between 0 and 47 and x + b between 0 and 63", "fg"))
def dilate(spark, d):
    return N.dilate(I.foreground(spark, d), N.CROSS, H, W)


@query(sql(f"select y + a as y, x + b as x from discs, {OFF} group by 1, 2 having count(*) = 5", "discs"))
def erode(spark, d):
    return N.erode(I.discs(spark, d), N.CROSS, I.disc_height(spark, d), W)


@query(sql(f""", e as (select y + a as y, x + b as x from fg, {OFF} group by 1, 2 having count(*) = 5), o as (select distinct y + a as y, x + b as x from e, {OFF} where y + a between 0 and 47 and x + b between 0 and 63),
g as (select distinct y + a as y, x + b as x from o, {OFF}) select y + a as y, x + b as x from g, {OFF} where y + a between 0 and 47 and x + b between 0 and 63 group by 1, 2 having count(*) = 5""", "fg"))
def open_close(spark, d):
    return N.closed(N.opened(I.foreground(spark, d), N.CROSS, H, W), N.CROSS, H, W)


@query(sql("select p.y, p.x, p.label from discs p where exists (select 1 from (values (-1, 0), (1, 0), (0, -1), (0, 1)) o(a, b) left join discs q on q.y = p.y + a and q.x = p.x + b where p.y + a >= 0 and p.y + a < (select hd from hd) and p.x + b between 0 and 63 and (q.label is null or q.label <> p.label))", "discs", "hd"))
def inner_boundary(spark, d):
    return N.inner_boundary(I.discs(spark, d).select("y", "x", "label"), I.disc_height(spark, d), W)


@query(sql("select p.y, p.x, max(q.v) as vmax from px p join px q on abs(p.y - q.y) <= 3 and abs(p.x - q.x) <= 3 group by 1, 2", "px"))
def window_max(spark, d):
    return N.window_max(I.px(spark, d), 3, H, W)


@query(sql("select p.y, p.x, p.v from px p join px q on abs(p.y - q.y) <= 2 and abs(p.x - q.x) <= 2 group by 1, 2, 3 having p.v = max(q.v)", "px"))
def local_peaks(spark, d):
    return N.local_peaks(I.px(spark, d), 2, H, W)


@query(sql(", bg as (select g.y, h.x from (select unnest(range(cast(hd as bigint))) as y from hd) g, range(64) h(x) where not exists (select 1 from discs d where d.y = g.y and d.x = h.x)) select d.y, d.x, min((d.y - b.y) * (d.y - b.y) + (d.x - b.x) * (d.x - b.x)) as d2 from discs d join bg b on abs(d.y - b.y) <= 12 group by 1, 2", "discs", "hd"))
def distance_sq(spark, d):
    return N.distance_squared(I.discs(spark, d), I.disc_height(spark, d), W, 10)


# ---------------------------------------------------------------- graphs


def _components_sql(near: str) -> str:
    return f", reach as (select y, x, y * 64 + x as root from fg union select f.y, f.x, r.root from reach r join fg f on {near}), comp as (select y, x, min(root) as label from reach group by 1, 2) "


FOUR, EIGHT = "abs(f.y - r.y) + abs(f.x - r.x) = 1", "greatest(abs(f.y - r.y), abs(f.x - r.x)) = 1"


@query(sql(_components_sql(FOUR) + "select y, x, label from comp", "fg", recursive=True))
def components4(spark, d):
    return GR.components(I.foreground(spark, d), H, W, block=16)


@query(sql(_components_sql(EIGHT) + "select y, x, label from comp", "fg", recursive=True))
def components8(spark, d):
    return GR.components(I.foreground(spark, d), H, W, diagonal=True, block=16)


@query(sql(_components_sql(FOUR) + "select y, x, label from comp where label in (select label from comp group by 1 having count(*) >= 6)", "fg", recursive=True))
def small_object_filter(spark, d):
    return GR.drop_small(GR.components(I.foreground(spark, d), H, W, block=16), 6).select("y", "x", "label")


@query(sql("select y, x, dense_rank() over (order by label) as label from cells", "cells"))
def relabel_compact(spark, d):
    return GR.relabel(I.cells(spark, d)).select("y", "x", "label")


@query(sql("select src, dst from edges where not fallback and overlap > 0 and score >= 0.9e0 and fg_px >= 100 and fg_frac >= 0.02e0", "edges"))
def valid_edges(spark, d):
    return GR.voting(I.edges(spark, d)).select("src", "dst")


@query(sql("select src, dst, dy, dx, round(w, 9) as w from links", "links"))
def adjacency(spark, d):
    return GR.both_ways(_weighted(spark, d)).withColumn("w", F.round("w", 9))


def _tiles(spark):
    return spark.range(30).select(F.col("id").alias("tile"), F.expr("id div 6").alias("gy"), F.expr("id % 6").alias("gx"))


@query(sql("select axis, round(coalesce(quantile_cont(dy, 0.5e0) filter (not fallback), quantile_cont(dy, 0.5e0)), 6) as dy, round(coalesce(quantile_cont(dx, 0.5e0) filter (not fallback), quantile_cont(dx, 0.5e0)), 6) as dx from edges group by 1", "edges"))
def nominal_steps(spark, d):
    return MO.nominal_steps(I.edges(spark, d)).withColumns({c: F.round(c, 6) for c in ("dy", "dx")})


def _start(spark):
    return _tiles(spark).select("tile", (F.col("gy") * 93.0).alias("y"), (F.col("gx") * 93.0).alias("x"))


RELAX = """, p as (select tile, (tile // 6) * 93e0 as y, (tile % 6) * 93e0 as x from range(30) t(tile)), votes as (select dst as tile, y + dy as vy, x + dx as vx, w from links join p on p.tile = src),
m as (select tile, quantile_cont(vy, 0.5e0) as my, quantile_cont(vx, 0.5e0) as mx, count(*) as n from votes group by 1),
t as (select v.tile, sum(vy * w) / sum(w) as ty, sum(vx * w) / sum(w) as tx from votes v join m on m.tile = v.tile where n < 3 or sqrt((vy - my) ** 2 + (vx - mx) ** 2) <= 12e0 group by 1),
q as (select p.tile, case when p.tile = 0 then 0e0 else y + 0.7e0 * (coalesce(ty, y) - y) end as y, case when p.tile = 0 then 0e0 else x + 0.7e0 * (coalesce(tx, x) - x) end as x from p left join t on t.tile = p.tile) """


@query(sql(RELAX + "select tile, round(y, 6) as y, round(x, 6) as x from q", "links"))
def relax_step(spark, d):
    return GR.relax(_start(spark), _weighted(spark, d), 0, rounds=1).select("tile", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"))


def _sweeps_sql(rounds: int) -> str:
    """One sweep after the other, each from the positions of the one before."""
    parts = [", p0 as (select tile, (tile // 6) * 93e0 as y, (tile % 6) * 93e0 as x from range(30) t(tile))"]
    for k in range(1, rounds + 1):
        parts.append(f"""v{k} as (select dst as tile, y + dy as vy, x + dx as vx, w from links join p{k - 1} p on p.tile = src), m{k} as (select tile, quantile_cont(vy, 0.5e0) as my, quantile_cont(vx, 0.5e0) as mx, count(*) as n from v{k} group by 1),
t{k} as (select v.tile, sum(vy * w) / sum(w) as ty, sum(vx * w) / sum(w) as tx from v{k} v join m{k} m on m.tile = v.tile where n < 3 or sqrt((vy - my) ** 2 + (vx - mx) ** 2) <= 12e0 group by 1),
p{k} as materialized (select p.tile, case when p.tile = 0 then 0e0 else y + 0.7e0 * (coalesce(ty, y) - y) end as y, case when p.tile = 0 then 0e0 else x + 0.7e0 * (coalesce(tx, x) - x) end as x from p{k - 1} p left join t{k} t on t.tile = p.tile)""")
    return ", ".join(parts) + f" select tile, cast(round_even(y - (select min(y) from p{rounds}), 0) as bigint) as y, cast(round_even(x - (select min(x) from p{rounds}), 0) as bigint) as x from p{rounds}"


@query(sql(_sweeps_sql(8), "links"))
def solve_positions(spark, d):
    """Eight sweeps, then whole positions from the origin."""
    return GR.to_origin(GR.relax(_start(spark), _weighted(spark, d), 0))


@query(sql(RELAX + "select tile, cast(round_even(y - (select min(y) from q), 0) as bigint) as y, cast(round_even(x - (select min(x) from q), 0) as bigint) as x from q", "links"))
def normalize_positions(spark, d):
    return GR.to_origin(GR.relax(_start(spark), _weighted(spark, d), 0, rounds=1))


def _places_sql(rounds: int) -> str:
    """Tiles reached in one hop after the other; of several parents the smallest tile decides."""
    parts = [", r0 as (select cast(0 as bigint) as tile, 0e0 as y, 0e0 as x, cast(0 as bigint) as hop)"]
    for k in range(1, rounds + 1):
        parts.append(f"""r{k} as materialized (select * from r{k - 1} union all select tile, y, x, {k} from (select dst as tile, r.y + dy as y, r.x + dx as x, row_number() over (partition by dst order by src, r.y + dy, r.x + dx) as k from links join r{k - 1} r on r.tile = src where hop = {k - 1} and dst not in (select tile from r{k - 1})) where k = 1)""")
    return ", ".join(parts) + f" select tile, y, x, hop from r{rounds}"


@query(sql(_places_sql(14), "links"))
def place_from_seed(spark, d):
    return GR.place_from_seed(_tiles(spark), _weighted(spark, d), 0)


BORROW = """, want as (select * from et where state = 'borrowed'), near as (select tile, sum(sdy * g) / sum(g) as dy, sum(sdx * g) / sum(g) as dx from (select w.tile, sdy, sdx, greatest(s.gain, 0.001e0) / greatest(sqrt((w.cy - sy) ** 2 + (w.cx - sx) ** 2), 1e-6) as g from want w join seeds s on s.island = w.island and abs(w.cy - sy) <= 30 and abs(w.cx - sx) <= 30) group by 1),
far as (select tile, sdy as dy, sdx as dx from (select w.tile, sdy, sdx, row_number() over (partition by w.tile order by (w.cy - sy) ** 2 + (w.cx - sx) ** 2, sy, sx) as k from want w join seeds s on s.island = w.island where w.tile not in (select tile from near)) where k = 1),
b as (select w.tile, coalesce(n.dy, f.dy, 0e0) as dy, coalesce(n.dx, f.dx, 0e0) as dx from want w left join near n on n.tile = w.tile left join far f on f.tile = w.tile)
select tile, round(dy * s, 6) as dy, round(dx * s, 6) as dx, 'borrowed' as mode from (select *, case when sqrt(dy * dy + dx * dx) > 15e0 then 15e0 / sqrt(dy * dy + dx * dx) else 1e0 end as s from b) union all select st, round(sdy, 6), round(sdx, 6), state from seeds"""


@query(sql(BORROW, "seeds"))
def borrow_shifts(spark, d):
    return GR.borrow_shifts(I.elastic_tiles(spark, d), 10.0, 15.0).withColumns({c: F.round(c, 6) for c in ("dy", "dx")})


@query(sql("select tile, round(sum(sdy * g) / sum(g), 6) as dy, round(sum(sdx * g) / sum(g), 6) as dx from (select t.tile, sdy, sdx, case when s.state = 'accepted' then greatest(s.gain, 0.001e0) else greatest(s.gain, 0.25e0) end / (sqrt((t.cy - sy) ** 2 + (t.cx - sx) ** 2) / 10e0 + 1e0) ** 2 as g from et t join seeds s on s.island = t.island and abs(t.cy - sy) <= 10 and abs(t.cx - sx) <= 10) group by 1", "seeds"))
def smooth_prior(spark, d):
    return GR.smooth_prior(I.elastic_tiles(spark, d), 10.0).withColumns({c: F.round(c, 6) for c in ("dy", "dx")})


@query(sql("select a.tile, case when b.x0 > a.x0 then 'right' else 'down' end as side, round(sqrt((a.dy - b.dy) ** 2 + (a.dx - b.dx) ** 2), 6) as jump from et a join et b on (b.y0 = a.y0 and b.x0 = a.x0 + 10) or (b.x0 = a.x0 and b.y0 = a.y0 + 10)", "et"))
def seam_jumps(spark, d):
    return GR.seam_jumps(I.elastic_tiles(spark, d), 10).withColumn("jump", F.round("jump", 6))


def _spread_sql(n: int) -> str:
    """The cell nearest the mean, then again and again the one farthest from those chosen."""
    parts = [", c as (select distinct y // 8 as y, x // 8 as x from cells), f1 as (select cast(0 as bigint) as rank, y, x from (select *, (select avg(y) from c) as my, (select avg(x) from c) as mx from c) order by round((y - my) * (y - my) + (x - mx) * (x - mx), 6), y, x limit 1)"]
    for k in range(2, n + 1):
        parts.append(f"f{k} as materialized (select * from f{k - 1} union all (select {k - 1}, y, x from (select c.y, c.x, min((c.y - f.y) * (c.y - f.y) + (c.x - f.x) * (c.x - f.x)) as d from c, f{k - 1} f group by 1, 2) where d > 0 order by d desc, y, x limit 1))")
    return ", ".join(parts) + f" select rank, y, x from f{n}"


@query(sql(_spread_sql(5), "cells"))
def farthest_cells(spark, d):
    return GR.farthest_cells(I.cells(spark, d).select(F.expr("y div 8").alias("y"), F.expr("x div 8").alias("x")).distinct(), 5)


@query(sql("select axis, src, dst from (select 'x' as axis, t as src, t + 1 as dst from range(30) r(t) where t % 6 < 5 union all select 'y', t, t + 6 from range(24) r(t))"))
def neighbour_pairs(spark, d):
    return MO.neighbour_pairs(_tiles(spark))


@query(sql(""", t as (select (y // 24) * 2 + x // 32 as tile, y % 24 as y, x % 32 as x, v from px), pos(tile, py, px_) as (values (0, 0, 0), (1, 1, 28), (2, 20, 0), (3, 21, 28)), m as (select y + py as y, x + px_ as x, v, least(y + 1, 24 - y) * least(x + 1, 32 - x) / 192e0 as w from t join pos on pos.tile = t.tile)
select cast(y as bigint) as y, cast(x as bigint) as x, cast(floor(round(sum(v * w) / sum(w), 6)) as bigint) as v from m group by 1, 2""", "px"))
def feather_mosaic(spark, d):
    tiles = I.px(spark, d).select(F.expr("(y div 24) * 2 + x div 32").alias("tile"), (F.col("y") % 24).alias("y"), (F.col("x") % 32).alias("x"), "v")
    at = spark.createDataFrame([(0, 0, 0), (1, 1, 28), (2, 20, 0), (3, 21, 28)], "tile long, py long, px long")
    return MO.feathered_mosaic(tiles, at, 24, 32)


# ---------------------------------------------------------------- metadata and plans

NAMES = "select case when p_partkey % 3 = 0 then 'raw_' when p_partkey % 3 = 1 then 'Area_' else 'other_' end || replace(p_brand, '#', '') || '_' || p_size || '_' || p_partkey % 9 || '.ome.tif' || case when p_partkey % 2 = 0 then 'f' else '' end as path from part"


def _names(spark, d):
    head = F.when(F.col("p_partkey") % 3 == 0, "raw_").when(F.col("p_partkey") % 3 == 1, "Area_").otherwise("other_")
    return I.table(spark, d, "part").select(F.concat(head, F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("_"), F.col("p_size").cast("string"), F.lit("_"), (F.col("p_partkey") % 9).cast("string"), F.lit(".ome.tif"), F.when(F.col("p_partkey") % 2 == 0, "f").otherwise("")).alias("path"))


TILES = rf"select path, cast(regexp_extract(path, '_(\d+)_(\d+)\.ome', 1) as bigint) as gx, cast(regexp_extract(path, '_(\d+)_(\d+)\.ome', 2) as bigint) as gy from ({NAMES}) where regexp_matches(path, '(?i)^(area|raw)_')"


@query(TILES)
def tile_name_parse(spark, d):
    return M.parse_tiles(_names(spark, d))


@query(f"select gy, gx, min(path) as path from ({TILES}) group by 1, 2")
def first_file_wins(spark, d):
    return MO.first_per_place(M.parse_tiles(_names(spark, d)))


@query("""with f as (select distinct 'C' || p_size || '_' || replace(p_brand, '#', '') as folder from part), g as (select folder, cast(regexp_extract(folder, '^[Cc](\\d+)_(.*)$', 1) as bigint) as number, regexp_extract(folder, '^[Cc](\\d+)_(.*)$', 2) as rest from f),
h as (select *, count(*) over (partition by number) as n, row_number() over (partition by number order by folder) - 1 as k, row_number() over (order by number, folder) - 1 as cycle from g)
select folder, number, rest, case when n = 1 then '' when k < 26 then chr(cast(97 + k as int)) else chr(cast(96 + k // 26 as int)) || chr(cast(97 + k % 26 as int)) end as suffix, cycle from h""".replace("\\\\", "\\"))
def cycle_dir_parse(spark, d):
    folders = I.table(spark, d, "part").select(F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("_"), F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))).alias("folder")).distinct()
    return M.parse_cycles(folders)


#: One row for each order and line.
LI = "(select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_returnflag) as l_returnflag, min(l_linestatus) as l_linestatus from lineitem group by 1, 2)"


def _lines(spark, d):
    rows = I.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return rows.agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_returnflag", "l_linestatus")])


CHANNELS = f"select l_orderkey as sample, cast(l_linenumber as bigint) as cycle, cast(c as bigint) as channel, case when c = 0 then 'DAPI' else l_returnflag end as name, l_linestatus as label from {LI}, range(2) t(c)"


def _channels(spark, d):
    rows = _lines(spark, d)
    c = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("channel")
    return rows.select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("cycle"), c, "l_returnflag", F.col("l_linestatus").alias("label")).withColumn("name", F.when(F.col("channel") == 0, "DAPI").otherwise(F.col("l_returnflag"))).drop("l_returnflag")


@query(f"""with ch as (select distinct * from ({CHANNELS})), o as (select *, row_number() over (partition by sample order by cycle, channel) - 1 as out_, name || '_cy' || label as stem from ch),
r as (select *, row_number() over (partition by sample, stem order by out_) as k from o) select sample, cycle, channel, out_ as "out", stem || case when k > 1 then '_' || k else '' end as out_name from r""")
def channel_layout(spark, d):
    return M.channel_layout(_channels(spark, d).distinct())


@query("select sample, cycle, row_number() over (partition by sample order by case when cycle = 3 then 0 else 1 end, cycle) as ord from (select distinct l_orderkey as sample, cast(l_linenumber as bigint) as cycle from lineitem)")
def write_order(spark, d):
    return M.write_order(_channels(spark, d).select("sample", "cycle").distinct(), 3)


@query("select l_orderkey as sample, sha256(string_agg(item, chr(10) order by item)) as fingerprint, count(*) as n from (select l_orderkey, cast(to_json(struct_pack(l_partkey := l_partkey, l_linenumber := l_linenumber, l_returnflag := l_returnflag)) as varchar) as item from lineitem) group by 1")
def fingerprint(spark, d):
    return M.fingerprint(I.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "sample"), "sample", "l_partkey", "l_linenumber", "l_returnflag")


PLAN_SQL = f"select l_orderkey as sample, list(l_linenumber % 4 order by l_linenumber) as cycles, list(l_shipdate_ order by l_linenumber) as files, list(l_returnflag order by l_linenumber) as markers, list(l_linestatus = 'O' order by l_linenumber) as enabled from (select *, 'f' || l_partkey as l_shipdate_ from {LI}) group by 1"


def _plan(spark, d):
    rows = _lines(spark, d).select(F.col("l_orderkey").alias("sample"), F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").alias("r"))
    got = rows.groupBy("sample").agg(F.sort_array(F.collect_list("r")).alias("r"))
    pick = lambda f: F.transform("r", f)
    return got.select("sample", pick(lambda r: (r["l_linenumber"] % 4).cast("long")).alias("cycles"), pick(lambda r: F.concat(F.lit("f"), r["l_partkey"].cast("string"))).alias("files"), pick(lambda r: r["l_returnflag"]).alias("markers"), pick(lambda r: r["l_linestatus"] == "O").alias("enabled"))


FLAT = f"select sample, i - 1 as place, cast(cycles[i] as bigint) as cycle, files[i] as file, markers[i] as marker from (select *, unnest(range(1, len(cycles) + 1)) as i from ({PLAN_SQL})) where enabled[i]"


@query(FLAT)
def plan_explode(spark, d):
    return M.explode_plan(_plan(spark, d))


@query(f"select sample, cycle, count(*) as n from ({FLAT}) group by 1, 2 having count(*) > 1")
def plan_duplicates(spark, d):
    return M.duplicate_cycles(M.explode_plan(_plan(spark, d)))


@query(f"""with f as ({FLAT}), c as (select sample, count(*) as n_cycles, count(*) - count(distinct cycle) as n_dup, count(*) filter (marker = 'N') as n_un from f group by 1)
select o.sample, case when o.sample % 17 = 0 then 'no output path' when coalesce(n_cycles, 0) = 0 then 'no enabled cycles' when n_dup > 0 then 'duplicate cycle numbers' when n_un > 0 then 'no registration marker' end as problem from (select distinct l_orderkey as sample from lineitem) o left join c on c.sample = o.sample""")
def plan_readiness(spark, d):
    flat = M.explode_plan(_plan(spark, d))
    counts = flat.groupBy("sample").agg(F.count("*").alias("n_cycles"), (F.count("*") - F.countDistinct("cycle")).alias("n_duplicates"), F.count_if(F.col("marker") == "N").alias("n_unmarked"))
    every = I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample")).distinct()
    rows = every.join(counts, "sample", "left").na.fill(0).withColumn("output", F.when(F.col("sample") % 17 == 0, " ").otherwise("out"))
    return M.readiness(rows)


PROGRESS = f"select l_orderkey as sample, cast(l_linenumber as bigint) as ord, cast(l_linenumber * 10 as bigint) as cycle, case when l_returnflag = 'N' then 'pending' else 'complete' end as status from {LI}"


def _progress(spark, d):
    return _lines(spark, d).select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("ord"), (F.col("l_linenumber") * 10).cast("long").alias("cycle"), F.when(F.col("l_returnflag") == "N", "pending").otherwise("complete").alias("status"))


@query(f"select sample, ord, cycle from (select *, min(case when status = 'complete' then 1 else 0 end) over (partition by sample order by ord rows unbounded preceding) as ok from ({PROGRESS})) where ok = 1")
def completed_prefix(spark, d):
    return M.completed_prefix(_progress(spark, d))


@query(f"select sample, arg_min(cycle, ord) as cycle, min(ord) as ord from ({PROGRESS}) where status <> 'complete' group by 1")
def first_incomplete(spark, d):
    return M.first_incomplete(_progress(spark, d))


@query("select user_id, event_type, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1")
def latest_run_events(spark, d):
    return M.latest_events(I.table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("select user_id, event_id, event_id // 1000 as generation from events e where event_id // 1000 = (select max(event_id // 1000) from events f where f.user_id = e.user_id)")
def current_generation(spark, d):
    return P.current_runs(I.table(spark, d, "events")).select("user_id", "event_id", "generation")


@query("select doc_id, quality from (select *, row_number() over (partition by quality order by md5(cast(doc_id as varchar))) as k from labels) where k <= 20")
def class_sample_cap(spark, d):
    rows = I.table(spark, d, "labels").select("doc_id", "quality")
    return M.sample_by_class(rows, "quality", 20, "doc_id").select("doc_id", "quality")


@query("select p_partkey as image, c as channel, case when c = 0 then p_brand else 'Channel 1' end as name from part, range(2) t(c)")
def ome_channel_names(spark, d):
    text = F.concat(F.lit('<OME xmlns="urn:x"><Image><Pixels SizeC="2"><Channel ID="0" Name="'), F.col("p_brand"), F.lit('"/><Channel ID="1" Name=" "/></Pixels></Image></OME>'))
    return M.ome_channels(I.table(spark, d, "part").select(F.col("p_partkey").alias("image"), text.alias("xml")))


@query("select * from (values (8), (16), (32)) a(spacing), (values (5), (10), (20)) b(iterations), (values (0e0), (0.1e0), (1e0)) c(weight), (values (10), (20), (40), (80)) d(\"limit\")".replace("select *", "select cast(spacing as bigint) as spacing, cast(iterations as bigint) as iterations, weight, cast(\"limit\" as bigint) as \"limit\""))
def sweep_grid(spark, d):
    return M.sweep(spark, [8, 16, 32], [5, 10, 20], [0.0, 0.1, 1.0], [10, 20, 40, 80])


KIND = "case when state = 'accepted' and gain >= 0.05e0 then 'improved' when state = 'accepted' then 'accepted' when gain + 0.5e0 >= 0.85e0 then 'already good' when dy = 0 then 'no shift' else 'rejected' end"


def _kinds(spark, d):
    return I.elastic_tiles(spark, d).select("tile", M.tile_class(F.col("gain"), F.col("gain") + 0.5, F.col("dy"), F.col("state") == "accepted").alias("kind"))


@query(sql(f"select tile, {KIND} as kind from et", "et"))
def tile_classes(spark, d):
    return _kinds(spark, d)


@query(sql(f"select {KIND} as kind, count(*) as n from et group by 1", "et"))
def class_counts(spark, d):
    return _kinds(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- edits


def _edited(spark, d):
    return I.cells(spark, d).where("(y + x) % 7 <> 0").withColumn("label", F.when(F.col("y") == 5, F.col("label") + 100).otherwise(F.col("label")))


EDITED = "(select y, x, case when y = 5 then label + 100 else label end as label from cells where (y + x) % 7 <> 0)"


@query(sql(f"select coalesce(a.y, b.y) as y, coalesce(a.x, b.x) as x, coalesce(a.label, 0) as old, coalesce(b.label, 0) as new from cells a full join {EDITED} b on a.y = b.y and a.x = b.x where coalesce(a.label, 0) <> coalesce(b.label, 0)", "cells"))
def edit_diff(spark, d):
    return E.difference(I.cells(spark, d), _edited(spark, d))


LINE = "(select cast(y + a as bigint) as y, cast(x + b as bigint) as x from (select 10 as y, c as x from range(5, 41) t(c)), range(-2, 3) p(a), range(-2, 3) q(b) where a * a + b * b <= 4)"


def _line(spark, r=2):
    return G.draw_polyline(spark, [(10, 5), (10, 40)], r)


@query(f"select distinct y, x from {LINE}")
def draw_polyline(spark, d):
    return _line(spark)


@query(sql(f", hit as (select distinct label from cells c where exists (select 1 from {LINE} l where l.y = c.y and l.x = c.x)) select y, x, case when label in (select label from hit) and (select count(*) from hit) > 1 then (select min(label) from hit) else label end as label from cells", "cells"))
def merge_labels(spark, d):
    return E.merge_under(I.cells(spark, d), _line(spark))


@query(sql("select y, x, label from discs where label <> 3", "discs"))
def delete_label(spark, d):
    return E.delete_at(I.discs(spark, d).select("y", "x", "label"), 6, 32)


@query(sql(f", over as (select label, count(*) as n from discs c where exists (select 1 from {LINE} l where l.y = c.y and l.x = c.x) group by 1) select y, x, label from discs union all select y, x, coalesce((select label from over order by n desc, label limit 1), (select max(label) + 1 from discs)) from (select distinct y, x from {LINE}) l where not exists (select 1 from discs c where c.y = l.y and c.x = l.x)", "discs"))
def draw_label(spark, d):
    return E.draw(I.discs(spark, d).select("y", "x", "label"), _line(spark))


@query(sql(f"select y, x, label from cells c where not exists (select 1 from {LINE} l where l.y = c.y and l.x = c.x)", "cells"))
def erase_label(spark, d):
    return E.erase(I.cells(spark, d), _line(spark))


SPLIT = """, reach as (select y, x, label, y * 64 + x as root from cells union select f.y, f.x, f.label, r.root from reach r join cells f on f.label = r.label and abs(f.y - r.y) + abs(f.x - r.x) = 1), part as (select y, x, label, min(root) as part from reach group by 1, 2, 3),
size as (select label, part, count(*) as n, row_number() over (partition by label order by count(*) desc, part) as k from part group by 1, 2), made as (select label, part, (select max(label) from cells) + row_number() over (order by label, k) as new from size where k > 1)
select p.y, p.x, coalesce(new, p.label) as label from part p left join made m on m.label = p.label and m.part = p.part"""


@query(sql(SPLIT, "cells", recursive=True))
def split_label(spark, d):
    return E.split_parts(I.cells(spark, d), H, W)


@query()
def split_by_line(spark, d):
    return E.split_by_line(I.discs(spark, d).select("y", "x", "label"), G.draw_polyline(spark, [(6, 0), (6, 63)]), I.disc_height(spark, d), W, least=3)


@query(sql(f"select count(*) > 0 as changed, (select count(*) > 0 from {EDITED} where label not in (select label from cells)) as appeared from (select 1 from cells a left join {EDITED} b on a.y = b.y and a.x = b.x where a.label <> coalesce(b.label, 0))", "cells"))
def model_need_flags(spark, d):
    return E.model_needs(I.cells(spark, d), _edited(spark, d))


# ---------------------------------------------------------------- kernels


@query(sql(f""", f as ({FIELD}), r as (select f.y, f.x, floor(f.y - dy) + a as sy, floor(f.x - dx) + b as sx, case when a = 1 then f.y - dy - floor(f.y - dy) else 1 - (f.y - dy - floor(f.y - dy)) end * case when b = 1 then f.x - dx - floor(f.x - dx) else 1 - (f.x - dx - floor(f.x - dx)) end as w from f, range(2) p(a), range(2) q(b))
select r.y, r.x, round(coalesce(sum(s.v * w), 0e0), 5) as v from r left join px s on s.y = r.sy and s.x = r.sx and w > 0 group by 1, 2""", "px"))
def warp_field(spark, d):
    return R.warp(I.px(spark, d), _field(spark, d)).withColumn("v", F.round("v", 5))


@query(sql("select b as ty, cast(0 as bigint) as tx, -3e0 as dy, 5e0 as dx from (select unnest(range(cast((hd + 47) // 48 as bigint))) as b from hd)", "hd"))
def phase_shift(spark, d):
    """Planted: the second plane is the first, moved by (3, -5) and wrapped within its band of 48 rows; a tile is a band, and the way back is found in each."""
    a = I.disc_plane(spark, d).withColumn("v", F.col("v") + (F.col("y") * 7 + F.col("x") * 13) % 50).withColumn("band", F.expr("y div 48"))
    rows = F.least(F.lit(48), I.disc_height(spark, d) - F.col("band") * 48)
    at = lambda y: (F.col("band") * 64 + y).alias("y")
    b = a.select(at((F.col("y") % 48 + 3) % rows), ((F.col("x") + W - 5) % W).alias("x"), "v")
    key = lambda p: p.withColumn("cycle", F.lit(1))
    got = R.estimate_shifts(key(a.select(at(F.col("y") % 48), "x", "v")), key(b), ["cycle"], 64)
    return got.select("ty", "tx", (F.round("dy", 0) + 0.0).alias("dy"), (F.round("dx", 0) + 0.0).alias("dx"))


@query()
def feature_stack(spark, d):
    return L.feature_stack(I.px(spark, d), [0.7, 1.6], H, W)


@query()
def rf_predict(spark, d):
    return L.classify_vectors(I.table(spark, d, "embeddings"), "vec_id", "embedding", "label", 10, trees=10)


@query()
def pixel_classes(spark, d):
    stack = I.disc_plane(spark, d).select("y", "x", F.col("v").cast("double").alias("raw"))
    marks = I.disc_plane(spark, d).where("(y * 64 + x) % 7 = 0").select("y", "x", F.when(F.col("v") > 20500, 1).when(F.col("v") > 10000, 2).otherwise(3).alias("class"))
    return L.classify_pixels(stack, marks, 3, trees=10)


@query(sql(f""", e as (select y + a as y, x + b as x from discs, {OFF} group by 1, 2 having count(*) = 5), o as (select distinct y + a as y, x + b as x from e, {OFF}),
g as (select distinct y + a as y, x + b as x from o, {OFF}), c as (select y + a as y, x + b as x from g, {OFF} group by 1, 2 having count(*) = 5)
select dense_rank() over (order by label) as label, count(*) as area from discs d where exists (select 1 from c where c.y = d.y and c.x = d.x) group by d.label""", "discs"))
def nuclei_instances(spark, d):
    """Planted discs, found again from their plane: areas in the order of the objects."""
    prob = I.disc_plane(spark, d).select("y", "x", F.when(F.col("v") > 1000, F.lit(0.9)).otherwise(F.lit(0.1)).alias("p"))
    found = SEG.nuclei(prob, I.disc_height(spark, d), W, least=12)
    order = found.groupBy("label").agg(F.count("*").alias("area"), F.min(F.expr("y div 12 * 64 + x")).alias("at"))
    from pyspark.sql import Window

    return order.select(F.row_number().over(Window.orderBy("at")).alias("label"), "area")  # one row for each object


@query(ORACLES["nuclei_instances"])
def boundary_instances(spark, d):
    """The same discs by their core, away from a boundary plane along their rims."""
    height = I.disc_height(spark, d)
    rim = N.inner_boundary(I.discs(spark, d).select("y", "x", "label"), height, W).select("y", "x", F.lit(0.8).alias("boundary"))
    probs = I.disc_plane(spark, d).join(by_sort(rim), ["y", "x"], "left").select("y", "x", F.when(F.col("v") > 1000, F.lit(0.9)).otherwise(F.lit(0.1)).alias("p"), F.coalesce("boundary", F.lit(0.0)).alias("boundary"), F.lit(0.0).alias("background"))
    found = SEG.boundary_nuclei(probs, height, W, least=12)
    order = found.groupBy("label").agg(F.count("*").alias("area"), F.min(F.expr("y div 12 * 64 + x")).alias("at"))
    from pyspark.sql import Window

    return order.select(F.row_number().over(Window.orderBy("at")).alias("label"), "area")  # one row for each object


@query()
def cells_from_nuclei(spark, d):
    prob = I.disc_plane(spark, d).select("y", "x", F.when(F.col("v") > 1000, F.lit(0.9)).otherwise(F.lit(0.5)).alias("p"))
    nuclei = I.discs(spark, d).select("y", "x", "label")
    return SEG.grow_cells(nuclei, prob, I.disc_height(spark, d), W, reach=3)
