"""Queries of pyramids, chunk windows, physical sizes and resuming, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import pyramid as P
from . import inputs as I
from .catalog import query, sql
from .inputs import H, W

# ---------------------------------------------------------------- derived tables

IMAGES = "select p_partkey as image, cast(p_size * 97 + p_partkey % 777 + 1 as bigint) as h, cast(p_partkey % 5000 + 60 as bigint) as w from part"
# How often a side halves, rounded up, while both are above 128.
LEVELS = f"select image, k as level, cast(ceil(h / 2e0 ** k) as bigint) as h, cast(ceil(w / 2e0 ** k) as bigint) as w from ({IMAGES}), range(0, 16) t(k) where k = 0 or least(ceil(h / 2e0 ** (k - 1)), ceil(w / 2e0 ** (k - 1))) > 128"


def _images(spark, d):
    k = F.col("p_partkey")
    return I.table(spark, d, "part").select(k.alias("image"), (F.col("p_size") * 97 + k % 777 + 1).cast("long").alias("h"), (k % 5000 + 60).cast("long").alias("w"))


@query(LEVELS)
def level_shapes(spark, d):
    return P.level_shapes(_images(spark, d))


@query(f"select image, cast(sum(case when level > 0 then ceil(h / 256e0) * ceil(w / 256e0) + 1 else 1 end) as bigint) as ticks from ({LEVELS}) group by 1")
def conversion_ticks(spark, d):
    return P.conversion_ticks(_images(spark, d), chunk=256)


SERIES = f"select image // 3 as image, image % 3 as series, level, h, w from ({LEVELS})"


@query(f"""with s as (select image, series, count(*) as n_levels, arg_min(h, level) as h, arg_min(w, level) as w from ({SERIES}) group by 1, 2), r as (select *, row_number() over (partition by image order by h * w desc, series) as k, bool_or(n_levels > 1) over (partition by image) as pyramidal from s)
select image, series, n_levels, h, w, pyramidal from r where k = 1""")
def pyramid_inspect(spark, d):
    levels = P.level_shapes(_images(spark, d)).select(F.expr("image div 3").alias("image"), (F.col("image") % 3).alias("series"), "level", "h", "w")
    return P.inspect(levels)


@query(f"with l as ({LEVELS}), b as (select image, h // 5 as t from l where level = 0) select image, arg_min(level, abs(h - t) * 100 + level) as level from l join b using (image) group by 1")
def nearest_level(spark, d):
    return P.nearest_level(P.level_shapes(_images(spark, d)), 5)


@query("""with s as (select l_orderkey * 10 + l_linenumber as strip, l_suppkey as first, l_suppkey + cast(l_quantity as bigint) as last from lineitem)
select strip, greatest(first, cy * 16) as y0, least(last, cy * 16 + 16) as y1, cx * 16 as x0, least(40, cx * 16 + 16) as x1 from (select *, unnest(range(first // 16, (last - 1) // 16 + 1)) as cy from s where last > first), range(3) t(cx)""")
def strip_windows(spark, d):
    rows = I.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("strip"), F.col("l_suppkey").alias("first"), (F.col("l_suppkey") + F.col("l_quantity").cast("long")).alias("last"))
    return P.strip_windows(rows, 40, 16)


HALVED = "select channel, y // 2 as y, x // 2 as x, cast(round_even(avg(v), 0) as bigint) as v from {} group by 1, 2, 3"
TILED = "select cast({} as bigint) as level, channel, y // 16 as tile_y, x // 16 as tile_x, count(*) as n, cast(sum(v) as bigint) as total, cast(sum(v * ((y % 16) * 16 + x % 16 + 1)) as bigint) as check from {} group by 2, 3, 4"


@query(sql(f", l0 as (select cycle || channel as channel, y, x, v from px2), l1 as ({HALVED.format('l0')}), l2 as ({HALVED.format('l1')}) " + " union all ".join(TILED.format(k, f"l{k}") for k in range(3)), "px2"))
def pyramid_tiles(spark, d):
    return P.pyramid(I.px2(spark, d).select(F.concat("cycle", "channel").alias("channel"), "y", "x", "v"), 2, 16)


@query(sql("select channel, y // 16 as tile_y, x // 16 as tile_x, count(*) as n, row_number() over (order by channel, tile_y, tile_x) as place from px2 group by 1, 2, 3", "px2"))
def tile_order(spark, d):
    from pyspark.sql import Window

    tiles = P.tile_table(I.px2(spark, d), 16).select("channel", "tile_y", "tile_x", "n")
    return tiles.withColumn("place", F.row_number().over(Window.orderBy("channel", "tile_y", "tile_x")))  # a row for each tile of one image


FOUND = f"select image, level, h + case when (image + level) % 11 = 0 then 1 else 0 end as h, w, (image + level) % 5 <> 0 as done from ({LEVELS}) where (image + level) % 7 <> 0"


@query(f"""with e as ({LEVELS}), f as ({FOUND}), j as (select e.image, e.level, coalesce(f.h = e.h and f.w = e.w and f.done, false) as fits from e left join f on f.image = e.image and f.level = e.level), b as (select image, min(level) filter (not fits) as first from j group by 1)
select image, level, case when first is null or level < first then 'kept' else 'rebuilt' end as state from j join b using (image)""")
def levels_to_build(spark, d):
    expected = P.level_shapes(_images(spark, d))
    k = F.col("image") + F.col("level")
    found = expected.where(k % 7 != 0).select("image", "level", (F.col("h") + (k % 11 == 0).cast("int")).alias("h"), "w", (k % 5 != 0).alias("done"))
    return P.levels_to_build(expected, found)


CYCLES = "select l_orderkey as sample, cast(l_linenumber as bigint) as ord, cast(l_linenumber * 10 as bigint) as cycle, min(l_returnflag) <> 'N' as marked, min(l_linestatus) = 'F' as written from lineitem group by 1, 2, 3"


def _resume_sql(ok: str) -> str:
    return f"select sample, ord, cycle from (select *, min(case when {ok} then 1 else 0 end) over (partition by sample order by ord rows unbounded preceding) as k from ({CYCLES})) where k = 1"


def _resumed(spark, d, how: str, force_from: int | None = None):
    rows = I.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("ord"), (F.col("l_linenumber") * 10).cast("long").alias("cycle"))
    return P.resume_cycles(rows.agg((F.min("l_returnflag") != "N").alias("marked"), (F.min("l_linestatus") == "F").alias("written")), how, force_from)


@query(_resume_sql("marked and written"))
def resume_hybrid(spark, d):
    return _resumed(spark, d, "hybrid")


@query(_resume_sql("written"))
def resume_pixels(spark, d):
    return _resumed(spark, d, "pixels")


@query(_resume_sql("marked and written and cycle <> 30"))
def resume_forced(spark, d):
    return _resumed(spark, d, "hybrid", 30)


def _xml(spark, d):
    """OME texts with their sizes and units, some of them missing or not positive."""
    k = F.col("p_partkey")
    size = F.concat(F.lit('PhysicalSizeX="'), k % 9 / 4.0, F.lit('" PhysicalSizeY="'), F.when(k % 10 == 0, "NaN").otherwise((k % 9 / 2.0).cast("string")), F.lit('" '))
    units = F.when(k % 4 == 0, 'PhysicalSizeXUnit="nm" ').when(k % 4 == 1, 'PhysicalSizeXUnit="mm" PhysicalSizeYUnit="µm" ').otherwise("")
    pixels = F.concat(F.lit("<Pixels "), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit('SizeC="'), k % 40, F.lit('" '))), F.when(k % 8 == 7, "").otherwise(size), units, F.lit("/>"))
    return I.table(spark, d, "part").select(k.alias("image"), F.concat(F.lit('<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image>'), pixels, F.lit("</Image></OME>")).alias("xml"))


@query("select p_partkey as image, case when p_partkey % 6 <> 0 then p_partkey % 40 else -1 end as size_c from part")
def channel_count(spark, d):
    return P.channel_counts(_xml(spark, d)).select("image", F.coalesce("size_c", F.lit(-1)).alias("size_c"))


SIZES = """select p_partkey as image, case when p_partkey % 8 <> 7 and p_partkey % 9 > 0 then p_partkey % 9 / 4e0 end as x, case when p_partkey % 8 <> 7 and p_partkey % 10 <> 0 and p_partkey % 9 > 0 then p_partkey % 9 / 2e0 end as y,
case p_partkey % 4 when 0 then 'nm' when 1 then 'mm' else 'µm' end as x_unit, case p_partkey % 4 when 0 then 'nm' else 'µm' end as y_unit from part"""


@query(SIZES)
def pixel_sizes(spark, d):
    return P.physical_sizes(_xml(spark, d))


@query(f"""with s as (select image, x * case x_unit when 'nm' then 1e-3 when 'mm' then 1e3 else 1e0 end as ux, y * case y_unit when 'nm' then 1e-3 else 1e0 end as uy from ({SIZES}))
select image, k as level, round(1e4 / ux / 2e0 ** k, 6) as x_res, round(1e4 / uy / 2e0 ** k, 6) as y_res from s, range(0, 4) t(k) where ux > 0 and uy > 0""")
def tiff_resolution(spark, d):
    return P.resolutions(P.physical_sizes(_xml(spark, d)), lambda unit: S.to_micrometres(F.lit(1.0), unit), 3)


@query("select l_orderkey % 7 as image, cast(l_linenumber % 4 as bigint) as channel, l_suppkey as y, l_partkey as x, cast(sum(l_quantity) as bigint) as v from lineitem where l_orderkey % 7 < 5 group by 1, 2, 3, 4")
def canonical_axes(spark, d):
    k, c, y, x = F.col("l_orderkey") % 7, (F.col("l_linenumber") % 4).cast("long"), F.col("l_suppkey"), F.col("l_partkey")
    axes = F.when(k % 3 == 0, "CYX").when(k % 3 == 1, "YXC").otherwise("YCX")
    i, j, m = F.when(k % 3 == 0, c).otherwise(y), F.when(k % 3 == 0, y).when(k % 3 == 1, x).otherwise(c), F.when(k % 3 == 0, x).when(k % 3 == 1, c).otherwise(x)
    rows = I.table(spark, d, "lineitem").select(k.alias("image"), F.when(k < 5, axes).otherwise("TZYX").alias("axes"), i.alias("i"), j.alias("j"), m.alias("k"), F.col("l_quantity").alias("v"))
    return P.canonical_axes(rows).groupBy("image", "channel", "y", "x").agg(F.sum("v").cast("long").alias("v"))


@query("select c_custkey as store, c_custkey % 3 <> 0 and c_custkey % 5 <> 0 and c_custkey % 7 <> 6 as ok from customer")
def store_layout(spark, d):
    c, k = I.table(spark, d, "customer"), F.col("c_custkey")
    names = F.array("c_mktsegment", F.lit("DAPI"))
    have = c.select(k.alias("store"), k.alias("h"), F.when(k % 3 == 0, k + 1).otherwise(k).alias("w"), F.lit(2).alias("n_channels"), F.when(k % 5 == 0, "uint8").otherwise("uint16").alias("dtype"), names.alias("names"))
    want = c.where(k % 7 != 6).select(k.alias("store"), k.alias("h"), k.alias("w"), F.lit(2).alias("n_channels"), F.lit("uint16").alias("dtype"), names.alias("names"))
    return P.same_layout(have, want)


@query(sql("select channel, round(quantile_cont(v, 0.01e0), 6) as lo, round(quantile_cont(v, 0.998e0), 6) as hi from px2 where y % 3 = 0 and x % 3 = 0 group by 1", "px2"))
def stride_quantiles(spark, d):
    return P.stride_quantiles(I.px2(spark, d), 0.01, 0.998, 300, H, W)


@query(sql("select channel, round(case when b <= a then 0 else a end, 6) as lo, round(case when b <= a then 65535 else b end, 6) as hi from (select channel, quantile_cont(case when channel = 'R' then 7 else v end, 0.01e0) as a, quantile_cont(case when channel = 'R' then 7 else v end, 0.99e0) as b from px2 group by 1)", "px2"))
def contrast_limits(spark, d):
    thumbs = I.px2(spark, d).withColumn("v", F.when(F.col("channel") == "R", F.lit(7).cast("long")).otherwise(F.col("v")))
    return P.contrast_limits(thumbs, 65535)


@query("select o_orderkey as region, o_custkey * 4 as y0, (o_custkey + 20) * 4 as y1, o_orderkey * 4 as x0, (o_orderkey + 9) * 4 as x1, cast(round(o_totalprice % 30) as bigint) * 4 as dy, (o_orderkey % 21 - 10) * 4 as dx, cast(o_custkey * 16 as bigint) as pixels from orders")
def scale_regions(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = I.table(spark, d, "orders").select(k.alias("region"), c.alias("y0"), (c + 20).alias("y1"), k.alias("x0"), (k + 9).alias("x1"), F.round(F.col("o_totalprice") % 30).cast("long").alias("dy"), (k % 21 - 10).alias("dx"), c.alias("pixels"))
    return P.scale_regions(rows, 4)


@query("select p_partkey, p_partkey % 2 + p_size * (p_partkey // 2 % 2 + p_partkey // 4 % 2 + p_partkey // 8 % 2 + p_partkey // 16 % 2 + 2 * (p_partkey // 32 % 2) + 2 * (p_partkey // 64 % 2)) as n_features from part")
def feature_counts(spark, d):
    names = ["intensity", "gaussian", "gradient", "log", "dog", "structure", "hessian"]
    flags = {n: F.expr(f"shiftright(p_partkey, {i}) % 2 = 1") for i, n in enumerate(names)}
    return I.table(spark, d, "part").select("p_partkey", P.feature_count(F.col("p_size"), flags).alias("n_features"))


@query("select p_partkey, sha1(cast(to_json(struct_pack(p_size := p_size, p_brand := p_brand, p_type := case when p_partkey % 2 = 0 then p_type end)) as varchar)) as hash from part")
def config_hash(spark, d):
    rows = I.table(spark, d, "part").withColumn("p_type", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")))
    return rows.select("p_partkey", P.config_hash("p_size", "p_brand", "p_type").alias("hash"))
