"""Queries of islands, stitching and touch-up, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import edits as E
from ..operators import geometry as G
from ..operators import islands as IS
from ..operators import neighbourhood as N
from ..operators import stitching as ST
from ..operators import touchup as T
from . import inputs as I
from .catalog import CTES, NEEDS, ORACLES, query, sql
from .inputs import H, W

# Foreground in four quarters of the plane; masks of overlapping lattice tiles; a texture of sums of squares of places.
CTES["quarters"] = "select y, x, y // 24 * 2 + x // 32 + 1 as label from fg"
CTES["masks"] = "select (ty * 8 + tx) * 7 % 48 as mask, y, x from fg, range(6) a(ty), range(8) b(tx) where y between ty * 8 and ty * 8 + 9 and x between tx * 8 and tx * 8 + 9 and v % 3 > 0"
NEEDS |= {"quarters": ["px", "fg"], "masks": ["px", "fg"]}


def _quarters(spark, d):
    return I.foreground(spark, d).select("y", "x", F.expr("y div 24 * 2 + x div 32 + 1").alias("label"))


def _masks(spark, d):
    lattice = G.on_lattice(I.foreground(spark, d), 10, 8).where(F.col("v") % 3 > 0).where("tile_y < 6 and tile_x < 8")
    return lattice.select(((F.col("tile_y") * 8 + F.col("tile_x")) * 7 % 48).cast("long").alias("mask"), "y", "x")


# ---------------------------------------------------------------- islands and joins


@query(sql(""", b as (select label, min(y) as by_, max(y) as ey, min(x) as bx, max(x) as ex from quarters group by 1),
c as (select q.label, by_ + (y - by_) // 5 * 5 as y0, bx + (x - bx) // 5 * 5 as x0, ey, ex, count(*) as n from quarters q join b on b.label = q.label group by 1, 2, 3, 4, 5)
select label, y0, least(y0 + 5, ey + 1) as y1, x0, least(x0 + 5, ex + 1) as x1, n from c where n > 0.005e0 * (least(y0 + 5, ey + 1) - y0) * (least(x0 + 5, ex + 1) - x0)""", "quarters"))
def island_cells(spark, d):
    return IS.island_cells(_quarters(spark, d), 5)


@query(sql(", t as (select y // 16 as tile_y, x // 16 as tile_x, cast(sum(v) as bigint) as total from px group by 1, 2) select l_orderkey * 10 + l_linenumber as id, tile_y, tile_x, total from lineitem join t on tile_y = l_orderkey % 60 // 16 and tile_x = l_partkey % 80 // 16", "px"))
def point_tiles(spark, d):
    tiles = I.px(spark, d).groupBy(F.expr("y div 16").alias("tile_y"), F.expr("x div 16").alias("tile_x")).agg(F.sum("v").alias("total"))
    points = I.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") % 60).alias("y"), (F.col("l_partkey") % 80).alias("x"))
    return IS.points_in_tiles(points, tiles, 16).select("id", "tile_y", "tile_x", "total")


BOXES = "select o_orderkey as id, o_custkey * 7 as y0, o_custkey * 7 + 1 + o_orderkey % 9 as y1, o_orderkey % 997 * 3 as x0, o_orderkey % 997 * 3 + o_custkey % 30 as x1 from orders"


@query(f"with b as ({BOXES}), g as (select * from b where x1 > x0) select p.id as a, q.id as b from g p join g q on p.id < q.id and p.y0 < q.y1 and q.y0 < p.y1 and p.x0 < q.x1 and q.x0 < p.x1")
def box_overlaps(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return IS.box_overlaps(I.table(spark, d, "orders").select(k.alias("id"), (c * 7).alias("y0"), (c * 7 + 1 + k % 9).alias("y1"), (k % 997 * 3).alias("x0"), (k % 997 * 3 + c % 30).alias("x1")), 16)


@query("""with t as (select l_orderkey * 10 + l_linenumber as tile, l_suppkey - 20 as y, cast(l_quantity as bigint) as h from lineitem), s as (select *, unnest(range(greatest(y, 0) // 16, (y + h - 1) // 16 + 1)) as strip from t where h > 0 and y + h > 0)
select strip, tile, greatest(y, strip * 16) as first, least(y + h, strip * 16 + 16) as last from s""")
def strip_tiles(spark, d):
    tiles = I.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tile"), (F.col("l_suppkey") - 20).alias("y"), F.col("l_quantity").cast("long").alias("h"))
    return IS.strips_of_tiles(tiles, 16)


PAIRS = "select a.mask as a, b.mask as b, count(*) as n from masks a join masks b on a.y = b.y and a.x = b.x and a.mask < b.mask group by 1, 2"


@query(sql(PAIRS, "masks"))
def mask_overlaps(spark, d):
    return IS.mask_overlaps(_masks(spark, d))


@query(sql(f", p as (select * from ({PAIRS}) where n >= 4), e as (select a, b from p union all select b, a from p), r as (select distinct mask as root, mask as node from masks union select r.root, e.b from r join e on e.a = r.node), c as (select node, min(root) as comp from r group by 1) select node as mask, dense_rank() over (order by comp) as island from c", "masks", recursive=True))
def component_islands(spark, d):
    return IS.islands(_masks(spark, d), 4)


@query("select o_orderkey, o_totalprice, o_orderpriority from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 25")
def worst_records(spark, d):
    return IS.worst(I.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), 25, F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey"))


# ---------------------------------------------------------------- stitching


@query(sql(""", ok as (select src, dst from we where not fallback and overlap > 0 and score >= 0.9 and fg_px >= 100 and fg_frac >= 0.02), e as (select we.*, ok.src is not null as ok from we left join ok on ok.src = we.src and ok.dst = we.dst), n as (select src as tile, w, overlap, ok from e union all select dst, w, overlap, ok from e),
t as (select tile, count(*) filter (ok) as valid, round(coalesce(sum(w) filter (ok), 0), 6) as support, round(coalesce(sum(greatest(overlap, 0)) filter (ok), 0), 6) as overlap, count(*) as degree from n group by 1)
select tile, valid, support, overlap, degree from t order by valid desc, support desc, overlap desc, degree desc, tile * 37 % 11 desc, tile limit 1""", "we"))
def seed_tile(spark, d):
    from .catalog import _weighted

    tiles = spark.range(30).select(F.col("id").alias("tile"), F.expr("id div 6").alias("gy"), F.expr("id % 6").alias("gx"), (F.col("id") * 37 % 11).alias("fg"))
    return ST.best_seed(tiles, I.edges(spark, d).join(_weighted(spark, d).select("src", "dst", "w"), ["src", "dst"]))


@query("select l_orderkey as image, l_returnflag as axis, l_partkey as src, l_suppkey as dst, l_quantity as fg, row_number() over (partition by l_orderkey order by l_quantity desc, l_returnflag, l_partkey, l_suppkey) as place from lineitem")
def ordered_pairs(spark, d):
    return ST.ordered_pairs(I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("axis"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("fg")))


@query("""with e as (select l_orderkey as image, l_returnflag as axis, l_partkey * 10000 + l_suppkey as place, max(l_quantity) as overlap from lineitem where l_suppkey % 10 <> 3 group by 1, 2, 3)
select image, axis, place, round((sum(overlap) over w + 1e2) / (count(*) over w + 1), 6) as mean from e window w as (partition by image, axis order by place rows unbounded preceding)""")
def running_overlap(spark, d):
    overlap = F.when(F.col("l_suppkey") % 10 != 3, F.col("l_quantity")).otherwise(float("nan"))
    rows = I.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("axis"), (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("place"))
    return ST.running_overlap(rows.agg(F.max(overlap).alias("overlap")), 2000)


SPOTS = "select s_suppkey as tile, s_suppkey // 10 as gy, s_suppkey % 10 as gx, s_suppkey // 10 * 91e0 + s_suppkey % 7 as y, s_suppkey % 10 * 88e0 - s_suppkey % 5 as x, s_suppkey % 10 = 0 and s_suppkey // 10 % 3 = 0 as placed from supplier"
ROUNDS = 14


def _fill_sql() -> str:
    parts = [f"t as ({SPOTS}), r0 as (select tile, gy, gx, y, x, 0 as round from t where placed)"]
    for k in range(1, ROUNDS):
        parts.append(f"""r{k} as materialized (select * from r{k - 1} union all select t.tile, t.gy, t.gx, avg(p.y + (t.gy - p.gy) * 9e1), avg(p.x + (t.gx - p.gx) * 8.5e1), {k} from t join r{k - 1} p on abs(t.gy - p.gy) + abs(t.gx - p.gx) = 1 where t.tile not in (select tile from r{k - 1}) group by 1, 2, 3)""")
    return "with " + ", ".join(parts) + f" select tile, round(y, 6) as y, round(x, 6) as x, cast(round as bigint) as round from r{ROUNDS - 1}"


@query(_fill_sql())
def interpolate_unplaced(spark, d):
    k = F.col("s_suppkey")
    rows = I.table(spark, d, "supplier").select(k.alias("tile"), F.expr("s_suppkey div 10").alias("gy"), (k % 10).alias("gx"), (F.expr("s_suppkey div 10") * 91.0 + k % 7).alias("y"), (k % 10 * 88.0 - k % 5).alias("x"))
    placed = rows.where("gx = 0 and gy % 3 = 0").select("tile", "y", "x")
    return ST.interpolate_unplaced(rows.select("tile", "gy", "gx"), placed, 90.0, 85.0).select("tile", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"), "round")


def _texture(y, x):
    """A value of each place of a plane without end."""
    return F.pmod(F.xxhash64(F.floor(y / 2).cast("long"), F.floor(x / 2).cast("long")), F.lit(60_000)) + 500


SIDE = 64


def _strip_tiles(spark, d):
    """For each supplier two tiles cut from one texture, the second ``SIDE - overlap`` further on, right or below."""
    s = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    s = s.withColumn("axis", F.when(F.col("k") % 2 == 0, "x").otherwise("y")).withColumn("overlap", 5 + F.col("k") % 7)
    both = s.withColumn("first", F.explode(F.array(F.lit(True), F.lit(False))))
    far = F.when(F.col("first"), 0).otherwise(SIDE - F.col("overlap"))
    both = both.withColumn("oy", F.when(F.col("axis") == "x", 0).otherwise(far)).withColumn("ox", F.when(F.col("axis") == "x", far).otherwise(0))
    pixels = both.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    return s, pixels.select((F.col("k") * 2 + F.when(F.col("first"), 0).otherwise(1)).alias("tile"), "y", "x", _texture(F.col("y") + F.col("oy"), F.col("x") + F.col("ox") + F.col("k") * 1000).alias("v"))


@query("select case when s_suppkey % 2 = 0 then 'x' else 'y' end as axis, s_suppkey * 2 as src, s_suppkey * 2 + 1 as dst, case when s_suppkey % 2 = 0 then 0e0 else 59e0 - s_suppkey % 7 end as dy, case when s_suppkey % 2 = 0 then 59e0 - s_suppkey % 7 else 0e0 end as dx, false as fallback from supplier")
def strip_pair(spark, d):
    """The planted place of the second tile of each pair is found."""
    s, tiles = _strip_tiles(spark, d)
    pairs = s.select("axis", (F.col("k") * 2).alias("src"), (F.col("k") * 2 + 1).alias("dst"))
    return ST.neighbour_estimates(tiles, pairs, SIDE, SIDE, 1000.0, least_px=4).select("axis", "src", "dst", (F.round("dy") + 0.0).alias("dy"), (F.round("dx") + 0.0).alias("dx"), "fallback")


# Small tiles of whole numbers: every candidate overlap, its shift by circular correlation, cost and correlation, are computed in SQL too.
EDGE = 16
VALUE = "((y + oy) * (y + oy) * 31 + (x + ox) * (x + ox) * 17 + (y + oy) * (x + ox) * 7 + k * 13) % 251"
STRIPS = f"""with s as (select s_suppkey as k, 3 + s_suppkey % 2 as true_overlap, s_suppkey % 3 - 1 + 4 as aside from supplier), o as (select unnest(range(3, 5)) as n),
a as (select k, n, y, x - ({EDGE} - n) as x, ({VALUE.replace('oy', '4').replace('ox', '0')}) as v from s, o, range({EDGE}) r(y), range({EDGE}) c(x) where x >= {EDGE} - n),
b as (select k, n, y, x, ({VALUE.replace('oy', 'aside').replace('ox', f'({EDGE} - true_overlap)')}) as v from s, o, range({EDGE}) r(y), range({EDGE}) c(x) where x < n),
lag as (select a.k, a.n, (a.y - b.y + {EDGE}) % {EDGE} as dy, (a.x - b.x + a.n) % a.n as dx, sum(a.v * b.v) as c from a join b on a.k = b.k and a.n = b.n group by 1, 2, 3, 4),
peak as (select k, n, arg_max(dy, (c, -dy, -dx)) as dy, arg_max(dx, (c, -dy, -dx)) as dx from lag group by 1, 2), far as (select k, n, case when dy > {EDGE // 2} then dy - {EDGE} else dy end as dy, case when dx > n // 2 then dx - n else dx end as dx from peak),
met as (select a.k, a.n, f.dy, f.dx, a.v as v, coalesce(b.v, 0) as w from a join far f on f.k = a.k and f.n = a.n left join b on b.k = a.k and b.n = a.n and b.y = a.y - f.dy and b.x = a.x - f.dx),
sums as (select k, n, dy, dx, count(*) as m, sum(v) as sa, sum(w) as sb, sum(v * v) as saa, sum(w * w) as sbb, sum(v * w) as sab, count(*) filter (v > 125 and w > 125) as common from met group by 1, 2, 3, 4),
cost as (select k, n as overlap, cast(dy as double) as cross_, cast(dx as double) as along, cast(common as bigint) as common, round((m * sab::double - sa::double * sb) / sqrt((m * saa::double - sa::double * sa) * (m * sbb::double - sb::double * sb)), 6) as score, abs(dx) + 0.25e0 * abs(dy) + case when common = 0 then 1e6 else 0 end as cost from sums)"""


def _whole_tiles(spark, d):
    s = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    both = s.withColumn("first", F.explode(F.array(F.lit(True), F.lit(False))))
    oy, ox = F.when(F.col("first"), 4).otherwise(F.col("k") % 3 - 1 + 4), F.when(F.col("first"), 0).otherwise(EDGE - 3 - F.col("k") % 2)
    rows = both.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(EDGE - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(EDGE - 1))))
    y, x = F.col("y") + oy, F.col("x") + ox
    tiles = rows.select((F.col("k") * 2 + F.when(F.col("first"), 0).otherwise(1)).alias("tile"), "y", "x", ((y * y * 31 + x * x * 17 + y * x * 7 + F.col("k") * 13) % 251).alias("v"))
    return tiles, s.select(F.lit("x").alias("axis"), (F.col("k") * 2).alias("src"), (F.col("k") * 2 + 1).alias("dst"))


@query(f"{STRIPS} select k * 2 as src, overlap, cross_ as cross, along, common, score, cost from cost")
def strip_candidates(spark, d):
    """Every overlap that is tried, with its shift, common foreground, correlation and cost."""
    got = ST.candidate_costs(*_whole_tiles(spark, d), EDGE, EDGE, 125.0, least_px=3, upsample=1)
    return got.select("src", "overlap", (F.col("cross") + 0.0).alias("cross"), (F.col("along") + 0.0).alias("along"), "common", F.round("score", 6).alias("score"), "cost")


@query(f"""{STRIPS}, best as (select *, row_number() over (partition by k order by round(cost, 6), score desc, overlap) as r from cost)
select k * 2 as src, cross_ as dy, 16e0 - overlap + along as dx, overlap - along as overlap, score, cast(common as double) as fg_px from best where r = 1""")
def strip_estimates(spark, d):
    """The overlap of least cost and the step that it gives."""
    got = ST.neighbour_estimates(*_whole_tiles(spark, d), EDGE, EDGE, 125.0, least_px=3, upsample=1)
    return got.select("src", (F.col("dy") + 0.0).alias("dy"), "dx", "overlap", F.round("score", 6).alias("score"), "fg_px")


# ---------------------------------------------------------------- touch-up


@query(sql(f", t as ({ORACLES['otsu_threshold']}), m as (select y, x from px where v > (select threshold from t)) select distinct y + a as y, x + b as x from m, (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(a, b) where y + a between 0 and 47 and x + b between 0 and 63", "px"))
def foreground_mask(spark, d):
    limit = A.otsu(I.px(spark, d)).select(F.round("threshold", 6).alias("threshold"))  # one row
    mask = I.px(spark, d).crossJoin(F.broadcast(limit)).where("v > threshold")
    return N.dilate(mask, N.CROSS, H, W)


@query(sql("select ty, tx, count(*) as n, cast(sum(v) as bigint) as total from (select y // 8 as ty, x // 8 as tx, v, v % 5 < 2 as m, count(*) filter (v % 5 < 2) over (partition by y // 8, x // 8) as held from px) where m or held < 27 group by 1, 2", "px"))
def score_mask(spark, d):
    rows = I.px(spark, d).select(F.expr("y div 8").alias("ty"), F.expr("x div 8").alias("tx"), "v", (F.col("v") % 5 < 2).alias("m"))
    return T.score_mask(rows, ["ty", "tx"], least=27).groupBy("ty", "tx").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(sql("select q.y // 16 as tile_y, q.x // 16 as tile_x, count(*) as n, count(*) >= 1024 as trusted from quarters q join px on px.y = q.y and px.x = q.x where px.v % 2 = 0 group by 1, 2", "quarters"))
def signal_pixels(spark, d):
    return T.signal_pixels(_quarters(spark, d), I.px(spark, d).where("v % 2 = 0"), 16)


@query("""with t as (select l_orderkey * 10 + l_linenumber as tile, l_suppkey % 100 / 1e2 as base, case when l_partkey % 50 = 7 then null else l_partkey % 97 / 1e2 end as corr, l_partkey % 4000 as signal from lineitem)
select tile, case when signal < 1024 then 'abstain' when base >= 0.95e0 then 'stable' when corr is null then 'rejected' when corr - base >= 0.01e0 and corr >= 0.5e0 then 'accepted' else 'rejected' end as state from t""")
def acceptance_gates(spark, d):
    rows = I.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tile"), (F.col("l_suppkey") % 100 / 100.0).alias("base"), F.when(F.col("l_partkey") % 50 != 7, F.col("l_partkey") % 97 / 100.0).alias("corr"), (F.col("l_partkey") % 4000).alias("signal"))
    return rows.select("tile", T.gate(F.col("base"), F.col("corr"), F.col("signal")).alias("state"))


# Tiles of sums of waves; a quarter of them against noise of whole numbers.
WAVE = "sin(({y}) / 2e0) * 900 + cos(({x}) / 2.5e0 + ({y}) / 4.5e0) * 700 + sin(({x}) / 1.5e0) * 300 + 4000"
TOUCH = f"""with g as (select s_suppkey as k, y, x, {WAVE.format(y='y', x='x')} as a, case when s_suppkey % 4 = 3 then (y * y * 7 + x * x * 13 + y * x * 5 + s_suppkey * 3) % 5003 * 1e0 else {WAVE.format(y='y + s_suppkey % 7 - 3', x='x + s_suppkey % 5 - 2')} end as b, y between 5 and 18 and x between 5 and 18 as m from supplier, range(24) r(y), range(24) c(x)),
q as (select k, quantile_cont(a, 0.01e0) as a1, quantile_cont(a, 0.99e0) as a9, quantile_cont(b, 0.01e0) as b1, quantile_cont(b, 0.99e0) as b9 from g group by 1),
n as (select g.k, y, x, m, least(greatest((a - a1) / (a9 - a1), 0), 1) as a, least(greatest((b - b1) / (b9 - b1), 0), 1) as b from g join q on q.k = g.k),
s as (select f.k, u.dy, t.dx, corr(f.a, v.b) as c from n f, range(-4, 5) u(dy), range(-4, 5) t(dx), n v where f.m and v.k = f.k and v.y = f.y - u.dy and v.x = f.x - t.dx group by 1, 2, 3),
best as (select *, row_number() over (partition by k order by round(c, 9) desc, dy * dy + dx * dx, dy, dx) as r, max(case when dy = 0 and dx = 0 then c end) over (partition by k) as base from s),
ok as (select *, c > base + 1e-6 and c - base >= 0.01e0 and c >= 0.5e0 as ok from best where r = 1)
select k as tile, case when ok then dy else 0 end * 1e0 as dy, case when ok then dx else 0 end * 1e0 as dx, round(base, 6) as base, round(c, 6) as corr, ok as accepted from ok"""


@query(TOUCH)
def rigid_touchup(spark, d):
    """Planted shifts are found and accepted; where the moving tile is noise, or lies right, nothing is."""
    n = 24
    wave = lambda y, x: F.sin(y / 2.0) * 900 + F.cos(x / 2.5 + y / 4.5) * 700 + F.sin(x / 1.5) * 300 + 4000
    rows = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t, y, x = F.col("tile"), F.col("y"), F.col("x")
    # moving[y, x] = fixed[y + dy, x + dx]: shifting it by (dy, dx) brings it back.
    noise = ((y * y * 7 + x * x * 13 + y * x * 5 + t * 3) % 5003).cast("double")
    rows = rows.select("tile", "y", "x", wave(y, x).alias("a"), F.when(t % 4 == 3, noise).otherwise(wave(y + t % 7 - 3, x + t % 5 - 2)).alias("b"), ((y >= 5) & (y < n - 5) & (x >= 5) & (x < n - 5)).alias("m"))
    got = T.rigid_touchup(rows, n, 4)
    return got.select("tile", (F.col("dy") + 0.0).alias("dy"), (F.col("dx") + 0.0).alias("dx"), F.round("base", 6).alias("base"), F.round("corr", 6).alias("corr"), "accepted")


REFINE = """, f as (select label as region, q.y, q.x, px.v from quarters q join px on px.y = q.y and px.x = q.x), m as (select y + 1 as y, x - 1 as x, v from px),
s as (select region, dy, dx, count(*) as n, cast(sum(f.v) as bigint) as sa, cast(sum(m.v) as bigint) as sb, cast(sum(f.v * f.v) as bigint) as saa, cast(sum(m.v * m.v) as bigint) as sbb, cast(sum(f.v * m.v) as bigint) as sab from f, m, range(-2, 3) u(dy), range(-2, 3) t(dx) where f.y = m.y + u.dy and f.x = m.x + t.dx group by 1, 2, 3),
c as (select region, dy, dx, round((n * sab::double - sa::double * sb) / sqrt((n * saa::double - sa::double * sa) * (n * sbb::double - sb::double * sb)), 9) as corr from s),
b as (select *, row_number() over (partition by region order by corr desc, dy * dy + dx * dx, dy, dx) as k, max(case when dy = 0 and dx = 0 then corr end) over (partition by region) as base from c)
select region, dy, dx, base, corr from b where k = 1"""


@query(sql(REFINE, "quarters"))
def refine_regions(spark, d):
    """Each quarter's shift back to where its moving plane came from."""
    fixed = I.px(spark, d).join(_quarters(spark, d), ["y", "x"]).select(F.col("label").alias("region"), "y", "x", "v")
    moving = I.px(spark, d).select((F.col("y") + 1).alias("y"), (F.col("x") - 1).alias("x"), "v")
    return T.refine_regions(fixed, moving, 2, H, W)


@query(sql("select y, x, round(sy / w, 9) + 0e0 as dy, round(sx / w, 9) + 0e0 as dx, round(sqrt((sy / w) ** 2 + (sx / w) ** 2), 9) as mag, round(log10(w), 9) as log_w from (select y // 6 as y, x // 6 as x, sum(w) as w, sum(dy * w) as sy, sum(dx * w) as sx from (select y, x, (v % 17 - 8) * 1e0 as dy, (v % 13 - 6) * 1e0 as dx, v % 10 / 1e1 as w from px) group by 1, 2) where w > 1e-5", "px"))
def field_preview(spark, d):
    v = F.col("v")
    return T.field_preview(I.px(spark, d).select("y", "x", (v % 17 - 8).cast("double").alias("dy"), (v % 13 - 6).cast("double").alias("dx"), (v % 10 / 10.0).alias("w")), 6)


def _crop_sql(y0: int, y1: int, x0: int, x1: int, parts: list[tuple[int, int, float]]) -> str:
    terms = " union all ".join(f"select y + {a} as y, x + {b} as x, v * {w!r}::double as v from px" for a, b, w in parts)
    return sql(f", p as (select y, x, sum(v) as v from ({terms}) group by 1, 2) select g.y, h.x, coalesce(round(p.v, 6), 0e0) as v from range({y0}, {y1}) g(y) cross join range({x0}, {x1}) h(x) left join p on p.y = g.y and p.x = h.x", "px")


@query(_crop_sql(-5, 20, 30, 70, [(3, -7, 1.0)]))
def translated_crop(spark, d):
    return T.crop(I.px(spark, d), (-5, 20, 30, 70), 3.0, -7.0).withColumn("v", F.round("v", 6))


@query(_crop_sql(10, 40, -3, 30, [(2, -4, 0.375), (2, -3, 0.375), (3, -4, 0.125), (3, -3, 0.125)]))
def relocated_read(spark, d):
    return T.crop(I.px(spark, d), (10, 40, -3, 30), 2.25, -3.5).withColumn("v", F.round("v", 6))


# ---------------------------------------------------------------- label edits


def _erase_split(parts: str) -> str:
    """SQL that gives the parts of touched labels numbers of their own, from ``left(y, x, label)`` and ``touched(label)``."""
    return f"""{parts}, work as (select l.* from left_ l join touched t on t.label = l.label), reach as (select y, x, label, y * 64 + x as root from work union select f.y, f.x, f.label, r.root from reach r join work f on f.label = r.label and abs(f.y - r.y) + abs(f.x - r.x) = 1), part as (select y, x, label, min(root) as part from reach group by 1, 2, 3),
size as (select label, part, row_number() over (partition by label order by count(*) desc, part) as k from part group by 1, 2), made as (select label, part, (select max(label) from left_) + row_number() over (order by label, k) as new from size where k > 1)
select p.y, p.x, coalesce(new, p.label) as label from part p left join made m on m.label = p.label and m.part = p.part union all select y, x, label from left_ l where label not in (select label from touched)"""


@query(sql(_erase_split(", shape as (select y, x from px where y % 6 = 2 or x % 7 = 3), touched as (select distinct c.label from cells c join shape s on s.y = c.y and s.x = c.x), left_ as (select y, x, label from cells c where not exists (select 1 from shape s where s.y = c.y and s.x = c.x))"), "cells", recursive=True))
def erase_split(spark, d):
    return E.erase_and_split(I.cells(spark, d), I.px(spark, d).where("y % 6 = 2 or x % 7 = 3").select("y", "x"), H, W)


@query(sql(_erase_split(", sel as (select y, x from quarters where label = 2), kept as (select y + a as y, x + b as x from sel, (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(a, b) group by 1, 2 having count(*) = 5), touched as (select 2 as label), left_ as (select y, x, label from quarters where label <> 2 union all select y, x, 2 from kept)"), "quarters", recursive=True))
def erode_split(spark, d):
    return E.erode_and_split(_quarters(spark, d), 2, 1, H, W)


@query(sql(", n as (select y, x, case when (y + x) % 3 = 0 then 0 when (y + x) % 3 = 1 then label + 100 else label end as new from cells) select y, x, new as label from n where new > 0 union all select 100, x, 7 from range(4) t(x)", "cells"))
def apply_edits(spark, d):
    base, k = I.cells(spark, d), (F.col("y") + F.col("x")) % 3
    changed = base.where(k < 2).select("y", "x", F.when(k == 0, 0).otherwise(F.col("label") + 100).cast("long").alias("new"))
    drawn = spark.range(4).select(F.lit(100).cast("long").alias("y"), F.col("id").alias("x"), F.lit(7).cast("long").alias("new"))
    return E.apply_changes(base, changed.unionByName(drawn))
