"""Queries of the report on a touch-up, with SQL that scores every shift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as DG
from . import inputs as I
from .catalog import query
from .stitching import TOUCH

SIDE, BOUNDS, MIDDLE = 24, (1, 2, 4), 2

# The scores of all shifts, as the SQL of the touch-up has them, and what follows.
_SCORES = TOUCH[: TOUCH.index("best as (")]
_SWEEP = f"""{_SCORES}bd as (select s.*, bound from s, (values {', '.join(f'({b})' for b in BOUNDS)}) v(bound) where abs(dy) <= bound and abs(dx) <= bound),
rk as (select *, row_number() over (partition by k, bound order by round(c, 9) desc, dy * dy + dx * dx, dy, dx) as r, max(case when dy = 0 and dx = 0 then c end) over (partition by k, bound) as base from bd),
mv as (select *, c > base + 1e-6 as moved from rk where r = 1),
sw as (select cast(k as bigint) as tile, cast(bound as bigint) as bound, cast(case when moved then dy else 0 end as bigint) as dy, cast(case when moved then dx else 0 end as bigint) as dx, round(base, 6) as base, round(case when moved then c else base end, 6) as corr from mv),
sweep as (select tile, bound, dy, dx, round(sqrt(dy * dy + dx * dx), 6) as mag, base, corr, round(corr - base, 6) as gain, greatest(abs(dy), abs(dx)) = bound as hit from sw)"""
_FINAL = "fin as (select cast(s_suppkey as bigint) as tile, cast(s_suppkey // 10 * 24 as bigint) as y0, cast(s_suppkey % 10 * 24 as bigint) as x0, case when c % 7 > 0 then c % 100 / 1e2 end as final from (select *, cast(floor(abs(s_acctbal) * 100) as bigint) as c from supplier))"
_TILES = f"""{_SWEEP}, {_FINAL},
top as (select *, row_number() over (partition by tile order by corr desc, bound) as r from sweep), mid as (select tile, hit, corr as held from sweep where bound = {MIDDLE}),
tl as (select top.tile, top.bound, top.dy, top.dx, top.mag, top.corr, top.gain, top.base, final, mid.hit, top.bound > {MIDDLE} and top.corr >= held + 0.05e0 as beyond, top.base >= 0.95e0 as skipped, y0, x0 from top join mid on mid.tile = top.tile join fin on fin.tile = top.tile where r = 1),
tiles as (select *, case when final >= 0.8e0 then 'well_registered' when hit or beyond then 'rigid_bound_limited' when skipped and final < 0.6e0 then 'skipped_incorrectly_suspect' when corr < base + 0.05e0 then 'upstream_rigid_or_low_texture_suspect' else 'elastic_or_blending_suspect' end as kind from tl)"""
_SEAMS = f"""{_TILES}, sd as (select t.tile, v.side, round(sqrt((t.dy - o.dy) ** 2 + (t.dx - o.dx) ** 2), 6) as jump, round(abs(t.final - o.final), 6) as delta from tiles t, (values ('right', 0, {SIDE}), ('down', {SIDE}, 0)) v(side, a, b), tiles o where o.y0 = t.y0 + v.a and o.x0 = t.x0 + v.b),
seams as (select *, jump >= 4 and coalesce(delta >= 0.15e0, true) as suspect from sd)"""


def _sweep(spark, d):
    """Tiles of waves moved by up to three pixels, a quarter of them against noise."""
    wave = lambda y, x: F.sin(y / 2.0) * 900 + F.cos(x / 2.5 + y / 4.5) * 700 + F.sin(x / 1.5) * 300 + 4000
    t, y, x = F.col("tile"), F.col("y"), F.col("x")
    rows = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    noise = ((y * y * 7 + x * x * 13 + y * x * 5 + t * 3) % 5003).cast("double")
    rows = rows.select("tile", "y", "x", wave(y, x).alias("a"), F.when(t % 4 == 3, noise).otherwise(wave(y + t % 7 - 3, x + t % 5 - 2)).alias("b"), ((y >= 5) & (y < SIDE - 5) & (x >= 5) & (x < SIDE - 5)).alias("m"))
    return DG.bound_sweep(rows, SIDE, list(BOUNDS))


def _tiles(spark, d):
    cents = F.floor(F.abs("s_acctbal") * 100).cast("long")
    final = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile"), (F.expr("s_suppkey div 10") * SIDE).alias("y0"), (F.col("s_suppkey") % 10 * SIDE).alias("x0"), F.when(cents % 7 > 0, cents % 100 / 100.0).alias("final"))
    return DG.diagnose(_sweep(spark, d), final, pivot=MIDDLE).join(final.select("tile", "y0", "x0"), "tile")


def _seams(tiles):
    return DG.suspect_seams(tiles, SIDE, jump=4.0)


@query(_SWEEP + " select * from sweep")
def bound_sweep(spark, d):
    """The best shift of every tile within each of three bounds."""
    return _sweep(spark, d)


@query(_TILES + " select * from tiles")
def diagnosed_tiles(spark, d):
    return _tiles(spark, d)


@query(_SEAMS + " select * from seams")
def suspect_seams(spark, d):
    return _seams(_tiles(spark, d))


@query(_TILES + " select tile, kind, mag, gain from tiles order by kind <> 'rigid_bound_limited', round(coalesce(corr - final, gain), 6) desc, mag desc, tile limit 10")
def worst_tiles(spark, d):
    """The ten tiles that the report shows first."""
    return DG.worst_first(_tiles(spark, d), 10).select("tile", "kind", "mag", "gain")


@query(f"""{_TILES}, cv as (select max(y0) // {SIDE} + 1 as h from fin), gr as (select y, x from (select unnest(range(h)) as y from cv), range(10) t(x)),
ev as (select gr.y, gr.x, coalesce(mag, 0e0) as r, greatest(coalesce(gain, 0e0), 0e0) as g, coalesce(bound, 0) * 1e0 as b from gr left join tiles on y0 // {SIDE} = gr.y and x0 // {SIDE} = gr.x),
li as (select {', '.join(f'quantile_cont({c}, 0.01e0) as {c}1, quantile_cont({c}, 0.995e0) as {c}9' for c in 'rgb')} from ev)
select y, x, {', '.join(f'cast(round_even(least(greatest(round(({c} - {c}1) / (case when {c}9 > {c}1 then {c}9 - {c}1 else 1e0 end), 9), 0e0), 1e0) * 255, 0) as bigint) as {n}' for c, n in zip('rgb', ('red', 'green', 'blue')))} from ev, li""")
def residual_heat_map(spark, d):
    """Distance, gain and bound of all tiles as bands of one image."""
    top = I.table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] or 0
    return DG.heat_map(_tiles(spark, d), (top // 10 + 1) * SIDE, 10 * SIDE, SIDE)


@query(_SEAMS + " select kind as what, count(*) as n from tiles group by 1 union all select 'tiles', count(*) from tiles union all select 'pairs', count(*) from seams union all select 'suspect pairs', count(*) filter (suspect) from seams")
def touchup_summary(spark, d):
    """Counts of the whole report; the diagnosis is computed once and kept in the shared folder."""
    from ..scratch import Steps

    tiles = Steps(spark, "diagnosis").save(_tiles(spark, d))
    return DG.summary(tiles, _seams(tiles))
