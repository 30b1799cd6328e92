"""What fills of the feature store compute, with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..scratch import Steps
from ..sources import bigtiff as B
from ..sources import features as S
from . import inputs as I
from .catalog import query, sql

SIZE, WIDTH = 32, 64
# Three fills of one image: two scales, one of them changed, and then limits for channel 1 alone.
RUNS = (S.Recipe((0.7, 1.6), SIZE), S.Recipe((0.7, 2.5), SIZE), S.Recipe((0.7, 2.5), SIZE, ((1, 0.0, 60000.0),)))


@query(sql(f""", t as (select channel, y // {SIZE} as ty, x // {SIZE} as tx, count(*) as n from plane group by 1, 2, 3),
r as (select unnest([{{'run': 0, 'sigma': 0.7e0, 'c': -1}}, {{'run': 0, 'sigma': 1.6e0, 'c': -1}}, {{'run': 1, 'sigma': 2.5e0, 'c': -1}}, {{'run': 2, 'sigma': 0.7e0, 'c': 1}}, {{'run': 2, 'sigma': 2.5e0, 'c': 1}}]) as r)
select cast(r.run as bigint) as run, cast(channel as bigint) as channel, cast(r.sigma as double) as sigma, count(*) as tiles, cast(sum(n) as bigint) as pixels from t join r on r.c < 0 or r.c = channel group by 1, 2, 3""", "plane"))
def feature_fills(spark, d):
    """Tiles and pixels that each of three fills computes, by channel and scale, as the store holds them after it."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    items = I.table(spark, d, "lineitem")
    height = (items.agg(F.max("l_suppkey")).first()[0] or 0) + 1
    pixels = items.groupBy(flag.alias("channel"), F.col("l_suppkey").alias("y"), (F.col("l_partkey") % WIDTH).alias("x")).agg((F.sum(F.col("l_quantity").cast("bigint")) * 37 % 65536).alias("v"))
    steps = Steps(spark, "features", keep_all=True)
    tiles = steps.save(B.tiles_of(pixels, B.Layout(3, height, WIDTH, "uint16", SIZE, 1, ("A", "N", "R"))))
    store, key, told = S.FeatureStore(spark, f"{steps.path}/store"), S.image_key(tiles), []
    for k, recipe in enumerate(RUNS):
        lacking = steps.save(store.missing(tiles, key, recipe))
        store.fill(tiles, key, recipe)
        whole = reduce(lambda a, b: a.unionByName(b), [store.read(key, recipe, c, s).select(F.lit(recipe.key(s, c)).alias("recipe"), F.lit(c).alias("channel"), "ty", "tx", (F.col("h") * F.col("w")).alias("px")) for c in range(3) for s in recipe.sigmas])
        told.append(lacking.join(whole, S.KEY).groupBy(F.lit(k).alias("run"), "channel", "sigma").agg(F.count("*").alias("tiles"), F.sum("px").alias("pixels")))
    return reduce(lambda a, b: a.unionByName(b), told)
