"""Queries of discovery, plans and their checks, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery as D
from . import inputs as I
from .catalog import query

# ---------------------------------------------------------------- derived tables

FILES = """select p_brand as sample, 'C' || p_size || '_' || p_type as folder,
case p_partkey % 4 when 0 then 'area_s1_' || p_partkey || '_' || p_size || '.ome.tiff' when 1 then 'C' || p_size || '_merged_' || p_type || '.ome.tif' when 2 then 'c' || p_partkey % 9 || '_' || p_type || '.OME.TIFF' else 'area_notes.ome.tif' end as name from part"""


def _files(spark, d):
    key = F.col("p_partkey")
    name = (
        F.when(key % 4 == 0, F.concat(F.lit("area_s1_"), key, F.lit("_"), "p_size", F.lit(".ome.tiff"))).when(key % 4 == 1, F.concat(F.lit("C"), "p_size", F.lit("_merged_"), "p_type", F.lit(".ome.tif")))
        .when(key % 4 == 2, F.concat(F.lit("c"), key % 9, F.lit("_"), "p_type", F.lit(".OME.TIFF"))).otherwise("area_notes.ome.tif")
    )
    return I.table(spark, d, "part").select(F.col("p_brand").alias("sample"), F.concat(F.lit("C"), "p_size", F.lit("_"), "p_type").alias("folder"), name.alias("name"))


TILES = f"select sample, folder, count(*) as n_tiles from ({FILES}) where regexp_matches(name, '(?i)^(?:area|raw)_.*_(\\d+)_(\\d+)\\.ome\\.tiff?$') group by 1, 2"
STITCHED = f"""select *, row_number() over (partition by sample order by cycle, lower(path), path) as place from
(select distinct sample, cast(regexp_extract(name, '^[Cc]([0-9]+)_', 1) as bigint) as cycle, sample || '/' || folder || '/' || name as path from ({FILES}) where regexp_matches(lower(name), '\\.ome\\.tiff?$') and not starts_with(lower(name), 'area_') and regexp_matches(name, '^[Cc]([0-9]+)_'))"""


@query(TILES)
def sample_cycles(spark, d):
    return D.cycles_with_tiles(_files(spark, d))


@query(STITCHED)
def stitched_files(spark, d):
    return D.stitched_files(_files(spark, d))


@query(f"select sample, count(*) as n_cycles, string_agg(cast(cycle as varchar), ',' order by place) as cycles, 'out/' || sample || '.ome.tiff' as output_path from ({STITCHED}) group by 1")
def sample_scan(spark, d):
    return D.scan_samples(_files(spark, d), "out")


@query(f"select sample, count(*) as n_cycles, round(avg(n_tiles), 6) as mean_tiles from ({TILES}) group by 1")
def stitch_scan(spark, d):
    return D.scan_for_stitching(_files(spark, d))


@query(f"""select sample, cycle, case when n = 1 then first end as path, case when coalesce(n, 0) = 0 then 'no stitched file' when n > 1 then 'more than one stitched file' end as problem
from (select distinct p_brand as sample, cast(p_size as bigint) as cycle from part) left join (select sample, cycle, count(*) as n, min(path) as first from ({STITCHED}) group by 1, 2) using (sample, cycle)""")
def sample_record(spark, d):
    asked = I.table(spark, d, "part").select(F.col("p_brand").alias("sample"), F.col("p_size").cast("long").alias("cycle")).distinct()
    return D.sample_records(_files(spark, d), asked)


PLANS = """select o_orderkey as plan, case when o_orderkey % 13 = 0 then '{"schema_version": 1, "samples": [' else '{"schema_version":' || o_orderkey % 3 || ',"defaults":{"tile_size":' || o_custkey % 5 * 100 || ',"iterations":' || o_custkey % 2 || '},"samples":[{"name":"' || o_orderstatus || '","tile_size":' || o_orderkey % 4 * 90
|| ',"workers":' || o_orderkey % 6 || '},{"enabled":false,"sample_count":' || o_custkey % 7 || '}]}' end as body from orders"""


def _plans(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    body = F.concat(F.lit('{"schema_version":'), k % 3, F.lit(',"defaults":{"tile_size":'), c % 5 * 100, F.lit(',"iterations":'), c % 2, F.lit('},"samples":[{"name":"'), "o_orderstatus", F.lit('","tile_size":'), k % 4 * 90, F.lit(',"workers":'), k % 6, F.lit('},{"enabled":false,"sample_count":'), c % 7, F.lit("}]}"))
    return I.table(spark, d, "orders").select(k.alias("plan"), F.when(k % 13 == 0, '{"schema_version": 1, "samples": [').otherwise(body).alias("body"))


def _plan_sql(versions: str) -> str:
    cascade = ", ".join(f"greatest(coalesce(nullif(cast(s ->> '{n}' as bigint), 0), nullif(cast(d ->> '{n}' as bigint), 0), {last}), {least}) as {n}" for n, (last, least) in D.SETTINGS.items())
    return f"""with p as ({PLANS}), v as (select plan, cast(body as json) as j from p where json_valid(body)), e as (select plan, j -> 'defaults' as d, unnest(cast(j -> 'samples' as json[])) as s from v where cast(j ->> 'schema_version' as bigint) in ({versions}))
select plan, coalesce(s ->> 'name', '') as sample, coalesce(cast(s ->> 'enabled' as boolean), true) as enabled, {cascade} from e"""


@query(_plan_sql("1"))
def plan_defaults(spark, d):
    return D.read_plan(_plans(spark, d))


@query(_plan_sql("1, 2"))
def stitch_plan_read(spark, d):
    return D.read_plan(_plans(spark, d), "stitch")


@query(f"""select plan, '{{"schema_version":1,"samples":[' || string_agg('{{"name":"' || sample || '","enabled":' || enabled || ',"tile_size":' || tile_size || ',"sample_count":' || sample_count || ',"iterations":' || iterations || ',"workers":' || workers || '}}', ',' order by sample, enabled) || ']}}' as body from ({_plan_sql("1")}) group by 1""")
def plan_json(spark, d):
    return D.write_plan(D.read_plan(_plans(spark, d)))


@query("""with m as (select o_orderkey as path, o_orderkey % 7 = 0 as bad, o_custkey, o_orderstatus, o_orderkey from orders)
select path, 'f' || o_custkey as fingerprint, cast(2 as bigint) as n_cycles, cast(case when o_orderstatus = 'F' then 2 when o_orderstatus = 'O' then 1 else 0 end as bigint) as n_complete from m where not bad""")
def manifest_read(spark, d):
    o = I.table(spark, d, "orders")
    status = lambda done: F.when(done, "complete").otherwise("pending")
    body = F.concat(F.lit('{"fingerprint":"f'), "o_custkey", F.lit('","cycles":{"1":{"status":"'), status(F.col("o_orderstatus") != "P"), F.lit('"},"2":{"status":"'), status(F.col("o_orderstatus") == "F"), F.lit('"}}}'))
    return D.read_manifests(o.select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 7 == 0, F.substring(body, 1, 25)).otherwise(body).alias("body")))


@query("""select o_custkey as run, count(*) filter (o_orderstatus <> 'P') as n_ok, count(*) filter (o_orderstatus = 'P') as n_failed, arg_min(o_orderpriority, o_orderkey) filter (o_orderstatus = 'P') as first_error, round(sum(o_orderkey % 100 / 8e0), 6) as seconds from orders group by 1""")
def batch_results(spark, d):
    o = I.table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("error"), (F.col("o_orderkey") % 100 / 8.0).alias("seconds"), "o_orderstatus")
    return D.batch_results(o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus = 'P'"))


MARKS = "select l_orderkey as sample, cast(l_linenumber as bigint) as cycle, l_suppkey as channel, case when l_suppkey % 5 = 0 then ' dapi ' else l_returnflag || l_suppkey end as name from lineitem"


@query(f"select sample, cycle, coalesce(arg_min(name, channel) filter (upper(trim(name)) = 'DAPI'), arg_min(name, channel), 'DAPI') as marker from (select sample, cycle, channel, min(name) as name from ({MARKS}) group by 1, 2, 3) group by 1, 2")
def registration_marker(spark, d):
    name = F.when(F.col("l_suppkey") % 5 == 0, " dapi ").otherwise(F.concat("l_returnflag", F.col("l_suppkey")))
    rows = I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("cycle"), F.col("l_suppkey").alias("channel"), name.alias("name"))
    return D.registration_marker(rows.groupBy("sample", "cycle", "channel").agg(F.min("name").alias("name")), "DAPI")


@query(r"""select user_id as run, event_id as id, regexp_replace(regexp_replace('Cycle ' || event_id % 3 * 11 || ' of cycle 1, cycles 11', '\b(Cycle|cycle) 11\b', '\1 ' || 'late' || user_id % 7, 'g'), '\b(Cycle|cycle) 1\b', '\1 ' || 'early', 'g') as msg from events""")
def display_names(spark, d):
    e = I.table(spark, d, "events")
    msgs = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("id"), F.concat(F.lit("Cycle "), F.col("event_id") % 3 * 11, F.lit(" of cycle 1, cycles 11")).alias("msg"))
    runs = e.select("user_id").distinct()
    pairs = F.array(F.struct(F.lit(1).alias("cycle"), F.lit("early").alias("display")), F.struct(F.lit(11).alias("cycle"), F.concat(F.lit("late"), F.col("user_id") % 7).alias("display")))
    return D.rewrite_names(msgs, runs.select(F.col("user_id").alias("run"), F.inline(pairs)))


@query("""with t as (select p_partkey as place, p_name as file, p_brand as marker from part), n as (select file, arg_min(marker, place) as m from t group by 1)
select l_orderkey as sample, l_suppkey as place, case when l_linenumber % 2 = 0 then p_name else 'other' end as file, coalesce(n.m, q.marker) as marker from lineitem join part on p_partkey = l_partkey left join n on n.file = case when l_linenumber % 2 = 0 then p_name else 'other' end left join t q on q.place = l_suppkey""")
def template_copy(spark, d):
    part = I.table(spark, d, "part")
    rows = I.table(spark, d, "lineitem").join(part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("place"), F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise("other").alias("file"))
    return D.copy_template(rows, part.select(F.col("p_partkey").alias("place"), F.col("p_name").alias("file"), F.col("p_brand").alias("marker")))


STATES = "select c_custkey as sample, count(o_orderkey) as n_cycles, count(*) filter (o_orderstatus = 'O') as n_enabled, count(o_orderkey) - count(distinct o_orderkey % 50) as n_duplicates from customer left join orders on o_custkey = c_custkey group by 1"


@query(f"select sample, case when n_cycles = 0 then 'missing' when n_enabled = 0 or n_duplicates > 0 then 'invalid' else 'valid' end as state from ({STATES})")
def config_state(spark, d):
    rows = I.table(spark, d, "customer").join(I.table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("sample"))
    return D.config_state(rows.agg(F.count("o_orderkey").alias("n_cycles"), F.count_if(F.col("o_orderstatus") == "O").alias("n_enabled"), (F.count("o_orderkey") - F.count_distinct(F.col("o_orderkey") % 50)).alias("n_duplicates")))


@query("""with r as (select o_custkey % 500 as sample, case o_orderkey % 40 when 0 then 'two' when 1 then '-3' else ' ' || o_orderkey || ' ' end as t, case when o_orderkey % 50 = 2 then '  ' else o_orderstatus end as m, o_orderkey % 30 <> 3 as held from orders),
j as (select sample, try_cast(trim(t) as bigint) as c, trim(m) = '' as un, not held or trim(m) = '' as ab from r)
select sample, case when count(*) filter (c is null or c < 0) > 0 then 'cycle is no number' when count(c) - count(distinct c) > 0 then 'cycle comes twice' when count(*) filter (un) > 0 then 'no marker' when count(*) filter (ab) > 0 then 'marker is no channel' end as problem from j group by 1""")
def merge_validation(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 40 == 0, "two").when(k % 40 == 1, "-3").otherwise(F.concat(F.lit(" "), k, F.lit(" ")))
    marker = F.when(k % 50 == 2, "  ").otherwise(F.col("o_orderstatus"))
    channels = F.when(k % 30 != 3, F.array(F.lit("x"), F.lower("o_orderstatus"))).otherwise(F.array(F.lit("x")))
    return D.merge_problems(I.table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("sample"), text.alias("cycle_text"), marker.alias("marker"), channels.alias("channels")))


@query("""with t as (select event_id, user_id, case event_id % 6 when 0 then ' ALL ' when 1 then event_id % 90 || ':' || user_id when 2 then ':' || user_id when 3 then event_id || ':' when 4 then 'x:1' end as s, user_id % 3 || '.5, 2,x,, 2 ,' || event_id % 2 as f from events),
c as (select *, lower(trim(coalesce(s, ''))) as l from t), p as (select *, l in ('', 'auto', 'all') as w, regexp_matches(l, '^\\d*:\\d*$') as ok, try_cast(split_part(l, ':', 1) as bigint) as a, try_cast(split_part(l, ':', 2) as bigint) as b from c),
q as (select *, case when w then 0 when ok then greatest(0, least(100, coalesce(a, 0))) end as first from p)
select event_id, coalesce(first, -1) as first, coalesce(case when w then 100 when ok then greatest(first, least(100, coalesce(b, 100))) end, -1) as last, array_to_string(list_sort(list_distinct([user_id % 3 + 0.5e0, 2e0, event_id % 2 + 0e0])), ',') as bounds from q""")
def parse_ranges(spark, d):
    k = F.col("event_id")
    text = F.when(k % 6 == 0, " ALL ").when(k % 6 == 1, F.concat(k % 90, F.lit(":"), "user_id")).when(k % 6 == 2, F.concat(F.lit(":"), "user_id")).when(k % 6 == 3, F.concat(k, F.lit(":"))).when(k % 6 == 4, "x:1")
    start, end = D.parse_range(text, 100)
    floats = D.parse_floats(F.concat(F.col("user_id") % 3, F.lit(".5, 2,x,, 2 ,"), k % 2))
    return I.table(spark, d, "events").select("event_id", F.coalesce(start, F.lit(-1)).alias("first"), F.coalesce(end, F.lit(-1)).alias("last"), F.array_join(floats.cast("array<string>"), ",").alias("bounds"))


@query(f"select path, path || '.progress.json' as progress, regexp_replace(path, '(?i)\\.ome\\.tiff?$', '') || '.chunks' as store, path || '.tmp' as draft from ({STITCHED})")
def work_paths(spark, d):
    return D.stitched_files(_files(spark, d)).select("path", *[c.alias(n) for n, c in D.work_paths(F.col("path")).items()])


@query("""with f as (select o_custkey as output, 'w' || o_orderkey as folder, cast(cast(o_orderdate as date) as varchar) as changed, o_orderstatus = 'F' as finished from orders) select output, changed, min(folder) as folder from f where not finished and (output, changed) in (select (output, max(changed)) from f where not finished group by output) group by 1, 2""")
def latest_work_dir(spark, d):
    o = I.table(spark, d, "orders")
    return D.latest_resumable(o.select(F.col("o_custkey").alias("output"), F.concat(F.lit("w"), "o_orderkey").alias("folder"), F.col("o_orderdate").cast("date").cast("string").alias("changed"), (F.col("o_orderstatus") == "F").alias("finished")))


@query("select distinct l_orderkey as sample, cast(l_linenumber as bigint) as cycle from lineitem except select l_orderkey, l_linenumber from lineitem where l_linestatus = 'F'")
def remaining_cycles(spark, d):
    rows = I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("cycle"), "l_linestatus")
    return D.remaining_cycles(rows.select("sample", "cycle").distinct(), rows.where("l_linestatus = 'F'").select("sample", "cycle").distinct())
