"""Groups cut from a stream are those of ``groupBy``."""

import pyarrow as pa

from rastrel.functions.groups import map_groups


def test_groups_that_span_batches_stay_whole(spark):
    rows = spark.range(2000).selectExpr("id", "case when id < 700 then 7 else id % 37 end as key", "cast(1 as long) as n").repartition(5)

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"key": table.column("key")[:1], "n": pa.array([table.num_rows]), "total": pa.array([sum(table.column("id").to_pylist())])})

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = map_groups(rows, "key", run, "key long, n long, total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = rows.groupBy("key").agg({"n": "sum", "id": "sum"}).select("key", "sum(n)", "sum(id)").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)
    assert map_groups(rows.where("id < 0"), "key", run, "key long, n long, total long").collect() == []
