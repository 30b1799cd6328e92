"""Queries of the elastic touch-up: blended fields with SQL; a whole touch-up, which SQL cannot express, over planes that grow with the suppliers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import elastic as E
from . import inputs as I
from .catalog import query

SIZE, WIDTH = 16, 40
# Cells of the lattice over a plane with eight rows for each supplier: a constant shift each, weighted by its distance from inner edges.
CELLS = f"select s.k as ty, t.tx, s.k % 7 - 3 + t.tx * 0.5e0 as dy, s.k % 5 - 2 - t.tx * 0.25e0 as dx from (select s_suppkey as k from supplier) s, range({E.lattice(WIDTH, SIZE // 2)}) t(tx)"
SIDE = "case when {k} > 0 then least(({at} + 0.5e0) / 8e0, 1e0) else 1e0 end * case when {k} < {n} - 1 then least(2e0 - ({at} + 0.5e0) / 8e0, 1e0) else 1e0 end"


def _image(spark, d, moved: bool):
    """Tiles of eight rows for each supplier: waves, or the same read through a smooth field."""
    def run(batches):
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                y, x = np.mgrid[k * 8 : k * 8 + 8, 0:128].astype(float)
                if moved:
                    y, x = y + 2 + 1.5 * np.sin(y / 40) * np.cos(x / 50), x - 3 + 1.5 * np.cos(y / 45)
                v = (900 * np.sin(y / 3.1) * np.cos(x / 3.7) + 700 * np.cos(y / 7.3 + x / 5.9) + 500 * np.sin(x / 4.3 - y / 6.1) + 4000).astype("<f4")
                rows.append({"y0": k * 8, "x0": 0, "h": 8, "w": 128, "dtype": "float32", "px": v.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, E._schema(E.TILE))

    return I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).mapInArrow(run, E.TILE)


@query(f"""with c as ({CELLS}), n as (select max(ty) + 1 as n from c),
w as (select ty * 8 + ay as y, tx * 8 + bx as x, dy, dx, {SIDE.format(k='ty', n='n.n', at='ay')} * {SIDE.format(k='tx', n=E.lattice(WIDTH, SIZE // 2), at='bx')} as w from c, n, range({SIZE}) a(ay), range({SIZE}) b(bx))
select y // 8 as ty, x // 8 as tx, round(sum(my), 3) as sum_y, round(sum(mx), 3) as sum_x from (select y, x, sum(w * dy) / sum(w) as my, sum(w * dx) / sum(w) as mx from w where x < {WIDTH} group by 1, 2) group by 1, 2""")
def elastic_tiles_blended(spark, d):
    """Fields of overlapping cells, one shift each, as one field by tiles."""
    height = (I.table(spark, d, "supplier").count() + 1) * 8
    cells = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ty"), F.explode(F.sequence(F.lit(0), F.lit(E.lattice(WIDTH, SIZE // 2) - 1))).alias("tx"))

    def fields(batches):
        for batch in batches:
            rows = [{"ty": ty, "tx": tx, "field_y": np.full(SIZE * SIZE, ty % 7 - 3 + tx * 0.5, "<f4").tobytes(), "field_x": np.full(SIZE * SIZE, ty % 5 - 2 - tx * 0.25, "<f4").tobytes()} for ty, tx in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(rows, E._schema("ty long, tx long, field_y binary, field_x binary"))

    def sums(batches):
        for batch in batches:
            rows = [{"ty": r["ty"], "tx": r["tx"], **{f"sum_{c}": float(np.frombuffer(r[f"field_{c}"], "<f4").astype(float).sum()) for c in "yx"}} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, E._schema("ty long, tx long, sum_y double, sum_x double"))

    told = E.blended(cells.mapInArrow(fields, "ty long, tx long, field_y binary, field_x binary"), height, WIDTH, SIZE)
    return told.mapInArrow(sums, "ty long, tx long, sum_y double, sum_x double").select("ty", "tx", (F.round("sum_y", 3) + 0.0).alias("sum_y"), (F.round("sum_x", 3) + 0.0).alias("sum_x"))


@query()
def elastic_field(spark, d):
    """State and scores of every cell; ``tests/test_elastic.py`` compares them with the planted field."""
    fixed, moving = _image(spark, d, False), _image(spark, d, True)
    height = I.table(spark, d, "supplier").count() * 8
    mask = fixed  # the waves are above 0 everywhere
    return E.elastic_fields(fixed, moving, mask, height, 128, 64, 8, 6.0).select("ty", "tx", "state", *[F.round(c, 3).alias(c) for c in ("base", "rigid", "elastic")])
