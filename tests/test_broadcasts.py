"""Planes do not pass through the driver: what a query broadcasts is a few rows, however many pixels there are."""

import pytest

from rastrel.plans.registered import QUERIES

from .conftest import DATA

#: Rows that a broadcast may have: classes, limits and ranges, but no objects or pixels.
FEW = 20
#: More where a parameter bounds them: the training pixels.
BOUNDED = {"edit_propagation": 600}


def _broadcasts(spark, run):
    """Rows of each broadcast of all that ``run`` executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen, rows = store.executionsList(int(before), 10_000), []
    for i in range(seen.size()):
        at = seen.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for j in range(nodes.size()):
            if nodes.apply(j).name() == "BroadcastExchange":
                metrics = nodes.apply(j).metrics()
                told = {metrics.apply(k).name(): values.get(metrics.apply(k).accumulatorId()) for k in range(metrics.size())}
                rows += [int(v.get().replace(",", "")) for name, v in told.items() if name == "number of output rows" and v.isDefined()]
    return rows


def test_a_broadcast_is_seen(spark):
    wide = spark.range(100).join(spark.range(70).hint("broadcast"), "id")
    assert _broadcasts(spark, lambda: wide.write.format("noop").mode("overwrite").save()) == [70]


@pytest.mark.parametrize("name", ["boundary_instances", "cells_from_nuclei", "cells_kept_apart", "edit_propagation", "levels_to_build", "nuclei_instances", "nuclei_touching", "nucleus_seeds", "pixel_classes", "strip_candidates", "strip_estimates", "strip_pair"])
def test_no_plane_is_broadcast(name, spark):
    told = _broadcasts(spark, lambda: QUERIES[name](spark, f"{DATA}/sf0.01").write.format("noop").mode("overwrite").save())
    assert [n for n in told if n > BOUNDED.get(name, FEW)] == []
