"""Pyramids that are interrupted and taken up again."""

import pytest

from rastrel.operators.geometry import block_mean
from rastrel.sources import levels as L

from .conftest import rows


@pytest.fixture()
def plane(spark):
    return spark.range(40 * 50 * 2).selectExpr("id % 2 as channel", "id div 2 div 50 as y", "id div 2 % 50 as x", "(id * 7919) % 65536 as v")


def _same(a, b):
    return rows(a.toPandas()) == rows(b.toPandas())


def test_levels_are_means_of_the_ones_before(spark, plane, tmp_path):
    path = str(tmp_path / "p")
    assert L.write_levels(plane, path, 2) == [True, True, True]
    assert _same(L.read_level(spark, path, 0), plane)
    assert _same(L.read_level(spark, path, 2), block_mean(block_mean(plane, by=("channel",)), by=("channel",)).select("channel", "y", "x", "v"))
    assert L.write_levels(plane, path, 2) == [False, False, False]


def test_an_interrupted_level_and_all_after_it_are_built_again(spark, plane, tmp_path):
    path = str(tmp_path / "p")
    L.write_levels(plane, path, 3)
    (tmp_path / "p" / "level=1" / L.DONE).unlink()
    with pytest.raises(FileNotFoundError):
        L.read_level(spark, path, 1)
    assert L.write_levels(plane, path, 3) == [False, True, True, True]
    assert _same(L.read_level(spark, path, 1), block_mean(plane, by=("channel",)).select("channel", "y", "x", "v"))


def test_reports_keep_nested_columns(spark, tmp_path):
    df = spark.sql("select 1 as k, array(1, 2) as a, named_struct('b', 'x') as s")
    L.write_report(df, str(tmp_path / "r"))
    (r,) = spark.read.option("header", True).csv(str(tmp_path / "r")).collect()
    assert (r["k"], r["a"], r["s"]) == ("1", "[1,2]", '{"b":"x"}')


def test_a_changed_image_keeps_no_old_level(spark, plane, tmp_path):
    path = str(tmp_path / "p")
    L.write_levels(plane, path, 2)
    other = plane.selectExpr("channel", "y", "x", "if(y = 3 and x = 4 and channel = 1, v + 1, v) as v")
    assert L.write_levels(other, path, 2) == [True, True, True]
    assert _same(L.read_level(spark, path, 0), other)
    assert L.write_levels(other.repartition(5), path, 2) == [False, False, False]
    (tmp_path / "p" / "content").unlink()
    assert L.write_levels(other, path, 2) == [True, True, True]
