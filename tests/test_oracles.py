"""Every raster query that has SQL gives what DuckDB gives."""

import pytest

from rastrel.plans.registered import ORACLES, QUERIES

from .conftest import DATA, rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, duck):
    got, want = QUERIES[name](spark, f"{DATA}/sf0.01").toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
