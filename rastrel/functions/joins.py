"""How the sides of a join meet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_sort(rows: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and sorted, never broadcast.

    Spark takes exploded rows to be as large as the table that they came from, and
    written ones as large as their compressed files; by that it would send whole
    planes through the driver.
    """
    return rows.hint("merge")
