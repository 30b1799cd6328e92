"""Many small groups, each handed to a function in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_groups(rows: DataFrame, key: str, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``groupBy(key).applyInArrow(run, schema)`` gives, for groups so small that a stream for each costs more than its work.

    A task reads its rows in the order of the key and cuts them where it changes; it
    holds one batch and the group that is still open.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(key).to_numpy()
            starts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()]
            done = []
            if held and held[-1].column(key)[0].as_py() != at[0]:
                done.append(run(pa.Table.from_batches(held)))
                held = []
            for start, end in zip(starts, starts[1:]):
                done.append(run(pa.Table.from_batches([*held, batch.slice(start, end - start)])))
                held = []
            held.append(batch.slice(starts[-1]))
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(cut, schema)
