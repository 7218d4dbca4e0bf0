"""A plain Python function over batches of one column, in the tasks of the cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.session import ship


def mapped(df: DataFrame, keep: list[str], column: str, f: Callable[[list], list], result: str) -> DataFrame:
    """The columns ``keep`` and ``result`` (a name and a type), what ``f`` gives for each value of ``column``.

    ``f`` takes a batch of values and returns as many results; batches
    run wherever there is room, so keep an ordinal to restore an order.
    """
    ship(df.sparkSession)
    types = dict(df.dtypes)
    name = result.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = f(batch.column(len(keep)).to_pylist())
            if len(found) != batch.num_rows:
                raise ValueError(f"{len(found)} results for {batch.num_rows} values")
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(found)], names=[*keep, name])

    return df.select(*keep, column).mapInArrow(run, "".join(f"`{c}` {types[c]}, " for c in keep) + result)
