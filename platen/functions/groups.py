"""Groups of rows in Python: Spark deals and orders them, tasks stream them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def dealt(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows dealt out by `by` and ordered by it and `order` within each partition."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, *order)


def starts(table: pa.Table | pa.RecordBatch, by: tuple[str, ...]) -> np.ndarray:
    """Where the groups of ordered rows begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in by:
        column = table.column(name).to_numpy() if isinstance(table, pa.Table) else table.column(name).to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches of `dealt` rows: the last group of a batch waits for the next one. Never more than a batch and a group is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in by):
            yield pa.Table.from_batches(held)
            held = []
        last = int(starts(batch, by)[-1])
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)
