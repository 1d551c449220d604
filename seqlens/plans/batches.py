"""Groups of sorted rows, handed to numpy many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows that are folded at a time, whole groups of them.
FOLD_ROWS = 60_000


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows of a sorted table at which a group begins."""
    begins = np.ones(len(table), bool)
    if len(table) > 1:
        begins[1:] = False
        for k in keys:
            column = table.column(k).combine_chunks()
            begins[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(begins)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of ``FOLD_ROWS`` rows or more that end where a group ends; what is held over is the batches of one group."""
    held: list[pa.RecordBatch] = []
    whole: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cut = group_starts(pa.Table.from_batches([batch]), keys)[-1]
        if held and cut == 0:
            last = held[-1]
            cut = 0 if any(last.column(k)[-1] != batch.column(k)[0] for k in keys) else -1
        if cut >= 0 and (held or cut):
            whole, held = [*whole, *held, batch.slice(0, cut)], []
            if sum(map(len, whole)) >= FOLD_ROWS:
                yield pa.Table.from_batches(whole)
                whole = []
        held.append(batch.slice(max(cut, 0)))
    if held:
        yield pa.Table.from_batches([*whole, *held])


def fold_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """``fold(table, starts)`` over rows sorted by ``order`` within ``keys`` (not null); a table holds many whole groups, which begin at ``starts``."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, keys):
            yield from fold(table, group_starts(table, keys)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
