"""One pass over rows that are range-partitioned and sorted: running sums inside each partition, a batch at a time.

What lies in the partitions before is not known inside a task. It is one small row per group and partition, which
callers add afterwards, so no group is ever held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class RunningSums:
    """Sums over the earlier rows of the same group, carried from batch to batch."""

    def __init__(self, group: Sequence[str], sums: Sequence[str]):
        self.group, self.sums = list(group), list(sums)
        self.key: tuple | None = None
        self.carried: dict[str, float | int] = {}

    def before(self, batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """First rows of the groups in ``batch``, and per summed column what precedes each row. The batch has rows."""
        rows = batch.num_rows
        new = np.zeros(rows, dtype=bool)
        new[0] = True
        for name in self.group:
            column = batch.column(name)
            a, b = column.slice(1), column.slice(0, rows - 1)
            differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            new[1:] |= differs.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, rows))
        first = tuple(batch.column(n)[0].as_py() for n in self.group)
        found = {}
        for name in self.sums:
            value = pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False)
            through = np.cumsum(value)
            before = through - value
            before -= np.repeat(before[starts], lengths)
            if self.key == first:
                before[: lengths[0]] += self.carried[name]
            self.carried[name] = before[-1] + value[-1]
            found[name] = before
        self.key = tuple(batch.column(n)[rows - 1].as_py() for n in self.group)
        return starts, found


def numbered(group: Sequence[str], sums: Sequence[str]):
    """A ``mapInArrow`` function that appends ``_part`` and ``before_<s>`` of each summed column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, running = TaskContext.get().partitionId(), RunningSums(group, sums)
        for batch in batches:
            if batch.num_rows:
                _, found = running.before(batch)
                arrays = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), *map(pa.array, found.values())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "_part", *[f"before_{s}" for s in sums]])

    return run
