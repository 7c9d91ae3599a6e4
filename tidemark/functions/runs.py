"""Work on the values of many keys in one sorted pass: a task holds the rows of one Arrow batch, and of the key it ends in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import dealt


def in_runs(rows: DataFrame, solve: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, Sequence[np.ndarray]]], fields: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """What solve makes of the keys of rows (did, gap) that have ``most`` values at most: did and fields; and the rows of the other keys, if there are any.

    solve takes the values in seconds, rising within each key, and where the keys start; it gives the numbers of those kept and their columns.
    """
    # As many as the rows over most, so few.
    large = rows.groupBy("did").count().where(F.col("count") > most).select("did")
    names_of = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = np.empty(0, object), np.empty(0)
        for batch in chain(batches, [None]):
            if batch is not None:
                names = np.concatenate((names, batch.column(0).to_numpy(zero_copy_only=False)))
                x = np.concatenate((x, batch.column(1).to_numpy(zero_copy_only=False) / 1e6))
            if not len(names):
                continue
            starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            # The last key of a batch waits for the next.
            cut = len(names) if batch is None else starts[-1]
            starts = starts[starts < cut]
            if len(starts):
                with np.errstate(all="ignore"):
                    kept, columns = solve(x[:cut], starts)
                yield pa.RecordBatch.from_arrays([pa.array(names[starts[kept]], pa.string()), *map(pa.array, columns)], ["did", *names_of])
            names, x = names[cut:], x[cut:]

    few = dealt(rows.join(F.broadcast(large), "did", "left_anti"), "did").sortWithinPartitions("did", "gap").mapInArrow(run, f"did string, {fields}")
    return few, None if large.isEmpty() else rows.join(F.broadcast(large), "did", "left_semi")
