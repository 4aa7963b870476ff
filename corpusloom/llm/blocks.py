"""Groups of any size compared in bounded pieces: a group is cut into blocks, and each pair of blocks is one unit of work."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(df: DataFrame, group: str, size: str, member: str, block: int) -> DataFrame:
    """Each row once per pair of blocks that its block belongs to: columns _i, _j (i <= j) and _own.

    ``size`` holds the number of rows of the group; a group of up to ``block`` rows is one pair (0, 0).
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = df.withColumn("_n", blocks).withColumn("_own", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_n")).cast("int"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return other.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_other", "_n")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches joined so that no group is cut, with the first row of each group and the number of rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        starts = _starts(table, keys)
        if len(starts) > 1:
            last = int(starts[-1])
            yield table.slice(0, last).combine_chunks(), np.append(starts[:-1], last)
            held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(table, keys)
        yield table, np.append(starts, table.num_rows)


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for key in keys:
        values = table.column(key).combine_chunks()
        if pa.types.is_binary(values.type) or pa.types.is_string(values.type):
            listed = values.to_pylist()
            change[1:] |= np.array([a != b for a, b in zip(listed[1:], listed[:-1], strict=True)], bool)
        else:
            numbers = values.to_numpy(zero_copy_only=False)
            change[1:] |= numbers[1:] != numbers[:-1]
    return np.flatnonzero(change)


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member of the connected part of each row of a symmetric boolean matrix."""
    n = len(linked)
    root = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        lower = np.where(reach, root[None, :], n).min(axis=1)
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower
