"""Ordered (running) computations that split a hot group over many tasks.

A plain window puts every row of one partition key into one task.  Here rows are range-partitioned by
(keys, order), so one key may span many blocks; each block is scanned on its own, one summary row per
(key, block) is carried forward, and the carry is joined back.  The summary holds at most one row per key
and block, so its window is small whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage


class Blocks:
    """Rows of ``df`` cut into contiguous blocks of the total order (keys, order).

    ``order`` must be total within a key (add a tie-breaker column); keys must not be null.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], blocks: int | None = None):
        self.keys = list(keys)
        self.order = [F.col(item) if isinstance(item, str) else item for item in order]
        sizes = [blocks] if blocks else []
        ranged = df.repartitionByRange(*sizes, *[F.col(key) for key in self.keys], *self.order)
        # Block numbers must not change between the scan and the carry: store them once.
        self.rows = cut_lineage(ranged.withColumn("_block", F.spark_partition_id()))

    @property
    def inside(self):
        """Window over one block in order."""
        return Window.partitionBy(*self.keys, "_block").orderBy(*self.order)

    @property
    def running(self):
        return self.inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def carry(self, summaries: dict[str, Column], earlier: dict[str, tuple[str, str]], totals: dict[str, tuple[str, str]] | None = None, rows: DataFrame | None = None) -> DataFrame:
        """Attach values of all earlier blocks of the same key to every row.

        ``summaries`` are per-block aggregates; ``earlier`` maps an output name to (function, summary) with
        function ``sum``, ``min``, ``max`` or ``last`` over the preceding blocks; ``totals`` likewise over all blocks.
        """
        rows = self.rows if rows is None else rows
        per_block = rows.groupBy(*self.keys, "_block").agg(*[expr.alias(name) for name, expr in summaries.items()])
        whole = Window.partitionBy(*self.keys)
        before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        functions = {
            "sum": F.sum,
            "min": F.min,
            "max": F.max,
            "last": lambda column: F.last(column, ignorenulls=True),
        }
        carried = [functions[fn](F.col(name)).over(before).alias(out) for out, (fn, name) in earlier.items()]
        carried += [functions[fn](F.col(name)).over(whole).alias(out) for out, (fn, name) in (totals or {}).items()]
        return rows.join(per_block.select(*self.keys, "_block", *carried), [*self.keys, "_block"])


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    index: str = "position",
    count: str | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """``row_number`` (from 1) and optionally the group size, for groups of any size."""
    cut = Blocks(df, keys, order, blocks)
    numbered = cut.rows.withColumn("_local", F.row_number().over(cut.inside))
    carried = cut.carry(
        {"_rows": F.count(F.lit(1))},
        {"_before": ("sum", "_rows")},
        {"_total": ("sum", "_rows")},
        rows=numbered,
    )
    out = carried.withColumn(index, F.col("_local") + F.coalesce("_before", F.lit(0)))
    if count:
        out = out.withColumn(count, F.col("_total"))
    return out.drop("_local", "_before", "_total", "_block")


def dyadic_blocks(low: Column, high: Column, levels: int = 62) -> Column:
    """The range of integers from ``low`` to ``high`` (at least 0) as at most two aligned blocks per level: structs of
    ``level`` and ``block``, where a number x lies in block x >> level.  An empty range has none."""
    kind = "struct<lo:bigint,hi:bigint,found:array<struct<level:int,block:bigint>>>"
    start = F.struct(low.cast("bigint").alias("lo"), (high + 1).cast("bigint").alias("hi"), F.array().cast("array<struct<level:int,block:bigint>>").alias("found")).cast(kind)
    block = lambda level, at: F.array(F.struct(level.cast("int").alias("level"), at.cast("bigint").alias("block")))
    none = F.array().cast("array<struct<level:int,block:bigint>>")

    def step(state: Column, level: Column) -> Column:
        # Both ends counted in blocks of this level; an odd end gives its outer block away.
        lo, hi = state["lo"], state["hi"]
        left, right = (lo < hi) & (lo % 2 == 1), (lo < hi) & (hi % 2 == 1)
        low_, high_ = F.when(left, lo + 1).otherwise(lo), F.when(right, hi - 1).otherwise(hi)
        both = F.concat(state["found"], F.when(left, block(level, lo)).otherwise(none), F.when(right & (high_ >= low_), block(level, high_)).otherwise(none))
        return F.struct(F.floor(low_ / 2).cast("bigint").alias("lo"), F.floor(high_ / 2).cast("bigint").alias("hi"), both.alias("found")).cast(kind)

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step, lambda state: state["found"])
