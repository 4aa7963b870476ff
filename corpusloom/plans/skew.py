"""Joins and aggregates that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_value(column: Column | str) -> Column:
    """The single distinct non-null value of a group, or null when there are none or several.

    ``min == max`` keeps constant state per group and combines map-side, unlike
    ``collect_set``/``count_distinct``, so a hot group costs no more than a cold one.
    """
    value = F.col(column) if isinstance(column, str) else column
    return F.when(F.min(value) == F.max(value), F.min(value))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salt: int = 0,
) -> DataFrame:
    """Join many ``left`` rows to a ``right`` table that is unique on ``on``.

    By default the strategy is left to adaptive execution (runtime-size broadcast, skew splitting).
    ``salt`` > 1 spreads every left key over that many reducers and copies each right row as often;
    right rows are unique per key, so the copy factor is exactly ``salt`` and never grows with a hot key.
    """
    keys = list(on)
    if salt <= 1:
        return left.join(right, keys, how)
    # A hash of the row, not a random number: a recomputed task must send its rows to the same place.
    hashable = [name for name, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salt)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def spread(rows: DataFrame) -> DataFrame:
    """Deal ``rows`` evenly over the shuffle partitions before work that costs much per row.

    A table of short rows is a few small files, which few tasks read, however long the work on each row takes.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
