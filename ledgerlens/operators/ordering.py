"""Pick or number rows inside groups, in one total order.

Every window here is partitioned and filtered on a small rank, which Spark turns into a per-partition limit
before the shuffle: at most ``k`` rows per group and input partition travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each group, numbered from 1 in column ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group."""
    return top_per_group(df, keys, order, 1, "_first").drop("_first")


def first_overall(df: DataFrame, order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows of the whole table: a partial top-k per task, never one sorted partition."""
    return df.orderBy(*order).limit(k)
