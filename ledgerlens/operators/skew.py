"""Work per group that stays spread out when one group holds a large part of all rows.

A *hot* group has more than ``threshold`` rows, so there are at most ``rows / threshold`` hot groups however
large the input is.  :func:`find_hot` counts rows per group once, reading only the key columns; without a hot
group the operators use the plain join or window, with one they spread its rows over many tasks.  Both ways
give the same rows.  Hot groups are only broadcast after their number has been checked.

Group keys must not be null; callers give missing keys a name first.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

from ledgerlens.session import shared_dir

#: A group up to this size is sorted by one task, spilling as needed.
HOT_GROUP_ROWS = 5_000_000

#: Hot groups whose keys and values are sent to every task at most.
BROADCAST_GROUPS = 100_000

#: Ranges that rows with hot groups are cut into at least.
RANGES = 64


#: Folders written since the innermost :func:`kept_until_end` began; None outside of one.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def kept_until_end(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that are written inside when the block ends, after an error too.

    A job that writes its results inside the block leaves nothing else behind; rows that are still to be computed must
    not leave the block.
    """
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for path in written:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def materialise(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write an intermediate table, with Parquet ``options``, to the shared folder and continue from the files.

    Inside :func:`kept_until_end` the files go at its end, else they stay for whoever reads the result later.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def find_hot(df: DataFrame, keys: Sequence[str], threshold: int = HOT_GROUP_ROWS) -> DataFrame | None:
    """Keys of the groups with more than ``threshold`` rows, or None when there are none."""
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > threshold)
        .select(*keys)
    )
    return None if hot.isEmpty() else materialise(hot, "hot-groups")


def never_null(key: Column, row_id: Column) -> Column:
    """Join key with a stand-in for null that is different in every row and matches nothing.

    Rows with a null key would otherwise all be shuffled to one task, only to find no partner there.
    """
    return F.coalesce(key.cast("string"), F.concat(F.lit("\u0000"), row_id.cast("string")))


def join_group_values(
    rows: DataFrame, values: DataFrame, keys: Sequence[str], hot: DataFrame | None
) -> DataFrame:
    """Left join of ``rows`` with one row per group of ``values``.

    Rows of hot groups meet their values by broadcast and never move; the other rows are joined by a
    shuffle in which no key exceeds the threshold.
    """
    keys = list(keys)
    if hot is None:
        return rows.join(values, keys, "left")
    # Beyond that size Spark joins by a shuffle and splits the partitions of hot keys itself.
    sent = F.broadcast if hot.count() <= BROADCAST_GROUPS else (lambda df: df)
    hot_values = hot.join(values, keys, "left")
    spread = rows.join(sent(hot_values), keys, "inner")
    rest = rows.join(sent(hot), keys, "left_anti").join(values, keys, "left")
    return spread.unionByName(rest)


def with_range(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``_range``: the number of the range of rows in that order, as many rows to each.

    Rows of one group, and rows of one value that differ in the later columns, lie in as many ranges as they fill.
    """
    ranges = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())


def exact_sum(left: Column, right: Column, data_type: DataType) -> Column:
    """Sum of two columns of one type.

    At the full 38 digits Spark would give up a fraction digit for a carry; one digit less leaves room for it.
    """
    if isinstance(data_type, DecimalType) and data_type.scale:
        room = DecimalType(min(data_type.precision, 37), data_type.scale)
        return (left.cast(room) + right.cast(room)).cast(data_type)
    return left + right


def ordered_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    hot: DataFrame | None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Running and total sums within each group, in the order of ``order`` then ``ties``.

    For every entry ``name`` of ``sums`` the result has ``name_before`` (sum over the earlier rows) and
    ``name_total`` (sum over the group).  With hot groups the rows are cut into ranges that are sorted by separate
    tasks; the sums of the earlier ranges of a group are then added to each row.
    """
    keys = list(keys)
    zero = F.lit(0)
    if hot is None:
        whole = Window.partitionBy(*keys).orderBy(order, *ties)
        before = whole.rowsBetween(Window.unboundedPreceding, -1)
        full = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.select(
            "*",
            *[F.coalesce(F.sum(c).over(before), zero).alias(f"{n}_before") for n, c in sums.items()],
            *[F.sum(c).over(full).alias(f"{n}_total") for n, c in sums.items()],
        )

    for name, column in sums.items():
        df = df.withColumn(f"_{name}", column)
    # Written once, as the range sums and the rows below must see the same ranges.
    ranged = materialise(with_range(df, [*keys, order, *ties]), "ordered")
    part = [*keys, "_range"]
    per_range = ranged.groupBy(*part).agg(*[F.sum(f"_{n}").alias(f"_{n}_range") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *part,
        *[F.coalesce(F.sum(f"_{n}_range").over(earlier), zero).alias(f"_{n}_offset") for n in sums],
        *[F.sum(f"_{n}_range").over(Window.partitionBy(*keys)).alias(f"{n}_total") for n in sums],
    )
    inside = (
        Window.partitionBy(*part).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    running = ranged.select(
        "*", *[F.coalesce(F.sum(f"_{n}").over(inside), zero).alias(f"_{n}_run") for n in sums]
    )
    joined = running.join(offsets, part, "inner")
    types = {f.name: f.dataType for f in joined.schema}
    for name in sums:
        before = exact_sum(F.col(f"_{name}_offset"), F.col(f"_{name}_run"), types[f"_{name}_run"])
        joined = joined.withColumn(f"{name}_before", before)
    hidden = ["_range"] + [f"_{n}{s}" for n in sums for s in ("", "_offset", "_run")]
    return joined.drop(*hidden)


def middle_value(value: str, count: str = "n", over: WindowSpec | None = None) -> Column:
    """Aggregate giving the exact median from distinct values with ``count``, ``count_before``, ``count_total``.

    With ``over`` it is added to every row of the group instead.
    """
    start, size, total = F.col(f"{count}_before"), F.col(count), F.col(f"{count}_total")
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)

    def at(position: Column) -> Column:
        found = F.max(F.when((start <= position) & (position < start + size), F.col(value)))
        return found if over is None else found.over(over)

    return (at(low) + at(high)) / 2
