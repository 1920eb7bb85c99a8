"""Tables in hash buckets of their key: a merge reads and rewrites the buckets of its updates, no others.

A row lies in the partition folder of the hash of its key.  Keys and number of buckets are kept with the table's schema,
so every writer deals rows alike.  A key has one row, or a bounded list of rows, so no bucket is hot; buckets are cut into
files by size when they are written.  A lost executor costs its tasks only: the merged rows are written apart, once, and their
folders are moved into place when that job has committed.  A driver lost while folders are replaced can leave some of them missing; where
that matters use a table format, whose commits are atomic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.skew import kept_until_end
from ledgerlens.sources.tables import _file_system, _keep_schema, read_table, stored_schema

BUCKET, PART = "bucket", "_part"

#: Buckets of a new table; at 100 TB a larger number keeps one within a task.
BUCKETS = 1024

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row; a null in its key is an error, as such a row could never be found again."""
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    return F.when(whole, number).otherwise(F.raise_error(F.lit(f"null in the key {', '.join(keys)}")).cast("int"))


def create_keyed(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write rows as a new table in buckets; a table that is there already is an error."""
    if stored_schema(rows.sparkSession, path) is not None:
        raise ValueError(f"there is a table at {path} already")
    dealt = rows.withColumn(BUCKET, bucket_of(keys, buckets)).hint("rebalance", BUCKET)
    _replace_buckets(dealt, path, list(keys), buckets, [])


def layout(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Keys and number of buckets of a table."""
    schema = stored_schema(spark, path)
    if schema is None or BUCKET not in schema.names or "buckets" not in schema[BUCKET].metadata:
        raise ValueError(f"no table in buckets at {path}")
    return list(schema[BUCKET].metadata["keys"]), int(schema[BUCKET].metadata["buckets"])


def read_keyed(spark: SparkSession, path: str, touched: Sequence[int] | None = None) -> DataFrame:
    """The rows of a table, of the given buckets only where there are some; other folders are never listed into the scan."""
    rows = read_table(spark, path)
    return (rows if touched is None else rows.filter(F.col(BUCKET).isin(list(touched)))).drop(BUCKET)


def with_buckets(updates: DataFrame, path: str) -> DataFrame:
    """Rows with the bucket that their key has in a table; keys take the table's types first, as hashes depend on them."""
    keys, buckets = layout(updates.sparkSession, path)
    types = {f.name: f.dataType for f in stored_schema(updates.sparkSession, path)}
    typed = updates.select(*[F.col(c).cast(types[c]).alias(c) if c in keys else F.col(c) for c in updates.columns])
    return typed.withColumn(BUCKET, bucket_of(keys, buckets))


def touched_buckets(rows: DataFrame) -> list[int]:
    """The distinct buckets of rows that have one: at most as many numbers as the table has buckets."""
    return sorted(r[BUCKET] for r in rows.select(BUCKET).distinct().collect())


def deal(rows: DataFrame, path: str) -> tuple[DataFrame, list[str]]:
    """Rows dealt by the bucket of a table and by parts of it, and the columns to group them by without another shuffle.

    A merge that groups by these columns and keeps :data:`BUCKET` is written as it is: its rows move once.
    """
    keys, buckets = layout(rows.sparkSession, path)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.pmod(F.hash(*keys), F.lit(max(1, -(-4 * width // buckets))))
    dealt = rows.withColumns({BUCKET: bucket_of(keys, buckets), PART: parts}).repartition(BUCKET, PART)
    return dealt, [BUCKET, PART, *keys]


def merge_keyed(updates: DataFrame, path: str, merge: Merge) -> list[int]:
    """Merge updates into a table and return the buckets that were rewritten.

    ``merge`` makes the new rows from the known rows of these buckets and the updates.  What it does to a key may only
    depend on rows of that key; a row that it puts into another bucket is an error.  No updates change nothing.  The
    updates are read for their buckets and again for the merge: give costly ones as a table.
    """
    spark = updates.sparkSession
    keys, buckets = layout(spark, path)
    with kept_until_end(spark):
        updates = with_buckets(updates, path)
        touched = touched_buckets(updates)
        if not touched:
            return []
        merged = merge(read_keyed(spark, path, touched), updates.drop(BUCKET))
        number = bucket_of(keys, buckets)
        inside = F.when(number.isin(touched), number).otherwise(F.raise_error(F.lit("a row left its buckets")).cast("int"))
        dealt = BUCKET in merged.columns
        merged = merged.withColumn(BUCKET, inside)
        _replace_buckets(merged if dealt else merged.hint("rebalance", BUCKET), path, keys, buckets, touched)
    return touched


def _replace_buckets(rows: DataFrame, path: str, keys: list[str], buckets: int, touched: Sequence[int]) -> None:
    """Write rows that have their bucket, and put their folders in the place of the touched ones."""
    spark, root = rows.sparkSession, path.rstrip("/")
    marked = F.col(BUCKET).alias(BUCKET, metadata={"keys": keys, "buckets": buckets})
    rows = rows.select(*[c for c in rows.columns if c not in (BUCKET, PART)], marked)
    _keep_schema(rows, path, BUCKET, "parquet")
    # The rows are computed from the folders they replace, so they are written beside them; readers skip the draft.
    files, draft = _file_system(spark, f"{root}/_draft-{uuid.uuid4().hex}")
    try:
        writer = rows.write.option("partitionOverwriteMode", "static").option("compression", "zstd")
        writer.partitionBy(BUCKET).parquet(draft.toString())
        made = [entry.getPath() for entry in files.listStatus(draft) if entry.getPath().getName().startswith(f"{BUCKET}=")]
        stale = {f"{BUCKET}={number}" for number in touched} | {folder.getName() for folder in made}
        for name in stale:
            files.delete(_file_system(spark, f"{root}/{name}")[1], True)
        for folder in made:
            if not files.rename(folder, _file_system(spark, f"{root}/{folder.getName()}")[1]):
                raise OSError(f"could not move {folder.toString()} into {root}")
    finally:
        files.delete(draft, True)
