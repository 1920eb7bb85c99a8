"""Periodic ingestion: turn what has landed since the last run into snapshot rows.

Any scheduler can call this every few minutes; the checkpoint remembers which files were read, so a run that
is repeated or restarted adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def ingest_landed(
    landed: DataFrame,
    to_rows: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    partition: str | None = None,
) -> StreamingQuery:
    """Run ``to_rows`` over the new part of a file stream and append the result to a table."""
    writer = (
        to_rows(landed)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    return (writer.partitionBy(partition) if partition else writer).start()
