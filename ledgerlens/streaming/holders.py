"""Holder state kept by a stream of token-account updates.

Spark's state store holds the last update per account, ordered by (slot, seq), so a late update cannot replace
a newer one and a balance of 0 stays as a tombstone.  Each micro-batch appends the accounts it changed to a
change log; the current accounts are the newest entry per account.  :func:`fold` turns the log into a version with one
row per account and drops the batches that the version before held, so that reading the state does not take longer as the stream gets older.

With an allowed lateness (:func:`expiring_updates`) a tombstone has a timer and leaves the store once no update can be
older than it: the store then holds the accounts with a balance and those that were closed lately.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlens.operators.holders import latest_accounts
from ledgerlens.operators.ordering import first_per_group
from ledgerlens.sources.tables import _file_system, publish_version, read_version

CHANGE_LOG = "account string, mint string, owner string, amount decimal(20,0), slot bigint, seq bigint"


def last_update(updates: DataFrame) -> DataFrame:
    """Newest update per account; as a stream this is the keyed state."""
    order = F.struct("slot", "seq")
    row = F.struct("mint", "owner", "amount", "slot", "seq")
    return updates.groupBy("account").agg(F.max_by(row, order).alias("last")).select("account", "last.*")


class _LastUpdate(StatefulProcessor):
    """The newest update of one account, and a timer where that update closed it."""

    FIELDS = ("mint", "owner", "amount", "slot", "seq")

    def __init__(self, lateness_ms: int) -> None:
        self.lateness_ms = lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "mint string, owner string, amount decimal(20,0), slot bigint, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        best, at = held, None
        for frame in rows:
            for row in frame[[*self.FIELDS, "at"]].itertuples(index=False, name=None):
                if best is None or (row[3], row[4]) > (best[3], best[4]):
                    best, at = (*row[:3], int(row[3]), int(row[4])), row[5]
        if at is None:  # nothing newer than what is held
            return
        self.last.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best[2] <= 0:
            expires = int(at.timestamp() * 1000) + self.lateness_ms
            self.handle.registerTimer(max(expires, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([(key[0], *best)], columns=["account", *self.FIELDS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_updates(updates: DataFrame, lateness: str) -> DataFrame:
    """Newest update per account of a stream, like :func:`last_update`, with a store that does not grow for ever.

    ``updates`` also has ``at``, the time of the update.  An update that comes more than ``lateness`` (an interval such as
    "1 hour") after newer ones of the stream is dropped, so a tombstone that is older than that is forgotten without
    being undone.  Accounts with a balance are kept.
    """
    wait = int(pd.Timedelta(lateness).total_seconds() * 1000)
    output = CHANGE_LOG
    return (
        updates.withWatermark("at", lateness)
        .groupBy("account")
        .transformWithStateInPandas(
            statefulProcessor=_LastUpdate(wait), outputStructType=output, outputMode="Update", timeMode="EventTime"
        )
    )


def follow_accounts(
    updates: DataFrame, log_path: str, checkpoint: str, available_now: bool = False, lateness: str | None = None
) -> StreamingQuery:
    """Run the state and append changed accounts to the log; with ``lateness`` closed accounts leave the state.

    A batch that is run again after a failure overwrites its own folder, so each change is logged once.
    """

    def log_changes(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    trigger = {"availableNow": True} if available_now else {"processingTime": "5 seconds"}
    changed = last_update(updates) if lateness is None else expiring_updates(updates, lateness)
    return (
        changed.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(log_changes)
        .trigger(**trigger)
        .start()
    )


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(f"{CHANGE_LOG}, batch int").option("basePath", log_path).parquet(f"{log_path}/batch=*")


def current_accounts(log: DataFrame) -> DataFrame:
    """Accounts with a balance, from the change log."""
    return latest_accounts(log)


def compact(log: DataFrame, root: str) -> str:
    """Publish the newest entry per account, tombstones included, as a new table version."""
    newest = first_per_group(log.drop("batch"), ["account"], [F.col("slot").desc(), F.col("seq").desc()])
    return publish_version(newest, root)


def batches(spark: SparkSession, log_path: str) -> list[int]:
    """Numbers of the logged batches, oldest first."""
    files, location = _file_system(spark, log_path)
    names = [e.getPath().getName() for e in files.listStatus(location)] if files.exists(location) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def _pending(spark: SparkSession, log_path: str, known: DataFrame | None) -> tuple[DataFrame | None, int | None]:
    """Entries of the batches that the newest version does not hold, and the last of these batches."""
    first = None if known is None else known.select("folded").first()
    new = [b for b in batches(spark, log_path) if first is None or b > first["folded"]]
    if not new:
        return None, None
    paths = [f"{log_path}/batch={b}" for b in new]
    return spark.read.schema(CHANGE_LOG).parquet(*paths), new[-1]


def state(spark: SparkSession, log_path: str, root: str) -> DataFrame:
    """Accounts with a balance: the newest version of :func:`fold` and the batches logged since."""
    known = read_version(spark, root)
    rows, _ = _pending(spark, log_path, known)
    held = None if known is None else known.drop("folded")
    if rows is None and held is None:
        return spark.createDataFrame([], CHANGE_LOG)
    return latest_accounts(rows if held is None else held if rows is None else held.unionByName(rows))


def fold(spark: SparkSession, log_path: str, root: str) -> str | None:
    """Publish the newest entry per account, tombstones included; None without new batches.

    The batches of this version stay until the next one, for readers that have listed them; those of the version before
    are dropped.  A batch that the stream runs again later writes its folder anew; its entries are in the version already and change
    nothing.
    """
    known = read_version(spark, root)
    rows, last = _pending(spark, log_path, known)
    if rows is None:
        return None
    older = -1 if known is None else (known.select("folded").first() or {"folded": -1})["folded"]
    rows = rows if known is None else rows.unionByName(known.drop("folded"))
    newest = first_per_group(rows, ["account"], [F.col("slot").desc(), F.col("seq").desc()])
    path = publish_version(newest.withColumn("folded", F.lit(last)), root)
    for batch in batches(spark, log_path):
        if batch <= older:
            files, location = _file_system(spark, f"{log_path}/batch={batch}")
            files.delete(location, True)
    return path
