"""Notification stream to event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions.identity import base58, decode_account
from ledgerlens.schemas import NOTIFICATION

# Flush interval, notification methods.
FLUSH_INTERVAL = "5 seconds"
SLOT, LOGS, PROGRAM = "slotNotification", "logsNotification", "programNotification"


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    """Stream of landed notification files, one JSON document per line."""
    return spark.readStream.schema(NOTIFICATION).json(path)


def event_rows(notifications: DataFrame) -> DataFrame:
    """One uniform row per notification; notifications without content are dropped."""
    method, value = F.col("method"), F.col("result.value")
    slot = F.when(method == SLOT, F.col("result.slot"))
    signature = F.when((method == LOGS) & (F.size(value["logs"]) > 0), F.nullif(value["signature"], F.lit("")))
    pubkey = F.when(method == PROGRAM, F.nullif(value["pubkey"], F.lit("")))
    kind = (
        F.when(F.coalesce(slot, F.lit(0)) != 0, "slot")
        .when(signature.isNotNull(), "logs")
        .when(pubkey.isNotNull(), "program")
    )
    return notifications.select(
        kind.alias("event_type"),
        F.coalesce(slot, F.lit(0)).cast("bigint").alias("slot"),
        F.coalesce(signature, F.lit("")).alias("signature"),
        F.when(signature.isNotNull(), F.size(value["logs"])).otherwise(0).alias("log_count"),
        F.coalesce(pubkey, F.lit("")).alias("pubkey"),
        "received_at",
    ).filter(F.col("event_type").isNotNull())


def _parsed_info(data: Column) -> Column:
    return F.from_json(
        data, "struct<parsed:struct<info:struct<mint:string,owner:string,tokenAmount:struct<amount:string>>>>"
    )["parsed"]["info"]


def account_updates(notifications: DataFrame) -> DataFrame:
    """Token-account balances carried by program notifications, parsed or as raw account bytes."""
    data = F.col("result.value.account.data")
    info = _parsed_info(F.when(data.startswith("{"), data))
    raw = decode_account(F.get(F.from_json(F.when(data.startswith("["), data), "array<string>"), F.lit(0)))
    rows = (
        notifications.filter((F.col("method") == PROGRAM) & (F.col("result.value.pubkey") != ""))
        .select(
            F.col("result.value.pubkey").alias("account"),
            info.alias("info"),
            raw.alias("raw"),
            F.coalesce("result.context.slot", F.lit(0)).alias("slot"),
            F.coalesce("seq", F.lit(0)).alias("seq"),
        )
    )
    return rows.select(
        "account",
        F.coalesce("info.mint", base58("raw.mint_key")).alias("mint"),
        F.coalesce("info.owner", base58("raw.owner_key")).alias("owner"),
        F.coalesce(F.col("info.tokenAmount.amount").try_cast("decimal(20,0)"), "raw.balance", F.lit(0))
        .cast("decimal(20,0)")
        .alias("amount"),
        "slot",
        "seq",
    ).filter((F.col("mint") != "") & (F.col("owner") != ""))


def write_events(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append event rows every five seconds, or once over everything that has landed."""
    writer = (
        events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": FLUSH_INTERVAL}
    return writer.outputMode("append").trigger(**trigger).start()

