"""Token lifecycle: rug, stale and retirement flags."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import first_eight
from ledgerlens.functions.times import days_between, moment
from ledgerlens.operators.merge import merge_by_key
from ledgerlens.operators.ordering import first_per_group

# Thresholds, statuses, messages and tags.
RUG_DROP, STALE_DAYS, RETIRE_DAYS = 0.99, 7, 30
STATUS = {"rug_flagged": "rug_flagged", "stale_flagged": "stale", "retired": "retired"}
MESSAGE = {
    "rug_flagged": "Rug pull detected: 99%+ supply drop in 1 hour",
    "stale_flagged": "No ingestion for 7+ days",
    "retired": "Retired: 0 holders + 0 supply for 30+ days",
}
TAG = {"rug_flagged": "rug-flagged", "stale_flagged": "stale", "retired": "retired"}


def supply_baselines(
    snapshots: DataFrame, as_of: datetime | str | Column, baseline: str = "sum"
) -> DataFrame:
    """Supply per mint over [1 h, 5 min) and [24 h, 1 h) before ``as_of``, in one pass over 24 hours.

    ``baseline`` adds up the snapshots of the window ('sum') or takes its last one ('last').
    """
    now = moment(as_of)

    def ago(interval: str) -> Column:
        return now - F.expr(f"INTERVAL {interval}")

    at = F.col("snapshot_at")
    hour = at >= ago("1 HOUR")

    def window(inside: Column) -> Column:
        value = F.when(inside, F.col("supply"))
        if baseline == "last":
            return F.max_by(value, F.when(inside, F.struct("snapshot_at", "slot")))
        return F.sum(value)

    return (
        snapshots.filter((at >= ago("24 HOURS")) & (at < ago("5 MINUTES")))
        .groupBy("mint_address")
        .agg(window(hour).alias("supply_1h_ago"), window(~hour).alias("supply_24h_ago"))
    )


def latest_holdings(holders: DataFrame) -> DataFrame:
    """Token accounts and total balance of each mint's latest holder snapshot."""
    per_time = holders.groupBy("mint_address", "snapshot_at").agg(
        F.count(F.lit(1)).alias("holder_count"), F.sum("balance").alias("total_supply")
    )
    return first_per_group(per_time, ["mint_address"], [F.col("snapshot_at").desc()])


def token_status(
    current: DataFrame,
    snapshots: DataFrame,
    ingestions: DataFrame,
    registry: DataFrame,
    as_of: datetime | str | Column,
    baseline: str = "sum",
) -> DataFrame:
    """Current holders and supply next to both baselines, the last ingestion and the symbol.

    All inputs are reduced to one row per mint before they are joined.
    """
    last = ingestions.groupBy("mint_address").agg(F.max("snapshot_at").alias("last_ingested_at_db"))
    symbols = registry.filter("is_active").select("mint_address", F.col("symbol").alias("_symbol"))
    past = supply_baselines(snapshots, as_of, baseline)
    return (
        current.withColumnRenamed("snapshot_at", "last_ingested_at")
        .join(past, "mint_address", "left")
        .join(last, "mint_address", "left")
        .join(symbols, "mint_address", "left")
        .select(
            "mint_address",
            F.coalesce("_symbol", first_eight(F.col("mint_address"))).alias("symbol"),
            F.coalesce("holder_count", F.lit(0)).alias("holder_count"),
            F.coalesce("total_supply", F.lit(0.0)).alias("total_supply"),
            "last_ingested_at",
            F.when(F.col("supply_1h_ago") != 0, F.col("supply_1h_ago")).alias("supply_1h_ago"),
            F.when(F.col("supply_24h_ago") != 0, F.col("supply_24h_ago")).alias("supply_24h_ago"),
            "last_ingested_at_db",
        )
    )


def lifecycle_events(
    status: DataFrame, as_of: datetime | str | Column, retire_first: bool = False
) -> DataFrame:
    """At most one event per token: rug, then stale, then retired.

    In that order a token idle for 30 days is always stale before it can retire; ``retire_first`` tests
    retirement before staleness.
    """
    now = moment(as_of)
    idle = days_between(F.col("last_ingested_at"), now)
    drop = 1 - F.col("total_supply") / F.col("supply_1h_ago")
    is_rug = (F.col("supply_1h_ago") != 0) & (F.col("total_supply") != 0) & (drop >= RUG_DROP)
    is_stale = idle >= STALE_DAYS
    is_retired = (F.col("holder_count") <= 0) & (F.col("total_supply") <= 0) & (idle >= RETIRE_DAYS)
    order = [("retired", is_retired), ("stale_flagged", is_stale)]
    if not retire_first:
        order.reverse()
    event = F.when(is_rug, "rug_flagged")
    for name, test in order:
        event = event.when(test, name)

    rug = F.struct(
        F.col("supply_1h_ago").alias("supply_before"),
        F.col("total_supply").alias("supply_after"),
        drop.alias("drop_ratio"),
    )
    stale = F.struct(F.col("last_ingested_at_db").alias("last_ingested"))
    retired = F.struct(
        F.col("last_ingested_at_db").alias("last_ingested"),
        days_between(F.col("last_ingested_at_db"), now).alias("days_inactive"),
    )
    kind = F.col("event_type")
    return (
        status.withColumn("event_type", event)
        .filter(kind.isNotNull())
        .select(
            "mint_address",
            "event_type",
            F.when(kind == "rug_flagged", F.to_json(rug))
            .when(kind == "stale_flagged", F.to_json(stale))
            .otherwise(F.to_json(retired))
            .alias("details"),
            now.alias("created_at"),
        )
    )


def apply_events(tokens: DataFrame, events: DataFrame) -> DataFrame:
    """Registry with status, message and tag of the events; only retirement switches a token off."""

    def lookup(values: dict[str, str]) -> Column:
        entries = [F.lit(x) for pair in values.items() for x in pair]
        return F.create_map(*entries)[F.col("event_type")]

    updates = events.select(
        "mint_address",
        lookup(STATUS).alias("verification_status"),
        lookup(MESSAGE).alias("verification_error"),
        F.array(lookup(TAG)).alias("tags"),
        F.when(F.col("event_type") == "retired", F.lit(False)).alias("is_active"),
        F.col("created_at").alias("updated_at"),
    )
    rules = {
        "verification_status": "replace",
        "verification_error": "replace",
        "tags": "array_concat",
        "is_active": "coalesce_new",
        "updated_at": "replace",
    }
    return merge_by_key(tokens, updates, ["mint_address"], rules, insert=False)


def event_counts(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.agg(
        F.count_if(kind == "retired").alias("retired"),
        F.count_if(kind == "rug_flagged").alias("flagged_rug"),
        F.count_if(kind == "stale_flagged").alias("flagged_stale"),
    )
