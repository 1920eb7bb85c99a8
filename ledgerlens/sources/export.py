"""Results for readers outside Spark: JSON documents, cache rows, CSV.

A document that grows with the data is written as one JSON row per entry, never gathered into one value.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.times import moment
from ledgerlens.operators.ordering import first_overall

# CSV header, refresh period of the cache.
CSV_COLUMNS = {
    "Symbol": ("symbol", None),
    "Name": ("name", None),
    "Total Supply": ("total_supply", None),
    "Circulating Supply": ("circulating_supply", "total_supply"),
    "Market Cap": ("market_cap_usd", 0),
    "Holders": ("holder_count", None),
    "Median Balance": ("median_balance", None),
    "Price": ("price_usd", 0),
    "24h Change": ("pct_change_prev_day", 0),
}
REFRESH_SECONDS = 300


def _token_json() -> Column:
    return F.struct(
        F.col("mint_address").alias("mintAddress"),
        "symbol",
        "name",
        F.col("circulating_supply").alias("totalSupply"),
        F.col("circulating_supply").alias("circulatingSupply"),
        F.col("holder_count").alias("holderCount"),
        F.col("median_balance").alias("medianBalance"),
        F.col("price_usd").alias("priceUsd"),
        F.col("market_cap_usd").alias("marketCapUsd"),
        F.col("pct_change_prev_day").alias("percentChange24h"),
    )


def _share_json(name: str) -> Column:
    return F.struct(name, "percentage", F.col("holder_count").alias("holderCount"))


def analytics_document(
    entries: DataFrame,
    geography: DataFrame,
    attribution: DataFrame,
    holders_history: DataFrame,
    supply_history: DataFrame,
) -> DataFrame:
    """The analytics document as JSON rows: section, key of the entry inside the section, entry."""

    def section(df: DataFrame, name: str, key: Column, entry: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("section"), key.cast("string").alias("key"), F.to_json(entry).alias("entry")
        )

    totals = entries.agg(F.sum("holder_count").alias("totalHolders"))
    parts = [
        section(entries, "stablecoins", F.col("symbol"), _token_json()),
        section(totals, "holders", F.lit("total"), F.struct("totalHolders")),
        section(geography, "geography", F.col("region"), _share_json("region")),
        section(attribution, "attribution", F.col("category"), _share_json("category")),
        section(
            holders_history,
            "holdersHistory",
            F.col("date"),
            F.struct(F.col("date").cast("string").alias("date"), F.col("holders").alias("value")),
        ),
        section(
            supply_history,
            "supplyHistory",
            F.concat_ws("/", F.col("date").cast("string"), "symbol"),
            F.struct(F.col("date").cast("string").alias("date"), "symbol", F.col("ui_supply").alias("value")),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cache_rows(entries: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """One cache row per token: its JSON document, holders and supply."""
    now = moment(as_of)
    return entries.select(
        "mint_address",
        F.to_json(
            F.struct(F.array(_token_json()).alias("stablecoins"), F.col("holder_count").alias("totalHolders"))
        ).alias("response_json"),
        "holder_count",
        F.col("circulating_supply").alias("total_supply"),
        now.alias("snapshot_at"),
    )


def latest_cache(cache: DataFrame) -> DataFrame:
    """The cache row written last."""
    return first_overall(cache, [F.col("id").desc()])


def cache_freshness(cache: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Age of the newest cache row and seconds to its next refresh, neither below 0."""
    age = (F.unix_micros(moment(as_of)) - F.unix_micros("snapshot_at")) / 1_000_000
    return latest_cache(cache).select(
        F.greatest(F.lit(0), F.floor(age + 0.5)).cast("bigint").alias("cache_age_seconds")
    ).withColumn(
        "next_refresh_seconds",
        F.greatest(F.lit(0), F.lit(REFRESH_SECONDS) - F.col("cache_age_seconds")).cast("bigint"),
    )


def csv_rows(entries: DataFrame) -> DataFrame:
    """The nine export columns with their defaults, all as text."""

    def value(column: str, default: str | int | None) -> Column:
        if default is None:
            return F.col(column)
        return F.coalesce(column, F.col(default) if isinstance(default, str) else F.lit(float(default)))

    return entries.select(
        *[value(c, d).cast("string").alias(header) for header, (c, d) in CSV_COLUMNS.items()]
    )


def write_csv(entries: DataFrame, path: str) -> None:
    csv_rows(entries).write.mode("overwrite").option("header", "true").csv(path)
