"""Supply and network snapshot history."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import first_eight
from ledgerlens.functions.times import moment
from ledgerlens.operators.ordering import first_overall, first_per_group
from ledgerlens.operators.ranks import exact_medians
from ledgerlens.operators.skew import materialise

# Look-back limits in days.
MIN_DAYS, MAX_DAYS = 1, 365


def newest(df: DataFrame, column: str = "scraped_at") -> Column:
    """Latest time in the table as a scalar, the default ``as_of``."""
    return df.agg(F.max(column)).scalar()


def since(
    df: DataFrame, days: int, as_of: datetime | str | Column, date: str = "date", most: int | None = MAX_DAYS
) -> DataFrame:
    """Rows of the last ``days`` days, between one and ``most`` (None: any number).

    The filter reaches the partition column of the scan.  A look-back beyond ``most`` is cut to it with a warning.
    """
    if most is not None and days > most:
        warnings.warn(f"look-back of {days} days cut to {most}; pass most=None for all of it", stacklevel=2)
        days = most
    days = max(days, MIN_DAYS)
    return df.filter(F.col(date) >= F.date_sub(F.to_date(moment(as_of)), days))


def latest_per_symbol(supply: DataFrame) -> DataFrame:
    """Most recent snapshot of each symbol."""
    return first_per_group(
        supply, ["symbol"], [F.col("scraped_at").desc(), F.col("slot").desc(), F.col("mint")]
    )


def latest_date_per_symbol(supply: DataFrame) -> DataFrame:
    """First snapshot on the latest date of each symbol (later rows of that date do not replace it)."""
    return first_per_group(
        supply, ["symbol"], [F.col("date").desc(), F.col("scraped_at"), F.col("mint"), F.col("slot")]
    )


def daily_average(supply: DataFrame) -> DataFrame:
    return supply.groupBy("symbol", "date").agg(F.avg("ui_supply").alias("avg_supply"))


def daily_spread(supply: DataFrame) -> DataFrame:
    """Exact median, mean, lowest and highest supply per symbol and day, from one pass."""
    extra = {
        "mean_supply": F.try_divide(F.sum(F.col("_value") * F.col("n")), F.sum("n")),
        "min_supply": F.min("_value"),
        "max_supply": F.max("_value"),
    }
    return exact_medians(supply, ["symbol", "date"], "ui_supply", "median_supply", extra)


def network_daily(network: DataFrame) -> DataFrame:
    return network.groupBy("date").agg(
        F.max("total_sol_supply").alias("sol_supply"),
        F.max("circulating_sol_supply").alias("circulating"),
        F.avg("tps").alias("avg_tps"),
        F.max("transaction_count").alias("total_tx"),
        F.max("epoch").alias("current_epoch"),
    )


def table_freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Latest time of each table, one row per table."""
    parts = [
        df.agg(F.max(column).alias("last_updated")).select(F.lit(name).alias("table_name"), "last_updated")
        for name, (df, column) in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dashboard(supply: DataFrame, network: DataFrame) -> DataFrame:
    """Latest snapshot per symbol next to the latest network row, read once as a scalar."""
    row = first_overall(
        network, [F.col("scraped_at").desc(), F.col("transaction_count").desc()]
    ).select(F.struct("total_sol_supply", "tps").alias("network"))
    return (
        latest_per_symbol(supply)
        .withColumn("network", row.scalar())
        .filter(F.col("network").isNotNull())
        .select("symbol", "mint", "ui_supply", "network.total_sol_supply", "network.tps", "scraped_at")
    )


def daily_last(supply: DataFrame) -> DataFrame:
    """Last supply per date and symbol; missing supply counts as 0."""
    return supply.groupBy("date", "symbol").agg(
        F.max_by(F.coalesce("ui_supply", F.lit(0.0)), F.struct("scraped_at", "slot")).alias("ui_supply")
    )


def daily_sides(supply: DataFrame) -> DataFrame:
    """Per date and symbol: the last supply, ``first`` (mint and supply of the first snapshot) and the newest time.

    All that latest figures, changes and histories need from the snapshots, in one pass: to be written once and read by
    each of them.
    """
    amount = F.coalesce("ui_supply", F.lit(0.0)).alias("ui_supply")
    return supply.groupBy("date", "symbol").agg(
        F.max_by(amount, F.struct("scraped_at", "slot")).alias("ui_supply"),
        F.min_by(F.struct("mint", amount), F.struct("scraped_at", "mint", "slot")).alias("first"),
        F.max("scraped_at").alias("scraped_at"),
    )


def wide_history(supply: DataFrame) -> DataFrame:
    """One row per date with ``supplies``, a map from symbol to the last supply of the day, however many symbols there are.

    Nothing is looked up while the plan is made; a symbol without a name is not in the map.
    """
    named = daily_last(supply).filter(F.col("symbol").isNotNull())
    entries = F.array_sort(F.collect_list(F.struct("symbol", "ui_supply")))
    return named.groupBy("date").agg(F.map_from_entries(entries).alias("supplies"))


def supply_history(supply: DataFrame, symbols: list[str]) -> DataFrame:
    """One row per date, one column per wanted symbol; :func:`wide_history` holds all symbols."""
    return daily_last(supply).groupBy("date").pivot("symbol", symbols).agg(F.max("ui_supply"))


def symbol_columns(supply: DataFrame) -> DataFrame:
    return supply.select("symbol").distinct()


def change_from_previous_day(supply: DataFrame) -> DataFrame:
    """Percent change between the two latest dates of the table, per symbol.

    A symbol missing on a date counts as 0 there; without a positive previous value the change is 0.  The last supplies
    of the days are written once.
    """
    return change_of_days(materialise(daily_last(supply), "daily"))


def change_of_days(daily: DataFrame) -> DataFrame:
    """:func:`change_from_previous_day` from stored rows of :func:`daily_last` or :func:`daily_sides`."""
    dates = first_overall(daily.select("date").distinct(), [F.col("date").desc()], 2)
    last, previous = dates.agg(F.max("date")).scalar(), dates.agg(F.min("date")).scalar()

    def on(day: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("date") == day, F.col("ui_supply"))), F.lit(0.0))

    sides = daily.groupBy("symbol").agg(on(last).alias("now"), on(previous).alias("before"))
    change = (F.col("now") - F.col("before")) / F.col("before") * 100
    return sides.select(
        "symbol", F.when(F.col("before") > 0, change).otherwise(F.lit(0.0)).alias("pct_change_prev_day")
    )


def last_periods(history: DataFrame, n: int | None, date: str = "date") -> DataFrame:
    """Rows of the last ``n`` distinct dates; None keeps everything."""
    if n is None:
        return history
    dates = first_overall(history.select(date).distinct(), [F.col(date).desc()], n)
    return history.filter(F.col(date) >= dates.agg(F.min(date)).scalar())


def daily_holders(holders: DataFrame, days: int, as_of: datetime | str | Column) -> DataFrame:
    """Distinct wallets per day."""
    recent = since(holders.withColumn("date", F.to_date("snapshot_at")), days, as_of)
    return recent.groupBy("date").agg(F.count_distinct("wallet_address").alias("holders"))


def daily_holders_approx(holders: DataFrame, days: int, as_of: datetime | str | Column) -> DataFrame:
    """Like :func:`daily_holders` from one mergeable sketch per day instead of an exact distinct."""
    recent = since(holders.withColumn("date", F.to_date("snapshot_at")), days, as_of)
    return recent.groupBy("date").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("wallet_address")).alias("holders")
    )


#: Registers of a stored sketch: 2 ** 14, an error of about one percent.
SKETCH_BITS = 14


def daily_sketches(holders: DataFrame) -> DataFrame:
    """One mergeable sketch of the distinct wallets per day, to be stored: date, wallets (binary)."""
    days = holders.withColumn("date", F.to_date("snapshot_at")).filter(F.col("date").isNotNull())
    return days.groupBy("date").agg(F.hll_sketch_agg("wallet_address", F.lit(SKETCH_BITS)).alias("wallets"))


def window_holders(sketches: DataFrame, days: Sequence[int], as_of: datetime | str | Column) -> DataFrame:
    """About how many distinct wallets the last days held, per length of the window, from stored sketches alone.

    A window of ``n`` days ends on the day of ``as_of`` and starts ``n - 1`` days before.  All windows come from one
    pass; a window without a day has 0.
    """
    end = F.to_date(moment(as_of))
    age = F.datediff(end, F.col("date"))
    inside = sketches.filter((age >= 0) & (age < max(days))).withColumn("_age", age)
    unions = inside.agg(*[F.hll_union_agg(F.when(F.col("_age") < n, F.col("wallets"))).alias(f"_{n}") for n in days])
    rows = [
        F.struct(F.lit(n).alias("days"), F.coalesce(F.hll_sketch_estimate(f"_{n}"), F.lit(0)).alias("holders"))
        for n in days
    ]
    return unions.select(F.inline(F.array(*rows)))


def daily_supply(snapshots: DataFrame, days: int, as_of: datetime | str | Column) -> DataFrame:
    """Per mint and day: supply summed over all snapshots, and supply of the last snapshot."""
    recent = since(snapshots.withColumn("date", F.to_date("snapshot_at")), days, as_of)
    return recent.groupBy("date", "mint_address").agg(
        F.sum("supply").alias("supply_daily_sum"),
        F.max_by("supply", F.struct("snapshot_at", "slot")).alias("supply_daily_last"),
    )


def with_symbol(df: DataFrame, registry: DataFrame, mint: str = "mint_address") -> DataFrame:
    """Add ``symbol`` from the registry; unknown mints show their first eight characters."""
    names = registry.select(F.col("mint_address").alias(mint), F.col("symbol").alias("_symbol"))
    return (
        df.join(names, mint, "left")
        .withColumn("symbol", F.coalesce("_symbol", first_eight(F.col(mint))))
        .drop("_symbol")
    )


def same_day_merge(existing: DataFrame, new: DataFrame, at: str = "scraped_at") -> DataFrame:
    """Union of two snapshots where rows equal in all other columns keep only the newest time."""
    both = existing.unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in existing.schema]))
    return both.groupBy(*[c for c in both.columns if c != at]).agg(F.max(at).alias(at))


def relaxed_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union by name; types that differ are widened to their common type."""
    return left.unionByName(right)


def token_entries(supply: DataFrame, registry: DataFrame, holders: DataFrame) -> DataFrame:
    """Latest figures per symbol with registry name, holder count, median balance and previous-day change.

    Snapshots and holders are read once each; their days and counted balances are written in between.
    """
    return entries_of_days(materialise(daily_sides(supply), "daily"), registry, holders)


def entries_of_days(daily: DataFrame, registry: DataFrame, holders: DataFrame) -> DataFrame:
    """:func:`token_entries` from stored rows of :func:`daily_sides`."""
    latest = first_per_group(daily, ["symbol"], [F.col("date").desc()]).select(
        "first.mint", "symbol", F.col("first.ui_supply").alias("circulating_supply")
    )
    balances = exact_medians(
        holders, ["mint"], "ui_amount", "median_balance", {"holder_count": F.sum("n_rows")}, once=True
    )
    return (
        latest.join(registry.select("mint", "name"), "mint", "left")
        .join(balances, "mint", "left")
        .join(change_of_days(daily), "symbol", "left")
        .select(
            F.col("mint").alias("mint_address"),
            "symbol",
            F.coalesce("name", "symbol").alias("name"),
            "circulating_supply",
            F.coalesce("holder_count", F.lit(0)).alias("holder_count"),
            F.coalesce("median_balance", F.lit(0.0)).alias("median_balance"),
            F.lit(1.0).alias("price_usd"),
            F.col("circulating_supply").alias("market_cap_usd"),
            F.coalesce("pct_change_prev_day", F.lit(0.0)).alias("pct_change_prev_day"),
        )
    )
