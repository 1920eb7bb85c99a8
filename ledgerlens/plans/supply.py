"""Queries over supply and network snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.times import freshness
from ledgerlens.operators import robust, supply
from ledgerlens.operators.merge import insert_absent
from ledgerlens.operators.skew import materialise
from ledgerlens.plans.views import over
from ledgerlens.session import shared_dir
from ledgerlens.sources import adapters, export, tables

MICROS = "unix_micros({0}) as {0}"


def _stats(spark, folder):
    return robust.series_statistics(adapters.supply_snapshots(spark, folder))


def f1_lookback(spark, folder):
    snapshots = adapters.supply_snapshots(spark, folder)
    return supply.since(snapshots, 7, supply.newest(snapshots)).select("slot", "date", "symbol", "ui_supply")


def w1_latest_per_symbol(spark, folder):
    rows = supply.latest_per_symbol(adapters.supply_snapshots(spark, folder))
    return rows.selectExpr("symbol", "mint", "ui_supply", "date", MICROS.format("scraped_at"))


def w2_latest_network(spark, folder):
    network = adapters.network_snapshots(spark, folder)
    rows = supply.first_overall(network, [F.col("scraped_at").desc(), F.col("transaction_count").desc()])
    return rows.select("date", "total_sol_supply", "tps", "transaction_count")


def w3_latest_date_per_symbol(spark, folder):
    rows = supply.latest_date_per_symbol(adapters.supply_snapshots(spark, folder))
    return rows.select("symbol", "date", "ui_supply", "slot")


def a1_daily_average(spark, folder):
    rows = supply.daily_average(adapters.supply_snapshots(spark, folder))
    return rows.select("symbol", "date", F.round("avg_supply", 6).alias("avg_supply"))


def a2_daily_spread(spark, folder):
    rows = supply.daily_spread(adapters.supply_snapshots(spark, folder))
    names = ["median_supply", "mean_supply", "min_supply", "max_supply"]
    return rows.select("symbol", "date", *[F.round(n, 6).alias(n) for n in names])


def a3_network_daily(spark, folder):
    rows = supply.network_daily(adapters.network_snapshots(spark, folder))
    return rows.withColumn("avg_tps", F.round("avg_tps", 8))


def a6_freshness(spark, folder):
    rows = supply.table_freshness(
        {
            "stablecoins": (adapters.supply_snapshots(spark, folder), "scraped_at"),
            "network": (adapters.network_snapshots(spark, folder), "scraped_at"),
            "holders": (adapters.token_holders(spark, folder), "snapshot_at"),
        }
    )
    return rows.selectExpr("table_name", MICROS.format("last_updated"))


def j2_dashboard(spark, folder):
    rows = supply.dashboard(
        adapters.supply_snapshots(spark, folder), adapters.network_snapshots(spark, folder)
    )
    return rows.selectExpr(
        "symbol", "mint", "ui_supply", "total_sol_supply", "round(tps, 6) as tps", MICROS.format("scraped_at")
    )


def w8_change_previous_day(spark, folder):
    rows = supply.change_from_previous_day(adapters.supply_snapshots(spark, folder))
    return rows.select("symbol", F.round("pct_change_prev_day", 6).alias("pct_change_prev_day"))


def w9_last_periods(spark, folder):
    return supply.last_periods(supply.daily_last(adapters.supply_snapshots(spark, folder)), 7)


def v1_supply_history(spark, folder):
    wanted = ["click", "error", "purchase", "signup", "view"]
    return supply.supply_history(adapters.supply_snapshots(spark, folder), wanted)


def v1_wide_history(spark, folder):
    """The entries of each day's map, and how many there are."""
    days = supply.wide_history(adapters.supply_snapshots(spark, folder))
    return days.select("date", F.size("supplies").alias("symbols"), F.explode("supplies").alias("symbol", "ui_supply"))


def v2_symbol_columns(spark, folder):
    return supply.symbol_columns(adapters.supply_snapshots(spark, folder))


def a7_daily_holders(spark, folder):
    holders = adapters.token_holders(spark, folder)
    return supply.daily_holders(holders, 365, supply.newest(holders, "snapshot_at"))


def a7_daily_holders_sketch(spark, folder):
    holders = adapters.token_holders(spark, folder)
    return supply.daily_holders_approx(holders, 365, supply.newest(holders, "snapshot_at"))


def a7_sketch_error(spark, folder):
    """Days with their exact holders, and whether the sketch is within five percent."""
    holders = adapters.token_holders(spark, folder)
    newest = supply.newest(holders, "snapshot_at")
    rough = supply.daily_holders_approx(holders, 365, newest).withColumnRenamed("holders", "rough")
    both = supply.daily_holders(holders, 365, newest).join(rough, "date")
    close = F.abs(F.col("rough") - F.col("holders")) <= F.greatest(F.lit(1.0), F.col("holders") * 0.05)
    return both.select("date", "holders", close.alias("close"))


def a7_window_holders(spark, folder):
    """Wallets of the last 7, 30 and 90 days from stored daily sketches, and whether they are within five percent.

    The sketches of the days are written in two goes, the second of which only adds the days that are missing.
    """
    holders = adapters.token_holders(spark, folder)
    path = shared_dir(spark, "sketches")
    newest = supply.newest(holders, "snapshot_at")
    tables.add_sketches(holders.filter(F.month("snapshot_at") % 2 == 0), path)
    tables.add_sketches(holders, path)
    rough = supply.window_holders(tables.read_table(spark, path), [7, 30, 90], newest).withColumnRenamed("holders", "rough")
    age = F.datediff(F.to_date(newest), F.to_date("snapshot_at"))
    seen = holders.select("wallet_address", age.alias("age"), F.explode(F.array(*map(F.lit, (7, 30, 90)))).alias("days"))
    exact = seen.filter(F.col("age") < F.col("days")).groupBy("days").agg(F.count_distinct("wallet_address").alias("holders"))
    close = F.abs(F.col("rough") - F.col("holders")) <= F.col("holders") * 0.05
    return rough.join(exact, "days").select("days", "holders", close.alias("close"))


def a8_daily_supply(spark, folder):
    snapshots = adapters.token_supply_snapshots(spark, folder)
    rows = supply.daily_supply(snapshots, 30, supply.newest(snapshots, "snapshot_at"))
    return rows.withColumn("supply_daily_sum", F.round("supply_daily_sum", 6))


def s7_same_day_merge(spark, folder):
    """Snapshots split in two overlapping halves and merged again; values repeat within a day."""
    rows = adapters.supply_snapshots(spark, folder).select(
        "date", "symbol", F.floor("ui_supply").alias("ui_supply"), "scraped_at"
    )
    merged = supply.same_day_merge(rows.filter("hour(scraped_at) < 16"), rows.filter("hour(scraped_at) >= 8"))
    return merged.selectExpr("date", "symbol", "ui_supply", MICROS.format("scraped_at"))


def s11_insert_absent(spark, folder):
    """Snapshots on odd days are new; those of even days are known."""
    rows = adapters.token_supply_snapshots(spark, folder)
    known = rows.filter("day(snapshot_at) % 2 = 0")
    fresh = insert_absent(known, rows, ["mint_address", "snapshot_at"])
    return fresh.selectExpr("mint_address", "supply", "slot", MICROS.format("snapshot_at"))


def u2_relaxed_union(spark, folder):
    """Two snapshots whose value columns have different types."""
    rows = adapters.supply_snapshots(spark, folder)
    whole = rows.select("symbol", F.floor("ui_supply").cast("int").alias("ui_supply"))
    union = supply.relaxed_union(rows.select("symbol", "ui_supply"), whole)
    return union.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("ui_supply"), 4).alias("total")
    )


def days(spark, folder):
    """The days of all snapshots, written once."""
    return materialise(supply.daily_sides(adapters.supply_snapshots(spark, folder)), "daily")


def entries(spark, folder, daily=None):
    daily = days(spark, folder) if daily is None else daily
    holders = adapters.holder_rows(spark, folder)
    kinds = daily.select("first.mint").distinct()
    # Holder mints are numbers; those that end like a supply mint is long stand for its holders.
    named = holders.withColumn("digit", F.col("mint").cast("int") % 10).join(
        kinds.withColumn("digit", F.length("mint")).select("digit", F.col("mint").alias("kind")), "digit"
    )
    per_kind = named.select(F.col("kind").alias("mint"), "holder_address", "ui_amount")
    return supply.entries_of_days(daily, adapters.token_registry(spark, folder), per_kind)


def j3_token_entries(spark, folder):
    rows = entries(spark, folder)
    rounded = ["circulating_supply", "median_balance", "market_cap_usd", "pct_change_prev_day"]
    return rows.select(
        "mint_address", "symbol", "name", "holder_count", "price_usd", *[F.round(c, 6).alias(c) for c in rounded]
    )


def a17_outliers(spark, folder):
    rows = robust.flag_outliers(adapters.supply_snapshots(spark, folder))
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if("is_outlier").alias("outliers"),
        F.round(F.max("mad"), 6).alias("mad"),
        F.round(F.min(F.when(F.col("is_outlier"), F.col("value"))), 6).alias("smallest_outlier"),
    )


def a18_weighted_median(spark, folder):
    return _stats(spark, folder).select("symbol", F.round("weighted_median", 6).alias("weighted_median"))


def a19_trend(spark, folder):
    return _stats(spark, folder).select(
        "symbol",
        "trend_direction",
        F.round("trend_strength", 8).alias("trend_strength"),
        F.round("trend_slope", 6).alias("trend_slope"),
    )


def a20_trimmed_mean(spark, folder):
    return _stats(spark, folder).select("symbol", F.round("trimmed_mean", 6).alias("trimmed_mean"))


def a21_robust_summary(spark, folder):
    rows = robust.robust_summary(adapters.supply_snapshots(spark, folder))
    text = ["symbol", "sample_count", "outliers_removed", "trend_direction"]
    return rows.select(*text, *[F.round(c, 6).alias(c) for c in rows.columns if c not in text])


def w15_freshness_class(spark, folder):
    """Freshness of every snapshot as seen at the newest one."""
    snapshots = adapters.supply_snapshots(spark, folder)
    label = freshness(F.col("scraped_at"), supply.newest(snapshots))
    return snapshots.groupBy(label.alias("freshness")).agg(F.count(F.lit(1)).alias("snapshots"))


def v4_cache_freshness(spark, folder):
    """Every supply snapshot as a cache row, read two minutes after the last one."""
    cache = adapters.token_supply_snapshots(spark, folder).withColumnRenamed("slot", "id")
    last = supply.newest(cache, "snapshot_at")
    return export.cache_freshness(cache, last + F.expr("INTERVAL 2 MINUTES"))


def s12_cache_rows(spark, folder):
    return export.cache_rows(entries(spark, folder), "2024-02-01 00:00:00").select(
        "mint_address",
        F.get_json_object("response_json", "$.stablecoins[0].symbol").alias("symbol"),
        F.round("total_supply", 6).alias("total_supply"),
        "holder_count",
    )


def s13_csv_rows(spark, folder):
    rows = export.csv_rows(
        entries(spark, folder).withColumn("total_supply", F.col("circulating_supply"))
    )
    return rows.select("Symbol", "Name", "Holders", "Price")


_LAST = """
WITH daily AS (
  SELECT date, symbol, arg_max(ui_supply, (scraped_at, slot)) AS ui_supply FROM supply_snapshots GROUP BY 1, 2)
"""

_ENTRIES = """
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC, scraped_at, mint, slot) AS rn
                 FROM supply_snapshots) WHERE rn = 1),
per_kind AS (
  SELECT k.mint, h.ui_amount FROM holder_rows h
  JOIN (SELECT DISTINCT mint FROM supply_snapshots) k ON CAST(h.mint AS INTEGER) % 10 = length(k.mint)),
figures AS (SELECT mint, count(*) AS holder_count, median(ui_amount) AS median_balance FROM per_kind GROUP BY 1),
daily AS (
  SELECT date, symbol, arg_max(ui_supply, (scraped_at, slot)) AS ui_supply FROM supply_snapshots GROUP BY 1, 2),
dates AS (SELECT DISTINCT date FROM daily ORDER BY date DESC LIMIT 2),
sides AS (
  SELECT symbol,
         coalesce(max(CASE WHEN date = (SELECT max(date) FROM dates) THEN ui_supply END), 0) AS now,
         coalesce(max(CASE WHEN date = (SELECT min(date) FROM dates) THEN ui_supply END), 0) AS before
  FROM daily GROUP BY symbol),
entries AS (
  SELECT l.mint AS mint_address, l.symbol, coalesce(r.name, l.symbol) AS name, coalesce(f.holder_count, 0) AS holder_count,
         CAST(1.0 AS DOUBLE) AS price_usd, round(l.ui_supply, 6) AS circulating_supply,
         round(coalesce(f.median_balance, 0), 6) AS median_balance, round(l.ui_supply, 6) AS market_cap_usd,
         round(CASE WHEN s.before > 0 THEN (s.now - s.before) / s.before * 100 ELSE 0 END, 6) AS pct_change_prev_day
  FROM latest l LEFT JOIN token_registry r ON l.mint = r.mint LEFT JOIN figures f ON l.mint = f.mint
  LEFT JOIN sides s ON l.symbol = s.symbol)
"""

# Modified z-score, trimmed mean, weighted median and trend, computed with plain windows.
_SUMMARY = """
WITH med AS (SELECT symbol, median(ui_supply) AS med, count(*) AS n0 FROM supply_snapshots GROUP BY 1),
mads AS (
  SELECT s.symbol, median(abs(s.ui_supply - m.med)) AS mad FROM supply_snapshots s JOIN med m USING (symbol) GROUP BY 1),
flagged AS (
  SELECT s.*, m.med, m.n0, d.mad,
         CASE WHEN m.n0 >= 4 AND d.mad > 0 THEN abs(CAST(0.6745 AS DOUBLE) * (s.ui_supply - m.med) / d.mad) > 3.5
              ELSE FALSE END AS is_outlier
  FROM supply_snapshots s JOIN med m USING (symbol) JOIN mads d USING (symbol)),
kept AS (SELECT * FROM flagged WHERE {keep}),
aged AS (
  SELECT *, (epoch_us(max(scraped_at) OVER (PARTITION BY symbol)) - epoch_us(scraped_at)) / CAST(86400000000 AS DOUBLE)
           AS age,
         row_number() OVER (PARTITION BY symbol ORDER BY ui_supply, scraped_at, slot) - 1 AS pos,
         count(*) OVER (PARTITION BY symbol) AS n
  FROM kept),
weighted AS (
  SELECT *, sum(exp(-age * ln(2) / 30)) OVER (PARTITION BY symbol ORDER BY ui_supply, scraped_at, slot
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         sum(exp(-age * ln(2) / 30)) OVER (PARTITION BY symbol) AS tot
  FROM aged),
summary AS (
  SELECT symbol, count(*) AS n, max(n0) AS n0, median(ui_supply) AS med,
         min(CASE WHEN cum >= tot / 2 - 1e-12 * tot THEN ui_supply END) AS twm,
         avg(CASE WHEN pos >= floor(n * CAST(0.1 AS DOUBLE)) AND pos < floor(n * CAST(0.9 AS DOUBLE)) THEN ui_supply END)
           AS trimmed,
         min(ui_supply) AS lo, max(ui_supply) AS hi, avg(ui_supply) AS mean, stddev_pop(ui_supply) AS dev,
         regr_slope(CASE WHEN age <= 30 THEN ui_supply END, -age) AS slope,
         corr(CASE WHEN age <= 30 THEN ui_supply END, CASE WHEN age <= 30 THEN -age END) AS r,
         stddev_pop(CASE WHEN age <= 30 THEN ui_supply END) AS recent_dev
  FROM weighted GROUP BY symbol),
shown AS (
  SELECT *, CASE WHEN slope > CAST(0.01 AS DOUBLE) * recent_dev THEN 'increasing'
                 WHEN slope < -CAST(0.01 AS DOUBLE) * recent_dev THEN 'decreasing' ELSE 'stable' END AS direction
  FROM summary)
"""
_ALL = _SUMMARY.format(keep="TRUE")
_KEPT = _SUMMARY.format(keep="NOT is_outlier")

_S = "supply_snapshots"

QUERIES = {
    "f1_lookback": (f1_lookback, over(_S, """
        SELECT slot, date, symbol, ui_supply FROM supply_snapshots
        WHERE date >= (SELECT CAST(max(scraped_at) AS DATE) FROM supply_snapshots) - 7""")),
    "w1_latest_per_symbol": (w1_latest_per_symbol, over(_S, """
        SELECT symbol, mint, ui_supply, date, epoch_us(scraped_at) AS scraped_at FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY scraped_at DESC, slot DESC, mint) AS rn
          FROM supply_snapshots) WHERE rn = 1""")),
    "w2_latest_network": (w2_latest_network, over("network_snapshots", """
        SELECT date, total_sol_supply, tps, transaction_count FROM network_snapshots
        ORDER BY scraped_at DESC, transaction_count DESC LIMIT 1""")),
    "w3_latest_date_per_symbol": (w3_latest_date_per_symbol, over(_S, """
        SELECT symbol, date, ui_supply, slot FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC, scraped_at, mint, slot) AS rn
          FROM supply_snapshots) WHERE rn = 1""")),
    "a1_daily_average": (a1_daily_average, over(_S, """
        SELECT symbol, date, round(avg(ui_supply), 6) AS avg_supply FROM supply_snapshots GROUP BY 1, 2""")),
    "a2_daily_spread": (a2_daily_spread, over(_S, """
        SELECT symbol, date, round(median(ui_supply), 6) AS median_supply, round(avg(ui_supply), 6) AS mean_supply,
               round(min(ui_supply), 6) AS min_supply, round(max(ui_supply), 6) AS max_supply
        FROM supply_snapshots GROUP BY 1, 2""")),
    "a3_network_daily": (a3_network_daily, over("network_snapshots", """
        SELECT date, max(total_sol_supply) AS sol_supply, max(circulating_sol_supply) AS circulating,
               round(avg(tps), 8) AS avg_tps, max(transaction_count) AS total_tx, max(epoch) AS current_epoch
        FROM network_snapshots GROUP BY 1""")),
    "a6_u1_freshness": (a6_freshness, over("supply_snapshots network_snapshots token_holders", """
        SELECT 'stablecoins' AS table_name, epoch_us(max(scraped_at)) AS last_updated FROM supply_snapshots
        UNION ALL SELECT 'network', epoch_us(max(scraped_at)) FROM network_snapshots
        UNION ALL SELECT 'holders', epoch_us(max(snapshot_at)) FROM token_holders""")),
    "j2_dashboard": (j2_dashboard, over("supply_snapshots network_snapshots", """
        SELECT s.symbol, s.mint, s.ui_supply, n.total_sol_supply, round(n.tps, 6) AS tps,
               epoch_us(s.scraped_at) AS scraped_at
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY scraped_at DESC, slot DESC, mint) AS rn
              FROM supply_snapshots) s
        CROSS JOIN (SELECT * FROM network_snapshots ORDER BY scraped_at DESC, transaction_count DESC LIMIT 1) n
        WHERE s.rn = 1""")),
    "w8_change_previous_day": (w8_change_previous_day, over(_S, _LAST + """
        , dates AS (SELECT DISTINCT date FROM daily ORDER BY date DESC LIMIT 2),
        sides AS (
          SELECT symbol, coalesce(max(CASE WHEN date = (SELECT max(date) FROM dates) THEN ui_supply END), 0) AS now,
                 coalesce(max(CASE WHEN date = (SELECT min(date) FROM dates) THEN ui_supply END), 0) AS before
          FROM daily GROUP BY symbol)
        SELECT symbol, round(CASE WHEN before > 0 THEN (now - before) / before * 100 ELSE 0 END, 6)
                 AS pct_change_prev_day FROM sides""")),
    "w9_last_periods": (w9_last_periods, over(_S, _LAST + """
        SELECT date, symbol, ui_supply FROM (
          SELECT *, dense_rank() OVER (ORDER BY date DESC) AS period FROM daily) WHERE period <= 7""")),
    "v1_supply_history": (v1_supply_history, over(_S, _LAST + """
        SELECT date, max(CASE WHEN symbol = 'click' THEN ui_supply END) AS click,
               max(CASE WHEN symbol = 'error' THEN ui_supply END) AS error,
               max(CASE WHEN symbol = 'purchase' THEN ui_supply END) AS purchase,
               max(CASE WHEN symbol = 'signup' THEN ui_supply END) AS signup,
               max(CASE WHEN symbol = 'view' THEN ui_supply END) AS view
        FROM daily GROUP BY date""")),
    "v1_wide_history": (v1_wide_history, over(_S, _LAST + """
        SELECT date, count(*) OVER (PARTITION BY date) AS symbols, symbol, ui_supply FROM daily WHERE symbol IS NOT NULL""")),
    "v2_symbol_columns": (v2_symbol_columns, over(_S, "SELECT DISTINCT symbol FROM supply_snapshots")),
    "a7_daily_holders": (a7_daily_holders, over("token_holders", """
        SELECT CAST(snapshot_at AS DATE) AS date, count(DISTINCT wallet_address) AS holders FROM token_holders
        WHERE CAST(snapshot_at AS DATE) >= (SELECT CAST(max(snapshot_at) AS DATE) FROM token_holders) - 365
        GROUP BY 1""")),
    "a7_daily_holders_sketch": (a7_daily_holders_sketch, None),
    "a7_sketch_error": (a7_sketch_error, over("token_holders", """
        SELECT CAST(snapshot_at AS DATE) AS date, count(DISTINCT wallet_address) AS holders, true AS close
        FROM token_holders
        WHERE CAST(snapshot_at AS DATE) >= (SELECT CAST(max(snapshot_at) AS DATE) FROM token_holders) - 365
        GROUP BY 1""")),
    "a7_window_holders": (a7_window_holders, over("token_holders", """
        SELECT days, count(DISTINCT wallet_address) AS holders, true AS close FROM token_holders, (VALUES (7), (30), (90)) v(days)
        WHERE CAST(snapshot_at AS DATE) > (SELECT CAST(max(snapshot_at) AS DATE) FROM token_holders) - days GROUP BY 1""")),
    "a8_daily_supply": (a8_daily_supply, over(_S, """
        SELECT date, mint AS mint_address, round(sum(ui_supply), 6) AS supply_daily_sum,
               arg_max(ui_supply, (scraped_at, slot)) AS supply_daily_last
        FROM supply_snapshots
        WHERE date >= (SELECT CAST(max(scraped_at) AS DATE) FROM supply_snapshots) - 30 GROUP BY 1, 2""")),
    "s7_same_day_merge": (s7_same_day_merge, over(_S, """
        SELECT date, symbol, CAST(floor(ui_supply) AS BIGINT) AS ui_supply, epoch_us(max(scraped_at)) AS scraped_at
        FROM supply_snapshots GROUP BY 1, 2, 3""")),
    "s11_insert_absent": (s11_insert_absent, over(_S, """
        SELECT mint_address, supply, slot, snapshot_at FROM (
          SELECT mint AS mint_address, ui_supply AS supply, slot, epoch_us(scraped_at) AS snapshot_at,
                 row_number() OVER (PARTITION BY mint, scraped_at ORDER BY ui_supply, slot) AS rn
          FROM supply_snapshots WHERE day(scraped_at) % 2 = 1) WHERE rn = 1""")),
    "u2_relaxed_union": (u2_relaxed_union, over(_S, """
        SELECT symbol, count(*) AS rows, round(sum(v), 4) AS total FROM (
          SELECT symbol, ui_supply AS v FROM supply_snapshots
          UNION ALL SELECT symbol, floor(ui_supply) FROM supply_snapshots) GROUP BY 1""")),
    "j3_j4_token_entries": (j3_token_entries, over("supply_snapshots holder_rows token_registry", _ENTRIES + """
        SELECT * FROM entries""")),
    "a17_outliers": (a17_outliers, over(_S, _ALL + """
        SELECT symbol, count(*) AS samples, count(*) FILTER (WHERE is_outlier) AS outliers, round(max(mad), 6) AS mad,
               round(min(CASE WHEN is_outlier THEN ui_supply END), 6) AS smallest_outlier
        FROM flagged GROUP BY 1""")),
    "a18_weighted_median": (a18_weighted_median, over(_S, _ALL + """
        SELECT symbol, round(twm, 6) AS weighted_median FROM shown""")),
    "a19_trend": (a19_trend, over(_S, _ALL + """
        SELECT symbol, direction AS trend_direction, round(r * r, 8) AS trend_strength, round(slope, 6) AS trend_slope
        FROM shown""")),
    "a20_trimmed_mean": (a20_trimmed_mean, over(_S, _ALL + """
        SELECT symbol, round(trimmed, 6) AS trimmed_mean FROM shown""")),
    "a21_robust_summary": (a21_robust_summary, over(_S, _KEPT + """
        SELECT symbol, n AS sample_count, n0 - n AS outliers_removed, direction AS trend_direction,
               round(med, 6) AS median_supply, round(twm, 6) AS time_weighted_median, round(trimmed, 6) AS trimmed_mean,
               round(lo, 6) AS min_supply, round(hi, 6) AS max_supply, round(mean, 6) AS mean_supply,
               round(CASE WHEN dev > 0 THEN dev END, 6) AS std_supply, round(r * r, 6) AS trend_strength,
               round(slope, 6) AS trend_slope
        FROM shown WHERE n0 >= 4 AND n >= 3""")),
    "w15_freshness_class": (w15_freshness_class, over(_S, """
        WITH aged AS (
          SELECT (epoch_us((SELECT max(scraped_at) FROM supply_snapshots)) - epoch_us(scraped_at)) / 3.6e9 AS age
          FROM supply_snapshots)
        SELECT CASE WHEN age > 24 THEN 'Stale' WHEN age > 4 THEN 'Delayed' ELSE 'Live' END AS freshness,
               count(*) AS snapshots FROM aged GROUP BY 1""")),
    "v4_cache_freshness": (v4_cache_freshness, over(_S, """
        WITH last AS (SELECT scraped_at FROM supply_snapshots ORDER BY slot DESC LIMIT 1),
        age AS (
          SELECT greatest(0, CAST(floor((epoch_us((SELECT max(scraped_at) FROM supply_snapshots)) + 120000000
                 - epoch_us(scraped_at)) / 1e6 + 0.5) AS BIGINT)) AS s FROM last)
        SELECT s AS cache_age_seconds, greatest(0, 300 - s) AS next_refresh_seconds FROM age""")),
    "s12_cache_rows": (s12_cache_rows, over("supply_snapshots holder_rows token_registry", _ENTRIES + """
        SELECT mint_address, symbol, circulating_supply AS total_supply, holder_count FROM entries""")),
    "s13_csv_rows": (s13_csv_rows, over("supply_snapshots holder_rows token_registry", _ENTRIES + """
        SELECT symbol AS "Symbol", name AS "Name", CAST(holder_count AS VARCHAR) AS "Holders", '1.0' AS "Price"
        FROM entries""")),
}
