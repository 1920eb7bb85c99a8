"""Robust statistics of a measured series per group.

Outliers by the modified z-score, median, trimmed mean, time-weighted median, spread and linear trend.  All
of them are computed from *distinct values with counts*, so a repeated value is one row, and all ordered work
goes through :func:`ledgerlens.operators.ranks.ranked`, so a series of any size is ranked by many tasks.  The distinct
values, and the few figures per series that a later pass compares its rows with, are written once between the passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranks import ranked, spread_join
from ledgerlens.operators.skew import materialise, middle_value

# Fixed values of the modified z-score and of the summary.
Z_SCALE = 0.6745
Z_THRESHOLD = 3.5
OUTLIER_MIN_VALUES = 4
MIN_SAMPLES = 4
MIN_KEPT = 3
HALF_LIFE_DAYS = 30.0
TREND_DAYS = 30
TREND_MARGIN = 0.01
TRIM_LOW, TRIM_HIGH = 0.1, 0.9

SECONDS_PER_DAY = 86400.0


def _days(column: Column) -> Column:
    return F.unix_micros(column) / F.lit(1e6) / F.lit(SECONDS_PER_DAY)


def _series(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    return rows.select(
        F.coalesce(F.col(key), F.lit("UNKNOWN")).alias("series"),
        F.col(value).cast("double").alias("value"),
        F.col(at).alias("at"),
    ).filter(F.col("value").isNotNull())


def _counted(series: DataFrame) -> DataFrame:
    counted = series.groupBy("series", "value").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))
    return materialise(counted, "counted")


def _centres(counted: DataFrame) -> DataFrame:
    """Samples, median (centre) and median absolute deviation (mad) per series, from its distinct values."""
    medians = (
        ranked(counted, ["series"], "value", {"n": "n"})
        .groupBy("series")
        .agg(middle_value("value").alias("centre"), F.sum("n").alias("samples"))
    )
    medians = materialise(medians, "medians")
    deviations = (
        spread_join(counted, medians, ["series"], "value")
        .groupBy("series", F.abs(F.col("value") - F.col("centre")).alias("deviation"))
        .agg(F.sum("n").alias("n"))
    )
    mads = (
        ranked(deviations, ["series"], "deviation", {"n": "n"})
        .groupBy("series")
        .agg(middle_value("deviation").alias("mad"))
    )
    return materialise(medians.join(mads, "series"), "centres")


def _is_outlier(threshold: float) -> Column:
    score = F.abs(Z_SCALE * (F.col("value") - F.col("centre")) / F.col("mad"))
    return F.when(
        (F.col("samples") >= OUTLIER_MIN_VALUES) & (F.col("mad") > 0), score > threshold
    ).otherwise(F.lit(False))


def flag_outliers(
    rows: DataFrame,
    key: str = "symbol",
    value: str = "ui_supply",
    at: str = "scraped_at",
    threshold: float = Z_THRESHOLD,
) -> DataFrame:
    """Every observation with ``is_outlier``; nothing is flagged below four values or without spread."""
    series = _series(rows, key, value, at)
    scored = spread_join(series, _centres(_counted(series)), ["series"], "value")
    return scored.select(
        F.col("series").alias(key), "value", "at", "centre", "mad", _is_outlier(threshold).alias("is_outlier")
    )


def _statistics(kept: DataFrame, half_life_days: float) -> DataFrame:
    """Statistics per series.

    ``kept`` has series, value, at and the per-series columns centre (a value inside the data, subtracted
    before squaring so that near-constant series keep their digits) and newest (latest ``at``).
    """
    age = _days(F.col("newest")) - _days(F.col("at"))
    recent = F.col("at") >= F.col("newest") - F.expr(f"INTERVAL {TREND_DAYS} DAYS")
    offset = F.col("value") - F.col("centre")
    by_value = (
        kept.withColumn("weight", F.exp(-age * F.log(F.lit(2.0)) / half_life_days))
        .withColumn("x", F.when(recent, -age))
        .groupBy("series", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("weight").alias("w"),
            F.max(offset).alias("d"),
            F.count("x").alias("tn"),
            F.sum("x").alias("tx"),
            F.sum(F.col("x") * F.col("x")).alias("txx"),
        )
    )
    placed = ranked(by_value, ["series"], "value", {"n": "n", "w": "w"}, like=kept)
    size, start = F.col("n_total"), F.col("n_before")
    trim_from, trim_to = F.floor(size * F.lit(TRIM_LOW)), F.floor(size * F.lit(TRIM_HIGH))
    in_trim = F.greatest(
        F.lit(0), F.least(start + F.col("n"), trim_to) - F.greatest(start, trim_from)
    )
    # Running sums of doubles differ in the last digits with the order of addition.
    reached = F.col("w_before") + F.col("w") >= F.col("w_total") / 2 * (1 - 1e-12)

    sums = placed.groupBy("series").agg(
        F.sum("n").alias("samples"),
        middle_value("value").alias("median"),
        F.min(F.when(reached, F.col("value"))).alias("weighted_median"),
        (F.sum(in_trim * F.col("value")) / F.sum(in_trim)).alias("trimmed_mean"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
        F.max(F.col("value") - F.col("d")).alias("centre"),
        (F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("mean_offset"),
        (F.sum(F.col("n") * F.col("d") * F.col("d")) / F.sum("n")).alias("square_offset"),
        F.sum("tn").alias("tn"),
        F.sum("tx").alias("tx"),
        F.sum("txx").alias("txx"),
        F.sum(F.col("d") * F.col("tn")).alias("ty"),
        F.sum(F.col("d") * F.col("tx")).alias("txy"),
        F.sum(F.col("d") * F.col("d") * F.col("tn")).alias("tyy"),
    )
    n = F.col("tn")
    spread_x = F.col("txx") - F.col("tx") * F.col("tx") / n
    spread_y = F.greatest(F.col("tyy") - F.col("ty") * F.col("ty") / n, F.lit(0.0))
    shared = F.col("txy") - F.col("tx") * F.col("ty") / n
    # All observations at one instant leave only rounding noise in spread_x.
    flat = spread_x <= F.col("txx") * 1e-12
    enough = n >= 3
    slope = F.when(enough & ~flat, shared / spread_x).otherwise(F.lit(0.0))
    margin = TREND_MARGIN * F.sqrt(spread_y / n)
    return sums.select(
        "series",
        "samples",
        "median",
        "weighted_median",
        "trimmed_mean",
        "lowest",
        "highest",
        (F.col("centre") + F.col("mean_offset")).alias("mean"),
        F.sqrt(
            F.greatest(F.col("square_offset") - F.col("mean_offset") ** 2, F.lit(0.0))
        ).alias("deviation"),
        F.when(~enough, "insufficient_data")
        .when(flat, "flat")
        .when(slope > margin, "increasing")
        .when(slope < -margin, "decreasing")
        .otherwise("stable")
        .alias("trend_direction"),
        F.when(enough & ~flat & (spread_y > 0), shared * shared / (spread_x * spread_y))
        .otherwise(F.lit(0.0))
        .alias("trend_strength"),
        slope.alias("trend_slope"),
    )


def series_statistics(
    rows: DataFrame,
    key: str = "symbol",
    value: str = "ui_supply",
    at: str = "scraped_at",
    half_life_days: float = HALF_LIFE_DAYS,
) -> DataFrame:
    """Median, time-weighted median, trimmed mean, spread and trend per series, with no outlier removal."""
    series = _series(rows, key, value, at)
    profile = series.groupBy("series").agg(F.avg("value").alias("centre"), F.max("at").alias("newest"))
    kept = spread_join(series, materialise(profile, "profiles"), ["series"], "value")
    return _statistics(kept, half_life_days).withColumnRenamed("series", key)


def robust_summary(
    rows: DataFrame,
    key: str = "symbol",
    value: str = "ui_supply",
    at: str = "scraped_at",
    threshold: float = Z_THRESHOLD,
    half_life_days: float = HALF_LIFE_DAYS,
    min_samples: int = MIN_SAMPLES,
    remove_outliers: bool = True,
    strict_reference: bool = False,
) -> DataFrame:
    """One row per series with at least ``min_samples`` observations and three left after outlier removal.

    ``outliers_removed`` is the true count; ``strict_reference`` reports it as 0 when fewer than four
    values are left.
    """
    series = _series(rows, key, value, at)
    drop = _is_outlier(threshold) if remove_outliers else F.lit(False)

    counted = _counted(series)
    profile = (
        spread_join(counted, _centres(counted), ["series"], "value")
        .withColumn("dropped", drop)
        .groupBy("series", "centre", "mad", "samples")
        .agg(
            F.sum(F.when(F.col("dropped"), F.col("n")).otherwise(0)).alias("outliers"),
            F.max(F.when(~F.col("dropped"), F.col("last_at"))).alias("newest"),
        )
        .filter(
            (F.col("samples") >= min_samples) & (F.col("samples") - F.col("outliers") >= MIN_KEPT)
        )
    )
    profile = materialise(profile, "profiles")
    kept = (
        spread_join(series, profile, ["series"], "value")
        .filter(F.col("samples").isNotNull() & ~drop)
        .select("series", "value", "at", "centre", "newest")
    )
    stats = _statistics(kept, half_life_days)
    removed = F.col("outliers")
    if strict_reference:
        removed = F.when(F.col("samples") >= OUTLIER_MIN_VALUES, removed).otherwise(0)
    return stats.join(profile.select("series", "outliers"), "series").select(
        F.col("series").alias(key),
        F.col("median").alias("median_supply"),
        F.col("weighted_median").alias("time_weighted_median"),
        "trimmed_mean",
        F.col("lowest").alias("min_supply"),
        F.col("highest").alias("max_supply"),
        F.col("mean").alias("mean_supply"),
        F.when(F.col("deviation") > 0, F.col("deviation")).alias("std_supply"),
        F.col("samples").alias("sample_count"),
        removed.alias("outliers_removed"),
        "trend_direction",
        "trend_strength",
        "trend_slope",
    )

