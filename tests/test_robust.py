"""Robust statistics against numpy, with and without hot groups."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ranks, robust, skew

START = datetime(2024, 1, 1)


def brute(values, times, threshold=3.5, half_life=30.0):
    values, days = np.array(values, float), np.array([(t - START).total_seconds() / 86400 for t in times])
    centre = np.median(values)
    mad = np.median(np.abs(values - centre))
    keep = np.ones(len(values), bool)
    if len(values) >= 4 and mad > 0:
        keep = np.abs(0.6745 * (values - centre) / mad) <= threshold
    removed, values, days = int((~keep).sum()), values[keep], days[keep]
    order = np.argsort(values, kind="stable")
    cumulative = np.cumsum(np.exp(-(days.max() - days) * np.log(2) / half_life)[order])
    index = min(np.searchsorted(cumulative, cumulative[-1] / 2 * (1 - 1e-12)), len(values) - 1)
    recent = days >= days.max() - 30
    x, y = days[recent], values[recent]
    slope = strength = 0.0
    direction = "insufficient_data"
    if len(x) >= 3:
        spread = ((x - x.mean()) ** 2).sum()
        direction = "flat"
        if spread > 0:
            slope = ((x - x.mean()) * (y - y.mean())).sum() / spread
            total = ((y - y.mean()) ** 2).sum()
            strength = 1 - ((y - y.mean() - slope * (x - x.mean())) ** 2).sum() / total if total > 0 else 0.0
            margin = 0.01 * y.std()
            direction = "increasing" if slope > margin else "decreasing" if slope < -margin else "stable"
    n = len(values)
    return {
        "median_supply": np.median(values),
        "time_weighted_median": values[order][index],
        "trimmed_mean": np.sort(values)[int(n * 0.1) : int(n * 0.9)].mean(),
        "min_supply": values.min(),
        "max_supply": values.max(),
        "mean_supply": values.mean(),
        "std_supply": values.std() or None,
        "sample_count": n,
        "outliers_removed": removed,
        "trend_direction": direction,
        "trend_strength": strength,
        "trend_slope": slope,
    }


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    rows = []

    def add(symbol, values, step=6.0):
        rows.extend((symbol, float(v), START + timedelta(hours=step * i)) for i, v in enumerate(values))

    add("noisy", np.append(rng.lognormal(3, 1, 400), [1e6, -1e6]))
    add("rising", 1e9 + np.arange(150) * 10 + rng.normal(0, 3, 150))
    add("ties", rng.integers(0, 6, 500), 3.0)
    add("constant", [5.0] * 40)
    add("one_outlier", [1, 2, 3, 2, 1, 900])
    add("small", [1, 2, 4, 8])
    add("too_few", [1, 2, 3])
    rows.extend(("one_time", v, START) for v in (1.0, 2.0, 3.0, 4.0, 5.0))
    return rows


def test_summary_equals_numpy(spark, series):
    df = spark.createDataFrame(series, "symbol string, ui_supply double, scraped_at timestamp")
    got = {r["symbol"]: r.asDict() for r in robust.robust_summary(df).collect()}
    symbols = {s for s, _, _ in series}
    assert set(got) == symbols - {"too_few"}
    for symbol in got:
        mine = [(v, t) for s, v, t in series if s == symbol]
        for name, value in brute([v for v, _ in mine], [t for _, t in mine]).items():
            if isinstance(value, float) and name != "trend_slope":
                assert got[symbol][name] == pytest.approx(value, rel=1e-6, abs=1e-9), (symbol, name)
            elif name == "trend_slope":
                assert got[symbol][name] == pytest.approx(value, rel=1e-5, abs=1e-7), (symbol, name)
            else:
                assert got[symbol][name] == value, (symbol, name)


def test_options(spark, series):
    df = spark.createDataFrame(series, "symbol string, ui_supply double, scraped_at timestamp")
    rows = {r["symbol"]: r for r in robust.robust_summary(df, remove_outliers=False, min_samples=1).collect()}
    assert rows["too_few"]["sample_count"] == 3 and rows["one_outlier"]["outliers_removed"] == 0
    assert rows["too_few"]["trimmed_mean"] == 1.5
    three_left = [("s", v, START) for v in (1.0, 1.1, 1.2, 99.0)]
    df = spark.createDataFrame(three_left, "symbol string, ui_supply double, scraped_at timestamp")
    assert robust.robust_summary(df).first()["outliers_removed"] == 1
    assert robust.robust_summary(df, strict_reference=True).first()["outliers_removed"] == 0


def test_exact_medians(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(0, 1, 900), "b": rng.integers(0, 3, 200).astype(float), "c": np.array([2.0, 5.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in ranks.exact_medians(df, ["k"], "v").collect()}
    assert got.pop("d") is None
    assert got == {k: pytest.approx(np.median(v)) for k, v in values.items()}


@pytest.mark.parametrize("hot_rows", [50_000_000, 40])
def test_ordered_prefix(spark, hot_rows):
    """One group holds most rows, a third of them at one instant."""
    rng = np.random.default_rng(5)
    rows = [("hot", int(t), i, int(a)) for i, (t, a) in enumerate(zip(rng.integers(0, 90, 600), rng.integers(1, 9, 600)))]
    rows += [("hot", 45, 1000 + i, 1) for i in range(300)] + [("cold", 1, 2000, 4), ("cold", 0, 2001, 5)]
    df = spark.createDataFrame(rows, "k string, t int, id int, a int")
    hot = skew.find_hot(df, ["k"], hot_rows)
    assert (hot is None) == (hot_rows > 1000)
    got = skew.ordered_prefix(df, ["k"], "t", {"a": F.col("a"), "n": F.lit(1)}, hot, ties=["id"])
    expected, seen = {}, {}
    for k, _, i, a in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total, count = seen.get(k, (0, 0))
        expected[i] = (total, count)
        seen[k] = (total + a, count + 1)
    found = got.collect()
    assert len(found) == len(rows)
    assert {r["id"]: (r["a_before"], r["n_before"]) for r in found} == expected
    assert all((r["a_total"], r["n_total"]) == seen[r["k"]] for r in found)


@pytest.mark.parametrize("hot_rows", [50_000_000, 10])
def test_join_group_values(spark, hot_rows):
    rows = spark.createDataFrame([("a", 1)] * 50 + [("b", 2), ("c", 3)], "k string, n int")
    values = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    joined = skew.join_group_values(rows, values, ["k"], skew.find_hot(rows, ["k"], hot_rows))
    counts = {(r["k"], r["v"]): r["count"] for r in joined.groupBy("k", "v").count().collect()}
    assert counts == {("a", 10): 50, ("b", 20): 1, ("c", None): 1}


def test_ties_of_a_hot_group_lie_in_several_ranges(spark):
    df = spark.range(4000).select(F.lit("k").alias("k"), F.lit(7).alias("t"), "id")
    ranges = skew.with_range(df, ["k", "t", "id"]).groupBy("_range").count().collect()
    assert len(ranges) > 8 and max(r["count"] for r in ranges) < 1000


@pytest.mark.parametrize("stretches", [5, 900])
def test_ranks_equal_sorting(spark, monkeypatch, stretches):
    monkeypatch.setattr(ranks, "LEAST_STRETCHES", stretches)
    rng = np.random.default_rng(8)
    values = {"near": 1 + rng.permutation(700) * 1e-12, "wide": rng.normal(0, 1, 300) * 10.0 ** rng.integers(-300, 300, 300), "one": np.array([5.0])}
    rows = [(k, float(v), int(n)) for k, vs in values.items() for v, n in zip(vs, rng.integers(1, 9, len(vs)))] + [("null", None, 0)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    got = {(r["k"], r["v"]): (r["n_before"], r["n_total"]) for r in ranks.ranked(df, ["k"], "v", {"n": "n"}).collect()}
    expected, seen = {}, {}
    for k, v, n in sorted(rows, key=lambda r: (r[0], r[1] or 0)):
        expected[k, v] = seen.get(k, 0)
        seen[k] = seen.get(k, 0) + n
    assert got == {key: (before, seen[key[0]]) for key, before in expected.items()}


def test_one_large_series_is_ranked_by_many_tasks(spark):
    """The plan looks at nothing while it is made, and stretches of one symbol are sorted apart."""
    df = spark.range(20_000).selectExpr("'hot' AS k", "1 + id * 1e-9 AS v", "id AS n")
    plan = ranks.ranked(df, ["k"], "v", {"n": "n"})
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_part" in text and "partial" not in text
    stretches = plan.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    counts = ranks.exact_medians(df, ["k"], "v").collect()
    assert counts[0]["median"] == pytest.approx(1 + 9999.5e-9, abs=1e-15) and sum(r["count"] for r in stretches) == 20_000
    dealt = ranks.spread_join(df, df.limit(1).selectExpr("k", "1 AS x"), ["k"], "v")
    assert dealt.filter("x = 1").count() == 20_000
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    ranks.ranked(df, ["k"], "v", {"n": "n"})
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == jobs
