"""Sources that several results are made from are read once."""

from datetime import date, datetime

import pytest

from ledgerlens.operators import labels, supply

SNAPSHOT = "date date, mint string, symbol string, ui_supply double, scraped_at timestamp, slot long"


@pytest.fixture
def tapped(spark):
    """A table that counts the rows that are read from it."""

    def tap(df):
        seen = spark.sparkContext.accumulator(0)

        def count(frames):
            for frame in frames:
                seen.add(len(frame))
                yield frame

        return df.mapInPandas(count, df.schema), seen

    return tap


def snapshots(spark):
    rows = [
        (date(2024, 1, d), f"m{s}", s, None if d == 2 and s == "b" else float(10 * d + h), datetime(2024, 1, d, h), h)
        for d in (1, 2, 3)
        for s in ("a", "b", None)
        for h in (1, 5, 9)
        if (d, s) != (3, "b")
    ]
    return spark.createDataFrame(rows, SNAPSHOT)


def test_entries_read_snapshots_and_holders_once(spark, tapped):
    names = spark.createDataFrame([("ma", "Alpha")], "mint string, name string")
    held = [("ma", 1.0), ("ma", 4.0), ("ma", 4.0), ("ma", None), ("mb", None)]
    rows, read = tapped(snapshots(spark))
    holders, read_holders = tapped(spark.createDataFrame(held, "mint string, ui_amount double"))
    found = {r["symbol"]: r for r in supply.token_entries(rows, names, holders).collect()}
    assert (read.value, read_holders.value) == (24, len(held))
    a, b = found["a"], found["b"]
    # The first snapshot of the latest date counts; the change is that between the last ones of two dates.
    assert (a["name"], a["circulating_supply"], a["holder_count"], a["median_balance"]) == ("Alpha", 31.0, 4, 4.0)
    assert a["pct_change_prev_day"] == pytest.approx((39 - 29) / 29 * 100)
    # No supply on the second date is 0, no snapshot on the third is 0 too; a mint whose balances are all null has holders.
    assert (b["name"], b["circulating_supply"], b["holder_count"], b["median_balance"]) == ("b", 0.0, 1, 0.0)
    assert b["pct_change_prev_day"] == 0.0 and found[None]["circulating_supply"] == 31.0


def test_days_hold_what_the_sections_need(spark):
    rows = snapshots(spark)
    sides = supply.daily_sides(rows)
    last = sorted(map(str, supply.daily_last(rows).collect()))
    assert sorted(map(str, sides.select("date", "symbol", "ui_supply").collect())) == last
    changes = sorted(map(str, supply.change_from_previous_day(rows).collect()))
    assert sorted(map(str, supply.change_of_days(sides).collect())) == changes
    assert sides.agg({"scraped_at": "max"}).first()[0] == rows.agg({"scraped_at": "max"}).first()[0]
    assert supply.token_entries(rows.limit(0), rows.selectExpr("mint", "symbol AS name"), spark.createDataFrame([], "mint string, ui_amount double")).count() == 0


def test_shares_read_the_labels_once(spark, tapped):
    held = [("US", "exchange"), ("US", "unknown"), ("DE", None), ("Unknown", "fund"), (None, "fund")]
    rows, read = tapped(spark.createDataFrame(held, "geography string, attribution_category string"))
    regions, categories = labels.labelled_shares(rows)
    assert {tuple(r) for r in regions.collect()} == {("US", 67, 2), ("DE", 33, 1)}
    assert {tuple(r) for r in categories.collect()} == {("exchange", 33, 1), ("fund", 67, 2)}
    assert read.value == len(held)
    nobody = labels.labelled_shares(rows.limit(0))
    assert nobody[0].count() == nobody[1].count() == 0
