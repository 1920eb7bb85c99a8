"""Shapes of the physical plans."""

import os
import re
from datetime import date, datetime

import pytest

from __spark_entry__ import queries
from ledgerlens.operators import ordering, supply
from ledgerlens.sources import tables
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
STREAMS = {"r1_r2_event_stream", "r3_holder_stream", "r5_ingest"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_no_cross_join_and_no_window_over_everything(spark):
    for name, query in queries().items():
        # The optional operators run jobs while they are planned; their plans are looked at in their own tests.
        if name in STREAMS or name == "pipeline" or re.match(r"op\d+_", name):
            continue
        text = plan(query(spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        for window in re.findall(r"windowspecdefinition\(([^)]*)", text):
            assert not re.match(r"\w+#\d+L? (ASC|DESC)", window), (name, window)


def test_latest_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    text = plan(ordering.first_per_group(df, ["k"], [F.col("id").desc()]))
    assert "Partial" in text and "WindowGroupLimit" in text
    assert "TakeOrderedAndProject" in plan(ordering.first_overall(df, [F.col("id")]))


def test_look_back_prunes_partitions_and_columns(spark, tmp_path):
    rows = [(date(2024, 1, d), "a", float(d), datetime(2024, 1, d)) for d in range(1, 30)]
    df = spark.createDataFrame(rows, "date date, symbol string, ui_supply double, scraped_at timestamp")
    tables.write_table(df, str(tmp_path / "t"))
    recent = supply.since(tables.read_table(spark, str(tmp_path / "t")), 5, "2024-01-29").select("ui_supply")
    text = plan(recent)
    assert re.search(r"PartitionFilters: \[[^\]]*date", text)
    assert "ReadSchema: struct<ui_supply:double>" in text
    assert recent.count() == 6
    assert supply.since(df, 0, "2024-01-29").count() == 2 and supply.since(df, 999, "2024-01-29").count() == 29
