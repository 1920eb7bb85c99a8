"""Table files, maintenance and payloads."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import labels, merge, registry, supply
from ledgerlens.sources import export, landed, tables

NOW = datetime(2024, 1, 2)
SNAPSHOT = "date date, symbol string, ui_supply double, scraped_at timestamp"


def snapshot(spark, *rows):
    return spark.createDataFrame([(date(2024, 1, d), s, v, datetime(2024, 1, d, h)) for d, s, v, h in rows], SNAPSHOT)


def test_prefix_scan_skips_what_it_cannot_read(spark, tmp_path):
    snapshot(spark, (1, "a", 1.0, 1)).coalesce(1).write.parquet(str(tmp_path / "x" / "one"))
    (tmp_path / "x" / "bad.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    (tmp_path / "x" / "note.txt").write_text("hello")
    rows = tables.read_prefix(spark, str(tmp_path / "x"), SNAPSHOT)
    assert [r["symbol"] for r in rows.collect()] == ["a"]


def test_write_append_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_table_or_none(spark, path) is None
    tables.write_table(snapshot(spark, (1, "a", 1.0, 1), (2, "a", 2.0, 1)), path)
    tables.write_table(snapshot(spark, (2, "b", 3.0, 1)), path)
    assert tables.read_table(spark, path).count() == 3
    tables.write_table(snapshot(spark, (2, "c", 4.0, 1)), path, "overwrite")
    assert {r["symbol"] for r in tables.read_table_or_none(spark, path).collect()} == {"a", "c"}
    tables.replace_object(snapshot(spark, (3, "z", 1.0, 1)), path)
    assert tables.read_object(spark, path, SNAPSHOT).count() == 1


def test_append_evolving(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append_evolving(snapshot(spark, (1, "a", 1.0, 1)), path)
    tables.append_evolving(snapshot(spark, (2, "b", 2.0, 1)).withColumn("note", F.lit("new")), path)
    rows = {r["symbol"]: r["note"] for r in tables.read_table(spark, path).collect()}
    assert rows == {"a": None, "b": "new"}
    with pytest.raises(ValueError, match="ui_supply"):
        tables.append_evolving(snapshot(spark, (3, "c", 3.0, 1)).withColumn("ui_supply", F.lit("3")), path)
    assert tables.read_table(spark, path).count() == 2


def test_same_day_merge_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.merge_into_day(snapshot(spark, (1, "a", 1.0, 1), (2, "a", 1.0, 1)), path)
    for _ in range(2):
        tables.merge_into_day(snapshot(spark, (2, "a", 1.0, 5), (2, "a", 2.0, 6), (2, "a", 2.0, 4)), path)
    rows = sorted((str(r["date"]), r["ui_supply"], r["scraped_at"].hour) for r in tables.read_table(spark, path).collect())
    assert rows == [("2024-01-01", 1.0, 1), ("2024-01-02", 1.0, 5), ("2024-01-02", 2.0, 6)]


def test_append_json(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"a":1}\n{"a":2}')
    (tmp_path / "empty.json").write_text("")
    assert tables.append_json(spark, str(tmp_path / "rows.json"), str(tmp_path / "t"), NOW) == 2
    assert {r["ingested_at"] for r in tables.read_table(spark, str(tmp_path / "t")).collect()} == {NOW}
    with pytest.raises(ValueError):
        tables.append_json(spark, str(tmp_path / "empty.json"), str(tmp_path / "t"), NOW)


def test_push_absent_views_and_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.push_absent(snapshot(spark, (1, "a", 1.0, 1), (1, "b", 1.0, 1)), path, ["symbol", "scraped_at"])
    tables.register_views(spark, {"pushed": path})
    assert spark.sql("SELECT count(*) AS n FROM pushed").first()["n"] == 2
    root = str(tmp_path / "v")
    assert tables.read_version(spark, root) is None
    for value in (1.0, 2.0):
        tables.publish_version(snapshot(spark, (1, "a", value, 1)), root)
    (tmp_path / "v" / "version=3").mkdir()  # a version whose job has not committed
    assert tables.versions(spark, root) == [1, 2]
    assert tables.read_version(spark, root).first()["ui_supply"] == 2.0
    assert tables.read_version(spark, root, 1).first()["ui_supply"] == 1.0


def test_merge_by_key(spark):
    schema = "k string, a int, b int, c int, d array<string>"
    target = spark.createDataFrame([("x", 1, 5, 1, ["p"]), ("y", 2, 2, 2, ["q"]), ("w", 3, 3, 3, None)], schema)
    updates = spark.createDataFrame([("x", None, 3, 9, ["p", "r"]), ("z", 7, 7, None, ["s"])], schema)
    rules = {"a": "coalesce_new", "b": "greatest", "d": "array_union"}
    merged = merge.merge_by_key(target, updates, ["k"], rules, {"c": F.lit(50)})
    assert {r["k"]: tuple(r)[1:] for r in merged.collect()} == {
        "x": (1, 5, 1, ["p", "r"]),
        "y": (2, 2, 2, ["q"]),
        "w": (3, 3, 3, None),
        "z": (7, 7, 50, ["s"]),
    }
    assert merge.duplicate_keys(merged, ["k"]).isEmpty()
    kept = merge.merge_by_key(target, updates, ["k"], {"c": "replace"}, insert=False)
    assert {r["k"]: r["c"] for r in kept.collect()} == {"x": 9, "y": 2, "w": 3}


def test_identifier_registry(spark):
    first = registry.bootstrap_registry(spark)
    assert first.count() == 5 and first.filter("symbol = 'USDC'").first()["uuid"][14] == "5"
    new = spark.createDataFrame(
        [("m1", "S", "", None, None), (registry.BOOTSTRAP[0][0], "X", "x", None, None)],
        "mint string, symbol string, name string, network string, decimals int",
    )
    once = registry.register_identifiers(first, new)
    twice = registry.register_identifiers(once, new)
    assert twice.count() == 6
    row = twice.filter("mint = 'm1'").first()
    assert (row["name"], row["network"], row["decimals"]) == ("S", "devnet", 6)


def test_list_arguments_are_checked(spark):
    df = spark.createDataFrame([(True, "a", 1)], "is_active boolean, symbol string, priority int")
    with pytest.raises(ValueError):
        registry.list_tokens(df, sort="symbol; drop table")


def test_wide_history_has_all_or_the_wanted_symbols(spark):
    rows = snapshot(spark, (1, "a", 1.0, 1), (1, "b", 2.0, 1), (1, "a", 3.0, 2)).withColumn("slot", F.lit(1))
    more = rows.unionByName(snapshot(spark, (1, None, 9.0, 1)).withColumn("slot", F.lit(1)))
    assert supply.wide_history(more).first()["supplies"] == {"a": 3.0, "b": 2.0}
    assert supply.supply_history(rows, ["b", "c"]).columns == ["date", "b", "c"]


def test_export(spark, tmp_path):
    schema = (
        "mint_address string, symbol string, name string, total_supply double, circulating_supply double, "
        "market_cap_usd double, holder_count bigint, median_balance double, price_usd double, pct_change_prev_day double"
    )
    entries = spark.createDataFrame([("m", "S", "N", 5.0, None, None, 3, 1.5, None, None)], schema)
    export.write_csv(entries, str(tmp_path / "csv"))
    row = spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().asDict()
    assert list(row) == list(export.CSV_COLUMNS)
    assert list(row.values()) == ["S", "N", "5.0", "5.0", "0.0", "3", "1.5", "0.0", "0.0"]
    cached = json.loads(export.cache_rows(entries, NOW).first()["response_json"])
    assert cached["stablecoins"][0]["symbol"] == "S" and cached["totalHolders"] == 3
    cache = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 1, 23, 58))], "id int, snapshot_at timestamp")
    assert tuple(export.cache_freshness(cache, NOW).first()) == (120, 180)
    assert tuple(export.cache_freshness(cache.filter("id = 1"), NOW).first()) == (86400, 0)


def test_payloads(spark):
    def frame(*payloads, extra="m"):
        return spark.createDataFrame([(extra, json.dumps(p)) for p in payloads], "mint string, payload string")

    votes = frame({"current": [{"nodePubkey": f"n{i}", "activatedStake": str(i)} for i in range(30)], "delinquent": [{}]})
    fallback = landed.whales(frame(), votes, NOW).orderBy("rank").collect()
    assert [r["address"] for r in fallback[:2]] == ["n29", "n28"] and len(fallback) == 20
    listed = landed.whales(frame([{"address": "a", "lamports": 5_000_000_000}]), votes, NOW).collect()
    assert [(r["address"], r["ui_balance"], r["source"]) for r in listed] == [("a", 5.0, "rpc")]
    assert {r["status"] for r in landed.validators(votes, NOW).collect()} == {"current", "delinquent"}
    runs = spark.createDataFrame(
        [
            (NOW, "getSupply", '{"total":"5000000000","circulating":"4000000000"}'),
            (NOW, "getRecentPerformanceSamples", '{"numTransactions":100,"samplePeriodSecs":0,"slot":8}'),
            (NOW, "getEpochInfo", '{"epoch":3,"absoluteSlot":99}'),
        ],
        "run_at timestamp, method string, payload string",
    )
    row = landed.network_snapshot(runs).first()
    assert (row["total_sol_supply"], row["non_circulating_sol_supply"], row["tps"], row["slot"]) == (5.0, 0.0, 0.0, 8)
    assert row["transaction_count"] is None and row["inflation_rate"] is None and row["epoch"] == 3


def test_program_labels(spark):
    program = next(iter(labels.PROGRAMS))
    schema = "wallet_address string, geography string, attribution_category string, source string, updated_at timestamp, confidence double, source_detail string"
    rows = [(program, "Unknown", "unknown", "s", NOW, None, None), (program[::-1], "Unknown", "unknown", "s", NOW, None, None)]
    got = labels.program_attribution(spark.createDataFrame(rows, schema), NOW).collect()
    assert [r["attribution_category"] for r in got] == ["protocol:jupiter", "unknown"]


def test_external_tables_keep_schema_and_files(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(snapshot(spark, (1, "a", 1.0, 1), (2, "b", 2.0, 1)), path)
    tables.register_tables(spark, {"external_supply": path})
    assert spark.sql("SELECT count(*) AS n FROM external_supply WHERE symbol = 'a'").first()["n"] == 1
    spark.sql("DROP TABLE external_supply")
    assert tables.read_table(spark, path).count() == 2


def test_skipped_files_are_named(spark, tmp_path):
    path = tmp_path / "p"
    snapshot(spark, (1, "a", 1.0, 1)).coalesce(1).write.parquet(str(path))
    (path / "broken.parquet").write_bytes(b"no parquet")
    assert tables.read_prefix(spark, str(path), "symbol string").count() == 1
    names = [r["path"].rsplit("/", 1)[1] for r in tables.skipped_files(spark, str(path), "symbol string").collect()]
    assert names == ["broken.parquet"]


def test_two_writers_get_two_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "v")
    tables.publish_version(snapshot(spark, (1, "a", 1.0, 1)), root)
    monkeypatch.setattr(tables, "versions", lambda *_: [])  # a writer that looked before the other one finished
    assert tables.publish_version(snapshot(spark, (1, "a", 2.0, 1)), root).endswith("version=2")
    monkeypatch.undo()
    assert [tables.read_version(spark, root, n).first()["ui_supply"] for n in (1, 2)] == [1.0, 2.0]


def test_registry_is_looked_up_by_mint_and_by_uuid(spark):
    known = registry.bootstrap_registry(spark)
    row = known.first()
    assert registry.identifier_of(known, mint=row["mint"]).first() == row
    assert registry.identifier_of(known, uuid=row["uuid"]).first() == row
    with pytest.raises(ValueError):
        registry.identifier_of(known)
    rows = spark.createDataFrame([(row["mint"], 1), ("unknown", 2)], "mint string, n int")
    got = {r["n"]: r["uuid"] for r in registry.with_identifiers(rows, known).collect()}
    assert got == {1: row["uuid"], 2: None}


def spoil(path, day):
    """Make the files of one day unreadable."""
    files = list((path / f"date={day}").glob("*.parquet"))
    for file in files:
        file.write_bytes(b"not parquet")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert files


def test_appends_open_no_file_of_the_table(spark, tmp_path):
    path = tmp_path / "t"
    tables.write_table(snapshot(spark, (1, "a", 1.0, 1), (2, "b", 2.0, 1)), str(path))
    spoil(path, "2024-01-01")
    wider = snapshot(spark, (3, "c", 3.0, 1)).withColumn("note", F.lit("n"))
    tables.append_evolving(wider, str(path))
    assert [f.name for f in tables.stored_schema(spark, str(path))][-1] == "note"
    rows = tables.read_table(spark, str(path)).filter("date > '2024-01-01'").orderBy("date").collect()
    assert [(r["symbol"], r["note"]) for r in rows] == [("b", None), ("c", "n")]
    with pytest.raises(ValueError):
        tables.append_evolving(snapshot(spark, (4, "d", 3.0, 1)).withColumn("symbol", F.lit(1)), str(path))
    assert tables.stored_schema(spark, str(tmp_path / "none")) is None


def test_absent_rows_are_looked_up_on_their_days_only(spark, tmp_path):
    path = tmp_path / "t"
    rows = snapshot(spark, (1, "a", 1.0, 1), (2, "b", 2.0, 1), (3, "c", 3.0, 1))
    tables.write_table(rows.drop("date").withColumn("date", F.to_date("scraped_at")), str(path))
    days = sorted(p.name[5:] for p in path.glob("date=*"))
    for day in days[:-1]:
        spoil(path, day)
    new = rows.filter("symbol = 'c'").unionByName(rows.filter("symbol = 'c'").withColumn("symbol", F.lit("z"))).drop("date")
    if len(days) == 1:
        pytest.skip("the rows lie on one day")
    tables.push_absent(new, str(path), ["symbol", "scraped_at"], at="scraped_at")
    kept = tables.read_table(spark, str(path)).filter(F.col("date") == days[-1])
    assert sorted(r["symbol"] for r in kept.collect()) == ["c", "z"]
    with pytest.raises(ValueError):
        tables.push_absent(new, str(path), ["symbol"], at="scraped_at")


def test_intermediate_tables_need_a_shared_folder_on_a_cluster(spark):
    from ledgerlens.session import shared_dir

    class Conf(dict):
        def get(self, name, default=None):
            return super().get(name, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(Session(spark_master=master), "x")
    assert shared_dir(spark, "x").startswith("file:")


def test_stored_sketches_are_added_once_and_unioned_over_windows(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(f"w{i % (40 * d)}", datetime(2024, 1, d, 5)) for d in (1, 2, 9, 10) for i in range(60 * d)]
    holders = spark.createDataFrame([*rows, ("x", None), (None, datetime(2024, 1, 10))], "wallet_address string, snapshot_at timestamp")
    tables.add_sketches(holders.filter("day(snapshot_at) < 10"), path)
    for _ in range(2):  # nothing is left for the second time
        tables.add_sketches(holders, path)
    sketches = tables.read_table(spark, path)
    assert sketches.count() == 4
    got = {r["days"]: r["holders"] for r in supply.window_holders(sketches, [1, 2, 9, 90], datetime(2024, 1, 10, 8)).collect()}
    for days, rough in got.items():
        exact = len({w for w, at in rows if (date(2024, 1, 10) - at.date()).days < days})
        assert abs(rough - exact) <= 0.05 * exact
    assert {r["holders"] for r in supply.window_holders(sketches, [1, 5], datetime(2023, 1, 1)).collect()} == {0}
