"""Tables in buckets, and balances and top lists kept up by deltas."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import holders
from ledgerlens.operators.merge import merge_by_key
from ledgerlens.operators.skew import kept_until_end, materialise
from ledgerlens.sources import keyed
from ledgerlens.streaming import owners


def table(spark, *rows, schema="k bigint, v string"):
    return spark.createDataFrame(list(rows), schema)


def upsert(known, new):
    return merge_by_key(known, new, ["k"], {"v": "replace"})


def values(spark, path, touched=None):
    return {r["k"]: r["v"] for r in keyed.read_keyed(spark, path, touched).collect()}


def test_a_merge_opens_touched_buckets_only(spark, tmp_path):
    path = tmp_path / "t"
    keyed.create_keyed(table(spark, *[(k, "old") for k in range(40)]), str(path), ["k"], 8)
    assert keyed.layout(spark, str(path)) == (["k"], 8)
    # The key of the update has another type; it still finds its bucket.
    updates = table(spark, (3, "new"), (100, "more"), schema="k int, v string")
    touched = keyed.touched_buckets(keyed.with_buckets(updates, str(path)))
    spoilt = [p for p in path.glob("bucket=*") if int(p.name[7:]) not in touched]
    for file in [f for p in spoilt for f in p.glob("*.parquet")]:
        file.write_bytes(b"not parquet")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert spoilt
    assert keyed.merge_keyed(updates, str(path), upsert) == touched
    found = values(spark, str(path), touched)
    assert found[3] == "new" and found[100] == "more" and set(found.values()) == {"old", "new", "more"}
    plan = keyed.read_keyed(spark, str(path), touched)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "PartitionFilters: [isnotnull(bucket" in plan


def test_emptied_buckets_errors_and_empty_updates(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create_keyed(table(spark, (1, "a"), (2, "b"), (None, "c")).filter("k IS NOT NULL"), path, ["k"], 4)
    none = table(spark, (1, "x")).limit(0)
    assert keyed.merge_keyed(none, path, upsert) == []
    assert values(spark, path) == {1: "a", 2: "b"}
    keyed.merge_keyed(table(spark, (1, None)), path, lambda known, new: known.join(new.select("k"), "k", "left_anti"))
    assert values(spark, path) == {2: "b"}
    with pytest.raises(Exception, match="null in the key"):
        keyed.merge_keyed(table(spark, (None, "x")), path, upsert)
    with pytest.raises(Exception, match="left its buckets"):
        far = table(spark, *[(k, "x") for k in range(50)])
        keyed.merge_keyed(table(spark, (2, "x")), path, lambda known, new: far)
    assert values(spark, path) == {2: "b"}
    with pytest.raises(ValueError):
        keyed.create_keyed(table(spark, (1, "a")), path, ["k"], 4)
    with pytest.raises(ValueError):
        keyed.layout(spark, str(tmp_path / "none"))


def test_an_empty_table_takes_its_first_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create_keyed(table(spark, (1, "a")).limit(0), path, ["k"], 4)
    assert values(spark, path) == {}
    keyed.merge_keyed(table(spark, (1, "a"), (2, None)), path, upsert)
    assert values(spark, path) == {1: "a", 2: None}


def folder_of(df):
    return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]


def test_intermediate_tables_go_at_the_end(spark):
    import os

    with kept_until_end(spark):
        outer = folder_of(materialise(spark.range(3), "outer"))
        with pytest.raises(ZeroDivisionError), kept_until_end(spark):
            inner = folder_of(materialise(spark.range(3), "inner"))
            assert os.path.exists(inner)
            raise ZeroDivisionError
        assert not os.path.exists(inner) and os.path.exists(outer)
    assert not os.path.exists(outer)
    assert os.path.exists(folder_of(materialise(spark.range(3), "free")))


def updates(spark, rows):
    raw = spark.createDataFrame(rows, "account string, mint string, owner string, amount long, slot long, seq long")
    return raw.withColumn("amount", F.col("amount").cast("decimal(20,0)"))


def kept(spark, root):
    lists = owners.top_lists(spark, root).select("mint", "owner", "amount", "rank").collect()
    return sorted(map(tuple, owners.owner_balances(spark, root).collect())), sorted(map(tuple, lists))


def computed(spark, rows, k):
    full = holders.owner_balances(holders.latest_accounts(updates(spark, rows)))
    lists = holders.top_holders(full, k).select("mint", "owner", "amount", "rank").collect()
    return sorted(map(tuple, full.select("mint", "owner", "amount").collect())), sorted(map(tuple, lists))


def test_balances_by_deltas_equal_the_full_computation(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "owners")
    owners.start(spark, root, 2)
    draw, seen = random.Random(5), []
    merge = keyed.merge_keyed
    for batch in range(4):
        rows = [
            (f"a{draw.randrange(25)}", f"m{draw.randrange(3)}", f"o{draw.randrange(8)}", draw.choice([0, 0, -1, 5, 10, 50]),
             draw.randrange(40), draw.randrange(3))
            for _ in range(15)
        ]
        seen += rows
        if batch:  # the first, second or third merge of the batch fails; the batch is run again
            calls = []

            def failing(changed, path, how):
                calls.append(path)
                if len(calls) == batch:
                    raise OSError("lost")
                return merge(changed, path, how)

            monkeypatch.setattr(keyed, "merge_keyed", failing)
            with pytest.raises(OSError):
                owners.apply_updates(updates(spark, rows), root, batch, 2)
            monkeypatch.setattr(keyed, "merge_keyed", merge)
        owners.apply_updates(updates(spark, rows), root, batch, 2)
        assert kept(spark, root) == computed(spark, seen, 2)
    # The last batch once more, whole: nothing is added twice.
    owners.apply_updates(updates(spark, rows), root, batch, 2)
    assert kept(spark, root) == computed(spark, seen, 2)


def test_thinned_lists_are_counted_again_and_nameless_owners_hold_nothing(spark, tmp_path):
    root = str(tmp_path / "owners")
    owners.start(spark, root, 2)
    first = [("a", "m", "x", 9, 1, 0), ("b", "m", "y", 8, 1, 0), ("c", "m", "z", 7, 1, 0), (None, "m", "w", 99, 1, 0), ("d", "m", None, 50, 1, 0)]
    owners.apply_updates(updates(spark, first), root, 0, 2)
    assert [r[1] for r in kept(spark, root)[1]] == ["x", "y"]
    # The largest owner closes the account, another account passes to someone unknown.
    owners.apply_updates(updates(spark, [("a", "m", "x", 0, 2, 0), ("b", "m", None, 8, 2, 0)]), root, 1, 2)
    assert [(r[1], int(r[2]), r[3]) for r in kept(spark, root)[1]] == [("z", 7, 1)]
    assert [r[1] for r in kept(spark, root)[0]] == ["z"]
    owners.apply_updates(updates(spark, first).limit(0), root, 2, 2)
    assert [r[1] for r in kept(spark, root)[0]] == ["z"]


def test_a_stream_keeps_balances_and_lists(spark, tmp_path):
    folder, root, seen = tmp_path / "in", str(tmp_path / "owners"), []
    folder.mkdir()
    for name, rows in [
        ("1", [("a", "m", "x", 9, 1, 0), ("b", "m", "y", 8, 1, 0)]),
        ("2", [("a", "m", "y", 9, 3, 0), ("b", "m", "y", 1, 0, 0)]),
    ]:
        seen += rows
        updates(spark, rows).coalesce(1).write.parquet(str(folder / name))
        stream = spark.readStream.schema(owners.ENTRY).option("recursiveFileLookup", "true").parquet(str(folder))
        owners.follow_owners(stream, root, str(tmp_path / "cp"), True, 2).awaitTermination()
        assert kept(spark, root) == computed(spark, seen, 20)
    assert [(r[1], int(r[2])) for r in kept(spark, root)[0]] == [("y", 17)]


def test_a_merge_moves_rows_once_and_writes_them_once(spark, tmp_path, monkeypatch):
    """No intermediate table is written for a merge, and rows that a merge has dealt are not dealt again."""
    from ledgerlens.operators import skew

    root, written = str(tmp_path / "owners"), []
    owners.start(spark, root, 2)
    monkeypatch.setattr(skew, "shared_dir", lambda spark, purpose: written.append(purpose) or str(tmp_path / f"{purpose}-{len(written)}"))
    owners.apply_updates(updates(spark, [("a", "m", "x", 9, 1, 0)]), root, 0, 2)
    owners.apply_updates(updates(spark, [("a", "m", "y", 4, 2, 0)]), root, 1, 2)
    assert kept(spark, root)[1] == [("m", "y", 4, 1)]
    assert set(written) == {"top-lists", "thin"}
    accounts = keyed.read_keyed(spark, f"{root}/accounts")
    plan = owners.renew(accounts, accounts.select("account", "mint", "owner", "amount", "slot", "seq"), 2, f"{root}/accounts")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and keyed.BUCKET in plan.columns
    assert not list((tmp_path / "owners" / "accounts").glob("_draft*"))
