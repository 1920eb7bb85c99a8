"""Ledger maintenance."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import balances, payments, scopes

NOW = datetime(2024, 5, 1, 12)


def ago(minutes):
    return NOW - timedelta(minutes=minutes)


def test_reconcile(spark):
    schema = (
        "id string, type string, status string, signature string, slot bigint, error string, updated_at timestamp"
    )
    rows = [
        ("stuck", "transfer", "processing", None, None, None, ago(6)),
        ("young", "transfer", "processing", None, None, None, ago(4)),
        ("edge", "transfer", "processing", None, None, None, ago(5)),
        ("ramp", "onramp", "processing", None, None, None, ago(60)),
        ("confirmed", "transfer_batch", "processing", "s1", None, None, ago(1)),
        ("finalized", "transfer", "processing", "s2", None, None, ago(60)),
        ("processed", "transfer", "processing", "s3", None, None, ago(60)),
        ("broken", "transfer", "processing", "s4", None, None, ago(1)),
        ("lost", "transfer", "processing", "s5", None, None, ago(6)),
        ("waiting", "transfer", "processing", "s6", None, None, ago(2)),
        ("done", "transfer", "confirmed", "s1", 7, None, ago(99)),
    ]
    chain = [("s1", 11, "confirmed", None), ("s2", 12, "finalized", None), ("s3", 13, "processed", None)]
    chain.append(("s4", 14, "confirmed", '{"err":1}'))
    result = payments.reconcile(
        spark.createDataFrame(rows, schema),
        spark.createDataFrame(chain, "signature string, slot bigint, confirmation_status string, err string"),
        NOW,
    )
    got = {r["id"]: (r["status"], r["slot"], r["error"], r["updated_at"] == NOW) for r in result.collect()}
    assert got == {
        "stuck": ("failed", None, payments.TIMED_OUT, True),
        "young": ("processing", None, None, False),
        "edge": ("processing", None, None, False),
        "ramp": ("processing", None, None, False),
        "confirmed": ("confirmed", 11, None, True),
        "finalized": ("finalized", 12, None, True),
        "processed": ("processing", None, None, False),
        "broken": ("failed", 14, '{"err":1}', True),
        "lost": ("failed", None, payments.NOT_FOUND, True),
        "waiting": ("processing", None, None, False),
        "done": ("confirmed", 7, None, False),
    }


def test_batch_status(spark):
    cases = {
        "processing": ["processing", "confirmed"],
        "confirmed": ["confirmed", "confirmed"],
        "failed": ["failed", "failed"],
        "partially_failed": ["failed", "confirmed"],
    }
    rows = [(batch, status) for batch, statuses in cases.items() for status in statuses]
    got = payments.batch_status(spark.createDataFrame(rows, "batch_id string, status string")).collect()
    assert all(r["batch_id"] == r["status"] for r in got) and len(got) == 4


@pytest.mark.parametrize("hot_rows", [50_000_000, 10])
def test_chunks_of_twenty(spark, hot_rows):
    rows = [(b, i, f"r{i}", 10**20) for b, n in (("a", 20), ("b", 21), ("c", 95)) for i in range(n)]
    df = spark.createDataFrame(
        [(b, i, r, Decimal(a)) for b, i, r, a in rows], "batch_id string, position int, recipient_id string, amount decimal(38,0)"
    )
    chunks = payments.batch_chunks(df, hot_rows=hot_rows).collect()
    assert all(r["chunk"] == r["position"] // 20 for r in chunks) and len(chunks) == len(rows)
    totals = {r["batch_id"]: (r["recipients"], r["total_amount"], r["transactions"]) for r in payments.batch_totals(df).collect()}
    assert totals == {"a": (20, 20 * 10**20, 1), "b": (21, 21 * 10**20, 2), "c": (95, 95 * 10**20, 5)}


def test_merge_feeds_does_not_depend_on_partitioning(spark):
    schema = "id string, created_at timestamp, signature string, amount string"

    def feed(ids, name):
        return spark.createDataFrame([(f"x{i}", ago(i), name, "1") for i in ids], schema)

    feeds = feed(range(0, 30), "c"), feed(range(10, 60), "o"), feed(range(5, 90, 5), "p")
    expected = {f"x{i}": "c" if i < 30 else "o" if i < 60 else "p" for i in [*range(60), *range(60, 90, 5)]}
    for parts in (1, 3, 7):
        merged = payments.merge_feeds(*[f.repartition(parts) for f in feeds]).collect()
        assert {r["id"]: r["signature"] for r in merged} == expected and len(merged) == len(expected)


def test_signature_history(spark):
    rows = [("a", 5, 1, 0), ("b", 5, 9, 1), ("c", None, 99, 2), ("a", 7, 2, 3)]
    df = spark.createDataFrame(rows, "signature string, block_time bigint, slot bigint, position int")
    assert [r["signature"] for r in payments.signature_history(df).collect()] == ["a", "b", "c"]
    assert [r["slot"] for r in payments.signature_history(df, 2).collect()] == [2, 9]


def test_running_spend_counts_instants_in_id_order(spark):
    schema = "id string, wallet_id string, token string, direction string, status string, amount string, created_at timestamp"
    rows = [(f"t{i:03d}", "w", "T", "outbound", "confirmed", "1.000000001", ago(i // 40)) for i in range(160)]
    rows += [("x", None, None, "outbound", "confirmed", "5", None), ("y", None, None, "outbound", "confirmed", "6", None)]
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: r["spent_before"] for r in payments.with_running_spend(df).collect()}
    at = sorted(rows[:160], key=lambda r: (r[-1], r[0]))
    assert {r[0]: Decimal(got[r[0]]) for r in at} == {r[0]: i * Decimal("1.000000001") for i, r in enumerate(at)}
    assert (got["x"], got["y"]) == ("0", "5")


def test_removable_keeps_the_last_wallet(spark):
    rows = [("c1", "a", "active"), ("c1", "b", "active"), ("c2", "c", "active"), ("c2", "d", "inactive")]
    df = spark.createDataFrame(rows, "config_id string, wallet_id string, status string")
    for hot_rows in (50_000_000, 1):
        assert {r["wallet_id"] for r in scopes.removable(df, hot_rows).collect()} == {"a", "b"}


def test_balances(spark):
    schema = "wallet_id string, token string, mint string, amount string, ui_amount string, decimals int"
    rows = [
        ("w1", "USDC", "m1", "1000001", "1.000001", 6),
        ("w2", "USDC", "m1", "340282366920938463", "1", 6),
        ("w3", "", "m2", "5", "0.05", 2),
        ("w4", "m2", "m2", "bad", "x", 2),
        ("w5", "SOL", "m3", "7", "0.000000007", 9),
        ("w6", "", "m1", "1", "0.5", 6),
    ]
    held = spark.createDataFrame(rows, schema)
    prices = spark.createDataFrame(
        [("m2", 2.0, " usdc "), ("m3", 5.0, "EUR")], "mint string, price double, currency string"
    )
    names = spark.createDataFrame([("m2", " TWO "), ("m3", "X")], "mint string, symbol string")
    assert [r["token"] for r in balances.fill_symbols(held, names).orderBy("wallet_id").collect()] == [
        "USDC", "USDC", "TWO", "TWO", "SOL", "",
    ]
    priced = balances.price_balances(held, prices)
    got = {r["wallet_id"]: (r["usd_price"], r["usd_value"]) for r in priced.collect()}
    assert got == {"w1": (1.0, 1.000001), "w2": (1.0, 1.0), "w3": (2.0, 0.1), "w4": (None, None), "w5": (None, None), "w6": (1.0, 0.5)}
    totals = {r["mint"]: (r["amount"], r["ui_amount"]) for r in balances.total_per_mint(held).collect()}
    assert totals["m1"] == ("340282366921938465", "340282366921.938465") and totals["m2"] == ("5", "0.05")
    assert balances.total_value(priced.filter("mint = 'm3'")).first()[0] is None
    assert [r["reason"] for r in balances.malformed_amounts(held).collect()] == ["amount"]
    assert [r["mint"] for r in balances.listed_balances(balances.valid_total_per_mint(priced)).collect()] == ["m1", "m2"]


def test_volume_skips_text(spark):
    rows = [("1.5", ago(10)), ("x", ago(10)), ("2", ago(60 * 24))]
    df = spark.createDataFrame(rows, "amount string, created_at timestamp")
    start = F.lit(datetime(2024, 5, 1))
    assert balances.volume_since(df, start).first()[0] == "1.5"
    assert balances.volume_since(df.filter("amount = 'x'"), start).first()[0] is None


def test_sums_keep_every_digit_and_count_what_cannot_be_summed(spark):
    amounts = [
        "1" + "0" * 31, "0.0000000004", "007.50", ".25", "999999999999999999.999999999999999999", "9" * 60, "0." + "9" * 60, "5.", "12,5",
        "NaN", "1" * 40, "0." + "3" * 19, None, "0", "000.000", "9" * 15 + "." + "9" * 9, "-1", "1e5", "",
    ]
    bad = {"12,5", "NaN", "-1", "1e5", ""}
    good = [a for a in amounts if a is not None and a not in bad]
    schema = "id int, wallet_id string, token string, direction string, status string, amount string, created_at timestamp"
    rows = [(i, "w", "T", "outbound", "confirmed", a, ago(500 - 20 * i)) for i, a in enumerate(amounts)]
    rows += [(900, "none", "T", "outbound", "confirmed", "x", ago(1)), (901, "zero", "T", "outbound", "confirmed", "0.000", ago(1))]
    df = spark.createDataFrame(rows, schema)
    got = {r["wallet_id"]: r for r in payments.daily_spend(df).collect()}
    assert got["w"]["unsummed"] == len(bad) and Decimal(got["w"]["spent"]) == add(good)
    assert (got["none"]["spent"], got["none"]["unsummed"], got["zero"]["spent"]) == (None, 1, "0")
    running = {r["id"]: r for r in payments.with_running_spend(df).collect()}
    for i in range(len(amounts)):
        earlier = [a for a in amounts[:i] if a is not None]
        assert Decimal(running[i]["spent_before"]) == add([a for a in earlier if a not in bad])
        assert running[i]["unsummed_before"] == sum(a in bad for a in earlier)
    total = balances.volume_since(df, F.lit(datetime(2020, 1, 1))).first()
    assert Decimal(total["volume"]) == add(good) and total["unsummed"] == len(bad) + 1


def test_running_sums_of_long_amounts_cross_spans_and_take_equal_rows(spark):
    schema = "id int, wallet_id string, token string, direction string, status string, amount string, created_at timestamp"
    amounts = ["7" * (1 + 13 * (i % 5)) + "." + "3" * (1 + 17 * (i % 3)) for i in range(60)]
    rows = [(i, "w", "T", "outbound", "confirmed", a, ago(700 - 7 * (i // 2))) for i, a in enumerate(amounts)]
    rows += [(99, "v", "T", "outbound", "confirmed", "8" * 30, ago(1))] * 4
    got = payments.with_running_spend(spark.createDataFrame(rows, schema)).collect()
    mine = {r["id"]: Decimal(r["spent_before"]) for r in got if r["wallet_id"] == "w"}
    assert mine == {i: add(amounts[:i]) for i in range(60)}
    assert sorted(int(r["spent_before"]) for r in got if r["wallet_id"] == "v") == [i * int("8" * 30) for i in range(4)]


def test_sums_are_aggregated_before_they_are_shuffled(spark):
    schema = "id int, wallet_id string, token string, direction string, status string, amount string, created_at timestamp"
    plan = payments.daily_spend(spark.createDataFrame([], schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum(_short") == 1 and "Window" not in plan and "Sort " not in plan.split("Exchange")[-1]


def add(amounts):
    """Exact sum of decimal texts."""
    from decimal import localcontext

    with localcontext() as context:
        context.prec = 300
        return sum((Decimal(a) for a in amounts), Decimal(0))


def test_values_that_are_not_finite_never_reach_a_total(spark):
    schema = "wallet_id string, token string, mint string, amount string, ui_amount string, decimals int"
    rows = [("w1", "USDC", "m1", "1", "1.5", 6), ("w2", "USDC", "m1", "2", "NaN", 6), ("w3", "USDC", "m1", "3", "Infinity", 6)]
    held = spark.createDataFrame(rows, schema)
    priced = balances.price_balances(held, spark.createDataFrame([], "mint string, price double, currency string"))
    assert {r["wallet_id"]: r["usd_value"] for r in priced.collect()} == {"w1": 1.5, "w2": None, "w3": None}
    assert balances.total_value(priced).first()["total_usd"] == 1.5
    assert balances.valid_total_per_mint(priced).first()["usd_value"] == 1.5
    assert {r["wallet_id"] for r in balances.malformed_amounts(held).collect()} == {"w2", "w3"}


def test_prices_that_are_not_finite_are_none(spark):
    schema = "wallet_id string, token string, mint string, amount string, ui_amount string, decimals int"
    rows = [(f"w{i}", "X", f"m{i}", "1" * 45 if i == 4 else "5", "1e308" if i == 3 else "2", 2) for i in range(5)]
    held = spark.createDataFrame(rows, schema)
    quoted = [("m0", float("nan"), "USD"), ("m1", float("inf"), "USD"), ("m2", -1.0, "USD"), ("m3", 1e300, "USD"), ("m4", 3.0, None)]
    priced = balances.price_balances(held, spark.createDataFrame(quoted, "mint string, price double, currency string"))
    got = {r["mint"]: (r["usd_price"], r["usd_value"]) for r in priced.collect()}
    assert got == {"m0": (None, None), "m1": (None, None), "m2": (None, None), "m3": (1e300, None), "m4": (3.0, 6.0)}
    spoilt = priced.withColumn("usd_value", F.when(F.col("mint") == "m0", float("nan")).otherwise(F.col("usd_value")))
    totals = {r["mint"]: r for r in balances.valid_total_per_mint(spoilt).collect()}
    assert totals["m0"]["usd_value"] is None and totals["m4"]["usd_value"] == 6.0
    assert (totals["m4"]["amount"], totals["m4"]["ui_amount"]) == ("1" * 45, "1" * 43 + ".11")
    assert balances.malformed_amounts(held).count() == 0


def test_unreadable_metadata_is_kept(spark):
    schema = "id string, organization_id string, project_id string, subscription_id string, due_at timestamp, status string, error string, metadata string, updated_at timestamp, created_at timestamp"
    rows = [(i, "o", "p", "s", ago(5), "pending", None, m, ago(n), ago(9)) for n, (i, m) in enumerate([("keep", "{}"), ("a", "not json"), ("b", "[1]"), ("c", '{"x":1}')])]
    got = payments.skip_duplicate_attempts(spark.createDataFrame(rows, schema), ago(0), "test")
    kept = {r["id"]: r["metadata"] for r in got.collect() if r["status"] == "skipped"}
    assert kept["a"] == "not json" and kept["b"] == "[1]" and '"x":1' in kept["c"] and "deduplicatedBy" in kept["c"]
