"""Policy decisions and transfer limits."""

import json
from datetime import datetime, timedelta
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import decimal_order, decimal_text
from ledgerlens.operators import policy

OPERATION = ("op", "w", None, "payment", "payment_request", "USDC", "125.50", "recipient_blocked")
OPERATIONS = (
    "operation_id string, wallet_scope_id string, api_key_scope_id string, family string, type string, "
    "asset string, amount string, destination string"
)
POLICIES = (
    "scope string, scope_id string, profile_id string, revision_id string, default_action string, rules string"
)


def decide(spark, wallet=None, key=None, default="allow", has_key=False, **changes):
    names = [c.split(" ")[0] for c in OPERATIONS.split(", ")]
    row = dict(zip(names, OPERATION))
    row.update(changes)
    if key is not None or has_key:
        row["api_key_scope_id"] = "k"
    policies = []
    if wallet is not None:
        policies.append(("wallet", "w", "p", "r", default, json.dumps(wallet)))
    if key is not None:
        policies.append(("api_key", "k", "p", "rk", "allow", json.dumps(key)))
    operations = spark.createDataFrame([tuple(row[n] for n in names)], OPERATIONS)
    return policy.evaluate(operations, spark.createDataFrame(policies, POLICIES)).first()


def test_no_policy_allows(spark):
    row = decide(spark)
    assert (row["decision"], row["reason_code"], row["requires_approval"]) == ("allow", "implicit_default_allow", False)
    assert row["matched_rules"] == [] and row["wallet_revision_id"] is None
    assert row["reason"] == "no active policy"


RULES = [
    ([{"kind": "operation_family", "families": ["payment"]}], "allow", 1),
    ([{"id": "d", "kind": "destination", "allowlist": ["recipient_allowed"]}], "deny", 1),
    ([{"kind": "destination", "blocklist": ["recipient_blocked"]}], "deny", 1),
    ([{"kind": "destination", "blocklist": ["someone"]}], "allow", 0),
    ([{"kind": "destination", "destination": "recipient_blocked", "action": "review"}], "review", 1),
    ([{"kind": "destination"}], "review", 1),
    ([{"kind": "amount", "asset": "USDC", "max": "100"}], "deny", 1),
    ([{"kind": "amount", "asset": "SOL", "max": "100"}], "allow", 0),
    ([{"kind": "amount", "min": "125.50", "max": "125.500"}], "allow", 1),
    ([{"kind": "amount", "min": ""}], "review", 1),
    ([{"kind": "amount", "max": "not-a-decimal"}], "review", 1),
    ([{"kind": "amount", "max": 100}], "review", 1),
    ([{"kind": "amount"}], "review", 1),
    ([{"kind": "approval", "families": ["payment"]}], "approval_required", 1),
    ([{"kind": "approval", "families": ["issuance"]}], "allow", 0),
    ([{"kind": "approval", "action": "provider_approval_required"}], "provider_approval_required", 1),
    ([{"kind": "operation_family", "families": ["issuance"], "action": "deny"}], "allow", 0),
    ([{"kind": "operation_family"}], "review", 1),
    ([{"kind": "operation_type", "operationType": "payment_request", "action": "unheard of"}], "allow", 1),
    ([{"kind": "asset", "assets": ["USDC", 7]}], "allow", 1),
    ([{"kind": "velocity"}], "review", 1),
    ([{"max": "1"}], "review", 1),
    ([{"kind": "always", "action": "deny"}, {"kind": "always"}], "deny", 2),
    ([], "allow", 0),
]


@pytest.mark.parametrize("rules, decision, matches", RULES)
def test_wallet_rules(spark, rules, decision, matches):
    row = decide(spark, rules)
    assert row["decision"] == decision and len(row["matched_rules"]) == matches
    assert row["reason_code"] == "wallet_policy_match" and row["wallet_revision_id"] == "r"
    assert row["requires_approval"] == (decision in policy.APPROVALS)


def test_missing_parts_of_an_operation(spark):
    assert decide(spark, [{"kind": "amount", "max": "1"}], amount=None)["matched_rules"] == []
    assert decide(spark, [{"kind": "amount", "max": "1"}], amount="1e5")["decision"] == "review"
    assert decide(spark, [{"kind": "asset", "asset": "USDC"}], "deny", asset=None)["decision"] == "allow"
    row = decide(spark, [{"kind": "destination", "allowlist": ["a"]}], destination=None)
    assert row["decision"] == "deny" and row["reason"].startswith("destination missing")


def test_default_action_when_nothing_matches(spark):
    row = decide(spark, [{"kind": "approval", "families": ["issuance"]}], default="deny")
    assert row["decision"] == "deny" and row["matched_rules"] == []
    assert "default: deny" in row["reason"]


def test_scopes_combine(spark):
    wallet = [{"kind": "approval", "families": ["payment"]}]
    row = decide(spark, wallet, [{"id": "b", "kind": "destination", "blocklist": ["recipient_blocked"]}])
    assert (row["decision"], row["reason_code"]) == ("deny", "api_key_policy_match")
    assert [(m["scope"], m["decision"]) for m in row["matched_rules"]] == [
        ("wallet", "approval_required"),
        ("api_key", "deny"),
    ]
    provider = [{"kind": "approval", "action": "provider_approval_required"}]
    assert decide(spark, provider, wallet)["decision"] == "approval_required"
    tie = decide(spark, wallet, wallet)
    assert tie["reason_code"] == "wallet_policy_match" and tie["api_key_revision_id"] == "rk"
    assert tie["reason"].endswith("wallet=approval_required, API key=approval_required")
    implicit = decide(spark, [{"kind": "always", "action": "review"}], has_key=True)
    assert implicit["api_key_decision"] == "allow" and implicit["api_key_revision_id"] is None


def test_first_of_equal_verdicts_gives_the_reason(spark):
    row = decide(spark, [{"kind": "asset", "asset": "USDC"}, {"kind": "always"}])
    assert row["reason"].startswith("listed asset: USDC")


DAY = datetime(2024, 5, 1)


def test_wallet_limits(spark):
    rows = [
        ("w", "destination_allowlist", '{"version":1,"destinationAllowlist":["a","b"]}', DAY, DAY, 1),
        ("w", "transfer_limits", '{"version":1,"maxTransferAmount":"10"}', DAY, DAY, 2),
        ("w", "transfer_limits", '{"version":1,"maxDailyAmount":"15"}', DAY + timedelta(1), DAY + timedelta(2), 3),
        ("v", "destination_allowlist", '{"version":2,"destinationAllowlist":["a"]}', DAY, DAY, 4),
        ("u", "transfer_limits", "not json", DAY, DAY, 5),
    ]
    schema = "wallet_id string, policy_type string, policy string, created_at timestamp, updated_at timestamp, policy_id int"
    limits = policy.wallet_limits(spark.createDataFrame(rows, schema))
    got = {r["wallet_id"]: r for r in limits.collect()}
    assert got["w"]["destination_allowlist"] == ["a", "b"]
    assert (got["w"]["max_transfer_amount"], got["w"]["max_daily_amount"]) == (None, "15")
    assert (got["w"]["created_at"], got["w"]["updated_at"]) == (DAY, DAY + timedelta(2))
    assert got["v"]["destination_allowlist"] == [] and got["u"]["max_daily_amount"] is None


def test_check_limits(spark):
    def transfer(i, minute, amount, to="a", status="confirmed", wallet="w", direction="outbound"):
        return (f"t{i}", wallet, "USDC", direction, status, amount, to, DAY + timedelta(minutes=minute))

    rows = [
        transfer(1, 0, "6"),
        transfer(2, 1, "9.5"),
        transfer(3, 2, "0.5", to="z"),
        transfer(4, 3, "11"),
        transfer(5, 4, "100", status="failed"),
        transfer(6, 5, "0.1", direction="inbound"),
        transfer(7, 24 * 60, "8"),
        transfer(8, 0, "1000000", wallet="free"),
    ]
    schema = (
        "id string, wallet_id string, token string, direction string, status string, amount string, "
        "destination_address string, created_at timestamp"
    )
    limits = spark.createDataFrame(
        [("w", ["a"], "10", "15")],
        "wallet_id string, destination_allowlist array<string>, max_transfer_amount string, max_daily_amount string",
    )
    got = policy.check_limits(spark.createDataFrame(rows, schema), limits).collect()
    assert {r["id"]: r["verdict"] for r in got} == {
        "t1": "allowed",
        "t2": "exceeds_max_daily",
        "t3": "destination_not_allowed",
        "t4": "exceeds_max_transfer",
        "t7": "allowed",
        "t8": "allowed",
    }


def test_amounts_of_any_length_are_compared(spark):
    numbers = ["0", "000.0", "0.1", "0.12", "9", "10", "99.999", "100", "100.0000000000000000000001", "1" + "0" * 24, "1" + "0" * 60]
    values = [Decimal(n) for n in numbers]
    rows = [(a, b) for a in numbers for b in numbers]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", (decimal_order(F.col("a")) > decimal_order(F.col("b"))).alias("more"))
    assert all(r["more"] == (values[numbers.index(r["a"])] > values[numbers.index(r["b"])]) for r in got.collect())


def test_long_and_malformed_transfers_are_never_allowed(spark):
    schema = (
        "id string, wallet_id string, token string, direction string, status string, amount string, "
        "destination_address string, created_at timestamp"
    )
    amounts = ["1" + "0" * 31, "12,5", "1", "1" * 40, "2"]
    rows = [(f"t{i}", "w", "T", "outbound", "confirmed", a, "a", DAY + timedelta(minutes=i)) for i, a in enumerate(amounts)]
    rows += [("u0", "u", "T", "outbound", "confirmed", "1" + "0" * 31, "a", DAY), ("u1", "u", "T", "outbound", "confirmed", "1", "a", DAY + timedelta(minutes=1))]
    limits = spark.createDataFrame(
        [("w", [], "100", "200"), ("u", [], None, "1" + "0" * 31)],
        "wallet_id string, destination_allowlist array<string>, max_transfer_amount string, max_daily_amount string",
    )
    got = {r["id"]: r["verdict"] for r in policy.check_limits(spark.createDataFrame(rows, schema), limits).collect()}
    assert got == {
        "t0": "exceeds_max_transfer", "t1": "invalid_amount", "t2": "unsummable_amount", "t3": "exceeds_max_transfer",
        "t4": "unsummable_amount", "u0": "allowed", "u1": "exceeds_max_daily",
    }


def test_daily_limits_of_any_length_bind(spark):
    schema = (
        "id string, wallet_id string, token string, direction string, status string, amount string, "
        "destination_address string, created_at timestamp"
    )
    tiny = "0" * 24
    limits = {
        "a": "100", "b": f"100.{tiny}1", "c": "1" + "0" * 45, "d": f"0.{tiny}2", "e": "100.", "f": "x", "g": None,
    }
    amounts = ["60", "40", f"0.{tiny}1", f"0.{tiny}1", "9" * 45, "1"]
    rows = [
        (f"{w}{i}", w, "T", "outbound", "confirmed", a, "z", DAY + timedelta(minutes=7 * i)) for w in limits for i, a in enumerate(amounts)
    ]
    table = spark.createDataFrame(
        [(w, [], None, daily) for w, daily in limits.items()],
        "wallet_id string, destination_allowlist array<string>, max_transfer_amount string, max_daily_amount string",
    )
    got = {r["id"]: r["verdict"] for r in policy.check_limits(spark.createDataFrame(rows, schema), table).collect()}
    for w, daily in limits.items():
        for i in range(len(amounts)):
            with localcontext() as context:
                context.prec = 100
                sent = sum((Decimal(a) for a in amounts[: i + 1]), Decimal(0))
            fits = daily is None or (w != "f" and sent <= Decimal(daily))
            assert got[f"{w}{i}"] == ("invalid_max_daily" if w == "f" else "allowed" if fits else "exceeds_max_daily")


def test_decimal_text_is_canonical(spark):
    texts = {"007.50": "7.5", ".25": "0.25", "5.": "5", "000": "0", "0.0000000004": "0.0000000004", "1" + "0" * 40: "1" + "0" * 40, " 1.0 ": "1"}
    rows = spark.createDataFrame([(t,) for t in [*texts, "1,5", "-1", "", None, "1e5"]], "t string")
    got = {r["t"]: r["d"] for r in rows.select("t", decimal_text(F.col("t")).alias("d")).collect()}
    assert got == {**texts, "1,5": None, "-1": None, "": None, None: None, "1e5": None}
