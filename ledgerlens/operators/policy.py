"""Policy decisions for a table of operations against a table of policies.

A policy row carries its rules as one JSON array, so an operation meets its policy in one equi join and the
rules are judged inside the row: operations are never multiplied by rules.

Operations: operation_id, wallet_scope_id, api_key_scope_id (null without a key), family, type, asset, amount
(decimal text), destination.  Policies: scope ('wallet' or 'api_key'), scope_id, profile_id, revision_id (null
without an active revision), default_action, rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import decimal_order, decimal_text, is_decimal_text
from ledgerlens.operators.exact import LIMBS, SHORT_SUM, amount_parts, sum_text
from ledgerlens.operators.payments import with_running_spend
from ledgerlens.operators.skew import HOT_GROUP_ROWS, never_null

# Decisions from mild to strict, actions, policy document version.
DECISIONS = ["not_evaluated", "allow", "review", "provider_approval_required", "approval_required", "deny"]
ACTIONS = ["allow", "deny", "approval_required", "provider_approval_required", "review"]
APPROVALS = ["approval_required", "provider_approval_required"]
DOCUMENT_VERSION = 1

MATCHES = "array<struct<scope:string,rule_id:string,kind:string,decision:string,reason:string>>"


# --- reading rules ---------------------------------------------------------------------------------------


def _text(rule: Column, name: str) -> Column:
    """Field of a rule when it is a JSON string, else null."""
    value = F.try_variant_get(rule, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(rule, f"$.{name}", "string"))


def _texts(rule: Column, name: str) -> Column:
    """The strings of an array field; an empty array when the field is no array."""
    items = F.try_variant_get(rule, f"$.{name}", "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(
        F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")),
        F.array().cast("array<string>"),
    )


def _values(rule: Column, single: str, many: str) -> Column:
    one = _text(rule, single)
    first = F.when(one != "", F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, _texts(rule, many)))


def _rule(rule: Column) -> Column:
    action = _text(rule, "action")
    return F.struct(
        _text(rule, "id").alias("rule_id"),
        _text(rule, "kind").alias("kind"),
        F.when(action.isin(*ACTIONS), action).alias("action"),
        _values(rule, "family", "families").alias("families"),
        _values(rule, "operationType", "operationTypes").alias("types"),
        _values(rule, "asset", "assets").alias("assets"),
        F.array_distinct(
            F.concat(_values(rule, "destination", "destinations"), _texts(rule, "allowlist"))
        ).alias("allowed"),
        _texts(rule, "blocklist").alias("blocked"),
        _texts(rule, "families").alias("approval_families"),
        _texts(rule, "operationTypes").alias("approval_types"),
        _texts(rule, "assets").alias("approval_assets"),
        _text(rule, "min").alias("low"),
        _text(rule, "max").alias("high"),
    )


def read_policies(policies: DataFrame) -> DataFrame:
    """Policies with typed rules; done once per policy, before any operation is looked at."""
    rules = F.transform(F.from_json("rules", "array<variant>"), _rule)
    return policies.withColumn("rules", rules)


# --- judging one operation -------------------------------------------------------------------------------


def _verdict(rule: Column, decision: Column | str, reason: Column | str) -> Column:
    decision = F.lit(decision) if isinstance(decision, str) else decision
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(
        decision.alias("decision"),
        reason.alias("reason"),
        F.coalesce(rule["kind"], F.lit("unknown")).alias("kind"),
        rule["rule_id"].alias("rule_id"),
    )


def _says(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _listed(values: Column, item: Column) -> Column:
    return F.coalesce(F.array_contains(values, item), F.lit(False))


def _empty(values: Column) -> Column:
    return F.size(values) == 0


def _judge(rule: Column) -> Column:
    """Verdict of one rule on the operation of the row, null when the rule does not apply."""
    family, kind, asset = F.col("family"), F.col("type"), F.col("asset")
    amount, destination = F.col("amount"), F.col("destination")
    allow = F.coalesce(rule["action"], F.lit("allow"))

    def membership(values: Column, item: Column, label: str, empty: str) -> Column:
        return F.when(_empty(values), _verdict(rule, "review", empty)).when(
            _listed(values, item), _verdict(rule, allow, _says(f"listed {label}: ", item))
        )

    by_destination = (
        F.when(
            _empty(rule["blocked"]) & _empty(rule["allowed"]),
            _verdict(rule, "review", "destination rule without lists"),
        )
        .when(
            _listed(rule["blocked"], F.nullif(destination, F.lit(""))),
            _verdict(rule, "deny", _says("blocked destination: ", destination)),
        )
        .when(
            ~_empty(rule["allowed"]) & (F.coalesce(destination, F.lit("")) == ""),
            _verdict(rule, "deny", "destination missing"),
        )
        .when(
            ~_empty(rule["allowed"]) & ~_listed(rule["allowed"], destination),
            _verdict(rule, "deny", _says("destination not on the list: ", destination)),
        )
        .when(
            ~_empty(rule["allowed"]),
            _verdict(rule, allow, _says("listed destination: ", destination)),
        )
    )

    low, high = rule["low"], rule["high"]
    bad_bound = (low.isNotNull() & ~is_decimal_text(low)) | (high.isNotNull() & ~is_decimal_text(high))
    by_amount = F.when(
        (_empty(rule["assets"]) | _listed(rule["assets"], F.nullif(asset, F.lit("")))) & amount.isNotNull(),
        F.when(
            ~is_decimal_text(amount),
            _verdict(rule, "review", "amount is no decimal"),
        )
        .when(low.isNull() & high.isNull(), _verdict(rule, "review", "amount rule without bounds"))
        .when(bad_bound, _verdict(rule, "review", "bound is no decimal"))
        .when(
            decimal_order(amount) < decimal_order(low),
            _verdict(
                rule, "deny", _says("amount ", amount, " < minimum ", low)
            ),
        )
        .when(
            decimal_order(amount) > decimal_order(high),
            _verdict(
                rule, "deny", _says("amount ", amount, " > maximum ", high)
            ),
        )
        .otherwise(_verdict(rule, allow, _says("amount ", amount, " within bounds"))),
    )

    applies = (
        (_empty(rule["approval_families"]) | _listed(rule["approval_families"], family))
        & (_empty(rule["approval_types"]) | _listed(rule["approval_types"], kind))
        & (_empty(rule["approval_assets"]) | _listed(rule["approval_assets"], F.nullif(asset, F.lit(""))))
    )
    by_approval = F.when(
        applies,
        _verdict(
            rule,
            F.coalesce(rule["action"], F.lit("approval_required")),
            "approval rule applies",
        ),
    )
    unknown = F.when(
        rule["kind"].isNotNull(),
        _verdict(
            rule, "review", _says("unknown rule kind: ", rule["kind"])
        ),
    ).otherwise(_verdict(rule, "review", "rule without a kind"))
    return (
        F.when(rule["kind"] == "always", _verdict(rule, allow, "rule always applies"))
        .when(
            rule["kind"] == "operation_family",
            membership(
                rule["families"], family, "family", "family rule without families"
            ),
        )
        .when(
            rule["kind"] == "operation_type",
            membership(rule["types"], kind, "type", "type rule without types"),
        )
        .when(
            rule["kind"] == "asset",
            membership(rule["assets"], F.nullif(asset, F.lit("")), "asset", "asset rule without assets"),
        )
        .when(rule["kind"] == "destination", by_destination)
        .when(rule["kind"] == "amount", by_amount)
        .when(rule["kind"] == "approval", by_approval)
        .otherwise(unknown)
    )


def _rank(decision: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DECISIONS]), decision)


def strictest(verdicts: Column) -> Column:
    """Strictest of an array of structs with ``decision``; the first of equals, null when empty."""
    ranked = F.transform(
        verdicts, lambda v, i: F.struct(_rank(v["decision"]).alias("r"), (-i).alias("p"), v.alias("v"))
    )
    # max over (rank, -position): no two entries share a position, so the verdict itself is never compared.
    return F.array_max(ranked)["v"]


def _needs_approval(decision: Column) -> Column:
    return decision.isin(*APPROVALS)


def _with_result(rows: DataFrame, scope: str, label: str) -> DataFrame:
    """Add the outcome of one scope, ``{scope}_result``, for the row's operation.

    Verdicts and choice are columns of their own, so each rule is judged once per operation.
    """
    policy = F.col(f"{scope}_policy")
    rows = rows.withColumn(
        "_verdicts", F.filter(F.transform(policy["rules"], _judge), lambda v: v.isNotNull())
    ).withColumn("_chosen", strictest(F.col("_verdicts")))
    chosen, verdicts = F.col("_chosen"), F.col("_verdicts")
    active = policy["revision_id"].isNotNull()
    default = F.coalesce(policy["default_action"], F.lit("allow"))
    result = F.struct(
        F.when(active, F.coalesce(chosen["decision"], default)).otherwise("allow").alias("decision"),
        F.when(~active, f"no active {label} policy")
        .when(chosen.isNotNull(), chosen["reason"])
        .otherwise(_says(f"no {label} rule applies; default: ", default))
        .alias("reason"),
        F.when(active, f"{scope}_policy_match").otherwise(f"{scope}_policy_missing").alias("reason_code"),
        policy["revision_id"].alias("revision_id"),
        F.when(active, verdicts).alias("matched"),
        active.alias("active"),
    )
    return rows.withColumn(f"{scope}_result", result).drop("_verdicts", "_chosen", f"{scope}_policy")


def _with_policy(operations: DataFrame, policies: DataFrame, scope: str) -> DataFrame:
    rows = policies.filter(F.col("scope") == scope).select(
        F.col("scope_id").alias("_scope_id"),
        F.struct("revision_id", "default_action", "rules").alias(f"{scope}_policy"),
    )
    key = never_null(F.col(f"{scope}_scope_id"), F.col("operation_id"))
    return operations.join(rows, key == F.col("_scope_id"), "left").drop("_scope_id")


def evaluate(operations: DataFrame, policies: DataFrame) -> DataFrame:
    """Combined decision per operation, with the reason and the rules that matched.

    The API-key scope counts when the operation has a key.  Of equally strict scopes the wallet wins.
    """
    ready = read_policies(policies)
    joined = _with_policy(_with_policy(operations, ready, "wallet"), ready, "api_key")
    judged = _with_result(_with_result(joined, "wallet", "wallet"), "api_key", "API key")
    judged = judged.withColumnsRenamed({"wallet_result": "w", "api_key_result": "k"})
    has_key = F.col("api_key_scope_id").isNotNull()
    key_wins = has_key & (_rank(F.col("k.decision")) > _rank(F.col("w.decision")))

    def pick(name: str) -> Column:
        return F.when(key_wins, F.col(f"k.{name}")).otherwise(F.col(f"w.{name}"))

    implicit = ~F.col("w.active") & ~(has_key & F.coalesce("k.active", F.lit(False)))
    scopes = F.concat_ws(
        ", ",
        F.concat(F.lit("wallet="), F.col("w.decision")),
        F.when(has_key, F.concat(F.lit("API key="), F.col("k.decision"))),
    )

    def tagged(column: str, scope: str) -> Column:
        """Matched rules of a scope; none for a scope without an active policy."""
        named = F.transform(
            F.col(f"{column}.matched"),
            lambda v: F.struct(
                F.lit(scope).alias("scope"),
                v["rule_id"].alias("rule_id"),
                v["kind"].alias("kind"),
                v["decision"].alias("decision"),
                v["reason"].alias("reason"),
            ),
        )
        return F.coalesce(named, F.array().cast(MATCHES))

    key_matches = F.when(has_key, tagged("k", "api_key")).otherwise(F.array().cast(MATCHES))
    matched = F.concat(tagged("w", "wallet"), key_matches)
    return judged.select(
        "operation_id",
        pick("decision").alias("decision"),
        F.when(implicit, "implicit_default_allow").otherwise(pick("reason_code")).alias("reason_code"),
        F.when(
            implicit, "no active policy"
        )
        .otherwise(_says(pick("reason"), "; ", scopes))
        .alias("reason"),
        F.col("w.decision").alias("wallet_decision"),
        F.when(has_key, F.col("k.decision")).alias("api_key_decision"),
        matched.alias("matched_rules"),
        _needs_approval(pick("decision")).alias("requires_approval"),
        F.col("w.revision_id").alias("wallet_revision_id"),
        F.when(has_key, F.col("k.revision_id")).alias("api_key_revision_id"),
    )


# --- transfer limits -------------------------------------------------------------------------------------


def wallet_limits(rows: DataFrame) -> DataFrame:
    """Allowlist and limits per wallet from its policy rows; the last row of each type counts.

    ``rows``: wallet_id, policy_type, policy (JSON), created_at, updated_at, policy_id.  A document of another
    version counts as empty.
    """
    document = F.from_json(
        "policy",
        "version int, destinationAllowlist array<string>, maxTransferAmount string, maxDailyAmount string",
    )
    read = rows.withColumn("doc", F.when(document["version"] == DOCUMENT_VERSION, document))
    order = F.struct("created_at", "policy_id")

    def last(policy_type: str) -> Column:
        mine = F.col("policy_type") == policy_type
        held = F.struct("doc.destinationAllowlist", "doc.maxTransferAmount", "doc.maxDailyAmount")
        return F.max_by(F.when(mine, held), F.when(mine, order))

    folded = read.groupBy("wallet_id").agg(
        last("destination_allowlist").alias("d"),
        last("transfer_limits").alias("l"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )
    return folded.select(
        "wallet_id",
        F.coalesce("d.destinationAllowlist", F.array().cast("array<string>")).alias("destination_allowlist"),
        F.nullif("l.maxTransferAmount", F.lit("")).alias("max_transfer_amount"),
        F.nullif("l.maxDailyAmount", F.lit("")).alias("max_daily_amount"),
        "created_at",
        "updated_at",
    )


def check_limits(transfers: DataFrame, limits: DataFrame) -> DataFrame:
    """What the wallet's limits say about each outbound transfer, given what was sent earlier that day.

    Amounts and limits of any length are compared exactly.  An amount that is no decimal text is ``invalid_amount``, and
    where the day holds such an amount before it, a daily limit gives ``unsummable_amount``: neither is ever allowed.
    Otherwise the first violated limit is reported, in the order destination, single transfer, day.  A limit that is no
    decimal text is ``invalid_max_transfer`` or ``invalid_max_daily``.
    """
    spent = with_running_spend(transfers)
    single, daily = F.col("max_transfer_amount"), F.col("max_daily_amount")
    # What only depends on the limits is worked out once per wallet.
    rows = limits.select(
        "wallet_id",
        "destination_allowlist",
        "max_transfer_amount",
        "max_daily_amount",
        decimal_order(single).alias("_single"),
        decimal_order(daily).alias("_daily"),
        amount_parts("max_daily_amount")["short"].alias("_daily_short"),
        (single.isNotNull() & ~is_decimal_text(single)).alias("_bad_single"),
        (daily.isNotNull() & ~is_decimal_text(daily)).alias("_bad_daily"),
    )
    # Numbers that a plain decimal holds are compared as such, all others by their digits.
    sent = spent.selectExpr(
        "*",
        f"CAST(CAST(coalesce(short_before, 0) AS DECIMAL(37,9)) + CAST(coalesce(short, 0) AS DECIMAL(37,9)) AS {SHORT_SUM}) AS _sent",
        f"concat(coalesce(limbs_before, CAST(array() AS {LIMBS})), coalesce(limbs, CAST(array() AS {LIMBS}))) AS _sent_limbs",
    )
    plain = (F.size("_sent_limbs") == 0) & F.col("_daily_short").isNotNull()
    beyond_day = F.when(plain, F.col("_sent") > F.col("_daily_short")).otherwise(
        decimal_order(sum_text("_sent", "_sent_limbs")) > F.col("_daily")
    )
    outside = (F.size("destination_allowlist") > 0) & ~_listed(
        F.col("destination_allowlist"), F.col("destination_address")
    )
    order = decimal_order(F.col("amount").cast("string"))
    verdict = (
        F.when(~F.col("valid"), "invalid_amount")
        .when(outside, "destination_not_allowed")
        .when(F.col("_bad_single"), "invalid_max_transfer")
        .when(order > F.col("_single"), "exceeds_max_transfer")
        .when(F.col("_bad_daily"), "invalid_max_daily")
        .when(daily.isNotNull() & (F.col("unsummed_before") > 0), "unsummable_amount")
        .when(daily.isNotNull() & beyond_day, "exceeds_max_daily")
        .otherwise("allowed")
    )
    amount = decimal_text(F.col("amount").cast("string"))
    return sent.join(rows, "wallet_id", "left").select(
        "id", "wallet_id", "token", "day", amount.alias("amount"), "spent_before", verdict.alias("verdict")
    )
