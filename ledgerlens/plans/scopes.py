"""Queries over issuance, scopes and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import issuance, policy, scopes
from ledgerlens.plans.views import over
from ledgerlens.sources import adapters


def _text(name: str):
    return F.col(name).cast("string")


# --- issuance -------------------------------------------------------------------------------------------


def j8_with_token(spark, folder):
    rows = issuance.with_token(
        adapters.issuance_transactions(spark, folder), adapters.issued_tokens(spark, folder).filter("status <> 'pending'")
    )
    return rows.select("id", "token_id", "token_symbol")


def _accounts(spark, folder):
    """One token account per supplier."""
    return adapters.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("token_id"), F.concat(F.lit("acc_"), (F.col("s_suppkey") % 40).cast("string")).alias("token_account")
    )


def f15_j11_transactions_of_wallet(spark, folder):
    """Transactions that involve three owners, or the token account of their supplier."""
    keys = adapters.table(spark, folder, "region").filter("r_regionkey < 3").select(
        F.concat(F.lit("own_"), _text("r_regionkey")).alias("public_key")
    )
    accounts = _accounts(spark, folder).withColumn(
        "token_account", F.regexp_replace("token_account", "^acc_", "own_")
    )
    rows = issuance.transactions_of_wallet(
        adapters.issuance_transactions(spark, folder),
        adapters.issued_tokens(spark, folder),
        keys,
        accounts.unionByName(_accounts(spark, folder)),
    )
    return rows.select("id", "token_id", "type")


def j11_transactions_of_accounts(spark, folder):
    rows = issuance.transactions_of_accounts(
        adapters.issuance_transactions(spark, folder), _accounts(spark, folder)
    )
    return rows.select("id", "token_id")


def j26_extensions(spark, folder):
    """Line items name five extension kinds per supplier's token."""
    lines = adapters.table(spark, folder, "lineitem")
    extensions = lines.select(
        F.col("l_suppkey").alias("token_id"),
        F.concat(F.lit("ext"), (F.col("l_linenumber") % 5).cast("string")).alias("extension"),
        F.lpad(_text("l_partkey"), 6, "0").alias("config"),
    ).filter("token_id % 3 <> 0")
    rows = issuance.with_extensions(adapters.issued_tokens(spark, folder), extensions)
    pairs = F.transform(F.map_entries("extensions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("token_id", F.array_join(pairs, ",").alias("extensions"))


def a28_issuer_summary(spark, folder):
    holders = adapters.token_holders(spark, folder)
    figures = holders.groupBy("mint_address").agg(
        F.sum("balance").alias("supply"), F.count(F.lit(1)).alias("holder_count")
    )
    rows = issuance.issuer_summary(
        adapters.issued_tokens(spark, folder), figures, ["organization_id", "project_id"]
    )
    return rows.withColumn("total_supply", F.round("total_supply", 2))


def a28_issuer_tokens(spark, folder):
    holders = adapters.token_holders(spark, folder)
    figures = holders.groupBy("mint_address").agg(
        F.sum("balance").alias("supply"), F.count(F.lit(1)).alias("holder_count")
    )
    rows = issuance.issuer_tokens(adapters.issued_tokens(spark, folder), figures)
    return rows.select("token_id", "total_supply", "holder_count", "mean_balance_rounded")


# --- scopes ---------------------------------------------------------------------------------------------

# Nations are organizations, customers their members.


def _members(spark, folder):
    key = F.col("c_custkey")
    return adapters.table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("organization_id"),
        key.alias("user_id"),
        F.when(key % 5 == 0, "removed").otherwise("active").alias("status"),
        F.col("c_acctbal").alias("created_at"),
    )


def _projects(spark, folder):
    """A sandbox for two of three organizations, and a production project for every fourth."""
    nation = adapters.table(spark, folder, "nation")
    key = F.col("n_nationkey")

    def part(condition: str, environment: str, slug: str, age: int):
        return nation.filter(condition).select(
            key.alias("organization_id"),
            F.concat(F.lit(f"{slug}-"), key.cast("string")).alias("project_id"),
            F.lit(environment).alias("environment"),
            F.lit(slug).alias("slug"),
            F.lit(age).alias("created_at"),
        )

    return (
        part("n_nationkey % 3 <> 0", "sandbox", "default-sandbox", 5)
        .unionByName(part("n_nationkey % 2 = 0", "sandbox", "trial", 1))
        .unionByName(part("n_nationkey % 4 = 0", "production", "default-production", 3))
    )


def j15_first_members(spark, folder):
    organizations = adapters.table(spark, folder, "nation").select(F.col("n_nationkey").alias("organization_id"))
    return scopes.first_members(
        organizations, _members(spark, folder), _projects(spark, folder), "production"
    )


def j16_fill_project(spark, folder):
    """Customers as API keys; every third already has a project."""
    key = F.col("c_custkey")
    rows = adapters.table(spark, folder, "customer").select(
        key.alias("api_key_id"),
        F.col("c_nationkey").alias("organization_id"),
        F.when(key % 2 == 0, "sandbox").otherwise("production").alias("environment"),
        F.when(key % 3 == 0, F.lit("own")).alias("project_id"),
    )
    filled = scopes.fill_project(rows, _projects(spark, folder), ["default-sandbox", "default-production"])
    return filled.select("api_key_id", "project_id")


def j29_fill_default_project(spark, folder):
    key = F.col("c_custkey")
    rows = adapters.table(spark, folder, "customer").select(
        key.alias("id"),
        F.col("c_nationkey").alias("organization_id"),
        F.when(key % 3 == 0, F.lit("own")).alias("project_id"),
    )
    return scopes.fill_default_project(rows, _projects(spark, folder), "default-sandbox").select("id", "project_id")


def j29_missing_memberships(spark, folder):
    """Members divisible by seven are already in the sandbox."""
    members = _members(spark, folder)
    known = members.filter("user_id % 7 = 0").select(
        F.concat(F.lit("default-sandbox-"), _text("organization_id")).alias("project_id"), "user_id"
    )
    return scopes.missing_memberships(
        _projects(spark, folder), members, known, ["default-sandbox", "default-production"]
    )


def _bindings(spark, folder):
    """Orders as bindings of an API key (its customer), to one of ten wallets or to all."""
    key = F.col("o_orderkey")
    return adapters.table(spark, folder, "orders").filter("o_custkey % 3 <> 0").select(
        F.col("o_custkey").alias("api_key_id"),
        F.concat(F.lit("w"), (key % 10).cast("string")).alias("wallet_id"),
        F.when(key % 4 == 0, "all").otherwise("selected").alias("binding_scope"),
        key.alias("binding_id"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderdate").alias("created_at"),
    )


def j17_w13_bindings(spark, folder):
    requests = adapters.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("api_key_id"),
        F.concat(F.lit("w"), (F.col("c_nationkey") % 12).cast("string")).alias("wallet_id"),
    )
    return scopes.resolve_bindings(requests, _bindings(spark, folder))


def _custody(spark, folder):
    """Suppliers as custody configurations of their nation, parts as their wallets."""
    key = F.col("s_suppkey")
    configs = adapters.table(spark, folder, "supplier").select(
        key.alias("config_id"),
        F.col("s_nationkey").alias("organization_id"),
        F.when(key % 3 != 0, key % 4).alias("project_id"),
        F.when(key % 8 == 0, "closed").otherwise("active").alias("status"),
    )
    part = F.col("p_partkey")
    wallets = adapters.table(spark, folder, "part").select(
        (part % 10).alias("config_id"),
        F.concat(F.lit("w"), (F.floor(part / 7) % 12).cast("string")).alias("wallet_id"),
        part.alias("custody_wallet_id"),
        F.when(part % 6 == 0, "inactive").otherwise("active").alias("status"),
        F.col("p_size").alias("created_at"),
    )
    return configs, wallets


def j18_targets(spark, folder):
    key = F.col("c_custkey")
    customer = adapters.table(spark, folder, "customer")
    wallet = F.concat(F.lit("w"), (key % 12).cast("string")).alias("wallet_id")
    requests = customer.select(key.alias("api_key_id"), wallet)
    api_keys = customer.select(
        key.alias("api_key_id"),
        F.col("c_nationkey").alias("organization_id"),
        (key % 4).alias("project_id"),
        F.when(key % 10 == 0, "revoked").otherwise("active").alias("status"),
    )
    permissions = customer.filter("c_custkey % 2 = 0").select(key.alias("api_key_id"), wallet, (key * 3).alias("permission_id"))
    rows = scopes.resolve_targets(requests, api_keys, *_custody(spark, folder), permissions)
    return rows.select(
        "api_key_id", "wallet_id", "custody_wallet_id", "wallet_project_id", "endpoint_binding_count", "permission_id"
    )


def j12_existence(spark, folder):
    """Customers as API keys: selected wallets when they have a binding, all otherwise."""
    keys = adapters.table(spark, folder, "customer").select(F.col("c_custkey").alias("api_key_id"))
    return scopes.with_existence(
        keys, _bindings(spark, folder), ["api_key_id"], "wallet_scope", "selected", "all"
    )


def j28_removable(spark, folder):
    """Configurations with one active wallet keep it."""
    part = F.col("p_partkey")
    wallets = adapters.table(spark, folder, "part").select(
        F.floor(part / 3).alias("config_id"),
        part.alias("wallet_id"),
        F.when(part % 2 == 0, "active").otherwise("inactive").alias("status"),
    )
    return scopes.removable(wallets).select("config_id", "wallet_id")


def a33_next_revisions(spark, folder):
    """Line numbers of an order are the revisions of its profile."""
    profiles = adapters.table(spark, folder, "orders").select(F.col("o_orderkey").alias("profile_id"))
    revisions = adapters.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("profile_id"), F.col("l_linenumber").alias("revision")
    )
    return scopes.next_revisions(profiles, revisions)


def j10_batch_recipients(spark, folder):
    """Orders as accounts of their customer; the details are JSON."""
    key = F.col("o_orderkey")
    details = F.to_json(
        F.struct(
            F.when(key % 3 == 0, "other").otherwise("chain").alias("network"),
            F.when(key % 5 != 0, F.concat(F.lit("addr"), key.cast("string"))).alias("address"),
        )
    )
    accounts = adapters.table(spark, folder, "orders").select(
        key.alias("account_id"),
        F.col("o_custkey").alias("counterparty_id"),
        (F.col("o_custkey") % 3).alias("organization_id"),
        (F.col("o_custkey") % 6).alias("project_id"),
        F.lit("active").alias("status"),
        F.when(key % 7 == 0, "bank").otherwise("crypto_wallet").alias("account_kind"),
        F.col("o_orderpriority").alias("label"),
        details.alias("details"),
        F.col("o_orderdate").alias("created_at"),
    )
    customer = F.col("c_custkey")
    people = adapters.table(spark, folder, "customer").select(
        customer.alias("counterparty_id"),
        (customer % 3).alias("organization_id"),
        (customer % 6).alias("project_id"),
        F.col("c_name").alias("display_name"),
        F.when(customer % 11 == 0, "archived").otherwise("active").alias("status"),
    )
    rows = scopes.batch_recipients(accounts, people, "chain", search="CUSTOMER#0000")
    return rows.select("counterparty_id", "counterparty_display_name", "account_id", "account_label", "address")


# --- policies -------------------------------------------------------------------------------------------


def p1_p4_decisions(spark, folder):
    rows = policy.evaluate(adapters.wallet_operations(spark, folder), adapters.policies(spark))
    return rows.select(
        "operation_id", "decision", "reason_code", "wallet_decision", "api_key_decision", "requires_approval",
        F.size("matched_rules").alias("matched_rules"),
    )


def j9_evaluations(spark, folder):
    operations = adapters.wallet_operations(spark, folder)
    rows = policy.evaluate(operations, adapters.policies(spark)).select(
        F.col("operation_id").alias("wallet_operation_id"),
        F.col("operation_id").alias("evaluation_id"),
        "decision",
        F.col("operation_id").alias("created_at"),
    )
    named = operations.select(F.col("operation_id").alias("wallet_operation_id"), "family", "asset")
    joined = scopes.evaluations_with_operations(rows, named)
    return joined.groupBy("family", "asset", "decision").agg(F.count(F.lit(1)).alias("operations"))


def _policy_rows(spark, folder):
    """Two policy rows per customer; later rows replace earlier ones, and other versions are ignored."""
    key = F.col("o_orderkey")
    customer = F.col("o_custkey")
    allowlist = F.to_json(
        F.struct(
            F.when(key % 9 == 0, 2).otherwise(1).alias("version"),
            F.array(
                F.concat(F.lit("dst_"), (key % 97).cast("string")),
                F.concat(F.lit("dst_"), ((key + 1) % 97).cast("string")),
            ).alias("destinationAllowlist"),
        )
    )
    limits = F.to_json(
        F.struct(
            F.lit(1).alias("version"),
            F.when(key % 5 != 0, F.lit("400000")).alias("maxTransferAmount"),
            F.lit("450000.50").alias("maxDailyAmount"),
        )
    )
    return adapters.table(spark, folder, "orders").filter(customer % 2 == 0).select(
        customer.cast("string").alias("wallet_id"),
        F.when(key % 4 == 0, "destination_allowlist").otherwise("transfer_limits").alias("policy_type"),
        F.when(key % 4 == 0, allowlist).otherwise(limits).alias("policy"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
        key.alias("policy_id"),
    )


def a32_wallet_limits(spark, folder):
    rows = policy.wallet_limits(_policy_rows(spark, folder))
    return rows.selectExpr(
        "wallet_id", "array_join(destination_allowlist, ',') as destination_allowlist", "max_transfer_amount",
        "max_daily_amount", "unix_micros(created_at) as created_at", "unix_micros(updated_at) as updated_at",
    )


def p5_limits(spark, folder):
    limits = policy.wallet_limits(_policy_rows(spark, folder).filter("policy_type = 'transfer_limits' OR policy_id % 8 = 0"))
    rows = policy.check_limits(adapters.payment_transfers(spark, folder), limits)
    return rows.select("id", "verdict")


def p5_long_limits(spark, folder):
    """Amounts and daily limits with 23 fraction digits."""
    tiny = F.lit("0" * 20)
    limits = policy.wallet_limits(_policy_rows(spark, folder).filter("policy_type = 'transfer_limits' OR policy_id % 8 = 0"))
    limits = limits.withColumn("max_daily_amount", F.concat("max_daily_amount", tiny, F.lit("2")))
    transfers = adapters.payment_transfers(spark, folder)
    rows = policy.check_limits(transfers.withColumn("amount", F.concat("amount", tiny, F.lit("1"))), limits)
    return rows.select("id", "verdict", "spent_before")


_PROJECTS = """
WITH projects AS (
  SELECT n_nationkey AS organization_id, 'default-sandbox-' || n_nationkey AS project_id, 'sandbox' AS environment,
         'default-sandbox' AS slug, 5 AS created_at FROM nation WHERE n_nationkey % 3 <> 0
  UNION ALL SELECT n_nationkey, 'trial-' || n_nationkey, 'sandbox', 'trial', 1 FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, 'default-production-' || n_nationkey, 'production', 'default-production', 3
  FROM nation WHERE n_nationkey % 4 = 0),
members AS (
  SELECT c_nationkey AS organization_id, c_custkey AS user_id, c_acctbal AS created_at FROM customer
  WHERE c_custkey % 5 <> 0)
"""
_BINDINGS = """
WITH bindings AS (
  SELECT o_custkey AS api_key_id, 'w' || o_orderkey % 10 AS wallet_id,
         CASE WHEN o_orderkey % 4 = 0 THEN 'all' ELSE 'selected' END AS binding_scope, o_orderkey AS binding_id,
         o_orderdate AS updated_at FROM orders WHERE o_custkey % 3 <> 0)
"""
_FIGURES = """
WITH figures AS (SELECT mint_address, sum(balance) AS supply, count(*) AS n FROM token_holders GROUP BY 1)
"""
# Every rule of the six policies, one CASE per rule.
_POLICY = """
WITH judged AS (
  SELECT *,
    CASE wallet_scope_id
      WHEN 'w0' THEN list_filter([
        CASE WHEN asset = 'asset1' AND amount IS NOT NULL THEN CASE WHEN amount > 100 THEN 'deny' ELSE 'allow' END END,
        CASE WHEN destination = 'dest3' THEN 'deny' END,
        CASE WHEN family = 'purchase' THEN 'approval_required' END], lambda x: x IS NOT NULL)
      WHEN 'w1' THEN list_filter([
        CASE WHEN family IN ('view', 'click') THEN 'allow' END,
        CASE WHEN type = 'signup_request' THEN 'review' END,
        CASE WHEN asset = 'asset2' THEN 'provider_approval_required' END], lambda x: x IS NOT NULL)
      WHEN 'w2' THEN list_filter([
        CASE WHEN destination IN ('dest1', 'dest2') THEN 'allow' ELSE 'deny' END,
        CASE WHEN amount IS NOT NULL THEN CASE WHEN amount < 10 THEN 'deny' ELSE 'allow' END END,
        CASE WHEN amount IS NOT NULL THEN 'review' END], lambda x: x IS NOT NULL)
      ELSE [] END AS w,
    CASE api_key_scope_id WHEN 'k1' THEN ['review', 'allow']
      WHEN 'k2' THEN list_filter([CASE WHEN amount IS NOT NULL THEN CASE WHEN amount > 50 THEN 'deny'
        ELSE 'approval_required' END END], lambda x: x IS NOT NULL)
      ELSE [] END AS k
  FROM wallet_operations),
ranked AS (
  SELECT *,
    CASE WHEN len(w) > 0 THEN list_max(list_transform(w, lambda x: list_position(['not_evaluated', 'allow', 'review',
      'provider_approval_required', 'approval_required', 'deny'], x)))
      ELSE CASE wallet_scope_id WHEN 'w1' THEN 6 WHEN 'w2' THEN 3 ELSE 2 END END AS wr,
    CASE WHEN api_key_scope_id IS NULL THEN 0 WHEN len(k) > 0 THEN list_max(list_transform(k, lambda x:
      list_position(['not_evaluated', 'allow', 'review', 'provider_approval_required', 'approval_required', 'deny'], x)))
      ELSE 2 END AS kr
  FROM judged),
named AS (
  SELECT *, ['not_evaluated', 'allow', 'review', 'provider_approval_required', 'approval_required', 'deny'] AS names
  FROM ranked),
decided AS (
  SELECT operation_id, family, asset, names[greatest(wr, kr)] AS decision,
         CASE WHEN wallet_scope_id = 'w3' AND api_key_scope_id IS NULL THEN 'implicit_default_allow'
              WHEN kr > wr THEN 'api_key_policy_match' WHEN wallet_scope_id = 'w3' THEN 'wallet_policy_missing'
              ELSE 'wallet_policy_match' END AS reason_code,
         names[wr] AS wallet_decision, CASE WHEN kr > 0 THEN names[kr] END AS api_key_decision,
         names[greatest(wr, kr)] IN ('approval_required', 'provider_approval_required') AS requires_approval,
         len(w) + len(k) AS matched_rules FROM named)
"""
_LIMITS = """
WITH rows AS (
  SELECT CAST(o_custkey AS VARCHAR) AS wallet_id, o_orderkey, o_orderkey % 4 = 0 AS is_list, o_orderdate AS created_at,
         CASE WHEN o_orderkey % 9 <> 0 THEN ['dst_' || o_orderkey % 97, 'dst_' || (o_orderkey + 1) % 97] END AS allowed,
         CASE WHEN o_orderkey % 5 <> 0 THEN '400000' END AS single, '450000.50' AS daily
  FROM orders WHERE o_custkey % 2 = 0 {where}),
limits AS (
  SELECT wallet_id,
         coalesce((arg_max({{'v': allowed}}, (created_at, o_orderkey)) FILTER (WHERE is_list)).v, []) AS allowed,
         (arg_max({{'v': single}}, (created_at, o_orderkey)) FILTER (WHERE NOT is_list)).v AS single,
         (arg_max({{'v': daily}}, (created_at, o_orderkey)) FILTER (WHERE NOT is_list)).v AS daily,
         min(created_at) AS created_at, max(created_at) + INTERVAL 1 DAY AS updated_at
  FROM rows GROUP BY 1)
"""

QUERIES = {
    "j8_with_token": (j8_with_token, over("issuance_transactions issued_tokens", """
        SELECT x.id, x.token_id, t.symbol AS token_symbol FROM issuance_transactions x JOIN issued_tokens t
        ON x.token_id = t.token_id WHERE t.status <> 'pending'""")),
    "f15_transactions_of_wallet": (f15_j11_transactions_of_wallet, over("issuance_transactions", """
        WITH f AS (
          SELECT *, CASE type WHEN 'mint' THEN [owner_a] WHEN 'burn' THEN [owner_b] WHEN 'freeze' THEN [owner_b]
                   WHEN 'unfreeze' THEN [owner_b] WHEN 'seize' THEN [owner_b, owner_a] WHEN 'force_burn' THEN [owner_b]
                   WHEN 'update_authority' THEN [owner_b, owner_a] ELSE [] END AS keys,
                 CASE type WHEN 'mint' THEN [owner_a, token_account] WHEN 'burn' THEN [owner_b] WHEN 'freeze' THEN [owner_b]
                   WHEN 'unfreeze' THEN [owner_b] WHEN 'seize' THEN [owner_b, owner_a] WHEN 'force_burn' THEN [owner_b]
                   ELSE [] END AS accounts FROM issuance_transactions)
        SELECT id, token_id, type FROM f
        WHERE list_has_any(keys, ['own_0', 'own_1', 'own_2'])
           OR list_has_any(accounts, ['own_' || token_id % 40, 'acc_' || token_id % 40])""")),
    "j11_transactions_of_accounts": (j11_transactions_of_accounts, over("issuance_transactions", """
        SELECT id, token_id FROM issuance_transactions WHERE token_account = 'acc_' || token_id % 40""")),
    "j26_extensions": (j26_extensions, over("issued_tokens", """
        WITH e AS (
          SELECT l_suppkey AS token_id, 'ext' || l_linenumber % 5 AS extension, max(lpad(CAST(l_partkey AS VARCHAR), 6, '0'))
                 AS config FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1, 2)
        SELECT t.token_id, string_agg(extension || '=' || config, ',' ORDER BY extension) AS extensions
        FROM issued_tokens t LEFT JOIN e ON t.token_id = e.token_id GROUP BY 1""")),
    "a28_issuer_summary": (a28_issuer_summary, over("issued_tokens token_holders", _FIGURES + """
        SELECT organization_id, project_id, count(*) AS total_tokens, round(sum(coalesce(supply, 0)), 2) AS total_supply,
               CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_holders,
               count(*) FILTER (WHERE status IN ('deployed', 'active')) AS deployed_tokens,
               count(*) FILTER (WHERE status NOT IN ('deployed', 'active')) AS pending_tokens
        FROM issued_tokens LEFT JOIN figures USING (mint_address) GROUP BY 1, 2""")),
    "a28_issuer_tokens": (a28_issuer_tokens, over("issued_tokens token_holders", _FIGURES + """
        SELECT token_id, coalesce(supply, 0) AS total_supply, coalesce(n, 0) AS holder_count,
               CASE WHEN n > 0 THEN CAST(floor(supply / n + 0.5) AS BIGINT) ELSE 0 END AS mean_balance_rounded
        FROM issued_tokens LEFT JOIN figures USING (mint_address)""")),
    "j15_first_members": (j15_first_members, _PROJECTS.strip() + """
        SELECT organization_id, user_id FROM (
          SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY created_at, user_id) AS rn FROM members)
        WHERE rn = 1 AND organization_id NOT IN (SELECT organization_id FROM projects WHERE environment = 'production')"""),
    "j16_fill_project": (j16_fill_project, _PROJECTS.strip() + """
        , best AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, environment ORDER BY
            CASE WHEN slug LIKE 'default-%' THEN 0 ELSE 1 END, created_at, project_id) AS rn FROM projects) WHERE rn = 1)
        SELECT c_custkey AS api_key_id, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE b.project_id END AS project_id
        FROM customer LEFT JOIN best b ON c_nationkey = b.organization_id
          AND b.environment = CASE WHEN c_custkey % 2 = 0 THEN 'sandbox' ELSE 'production' END"""),
    "j29_fill_default_project": (j29_fill_default_project, """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_nationkey % 3 <> 0
               THEN 'default-sandbox-' || c_nationkey END AS project_id FROM customer"""),
    "j29_missing_memberships": (j29_missing_memberships, _PROJECTS.strip() + """
        SELECT p.project_id, m.user_id FROM projects p JOIN members m USING (organization_id)
        WHERE slug <> 'trial' AND NOT (slug = 'default-sandbox' AND user_id % 7 = 0)"""),
    "j17_w13_bindings": (j17_w13_bindings, _BINDINGS.strip() + """
        , req AS (SELECT c_custkey AS api_key_id, 'w' || c_nationkey % 12 AS wallet_id FROM customer),
        hits AS (
          SELECT r.api_key_id, b.binding_id, b.binding_scope, row_number() OVER (PARTITION BY r.api_key_id ORDER BY
                   CASE WHEN b.binding_scope = 'selected' THEN 0 ELSE 1 END, b.updated_at DESC, b.binding_id) AS rn
          FROM req r JOIN bindings b ON r.api_key_id = b.api_key_id
            AND (b.binding_scope = 'all' OR b.wallet_id = r.wallet_id))
        SELECT r.api_key_id, r.wallet_id, (SELECT count(*) FROM bindings b WHERE b.api_key_id = r.api_key_id)
                 AS total_binding_count, h.binding_id, h.binding_scope
        FROM req r LEFT JOIN hits h ON r.api_key_id = h.api_key_id AND h.rn = 1"""),
    "j18_targets": (j18_targets, """
        WITH configs AS (
          SELECT s_suppkey AS config_id, s_nationkey AS organization_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 4 END
                 AS project_id FROM supplier WHERE s_suppkey % 8 <> 0),
        wallets AS (
          SELECT p_partkey % 10 AS config_id, 'w' || (p_partkey // 7) % 12 AS wallet_id,
                 p_partkey, p_size FROM part WHERE p_partkey % 6 <> 0),
        hits AS (
          SELECT c_custkey AS api_key_id, w.wallet_id, w.p_partkey AS custody_wallet_id, c.project_id AS wallet_project_id,
                 row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN c.project_id = c_custkey % 4 THEN 0
                   WHEN c.project_id IS NULL THEN 1 ELSE 2 END, p_size DESC, p_partkey) AS rn
          FROM customer JOIN configs c ON c.organization_id = c_nationkey
          JOIN wallets w ON w.config_id = c.config_id AND w.wallet_id = 'w' || c_custkey % 12
          WHERE c_custkey % 10 <> 0)
        SELECT api_key_id, wallet_id, custody_wallet_id, wallet_project_id,
               CASE WHEN api_key_id % 2 = 0 THEN 1 ELSE 0 END AS endpoint_binding_count,
               CASE WHEN api_key_id % 2 = 0 THEN api_key_id * 3 END AS permission_id FROM hits WHERE rn = 1"""),
    "j12_existence": (j12_existence, """
        SELECT c_custkey AS api_key_id, CASE WHEN c_custkey % 3 <> 0 AND EXISTS (
                 SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'selected' ELSE 'all' END AS wallet_scope
        FROM customer"""),
    "j28_removable": (j28_removable, """
        WITH a AS (SELECT p_partkey // 3 AS config_id, p_partkey AS wallet_id FROM part WHERE p_partkey % 2 = 0)
        SELECT config_id, wallet_id FROM a WHERE (SELECT count(*) FROM a b WHERE b.config_id = a.config_id) > 1"""),
    "a33_next_revisions": (a33_next_revisions, """
        SELECT o_orderkey AS profile_id, coalesce(max(l_linenumber), 0) + 1 AS next_revision
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""),
    "j10_batch_recipients": (j10_batch_recipients, """
        SELECT c_custkey AS counterparty_id, c_name AS counterparty_display_name, o_orderkey AS account_id,
               o_orderpriority AS account_label, 'addr' || o_orderkey AS address
        FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND c_custkey % 11 <> 0
          AND c_name ILIKE '%customer#0000%'"""),
    "p1_p4_decisions": (p1_p4_decisions, over("wallet_operations", _POLICY + """
        SELECT * EXCLUDE (family, asset) FROM decided""")),
    "j9_evaluations": (j9_evaluations, over("wallet_operations", _POLICY + """
        SELECT family, asset, decision, count(*) AS operations FROM decided GROUP BY 1, 2, 3""")),
    "a32_wallet_limits": (a32_wallet_limits, _LIMITS.strip().format(where="") + """
        SELECT wallet_id, array_to_string(allowed, ',') AS destination_allowlist, single AS max_transfer_amount,
               daily AS max_daily_amount, epoch_us(created_at) AS created_at, epoch_us(updated_at) AS updated_at
        FROM limits"""),
    "p5_long_limits": (p5_long_limits, over("payment_transfers", _LIMITS.format(
        where="AND (o_orderkey % 4 <> 0 OR o_orderkey % 8 = 0)") + """
        , spent AS (
          SELECT *, CAST(amount AS DECIMAL(38,2)) AS own,
                 CAST(coalesce(sum(CAST(amount AS DECIMAL(38,2))) OVER earlier, 0) AS DECIMAL(38,2)) AS before, count(*) OVER earlier AS n
          FROM payment_transfers WHERE status IN ('pending', 'processing', 'confirmed', 'finalized')
            AND direction = 'outbound'
          WINDOW earlier AS (PARTITION BY wallet_id, token, CAST(created_at AS DATE)
                   ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT s.id, CASE WHEN len(l.allowed) > 0 AND NOT list_contains(l.allowed, s.destination_address)
                            THEN 'destination_not_allowed'
                          WHEN s.own >= CAST(l.single AS DECIMAL(38,2)) THEN 'exceeds_max_transfer'
                          WHEN s.before + s.own > CAST(l.daily AS DECIMAL(38,2))
                            OR s.before + s.own = CAST(l.daily AS DECIMAL(38,2)) AND s.n + 1 > 2 THEN 'exceeds_max_daily'
                          ELSE 'allowed' END AS verdict,
               CASE WHEN n = 0 THEN '0' ELSE CAST(before AS VARCHAR) || lpad(CAST(n AS VARCHAR), 21, '0') END AS spent_before
        FROM spent s LEFT JOIN limits l ON s.wallet_id = l.wallet_id""")),
    "p5_limits": (p5_limits, over("payment_transfers", _LIMITS.format(
        where="AND (o_orderkey % 4 <> 0 OR o_orderkey % 8 = 0)") + """
        , spent AS (
          SELECT *, coalesce(sum(amount) OVER (PARTITION BY wallet_id, token, CAST(created_at AS DATE)
                   ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM payment_transfers WHERE status IN ('pending', 'processing', 'confirmed', 'finalized')
            AND direction = 'outbound')
        SELECT s.id, CASE WHEN len(l.allowed) > 0 AND NOT list_contains(l.allowed, s.destination_address)
                            THEN 'destination_not_allowed'
                          WHEN s.amount > CAST(l.single AS DECIMAL(38,9)) THEN 'exceeds_max_transfer'
                          WHEN s.before + s.amount > CAST(l.daily AS DECIMAL(38,9)) THEN 'exceeds_max_daily'
                          ELSE 'allowed' END AS verdict
        FROM spent s LEFT JOIN limits l ON s.wallet_id = l.wallet_id""")),
}
