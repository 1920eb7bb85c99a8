"""The domain tables of :mod:`ledgerlens.sources.adapters` as SQL, for the independent check."""

from __future__ import annotations

LINE_KEY = (
    "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) "
    "|| '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)"
)

VIEWS: dict[str, str] = {
    "supply_snapshots": """
        SELECT CAST(ts AS DATE) AS date, 'mint_' || event_type AS mint, event_type AS symbol,
               value AS ui_supply, ts AS scraped_at, event_id AS slot FROM events""",
    "network_snapshots": """
        SELECT CAST(o_orderdate AS DATE) AS date, o_orderdate AS scraped_at, o_totalprice AS total_sol_supply,
               o_totalprice / 2 AS circulating_sol_supply, o_totalprice / 3 AS tps,
               o_orderkey AS transaction_count, o_custkey AS epoch FROM orders""",
    "token_registry": """
        SELECT DISTINCT 'mint_' || event_type AS mint, event_type AS symbol,
               upper(event_type[1]) || event_type[2:] AS name FROM events
        UNION ALL
        SELECT CAST(s_suppkey AS VARCHAR), 'S' || CAST(s_suppkey AS VARCHAR), s_name
        FROM supplier WHERE s_suppkey % 2 = 0""",
    "analytics_tokens": """
        SELECT 'tok' || CAST(p_partkey AS VARCHAR) AS mint_address, p_brand AS symbol, p_name AS name,
               6 AS decimals, p_partkey % 2 = 0 AS source_env, p_partkey % 3 = 0 AS source_db,
               p_partkey % 5 = 0 AS source_user_deployment, p_partkey % 7 = 0 AS source_discovery,
               CASE WHEN p_partkey % 11 <> 0 THEN TIMESTAMP '2024-06-30 00:00:00' - to_days(p_size) END
                 AS last_verified_at,
               [p_type] AS verification_sources,
               CASE p_partkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed'
                 WHEN 3 THEN 'stale' WHEN 4 THEN 'rug_flagged' ELSE 'retired' END AS verification_status,
               CASE WHEN p_partkey % 6 = 2 THEN 'RPC verification failed' END AS verification_error,
               [lower(p_type), 'stablecoin'] AS tags, p_partkey % 10 <> 0 AS is_active, p_size AS priority,
               100 AS min_holders_threshold,
               TIMESTAMP '2024-06-30 00:00:00' - to_days(p_size) + to_seconds(p_partkey % 60) AS updated_at,
               TIMESTAMP '2024-06-30 00:00:00' - to_days(p_size) AS last_ingested_at,
               CASE WHEN p_partkey % 13 = 0 THEN 'failed' ELSE 'success' END AS last_ingestion_status,
               p_partkey FROM part""",
    "account_updates": """
        SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS account,
               CAST(l_suppkey AS VARCHAR) AS mint, CAST(l_partkey AS VARCHAR) AS owner,
               CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity * 100 AS BIGINT) END AS amount,
               CAST(epoch(l_shipdate) AS BIGINT) AS slot, l_partkey AS seq FROM lineitem""",
    "token_accounts": """
        SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS account,
               CAST(l_suppkey AS VARCHAR) AS mint, CAST(l_partkey AS VARCHAR) AS owner,
               l_quantity AS balance, CAST(l_quantity * 100 AS BIGINT) AS amount,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS position, l_shipdate AS snapshot_at FROM lineitem""",
    "holder_rows": """
        SELECT CAST(l_suppkey AS VARCHAR) AS mint, CAST(l_partkey AS VARCHAR) AS holder_address,
               sum(CAST(l_quantity * 100 AS BIGINT)) AS amount,
               CAST(sum(CAST(l_quantity * 100 AS BIGINT)) AS DOUBLE) / 100 AS ui_amount
        FROM lineitem GROUP BY 1, 2""",
    "token_holders": """
        SELECT 'tok' || CAST(l_suppkey AS VARCHAR) AS mint_address, CAST(l_partkey AS VARCHAR) AS wallet_address,
               l_quantity AS balance, l_orderkey AS slot, l_shipdate AS snapshot_at FROM lineitem""",
    "wallet_labels": """
        SELECT CAST(c_custkey AS VARCHAR) AS wallet_address,
               CASE WHEN n_regionkey = 0 THEN 'Unknown' ELSE n_name END AS geography,
               CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE lower(c_mktsegment) END AS attribution_category,
               'analytics' AS source,
               CAST(CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence,
               CASE WHEN c_custkey % 3 = 0 THEN 'helius+static' ELSE 'helius' END AS source_detail,
               c_custkey
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "payment_transfers": """
        SELECT 'xfr_' || CAST(o_orderkey AS VARCHAR) AS id, 'org_' || CAST(o_orderkey % 3 AS VARCHAR) AS organization_id,
               'prj_' || CAST(o_orderkey % 6 AS VARCHAR) AS project_id, CAST(o_custkey AS VARCHAR) AS wallet_id,
               'cp_' || CAST(o_orderkey % 50 AS VARCHAR) AS counterparty_id,
               'src_' || CAST(o_custkey AS VARCHAR) AS source_address,
               'dst_' || CAST(o_orderkey % 97 AS VARCHAR) AS destination_address,
               o_orderpriority[1] AS token, CAST(o_totalprice AS DECIMAL(38,2)) AS amount,
               CASE WHEN o_orderkey % 11 = 0 THEN 'onramp' ELSE 'transfer' END AS type,
               CASE WHEN o_orderkey % 2 = 0 THEN 'outbound' ELSE 'inbound' END AS direction,
               CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'F' THEN 'failed' ELSE 'confirmed' END AS status,
               CASE WHEN o_orderkey % 7 <> 0 THEN 'sig_' || CAST(o_orderkey AS VARCHAR) END AS signature,
               o_orderdate AS created_at, o_orderdate + to_minutes(o_orderkey % 30) AS updated_at, o_orderkey
        FROM orders""",
    "chain_status": """
        SELECT 'sig_' || CAST(o_orderkey AS VARCHAR) AS signature, o_orderkey * 2 AS slot,
               CASE o_orderkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'finalized' ELSE 'processed' END
                 AS confirmation_status,
               CASE WHEN o_orderkey % 17 = 0 THEN '{"InstructionError":1}' END AS err
        FROM orders WHERE o_orderkey % 10 <> 0""",
    "recurring_payments": """
        SELECT 'rp_' || CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS subscription_id,
               CASE WHEN o_orderkey % 4 < 2 THEN 'active' WHEN o_orderkey % 4 = 2 THEN 'activating'
                 ELSE 'canceling' END AS status,
               CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS next_collection_due_at,
               24 * (o_orderkey % 5 + 1) AS period_hours, o_orderdate AS updated_at FROM orders""",
    "collection_attempts": """
        SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
               CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' ||
               CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS id,
               CAST(l_orderkey AS VARCHAR) AS subscription_id,
               CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate ELSE o_orderdate END AS due_at,
               CASE WHEN l_returnflag = 'R' THEN 'failed'
                    WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'processing'
                    WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'pending'
                    WHEN l_linestatus = 'F' THEN 'confirmed' ELSE 'skipped' END AS status,
               l_shipdate AS updated_at, o_orderdate AS created_at, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "batch_transfers": """
        SELECT o_custkey AS batch_id, CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 'processing'
               WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'confirmed' END AS status FROM orders""",
    "batch_recipients": """
        SELECT l_suppkey AS batch_id, l_orderkey AS position,
               CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' ||
               CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS recipient_id,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM lineitem""",
    "wallet_operations": """
        SELECT event_id AS operation_id, 'w' || CAST(user_id % 4 AS VARCHAR) AS wallet_scope_id,
               CASE WHEN user_id % 3 <> 0 THEN 'k' || CAST(user_id % 3 AS VARCHAR) END AS api_key_scope_id,
               event_type AS family, event_type || '_request' AS type,
               'asset' || CAST(user_id % 5 AS VARCHAR) AS asset,
               CASE WHEN event_id % 19 <> 0 THEN CAST(value AS DECIMAL(38,2)) END AS amount,
               'dest' || CAST(user_id % 7 AS VARCHAR) AS destination FROM events""",
    "balances": """
        SELECT CAST(c_custkey AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) AS wallet_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'USDC'
                 WHEN 1 THEN 'm' || o_orderpriority[1] || CAST(o_orderkey % 4 AS VARCHAR) ELSE '' END AS token,
               'm' || o_orderpriority[1] || CAST(o_orderkey % 4 AS VARCHAR) AS mint,
               CASE WHEN o_orderkey % 23 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS units,
               o_totalprice AS ui_amount, o_orderkey
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "priced_balances": """
        SELECT b.*, CASE WHEN token = 'USDC' THEN 1.0
                 WHEN mint IN ('m41', 'm12', 'm22') THEN NULL
                 WHEN right(mint, 1) <> '3' AND mint[2] <> '5' THEN CAST(mint[2] AS INTEGER) * CAST(0.25 AS DOUBLE)
               END AS usd_price FROM balances b""",
    "screening_results": """
        SELECT p_partkey AS screening_id,
               CASE p_partkey % 8 WHEN 0 THEN 'elliptic' WHEN 1 THEN 'trm' ELSE lower(p_type) END AS provider,
               CASE WHEN p_partkey % 9 = 0 THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN p_partkey % 3 = 0 THEN p_size / CAST(5 AS DOUBLE) END AS risk_score,
               ['Severe risk', 'High', 'Medium', 'Moderate watch', 'Low', 'None', '', 'check passed'][p_size % 8 + 1]
                 AS risk_level FROM part""",
    "issuance_transactions": f"""
        SELECT {LINE_KEY} AS id, l_suppkey AS token_id, 'acc_' || CAST(l_partkey % 40 AS VARCHAR) AS token_account,
               ['mint', 'burn', 'freeze', 'unfreeze', 'seize', 'force_burn', 'update_authority', 'pause',
                'deploy'][l_partkey % 9 + 1] AS type,
               'own_' || CAST(l_partkey % 40 AS VARCHAR) AS owner_a,
               'own_' || CAST((l_partkey + 7) % 40 AS VARCHAR) AS owner_b,
               CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS amount, l_shipdate AS created_at FROM lineitem""",
    "issued_tokens": """
        SELECT s_suppkey AS token_id, 'org_' || CAST(s_suppkey % 4 AS VARCHAR) AS organization_id,
               'prj_' || CAST(s_suppkey % 8 AS VARCHAR) AS project_id,
               CASE WHEN s_suppkey % 5 <> 0 THEN 'tok' || CAST(s_suppkey AS VARCHAR) END AS mint_address,
               'S' || CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name,
               CASE s_suppkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'deployed' ELSE 'active' END AS status
        FROM supplier""",
}

#: Views that are built from other views.
NEEDS = {"priced_balances": ["balances"]}


def over(views: str, body: str) -> str:
    """A query with the named views in front of it."""
    names: list[str] = []
    for view in views.split():
        names += [v for v in [*NEEDS.get(view, []), view] if v not in names]
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in names)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
