"""Declared schemas of the domain tables."""

from __future__ import annotations

SUPPLY_SNAPSHOTS = (
    "date date, mint string, symbol string, supply decimal(38,0), decimals int, ui_supply double, "
    "scraped_at timestamp"
)
NETWORK_SNAPSHOTS = (
    "date date, scraped_at timestamp, total_sol_supply double, circulating_sol_supply double, "
    "non_circulating_sol_supply double, tps double, slot bigint, transaction_count bigint, "
    "inflation_rate double, epoch bigint"
)
HOLDERS = (
    "mint string, holder_address string, amount decimal(38,0), decimals int, ui_amount double, rank int, "
    "scraped_at timestamp"
)
WHALES = (
    "address string, lamports decimal(20,0), ui_balance double, rank int, scraped_at timestamp, source string"
)
VALIDATORS = (
    "status string, vote_address string, node_pubkey string, activated_stake decimal(20,0), commission int, "
    "epoch_vote_account boolean, root_slot bigint, last_vote bigint, rank int, scraped_at timestamp"
)
EVENTS = (
    "event_type string, slot bigint, signature string, log_count int, pubkey string, received_at timestamp"
)
TOKEN_REGISTRY = "uuid string, mint string, symbol string, name string, network string, decimals int"
TOKEN_HOLDERS = (
    "mint_address string, wallet_address string, balance double, slot bigint, snapshot_at timestamp"
)
TOKEN_SUPPLY_SNAPSHOTS = (
    "mint_address string, supply double, decimals int, slot bigint, snapshot_at timestamp"
)
ANALYTICS_CACHE = (
    "id bigint, response_json string, holder_count bigint, total_supply double, snapshot_at timestamp"
)
WALLET_LABELS = (
    "wallet_address string, geography string, attribution_category string, source string, "
    "updated_at timestamp, confidence double, source_detail string"
)
ANALYTICS_TOKENS = (
    "mint_address string, symbol string, name string, decimals int, source_env boolean, source_db boolean, "
    "source_user_deployment boolean, source_discovery boolean, last_verified_at timestamp, "
    "verification_sources array<string>, verification_status string, verification_error string, "
    "holder_count_at_verification bigint, supply_at_verification decimal(38,9), logo_uri string, "
    "coingecko_id string, jupiter_verified boolean, tags array<string>, is_active boolean, priority int, "
    "min_holders_threshold int, added_at timestamp, updated_at timestamp, last_ingested_at timestamp, "
    "last_ingestion_status string, last_ingestion_error string, holder_count bigint, supply decimal(38,9), "
    "last_slot bigint"
)
PAYMENT_TRANSFERS = (
    "id string, organization_id string, project_id string, wallet_id string, counterparty_id string, "
    "source_address string, destination_address string, token string, amount string, type string, "
    "direction string, status string, signature string, slot bigint, fee bigint, error string, "
    "created_at timestamp, updated_at timestamp"
)

# Payloads as they are landed: one JSON document per line.
ACCOUNT_PAYLOAD = (
    "struct<pubkey:string,account:struct<slot:bigint,data:struct<parsed:struct<info:struct<mint:string,"
    "owner:string,decimals:int,supply:string,mintAuthority:string,tokenAmount:struct<amount:string,"
    "decimals:int,uiAmount:double,uiAmountString:string>>>>>>"
)
LARGEST_HOLDERS_PAYLOAD = "array<struct<address:string,amount:string,decimals:int,uiAmount:double>>"
LARGEST_ACCOUNTS_PAYLOAD = "array<struct<address:string,lamports:string>>"
VOTE_ACCOUNT = (
    "struct<votePubkey:string,nodePubkey:string,activatedStake:string,commission:int,"
    "epochVoteAccount:boolean,rootSlot:bigint,lastVote:bigint>"
)
VOTE_ACCOUNTS_PAYLOAD = f"struct<current:array<{VOTE_ACCOUNT}>,delinquent:array<{VOTE_ACCOUNT}>>"
TOKEN_BALANCE = (
    "struct<accountIndex:int,mint:string,owner:string,uiTokenAmount:struct<amount:string,decimals:int,"
    "uiAmount:double,uiAmountString:string>>"
)
INSTRUCTION = (
    "struct<program:string,parsed:struct<type:string,info:struct<source:string,destination:string,"
    "account:string,mint:string,mintAuthority:string,lamports:string,amount:string,decimals:int,"
    "tokenAmount:struct<amount:string,decimals:int,uiAmountString:string>>>>"
)
TRANSACTION_PAYLOAD = (
    "struct<slot:bigint,blockTime:bigint,meta:struct<err:string,fee:bigint,"
    f"innerInstructions:array<struct<instructions:array<{INSTRUCTION}>>>,"
    f"preTokenBalances:array<{TOKEN_BALANCE}>,postTokenBalances:array<{TOKEN_BALANCE}>,"
    "preBalances:array<bigint>,postBalances:array<bigint>>,"
    f"transaction:struct<message:struct<accountKeys:array<string>,instructions:array<{INSTRUCTION}>>>>"
)
# The parts of a transaction that a job reads.
_MESSAGE = "transaction:struct<message:struct<accountKeys:array<string>"
_FACTS = "struct<accountIndex:int,mint:string,owner:string,uiTokenAmount:struct<decimals:int>>"
_UNITS = (
    "struct<mint:string,owner:string,uiTokenAmount:struct<amount:string,decimals:int,uiAmount:double>>"
)
_INNER = f"innerInstructions:array<struct<instructions:array<{INSTRUCTION}>>>"
BALANCES_PAYLOAD = (
    f"struct<meta:struct<preTokenBalances:array<{_FACTS}>,postTokenBalances:array<{_FACTS}>>,{_MESSAGE}>>>"
)
INSTRUCTIONS_PAYLOAD = (
    f"struct<meta:struct<{_INNER}>,transaction:struct<message:struct<instructions:array<{INSTRUCTION}>>>>"
)
TRANSFERS_PAYLOAD = (
    f"struct<slot:bigint,blockTime:bigint,meta:struct<err:string,fee:bigint,{_INNER},"
    f"preTokenBalances:array<{_FACTS}>,postTokenBalances:array<{_FACTS}>>,"
    f"{_MESSAGE},instructions:array<{INSTRUCTION}>>>>"
)
NET_PAYLOAD = (
    "struct<slot:bigint,blockTime:bigint,meta:struct<fee:bigint,"
    f"preTokenBalances:array<{_UNITS}>,postTokenBalances:array<{_UNITS}>,"
    f"preBalances:array<bigint>,postBalances:array<bigint>>,{_MESSAGE}>>>"
)
NOTIFICATION = (
    "method string, received_at timestamp, seq bigint, result struct<slot:bigint,context:struct<slot:bigint>,"
    "value:struct<signature:string,logs:array<string>,pubkey:string,account:struct<data:string>>>"
)
