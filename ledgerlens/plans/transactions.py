"""Queries over raw transactions and landed payloads, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.identity import base58, decode_account, token_uuid
from ledgerlens.operators import holders, transactions
from ledgerlens.plans.views import LINE_KEY, over
from ledgerlens.session import shared_dir
from ledgerlens.sources import adapters, landed
from ledgerlens.streaming import events as event_stream
from ledgerlens.streaming import holders as holder_stream
from ledgerlens.streaming.ingest import ingest_landed

AS_OF = "2002-01-01 00:00:00"


def _text(name: str) -> Column:
    return F.col(name).cast("string")


# --- raw transactions -----------------------------------------------------------------------------------


def t1_flattened(spark, folder):
    rows = transactions.flattened(adapters.transactions(spark, folder))
    return rows.groupBy(
        "position", F.col("instruction.parsed.type").alias("type"), F.col("instruction.program").alias("program")
    ).agg(F.count(F.lit(1)).alias("instructions"))


def t2_token_accounts(spark, folder):
    return transactions.token_accounts(adapters.transactions(spark, folder))


def j20_indexed_accounts(spark, folder):
    return transactions.indexed_accounts(adapters.transactions(spark, folder))


def _observed(spark, folder, raw, **options):
    """Transfers of known wallets; half of the mints have a symbol."""
    symbols = adapters.table(spark, folder, "region").select(
        F.concat(F.lit("mint"), _text("r_regionkey")).alias("mint"),
        F.concat(F.lit("SYM"), _text("r_regionkey")).alias("symbol"),
    )
    rows = transactions.observed_transfers(raw, adapters.wallets(spark, folder), symbols, AS_OF, **options)
    return rows.selectExpr(
        "id", "wallet_id", "source_address", "destination_address", "token", "amount", "direction", "status",
        "signature", "slot", "fee", "unix_micros(created_at) as created_at",
    )


def t3_t6_observed_transfers(spark, folder):
    return _observed(spark, folder, adapters.transactions(spark, folder))


def t5_t8_checked_transfers(spark, folder):
    """Token transfers of another program: half with a complete tokenAmount, half with decimals beside the amount.

    No wallets are sent to the tasks, so the reduced lookup is used.
    """
    raw = adapters.transactions(spark, folder)
    even = F.element_at(F.split("signature", "-"), 3).cast("bigint") % 2 == 0
    plain, amount = F.lit('"program":"spl-token","parsed":{"type":"transfer"'), r'"amount":"([0-9]+)"\}\}'
    checked = F.replace("payload", plain, F.lit('"program":"spl-token-2022","parsed":{"type":"transferChecked"'))
    whole = F.regexp_replace(checked, amount, '"tokenAmount":{"amount":"$1","decimals":3,"uiAmountString":"$1.0"}}}')
    beside = F.regexp_replace(checked, amount, '"amount":"$1","decimals":1}}')
    moved = F.col("payload").contains(plain)
    payload = F.when(moved & even, whole).when(moved, beside).otherwise(F.col("payload"))
    return _observed(spark, folder, raw.withColumn("payload", payload), most_sent=0)


def t7_j19_net_transfers(spark, folder):
    rows = transactions.net_transfers(adapters.transactions(spark, folder), AS_OF)
    return rows.select(
        "signature",
        "slot",
        "fee",
        "token_transfer.mint",
        "token_transfer.owner",
        F.col("token_transfer.change").cast("bigint").alias("change"),
        F.round("token_transfer.ui_change", 4).alias("ui_change"),
    )


def a5_transfers_per_mint(spark, folder):
    rows = transactions.net_transfers(adapters.transactions(spark, folder), AS_OF)
    return holders.transfers_per_mint(rows, 5)


# --- landed payloads ------------------------------------------------------------------------------------


def _account_payloads(lines):
    """Line items as parsed token accounts; some owners are blank, some balances missing."""
    info = F.struct(
        F.when(F.col("l_linenumber") == 1, "").otherwise(_text("l_partkey")).alias("owner"),
        F.struct(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("uiAmount")).alias("tokenAmount"),
    )
    account = F.struct(
        F.concat(F.lit("acct"), _text("l_orderkey")).alias("pubkey"),
        F.struct(F.struct(F.struct(info.alias("info")).alias("parsed")).alias("data")).alias("account"),
    )
    return lines.select(
        _text("l_suppkey").alias("mint_address"), F.col("l_orderkey").alias("slot"), F.to_json(account).alias("payload")
    )


def s14_token_holders(spark, folder):
    rows = landed.token_holders(
        _account_payloads(adapters.spread(adapters.table(spark, folder, "lineitem"))), AS_OF
    )
    return rows.select("mint_address", "wallet_address", "balance", "slot")


def _mint_payloads(spark, folder):
    key = F.col("p_partkey")
    info = F.struct(
        F.when(key % 3 != 0, F.lit(6)).alias("decimals"),
        F.round(F.col("p_retailprice") * 1000).cast("bigint").cast("string").alias("supply"),
        F.when(key % 2 == 0, F.lit("auth")).alias("mintAuthority"),
    )
    account = F.struct(
        F.when(key % 50 == 0, "").otherwise(F.concat(F.lit("mint"), F.lpad(key.cast("string"), 8, "0"))).alias("pubkey"),
        F.struct(F.struct(F.struct(info.alias("info")).alias("parsed")).alias("data")).alias("account"),
    )
    return adapters.table(spark, folder, "part").select(F.to_json(account).alias("payload"))


def s15_discovered_mints(spark, folder):
    return landed.discovered_mints(_mint_payloads(spark, folder))


def s15_known_mints(spark, folder):
    """No account is usable, so the known mints are listed."""
    blank = _mint_payloads(spark, folder).select(F.regexp_replace("payload", '"mint[0-9]+"', '""').alias("payload"))
    return landed.discovered_mints(blank).select("mint", "decimals", "supply")


def s16_supply_snapshot(spark, folder):
    """Two of three mints have a supply payload."""
    key = F.col("p_partkey")
    told = F.struct(
        F.round(F.col("p_retailprice") * 2000).cast("bigint").cast("string").alias("amount"),
        F.lit(3).alias("decimals"),
        F.format_string("%.3f", F.col("p_retailprice") * 2).alias("uiAmountString"),
    )
    supplies = adapters.table(spark, folder, "part").filter(key % 3 != 1).select(
        F.concat(F.lit("mint"), F.lpad(key.cast("string"), 8, "0")).alias("mint"), F.to_json(told).alias("payload")
    )
    mints = landed.discovered_mints(_mint_payloads(spark, folder))
    rows = landed.supply_snapshot(mints, supplies, AS_OF)
    return rows.select(
        "date", "mint", "symbol", F.col("supply").cast("bigint").alias("supply"), "decimals",
        F.round("ui_supply", 6).alias("ui_supply"),
    )


def s17_network_snapshot(spark, folder):
    """Every order is one run; some of its five payloads are missing."""
    key = F.col("o_orderkey")
    units = F.round(F.col("o_totalprice") * 100).cast("bigint")
    entries = F.array(
        F.struct(
            F.lit("getSupply").alias("method"),
            F.to_json(F.struct((units * 1000).cast("string").alias("total"), units.cast("string").alias("circulating"))).alias("payload"),
        ),
        F.when(
            key % 3 != 0,
            F.struct(
                F.lit("getRecentPerformanceSamples").alias("method"),
                F.to_json(
                    F.struct(units.alias("numTransactions"), F.lit(64).alias("samplePeriodSecs"), key.alias("slot"))
                ).alias("payload"),
            ),
        ),
        F.struct(
            F.lit("getTransactionCount").alias("method"), F.to_json(F.struct(key.alias("count"))).alias("payload")
        ),
        F.when(
            key % 5 != 0,
            F.struct(
                F.lit("getInflationRate").alias("method"),
                F.to_json(F.struct((F.col("o_totalprice") / 3e7).alias("total"))).alias("payload"),
            ),
        ),
        F.struct(
            F.lit("getEpochInfo").alias("method"),
            F.to_json(F.struct((key % 100).alias("epoch"), (key * 10).alias("absoluteSlot"))).alias("payload"),
        ),
    )
    run = F.timestamp_seconds(key).alias("run_at")
    payloads = adapters.table(spark, folder, "orders").select(run, F.inline(F.array_compact(entries)))
    rows = landed.network_snapshot(payloads)
    return rows.select(
        "date", F.round("total_sol_supply", 9).alias("total_sol_supply"), "tps", "slot", "transaction_count",
        "inflation_rate", "epoch",
    )


def s18_largest_holders(spark, folder):
    """Every order names three holders of one mint."""
    key = F.col("o_orderkey")

    def holder(i: int) -> Column:
        return F.struct(
            F.concat(F.lit(f"h{i}-"), _text("o_custkey")).alias("address"),
            (key * (4 - i)).cast("string").alias("amount"),
            F.lit(2).alias("decimals"),
            F.when(key % 2 == 0, key * (4 - i) / 100).alias("uiAmount"),
        )

    payloads = adapters.table(spark, folder, "orders").select(
        F.concat(F.lit("m"), key.cast("string")).alias("mint"),
        F.to_json(F.array(*[holder(i) for i in (1, 2, 3)])).alias("payload"),
    )
    rows = landed.largest_holders(payloads, AS_OF)
    return rows.select(
        "mint", "holder_address", F.col("amount").cast("bigint").alias("amount"), "decimals",
        F.round("ui_amount", 4).alias("ui_amount"), "rank",
    )


def _vote_payloads(spark, folder):
    """Every supplier reports one current and one delinquent validator."""
    key = F.col("s_suppkey")

    def vote(kind: str, stake: Column) -> Column:
        return F.struct(
            F.concat(F.lit(f"vote-{kind}-"), key.cast("string")).alias("votePubkey"),
            F.concat(F.lit(f"node-{kind}-"), key.cast("string")).alias("nodePubkey"),
            stake.cast("bigint").cast("string").alias("activatedStake"),
            (key % 10).cast("int").alias("commission"),
            (key % 2 == 0).alias("epochVoteAccount"),
            (key * 5).alias("lastVote"),
        )

    stake = F.round((F.col("s_acctbal") + 1000) * 100)
    body = F.struct(
        F.array(vote("c", stake), vote("d", stake + 7)).alias("current"),
        F.array(vote("e", stake * 2)).alias("delinquent"),
    )
    return adapters.table(spark, folder, "supplier").select(F.to_json(body).alias("payload"))


def s19_whales(spark, folder):
    """No account list has landed, so the largest stakes stand in."""
    nothing = adapters.table(spark, folder, "region").filter("r_regionkey < 0").select(F.col("r_name").alias("payload"))
    rows = landed.whales(nothing, _vote_payloads(spark, folder), AS_OF)
    return rows.select("address", F.col("lamports").cast("bigint").alias("lamports"), "ui_balance", "rank", "source")


def s19_listed_whales(spark, folder):
    """Account lists have landed, three accounts each, so the stakes are not looked at."""
    key = F.col("s_suppkey")
    account = [F.struct(F.concat(F.lit(f"acct{i}-"), _text("s_suppkey")).alias("address"), (key * (40 - i)).alias("lamports")) for i in range(3)]
    lists = adapters.table(spark, folder, "supplier").select(F.to_json(F.array(*account)).alias("payload"))
    rows = landed.whales(lists, _vote_payloads(spark, folder), AS_OF)
    return rows.select("address", F.col("lamports").cast("bigint").alias("lamports"), "ui_balance", "rank", "source")


def s20_validators(spark, folder):
    rows = landed.validators(_vote_payloads(spark, folder), AS_OF)
    return rows.select(
        "status", "vote_address", "node_pubkey", F.col("activated_stake").cast("bigint").alias("activated_stake"),
        "commission", "epoch_vote_account", "root_slot", "last_vote", "rank",
    )


# --- identifiers and account bytes ----------------------------------------------------------------------


def x4_token_uuid(spark, folder):
    mint = F.concat(F.lit("tok"), _text("p_partkey"))
    return adapters.table(spark, folder, "part").select(mint.alias("mint"), token_uuid(mint).alias("uuid"))


def x5_x6_account_bytes(spark, folder):
    """Line items as raw token accounts; balances of odd orders exceed a signed long, some data is short."""

    def key(n: Column) -> Column:
        return F.unhex(F.lpad(F.hex(n), 64, "0"))

    high = F.when(F.col("l_orderkey") % 2 == 1, "F").otherwise("0")
    number = F.concat(high, F.lpad(F.hex("l_orderkey"), 15, "0"))
    little = F.concat(*[F.substring(number, i, 2) for i in range(15, 0, -2)])
    body = F.concat(key(F.col("l_partkey") + 1), key(F.col("l_suppkey") + 100), F.unhex(little))
    whole = F.when(F.col("l_linenumber") == 7, F.substring(body, 1, 71)).otherwise(
        F.concat(body, F.unhex(F.repeat(F.lit("00"), 93)))
    )
    lines = adapters.spread(adapters.table(spark, folder, "lineitem"))
    rows = lines.select("l_orderkey", decode_account(F.base64(whole)).alias("raw"))
    return rows.filter("raw IS NOT NULL").select(
        "l_orderkey",
        base58("raw.mint_key").alias("mint"),
        base58("raw.owner_key").alias("owner"),
        _text("raw.balance").alias("balance"),
    )


# --- streams --------------------------------------------------------------------------------------------


def _notifications(rows):
    """Events as notifications: slots, logs and account changes, some without content."""
    kind, key = F.col("event_type"), F.col("event_id")
    method = F.when(kind == "view", event_stream.SLOT).when(
        kind.isin("click", "error"), event_stream.LOGS
    ).otherwise(event_stream.PROGRAM)
    value = F.struct(
        F.when(key % 10 != 0, F.concat(F.lit("sig"), key.cast("string"))).alias("signature"),
        F.when(key % 7 != 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("logs"),
        F.when(key % 10 != 0, F.concat(F.lit("acct"), (key % 100).cast("string"))).alias("pubkey"),
        F.struct(F.lit(None).cast("string").alias("data")).alias("account"),
    )
    result = F.struct(
        F.when(key % 10 != 0, key).alias("slot"), F.struct(key.alias("slot")).alias("context"), value.alias("value")
    )
    return rows.select(method.alias("method"), F.col("ts").alias("received_at"), key.alias("seq"), result.alias("result"))


def r1_r2_event_stream(spark, folder):
    """The events table as a file stream, turned into event rows and appended to a table."""
    rows = event_stream.event_rows(_notifications(adapters.stream(spark, folder, "events")))
    path = shared_dir(spark, "events")
    event_stream.write_events(rows, f"{path}/table", f"{path}/checkpoint", available_now=True).awaitTermination()
    table = spark.read.schema(rows.schema).parquet(f"{path}/table")
    return table.selectExpr("event_type", "slot", "signature", "log_count", "pubkey", "unix_micros(received_at) as received_at")


def r3_holder_stream(spark, folder):
    """Account updates as a stream; the state it leaves equals the last write per account."""
    updates = adapters.account_updates(adapters.stream(spark, folder, "lineitem"))
    path = shared_dir(spark, "accounts")
    holder_stream.follow_accounts(
        updates, f"{path}/log", f"{path}/checkpoint", available_now=True
    ).awaitTermination()
    state = holder_stream.current_accounts(holder_stream.read_log(spark, f"{path}/log"))
    return state.select("account", F.col("amount").cast("bigint").alias("amount"), "slot", "seq")


def r5_ingest(spark, folder):
    """Landed account payloads as a file stream, ingested once."""
    path = shared_dir(spark, "ingest")

    def to_rows(stream):
        return landed.token_holders(stream, AS_OF)

    payloads = _account_payloads(adapters.stream(spark, folder, "lineitem"))
    ingest_landed(payloads, to_rows, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.schema(to_rows(payloads).schema).parquet(f"{path}/table")
    return rows.groupBy("mint_address").agg(
        F.count(F.lit(1)).alias("accounts"), F.round(F.sum("balance"), 2).alias("balance")
    )


_RAW = f"""
WITH raw AS (
  SELECT {LINE_KEY} AS signature, l_linenumber % 3 AS shape, l_orderkey AS slot, CAST(l_quantity * 100 AS BIGINT) AS units,
         'wallet' || l_partkey % 50 AS owner_a, 'wallet' || (l_suppkey % 50 + 50) AS owner_b,
         'mint' || l_suppkey % 10 AS mint, l_partkey % 50 AS a, l_suppkey % 50 + 50 AS b, l_suppkey % 10 AS m,
         CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'confirmed' END AS status, epoch_us(l_shipdate) AS created_at
  FROM lineitem)
"""
_DIGITS = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _base58_sql(n: str) -> str:
    """Base58 of a number below 58 ** 4."""
    digits = " || ".join(f"'{_DIGITS}'[({n}) // {58**i} % 58 + 1]" for i in (3, 2, 1, 0))
    return f"ltrim({digits}, '1')"


_SQL_HOLDERS = """
    SELECT CAST(l_suppkey AS VARCHAR) AS mint_address,
           CASE WHEN l_linenumber = 1 THEN 'acct' || l_orderkey ELSE CAST(l_partkey AS VARCHAR) END AS wallet_address,
           CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END AS balance, l_orderkey AS slot FROM lineitem"""
_SQL_MINTS = """
    SELECT 'mint' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS mint, CASE WHEN p_partkey % 3 <> 0 THEN 6 ELSE 0 END
             AS decimals, CAST(round(p_retailprice * 1000) AS BIGINT) AS supply, p_partkey, p_retailprice
    FROM part WHERE p_partkey % 50 <> 0"""

QUERIES = {
    "t1_flattened": (t1_flattened, _RAW.strip() + """
        SELECT p AS position, ['transfer', 'mintTo', 'transfer'][shape + 1] AS type,
               CASE WHEN shape = 0 THEN 'system' ELSE 'spl-token' END AS program, count(*) AS instructions
        FROM raw, (VALUES (0), (1)) v(p) GROUP BY 1, 2, 3"""),
    "t2_token_accounts": (t2_token_accounts, _RAW.strip() + """
        SELECT signature, 'acct0' AS address, owner_a AS owner, mint, 2 AS decimals FROM raw
        UNION ALL SELECT signature, 'acct1', owner_b, mint, 2 FROM raw"""),
    "j20_indexed_accounts": (j20_indexed_accounts, _RAW.strip() + """
        SELECT signature, 0 AS position, 'acct0' AS address, mint, owner_a AS owner FROM raw
        UNION ALL SELECT signature, 1, 'acct1', mint, owner_b FROM raw"""),
    "t3_t6_observed_transfers": (t3_t6_observed_transfers, _RAW.strip() + """
        , w AS (
          SELECT *, CASE WHEN shape <> 1 AND a % 2 = 0 THEN 'wal_' || a END AS src, CASE WHEN b % 2 = 0 THEN 'wal_' || b END
                 AS dst, CASE WHEN shape = 0 THEN 9 ELSE 2 END AS places FROM raw
          WHERE a IN (SELECT c_custkey % 100 FROM customer) AND b IN (SELECT c_custkey % 100 FROM customer)),
        t AS (SELECT *, coalesce(src, dst) AS wallet_id, CAST(power(10, places) AS BIGINT) AS unit FROM w
              WHERE coalesce(src, dst) IS NOT NULL)
        SELECT 'xfr_observed_' || wallet_id || '_' || signature || CASE shape WHEN 0 THEN '' WHEN 1 THEN '_' || mint || '_mint'
                 ELSE '_' || mint END AS id,
               wallet_id, CASE WHEN shape = 1 THEN 'auth' ELSE owner_a END AS source_address,
               owner_b AS destination_address,
               CASE WHEN shape = 0 THEN 'SOL' WHEN m < 5 THEN 'SYM' || m ELSE mint END AS token,
               CAST(units // unit AS VARCHAR) || CASE WHEN units % unit = 0 THEN '' ELSE '.' ||
                 rtrim(lpad(CAST(units % unit AS VARCHAR), places, '0'), '0') END AS amount,
               CASE WHEN shape = 1 OR (dst IS NOT NULL AND src IS NULL) THEN 'inbound' ELSE 'outbound' END AS direction,
               status, signature, slot, 5000 AS fee, created_at FROM t"""),
    "t5_t8_checked_transfers": (t5_t8_checked_transfers, _RAW.strip() + """
        , w AS (
          SELECT *, CASE WHEN shape <> 1 AND a % 2 = 0 THEN 'wal_' || a END AS src, CASE WHEN b % 2 = 0 THEN 'wal_' || b END
                 AS dst, CASE WHEN shape = 0 THEN 9 WHEN shape = 2 THEN 1 ELSE 2 END AS places FROM raw
          WHERE a IN (SELECT c_custkey % 100 FROM customer) AND b IN (SELECT c_custkey % 100 FROM customer)),
        t AS (SELECT *, coalesce(src, dst) AS wallet_id, CAST(power(10, places) AS BIGINT) AS unit FROM w
              WHERE coalesce(src, dst) IS NOT NULL)
        SELECT 'xfr_observed_' || wallet_id || '_' || signature || CASE shape WHEN 0 THEN '' WHEN 1 THEN '_' || mint || '_mint'
                 ELSE '_' || mint END AS id,
               wallet_id, CASE WHEN shape = 1 THEN 'auth' ELSE owner_a END AS source_address,
               owner_b AS destination_address,
               CASE WHEN shape = 0 THEN 'SOL' WHEN m < 5 THEN 'SYM' || m ELSE mint END AS token,
               CASE WHEN shape = 2 AND a % 2 = 0 THEN units || '.0' ELSE CAST(units // unit AS VARCHAR) || CASE WHEN units % unit = 0 THEN '' ELSE '.' ||
                 rtrim(lpad(CAST(units % unit AS VARCHAR), places, '0'), '0') END END AS amount,
               CASE WHEN shape = 1 OR (dst IS NOT NULL AND src IS NULL) THEN 'inbound' ELSE 'outbound' END AS direction,
               status, signature, slot, 5000 AS fee, created_at FROM t"""),
    "t7_j19_net_transfers": (t7_j19_net_transfers, _RAW.strip() + """
        SELECT signature, slot, 5000 AS fee, mint, owner_a AS owner, units AS change,
               round(abs(10.0 - (units + 1000) / CAST(100 AS DOUBLE)), 4) AS ui_change FROM raw"""),
    "a5_transfers_per_mint": (a5_transfers_per_mint, _RAW.strip() + """
        SELECT mint, count(*) AS transfer_count FROM raw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""),
    "s14_token_holders": (s14_token_holders, _SQL_HOLDERS.strip()),
    "s15_discovered_mints": (s15_discovered_mints, f"""
        SELECT mint, decimals, CAST(supply AS VARCHAR) AS supply, 0 AS slot,
               CASE WHEN p_partkey % 2 = 0 THEN 'auth' END AS mint_authority FROM ({_SQL_MINTS})"""),
    "s15_known_mints": (s15_known_mints, """
        SELECT * FROM (VALUES ('Gh9ZwEmdLJ8DscKNTkTqPbNwLNNBjuSzaG9Vp2KGtKJr', 6, '0'),
          ('9fxDZ7rBCNdHureibbAVa6J73srhCYWoKYZWwegXe72Z', 6, '0')) v(mint, decimals, supply)"""),
    "s16_supply_snapshot": (s16_supply_snapshot, f"""
        SELECT DATE '2002-01-01' AS date, mint, left(mint, 4) || '...' || right(mint, 4) AS symbol,
               CASE WHEN p_partkey % 3 <> 1 THEN CAST(round(p_retailprice * 2000) AS BIGINT) ELSE supply END AS supply,
               CASE WHEN p_partkey % 3 <> 1 THEN 3 ELSE decimals END AS decimals,
               round(CASE WHEN p_partkey % 3 <> 1 THEN p_retailprice * 2 ELSE supply / power(10, decimals) END, 6)
                 AS ui_supply FROM ({_SQL_MINTS})"""),
    "s17_network_snapshot": (s17_network_snapshot, """
        SELECT CAST(TIMESTAMP '1970-01-01' + to_seconds(o_orderkey) AS DATE) AS date,
               round(CAST(round(o_totalprice * 100) AS BIGINT) * 1000 / CAST(1e9 AS DOUBLE), 9) AS total_sol_supply,
               CASE WHEN o_orderkey % 3 <> 0 THEN round_even(round(o_totalprice * 100) / 64, 2) END AS tps,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey ELSE o_orderkey * 10 END AS slot,
               o_orderkey AS transaction_count,
               CASE WHEN o_orderkey % 5 <> 0 THEN round_even(o_totalprice / 3e7 * 100, 4) END AS inflation_rate,
               o_orderkey % 100 AS epoch FROM orders"""),
    "s18_largest_holders": (s18_largest_holders, """
        SELECT 'm' || o_orderkey AS mint, 'h' || i || '-' || o_custkey AS holder_address, o_orderkey * (4 - i) AS amount,
               2 AS decimals, round(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * (4 - i) / 100 ELSE 0 END, 4) AS ui_amount,
               i AS rank FROM orders, (VALUES (1), (2), (3)) v(i)"""),
    "s19_whales": (s19_whales, """
        WITH v AS (
          SELECT 'node-c-' || s_suppkey AS address, CAST(round((s_acctbal + 1000) * 100) AS BIGINT) AS lamports FROM supplier
          UNION ALL
          SELECT 'node-d-' || s_suppkey, CAST(round((s_acctbal + 1000) * 100) AS BIGINT) + 7 FROM supplier)
        SELECT address, lamports, lamports / 1e9 AS ui_balance, row_number() OVER (ORDER BY lamports DESC, address) AS rank,
               'validators' AS source FROM v ORDER BY lamports DESC, address LIMIT 20"""),
    "s19_listed_whales": (s19_listed_whales, """
        SELECT 'acct' || i || '-' || s_suppkey AS address, s_suppkey * (40 - i) AS lamports,
               s_suppkey * (40 - i) / 1e9 AS ui_balance, i + 1 AS rank, 'rpc' AS source
        FROM supplier, (VALUES (0), (1), (2)) v(i)"""),
    "s20_validators": (s20_validators, """
        WITH k AS (SELECT *, CAST(round((s_acctbal + 1000) * 100) AS BIGINT) AS stake FROM supplier)
        SELECT status, 'vote-' || t || '-' || s_suppkey AS vote_address, 'node-' || t || '-' || s_suppkey AS node_pubkey,
               CASE t WHEN 'c' THEN stake WHEN 'd' THEN stake + 7 ELSE stake * 2 END AS activated_stake,
               s_suppkey % 10 AS commission, s_suppkey % 2 = 0 AS epoch_vote_account, 0 AS root_slot,
               s_suppkey * 5 AS last_vote, rank
        FROM k, (VALUES ('current', 'c', 1), ('current', 'd', 2), ('delinquent', 'e', 1)) v(status, t, rank)"""),
    "x4_token_uuid": (x4_token_uuid, """
        WITH h AS (SELECT 'tok' || p_partkey AS mint,
                   sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('tok' || p_partkey)) AS d FROM part)
        SELECT mint, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' ||
               '89ab'[(strpos('0123456789abcdef', d[17]) - 1) % 4 + 1] || d[18:20] || '-' || d[21:32] AS uuid FROM h"""),
    "x5_x6_account_bytes": (x5_x6_account_bytes, f"""
        SELECT l_orderkey, {_base58_sql("l_partkey + 1")} AS mint, {_base58_sql("l_suppkey + 100")} AS owner,
               CAST(CASE WHEN l_orderkey % 2 = 1 THEN CAST('17293822569102704640' AS HUGEINT) ELSE 0 END + l_orderkey
                    AS VARCHAR) AS balance FROM lineitem WHERE l_linenumber <> 7"""),
    "r1_r2_event_stream": (r1_r2_event_stream, """
        WITH n AS (
          SELECT *, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 10 <> 0 THEN 'slot' END
                 WHEN event_type IN ('click', 'error') THEN CASE WHEN event_id % 10 <> 0 AND event_id % 7 <> 0 THEN 'logs' END
                 WHEN event_id % 10 <> 0 THEN 'program' END AS k FROM events)
        SELECT k AS event_type, CASE WHEN k = 'slot' THEN event_id ELSE 0 END AS slot,
               CASE WHEN k = 'logs' THEN 'sig' || event_id ELSE '' END AS signature,
               CASE WHEN k = 'logs' THEN 2 ELSE 0 END AS log_count,
               CASE WHEN k = 'program' THEN 'acct' || event_id % 100 ELSE '' END AS pubkey, epoch_us(ts) AS received_at
        FROM n WHERE k IS NOT NULL"""),
    "r3_holder_stream": (r3_holder_stream, over("account_updates", """
        SELECT account, amount, slot, seq FROM (
          SELECT *, row_number() OVER (PARTITION BY account ORDER BY slot DESC, seq DESC) AS rn FROM account_updates)
        WHERE rn = 1 AND amount > 0""")),
    "r5_ingest": (r5_ingest, f"""
        SELECT mint_address, count(*) AS accounts, round(sum(balance), 2) AS balance FROM ({_SQL_HOLDERS}) GROUP BY 1"""),
}
