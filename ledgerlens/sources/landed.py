"""Landed API payloads (JSON text) to typed snapshot rows.

Every function takes a DataFrame with a ``payload`` column and, where one belongs to a mint, the mint.  Arrays
are exploded with the outer form, so that no filter parses the payload a second time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import UNITS, half_even, ui_amount
from ledgerlens.functions.text import short_address
from ledgerlens.functions.times import moment
from ledgerlens.operators.ordering import first_overall
from ledgerlens.schemas import (
    ACCOUNT_PAYLOAD,
    LARGEST_ACCOUNTS_PAYLOAD,
    LARGEST_HOLDERS_PAYLOAD,
    VOTE_ACCOUNTS_PAYLOAD,
)

# Known mints when discovery finds none, units of the native token, listing sizes.
KNOWN_MINTS = {
    "Gh9ZwEmdLJ8DscKNTkTqPbNwLNNBjuSzaG9Vp2KGtKJr": ("USDC", 6),
    "9fxDZ7rBCNdHureibbAVa6J73srhCYWoKYZWwegXe72Z": ("PYUSD", 6),
}
LAMPORTS = 1e9
TOP_STAKES = 20


def _units(text: Column) -> Column:
    return F.coalesce(text.try_cast(UNITS), F.lit(0).cast(UNITS))


def token_holders(accounts: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """One row per token account: its owner, or the account itself, and its balance or 0.

    ``accounts`` also has mint_address and slot.
    """
    accounts = accounts.withColumn("account", F.from_json("payload", ACCOUNT_PAYLOAD))
    account = F.col("account")
    info = account["account"]["data"]["parsed"]["info"]
    return accounts.select(
        "mint_address",
        F.coalesce(F.nullif(info["owner"], F.lit("")), account["pubkey"]).alias("wallet_address"),
        F.coalesce(info["tokenAmount"]["uiAmount"], F.lit(0.0)).alias("balance"),
        F.coalesce("slot", F.lit(0)).alias("slot"),
        moment(as_of).alias("snapshot_at"),
    )


def discovered_mints(accounts: DataFrame) -> DataFrame:
    """Mint accounts of a discovery payload; the known mints when it has none."""
    # Parsed behind an outer explode, so that the filter below does not parse every payload again.
    parsed = accounts.select(F.explode_outer(F.array(F.from_json("payload", ACCOUNT_PAYLOAD))).alias("account"))
    account = F.col("account")
    info = account["account"]["data"]["parsed"]["info"]
    found = parsed.select(
        account["pubkey"].alias("mint"),
        F.coalesce(info["decimals"], F.lit(0)).alias("decimals"),
        F.coalesce(info["supply"], F.lit("0")).alias("supply"),
        F.coalesce(account["account"]["slot"], F.lit(0)).alias("slot"),
        info["mintAuthority"].alias("mint_authority"),
    ).filter(F.col("mint") != "")
    known = accounts.sparkSession.createDataFrame(
        [(mint, places, "0", 0, None) for mint, (_, places) in KNOWN_MINTS.items()],
        "mint string, decimals int, supply string, slot bigint, mint_authority string",
    )
    return found.unionByName(known.filter(~found.exists()))


def token_symbol(mint: Column) -> Column:
    """Symbol of a known mint, else its short address."""
    entries = [F.lit(x) for mint_, (symbol, _) in KNOWN_MINTS.items() for x in (mint_, symbol)]
    return F.coalesce(F.create_map(*entries)[mint], short_address(mint))


def supply_snapshot(mints: DataFrame, supplies: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Supply per mint from its payload (mint, payload); without one, from the discovery row."""
    value = F.col("value")
    parsed = F.from_json("payload", "amount string, decimals int, uiAmountString string")
    told = supplies.select("mint", F.explode_outer(F.array(parsed)).alias("value")).select(
        "mint",
        value["amount"].alias("_amount"),
        value["decimals"].alias("_decimals"),
        value["uiAmountString"].alias("_ui"),
        F.lit(True).alias("_told"),
    )
    places = F.coalesce("_decimals", "decimals")
    supply = F.when(F.col("_told"), _units(F.col("_amount"))).otherwise(_units(F.col("supply")))
    derived = F.when(
        F.col("decimals") > 0, ui_amount(_units(F.col("supply")), F.col("decimals"))
    ).otherwise(_units(F.col("supply")).cast("double"))
    told_amount = F.coalesce(F.col("_ui").try_cast("double"), F.lit(0.0))
    now = moment(as_of)
    return mints.join(told, "mint", "left").select(
        F.to_date(now).alias("date"),
        "mint",
        token_symbol(F.col("mint")).alias("symbol"),
        supply.alias("supply"),
        places.alias("decimals"),
        F.when(F.col("_told"), told_amount).otherwise(derived).alias("ui_supply"),
        now.alias("scraped_at"),
    )


def network_snapshot(payloads: DataFrame) -> DataFrame:
    """One row per run from the five network payloads (run_at, method, payload); missing ones leave nulls."""

    def of(method: str, schema: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.from_json("payload", schema)))

    runs = payloads.groupBy("run_at").agg(
        of("getSupply", "total string, circulating string, nonCirculating string").alias("supply"),
        of(
            "getRecentPerformanceSamples",
            "numTransactions bigint, samplePeriodSecs int, slot bigint",
        ).alias("sample"),
        of("getTransactionCount", "count bigint").alias("transactions"),
        of("getInflationRate", "total double").alias("inflation"),
        of("getEpochInfo", "epoch bigint, absoluteSlot bigint").alias("epoch_info"),
    )

    def sol(name: str) -> Column:
        whole = F.when(F.col("supply").isNotNull(), F.coalesce(F.col(f"supply.{name}").try_cast("double"), F.lit(0.0)))
        return whole / LAMPORTS

    seconds = F.col("sample.samplePeriodSecs")
    rate = F.coalesce("sample.numTransactions", F.lit(0)) / F.greatest(F.coalesce(seconds, F.lit(1)), F.lit(1))
    return runs.select(
        F.to_date("run_at").alias("date"),
        F.col("run_at").alias("scraped_at"),
        sol("total").alias("total_sol_supply"),
        sol("circulating").alias("circulating_sol_supply"),
        sol("nonCirculating").alias("non_circulating_sol_supply"),
        F.when(
            F.col("sample").isNotNull(), F.when(seconds == 0, F.lit(0.0)).otherwise(half_even(rate, 2))
        ).alias("tps"),
        F.when(F.col("sample").isNotNull(), F.coalesce("sample.slot", F.lit(0)))
        .otherwise(F.col("epoch_info.absoluteSlot"))
        .alias("slot"),
        F.col("transactions.count").alias("transaction_count"),
        half_even(F.col("inflation.total") * 100, 4).alias("inflation_rate"),
        F.col("epoch_info.epoch").alias("epoch"),
    )


def largest_holders(payloads: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Holders per mint in payload order, ranked from 1."""
    rows = payloads.select(
        "mint", F.posexplode_outer(F.from_json("payload", LARGEST_HOLDERS_PAYLOAD)).alias("position", "holder")
    ).filter(F.col("holder").isNotNull())
    return rows.select(
        "mint",
        F.coalesce("holder.address", F.lit("")).alias("holder_address"),
        _units(F.col("holder.amount")).alias("amount"),
        F.coalesce("holder.decimals", F.lit(0)).alias("decimals"),
        F.coalesce("holder.uiAmount", F.lit(0.0)).alias("ui_amount"),
        (F.col("position") + 1).alias("rank"),
        moment(as_of).alias("scraped_at"),
    )


def _stake(vote: str) -> Column:
    return F.coalesce(F.col(f"{vote}.activatedStake").try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def whales(accounts: DataFrame, votes: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Largest accounts in payload order; without any, the twenty current validators with most stake."""
    entries = accounts.select(
        F.posexplode_outer(F.from_json("payload", LARGEST_ACCOUNTS_PAYLOAD)).alias("position", "account")
    )
    listed = entries.filter(F.col("account").isNotNull()).select(
        F.coalesce("account.address", F.lit("")).alias("address"),
        F.coalesce(F.col("account.lamports").try_cast("decimal(20,0)"), F.lit(0)).cast("decimal(20,0)").alias("lamports"),
        (F.col("position") + 1).alias("rank"),
        F.lit("rpc").alias("source"),
    )
    stakes = votes.select(
        F.explode_outer(F.from_json("payload", VOTE_ACCOUNTS_PAYLOAD)["current"]).alias("vote")
    ).filter(F.col("vote").isNotNull())
    fallback = top_stakes(
        stakes.select(F.coalesce("vote.nodePubkey", F.lit("")).alias("address"), _stake("vote").alias("lamports"))
    )
    chosen = listed.unionByName(fallback.filter(~listed.exists()))
    return chosen.select(
        "address",
        "lamports",
        (F.col("lamports").cast("double") / LAMPORTS).alias("ui_balance"),
        "rank",
        moment(as_of).alias("scraped_at"),
        "source",
    )


def top_stakes(stakes: DataFrame, k: int = TOP_STAKES) -> DataFrame:
    """The ``k`` largest stakes (address, lamports), ranked from 1; only those k rows are collected to rank."""
    best = first_overall(stakes, [F.col("lamports").desc(), F.col("address")], k)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("lamports")).alias("down"), "address", "lamports")))
    return best.agg(rows.alias("rows")).select(F.posexplode("rows").alias("position", "row")).select(
        "row.address",
        "row.lamports",
        (F.col("position") + 1).alias("rank"),
        F.lit("validators").alias("source"),
    )


def validators(votes: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Current and delinquent validators, ranked in payload order inside each."""

    def part(status: str) -> DataFrame:
        lists = votes.select(
            F.posexplode_outer(F.from_json("payload", VOTE_ACCOUNTS_PAYLOAD)[status]).alias("position", "vote")
        ).filter(F.col("vote").isNotNull())
        return lists.select(
            F.lit(status).alias("status"),
            F.coalesce("vote.votePubkey", F.lit("")).alias("vote_address"),
            F.coalesce("vote.nodePubkey", F.lit("")).alias("node_pubkey"),
            _stake("vote").alias("activated_stake"),
            F.coalesce("vote.commission", F.lit(0)).alias("commission"),
            F.coalesce("vote.epochVoteAccount", F.lit(False)).alias("epoch_vote_account"),
            F.coalesce("vote.rootSlot", F.lit(0)).alias("root_slot"),
            F.coalesce("vote.lastVote", F.lit(0)).alias("last_vote"),
            (F.col("position") + 1).alias("rank"),
            moment(as_of).alias("scraped_at"),
        )

    return part("current").unionByName(part("delinquent"))


def token_list(payloads: DataFrame) -> DataFrame:
    """Entries of landed token-list files (one JSON array per row)."""
    entry = "array<struct<address:string,symbol:string,name:string,decimals:int,logoURI:string>>"
    rows = payloads.select(F.inline_outer(F.from_json("payload", entry)))
    return rows.filter(F.col("address").isNotNull())


def market_list(payloads: DataFrame, platform: str) -> DataFrame:
    """Entries of landed market files with their address on one platform."""
    entry = "array<struct<id:string,symbol:string,name:string,platforms:map<string,string>>>"
    rows = payloads.select(F.inline_outer(F.from_json("payload", entry))).filter(F.col("id").isNotNull())
    return rows.select("id", "symbol", "name", F.try_element_at("platforms", F.lit(platform)).alias("address"))
