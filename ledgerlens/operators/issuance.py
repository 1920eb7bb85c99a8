"""Issued tokens and their transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import half_up
from ledgerlens.operators.skew import never_null

# Which parameters of a transaction hold an owner key or a token account.
KEY_FIELDS = {
    "mint": ["destination"],
    "burn": ["source"],
    "freeze": ["accountAddress"],
    "unfreeze": ["accountAddress"],
    "seize": ["source", "destination"],
    "force_burn": ["source"],
    "update_authority": ["currentAuthority", "newAuthority"],
    "pause": [],
    "unpause": [],
    "deploy": [],
}
ACCOUNT_FIELDS = {**KEY_FIELDS, "mint": ["destination", "tokenAccount"], "update_authority": []}


def _candidates(transactions: DataFrame, fields: dict[str, list[str]], alias: str) -> DataFrame:
    """One row per address a transaction's type lets it hold."""
    names = sorted({f for fs in fields.values() for f in fs})
    values = F.from_json("operation_params", ", ".join(f"{n} string" for n in names))
    cases = F.create_map(
        *[x for t, fs in fields.items() for x in (F.lit(t), F.array(*[F.lit(f) for f in fs]).cast("array<string>"))]
    )
    held = F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"_params.{n}").alias("v")) for n in names])
    wanted = F.filter(held, lambda e: F.array_contains(F.col("_fields"), e["f"]) & e["v"].isNotNull())
    return (
        transactions.select("id", "token_id", "type", values.alias("_params"))
        .withColumn("_fields", cases[F.col("type")])
        .select(
            "id", "token_id", F.explode_outer(F.array_distinct(F.transform(wanted, lambda e: e["v"]))).alias(alias)
        )
        .filter(F.col(alias).isNotNull())
    )


def transactions_of_wallet(
    transactions: DataFrame, tokens: DataFrame, keys: DataFrame, accounts: DataFrame
) -> DataFrame:
    """Transactions that involve one of the owner keys, or one of the (token_id, token_account) pairs.

    ``keys`` has public_key.  Each side is a semi join on the extracted addresses.
    """
    by_key = _candidates(transactions, KEY_FIELDS, "public_key").join(
        keys.select("public_key").distinct(), "public_key", "left_semi"
    )
    by_account = _candidates(transactions, ACCOUNT_FIELDS, "token_account").join(
        accounts.select("token_id", "token_account").distinct(), ["token_id", "token_account"], "left_semi"
    )
    hits = by_key.select("id").unionByName(by_account.select("id")).distinct()
    return with_token(transactions, tokens).join(hits, "id", "left_semi")


def with_token(transactions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Transactions next to their token; transactions of unknown tokens are left out."""
    return transactions.join(
        tokens.select("token_id", F.col("symbol").alias("token_symbol"), F.col("name").alias("token_name")),
        "token_id",
    )


def transactions_of_accounts(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transactions whose (token_id, token_account) is listed."""
    pairs = accounts.select("token_id", "token_account").distinct()
    return transactions.join(pairs, ["token_id", "token_account"], "left_semi")


def with_extensions(tokens: DataFrame, extensions: DataFrame) -> DataFrame:
    """Add the map of each token's extensions; the number of extension kinds bounds its size.

    A kind listed twice for a token keeps its largest value.
    """
    once = extensions.groupBy("token_id", "extension").agg(F.max("config").alias("config"))
    maps = once.groupBy("token_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("extension", "config")))).alias("extensions")
    )
    return tokens.join(maps, "token_id", "left")


def _with_figures(tokens: DataFrame, figures: DataFrame) -> DataFrame:
    """Tokens next to their figures; tokens that are not deployed yet have no mint."""
    known = figures.select(F.col("mint_address").alias("_mint"), "supply", "holder_count")
    key = never_null(F.col("mint_address"), F.col("token_id"))
    return tokens.join(known, key == F.col("_mint"), "left").drop("_mint")


def issuer_summary(tokens: DataFrame, figures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens, supply, holders, deployed and pending tokens per issuer.

    ``figures`` has mint_address, supply, holder_count; a token without figures counts as 0.
    """
    deployed = F.col("status").isin("deployed", "active")
    return (
        _with_figures(tokens, figures)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_tokens"),
            F.sum(F.coalesce("supply", F.lit(0.0))).alias("total_supply"),
            F.sum(F.coalesce("holder_count", F.lit(0))).alias("total_holders"),
            F.count_if(deployed).alias("deployed_tokens"),
            F.count_if(~F.coalesce(deployed, F.lit(False))).alias("pending_tokens"),
        )
    )


def issuer_tokens(tokens: DataFrame, figures: DataFrame) -> DataFrame:
    """Per token: supply, holders and the rounded mean balance."""
    supply, holders = F.coalesce("supply", F.lit(0.0)), F.coalesce("holder_count", F.lit(0))
    return _with_figures(tokens, figures).select(
        *tokens.columns,
        supply.alias("total_supply"),
        holders.alias("holder_count"),
        F.when(holders > 0, half_up(supply / holders)).otherwise(0).alias("mean_balance_rounded"),
    )
