"""Wallet token balances: symbols, prices, totals.

Balance rows have wallet_id, token, mint, amount (base units as text), ui_amount (text), decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import finite_number, is_finite, is_integer_text, with_point
from ledgerlens.operators.exact import sum_amounts
from ledgerlens.operators.ordering import first_overall, first_per_group

# Currencies accepted as US dollars, stable tokens, native token, listing size.
DOLLAR_CURRENCIES = ["USD", "USDC"]
STABLE_TOKENS = ["USDC", "USDT", "USDG", "PYUSD"]
STABLE_MINTS = [
    "4zMMC9srt5Ri5X14GAgXhaHii3GnPAEERYPJgZJDncDU",
    "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v",
    "Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB",
    "4F6PM96JJxngmHnZLBh9n58RH4aTVNWvDs2nuwrT5BP7",
    "2u1tszSeqZ3qBWF3uNGPFc8TzMk2tdiwknnRMWGWjGWH",
    "CXk2AMBfi3TwaEL2468s6zP8xq9NxTXjp9gjMgzeUynM",
    "2b1kV6DkPAnxd5ixfnxCpjxmKwqjjaYmCZfHsFu24GXo",
]
NATIVE_TOKEN = "SOL"
PINNED_TOKEN = "USDC"
LISTED = 3


def fill_symbols(balances: DataFrame, symbols: DataFrame) -> DataFrame:
    """Name tokens that are blank or only repeat their mint; known names are kept.

    ``symbols`` has one row per mint: mint, symbol.
    """
    names = symbols.select(
        F.trim("mint").alias("_mint"), F.when(F.trim("symbol") != "", F.trim("symbol")).alias("_symbol")
    )
    token, mint = F.trim("token"), F.trim("mint")
    missing = (token == "") | (token == mint)
    return (
        balances.join(names, F.trim(balances["mint"]) == F.col("_mint"), "left")
        .withColumn("token", F.when(missing & F.col("_symbol").isNotNull(), F.col("_symbol")).otherwise(F.col("token")))
        .drop("_mint", "_symbol")
    )


def mint_prices(
    balances: DataFrame,
    prices: DataFrame,
    stable: Sequence[str] = STABLE_TOKENS,
    stable_mints: Sequence[str] = STABLE_MINTS,
) -> DataFrame:
    """Dollar price per held mint: 1 for a stable mint or a mint held under a stable name, else the fetched price.

    ``prices`` has one row per mint: mint, price, currency.  A price must be in dollars, finite and not negative.
    """
    is_stable = F.upper(F.trim("token")).isin(*stable) | F.trim("mint").isin(*stable_mints)
    fixed = balances.filter(is_stable).select("mint").distinct().withColumn("usd_price", F.lit(1.0))
    currency = F.upper(F.trim(F.coalesce("currency", F.lit("USD"))))
    sound = is_finite(F.col("price").cast("double")) & (F.col("price") >= 0)
    fetched = prices.filter(sound & currency.isin(*DOLLAR_CURRENCIES)).select(
        F.trim("mint").alias("mint"), F.col("price").cast("double").alias("usd_price")
    )
    return fixed.unionByName(fetched.join(fixed, "mint", "left_anti"))


def price_balances(
    balances: DataFrame,
    prices: DataFrame,
    stable: Sequence[str] = STABLE_TOKENS,
    stable_mints: Sequence[str] = STABLE_MINTS,
) -> DataFrame:
    """Add usd_price and usd_value to balances with a numeric amount and a known price; a value is finite or null."""
    known = mint_prices(balances, prices, stable, stable_mints)
    amount = finite_number(F.col("ui_amount"))
    value = F.round(amount * F.col("usd_price"), 6)
    return (
        balances.join(known, "mint", "left")
        .withColumn("usd_value", F.when(is_finite(value), value))
        .withColumn("usd_price", F.when(amount.isNotNull(), F.col("usd_price")))
    )


def _totals(balances: DataFrame, *more: tuple[str, tuple[str, Column]]) -> DataFrame:
    """Exact base units per mint as text, and the label of the wallet that comes first."""
    units = F.when(is_integer_text(F.col("amount")), F.trim("amount"))
    first = F.struct("wallet_id", "token", "decimals")
    sums = sum_amounts(balances, ["mint"], units, "units", "unsummed", {"first": ("min", first), **dict(more)})
    digits = F.coalesce("units", F.lit("0"))
    return sums.select(
        "first.token",
        "mint",
        digits.alias("amount"),
        with_point(digits, F.col("first.decimals")).alias("ui_amount"),
        "first.decimals",
        *[name for name, _ in more],
    )


def total_per_mint(balances: DataFrame) -> DataFrame:
    """Exact balance per mint over all wallets, for amounts of any length; malformed amounts count as 0."""
    return _totals(balances)


def valid_total_per_mint(balances: DataFrame) -> DataFrame:
    """Exact balance and dollar value per mint; rows with a malformed amount are dropped, values that are not finite too."""
    sound = balances.filter(is_integer_text(F.col("amount")) & finite_number(F.col("ui_amount")).isNotNull())
    value = F.when(is_finite(F.col("usd_value")), F.col("usd_value"))
    return _totals(sound, ("usd_value", ("sum", value))).withColumn("usd_value", F.round("usd_value", 6))


def malformed_amounts(balances: DataFrame) -> DataFrame:
    """Rows the totals cannot use, with the reason."""
    bad_units = ~is_integer_text(F.col("amount"))
    bad_amount = finite_number(F.col("ui_amount")).isNull()
    return balances.withColumn(
        "reason", F.when(bad_units, "amount").when(bad_amount, "ui_amount")
    ).filter(F.col("reason").isNotNull())


def total_value(balances: DataFrame) -> DataFrame:
    """Dollar value of everything, null when nothing has a price; values that are not finite have none."""
    return balances.agg(F.sum(F.when(is_finite(F.col("usd_value")), F.col("usd_value"))).alias("total_usd"))


def listed_balances(balances: DataFrame) -> DataFrame:
    """Priced balances without the native token, the pinned token first, then by name."""
    name = F.upper(F.trim("token"))
    return balances.filter((name != NATIVE_TOKEN) & F.col("usd_value").isNotNull()).orderBy(
        F.when(name == PINNED_TOKEN, 0).otherwise(1), "token", "mint"
    )


def top_balances(balances: DataFrame, k: int = LISTED) -> DataFrame:
    """The pinned token, then the largest dollar values."""
    pinned = F.when(F.upper(F.trim("token")) == PINNED_TOKEN, 0).otherwise(1)
    value = F.coalesce("usd_value", F.lit(0.0))
    return first_overall(balances, [pinned, value.desc(), F.col("token"), F.col("mint")], k)


def positive_per_owner(accounts: DataFrame) -> DataFrame:
    """Balance per owner and mint over token accounts with a positive amount."""
    return (
        accounts.filter(F.col("amount") > 0)
        .groupBy("owner", "mint")
        .agg(F.sum("amount").alias("amount"))
    )


def largest_account(accounts: DataFrame) -> DataFrame:
    """Token account with the largest amount per owner and mint; the earliest of equals."""
    return first_per_group(
        accounts, ["owner", "mint"], [F.col("amount").desc(), F.col("position"), F.col("account")]
    )


def volume_since(transfers: DataFrame, start: Column) -> DataFrame:
    """Exact sum of the amounts created at or after ``start`` as decimal text, for amounts of any length.

    ``volume`` is null when there is none; ``unsummed`` counts amounts that are no decimal text.
    """
    return sum_amounts(transfers.filter(F.col("created_at") >= start), [], F.col("amount"), "volume", "unsummed")
