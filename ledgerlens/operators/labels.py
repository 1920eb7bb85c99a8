"""Wallet labels: attribution, distributions, coverage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import half_even, half_up
from ledgerlens.functions.times import moment
from ledgerlens.operators.merge import merge_by_key
from ledgerlens.operators.skew import materialise

# Programs with a known operator, label defaults, confidence levels.
PROGRAMS = {
    "JUP6LkbZbjS1jKKwapdHNy74zcZ3tLUZoi5QNyVTaV4": "protocol:jupiter",
    "whirLbMiicVdio4qvUfM5KAg6Ct8VwpYzGff3uctyCc": "protocol:orca",
    "675kPX9MHTjS2zt1qfr1NYHuzeLXfQM9H24wFSUt1Mp8": "protocol:raydium",
    "MarBmsSgKXdrN1egZf5sqe1TMai9K1rChYNDJgjq7aD": "protocol:marinade",
    "metaqbxxUerdq28cj1RbAWkYQm3ybzjb6a8bt518x1s": "protocol:metaplex",
}
UNKNOWN_REGION, UNKNOWN_CATEGORY = "Unknown", "unknown"
CONFIRMED, SINGLE_SOURCE = 1.0, 0.9


def is_unlabelled() -> Column:
    return (F.col("geography") == UNKNOWN_REGION) | (F.col("attribution_category") == UNKNOWN_CATEGORY)


def unlabelled(labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Wallets without region or category; ``limit`` bounds one run of a rate-limited enrichment."""
    wallets = labels.filter(is_unlabelled()).select("wallet_address")
    return wallets if limit is None else wallets.orderBy("wallet_address").limit(limit)


def _shares(pairs: DataFrame, column: str, unknown: str, alias: str, total: Column) -> DataFrame:
    counts = (
        pairs.filter(F.col(column).isNotNull() & (F.col(column) != unknown))
        .groupBy(F.col(column).alias(alias))
        .agg(F.sum("wallets").alias("holder_count"))
    )
    share = half_up(F.col("holder_count") / total * 100).cast("int")
    return counts.select(alias, F.when(total > 0, share).otherwise(0).alias("percentage"), "holder_count")


def labelled_shares(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions and categories of labelled wallets, in whole percent of the wallets with a region.

    The labels are read once: wallets are counted per region and category, and these few rows are written.
    """
    counted = labels.groupBy("geography", "attribution_category").agg(F.count(F.lit(1)).alias("wallets"))
    pairs = materialise(counted, "label-pairs")
    known = F.col("geography").isNotNull() & (F.col("geography") != UNKNOWN_REGION)
    total = pairs.filter(known).agg(F.coalesce(F.sum("wallets"), F.lit(0))).scalar()
    return (
        _shares(pairs, "geography", UNKNOWN_REGION, "region", total),
        _shares(pairs, "attribution_category", UNKNOWN_CATEGORY, "category", total),
    )


def holder_distribution(holders: DataFrame, column: str, alias: str, unknown: str) -> DataFrame:
    """Holders per label in percent of all holders, to two places; one ``unknown`` row when there are none."""
    total = holders.agg(F.count(F.lit(1)).alias("holder_count"))
    counts = holders.groupBy(F.coalesce(column, F.lit(unknown)).alias(alias)).agg(
        F.count(F.lit(1)).alias("holder_count")
    )
    share = half_even(F.col("holder_count") / total.scalar() * 100, 2)
    listed = counts.select(alias, share.alias("percentage"), "holder_count")
    fallback = total.filter(F.col("holder_count") == 0).select(
        F.lit(unknown).alias(alias), F.lit(100.0).alias("percentage"), "holder_count"
    )
    return listed.unionByName(fallback)


def program_attribution(
    labels: DataFrame, as_of: datetime | str | Column, programs: dict[str, str] | None = None
) -> DataFrame:
    """Label unlabelled wallets that are known programs; a fixed list, so a map literal is enough."""
    programs = PROGRAMS if programs is None else programs
    entries = [F.lit(x) for pair in programs.items() for x in pair]
    known = F.create_map(*entries)[F.col("wallet_address")]
    hit = is_unlabelled() & known.isNotNull()
    new = {
        "attribution_category": known,
        "source_detail": F.lit("heuristic"),
        "confidence": F.lit(CONFIRMED),
        "source": F.lit("heuristic"),
        "updated_at": moment(as_of),
    }
    return labels.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in labels.columns]
    )


def resolve_sources(
    wallets: DataFrame, identities: DataFrame, confirmations: DataFrame, exchanges: DataFrame | None = None
) -> DataFrame:
    """Attribution of wallets from landed source tables; wallets nobody can attribute are left out.

    ``identities`` (wallet_address, source, name, category) attributes a wallet, ``confirmations``
    (wallet_address, source) only confirms it, ``exchanges`` (wallet_address, exchange, country) is a fixed
    list that also gives a region.  Each has one row per wallet.
    """
    named = identities.select(
        "wallet_address",
        F.coalesce("category", "name").alias("_name"),
        F.col("source").alias("_by"),
    ).filter(F.col("_name").isNotNull())
    confirmed = confirmations.select("wallet_address", F.col("source").alias("_also"))
    found = wallets.join(named, "wallet_address", "left").join(confirmed, "wallet_address", "left")
    label, region = F.concat(F.lit("entity:"), F.col("_name")), F.lit(UNKNOWN_REGION)
    listed = F.lit(None).cast("string")
    if exchanges is not None:
        found = found.join(exchanges, "wallet_address", "left")
        listed = F.when(F.col("exchange").isNotNull(), F.lit("static"))
        label = F.coalesce(F.concat(F.lit("exchange:"), F.col("exchange")), label)
        region = F.coalesce("country", region)
    sources = F.array_compact(F.array(listed, F.col("_by"), F.col("_also")))
    return (
        found.withColumn("attribution_category", label)
        .filter(F.col("attribution_category").isNotNull())
        .select(
            "wallet_address",
            "attribution_category",
            region.alias("geography"),
            F.when(F.size(sources) >= 2, CONFIRMED).otherwise(SINGLE_SOURCE).alias("confidence"),
            F.array_join(sources, "+").alias("source_detail"),
            F.get(sources, F.lit(0)).alias("source"),
        )
    )


def enrich(
    labels: DataFrame,
    identities: DataFrame,
    confirmations: DataFrame,
    as_of: datetime | str | Column,
    exchanges: DataFrame | None = None,
) -> DataFrame:
    """Apply :func:`resolve_sources` to the unlabelled wallets of the label table."""
    updates = resolve_sources(unlabelled(labels), identities, confirmations, exchanges).withColumn(
        "updated_at", moment(as_of)
    )
    replaced = {c: "replace" for c in updates.columns if c != "wallet_address"}
    return merge_by_key(labels, updates, ["wallet_address"], replaced)


def new_wallets(
    holders: DataFrame, labels: DataFrame, as_of: datetime | str | Column, source: str
) -> DataFrame:
    """Default label rows for wallets that have none yet."""
    return (
        holders.select("wallet_address")
        .distinct()
        .join(labels, "wallet_address", "left_anti")
        .select(
            "wallet_address",
            F.lit(UNKNOWN_REGION).alias("geography"),
            F.lit(UNKNOWN_CATEGORY).alias("attribution_category"),
            F.lit(source).alias("source"),
            moment(as_of).alias("updated_at"),
        )
    )


def coverage(labels: DataFrame, holders: DataFrame, large_balance: float = 1000.0) -> DataFrame:
    """Share of labelled wallets, of labelled wallets among large holders, confidence, two-source share."""
    balances = holders.groupBy("wallet_address").agg(F.sum("balance").alias("balance"))
    labelled = F.col("attribution_category").isNotNull() & (
        F.col("attribution_category") != UNKNOWN_CATEGORY
    )
    large = F.col("balance") > large_balance
    agreed = F.size(F.split("source_detail", r"\+")) >= 2

    def percent(part: Column, whole: Column) -> Column:
        return F.try_divide(F.count_if(part) * 100.0, F.count_if(whole))

    return labels.join(balances, "wallet_address", "left").agg(
        F.count(F.lit(1)).alias("wallets"),
        percent(labelled, F.lit(True)).alias("labelled_pct"),
        percent(labelled & large, large).alias("large_labelled_pct"),
        F.avg(F.when(labelled, F.col("confidence"))).alias("avg_confidence"),
        percent(labelled & agreed, labelled).alias("two_source_pct"),
    )
