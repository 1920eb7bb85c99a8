"""Token registry: listings, merge of sources, registration, verification."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.identity import token_uuid
from ledgerlens.functions.text import first_eight
from ledgerlens.functions.times import moment
from ledgerlens.operators.listing import equal_or_in, page
from ledgerlens.operators.merge import insert_absent, merge_by_key
from ledgerlens.operators.ordering import first_per_group

# Registry defaults and status names.
DEFAULT_STATUS, DEFAULT_PRIORITY, DEFAULT_MIN_HOLDERS, DEFAULT_DECIMALS = "pending", 50, 100, 9
RECHECK_STATUSES = ["pending", "failed", "stale"]
CLOSED_STATUSES = ["retired", "rug_flagged", "stale"]
RECHECK_HOURS = 24
SORT_COLUMNS = ["priority", "symbol", "last_verified_at"]
SOURCES = ["env", "db", "user_deployment", "discovery"]
ADDRESS_LENGTH = 44
BOOTSTRAP = [
    ("EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v", "USDC", "USD Coin", "mainnet", 6),
    ("Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB", "USDT", "Tether USD", "mainnet", 6),
    ("4zMMC9srt5Ri5X14GAgXhaHii3GnPAEERYPXg4gQzNBP", "PYUSD", "PayPal USD", "mainnet", 6),
    ("Gh9ZwEmdLJ8DscKNTkTqPbNwLNNBjuSzaG9Vp2KGtKJr", "USDC_DEV", "USD Coin (Devnet)", "devnet", 6),
    ("9fxDZ7rBCNdHureibbAVa6J73srhCYWoKYZWwegXe72Z", "PYUSD_DEV", "PayPal USD (Devnet)", "devnet", 6),
]


def active_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.filter("is_active").orderBy(F.col("priority").desc(), "symbol", "mint_address")


def list_tokens(
    tokens: DataFrame,
    status: str | None = None,
    source: str | None = None,
    sort: str = "priority",
    descending: bool = True,
    limit: int | None = None,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Active tokens with optional status and source flag, and their total."""
    if sort not in SORT_COLUMNS or (source is not None and source not in SOURCES):
        raise ValueError("unknown sort column or source")
    key = F.col(sort).desc() if descending else F.col(sort).asc()
    flag = None if source is None else F.col(f"source_{source}")
    predicates = [F.col("is_active"), equal_or_in("verification_status", status), flag]
    return page(tokens, predicates, [key, F.col("mint_address")], limit, offset)


def needs_recheck(as_of: datetime | str | Column) -> Column:
    cutoff = moment(as_of) - F.expr(f"INTERVAL {RECHECK_HOURS} HOURS")
    return F.col("is_active") & (
        F.col("verification_status").isin(*RECHECK_STATUSES)
        | F.col("last_verified_at").isNull()
        | (F.col("last_verified_at") < cutoff)
    )


def needing_recheck(tokens: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    return tokens.filter(needs_recheck(as_of)).orderBy(F.col("priority").desc(), "mint_address")


def lifecycle_log(tokens: DataFrame, limit: int | None = None) -> DataFrame:
    """Closed or stale tokens, newest first."""
    return page(
        tokens.select(
            "mint_address",
            F.col("verification_status").alias("event_type"),
            F.coalesce("verification_error", F.lit("")).alias("details"),
            F.col("updated_at").alias("created_at"),
        ),
        [F.col("event_type").isin(*CLOSED_STATUSES)],
        [F.col("created_at").desc(), F.col("mint_address")],
        limit,
    )[0]


def registry_summary(tokens: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Thirteen counts in one pass."""
    active, status = F.col("is_active"), F.col("verification_status")
    recent = F.col("updated_at") > moment(as_of) - F.expr("INTERVAL 30 DAYS")
    return tokens.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(active).alias("active"),
        *[F.count_if(active & (status == s)).alias(s) for s in ["verified", "pending", "failed", "stale"]],
        F.count_if(status == "rug_flagged").alias("rug_flagged"),
        F.count_if(status == "retired").alias("retired"),
        F.count_if((status == "retired") & recent).alias("retired_30d"),
        F.count_if("source_env").alias("by_source_env"),
        F.count_if("source_db").alias("by_source_db"),
        F.count_if("source_user_deployment").alias("by_source_user"),
        F.count_if("source_discovery").alias("by_source_discovery"),
    )


def deployed_mints(issued: DataFrame) -> DataFrame:
    return (
        issued.filter((F.col("status") == "deployed") & F.col("mint_address").isNotNull())
        .select("mint_address")
        .distinct()
    )


def resolve_mints(configured: DataFrame, tokens: DataFrame, issued: DataFrame) -> DataFrame:
    """One row per mint from the configured list, the active registry and deployed tokens.

    Only the registry carries values; the other sources say that a mint is wanted.  The aggregation holds
    one row and three flags per mint, whatever the number of copies.
    """
    fields = ["symbol", "name", "decimals", "verification_status", "priority", "min_holders_threshold", "tags"]
    known = tokens.filter("is_active").select(
        "mint_address", F.lit("db").alias("source"), F.struct(*fields).alias("entry")
    )
    empty = F.lit(None).cast(known.schema["entry"].dataType)
    wanted = configured.select("mint_address", F.lit("env").alias("source"), empty.alias("entry"))
    deployed = deployed_mints(issued).select(
        "mint_address", F.lit("user_deployment").alias("source"), empty.alias("entry")
    )
    seen = [F.max(F.col("source") == s).alias(f"_{s}") for s in ("env", "db", "user_deployment")]
    merged = (
        wanted.unionByName(known)
        .unionByName(deployed)
        .groupBy("mint_address")
        .agg(F.max("entry").alias("entry"), *seen)
    )
    mint = F.col("mint_address")
    return merged.select(
        "mint_address",
        F.coalesce("entry.symbol", first_eight(mint)).alias("symbol"),
        F.coalesce("entry.name", F.concat(F.lit("Token "), first_eight(mint))).alias("name"),
        F.coalesce("entry.decimals", F.lit(DEFAULT_DECIMALS)).alias("decimals"),
        F.array_compact(
            F.array(*[F.when(F.col(f"_{s}"), F.lit(s)) for s in ("env", "db", "user_deployment")])
        ).alias("sources"),
        F.coalesce("entry.verification_status", F.lit(DEFAULT_STATUS)).alias("verification_status"),
        F.coalesce("entry.priority", F.lit(DEFAULT_PRIORITY)).alias("priority"),
        F.coalesce("entry.min_holders_threshold", F.lit(DEFAULT_MIN_HOLDERS)).alias(
            "min_holders_threshold"
        ),
        F.array_distinct(F.coalesce("entry.tags", F.array().cast("array<string>"))).alias("tags"),
    ).orderBy(F.col("priority").desc(), "mint_address")


def _new_token_defaults(tag: str, as_of: Column) -> dict[str, Column]:
    return {
        "source_env": F.lit(False),
        "source_db": F.lit(False),
        "source_user_deployment": F.lit(False),
        "source_discovery": F.lit(False),
        "is_active": F.lit(True),
        "priority": F.lit(DEFAULT_PRIORITY),
        "min_holders_threshold": F.lit(DEFAULT_MIN_HOLDERS),
        "tags": F.array(F.lit(tag)),
        "verification_status": F.lit(DEFAULT_STATUS),
        "added_at": as_of,
        "updated_at": as_of,
    }


def register_user_tokens(
    tokens: DataFrame, deployed: DataFrame, as_of: datetime | str | Column
) -> DataFrame:
    """Registry with user-deployed tokens (mint_address, symbol, name, decimals) inserted or flagged."""
    now = moment(as_of)
    updates = deployed.withColumns(
        {"source_user_deployment": F.lit(True), "is_active": F.lit(True), "updated_at": now}
    )
    rules = {
        "source_user_deployment": "replace",
        "is_active": "replace",
        "symbol": "coalesce_new",
        "name": "coalesce_new",
        "decimals": "coalesce_new",
        "updated_at": "replace",
    }
    return merge_by_key(
        tokens, updates, ["mint_address"], rules, _new_token_defaults("user-deployed", now)
    )


def register_discovered_tokens(
    tokens: DataFrame, found: DataFrame, as_of: datetime | str | Column
) -> DataFrame:
    """Registry with externally discovered tokens; ``found`` also has source, logo_uri and coingecko_id."""
    now = moment(as_of)
    updates = found.select(
        "mint_address",
        "symbol",
        "name",
        "decimals",
        "logo_uri",
        "coingecko_id",
        (F.col("source") == "jupiter").alias("jupiter_verified"),
        F.lit(True).alias("source_discovery"),
        F.lit(True).alias("is_active"),
        F.array(F.lit("discovered")).alias("tags"),
        now.alias("updated_at"),
    )
    rules = {
        "source_discovery": "replace",
        "is_active": "replace",
        "updated_at": "replace",
        "tags": "array_concat",
        **{
            c: "coalesce_new"
            for c in ["symbol", "name", "decimals", "logo_uri", "coingecko_id", "jupiter_verified"]
        },
    }
    return merge_by_key(tokens, updates, ["mint_address"], rules, _new_token_defaults("discovered", now))


def seed_tokens(tokens: DataFrame, seeds: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Seed rows: inserted as given, or reactivating the known row with the higher priority."""
    updates = seeds.withColumns({"is_active": F.lit(True), "updated_at": moment(as_of)})
    rules = {
        "is_active": "replace",
        "source_env": "replace",
        "source_db": "replace",
        "symbol": "coalesce_new",
        "name": "coalesce_new",
        "priority": "greatest",
        "updated_at": "replace",
    }
    return merge_by_key(
        tokens, updates, ["mint_address"], rules, _new_token_defaults("seed", moment(as_of))
    )


def deactivate(tokens: DataFrame, mints: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Switch off the listed mints."""
    updates = mints.select(
        "mint_address", F.lit(False).alias("is_active"), moment(as_of).alias("updated_at")
    ).dropDuplicates(["mint_address"])
    rules = {"is_active": "replace", "updated_at": "replace"}
    return merge_by_key(tokens, updates, ["mint_address"], rules, insert=False)


# Fields a sparse update may set; fixed values.
SPARSE_FIELDS = [
    "last_ingested_at", "last_ingestion_status", "last_ingestion_error", "holder_count", "supply", "decimals",
    "last_slot", "last_verified_at", "verification_status", "verification_sources", "verification_error",
    "holder_count_at_verification", "supply_at_verification",
]


def sparse_update(tokens: DataFrame, updates: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Set only the fields named in each update's ``set_fields`` array; a named field may become null.

    An update that names no field leaves the row, including its update time, as it is.
    """
    fields = [f for f in SPARSE_FIELDS if f in updates.columns and f in tokens.columns]
    allowed = F.array(*[F.lit(f) for f in fields])
    named = updates.filter(F.arrays_overlap("set_fields", allowed))
    fresh = named.select(
        "mint_address", F.col("set_fields").alias("_set"), *[F.col(f).alias(f"_new_{f}") for f in fields]
    )
    joined = tokens.join(fresh, "mint_address", "left")
    types = {f.name: f.dataType for f in tokens.schema}
    changed = {
        f: F.when(F.array_contains("_set", f), F.col(f"_new_{f}").cast(types[f])).otherwise(F.col(f))
        for f in fields
    }
    changed["updated_at"] = F.when(F.col("_set").isNotNull(), moment(as_of)).otherwise(F.col("updated_at"))
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in tokens.columns])


def candidates_from_lists(
    verified_list: DataFrame, market_list: DataFrame, on_chain: DataFrame
) -> DataFrame:
    """Discovery candidates from two landed list files, kept only when verified on chain.

    ``verified_list``: address, symbol, name, decimals, logoURI.  ``market_list``: id, symbol, name and the
    platform address.  ``on_chain``: mint_address, verified.
    """
    first = verified_list.select(
        F.col("address").alias("mint_address"),
        "symbol",
        "name",
        F.col("decimals").cast("int").alias("decimals"),
        F.lit("jupiter").alias("source"),
        F.col("logoURI").alias("logo_uri"),
        F.lit(None).cast("string").alias("coingecko_id"),
    )
    second = market_list.select(
        F.col("address").alias("mint_address"),
        F.upper("symbol").alias("symbol"),
        "name",
        F.lit(DEFAULT_DECIMALS).alias("decimals"),
        F.lit("coingecko").alias("source"),
        F.lit(None).cast("string").alias("logo_uri"),
        F.col("id").alias("coingecko_id"),
    )
    sound = first.unionByName(second).filter(F.length("mint_address") == ADDRESS_LENGTH)
    return sound.join(on_chain.filter("verified").select("mint_address"), "mint_address", "left_semi")


def register_candidates(
    tokens: DataFrame, candidates: DataFrame, as_of: datetime | str | Column
) -> DataFrame:
    """Register both lists in turn: the market list after the verified list, as its values win."""
    for source in ("jupiter", "coingecko"):
        batch = first_per_group(
            candidates.filter(F.col("source") == source),
            ["mint_address"],
            [F.col("symbol"), F.col("name"), F.col("coingecko_id")],
        )
        tokens = register_discovered_tokens(tokens, batch, as_of)
    return tokens


def reverify(tokens: DataFrame, on_chain: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Apply landed verification results (mint_address, verified, holders, supply, decimals) to due tokens.

    A due token without a positive result fails.
    """
    now = moment(as_of)
    results = on_chain.select(
        "mint_address",
        F.col("verified").alias("_verified"),
        F.col("holders").alias("_holders"),
        F.col("supply").alias("_supply"),
        F.col("decimals").alias("_decimals"),
    )
    joined = tokens.join(results, "mint_address", "left")
    due, good = needs_recheck(now), F.coalesce("_verified", F.lit(False))
    types = {f.name: f.dataType for f in tokens.schema}
    sources = F.array_distinct(
        F.concat(
            F.coalesce("verification_sources", F.array().cast("array<string>")),
            F.array(F.lit("rpc_reverification")),
        )
    )
    passed = {
        "verification_status": F.lit("verified"),
        "last_verified_at": now,
        "verification_sources": sources,
        "verification_error": F.lit(None),
        "holder_count_at_verification": F.coalesce("_holders", F.lit(0)),
        "supply_at_verification": F.coalesce("_supply", F.lit(0)),
        "decimals": F.coalesce("_decimals", F.lit(DEFAULT_DECIMALS)),
        "updated_at": now,
    }
    failed = {
        "verification_status": F.lit("failed"),
        "verification_error": F.lit("RPC verification failed"),
        "updated_at": now,
    }
    return joined.select(
        *[
            F.when(due & good, passed.get(c, F.col(c)).cast(types[c]))
            .when(due & ~good, failed.get(c, F.col(c)).cast(types[c]))
            .otherwise(F.col(c))
            .alias(c)
            for c in tokens.columns
        ]
    )


def bootstrap_registry(spark) -> DataFrame:
    """The fixed first rows of the identifier registry."""
    rows = spark.createDataFrame(BOOTSTRAP, "mint string, symbol string, name string, network string, decimals int")
    return rows.select(token_uuid(F.col("mint")).alias("uuid"), "*")


def register_identifiers(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry plus mints it does not have; registering a mint twice changes nothing."""
    rows = new.select(
        token_uuid(F.col("mint")).alias("uuid"),
        "mint",
        "symbol",
        F.coalesce(F.when(F.col("name") != "", F.col("name")), "symbol").alias("name"),
        F.coalesce("network", F.lit("devnet")).alias("network"),
        F.coalesce("decimals", F.lit(6)).alias("decimals"),
    )
    return registry.unionByName(insert_absent(registry, rows, ["mint"]))


def identifier_of(registry: DataFrame, mint: str | None = None, uuid: str | None = None) -> DataFrame:
    """The registry row of a mint or of an identifier; exactly one of the two is given."""
    if (mint is None) == (uuid is None):
        raise ValueError("give a mint or a uuid")
    return registry.filter(F.col("mint") == mint if uuid is None else F.col("uuid") == uuid)


def with_identifiers(rows: DataFrame, registry: DataFrame, by: str = "mint") -> DataFrame:
    """Rows with the registry's columns added, looked up by ``mint`` or ``uuid``; unknown ones get nulls."""
    if by not in ("mint", "uuid"):
        raise ValueError("look up by mint or uuid")
    return rows.join(registry, by, "left")
