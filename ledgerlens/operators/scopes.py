"""Lookups by scope: bindings, targets, defaults, memberships.

Where the right side has several candidates per key, the best one is chosen before the join, so no join
multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.documents import field
from ledgerlens.operators.listing import all_of
from ledgerlens.operators.ordering import first_per_group
from ledgerlens.operators.skew import HOT_GROUP_ROWS, find_hot, join_group_values


def with_existence(
    df: DataFrame, other: DataFrame, keys: Sequence[str], alias: str, yes: str, no: str
) -> DataFrame:
    """Add a column telling whether ``other`` has the key."""
    present = other.select(*keys).distinct().withColumn("_present", F.lit(True))
    return (
        df.join(present, list(keys), "left")
        .withColumn(alias, F.when(F.col("_present"), yes).otherwise(no))
        .drop("_present")
    )


def first_members(organizations: DataFrame, members: DataFrame, projects: DataFrame, environment: str) -> DataFrame:
    """Earliest active member of each organization that has no project in the environment yet."""
    first = first_per_group(
        members.filter(F.col("status") == "active"),
        ["organization_id"],
        [F.col("created_at"), F.col("user_id")],
    ).select("organization_id", "user_id")
    existing = projects.filter(F.col("environment") == environment).select("organization_id")
    return (
        organizations.select("organization_id")
        .join(first, "organization_id")
        .join(existing, "organization_id", "left_anti")
    )


def fill_project(df: DataFrame, projects: DataFrame, default_slugs: Sequence[str]) -> DataFrame:
    """Project of rows without one: the default, else the oldest, project of organization and environment."""
    preferred = F.when(F.col("slug").isin(*default_slugs), 0).otherwise(1)
    best = first_per_group(
        projects, ["organization_id", "environment"], [preferred, F.col("created_at"), F.col("project_id")]
    ).select("organization_id", "environment", F.col("project_id").alias("_project"))
    return (
        df.join(best, ["organization_id", "environment"], "left")
        .withColumn("project_id", F.coalesce("project_id", "_project"))
        .drop("_project")
    )


def fill_default_project(df: DataFrame, projects: DataFrame, slug: str) -> DataFrame:
    """Project of rows without one: the organization's project with the slug."""
    default = projects.filter(F.col("slug") == slug).select(
        "organization_id", F.col("project_id").alias("_project")
    )
    return (
        df.join(default, "organization_id", "left")
        .withColumn("project_id", F.coalesce("project_id", "_project"))
        .drop("_project")
    )


def missing_memberships(
    projects: DataFrame, members: DataFrame, memberships: DataFrame, default_slugs: Sequence[str]
) -> DataFrame:
    """Default project and active member pairs of an organization that are not memberships yet.

    An organization has one project per slug, so a member gets at most ``len(default_slugs)`` rows.
    """
    defaults = projects.filter(F.col("slug").isin(*default_slugs)).select("organization_id", "project_id")
    active = members.filter(F.col("status") == "active").select("organization_id", "user_id").distinct()
    return (
        defaults.join(active, "organization_id")
        .select("project_id", "user_id")
        .join(memberships, ["project_id", "user_id"], "left_anti")
    )


def resolve_bindings(requests: DataFrame, bindings: DataFrame) -> DataFrame:
    """Binding that applies to each requested (api_key_id, wallet_id), and how many bindings the key has.

    A binding for the selected wallet comes before one for all wallets; of several, the newest.  The count
    is kept when no binding applies.
    """
    newest = [F.col("updated_at").desc(), F.col("created_at").desc(), F.col("binding_id")]
    counts = bindings.groupBy("api_key_id").agg(F.count(F.lit(1)).alias("_count"))
    selected = first_per_group(
        bindings.filter(F.col("binding_scope") == "selected"), ["api_key_id", "wallet_id"], newest
    ).select("api_key_id", "wallet_id", F.col("binding_id").alias("_selected"))
    general = first_per_group(
        bindings.filter(F.col("binding_scope") == "all"), ["api_key_id"], newest
    ).select("api_key_id", F.col("binding_id").alias("_all"))
    binding = F.coalesce("_selected", "_all")
    return (
        requests.join(counts, "api_key_id", "left")
        .join(general, "api_key_id", "left")
        .join(selected, ["api_key_id", "wallet_id"], "left")
        .select(
            *requests.columns,
            F.coalesce("_count", F.lit(0)).alias("total_binding_count"),
            binding.alias("binding_id"),
            F.when(F.col("_selected").isNotNull(), "selected")
            .when(F.col("_all").isNotNull(), "all")
            .alias("binding_scope"),
        )
    )


def resolve_targets(
    requests: DataFrame,
    api_keys: DataFrame,
    configs: DataFrame,
    wallets: DataFrame,
    permissions: DataFrame,
) -> DataFrame:
    """Custody wallet behind each requested (api_key_id, wallet_id).

    Wallets of the key's own project come first, then wallets without a project, then others; of several,
    the newest.
    """
    keys = api_keys.filter(F.col("status") == "active").select(
        "api_key_id", "organization_id", "project_id"
    )
    held = (
        wallets.filter(F.col("status") == "active")
        .join(
            configs.filter(F.col("status") == "active").select(
                "config_id", "organization_id", F.col("project_id").alias("wallet_project_id")
            ),
            "config_id",
        )
        .select(
            "organization_id",
            "wallet_id",
            F.col("wallet_project_id").alias("project_id"),
            F.struct("custody_wallet_id", "wallet_project_id").alias("wallet"),
            "created_at",
        )
    )
    newest = [F.col("created_at").desc(), F.col("wallet.custody_wallet_id")]

    def best(candidates: DataFrame, keys: list[str], alias: str) -> DataFrame:
        return first_per_group(candidates, keys, newest).select(*keys, F.col("wallet").alias(alias))

    place = ["organization_id", "wallet_id"]
    of_project = held.filter(F.col("project_id").isNotNull())
    own = best(of_project, [*place, "project_id"], "_own")
    shared = best(held.filter(F.col("project_id").isNull()), place, "_shared")
    other = best(of_project, place, "_other")
    counts = permissions.groupBy("api_key_id").agg(F.count(F.lit(1)).alias("endpoint_binding_count"))
    allowed = permissions.select("api_key_id", "wallet_id", "permission_id")
    return (
        requests.distinct()
        .join(keys, "api_key_id")
        .join(own, [*place, "project_id"], "left")
        .join(shared, place, "left")
        .join(other, place, "left")
        .withColumn("_wallet", F.coalesce("_own", "_shared", "_other"))
        .filter(F.col("_wallet").isNotNull())
        .join(counts, "api_key_id", "left")
        .join(allowed, ["api_key_id", "wallet_id"], "left")
        .select(
            "api_key_id",
            "organization_id",
            "project_id",
            "wallet_id",
            "_wallet.custody_wallet_id",
            "_wallet.wallet_project_id",
            F.coalesce("endpoint_binding_count", F.lit(0)).alias("endpoint_binding_count"),
            "permission_id",
        )
    )


def removable(wallets: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Active wallets whose configuration keeps another active one."""
    active = wallets.filter(F.col("status") == "active")
    counts = active.groupBy("config_id").agg(F.count(F.lit(1)).alias("_active"))
    joined = join_group_values(active, counts, ["config_id"], find_hot(active, ["config_id"], hot_rows))
    return joined.filter(F.col("_active") > 1).drop("_active")


def next_revisions(profiles: DataFrame, revisions: DataFrame) -> DataFrame:
    """Revision number each profile gets next."""
    last = revisions.groupBy("profile_id").agg(F.max("revision").alias("_last"))
    return (
        profiles.select("profile_id")
        .join(last, "profile_id", "left")
        .select("profile_id", (F.coalesce("_last", F.lit(0)) + 1).alias("next_revision"))
    )


def evaluations_with_operations(evaluations: DataFrame, operations: DataFrame) -> DataFrame:
    """Evaluations next to the operation they judged, newest first."""
    return evaluations.join(operations, "wallet_operation_id").orderBy(
        F.col("created_at").desc(), F.col("evaluation_id").desc()
    )


def batch_recipients(
    accounts: DataFrame,
    counterparties: DataFrame,
    network: str,
    search: str | None = None,
    account_ids: Sequence[Any] | None = None,
) -> DataFrame:
    """Active crypto accounts of active counterparties on a network that have an address."""
    details = F.col("details")
    usable = accounts.filter(
        all_of(
            [
                F.col("status") == "active",
                F.col("account_kind") == "crypto_wallet",
                field(details, "network") == network,
                field(details, "address").isNotNull(),
                F.col("account_id").isin(*account_ids) if account_ids else None,
            ]
        )
    )
    people = counterparties.filter(
        all_of(
            [
                F.col("status") == "active",
                F.col("display_name").ilike(f"%{search}%") if search else None,
            ]
        )
    ).select("counterparty_id", "organization_id", "project_id", "display_name")
    return (
        usable.join(people, ["counterparty_id", "organization_id", "project_id"])
        .select(
            "counterparty_id",
            F.col("display_name").alias("counterparty_display_name"),
            "account_id",
            F.col("label").alias("account_label"),
            field(details, "address").alias("address"),
            "created_at",
        )
        .orderBy("counterparty_display_name", F.col("created_at").desc(), "account_id")
        .drop("created_at")
    )

