"""Payment ledger: spending, batches, reconciliation, recurring collections, feeds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import UNITS
from ledgerlens.functions.documents import appended, field, merged
from ledgerlens.functions.text import title_case
from ledgerlens.functions.times import moment, plus_hours
from ledgerlens.operators.exact import running_amounts, sum_amounts, sum_text
from ledgerlens.operators.listing import waiting_since
from ledgerlens.operators.ordering import first_overall, first_per_group
from ledgerlens.operators.skew import HOT_GROUP_ROWS, find_hot, never_null, ordered_prefix

# Statuses, types, limits.
COUNTED_STATUSES = ["pending", "processing", "confirmed", "finalized"]
WALLET_TYPES = ["transfer", "transfer_confidential", "transfer_batch"]
RECIPIENTS_PER_TRANSACTION = 20
STUCK_MINUTES, STALE_MINUTES, RETRY_MINUTES = 5, 15, 60
TIMED_OUT, NOT_FOUND = "Transfer processing timed out", "Transaction not found on chain"
CHANGING_STATUSES = ["activating", "canceling", "resuming"]
DUE_KEY = ["organization_id", "project_id", "subscription_id", "due_at"]
FEED_SIZE = 10

#: Running sums sort one wallet's transfers of so many minutes at once.
SPAN_MINUTES = 10


# --- spending -------------------------------------------------------------------------------------------


def daily_spend(transfers: DataFrame) -> DataFrame:
    """Exact amount per wallet, token, direction and UTC day over transfers that count, for amounts of any length.

    ``spent`` is decimal text, null without a valid amount; ``unsummed`` counts amounts that are no decimal text.
    """
    counted = transfers.filter(F.col("status").isin(*COUNTED_STATUSES)).withColumn("day", F.to_date("created_at"))
    return sum_amounts(counted, ["wallet_id", "token", "direction", "day"], F.col("amount"), "spent", "unsummed")


def with_running_spend(transfers: DataFrame) -> DataFrame:
    """Add ``spent_before``: the exact decimal text of what the wallet sent of the token earlier the same UTC day.

    Transfers of one instant are taken in id order.  ``unsummed_before`` counts the earlier amounts that are no decimal
    text; ``short_before`` and ``limbs_before`` hold the sum in parts (:mod:`ledgerlens.operators.exact`).
    """
    counted = transfers.filter(F.col("status").isin(*COUNTED_STATUSES) & (F.col("direction") == "outbound")).withColumns(
        {"day": F.to_date("created_at"), "_at": F.unix_micros("created_at")}
    )
    # A day is cut into stretches of time that are sorted apart.
    span = f"floor(_at / {SPAN_MINUTES * 60_000_000})"
    running = running_amounts(counted, ["wallet_id", "token", "day"], F.col("amount"), ["_at", "id"], span)
    return running.withColumn("spent_before", sum_text("short_before", "limbs_before")).drop("_at")


# --- batches --------------------------------------------------------------------------------------------


def batch_status(transfers: DataFrame) -> DataFrame:
    """Status of each batch from the statuses of its transfers."""
    status = F.col("status")
    confirmed = F.count_if(status == "confirmed")
    return transfers.groupBy("batch_id").agg(
        F.when(F.count_if(status == "processing") > 0, "processing")
        .when(confirmed == F.count(F.lit(1)), "confirmed")
        .when(confirmed == 0, "failed")
        .otherwise("partially_failed")
        .alias("status")
    )


def batch_totals(recipients: DataFrame, per_transaction: int = RECIPIENTS_PER_TRANSACTION) -> DataFrame:
    """Recipients, exact amount and number of transactions per batch."""
    count = F.count(F.lit(1))
    return recipients.groupBy("batch_id").agg(
        count.alias("recipients"),
        F.sum(F.col("amount").cast(UNITS)).alias("total_amount"),
        F.ceil(count / per_transaction).alias("transactions"),
    )


def batch_chunks(
    recipients: DataFrame,
    per_transaction: int = RECIPIENTS_PER_TRANSACTION,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Add ``chunk``: the transaction, counted from 0, that carries each recipient of a batch."""
    hot = find_hot(recipients, ["batch_id"], hot_rows)
    placed = ordered_prefix(
        recipients, ["batch_id"], "position", {"place": F.lit(1)}, hot, ties=["recipient_id"]
    )
    return placed.withColumn("chunk", F.floor(F.col("place_before") / per_transaction)).drop(
        "place_before", "place_total"
    )


# --- reconciliation -------------------------------------------------------------------------------------


def reconcile(transfers: DataFrame, chain: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Transfers still processing, brought up to date.

    Without a signature they fail after five minutes.  With one, the landed chain status decides
    (``chain``: signature, slot, confirmation_status, err, one row per signature); a signature the chain does
    not know fails after five minutes, and 'processed' is too weak to change anything.
    """
    now = moment(as_of)
    waiting = (F.col("status") == "processing") & F.col("type").isin(*WALLET_TYPES)
    facts = chain.select(
        F.col("signature").alias("_signature"),
        F.col("slot").alias("_slot"),
        F.col("confirmation_status").alias("_seen"),
        F.col("err").alias("_err"),
        F.lit(True).alias("_found"),
    )
    old = F.col("updated_at") < now - F.expr(f"INTERVAL {STUCK_MINUTES} MINUTES")
    stuck = waiting & F.col("signature").isNull() & old
    signed = waiting & F.col("signature").isNotNull()
    lost = signed & F.col("_found").isNull() & old
    broken = signed & F.col("_err").isNotNull()
    settled = signed & F.col("_err").isNull() & F.col("_seen").isin("finalized", "confirmed")
    changed = {
        "status": F.when(stuck | lost | broken, F.lit("failed")).when(settled, F.col("_seen")),
        "error": F.when(stuck, F.lit(TIMED_OUT)).when(lost, F.lit(NOT_FOUND)).when(broken, F.col("_err")),
        "slot": F.when(broken | settled, F.col("_slot")),
        "updated_at": F.when(stuck | lost | broken | settled, now),
    }
    key = never_null(F.col("signature"), F.col("id"))
    return transfers.join(facts, key == F.col("_signature"), "left").select(
        *[F.coalesce(changed[c], F.col(c)).alias(c) if c in changed else F.col(c) for c in transfers.columns]
    )


def unknown_signatures(observed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Signatures seen on chain that no ledger row has."""
    known = ledger.filter(F.col("signature").isNotNull()).select("signature")
    return observed.join(known, "signature", "left_anti")


def rows_of_signatures(ledger: DataFrame, signatures: DataFrame) -> DataFrame:
    return ledger.join(signatures.select("signature").distinct(), "signature", "left_semi")


def merge_feeds(confirmed: DataFrame, observed: DataFrame, pending: DataFrame) -> DataFrame:
    """One row per id: confirmed rows before observed before pending ones."""
    parts = [
        df.withColumn("_precedence", F.lit(i)) for i, df in enumerate([confirmed, observed, pending])
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ties = [F.col("created_at").desc(), F.col("signature"), F.col("amount")]
    return first_per_group(union, ["id"], [F.col("_precedence"), *ties]).drop("_precedence")


def signature_history(entries: DataFrame, k: int | None = None) -> DataFrame:
    """Newest first; of several entries with one signature the one read last counts."""
    once = first_per_group(entries, ["signature"], [F.col("position").desc(), F.col("slot").desc()])
    order = [F.coalesce("block_time", F.lit(0)).desc(), F.col("slot").desc(), F.col("signature")]
    return once.orderBy(*order) if k is None else first_overall(once, order, k)


def distinct_transfers(transfers: DataFrame) -> DataFrame:
    """One row per signature, or per id where there is none; the newest of several."""
    key = F.coalesce(F.nullif(F.trim("signature"), F.lit("")), F.col("id"))
    keyed = transfers.withColumn("_key", key).filter(F.coalesce(F.col("_key"), F.lit("")) != "")
    return first_per_group(keyed, ["_key"], [F.col("created_at").desc(), F.col("id")]).drop("_key")


# --- activity -------------------------------------------------------------------------------------------

DASH = "—"


def activity(payments: DataFrame, issuance: DataFrame, k: int = FEED_SIZE) -> DataFrame:
    """Newest payments and issuance transactions in one shape.

    Each side is cut to its ``k`` newest rows before anything is parsed.
    """
    newest = [F.col("created_at").desc(), F.col("id")]
    payments = first_overall(payments.filter(F.col("created_at").isNotNull()), newest, k)
    issuance = first_overall(issuance.filter(F.col("created_at").isNotNull()), newest, k)
    direction = F.col("direction")
    address = F.when(direction == "outbound", F.col("destination_address")).when(
        direction == "inbound", F.col("source_address")
    ).otherwise(F.coalesce("destination_address", "source_address"))
    kind = F.when(direction == "outbound", "Send").when(direction == "inbound", "Receive").otherwise(
        title_case(F.coalesce("type", F.lit("transfer")))
    )
    sent = payments.select(
        F.concat(F.lit("payment-"), "id").alias("id"),
        "created_at",
        kind.alias("type"),
        F.coalesce("token", F.lit(DASH)).alias("token"),
        F.coalesce("amount", F.lit(DASH)).alias("amount"),
        F.coalesce(address, F.lit(DASH)).alias("address"),
        F.lit("payments").alias("source_kind"),
    )
    params = F.col("operation_params")
    issued = issuance.select(
        F.concat(F.lit("issuance-"), "id").alias("id"),
        "created_at",
        title_case(F.col("type")).alias("type"),
        F.coalesce(
            F.nullif("token_symbol", F.lit("")), F.nullif("token_name", F.lit("")), F.lit(DASH)
        ).alias("token"),
        F.coalesce(field(params, "amount"), F.lit(DASH)).alias("amount"),
        F.coalesce(
            field(params, "destination"),
            field(params, "source"),
            F.nullif("signature", F.lit("")),
            F.lit(DASH),
        ).alias("address"),
        F.lit("issuance").alias("source_kind"),
    )
    return first_overall(sent.unionByName(issued), newest, k)


# --- recurring collections ------------------------------------------------------------------------------


def recoverable(payments: DataFrame, attempts: DataFrame, stale_before: Column) -> DataFrame:
    """Active payments whose due attempt is confirmed, or processing for too long; best attempt each."""
    open_attempts = attempts.filter(
        (F.col("status") == "confirmed")
        | ((F.col("status") == "processing") & (F.col("updated_at") <= stale_before))
    ).select(
        *DUE_KEY,
        F.col("status").alias("attempt_status"),
        F.col("updated_at").alias("attempt_updated_at"),
    )
    order = [
        F.when(F.col("attempt_status") == "confirmed", 0).otherwise(1),
        F.col("attempt_updated_at"),
    ]
    # One attempt per due date is enough, and it is chosen before the join.
    best = first_per_group(open_attempts, DUE_KEY, order)
    return _due_payments(payments).join(best, DUE_KEY).drop("due_at")


def _due_payments(payments: DataFrame) -> DataFrame:
    return payments.filter(
        (F.col("status") == "active") & F.col("next_collection_due_at").isNotNull()
    ).withColumn("due_at", F.col("next_collection_due_at"))


def due_payments(
    payments: DataFrame, attempts: DataFrame, due_before: Column, retry_before: Column
) -> DataFrame:
    """Active payments that are due and have neither an open attempt nor a recent failure."""
    blocking = attempts.filter(
        F.col("status").isin("pending", "processing", "confirmed")
        | ((F.col("status") == "failed") & (F.col("updated_at") > retry_before))
    ).select(*DUE_KEY)
    due = _due_payments(payments).filter(F.col("due_at") <= due_before)
    return due.join(blocking, DUE_KEY, "left_anti").drop("due_at")


def collection_work(payments: DataFrame, attempts: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Everything a collection run has to do, tagged, with the due date that follows."""
    now = moment(as_of)
    stale = now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")
    retry = now - F.expr(f"INTERVAL {RETRY_MINUTES} MINUTES")

    def tagged(df: DataFrame, work: str) -> DataFrame:
        return df.select(F.lit(work).alias("work"), "id", "next_collection_due_at", "period_hours")

    changing = payments.filter(F.col("status").isin(*CHANGING_STATUSES) & (F.col("updated_at") <= stale))
    return (
        tagged(changing, "recover_lifecycle")
        .unionByName(tagged(recoverable(payments, attempts, stale), "recover_collection"))
        .unionByName(tagged(due_payments(payments, attempts, now, retry), "collect"))
        .withColumn(
            "following_due_at", plus_hours(F.col("next_collection_due_at"), F.col("period_hours"))
        )
    )


SKIPPED_ERROR = "another attempt for the same due date is kept"


def skip_duplicate_attempts(attempts: DataFrame, as_of: datetime | str | Column, by: str) -> DataFrame:
    """Mark all but the best open attempt per due date as skipped, noting the old status in the metadata."""
    status = F.col("status")
    is_open = status.isin("pending", "processing", "confirmed")
    order = [
        F.when(status == "confirmed", 0).when(status == "processing", 1).otherwise(2),
        F.col("updated_at").desc(),
        F.col("created_at").desc(),
        F.col("id").desc(),
    ]
    best = first_per_group(attempts.filter(is_open), DUE_KEY, order)
    kept = best.select("id", F.lit(True).alias("_kept"))
    extra = F.to_json(F.struct(F.lit(by).alias("deduplicatedBy"), status.alias("previousStatus")))
    skip = is_open & F.col("_kept").isNull()
    changed = {
        "status": F.lit("skipped"),
        "error": F.coalesce("error", F.lit(SKIPPED_ERROR)),
        # Metadata that is no JSON object cannot take the note and stays as it is.
        "metadata": F.coalesce(merged(F.col("metadata"), extra), F.col("metadata")),
        "updated_at": moment(as_of),
    }
    return attempts.join(kept, "id", "left").select(
        *[
            F.when(skip, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in attempts.columns
        ]
    )


def keep_oldest(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the oldest."""
    return first_per_group(requests, keys, [F.col("created_at"), F.col("id")])


def stale_lifecycles(payments: DataFrame, cutoff: datetime | str, limit: int | None = None) -> DataFrame:
    return waiting_since(payments, CHANGING_STATUSES, cutoff, limit)


# --- payment requests -----------------------------------------------------------------------------------


def mark_requests(requests: DataFrame, marks: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Move waiting requests to a new status and append it to their lifecycle.

    ``marks`` has id, status, fulfilled_by_transfer_id, canceled_by; only requests awaiting payment change.
    """
    now = moment(as_of)
    fresh = marks.select(
        "id",
        F.col("status").alias("_status"),
        F.col("fulfilled_by_transfer_id").alias("_transfer"),
        F.col("canceled_by").alias("_by"),
    )
    hit = F.col("_status").isNotNull() & (F.col("status") == "awaiting_payment")
    entry = F.struct(F.col("_status").alias("status"), now.alias("at"))
    changed = {
        "status": F.col("_status"),
        "fulfilled_by_transfer_id": F.coalesce("_transfer", "fulfilled_by_transfer_id"),
        "canceled_by": F.col("_by"),
        "lifecycle": appended(F.col("lifecycle"), entry),
        "updated_at": now,
    }
    return requests.join(fresh, "id", "left").select(
        *[
            F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in requests.columns
        ]
    )
