"""Queries over the payment ledger and wallet balances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.risk import risk_tone
from ledgerlens.functions.times import moment, utc_day
from ledgerlens.operators import balances, listing, payments
from ledgerlens.operators.supply import newest
from ledgerlens.plans.views import over
from ledgerlens.sources import adapters

AS_OF = "2001-08-01 00:03:00"


def _transfers(spark, folder):
    return adapters.payment_transfers(spark, folder)


def f8_list_transfers(spark, folder):
    rows, _ = listing.list_transfers(
        _transfers(spark, folder),
        {
            "organization_id": "org_1",
            "project_id": ["prj_1", "prj_4"],
            "wallet_id": None,
            "status": ["processing", "confirmed"],
            "type": ["transfer"],
            "direction": "outbound",
            "token": [],
        },
        created_from="1996-01-01",
        created_to="2000-12-31",
    )
    return rows.select("id", "wallet_id", "status", F.to_date("created_at").alias("created"))


def f8_list_total(spark, folder):
    return listing.list_transfers(_transfers(spark, folder), {"organization_id": "org_1"})[1]


def f9_by_status(spark, folder):
    rows = listing.transfers_by_status(
        _transfers(spark, folder), ["processing"], ["transfer"], has_signature=False, updated_before="2000-01-01"
    )
    return rows.select("id", "status")


def f10_null_safe(spark, folder):
    """Transfers without a signature, by an equality that treats null as a value."""
    rows = _transfers(spark, folder).filter(listing.same_or_both_null("signature", None))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("transfers"))


def f12_audit_log(spark, folder):
    """Events as an audit log: one action and resource in a date range."""
    log = adapters.table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("resource_id"),
        F.col("ts").alias("created_at"),
    )
    rows, _ = listing.listing(
        log,
        {"action": "purchase"},
        [F.col("created_at").desc(), F.col("id").desc()],
        [listing.between("created_at", "2024-01-05", "2024-01-20")],
        limit=100,
        offset=20,
    )
    return rows.select("id", "action", "resource_id")


def f13_listing(spark, folder):
    """One page of a listing that hides a status unless asked for."""
    rows, _ = listing.listing(
        _transfers(spark, folder),
        {"organization_id": "org_2"},
        [F.col("created_at").desc(), F.col("id")],
        [F.col("status") != "failed"],
        limit=40,
        offset=40,
    )
    return rows.select("id", "status")


def f14_json_field(spark, folder):
    rows = adapters.table(spark, folder, "events")
    hits = rows.filter(listing.json_field_in("props", ["k"], ["3", "7", "42"]))
    return hits.select("event_id", F.get_json_object("props", "$.k").alias("k"))


def f16_waiting(spark, folder):
    rows = listing.waiting_since(
        adapters.recurring_payments(spark, folder), payments.CHANGING_STATUSES, "1999-01-01 00:00:00"
    )
    return rows.select("id", "status")


def f17_category(spark, folder):
    transfers = _transfers(spark, folder)
    tagged = transfers.withColumn("category", F.when(listing.in_category("ramp"), "ramp").otherwise("wallet"))
    return tagged.groupBy("category").agg(F.count(F.lit(1)).alias("transfers"))


def a29_daily_spend(spark, folder):
    rows = payments.daily_spend(_transfers(spark, folder)).drop("unsummed")
    return rows.withColumn("spent", F.col("spent").cast("double"))


def _long_amounts(spark, folder):
    """Transfers of which every fifth amount has up to 47 whole and 30 fraction digits, and every fifth is malformed."""
    key = F.substring_index("id", "_", -1).cast("bigint")
    long = F.concat(key.cast("string"), F.lit("0" * 40 + "." + "0" * 29 + "1"))
    amount = F.when(key % 5 == 0, long).when(key % 5 == 1, "12,5").otherwise(F.col("amount").cast("string"))
    return _transfers(spark, folder).withColumn("amount", amount)


def a29_exact_spend(spark, folder):
    """Daily spend of amounts beyond any number type."""
    return payments.daily_spend(_long_amounts(spark, folder))


def a29_exact_running(spark, folder):
    """Running spend of amounts beyond any number type."""
    rows = payments.with_running_spend(_long_amounts(spark, folder))
    return rows.select("id", "spent_before", "unsummed_before")


def a29_running_spend(spark, folder):
    rows = payments.with_running_spend(_transfers(spark, folder))
    return rows.select("id", F.col("spent_before").cast("double").alias("spent_before"))


def a30_batch_status(spark, folder):
    return payments.batch_status(adapters.batch_transfers(spark, folder))


def a31_batch_totals(spark, folder):
    rows = payments.batch_totals(adapters.batch_recipients(spark, folder))
    return rows.withColumn("total_amount", F.col("total_amount").cast("bigint"))


def a31_batch_chunks(spark, folder):
    rows = payments.batch_chunks(adapters.batch_recipients(spark, folder))
    return rows.groupBy("batch_id", "chunk").agg(
        F.count(F.lit(1)).alias("recipients"), F.sum("amount").cast("bigint").alias("amount")
    )


def a36_volume_today(spark, folder):
    transfers = _transfers(spark, folder)
    rows = balances.volume_since(transfers, utc_day(newest(transfers, "created_at")))
    return rows.select(F.col("volume").cast("double").alias("volume"))


def a36_exact_volume(spark, folder):
    """Volume of the last days, of amounts beyond any number type."""
    transfers = _long_amounts(spark, folder)
    return balances.volume_since(transfers, F.lit("1998-01-01").cast("timestamp"))


def m11_reconcile(spark, folder):
    rows = payments.reconcile(_transfers(spark, folder), adapters.chain_status(spark, folder), AS_OF)
    return rows.select("id", "status", "error", "slot")


def j22_u4_unknown_signatures(spark, folder):
    chain = adapters.chain_status(spark, folder)
    rows = payments.unknown_signatures(chain, _transfers(spark, folder).filter("status <> 'processing'"))
    return rows.select("signature")


def j27_rows_of_signatures(spark, folder):
    wanted = adapters.chain_status(spark, folder).filter("confirmation_status = 'finalized'")
    return payments.rows_of_signatures(_transfers(spark, folder), wanted).select("id", "signature")


def u3_merge_feeds(spark, folder):
    """Confirmed, observed and pending rows with overlapping ids."""
    rows = _transfers(spark, folder).select("id", "created_at", "signature", "amount", "status", "wallet_id")
    number = F.substring("id", 5, 20).cast("bigint")

    def feed(divisor: int, name: str):
        return rows.filter(number % divisor == 0).withColumn("feed", F.lit(name))

    merged = payments.merge_feeds(feed(3, "confirmed"), feed(2, "observed"), feed(5, "pending"))
    return merged.select("id", "feed", "status")


def w12_signature_history(spark, folder):
    """Line items as history entries of their order's signature."""
    lines = adapters.table(spark, folder, "lineitem")
    entries = lines.select(
        F.concat(F.lit("sig_"), F.col("l_orderkey").cast("string")).alias("signature"),
        F.when(F.col("l_linenumber") % 4 != 0, F.unix_seconds("l_shipdate")).alias("block_time"),
        F.col("l_partkey").alias("slot"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("position"),
    )
    return payments.signature_history(entries, 500).select("signature", "slot")


def w14_distinct_transfers(spark, folder):
    """Transfers whose signatures repeat; those without one count by id."""
    number = F.substring("id", 5, 20).cast("bigint")
    signature = F.when(number % 7 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("s"), (number % 100).cast("string"))
    )
    rows = payments.distinct_transfers(_transfers(spark, folder).withColumn("signature", signature))
    return rows.select("id", F.trim("signature").alias("signature"))


def u6_activity(spark, folder):
    issuance = adapters.issuance_transactions(spark, folder).join(
        adapters.issued_tokens(spark, folder).select(
            "token_id", F.col("symbol").alias("token_symbol"), F.col("name").alias("token_name")
        ),
        "token_id",
    )
    rows = payments.activity(_transfers(spark, folder), issuance)
    return rows.selectExpr("id", "type", "token", "amount", "address", "source_kind", "unix_micros(created_at) as created_at")


def _recurring(spark, folder):
    return adapters.recurring_payments(spark, folder), adapters.collection_attempts(spark, folder)


def j14_w5_recoverable(spark, folder):
    rows = payments.recoverable(*_recurring(spark, folder), moment("2000-01-01 00:00:00"))
    return rows.selectExpr("id", "attempt_status", "unix_micros(attempt_updated_at) as attempt_updated_at")


def j13_due(spark, folder):
    rows = payments.due_payments(
        *_recurring(spark, folder), moment("2001-01-01 00:00:00"), moment("1999-01-01 00:00:00")
    )
    return rows.select("id")


def m12_collection_work(spark, folder):
    rows = payments.collection_work(*_recurring(spark, folder), AS_OF)
    return rows.selectExpr("work", "id", "unix_micros(following_due_at) as following_due_at")


def w6_skip_duplicates(spark, folder):
    rows = payments.skip_duplicate_attempts(
        adapters.collection_attempts(spark, folder), AS_OF, "active_due_uniqueness"
    )
    return rows.select(
        "id",
        "status",
        F.get_json_object("metadata", "$.previousStatus").alias("previous_status"),
        F.get_json_object("metadata", "$.line").alias("line"),
    )


def w7_keep_oldest(spark, folder):
    """Attempts as approval requests: the oldest per order."""
    rows = payments.keep_oldest(adapters.collection_attempts(spark, folder), ["subscription_id"])
    return rows.select("subscription_id", "id")


def m15_mark_requests(spark, folder):
    """Processing transfers as requests that await payment; every fourth transfer is marked."""
    transfers = _transfers(spark, folder)
    waiting = F.when(F.col("status") == "processing", "awaiting_payment").otherwise("fulfilled")
    start = F.array(F.struct(F.lit("awaiting_payment").alias("status"), F.col("created_at").alias("at")))
    requests = transfers.select(
        "id",
        waiting.alias("status"),
        F.lit(None).cast("string").alias("fulfilled_by_transfer_id"),
        F.lit(None).cast("string").alias("canceled_by"),
        start.alias("lifecycle"),
        "updated_at",
    )
    number = F.substring("id", 5, 20).cast("bigint")
    marks = transfers.filter(number % 4 == 0).select(
        "id",
        F.when(number % 8 == 0, "fulfilled").otherwise("canceled").alias("status"),
        F.when(number % 8 == 0, F.col("signature")).alias("fulfilled_by_transfer_id"),
        F.when(number % 8 != 0, F.lit("user_1")).alias("canceled_by"),
    )
    rows = payments.mark_requests(requests, marks, AS_OF)
    steps = F.array_join(F.transform("lifecycle", lambda e: e["status"]), ">")
    return rows.select("id", "status", "fulfilled_by_transfer_id", "canceled_by", steps.alias("lifecycle"))


# --- balances -------------------------------------------------------------------------------------------


def _named(spark, folder):
    """Symbols for mints of two kinds; the others stay blank."""
    held = adapters.balances(spark, folder)
    symbols = held.select("mint").distinct().filter("mint LIKE '%1' OR mint LIKE '%2'").select(
        "mint", F.upper("mint").alias("symbol")
    )
    return balances.fill_symbols(held, symbols)


def _priced(spark, folder):
    return balances.price_balances(adapters.balances(spark, folder), adapters.prices(spark, folder))


def j25_fill_symbols(spark, folder):
    return _named(spark, folder).select("wallet_id", "mint", "token")


def j24_price_balances(spark, folder):
    return _priced(spark, folder).select("wallet_id", "mint", "usd_price", "usd_value")


def a22_total_per_mint(spark, folder):
    rows = balances.total_per_mint(adapters.balances(spark, folder))
    return rows.select("mint", "amount", "ui_amount")


def a22_exact_total(spark, folder):
    """Totals per mint where every fifth balance has more than 40 digits."""
    held = adapters.balances(spark, folder)
    key = F.substring_index("wallet_id", "-", -1).cast("bigint")
    amount = F.when(key % 5 == 0, F.concat("amount", F.lit("0" * 40))).otherwise(F.col("amount"))
    return balances.total_per_mint(held.withColumn("amount", amount)).select("mint", "amount", "ui_amount")


def a23_valid_total_per_mint(spark, folder):
    rows = balances.valid_total_per_mint(_priced(spark, folder))
    return rows.select("mint", "amount", "ui_amount", F.round("usd_value", 2).alias("usd_value"))


def x2_malformed_amounts(spark, folder):
    return balances.malformed_amounts(adapters.balances(spark, folder)).select("wallet_id", "reason")


def a24_total_value(spark, folder):
    return balances.total_value(_priced(spark, folder)).select(F.round("total_usd", 2).alias("total_usd"))


def a23_listed(spark, folder):
    rows = balances.listed_balances(balances.valid_total_per_mint(_priced(spark, folder)))
    return rows.select("mint", "token")


def w10_top_balances(spark, folder):
    rows = balances.top_balances(balances.valid_total_per_mint(_priced(spark, folder)), 8)
    return rows.select("mint", "token", F.round("usd_value", 2).alias("usd_value"))


def x16_risk_tone(spark, folder):
    rows = adapters.screening_results(spark, folder)
    tone = risk_tone(F.col("status"), F.col("provider"), F.col("risk_score"), F.col("risk_level"))
    return rows.select("screening_id", tone.alias("tone"))


_P = "payment_transfers"
_VALID = "priced_balances"
_TOTALS = """
WITH totals AS (
  SELECT mint, arg_min(token, (wallet_id, token)) AS token, sum(units) AS units,
         round(sum(round(ui_amount * usd_price, 6)), 6) AS usd_value
  FROM priced_balances WHERE units IS NOT NULL GROUP BY 1)
"""
_PLAIN = """CAST({0} // 100 AS VARCHAR) || CASE WHEN {0} % 100 = 0 THEN ''
            ELSE '.' || rtrim(lpad(CAST({0} % 100 AS VARCHAR), 2, '0'), '0') END"""
_COUNTED = "status IN ('pending', 'processing', 'confirmed', 'finalized')"
_EARLIER = """OVER (PARTITION BY wallet_id, token, CAST(created_at AS DATE)
                 ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
#: Sums of the long amounts' leading numbers, of how many there are, and of the plain amounts in cents.
_PARTS = """CAST(coalesce(sum(o_orderkey) FILTER (WHERE o_orderkey % 5 = 0) {over}, 0) AS BIGINT) AS front,
                 count(*) FILTER (WHERE o_orderkey % 5 = 0) {over} AS n_long,
                 CAST(coalesce(sum(CAST(amount * 100 AS BIGINT)) FILTER (WHERE o_orderkey % 5 > 1) {over}, 0) AS BIGINT) AS cents,
                 count(*) FILTER (WHERE o_orderkey % 5 <> 1) {over} AS valid"""
_JOINED = """rtrim(rtrim(CASE WHEN front > 0 THEN front || lpad(CAST(cents // 100 AS VARCHAR), 40, '0')
                              ELSE CAST(cents // 100 AS VARCHAR) END
                         || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || lpad(CAST(n_long AS VARCHAR), 28, '0'), '0'), '.')"""
_OPEN = "status IN ('pending', 'processing', 'confirmed')"
_RECOVERABLE = """
  SELECT * FROM (
    SELECT r.id, r.next_collection_due_at, r.period_hours, a.status AS attempt_status, a.updated_at AS attempt_updated_at,
           row_number() OVER (PARTITION BY r.id ORDER BY CASE WHEN a.status = 'confirmed' THEN 0 ELSE 1 END,
                              a.updated_at) AS rn
    FROM recurring_payments r JOIN collection_attempts a
      ON a.subscription_id = r.subscription_id AND a.due_at = r.next_collection_due_at
    WHERE r.status = 'active' AND (a.status = 'confirmed' OR (a.status = 'processing' AND a.updated_at <= {0})))
  WHERE rn = 1"""
_DUE = """
  SELECT r.* FROM recurring_payments r WHERE r.status = 'active' AND r.next_collection_due_at <= {0}
    AND NOT EXISTS (SELECT 1 FROM collection_attempts a WHERE a.subscription_id = r.subscription_id
                    AND a.due_at = r.next_collection_due_at AND a.status IN ('pending', 'processing', 'confirmed'))
    AND NOT EXISTS (SELECT 1 FROM collection_attempts a WHERE a.subscription_id = r.subscription_id
                    AND a.due_at = r.next_collection_due_at AND a.status = 'failed' AND a.updated_at > {1})"""

QUERIES = {
    "f8_list_transfers": (f8_list_transfers, over(_P, """
        SELECT id, wallet_id, status, CAST(created_at AS DATE) AS created FROM payment_transfers
        WHERE organization_id = 'org_1' AND project_id IN ('prj_1', 'prj_4') AND status IN ('processing', 'confirmed')
          AND type = 'transfer' AND direction = 'outbound'
          AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '2000-12-31'""")),
    "f8_list_total": (f8_list_total, over(_P, """
        SELECT count(*) AS total FROM payment_transfers WHERE organization_id = 'org_1'""")),
    "f9_by_status": (f9_by_status, over(_P, """
        SELECT id, status FROM payment_transfers WHERE status = 'processing' AND type = 'transfer'
          AND signature IS NULL AND updated_at < TIMESTAMP '2000-01-01'""")),
    "f10_null_safe": (f10_null_safe, over(_P, """
        SELECT status, count(*) AS transfers FROM payment_transfers WHERE signature IS NOT DISTINCT FROM NULL
        GROUP BY 1""")),
    "f12_audit_log": (f12_audit_log, """
        SELECT event_id AS id, event_type AS action, 'user' || CAST(user_id AS VARCHAR) AS resource_id FROM events
        WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'
        ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 20"""),
    "f13_listing": (f13_listing, over(_P, """
        SELECT id, status FROM payment_transfers WHERE organization_id = 'org_2' AND status <> 'failed'
        ORDER BY created_at DESC, id LIMIT 40 OFFSET 40""")),
    "f14_x10_json_field": (f14_json_field, """
        SELECT event_id, json_extract_string(props, '$.k') AS k FROM events
        WHERE json_extract_string(props, '$.k') IN ('3', '7', '42')"""),
    "f16_waiting": (f16_waiting, over("recurring_payments", """
        SELECT id, status FROM recurring_payments WHERE status IN ('activating', 'canceling', 'resuming')
          AND updated_at <= TIMESTAMP '1999-01-01'""")),
    "f17_category": (f17_category, over(_P, """
        SELECT CASE WHEN type IN ('onramp', 'offramp') THEN 'ramp' ELSE 'wallet' END AS category, count(*) AS transfers
        FROM payment_transfers GROUP BY 1""")),
    "a29_exact_spend": (a29_exact_spend, over(_P, f"""
        WITH sums AS (
          SELECT wallet_id, token, direction, CAST(created_at AS DATE) AS day, {_PARTS.format(over="")},
                 count(*) FILTER (WHERE o_orderkey % 5 = 1) AS unsummed
          FROM payment_transfers WHERE {_COUNTED} GROUP BY 1, 2, 3, 4)
        SELECT wallet_id, token, direction, day, CASE WHEN valid > 0 THEN {_JOINED} END AS spent, unsummed FROM sums""")),
    "a29_exact_running": (a29_exact_running, over(_P, f"""
        WITH sums AS (
          SELECT id, {_PARTS.format(over=_EARLIER)}, count(*) FILTER (WHERE o_orderkey % 5 = 1) {_EARLIER} AS unsummed_before
          FROM payment_transfers WHERE {_COUNTED} AND direction = 'outbound')
        SELECT id, {_JOINED} AS spent_before, unsummed_before FROM sums""")),
    "a36_exact_volume": (a36_exact_volume, over(_P, f"""
        WITH sums AS (SELECT {_PARTS.format(over="")}, count(*) FILTER (WHERE o_orderkey % 5 = 1) AS unsummed
                      FROM payment_transfers WHERE created_at >= TIMESTAMP '1998-01-01')
        SELECT CASE WHEN valid > 0 THEN {_JOINED} END AS volume, unsummed FROM sums""")),
    "a29_daily_spend": (a29_daily_spend, over(_P, """
        SELECT wallet_id, token, direction, CAST(created_at AS DATE) AS day, CAST(sum(amount) AS DOUBLE) AS spent
        FROM payment_transfers WHERE status IN ('pending', 'processing', 'confirmed', 'finalized')
        GROUP BY 1, 2, 3, 4""")),
    "a29_running_spend": (a29_running_spend, over(_P, """
        SELECT id, CAST(coalesce(sum(amount) OVER (PARTITION BY wallet_id, token, CAST(created_at AS DATE)
                 ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS spent_before
        FROM payment_transfers
        WHERE status IN ('pending', 'processing', 'confirmed', 'finalized') AND direction = 'outbound'""")),
    "a30_batch_status": (a30_batch_status, over("batch_transfers", """
        SELECT batch_id, CASE WHEN count(*) FILTER (WHERE status = 'processing') > 0 THEN 'processing'
               WHEN count(*) FILTER (WHERE status = 'confirmed') = count(*) THEN 'confirmed'
               WHEN count(*) FILTER (WHERE status = 'confirmed') = 0 THEN 'failed' ELSE 'partially_failed' END AS status
        FROM batch_transfers GROUP BY 1""")),
    "a31_batch_totals": (a31_batch_totals, over("batch_recipients", """
        SELECT batch_id, count(*) AS recipients, CAST(sum(amount) AS BIGINT) AS total_amount,
               CAST(ceil(count(*) / 20.0) AS BIGINT) AS transactions FROM batch_recipients GROUP BY 1""")),
    "a31_batch_chunks": (a31_batch_chunks, over("batch_recipients", """
        SELECT batch_id, chunk, count(*) AS recipients, CAST(sum(amount) AS BIGINT) AS amount FROM (
          SELECT *, (row_number() OVER (PARTITION BY batch_id ORDER BY position, recipient_id) - 1) // 20 AS chunk
          FROM batch_recipients) GROUP BY 1, 2""")),
    "a36_volume_today": (a36_volume_today, over(_P, """
        SELECT CAST(sum(amount) AS DOUBLE) AS volume FROM payment_transfers
        WHERE created_at >= (SELECT date_trunc('day', max(created_at)) FROM payment_transfers)""")),
    "m11_reconcile": (m11_reconcile, over("payment_transfers chain_status", """
        WITH j AS (
          SELECT t.*, c.slot AS seen_slot, c.confirmation_status AS seen, c.err, c.signature IS NOT NULL AS found,
                 t.status = 'processing' AND t.type = 'transfer' AS waiting,
                 t.updated_at < TIMESTAMP '2001-08-01 00:03:00' - INTERVAL 5 MINUTES AS old
          FROM payment_transfers t LEFT JOIN chain_status c ON t.signature = c.signature)
        SELECT id,
               CASE WHEN NOT waiting THEN status WHEN signature IS NULL THEN CASE WHEN old THEN 'failed' ELSE status END
                    WHEN NOT found THEN CASE WHEN old THEN 'failed' ELSE status END WHEN err IS NOT NULL THEN 'failed'
                    WHEN seen IN ('finalized', 'confirmed') THEN seen ELSE status END AS status,
               CASE WHEN NOT waiting THEN NULL WHEN signature IS NULL THEN CASE WHEN old THEN 'Transfer processing timed out' END
                    WHEN NOT found THEN CASE WHEN old THEN 'Transaction not found on chain' END ELSE err END AS error,
               CASE WHEN waiting AND signature IS NOT NULL AND found
                         AND (err IS NOT NULL OR seen IN ('finalized', 'confirmed')) THEN seen_slot END AS slot FROM j""")),
    "j22_u4_unknown_signatures": (j22_u4_unknown_signatures, over("payment_transfers chain_status", """
        SELECT signature FROM chain_status EXCEPT SELECT signature FROM payment_transfers WHERE status <> 'processing'""")),
    "j27_rows_of_signatures": (j27_rows_of_signatures, over("payment_transfers chain_status", """
        SELECT id, signature FROM payment_transfers
        WHERE signature IN (SELECT signature FROM chain_status WHERE confirmation_status = 'finalized')""")),
    "u3_merge_feeds": (u3_merge_feeds, over(_P, """
        SELECT id, CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed' WHEN o_orderkey % 2 = 0 THEN 'observed'
                   ELSE 'pending' END AS feed, status FROM payment_transfers
        WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 OR o_orderkey % 5 = 0""")),
    "w12_signature_history": (w12_signature_history, """
        WITH e AS (
          SELECT 'sig_' || CAST(l_orderkey AS VARCHAR) AS signature, l_partkey AS slot,
                 CASE WHEN l_linenumber % 4 <> 0 THEN epoch(l_shipdate) END AS block_time,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(round(l_extendedprice * 100) AS BIGINT) DESC,
                                    l_partkey DESC) AS rn FROM lineitem)
        SELECT signature, slot FROM e WHERE rn = 1 ORDER BY coalesce(block_time, 0) DESC, slot DESC, signature LIMIT 500"""),
    "w14_distinct_transfers": (w14_distinct_transfers, over(_P, """
        SELECT id, signature FROM (
          SELECT id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 's' || CAST(o_orderkey % 100 AS VARCHAR) END AS signature,
                 row_number() OVER (PARTITION BY CASE WHEN o_orderkey % 7 = 0 THEN id
                   ELSE 's' || CAST(o_orderkey % 100 AS VARCHAR) END ORDER BY created_at DESC, id) AS rn
          FROM payment_transfers) WHERE rn = 1""")),
    "u6_activity": (u6_activity, over("payment_transfers issuance_transactions issued_tokens", """
        WITH feed AS (
          SELECT 'payment-' || id AS id, CASE WHEN direction = 'outbound' THEN 'Send' ELSE 'Receive' END AS type, token,
                 CAST(amount AS VARCHAR) AS amount,
                 CASE WHEN direction = 'outbound' THEN destination_address ELSE source_address END AS address,
                 'payments' AS source_kind, epoch_us(created_at) AS created_at FROM payment_transfers
          UNION ALL
          SELECT 'issuance-' || x.id, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(x.type, '_')], ' '),
                 t.symbol, x.amount, x.owner_a, 'issuance', epoch_us(x.created_at)
          FROM issuance_transactions x JOIN issued_tokens t ON x.token_id = t.token_id)
        SELECT * FROM feed ORDER BY created_at DESC, id LIMIT 10""")),
    "j14_w5_recoverable": (j14_w5_recoverable, over("recurring_payments collection_attempts", f"""
        SELECT id, attempt_status, epoch_us(attempt_updated_at) AS attempt_updated_at
        FROM ({_RECOVERABLE.format("TIMESTAMP '2000-01-01'")})""")),
    "j13_due": (j13_due, over("recurring_payments collection_attempts", f"""
        SELECT id FROM ({_DUE.format("TIMESTAMP '2001-01-01'", "TIMESTAMP '1999-01-01'")})""")),
    "m12_collection_work": (m12_collection_work, over("recurring_payments collection_attempts", f"""
        WITH work AS (
          SELECT 'recover_lifecycle' AS work, id, next_collection_due_at, period_hours FROM recurring_payments
          WHERE status IN ('activating', 'canceling', 'resuming') AND updated_at <= TIMESTAMP '2001-07-31 23:48:00'
          UNION ALL
          SELECT 'recover_collection', id, next_collection_due_at, period_hours
          FROM ({_RECOVERABLE.format("TIMESTAMP '2001-07-31 23:48:00'")})
          UNION ALL
          SELECT 'collect', id, next_collection_due_at, period_hours
          FROM ({_DUE.format("TIMESTAMP '2001-08-01 00:03:00'", "TIMESTAMP '2001-07-31 23:03:00'")}))
        SELECT work, id, epoch_us(next_collection_due_at + to_hours(period_hours)) AS following_due_at FROM work""")),
    "w6_skip_duplicates": (w6_skip_duplicates, over("collection_attempts", f"""
        WITH r AS (
          SELECT id, row_number() OVER (PARTITION BY subscription_id, due_at ORDER BY CASE status WHEN 'confirmed' THEN 0
                   WHEN 'processing' THEN 1 ELSE 2 END, updated_at DESC, created_at DESC, id DESC) AS rn
          FROM collection_attempts WHERE {_OPEN})
        SELECT a.id, CASE WHEN r.rn > 1 THEN 'skipped' ELSE a.status END AS status,
               CASE WHEN r.rn > 1 THEN a.status END AS previous_status, CAST(a.l_linenumber AS VARCHAR) AS line
        FROM collection_attempts a LEFT JOIN r ON a.id = r.id""")),
    "w7_keep_oldest": (w7_keep_oldest, over("collection_attempts", """
        SELECT subscription_id, id FROM (
          SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY created_at, id) AS rn
          FROM collection_attempts) WHERE rn = 1""")),
    "m15_mark_requests": (m15_mark_requests, over(_P, """
        WITH r AS (SELECT *, status = 'processing' AND o_orderkey % 4 = 0 AS hit,
                   CASE WHEN o_orderkey % 8 = 0 THEN 'fulfilled' ELSE 'canceled' END AS mark FROM payment_transfers)
        SELECT id, CASE WHEN hit THEN mark WHEN status = 'processing' THEN 'awaiting_payment' ELSE 'fulfilled' END AS status,
               CASE WHEN hit AND o_orderkey % 8 = 0 THEN signature END AS fulfilled_by_transfer_id,
               CASE WHEN hit AND o_orderkey % 8 <> 0 THEN 'user_1' END AS canceled_by,
               'awaiting_payment' || CASE WHEN hit THEN '>' || mark ELSE '' END AS lifecycle FROM r""")),
    "j25_fill_symbols": (j25_fill_symbols, over("balances", """
        SELECT wallet_id, mint, CASE WHEN (token = '' OR token = mint) AND right(mint, 1) IN ('1', '2') THEN upper(mint)
               ELSE token END AS token FROM balances""")),
    "j24_price_balances": (j24_price_balances, over(_VALID, """
        SELECT wallet_id, mint, usd_price, round(ui_amount * usd_price, 6) AS usd_value FROM priced_balances""")),
    "a22_total_per_mint": (a22_total_per_mint, over("balances", """
        WITH t AS (SELECT mint, CAST(sum(coalesce(units, 0)) AS BIGINT) AS u FROM balances GROUP BY 1)
        SELECT mint, CAST(u AS VARCHAR) AS amount, """ + _PLAIN.format("u") + " AS ui_amount FROM t")),
    "a22_exact_total": (a22_exact_total, over("balances", """
        WITH t AS (
          SELECT mint, CAST(coalesce(sum(units) FILTER (WHERE o_orderkey % 5 = 0), 0) AS BIGINT) AS front,
                 CAST(coalesce(sum(units) FILTER (WHERE o_orderkey % 5 <> 0), 0) AS BIGINT) AS u FROM balances GROUP BY 1),
        d AS (SELECT mint, CASE WHEN front > 0 THEN front || lpad(CAST(u AS VARCHAR), 40, '0') ELSE CAST(u AS VARCHAR) END AS amount FROM t)
        SELECT mint, amount, rtrim(rtrim(CASE WHEN len(amount) > 2 THEN amount[1:len(amount) - 2] ELSE '0' END || '.' || right(CASE WHEN len(amount) < 3 THEN lpad(amount, 3, '0') ELSE amount END, 2), '0'), '.')
                 AS ui_amount FROM d""")),
    "a23_valid_total_per_mint": (a23_valid_total_per_mint, over(_VALID, _TOTALS + """
        SELECT mint, CAST(units AS VARCHAR) AS amount, """ + _PLAIN.format("CAST(units AS BIGINT)") + """ AS ui_amount,
               round(usd_value, 2) AS usd_value FROM totals""")),
    "x2_malformed_amounts": (x2_malformed_amounts, over("balances", """
        SELECT wallet_id, 'amount' AS reason FROM balances WHERE units IS NULL""")),
    "a24_total_value": (a24_total_value, over(_VALID, """
        SELECT round(sum(round(ui_amount * usd_price, 6)), 2) AS total_usd FROM priced_balances""")),
    "a23_listed": (a23_listed, over(_VALID, _TOTALS + """
        SELECT mint, token FROM totals WHERE usd_value IS NOT NULL""")),
    "w10_top_balances": (w10_top_balances, over(_VALID, _TOTALS + """
        SELECT mint, token, round(usd_value, 2) AS usd_value FROM totals
        ORDER BY CASE WHEN token = 'USDC' THEN 0 ELSE 1 END, coalesce(usd_value, 0) DESC, token, mint LIMIT 8""")),
    "x16_risk_tone": (x16_risk_tone, over("screening_results", """
        SELECT screening_id, CASE WHEN status <> 'ok' THEN 'neutral'
               WHEN provider = 'elliptic' AND lower(risk_level) = 'check passed' THEN 'green'
               WHEN provider = 'trm' AND risk_score IS NULL AND risk_level = '' THEN 'green'
               WHEN risk_score >= 7 THEN 'red' WHEN risk_score >= 3 THEN 'yellow' WHEN risk_score IS NOT NULL THEN 'green'
               WHEN regexp_matches(lower(risk_level), 'severe|high|critical|elevated') THEN 'red'
               WHEN regexp_matches(lower(risk_level), 'medium|moderate|watch') THEN 'yellow'
               WHEN regexp_matches(lower(risk_level), 'low|none|minimal') THEN 'green' ELSE 'neutral' END AS tone
        FROM screening_results""")),
}
