"""Queries over token accounts, holders and wallet labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import balances, holders, labels, supply
from ledgerlens.operators.skew import materialise
from ledgerlens.plans.supply import _ENTRIES, days, entries
from ledgerlens.plans.views import over
from ledgerlens.session import shared_dir
from ledgerlens.sources import adapters, export
from ledgerlens.streaming import owners

AS_OF = "2024-07-01 00:00:00"


def _state(spark, folder):
    lines = adapters.table(spark, folder, "lineitem")
    return holders.latest_accounts(adapters.account_updates(lines))


def _shares(spark, folder):
    return holders.holder_shares(adapters.holder_rows(spark, folder), "amount")


def a14_owner_balances(spark, folder):
    rows = holders.owner_balances(adapters.token_accounts(spark, folder))
    return rows.select("mint", "owner", F.col("amount").cast("bigint").alias("amount"))


def w4_top_holders(spark, folder):
    rows = holders.top_holders(holders.owner_balances(adapters.token_accounts(spark, folder)))
    return rows.select("mint", "owner", F.col("amount").cast("bigint").alias("amount"), "rank")


def a15_holder_shares(spark, folder):
    return _shares(spark, folder).select("mint", "holder_address", "percentage")


def a4_j1_concentration(spark, folder):
    shares = _shares(spark, folder).withColumnRenamed("holder_address", "owner")
    rows = holders.concentration(shares, adapters.token_registry(spark, folder))
    return rows.select(
        "mint", "symbol", "name", "top1_pct", F.round("top10_pct", 4).alias("top10_pct"), "holder_count"
    )


def a16_median_balances(spark, folder):
    return holders.median_balances(adapters.holder_rows(spark, folder))


def a7_balance_summary(spark, folder):
    return holders.balance_summary(adapters.token_accounts(spark, folder))


def r3_last_write(spark, folder):
    return _state(spark, folder).select("account", "mint", "owner", F.col("amount").cast("bigint").alias("amount"))


def _mints(spark, folder):
    """Two decimals for every fourth mint; the mints that are multiples of ten."""
    suppliers = adapters.table(spark, folder, "supplier")
    mint = F.col("s_suppkey").cast("string").alias("mint")
    decimals = suppliers.filter("s_suppkey % 4 = 0").select(mint, F.lit(2).alias("decimals"))
    return decimals, suppliers.filter("s_suppkey % 10 = 0").select(mint)


def r4_holder_snapshot(spark, folder):
    """Top holders of the mints that are multiples of ten; two decimals for every fourth mint."""
    rows = holders.holder_snapshot(_state(spark, folder), *_mints(spark, folder))
    return rows.withColumn("amount", F.col("amount").cast("bigint"))


def _followed(spark, folder):
    """Tables of owners and top lists after all updates came in three batches, late ones among them."""
    root = shared_dir(spark, "owners")
    owners.start(spark, root, 16)
    updates = adapters.account_updates(adapters.table(spark, folder, "lineitem"))
    for batch in range(3):
        owners.apply_updates(updates.filter(F.pmod("seq", F.lit(3)) == batch), root, batch)
    return root


def r4_snapshot_by_deltas(spark, folder):
    """The snapshot from top lists that were kept up batch by batch."""
    rows = holders.listed_snapshot(owners.top_lists(spark, _followed(spark, folder)), *_mints(spark, folder))
    return rows.withColumn("amount", F.col("amount").cast("bigint"))


def w4_balances_by_deltas(spark, folder):
    """Balances of all owners that were kept up batch by batch."""
    rows = owners.owner_balances(spark, _followed(spark, folder))
    return rows.withColumn("amount", F.col("amount").cast("bigint"))


def r4_holder_snapshot_fallback(spark, folder):
    """No wanted mint has a holder, so every mint is listed."""
    suppliers = adapters.table(spark, folder, "supplier")
    nobody = suppliers.select(F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("mint"))
    decimals = suppliers.filter("s_suppkey < 0").select(
        F.col("s_suppkey").cast("string").alias("mint"), F.lit(0).alias("decimals")
    )
    rows = holders.holder_snapshot(_state(spark, folder), decimals, nobody)
    return rows.withColumn("amount", F.col("amount").cast("bigint")).select("mint", "holder_address", "amount", "rank")


def a25_concentration_index(spark, folder):
    """Owners of the first ten mints weighted by balance, one index over all mints."""
    tokens = adapters.holder_rows(spark, folder).groupBy("mint").agg(
        F.sum("ui_amount").alias("market_cap_usd")
    )
    return holders.concentration_index(tokens)


def a27_key_figures(spark, folder):
    rows = holders.key_figures(entries(spark, folder))
    return rows.select(
        F.round("total_market_cap", 4).alias("total_market_cap"),
        "total_holders",
        F.round("avg_balance", 6).alias("avg_balance"),
    )


def a26_insights(spark, folder):
    regions, categories = labels.labelled_shares(adapters.wallet_labels(spark, folder))
    return holders.insights(entries(spark, folder), regions, categories)


def a37_positive_balances(spark, folder):
    """Balance per owner over accounts whose last balance is positive."""
    rows = balances.positive_per_owner(adapters.account_updates(adapters.table(spark, folder, "lineitem")))
    return rows.withColumn("amount", F.col("amount").cast("bigint"))


def w16_largest_account(spark, folder):
    rows = balances.largest_account(adapters.token_accounts(spark, folder))
    return rows.select("owner", "mint", "account", F.col("amount").cast("bigint").alias("amount"))


def f6_unlabelled(spark, folder):
    return labels.unlabelled(adapters.wallet_labels(spark, folder))


def f7_a9_regions(spark, folder):
    return labels.labelled_shares(adapters.wallet_labels(spark, folder))[0]


def a9_categories(spark, folder):
    return labels.labelled_shares(adapters.wallet_labels(spark, folder))[1]


def _labelled_holders(spark, folder):
    rows = adapters.holder_rows(spark, folder).withColumnRenamed("holder_address", "wallet_address")
    return rows.join(
        adapters.wallet_labels(spark, folder).select("wallet_address", "geography", "attribution_category"),
        "wallet_address",
        "left",
    )


def a10_holder_regions(spark, folder):
    return labels.holder_distribution(_labelled_holders(spark, folder), "geography", "region", "Unknown")


def a10_no_holders(spark, folder):
    """No holder qualifies, so one row says unknown."""
    none = _labelled_holders(spark, folder).filter("amount < 0")
    return labels.holder_distribution(none, "attribution_category", "category", "unknown")


def m8_program_attribution(spark, folder):
    """Wallets divisible by 500 stand for programs."""
    wallets = adapters.wallet_labels(spark, folder)
    programs = {str(500 * i): name for i, name in enumerate(labels.PROGRAMS.values())}
    rows = labels.program_attribution(wallets, AS_OF, programs)
    return rows.select("wallet_address", "geography", "attribution_category", "source", "confidence")


def _sources(spark, folder):
    customer = adapters.table(spark, folder, "customer")
    wallet = F.col("c_custkey").cast("string").alias("wallet_address")
    identities = customer.filter("c_custkey % 2 = 0").select(
        wallet,
        F.lit("helius").alias("source"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).alias("category"),
    )
    confirmations = customer.filter("c_custkey % 5 = 0").select(wallet, F.lit("explorer").alias("source"))
    exchanges = customer.filter("c_custkey % 7 = 0").select(
        wallet, F.lit("kraken").alias("exchange"), F.lit("USA").alias("country")
    )
    return identities, confirmations, exchanges


def m9_enrich(spark, folder):
    identities, confirmations, exchanges = _sources(spark, folder)
    rows = labels.enrich(adapters.wallet_labels(spark, folder), identities, confirmations, AS_OF, exchanges)
    return rows.select(
        "wallet_address", "geography", "attribution_category", "confidence", "source_detail", "source"
    )


def m10_new_wallets(spark, folder):
    """Holders that are no customer have no label yet."""
    rows = labels.new_wallets(
        adapters.token_holders(spark, folder),
        adapters.wallet_labels(spark, folder),
        AS_OF,
        "analytics",
    )
    return rows.select("wallet_address", "geography", "attribution_category", "source")


def a35_coverage(spark, folder):
    rows = labels.coverage(
        adapters.wallet_labels(spark, folder), adapters.token_holders(spark, folder), 800.0
    )
    return rows.select("wallets", *[F.round(c, 6).alias(c) for c in rows.columns if c != "wallets"])


def v3_document(spark, folder):
    """Every entry of the analytics document with its number."""
    daily = days(spark, folder)
    holders = adapters.token_holders(spark, folder)
    regions, categories = labels.labelled_shares(adapters.wallet_labels(spark, folder))
    document = export.analytics_document(
        materialise(entries(spark, folder, daily), "entries"),
        regions,
        categories,
        supply.daily_holders(holders, 30, supply.newest(holders, "snapshot_at")),
        supply.since(daily, 30, supply.newest(daily)).select("date", "symbol", "ui_supply"),
    )
    number = F.coalesce(*[F.get_json_object("entry", f"$.{n}") for n in ("value", "holderCount", "totalHolders")])
    return document.select("section", "key", F.round(number.cast("double"), 6).alias("number"))


_STATE = """
WITH last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY slot DESC, seq DESC, mint, owner,
                 amount DESC) AS rn FROM account_updates) WHERE rn = 1 AND amount > 0),
owners AS (SELECT mint, owner, CAST(sum(amount) AS BIGINT) AS amount FROM last GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY amount DESC, owner) AS rank FROM owners)
"""
_SHARES = """
WITH shares AS (
  SELECT *, CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY mint) AS DOUBLE) * 100 AS share FROM holder_rows)
"""
_REGIONS = """
WITH regions AS (
  SELECT geography AS region, count(*) AS n FROM wallet_labels WHERE geography <> 'Unknown' GROUP BY 1),
categories AS (
  SELECT attribution_category AS category, count(*) AS n FROM wallet_labels WHERE attribution_category <> 'unknown'
  GROUP BY 1),
total AS (SELECT sum(n) AS n FROM regions)
"""

QUERIES = {
    "a14_owner_balances": (a14_owner_balances, over("token_accounts", """
        SELECT mint, owner, CAST(sum(amount) AS BIGINT) AS amount FROM token_accounts GROUP BY 1, 2""")),
    "w4_top_holders": (w4_top_holders, over("token_accounts", """
        SELECT * FROM (
          SELECT mint, owner, CAST(sum(amount) AS BIGINT) AS amount,
                 row_number() OVER (PARTITION BY mint ORDER BY sum(amount) DESC, owner) AS rank
          FROM token_accounts GROUP BY 1, 2) WHERE rank <= 20""")),
    "a15_holder_shares": (a15_holder_shares, over("holder_rows", _SHARES + """
        SELECT mint, holder_address, round_even(share, 4) AS percentage FROM shares""")),
    "a4_j1_concentration": (a4_j1_concentration, over("holder_rows token_registry", _SHARES + """
        , ranked AS (
          SELECT *, round_even(share, 4) AS percentage,
                 row_number() OVER (PARTITION BY mint ORDER BY amount DESC, holder_address) AS rank FROM shares)
        SELECT r.mint, t.symbol, t.name, max(CASE WHEN rank = 1 THEN percentage END) AS top1_pct,
               round(sum(CASE WHEN rank <= 10 THEN percentage END), 4) AS top10_pct, count(*) AS holder_count
        FROM ranked r LEFT JOIN token_registry t ON r.mint = t.mint GROUP BY 1, 2, 3""")),
    "a16_median_balances": (a16_median_balances, over("holder_rows", """
        SELECT mint, median(ui_amount) AS median_balance FROM holder_rows GROUP BY 1""")),
    "a7_balance_summary": (a7_balance_summary, over("token_accounts", """
        SELECT mint, count(*) AS token_accounts, count(DISTINCT owner) AS wallets,
               CAST(floor(avg(balance) + 0.5) AS BIGINT) AS mean_balance_rounded, median(balance) AS median_balance
        FROM token_accounts GROUP BY 1""")),
    "r3_last_write": (r3_last_write, over("account_updates", _STATE + """
        SELECT account, mint, owner, amount FROM last""")),
    "r4_holder_snapshot": (r4_holder_snapshot, over("account_updates", _STATE + """
        SELECT mint, owner AS holder_address, amount,
               CASE WHEN CAST(mint AS INTEGER) % 4 = 0 THEN 2 ELSE 0 END AS decimals,
               amount / CASE WHEN CAST(mint AS INTEGER) % 4 = 0 THEN CAST(100 AS DOUBLE) ELSE 1 END AS ui_amount, rank
        FROM ranked WHERE rank <= 20 AND CAST(mint AS INTEGER) % 10 = 0""")),
    "w4_balances_by_deltas": (w4_balances_by_deltas, over("account_updates", _STATE + """
        SELECT mint, owner, amount FROM owners""")),
    "r4_holder_snapshot_fallback": (r4_holder_snapshot_fallback, over("account_updates", _STATE + """
        SELECT mint, owner AS holder_address, amount, rank FROM ranked WHERE rank <= 20""")),
    "a25_concentration_index": (a25_concentration_index, over("holder_rows", """
        WITH caps AS (SELECT mint, sum(ui_amount) AS v FROM holder_rows GROUP BY 1),
        hhi AS (SELECT CAST(floor(sum(power(v / t * 100, 2)) + 0.5) AS BIGINT) AS hhi
                FROM caps, (SELECT sum(v) AS t FROM caps))
        SELECT hhi, CASE WHEN hhi < 1500 THEN 'Low Concentration' WHEN hhi < 2500 THEN 'Moderate Concentration'
                    ELSE 'High Concentration' END AS band FROM hhi""")),
    "a37_positive_balances": (a37_positive_balances, over("account_updates", """
        SELECT owner, mint, CAST(sum(amount) AS BIGINT) AS amount FROM account_updates WHERE amount > 0 GROUP BY 1, 2""")),
    "w16_largest_account": (w16_largest_account, over("token_accounts", """
        SELECT owner, mint, account, amount FROM (
          SELECT *, row_number() OVER (PARTITION BY owner, mint ORDER BY amount DESC, position, account) AS rn
          FROM token_accounts) WHERE rn = 1""")),
    "f6_unlabelled": (f6_unlabelled, over("wallet_labels", """
        SELECT wallet_address FROM wallet_labels WHERE geography = 'Unknown' OR attribution_category = 'unknown'""")),
    "f7_a9_regions": (f7_a9_regions, over("wallet_labels", _REGIONS + """
        SELECT region, CAST(floor(n / (SELECT n FROM total) * 100 + 0.5) AS BIGINT) AS percentage, n AS holder_count
        FROM regions""")),
    "a9_categories": (a9_categories, over("wallet_labels", _REGIONS + """
        SELECT category, CAST(floor(n / (SELECT n FROM total) * 100 + 0.5) AS BIGINT) AS percentage,
               n AS holder_count FROM categories""")),
    "a10_holder_regions": (a10_holder_regions, over("holder_rows wallet_labels", """
        SELECT coalesce(l.geography, 'Unknown') AS region, count(*) AS holder_count,
               round_even(count(*) / (SELECT count(*) FROM holder_rows) * 100, 2) AS percentage
        FROM holder_rows h LEFT JOIN wallet_labels l ON h.holder_address = l.wallet_address GROUP BY 1""")),
    "a10_no_holders": (a10_no_holders, "SELECT 'unknown' AS category, CAST(100.0 AS DOUBLE) AS percentage, 0 AS holder_count"),
    "m8_program_attribution": (m8_program_attribution, over("wallet_labels", """
        WITH hits AS (
          SELECT *, c_custkey % 500 = 0 AND c_custkey < 2500 AND (geography = 'Unknown' OR attribution_category = 'unknown')
                 AS hit FROM wallet_labels)
        SELECT wallet_address, geography,
               CASE WHEN hit THEN ['protocol:jupiter', 'protocol:orca', 'protocol:raydium', 'protocol:marinade',
                 'protocol:metaplex'][c_custkey // 500 + 1] ELSE attribution_category END AS attribution_category,
               CASE WHEN hit THEN 'heuristic' ELSE source END AS source, CASE WHEN hit THEN 1.0 ELSE confidence END
                 AS confidence FROM hits""")),
    "m9_enrich": (m9_enrich, over("wallet_labels", """
        WITH found AS (
          SELECT l.*, c.c_custkey % 7 = 0 AS listed, c.c_custkey % 2 = 0 AS named, c.c_custkey % 5 = 0 AS confirmed,
                 CASE WHEN c.c_custkey % 3 = 0 THEN lower(c.c_mktsegment) ELSE c.c_name END AS entity,
                 (geography = 'Unknown' OR attribution_category = 'unknown') AS open
          FROM wallet_labels l JOIN customer c ON l.c_custkey = c.c_custkey),
        hits AS (
          SELECT *, open AND (listed OR named) AS hit,
                 list_filter([CASE WHEN listed THEN 'static' END, CASE WHEN named THEN 'helius' END,
                              CASE WHEN confirmed THEN 'explorer' END], lambda x: x IS NOT NULL) AS sources FROM found)
        SELECT wallet_address,
               CASE WHEN NOT hit THEN geography WHEN listed THEN 'USA' ELSE 'Unknown' END AS geography,
               CASE WHEN NOT hit THEN attribution_category WHEN listed THEN 'exchange:kraken'
                    ELSE 'entity:' || entity END AS attribution_category,
               CASE WHEN NOT hit THEN confidence WHEN len(sources) >= 2 THEN 1.0 ELSE 0.9 END AS confidence,
               CASE WHEN hit THEN array_to_string(sources, '+') ELSE source_detail END AS source_detail,
               CASE WHEN hit THEN sources[1] ELSE source END AS source FROM hits""")),
    "m10_new_wallets": (m10_new_wallets, over("token_holders wallet_labels", """
        SELECT DISTINCT wallet_address, 'Unknown' AS geography, 'unknown' AS attribution_category, 'analytics' AS source
        FROM token_holders WHERE wallet_address NOT IN (SELECT wallet_address FROM wallet_labels)""")),
    "a35_coverage": (a35_coverage, over("token_holders wallet_labels", """
        WITH b AS (SELECT wallet_address, sum(balance) AS balance FROM token_holders GROUP BY 1),
        j AS (SELECT l.*, attribution_category <> 'unknown' AS labelled, coalesce(balance > 800, FALSE) AS large
              FROM wallet_labels l LEFT JOIN b USING (wallet_address))
        SELECT count(*) AS wallets, round(count(*) FILTER (WHERE labelled) * 100.0 / count(*), 6) AS labelled_pct,
               round(count(*) FILTER (WHERE labelled AND large) * 100.0 / nullif(count(*) FILTER (WHERE large), 0), 6)
                 AS large_labelled_pct,
               round(avg(confidence) FILTER (WHERE labelled), 6) AS avg_confidence,
               round(count(*) FILTER (WHERE labelled AND source_detail LIKE '%+%') * 100.0
                     / count(*) FILTER (WHERE labelled), 6) AS two_source_pct FROM j""")),
}

QUERIES["a27_key_figures"] = (a27_key_figures, over("supply_snapshots holder_rows token_registry", _ENTRIES + """
    SELECT round(sum(market_cap_usd), 4) AS total_market_cap, CAST(sum(holder_count) AS BIGINT) AS total_holders,
           round(avg(median_balance), 6) AS avg_balance FROM entries"""))
QUERIES["a26_insights"] = (a26_insights, over(
    "supply_snapshots holder_rows token_registry wallet_labels", _ENTRIES + "," + _REGIONS.strip()[4:] + """
    , r AS (SELECT region, n, CAST(floor(n / (SELECT n FROM total) * 100 + 0.5) AS BIGINT) AS p FROM regions),
    c AS (SELECT category, n, CAST(floor(n / (SELECT n FROM total) * 100 + 0.5) AS BIGINT) AS p FROM categories)
    (SELECT 'Dominance' AS label, 'largest token: ' || symbol || ', ' ||
            format('{:.1f}', market_cap_usd / (SELECT sum(market_cap_usd) FROM entries) * 100) ||
            '% of the value of all tokens' AS message, 'info' AS variant
     FROM entries ORDER BY market_cap_usd DESC, symbol DESC LIMIT 1)
    UNION ALL
    (SELECT 'Geography', 'largest region: ' || region || ', ' || p || '% of the wallets', 'success'
     FROM r ORDER BY p DESC, n DESC, region DESC LIMIT 1)
    UNION ALL
    (SELECT 'Attribution', 'largest category: ' || category || ', ' || p || '% of the wallets', 'warning'
     FROM c ORDER BY p DESC, n DESC, category DESC LIMIT 1)"""))


QUERIES["v3_document"] = (v3_document, over(
    "supply_snapshots holder_rows token_registry wallet_labels token_holders", _ENTRIES + "," + _REGIONS.strip()[4:] + """
    SELECT 'stablecoins' AS section, symbol AS key, CAST(holder_count AS DOUBLE) AS number FROM entries
    UNION ALL SELECT 'holders', 'total', sum(holder_count) FROM entries
    UNION ALL SELECT 'geography', region, n FROM regions
    UNION ALL SELECT 'attribution', category, n FROM categories
    UNION ALL
    SELECT 'holdersHistory', CAST(CAST(snapshot_at AS DATE) AS VARCHAR), count(DISTINCT wallet_address) FROM token_holders
    WHERE CAST(snapshot_at AS DATE) >= (SELECT CAST(max(snapshot_at) AS DATE) FROM token_holders) - 30 GROUP BY 2
    UNION ALL
    SELECT 'supplyHistory', CAST(date AS VARCHAR) || '/' || symbol, round(ui_supply, 6) FROM daily
    WHERE date >= (SELECT max(date) FROM daily) - 30"""))

# Top lists that were kept up by deltas equal those of all accounts.
QUERIES["r4_snapshot_by_deltas"] = (r4_snapshot_by_deltas, QUERIES["r4_holder_snapshot"][1])
