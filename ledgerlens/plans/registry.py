"""Queries over the token registry: listings, maintenance, lifecycle, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import health, lifecycle, listing, registry
from ledgerlens.plans.views import over
from ledgerlens.session import shared_dir
from ledgerlens.sources import adapters, keyed

AS_OF = "2024-06-30 00:00:00"


def _tokens(spark, folder):
    return adapters.analytics_tokens(spark, folder)


def _listed(column: str):
    return F.array_join(column, ",").alias(column)


def f2_list_tokens(spark, folder):
    rows, _ = registry.list_tokens(
        _tokens(spark, folder), status="verified", source="db", sort="symbol", descending=False, limit=50, offset=10
    )
    return rows.select("mint_address", "symbol", "priority")


def f2_list_total(spark, folder):
    return registry.list_tokens(_tokens(spark, folder), status="verified", source="db")[1]


def f3_needing_recheck(spark, folder):
    rows = registry.needing_recheck(_tokens(spark, folder), AS_OF)
    return rows.select("mint_address", "verification_status", "priority")


def f4_active_tokens(spark, folder):
    return registry.active_tokens(_tokens(spark, folder)).select("mint_address", "symbol", "priority")


def f5_lifecycle_log(spark, folder):
    rows = registry.lifecycle_log(_tokens(spark, folder))
    return rows.selectExpr("mint_address", "event_type", "details", "unix_micros(created_at) as created_at")


def f11_search(spark, folder):
    """Tokens whose name contains a text, whatever its case."""
    from ledgerlens.functions.text import contains_ignore_case

    tokens = _tokens(spark, folder)
    hits = tokens.filter(
        contains_ignore_case(F.col("symbol"), "BRAND#2") | contains_ignore_case(F.col("name"), "Widget")
    )
    return hits.filter(F.col("name").ilike("%R%")).select("mint_address", "symbol", "name")


def w11_sorted(spark, folder):
    """All tokens, the oldest verification first; never verified tokens sort last."""
    tokens = _tokens(spark, folder)
    rows = listing.sorted_nulls_last(tokens, "last_verified_at", False, ["mint_address"])
    return rows.selectExpr("mint_address", "unix_micros(last_verified_at) as last_verified_at")


def a11_summary(spark, folder):
    return registry.registry_summary(_tokens(spark, folder), AS_OF)


def a34_deployed_mints(spark, folder):
    return registry.deployed_mints(adapters.issued_tokens(spark, folder))


def _configured(spark, folder):
    """Mints of every seventh supplier, as a configured list would name them."""
    suppliers = adapters.table(spark, folder, "supplier").filter("s_suppkey % 7 = 0")
    return suppliers.select(F.concat(F.lit("tok"), F.col("s_suppkey").cast("string")).alias("mint_address"))


def j7_u5_resolve_mints(spark, folder):
    configured = _configured(spark, folder).unionByName(
        _configured(spark, folder).select(F.concat(F.lit("new"), "mint_address").alias("mint_address"))
    )
    rows = registry.resolve_mints(configured, _tokens(spark, folder), adapters.issued_tokens(spark, folder))
    return rows.select(
        "mint_address", "symbol", "name", "decimals", _listed("sources"), "verification_status", "priority",
        "min_holders_threshold", _listed("tags"),
    )


def _deployed(spark, folder):
    """Suppliers' tokens: half of them new mints, half known ones, some without a name."""
    key = F.col("s_suppkey")
    return adapters.table(spark, folder, "supplier").select(
        F.concat(F.when(key % 2 == 0, "tok").otherwise("own"), key.cast("string")).alias("mint_address"),
        F.concat(F.lit("S"), key.cast("string")).alias("symbol"),
        F.when(key % 3 != 0, F.col("s_name")).alias("name"),
        F.when(key % 5 != 0, F.lit(9)).alias("decimals"),
    )


_MAINTAINED = ["mint_address", "symbol", "name", "decimals", "is_active", "priority", "verification_status"]


def m1_register_user_tokens(spark, folder):
    rows = registry.register_user_tokens(_tokens(spark, folder), _deployed(spark, folder), AS_OF)
    return rows.select(*_MAINTAINED, "source_user_deployment", _listed("tags"))


def _found(spark, folder):
    return _deployed(spark, folder).withColumns(
        {
            "source": F.when(F.col("decimals").isNull(), "coingecko").otherwise("jupiter"),
            "logo_uri": F.concat(F.lit("logo/"), "symbol"),
            "coingecko_id": F.lower("symbol"),
        }
    )


def m2_register_discovered(spark, folder):
    rows = registry.register_discovered_tokens(_tokens(spark, folder), _found(spark, folder), AS_OF)
    return rows.select(*_MAINTAINED, "source_discovery", "jupiter_verified", "logo_uri", _listed("tags"))


def _seeds(spark, folder):
    return _deployed(spark, folder).withColumns(
        {
            "source_env": F.lit(True),
            "source_db": F.lit(True),
            "priority": F.lit(25),
            "verification_status": F.lit("verified"),
            "tags": F.array(F.lit("stablecoin")),
        }
    )


def _retired(spark, folder):
    return adapters.table(spark, folder, "supplier").filter("s_suppkey % 6 = 0").select(
        F.concat(F.lit("tok"), F.col("s_suppkey").cast("string")).alias("mint_address")
    )


def m3_seed(spark, folder):
    tokens = registry.seed_tokens(_tokens(spark, folder), _seeds(spark, folder), AS_OF)
    rows = registry.deactivate(tokens, _retired(spark, folder), AS_OF)
    return rows.select(*_MAINTAINED, "source_env", "source_db", _listed("tags"))


def _figures(spark, folder):
    """Every third token gets new figures; every sixth also loses its error text."""
    part = adapters.table(spark, folder, "part").filter("p_partkey % 3 = 0")
    key = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("tok"), key.cast("string")).alias("mint_address"),
        key.alias("holder_count"),
        F.lit("verified").alias("verification_status"),
        F.lit(None).cast("string").alias("verification_error"),
        F.when(key % 6 == 0, F.array(F.lit("holder_count"), F.lit("verification_error")))
        .when(key % 9 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("holder_count"), F.lit("verification_status")))
        .alias("set_fields"),
    )


_FIGURES = ["mint_address", "holder_count", "verification_status", "verification_error", "unix_micros(updated_at) as updated_at"]


def m4_sparse_update(spark, folder):
    return registry.sparse_update(_tokens(spark, folder), _figures(spark, folder), AS_OF).selectExpr(*_FIGURES)


def _stored(spark, folder, *steps):
    """The registry as a table in buckets, after merges of updates by operators that know a key's own rows only."""
    path = shared_dir(spark, "registry")
    keyed.create_keyed(_tokens(spark, folder), path, ["mint_address"], 16)
    for updates, operator in steps:
        keyed.merge_keyed(updates(spark, folder), path, lambda known, new: operator(known, new, AS_OF))
    return keyed.read_keyed(spark, path)


def m2_stored_registry(spark, folder):
    rows = _stored(spark, folder, (_found, registry.register_discovered_tokens))
    return rows.select(*_MAINTAINED, "source_discovery", "jupiter_verified", "logo_uri", _listed("tags"))


def m3_stored_registry(spark, folder):
    rows = _stored(spark, folder, (_seeds, registry.seed_tokens), (_retired, registry.deactivate))
    return rows.select(*_MAINTAINED, "source_env", "source_db", _listed("tags"))


def m4_stored_registry(spark, folder):
    return _stored(spark, folder, (_figures, registry.sparse_update)).selectExpr(*_FIGURES)


def _address(letter: str):
    return F.concat(F.lit(letter), F.lpad(F.col("p_partkey").cast("string"), 43, "0"))


def m5_candidates(spark, folder):
    """Two lists made from the parts; some addresses are too short, some are not verified."""
    from ledgerlens.sources import landed

    part = adapters.table(spark, folder, "part")
    short = F.concat(F.lit("x"), F.col("p_partkey").cast("string"))
    entry = F.struct(
        F.when(F.col("p_partkey") % 4 == 0, short).otherwise(_address("a")).alias("address"),
        F.col("p_brand").alias("symbol"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("decimals"),
        F.lit("logo").alias("logoURI"),
    )
    first = part.select(F.to_json(F.array(entry)).alias("payload"))
    market = F.struct(
        F.lower("p_type").alias("id"),
        F.lower("p_type").alias("symbol"),
        F.col("p_name").alias("name"),
        F.create_map(F.lit("chain"), _address("b")).alias("platforms"),
    )
    second = part.select(F.to_json(F.array(market)).alias("payload"))
    on_chain = part.filter("p_partkey % 3 <> 0").select(
        F.explode(F.array(_address("a"), _address("b"))).alias("mint_address"),
        (F.col("p_partkey") % 5 != 0).alias("verified"),
    )
    found = registry.candidates_from_lists(landed.token_list(first), landed.market_list(second, "chain"), on_chain)
    tokens = registry.register_candidates(_tokens(spark, folder), found, AS_OF)
    return tokens.filter("source_discovery").select("mint_address", "symbol", "name", "decimals", "coingecko_id")


def m6_reverify(spark, folder):
    part = adapters.table(spark, folder, "part").filter("p_partkey % 4 <> 0")
    results = part.select(
        F.concat(F.lit("tok"), F.col("p_partkey").cast("string")).alias("mint_address"),
        (F.col("p_partkey") % 3 != 0).alias("verified"),
        F.col("p_partkey").alias("holders"),
        F.col("p_retailprice").cast("decimal(38,9)").alias("supply"),
        F.when(F.col("p_partkey") % 7 != 0, F.lit(8)).alias("decimals"),
    )
    rows = registry.reverify(_tokens(spark, folder), results, AS_OF)
    return rows.select(
        "mint_address", "verification_status", "verification_error", "decimals", "holder_count_at_verification",
        F.col("supply_at_verification").cast("double").alias("supply_at_verification"),
        _listed("verification_sources"),
    )


def m14_register_identifiers(spark, folder):
    """The registry holds even parts; all parts are registered, twice."""
    part = adapters.table(spark, folder, "part").select(
        F.concat(F.lit("tok"), F.col("p_partkey").cast("string")).alias("mint"),
        F.col("p_brand").alias("symbol"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("name"),
        F.lit(None).cast("string").alias("network"),
        F.lit(None).cast("int").alias("decimals"),
        "p_partkey",
    )
    empty = registry.bootstrap_registry(spark).filter("mint IS NULL")
    known = registry.register_identifiers(empty, part.filter("p_partkey % 2 = 0").drop("p_partkey"))
    rows = registry.register_identifiers(known, part.drop("p_partkey").unionByName(part.drop("p_partkey")))
    return rows.select(
        "mint", "symbol", "name", "network", "decimals", F.substring("uuid", 15, 1).alias("uuid_version")
    )


# --- lifecycle ------------------------------------------------------------------------------------------

# Snapshots of the lifecycle queries: line items of one simulated month, seen at its end.
SEEN = "2001-11-05 00:00:00"


def _snapshots(spark, folder):
    """Supply per mint over 36 hours: every line item is one snapshot, placed by its order key."""
    key = F.col("l_orderkey")
    lines = adapters.table(spark, folder, "lineitem")
    ago = F.make_dt_interval(F.lit(0), F.lit(0), (key % 2160).cast("int"))
    return lines.select(
        F.concat(F.lit("tok"), F.col("l_suppkey").cast("string")).alias("mint_address"),
        F.col("l_extendedprice").alias("supply"),
        key.alias("slot"),
        (F.lit(SEEN).cast("timestamp") - ago).alias("snapshot_at"),
    )


def _current(spark, folder):
    """Holders and supply of each supplier's mint; ages run from 0 to 39 days."""
    key = F.col("s_suppkey")
    return adapters.table(spark, folder, "supplier").select(
        F.concat(F.lit("tok"), key.cast("string")).alias("mint_address"),
        F.when(key % 10 == 3, 0).otherwise(key).cast("bigint").alias("holder_count"),
        F.when(key % 10 == 3, 0.0).when(key % 9 == 1, 1.0).otherwise(1e12).alias("total_supply"),
        (F.lit(SEEN).cast("timestamp") - F.make_dt_interval((key % 40).cast("int"))).alias("snapshot_at"),
    )


def _status(spark, folder, baseline="sum"):
    current = _current(spark, folder)
    return lifecycle.token_status(
        current, _snapshots(spark, folder), current, _tokens(spark, folder), SEEN, baseline
    )


def j23_baselines(spark, folder):
    rows = lifecycle.supply_baselines(_snapshots(spark, folder), SEEN)
    return rows.select(
        "mint_address",
        F.round("supply_1h_ago", 2).alias("supply_1h_ago"),
        F.round("supply_24h_ago", 2).alias("supply_24h_ago"),
    )


def j5_j6_token_status(spark, folder):
    rows = _status(spark, folder)
    return rows.selectExpr(
        "mint_address", "symbol", "holder_count", "total_supply", "unix_micros(last_ingested_at) as last_ingested_at",
        "round(supply_1h_ago, 2) as supply_1h_ago", "round(supply_24h_ago, 2) as supply_24h_ago",
        "unix_micros(last_ingested_at_db) as last_ingested_at_db",
    )


def m7_lifecycle_events(spark, folder):
    rows = lifecycle.lifecycle_events(_status(spark, folder), SEEN)
    return rows.select(
        "mint_address",
        "event_type",
        F.round(F.get_json_object("details", "$.supply_before").cast("double"), 2).alias("supply_before"),
    )


def m7_retire_first(spark, folder):
    rows = lifecycle.lifecycle_events(_status(spark, folder), SEEN, retire_first=True)
    return lifecycle.event_counts(rows)


def m7_apply_events(spark, folder):
    events = lifecycle.lifecycle_events(_status(spark, folder), SEEN, retire_first=True)
    rows = lifecycle.apply_events(_tokens(spark, folder), events)
    return rows.select("mint_address", "verification_status", "verification_error", "is_active", _listed("tags"))


def j5_latest_holdings(spark, folder):
    rows = lifecycle.latest_holdings(adapters.token_holders(spark, folder))
    return rows.selectExpr(
        "mint_address", "unix_micros(snapshot_at) as snapshot_at", "holder_count", "total_supply"
    )


# --- health ---------------------------------------------------------------------------------------------


def a12_token_counts(spark, folder):
    return health.token_counts(_tokens(spark, folder), AS_OF)


def a13_ingestion(spark, folder):
    rows = health.ingestion_figures(_tokens(spark, folder), "2024-06-30 00:00:10")
    return rows.selectExpr(
        "unix_micros(last_ingested) as last_ingested", "failed_count", "round(avg_latency_ms, 6) as avg_latency_ms"
    )


def m13_checks(spark, folder):
    return health.health_checks(_tokens(spark, folder), AS_OF)


def m13_alerts(spark, folder):
    return health.health_alerts(_tokens(spark, folder), AS_OF)


def m13_report(spark, folder):
    rows = health.health_report(_tokens(spark, folder), AS_OF)
    return rows.select(
        "overall", "alerts", "active_tokens", "failed_ingestions", "retired_tokens_30d", "flagged_rug",
        "flagged_stale", "avg_ingestion_latency_ms",
    )


_T = "analytics_tokens"
_RECHECK = """is_active AND (verification_status IN ('pending', 'failed', 'stale') OR last_verified_at IS NULL
              OR last_verified_at < TIMESTAMP '2024-06-30 00:00:00' - INTERVAL 24 HOURS)"""
_DEPLOYED = """
WITH deployed AS (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'tok' ELSE 'own' END || CAST(s_suppkey AS VARCHAR) AS mint_address,
         'S' || CAST(s_suppkey AS VARCHAR) AS symbol, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS name,
         CASE WHEN s_suppkey % 5 <> 0 THEN 9 END AS decimals FROM supplier)
"""


def _merged(extra: str) -> str:
    return _DEPLOYED + f"""
        SELECT coalesce(t.mint_address, d.mint_address) AS mint_address, coalesce(d.symbol, t.symbol) AS symbol,
               coalesce(d.name, t.name) AS name, coalesce(d.decimals, t.decimals) AS decimals,
               {extra}
        FROM analytics_tokens t FULL JOIN deployed d ON t.mint_address = d.mint_address"""


_LIFE = """
WITH snaps AS (
  SELECT 'tok' || CAST(l_suppkey AS VARCHAR) AS mint_address, l_extendedprice AS supply,
         TIMESTAMP '2001-11-05 00:00:00' - to_minutes(l_orderkey % 2160) AS snapshot_at FROM lineitem),
cur AS (
  SELECT 'tok' || CAST(s_suppkey AS VARCHAR) AS mint_address, CASE WHEN s_suppkey % 10 = 3 THEN 0 ELSE s_suppkey END
           AS holder_count,
         CASE WHEN s_suppkey % 10 = 3 THEN 0.0 WHEN s_suppkey % 9 = 1 THEN 1.0 ELSE 1e12 END AS total_supply,
         TIMESTAMP '2001-11-05 00:00:00' - to_days(CAST(s_suppkey % 40 AS INTEGER)) AS snapshot_at FROM supplier),
h1 AS (SELECT mint_address, sum(supply) AS s FROM snaps
       WHERE snapshot_at >= TIMESTAMP '2001-11-04 23:00:00' AND snapshot_at < TIMESTAMP '2001-11-04 23:55:00' GROUP BY 1),
h24 AS (SELECT mint_address, sum(supply) AS s FROM snaps
        WHERE snapshot_at >= TIMESTAMP '2001-11-04 00:00:00' AND snapshot_at < TIMESTAMP '2001-11-04 23:00:00' GROUP BY 1),
status AS (
  SELECT c.mint_address, coalesce(t.symbol, c.mint_address[1:8]) AS symbol, c.holder_count, c.total_supply,
         c.snapshot_at AS last_ingested_at, round(h1.s, 2) AS supply_1h_ago, round(h24.s, 2) AS supply_24h_ago,
         c.snapshot_at AS last_ingested_at_db
  FROM cur c LEFT JOIN h1 USING (mint_address) LEFT JOIN h24 USING (mint_address)
  LEFT JOIN (SELECT mint_address, symbol FROM analytics_tokens WHERE is_active) t USING (mint_address)),
tested AS (
  SELECT *, coalesce(supply_1h_ago <> 0 AND total_supply <> 0 AND 1 - total_supply / supply_1h_ago >= 0.99, FALSE) AS rug,
         last_ingested_at <= TIMESTAMP '2001-11-05 00:00:00' - INTERVAL 7 DAYS AS stale,
         holder_count = 0 AND total_supply = 0
           AND last_ingested_at <= TIMESTAMP '2001-11-05 00:00:00' - INTERVAL 30 DAYS AS retire FROM status)
"""

QUERIES = {
    "f2_list_tokens": (f2_list_tokens, over(_T, """
        SELECT mint_address, symbol, priority FROM analytics_tokens
        WHERE is_active AND verification_status = 'verified' AND source_db ORDER BY symbol, mint_address
        LIMIT 50 OFFSET 10""")),
    "f2_list_total": (f2_list_total, over(_T, """
        SELECT count(*) AS total FROM analytics_tokens
        WHERE is_active AND verification_status = 'verified' AND source_db""")),
    "f3_needing_recheck": (f3_needing_recheck, over(_T, f"""
        SELECT mint_address, verification_status, priority FROM analytics_tokens WHERE {_RECHECK}""")),
    "f4_active_tokens": (f4_active_tokens, over(_T, """
        SELECT mint_address, symbol, priority FROM analytics_tokens WHERE is_active""")),
    "f5_lifecycle_log": (f5_lifecycle_log, over(_T, """
        SELECT mint_address, verification_status AS event_type, coalesce(verification_error, '') AS details,
               epoch_us(updated_at) AS created_at FROM analytics_tokens
        WHERE verification_status IN ('retired', 'rug_flagged', 'stale')""")),
    "f11_search": (f11_search, over(_T, """
        SELECT mint_address, symbol, name FROM analytics_tokens
        WHERE (symbol ILIKE '%brand#2%' OR name ILIKE '%widget%') AND name ILIKE '%r%'""")),
    "w11_sorted": (w11_sorted, over(_T, """
        SELECT mint_address, epoch_us(last_verified_at) AS last_verified_at FROM analytics_tokens
        ORDER BY last_verified_at ASC NULLS LAST, mint_address""")),
    "a11_summary": (a11_summary, over(_T, """
        SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active,
               count(*) FILTER (WHERE is_active AND verification_status = 'verified') AS verified,
               count(*) FILTER (WHERE is_active AND verification_status = 'pending') AS pending,
               count(*) FILTER (WHERE is_active AND verification_status = 'failed') AS failed,
               count(*) FILTER (WHERE is_active AND verification_status = 'stale') AS stale,
               count(*) FILTER (WHERE verification_status = 'rug_flagged') AS rug_flagged,
               count(*) FILTER (WHERE verification_status = 'retired') AS retired,
               count(*) FILTER (WHERE verification_status = 'retired'
                                AND updated_at > TIMESTAMP '2024-05-31 00:00:00') AS retired_30d,
               count(*) FILTER (WHERE source_env) AS by_source_env, count(*) FILTER (WHERE source_db) AS by_source_db,
               count(*) FILTER (WHERE source_user_deployment) AS by_source_user,
               count(*) FILTER (WHERE source_discovery) AS by_source_discovery FROM analytics_tokens""")),
    "a34_deployed_mints": (a34_deployed_mints, over("issued_tokens", """
        SELECT DISTINCT mint_address FROM issued_tokens WHERE status = 'deployed' AND mint_address IS NOT NULL""")),
    "j7_u5_resolve_mints": (j7_u5_resolve_mints, over("analytics_tokens issued_tokens", """
        WITH env AS (
          SELECT p || 'tok' || CAST(s_suppkey AS VARCHAR) AS mint_address FROM supplier, (VALUES (''), ('new')) v(p)
          WHERE s_suppkey % 7 = 0),
        db AS (SELECT * FROM analytics_tokens WHERE is_active),
        dep AS (SELECT DISTINCT mint_address FROM issued_tokens WHERE status = 'deployed' AND mint_address IS NOT NULL),
        mints AS (SELECT mint_address FROM env UNION SELECT mint_address FROM db UNION SELECT mint_address FROM dep)
        SELECT m.mint_address, coalesce(d.symbol, m.mint_address[1:8]) AS symbol,
               coalesce(d.name, 'Token ' || m.mint_address[1:8]) AS name, coalesce(d.decimals, 9) AS decimals,
               array_to_string(list_filter([CASE WHEN e.mint_address IS NOT NULL THEN 'env' END,
                 CASE WHEN d.mint_address IS NOT NULL THEN 'db' END,
                 CASE WHEN p.mint_address IS NOT NULL THEN 'user_deployment' END], lambda x: x IS NOT NULL), ',') AS sources,
               coalesce(d.verification_status, 'pending') AS verification_status, coalesce(d.priority, 50) AS priority,
               coalesce(d.min_holders_threshold, 100) AS min_holders_threshold,
               coalesce(array_to_string(d.tags, ','), '') AS tags
        FROM mints m LEFT JOIN env e USING (mint_address) LEFT JOIN db d USING (mint_address)
        LEFT JOIN dep p USING (mint_address)""")),
    "m1_register_user_tokens": (m1_register_user_tokens, over(_T, _merged("""
        CASE WHEN d.mint_address IS NOT NULL THEN TRUE ELSE t.is_active END AS is_active,
        coalesce(t.priority, 50) AS priority, coalesce(t.verification_status, 'pending') AS verification_status,
        d.mint_address IS NOT NULL OR t.source_user_deployment AS source_user_deployment,
        coalesce(array_to_string(t.tags, ','), 'user-deployed') AS tags"""))),
    "m2_register_discovered": (m2_register_discovered, over(_T, _merged("""
        CASE WHEN d.mint_address IS NOT NULL THEN TRUE ELSE t.is_active END AS is_active,
        coalesce(t.priority, 50) AS priority, coalesce(t.verification_status, 'pending') AS verification_status,
        d.mint_address IS NOT NULL OR t.source_discovery AS source_discovery,
        CASE WHEN d.mint_address IS NOT NULL THEN d.decimals IS NOT NULL ELSE FALSE END AS jupiter_verified,
        'logo/' || d.symbol AS logo_uri,
        array_to_string(list_concat(coalesce(t.tags, []), CASE WHEN d.mint_address IS NOT NULL THEN ['discovered']
          ELSE [] END), ',') AS tags"""))),
    "m3_seed_deactivate": (m3_seed, over(_T, _DEPLOYED + """
        SELECT coalesce(t.mint_address, d.mint_address) AS mint_address, coalesce(d.symbol, t.symbol) AS symbol,
               coalesce(d.name, t.name) AS name, coalesce(t.decimals, d.decimals) AS decimals,
               CASE WHEN coalesce(t.mint_address, d.mint_address) IN
                      (SELECT 'tok' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 6 = 0) THEN FALSE
                    WHEN d.mint_address IS NOT NULL THEN TRUE ELSE t.is_active END AS is_active,
               CASE WHEN d.mint_address IS NULL THEN t.priority ELSE greatest(25, coalesce(t.priority, 0)) END AS priority,
               coalesce(t.verification_status, 'verified') AS verification_status,
               d.mint_address IS NOT NULL OR t.source_env AS source_env,
               d.mint_address IS NOT NULL OR t.source_db AS source_db,
               coalesce(array_to_string(t.tags, ','), 'stablecoin') AS tags
        FROM analytics_tokens t FULL JOIN deployed d ON t.mint_address = d.mint_address""")),
    "m4_sparse_update": (m4_sparse_update, over(_T, """
        SELECT mint_address,
               CASE WHEN p_partkey % 3 = 0 AND (p_partkey % 6 = 0 OR p_partkey % 9 <> 0) THEN p_partkey ELSE 0 END
                 AS holder_count,
               CASE WHEN p_partkey % 3 = 0 AND p_partkey % 6 <> 0 AND p_partkey % 9 <> 0 THEN 'verified'
                    ELSE verification_status END AS verification_status,
               CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE verification_error END AS verification_error,
               epoch_us(CASE WHEN p_partkey % 3 = 0 AND (p_partkey % 6 = 0 OR p_partkey % 9 <> 0)
                             THEN TIMESTAMP '2024-06-30 00:00:00' ELSE updated_at END) AS updated_at
        FROM analytics_tokens""")),
    "m5_candidates": (m5_candidates, over(_T, """
        SELECT mint_address, symbol, name, decimals, CAST(NULL AS VARCHAR) AS coingecko_id FROM analytics_tokens
        WHERE source_discovery
        UNION ALL
        SELECT 'a' || lpad(CAST(p_partkey AS VARCHAR), 43, '0'), p_brand, p_name, p_size, NULL FROM part
        WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0
        UNION ALL
        SELECT 'b' || lpad(CAST(p_partkey AS VARCHAR), 43, '0'), p_type, p_name, 9, lower(p_type) FROM part
        WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0""")),
    "m6_reverify": (m6_reverify, over(_T, f"""
        WITH due AS (SELECT *, {_RECHECK} AS due, p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AS good FROM analytics_tokens)
        SELECT d.mint_address,
               CASE WHEN NOT due THEN verification_status WHEN good THEN 'verified' ELSE 'failed' END
                 AS verification_status,
               CASE WHEN NOT due THEN verification_error WHEN good THEN NULL ELSE 'RPC verification failed' END
                 AS verification_error,
               CASE WHEN due AND good THEN CASE WHEN d.p_partkey % 7 <> 0 THEN 8 ELSE 9 END ELSE decimals END AS decimals,
               CASE WHEN due AND good THEN d.p_partkey ELSE 0 END AS holder_count_at_verification,
               CASE WHEN due AND good THEN p.p_retailprice ELSE 0 END AS supply_at_verification,
               CASE WHEN due AND good THEN p.p_type || ',rpc_reverification' ELSE p.p_type END AS verification_sources
        FROM due d JOIN part p ON d.p_partkey = p.p_partkey""")),
    "m14_register_identifiers": (m14_register_identifiers, """
        SELECT 'tok' || CAST(p_partkey AS VARCHAR) AS mint, p_brand AS symbol,
               CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE p_brand END AS name, 'devnet' AS network, 6 AS decimals,
               '5' AS uuid_version FROM part"""),
    "j23_baselines": (j23_baselines, over(_T, _LIFE + """
        SELECT mint_address, round(h1.s, 2) AS supply_1h_ago, round(h24.s, 2) AS supply_24h_ago
        FROM h1 FULL JOIN h24 USING (mint_address)""")),
    "j5_j6_token_status": (j5_j6_token_status, over(_T, _LIFE + """
        SELECT * REPLACE (epoch_us(last_ingested_at) AS last_ingested_at, epoch_us(last_ingested_at_db)
          AS last_ingested_at_db) FROM status""")),
    "j5_latest_holdings": (j5_latest_holdings, over("token_holders", """
        SELECT mint_address, epoch_us(snapshot_at) AS snapshot_at, count(*) AS holder_count, sum(balance) AS total_supply
        FROM token_holders t
        WHERE snapshot_at = (SELECT max(snapshot_at) FROM token_holders u WHERE u.mint_address = t.mint_address)
        GROUP BY 1, 2""")),
    "m7_lifecycle_events": (m7_lifecycle_events, over(_T, _LIFE + """
        SELECT mint_address, CASE WHEN rug THEN 'rug_flagged' WHEN stale THEN 'stale_flagged' ELSE 'retired' END
                 AS event_type, CASE WHEN rug THEN supply_1h_ago END AS supply_before
        FROM tested WHERE rug OR stale OR retire""")),
    "m7_retire_first": (m7_retire_first, over(_T, _LIFE + """
        SELECT count(*) FILTER (WHERE retire AND NOT rug) AS retired, count(*) FILTER (WHERE rug) AS flagged_rug,
               count(*) FILTER (WHERE stale AND NOT rug AND NOT retire) AS flagged_stale FROM tested""")),
    "m7_apply_events": (m7_apply_events, over(_T, _LIFE + """
        SELECT t.mint_address,
               CASE WHEN rug THEN 'rug_flagged' WHEN retire THEN 'retired' WHEN stale THEN 'stale'
                    ELSE verification_status END AS verification_status,
               CASE WHEN rug THEN 'Rug pull detected: 99%+ supply drop in 1 hour'
                    WHEN retire THEN 'Retired: 0 holders + 0 supply for 30+ days'
                    WHEN stale THEN 'No ingestion for 7+ days' ELSE verification_error END AS verification_error,
               CASE WHEN retire AND NOT rug THEN FALSE ELSE is_active END AS is_active,
               array_to_string(list_concat(tags, CASE WHEN rug THEN ['rug-flagged'] WHEN retire THEN ['retired']
                 WHEN stale THEN ['stale'] ELSE [] END), ',') AS tags
        FROM analytics_tokens t LEFT JOIN tested e USING (mint_address)""")),
    "a12_token_counts": (a12_token_counts, over(_T, """
        SELECT count(*) FILTER (WHERE is_active AND verification_status = 'verified') AS active,
               count(*) FILTER (WHERE is_active AND verification_status = 'pending') AS pending,
               count(*) FILTER (WHERE is_active AND verification_status = 'failed') AS failed,
               count(*) FILTER (WHERE is_active AND verification_status = 'stale') AS stale,
               count(*) FILTER (WHERE verification_status = 'rug_flagged') AS rug_flagged,
               count(*) FILTER (WHERE verification_status = 'retired'
                                AND updated_at > TIMESTAMP '2024-05-31 00:00:00') AS retired_30d,
               count(*) FILTER (WHERE verification_status = 'stale') AS stale_flagged FROM analytics_tokens""")),
    "a13_ingestion": (a13_ingestion, over(_T, """
        SELECT epoch_us(max(last_ingested_at) FILTER (WHERE is_active)) AS last_ingested,
               count(*) FILTER (WHERE is_active AND last_ingestion_status = 'failed') AS failed_count,
               round(avg((epoch_us(updated_at) - epoch_us(last_ingested_at)) / 1000) FILTER (
                 WHERE last_ingestion_status = 'success' AND updated_at > TIMESTAMP '2024-06-29 00:00:10'), 6)
                 AS avg_latency_ms FROM analytics_tokens""")),
    "m13_checks": (m13_checks, over(_T, """
        WITH m AS (
          SELECT count(*) FILTER (WHERE is_active AND verification_status = 'verified') AS ok,
                 count(*) FILTER (WHERE is_active AND verification_status = 'pending') AS pending,
                 count(*) FILTER (WHERE is_active AND verification_status = 'failed') AS failed,
                 count(*) FILTER (WHERE is_active AND verification_status = 'stale') AS stale,
                 count(*) FILTER (WHERE verification_status = 'stale') AS all_stale,
                 count(*) FILTER (WHERE verification_status = 'rug_flagged') AS rug,
                 count(*) FILTER (WHERE verification_status = 'retired' AND updated_at > TIMESTAMP '2024-05-31 00:00:00')
                   AS retired,
                 count(*) FILTER (WHERE is_active AND last_ingestion_status = 'failed') AS broken,
                 (epoch_us(TIMESTAMP '2024-06-30 00:00:00') - epoch_us(max(last_ingested_at) FILTER (WHERE is_active)))
                   / 3.6e9 AS age FROM analytics_tokens)
        SELECT 'ingestion' AS "check", CASE WHEN broken > 0 THEN 'warn' WHEN age > 6 THEN 'fail' WHEN age > 2 THEN 'warn'
                 ELSE 'pass' END AS status,
               format('ingested {:.1f} h ago', age) || CASE WHEN broken > 0 THEN format(', {} failed', broken)
                 ELSE '' END AS message FROM m
        UNION ALL
        SELECT 'tokens', CASE WHEN failed > 0 OR stale > 0 OR rug > 0 THEN 'warn' ELSE 'pass' END,
               format('{} tokens, {} verified', ok + pending + failed + stale, ok)
               || CASE WHEN failed > 0 THEN format(', {} failed', failed) ELSE '' END
               || CASE WHEN stale > 0 THEN format(', {} stale', stale) ELSE '' END
               || CASE WHEN rug > 0 THEN format(', {} rug-flagged', rug) ELSE '' END FROM m
        UNION ALL
        SELECT 'retirement', 'pass', format('{} retired in 30 days, {} rug-flagged, {} stale', retired, rug,
               all_stale) FROM m""")),
    "m13_alerts": (m13_alerts, over(_T, """
        WITH m AS (
          SELECT count(*) FILTER (WHERE is_active AND last_ingestion_status = 'failed') AS broken,
                 count(*) FILTER (WHERE verification_status = 'rug_flagged') AS rug,
                 count(*) FILTER (WHERE verification_status = 'stale') AS stale FROM analytics_tokens)
        SELECT 'warning' AS severity, 'ingestion' AS source, 'ingestion late or partly failed' AS message FROM m
        WHERE broken > 0
        UNION ALL SELECT 'warning', 'tokens', 'tokens failed, stale or flagged' FROM m
        UNION ALL SELECT 'warning', 'ingestion', format('failed ingestions: {}', broken) FROM m WHERE broken > 10
        UNION ALL SELECT 'warning', 'retirement', format('possible rug pulls: {}', rug) FROM m
        WHERE rug > 0
        UNION ALL SELECT 'warning', 'retirement', format('stale tokens: {}', stale) FROM m
        WHERE stale > 5""")),
    "m13_report": (m13_report, over(_T, """
        WITH m AS (
          SELECT count(*) FILTER (WHERE is_active AND verification_status = 'verified') AS active_tokens,
                 count(*) FILTER (WHERE is_active AND last_ingestion_status = 'failed') AS failed_ingestions,
                 count(*) FILTER (WHERE verification_status = 'retired' AND updated_at > TIMESTAMP '2024-05-31 00:00:00')
                   AS retired_tokens_30d,
                 count(*) FILTER (WHERE verification_status = 'rug_flagged') AS flagged_rug,
                 count(*) FILTER (WHERE verification_status = 'stale') AS flagged_stale,
                 CAST(floor(coalesce(avg((epoch_us(updated_at) - epoch_us(last_ingested_at)) / 1000) FILTER (
                   WHERE last_ingestion_status = 'success' AND updated_at > TIMESTAMP '2024-06-29 00:00:00'), 0) + 0.5)
                   AS BIGINT) AS avg_ingestion_latency_ms FROM analytics_tokens)
        SELECT 'degraded' AS overall, CASE WHEN failed_ingestions > 10 THEN 2 ELSE CASE WHEN failed_ingestions > 0 THEN 1
               ELSE 0 END END + 1 + CASE WHEN flagged_rug > 0 THEN 1 ELSE 0 END
               + CASE WHEN flagged_stale > 5 THEN 1 ELSE 0 END AS alerts, * FROM m""")),
}

# What a table in buckets holds after its merges equals the merge of everything.
for _name, _query, _same in [
    ("m2_stored_registry", m2_stored_registry, "m2_register_discovered"),
    ("m3_stored_registry", m3_stored_registry, "m3_seed_deactivate"),
    ("m4_stored_registry", m4_stored_registry, "m4_sparse_update"),
]:
    QUERIES[_name] = (_query, QUERIES[_same][1])
