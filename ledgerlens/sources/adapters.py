"""Domain tables as views over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _as_utc(df: DataFrame) -> DataFrame:
    naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table with its naive timestamps read as UTC."""
    return _as_utc(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer parts than the session has cores, dealt out before per-row work.

    A table of many files already has enough parts and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table as a file stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return _as_utc(reader.parquet(folder))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def supply_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.to_date("ts").alias("date"),
        F.concat(F.lit("mint_"), "event_type").alias("mint"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("ui_supply"),
        F.col("ts").alias("scraped_at"),
        F.col("event_id").alias("slot"),
    )


def token_supply_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return supply_snapshots(spark, folder).select(
        F.col("mint").alias("mint_address"),
        F.col("ui_supply").alias("supply"),
        F.lit(6).alias("decimals"),
        "slot",
        F.col("scraped_at").alias("snapshot_at"),
    )


def network_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderdate").alias("scraped_at"),
        F.col("o_totalprice").alias("total_sol_supply"),
        (F.col("o_totalprice") / 2).alias("circulating_sol_supply"),
        (F.col("o_totalprice") / 3).alias("tps"),
        F.col("o_orderkey").alias("transaction_count"),
        F.col("o_custkey").alias("epoch"),
    )


def token_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the supply mints and of half of the holder mints."""
    kinds = supply_snapshots(spark, folder).select("mint", "symbol").distinct()
    suppliers = table(spark, folder, "supplier").filter("s_suppkey % 2 = 0")
    return kinds.select("mint", "symbol", F.initcap("symbol").alias("name")).unionByName(
        suppliers.select(
            _text("s_suppkey").alias("mint"),
            F.concat(F.lit("S"), _text("s_suppkey")).alias("symbol"),
            F.col("s_name").alias("name"),
        )
    )


def analytics_tokens(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    base = F.lit("2024-06-30 00:00:00").cast("timestamp")
    ago = F.make_dt_interval(size)
    statuses = ["verified", "pending", "failed", "stale", "rug_flagged", "retired"]
    pick = F.element_at(F.array(*[F.lit(s) for s in statuses]), (key % 6).cast("int") + 1)
    return table(spark, folder, "part").select(
        F.concat(F.lit("tok"), _text("p_partkey")).alias("mint_address"),
        F.col("p_brand").alias("symbol"),
        F.col("p_name").alias("name"),
        F.lit(6).alias("decimals"),
        (key % 2 == 0).alias("source_env"),
        (key % 3 == 0).alias("source_db"),
        (key % 5 == 0).alias("source_user_deployment"),
        (key % 7 == 0).alias("source_discovery"),
        F.when(key % 11 != 0, base - ago).alias("last_verified_at"),
        F.array(F.col("p_type")).alias("verification_sources"),
        pick.alias("verification_status"),
        F.when(key % 6 == 2, "RPC verification failed").alias("verification_error"),
        F.lit(0).cast("bigint").alias("holder_count_at_verification"),
        F.lit(0).cast("decimal(38,9)").alias("supply_at_verification"),
        F.lit(None).cast("string").alias("logo_uri"),
        F.lit(None).cast("string").alias("coingecko_id"),
        F.lit(False).alias("jupiter_verified"),
        F.array(F.lower("p_type"), F.lit("stablecoin")).alias("tags"),
        (key % 10 != 0).alias("is_active"),
        size.alias("priority"),
        F.lit(100).alias("min_holders_threshold"),
        (base - F.expr("INTERVAL 90 DAYS")).alias("added_at"),
        (base - ago + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), key % 60)).alias("updated_at"),
        (base - ago).alias("last_ingested_at"),
        F.when(key % 13 == 0, "failed").otherwise("success").alias("last_ingestion_status"),
        F.lit(None).cast("string").alias("last_ingestion_error"),
        F.lit(0).cast("bigint").alias("holder_count"),
        F.lit(0).cast("decimal(38,9)").alias("supply"),
        F.lit(0).cast("bigint").alias("last_slot"),
    )


def account_updates(lines: DataFrame) -> DataFrame:
    """Updates per token account from line items; the account key repeats, so the last write counts."""
    return lines.select(
        F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias("account"),
        _text("l_suppkey").alias("mint"),
        _text("l_partkey").alias("owner"),
        F.when(F.col("l_returnflag") == "R", 0)
        .otherwise(F.col("l_quantity") * 100)
        .cast("decimal(20,0)")
        .alias("amount"),
        F.unix_seconds("l_shipdate").alias("slot"),
        F.col("l_partkey").alias("seq"),
    )


def token_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias("account"),
        _text("l_suppkey").alias("mint"),
        _text("l_partkey").alias("owner"),
        F.col("l_quantity").alias("balance"),
        (F.col("l_quantity") * 100).cast("decimal(38,0)").alias("amount"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("position"),
        F.col("l_shipdate").alias("snapshot_at"),
    )


def holder_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Balance per mint and owner, as one holder snapshot."""
    return (
        token_accounts(spark, folder)
        .groupBy("mint", F.col("owner").alias("holder_address"))
        .agg(F.sum("amount").alias("amount"))
        .withColumn("ui_amount", F.col("amount").cast("double") / 100)
    )


def token_holders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("tok"), _text("l_suppkey")).alias("mint_address"),
        _text("l_partkey").alias("wallet_address"),
        F.col("l_quantity").alias("balance"),
        F.col("l_orderkey").alias("slot"),
        F.col("l_shipdate").alias("snapshot_at"),
    )


def wallet_labels(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    joined = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    return joined.select(
        _text("c_custkey").alias("wallet_address"),
        F.when(F.col("n_regionkey") == 0, "Unknown").otherwise(F.col("n_name")).alias("geography"),
        F.when(key % 4 == 0, "unknown").otherwise(F.lower("c_mktsegment")).alias("attribution_category"),
        F.lit("analytics").alias("source"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"),
        F.when(key % 3 == 0, 1.0).otherwise(0.9).alias("confidence"),
        F.when(key % 3 == 0, "helius+static").otherwise("helius").alias("source_detail"),
    )


def payment_transfers(spark: SparkSession, folder: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("xfr_"), _text("o_orderkey")).alias("id"),
        F.concat(F.lit("org_"), (key % 3).cast("string")).alias("organization_id"),
        F.concat(F.lit("prj_"), (key % 6).cast("string")).alias("project_id"),
        _text("o_custkey").alias("wallet_id"),
        F.concat(F.lit("cp_"), (key % 50).cast("string")).alias("counterparty_id"),
        F.concat(F.lit("src_"), _text("o_custkey")).alias("source_address"),
        F.concat(F.lit("dst_"), (key % 97).cast("string")).alias("destination_address"),
        F.substring("o_orderpriority", 1, 1).alias("token"),
        F.col("o_totalprice").cast("decimal(38,2)").cast("string").alias("amount"),
        F.when(key % 11 == 0, "onramp").otherwise("transfer").alias("type"),
        F.when(key % 2 == 0, "outbound").otherwise("inbound").alias("direction"),
        F.when(status == "P", "processing").when(status == "F", "failed").otherwise("confirmed").alias("status"),
        F.when(key % 7 != 0, F.concat(F.lit("sig_"), _text("o_orderkey"))).alias("signature"),
        F.lit(None).cast("bigint").alias("slot"),
        F.lit(5000).cast("bigint").alias("fee"),
        F.lit(None).cast("string").alias("error"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (key % 30).cast("int"))).alias("updated_at"),
    )


def chain_status(spark: SparkSession, folder: str) -> DataFrame:
    """Chain status for nine of ten signatures."""
    key = F.col("o_orderkey")
    states = F.array(*[F.lit(s) for s in ("confirmed", "finalized", "processed")])
    return (
        table(spark, folder, "orders")
        .filter(key % 10 != 0)
        .select(
            F.concat(F.lit("sig_"), _text("o_orderkey")).alias("signature"),
            (key * 2).alias("slot"),
            F.element_at(states, (key % 3).cast("int") + 1).alias("confirmation_status"),
            F.when(key % 17 == 0, F.lit('{"InstructionError":1}')).alias("err"),
        )
    )


def recurring_payments(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    states = F.array(*[F.lit(s) for s in ("active", "active", "activating", "canceling")])
    return table(spark, folder, "orders").select(
        F.concat(F.lit("rp_"), _text("o_orderkey")).alias("id"),
        F.lit("org_0").alias("organization_id"),
        F.lit("prj_0").alias("project_id"),
        _text("o_orderkey").alias("subscription_id"),
        F.element_at(states, (key % 4).cast("int") + 1).alias("status"),
        F.when(key % 9 != 0, F.col("o_orderdate")).alias("next_collection_due_at"),
        (F.lit(24) * (key % 5 + 1)).cast("int").alias("period_hours"),
        F.col("o_orderdate").alias("updated_at"),
    )


def collection_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts of an order's lines; two of three are for the order's own due date."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("_due")
    )
    lines = table(spark, folder, "lineitem").join(orders, "l_orderkey")
    flag, state = F.col("l_returnflag"), F.col("l_linestatus")
    return lines.select(
        F.concat_ws(
            "-",
            _text("l_orderkey"),
            _text("l_linenumber"),
            _text("l_partkey"),
            _text("l_suppkey"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("id"),
        F.lit("org_0").alias("organization_id"),
        F.lit("prj_0").alias("project_id"),
        _text("l_orderkey").alias("subscription_id"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_shipdate")).otherwise(F.col("_due")).alias("due_at"),
        F.when(flag == "R", "failed")
        .when((flag == "A") & (state == "O"), "processing")
        .when((flag == "A") & (state == "F"), "pending")
        .when(state == "F", "confirmed")
        .otherwise("skipped")
        .alias("status"),
        F.col("l_shipdate").alias("updated_at"),
        F.col("_due").alias("created_at"),
        F.lit(None).cast("string").alias("error"),
        F.to_json(F.struct(F.col("l_linenumber").alias("line"))).alias("metadata"),
    )


def batch_transfers(spark: SparkSession, folder: str) -> DataFrame:
    """Transfers grouped into batches by customer."""
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("batch_id"),
        F.when((status == "P") & (F.col("o_custkey") % 2 == 0), "processing")
        .when(status == "F", "failed")
        .otherwise("confirmed")
        .alias("status"),
    )


def batch_recipients(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a supplier as recipients of one batch."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("batch_id"),
        F.col("l_orderkey").alias("position"),
        F.concat_ws(
            "-",
            _text("l_linenumber"),
            _text("l_partkey"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("recipient_id"),
        F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)").alias("amount"),
    )


def wallet_operations(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id")
    return spread(table(spark, folder, "events")).select(
        F.col("event_id").alias("operation_id"),
        F.concat(F.lit("w"), (user % 4).cast("string")).alias("wallet_scope_id"),
        F.when(user % 3 != 0, F.concat(F.lit("k"), (user % 3).cast("string"))).alias("api_key_scope_id"),
        F.col("event_type").alias("family"),
        F.concat("event_type", F.lit("_request")).alias("type"),
        F.concat(F.lit("asset"), (user % 5).cast("string")).alias("asset"),
        F.when(F.col("event_id") % 19 == 0, F.lit(None))
        .otherwise(F.col("value").cast("decimal(38,2)").cast("string"))
        .alias("amount"),
        F.concat(F.lit("dest"), (user % 7).cast("string")).alias("destination"),
    )


#: Policies over the operations above, one rule of every kind.
POLICIES = [
    (
        "wallet", "w0", "p0", "r0", "allow",
        '[{"id":"max","kind":"amount","asset":"asset1","max":"100"},'
        '{"id":"dest","kind":"destination","blocklist":["dest3"]},'
        '{"id":"appr","kind":"approval","families":["purchase"]}]',
    ),
    (
        "wallet", "w1", "p1", "r1", "deny",
        '[{"id":"fam","kind":"operation_family","families":["view","click"]},'
        '{"id":"type","kind":"operation_type","operationTypes":["signup_request"],"action":"review"},'
        '{"id":"asset","kind":"asset","assets":["asset2"],"action":"provider_approval_required"}]',
    ),
    (
        "wallet", "w2", "p2", "r2", "review",
        '[{"id":"allow","kind":"destination","allowlist":["dest1","dest2"]},'
        '{"id":"min","kind":"amount","min":"10"},{"id":"bad","kind":"amount","max":"not-a-number"}]',
    ),
    ("wallet", "w3", "p3", None, "allow", "[]"),
    (
        "api_key", "k1", "p4", "r4", "allow",
        '[{"id":"odd","kind":"velocity"},{"id":"any","kind":"always"}]',
    ),
    (
        "api_key", "k2", "p5", "r5", "allow",
        '[{"id":"cap","kind":"amount","max":"50","action":"approval_required"}]',
    ),
]


def policies(spark: SparkSession) -> DataFrame:
    names = ["scope", "scope_id", "profile_id", "revision_id", "default_action", "rules"]
    rows = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, row)]) for row in POLICIES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def balances(spark: SparkSession, folder: str) -> DataFrame:
    """One balance per order, held by its customer; a few amounts are malformed."""
    key = F.col("o_orderkey")
    customer = table(spark, folder, "customer")
    joined = table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    units = F.round(F.col("o_totalprice") * 100).cast("decimal(38,0)").cast("string")
    mint = F.concat(F.lit("m"), F.substring("o_orderpriority", 1, 1), (key % 4).cast("string"))
    return joined.select(
        F.concat_ws("-", _text("c_custkey"), _text("o_orderkey")).alias("wallet_id"),
        F.when(key % 4 == 0, "USDC").when(key % 4 == 1, mint).otherwise("").alias("token"),
        mint.alias("mint"),
        F.when(key % 23 == 0, "n/a").otherwise(units).alias("amount"),
        F.col("o_totalprice").cast("decimal(38,2)").cast("string").alias("ui_amount"),
        F.lit(2).alias("decimals"),
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """A price for every mint except those of the third kind; some are not in dollars, not finite or negative."""
    mints = balances(spark, folder).select("mint").distinct()
    number = F.substring("mint", 2, 1).cast("int")
    return mints.filter(~F.col("mint").endswith("3")).select(
        "mint",
        F.when(F.col("mint") == "m41", float("nan"))
        .when(F.col("mint") == "m12", float("inf"))
        .when(F.col("mint") == "m22", -1.0)
        .otherwise(number * 0.25)
        .alias("price"),
        F.when(number == 5, "EUR").when(number == 2, F.lit(None)).otherwise("usd").alias("currency"),
    )


def screening_results(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    levels = ["Severe risk", "High", "Medium", "Moderate watch", "Low", "None", "", "check passed"]
    return table(spark, folder, "part").select(
        key.alias("screening_id"),
        F.when(key % 8 == 0, "elliptic").when(key % 8 == 1, "trm").otherwise(F.lower("p_type")).alias("provider"),
        F.when(key % 9 == 0, "error").otherwise("ok").alias("status"),
        F.when(key % 3 == 0, size / 5.0).alias("risk_score"),
        F.element_at(F.array(*[F.lit(x) for x in levels]), (size % 8).cast("int") + 1).alias("risk_level"),
    )


def issuance_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Token transactions from suppliers' lines; the parameters depend on the type."""
    kinds = ["mint", "burn", "freeze", "unfreeze", "seize", "force_burn", "update_authority", "pause", "deploy"]
    line = spread(table(spark, folder, "lineitem"))
    part = F.col("l_partkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (part % 9).cast("int") + 1)
    owner = F.concat(F.lit("own_"), (part % 40).cast("string"))
    other = F.concat(F.lit("own_"), ((part + 7) % 40).cast("string"))
    params = F.to_json(
        F.struct(
            owner.alias("destination"),
            other.alias("source"),
            F.concat(F.lit("acc_"), (part % 40).cast("string")).alias("tokenAccount"),
            other.alias("accountAddress"),
            other.alias("currentAuthority"),
            owner.alias("newAuthority"),
            F.col("l_quantity").cast("bigint").cast("string").alias("amount"),
        )
    )
    return line.select(
        F.concat_ws(
            "-",
            _text("l_orderkey"),
            _text("l_linenumber"),
            _text("l_partkey"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("id"),
        F.col("l_suppkey").alias("token_id"),
        F.concat(F.lit("acc_"), (part % 40).cast("string")).alias("token_account"),
        kind.alias("type"),
        params.alias("operation_params"),
        F.lit(None).cast("string").alias("signature"),
        F.col("l_shipdate").alias("created_at"),
    )


def issued_tokens(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("token_id"),
        F.concat(F.lit("org_"), (key % 4).cast("string")).alias("organization_id"),
        F.concat(F.lit("prj_"), (key % 8).cast("string")).alias("project_id"),
        F.when(key % 5 != 0, F.concat(F.lit("tok"), _text("s_suppkey"))).alias("mint_address"),
        F.concat(F.lit("S"), _text("s_suppkey")).alias("symbol"),
        F.col("s_name").alias("name"),
        F.when(key % 3 == 0, "pending").when(key % 3 == 1, "deployed").otherwise("active").alias("status"),
    )


def _quoted(value: Column | str) -> Column:
    """JSON text of a string without characters that JSON escapes."""
    return F.concat(F.lit('"'), F.lit(value) if isinstance(value, str) else value, F.lit('"'))


def _object(**fields: Column) -> Column:
    """JSON text of an object from the JSON texts of its fields; like in ``to_json``, null fields are left out."""
    named = [F.concat(F.lit(f'"{name}":'), text.cast("string")) for name, text in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}"))


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Raw transactions as JSON text, one per line item, in each of three shapes.

    The text is put together from its parts, which takes a fraction of the time of ``to_json`` on nested structs.
    """
    line = spread(table(spark, folder, "lineitem"))
    number = F.col("l_linenumber")
    parts = line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag",
        F.unix_seconds("l_shipdate").alias("seconds"),
        (F.col("l_quantity") * 100).cast("bigint").alias("units"),
        _quoted(F.concat(F.lit("wallet"), (F.col("l_partkey") % 50).cast("string"))).alias("owner_a"),
        _quoted(F.concat(F.lit("wallet"), (F.col("l_suppkey") % 50 + 50).cast("string"))).alias("owner_b"),
        _quoted(F.concat(F.lit("mint"), (F.col("l_suppkey") % 10).cast("string"))).alias("mint"),
    )
    units, owner_a, owner_b, mint = (F.col(c) for c in ("units", "owner_a", "owner_b", "mint"))

    def balance(index: int, owner: Column, amount: Column) -> Column:
        text = _object(
            amount=_quoted(amount.cast("string")), decimals=F.lit(2), uiAmount=amount.cast("double") / 100
        )
        return _object(accountIndex=F.lit(index), mint=mint, owner=owner, uiTokenAmount=text)

    def instruction(program: str, kind: str, **info: Column) -> Column:
        parsed = _object(type=_quoted(kind), info=_object(**info))
        return _list(_object(program=_quoted(program), parsed=parsed))

    native = instruction("system", "transfer", source=owner_a, destination=owner_b, lamports=units)
    minted = instruction(
        "spl-token", "mintTo", account=_quoted("acct1"), mint=mint, mintAuthority=_quoted("auth"),
        amount=_quoted(units.cast("string")),
    )
    moved = instruction(
        "spl-token", "transfer", source=_quoted("acct0"), destination=_quoted("acct1"),
        amount=_quoted(units.cast("string")),
    )
    top = F.when(number % 3 == 0, native).when(number % 3 == 1, minted).otherwise(moved)
    before = _list(balance(0, owner_a, units + 1000), balance(1, owner_b, F.lit(500).cast("bigint")))
    after = _list(balance(0, owner_a, F.lit(1000).cast("bigint")), balance(1, owner_b, units + 500))
    payload = _object(
        slot=F.col("l_orderkey"),
        blockTime=F.col("seconds"),
        meta=_object(
            err=F.when(F.col("l_returnflag") == "R", '{"InstructionError":1}'),
            fee=F.lit(5000),
            # The inner instruction repeats the outer one and must not be counted again.
            innerInstructions=_list(_object(instructions=F.col("top"))),
            preTokenBalances=before,
            postTokenBalances=after,
        ),
        transaction=_object(
            message=_object(accountKeys=F.lit('["acct0","acct1","payer"]'), instructions=F.col("top"))
        ),
    )
    return parts.withColumn("top", top).select(
        F.concat_ws(
            "-",
            _text("l_orderkey"),
            _text("l_linenumber"),
            _text("l_partkey"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("signature"),
        payload.alias("payload"),
    )


def wallets(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of known wallets: every even one of the hundred owners."""
    return (
        table(spark, folder, "customer")
        .select((F.col("c_custkey") % 100).alias("n"))
        .distinct()
        .filter("n % 2 = 0")
        .select(
            F.concat(F.lit("wallet"), _text("n")).alias("address"), F.concat(F.lit("wal_"), _text("n")).alias("wallet_id")
        )
    )
