"""Balances per owner and top holders kept up by signed deltas of account updates.

A batch of updates is merged into the accounts it names, and an account keeps the batch that changed it last with what it
held before; what the changed accounts give to and take from an owner is summed per owner and added to the stored balance,
and the stored top list of a mint is mended by the owners that changed.  A batch reads and rewrites the buckets it touches
only, each merge moves its rows once and writes them once, and a snapshot reads the top lists alone.

Every step can be run again: accounts keep their newest entry whatever is merged twice, the deltas of a batch follow from
the accounts that it changed, and a balance carries the batch that it was changed by last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators.holders import TOP_HOLDERS, last_entries, top_holders
from ledgerlens.operators.skew import kept_until_end, materialise
from ledgerlens.sources import keyed
from ledgerlens.sources.tables import _file_system, stored_schema
from ledgerlens.streaming.holders import batches

ENTRY = "account string, mint string, owner string, amount decimal(20,0), slot bigint, seq bigint"
ACCOUNT = f"{ENTRY}, batch bigint, was struct<mint:string,owner:string,amount:decimal(20,0)>"
BALANCE = "mint string, owner string, amount decimal(38,0), batch bigint"
TOP = "mint string, owner string, amount decimal(38,0), rank int"
DELTA = "mint string, owner string, delta decimal(38,0)"

OWNER = ["mint", "owner"]


def start(spark: SparkSession, root: str, buckets: int = keyed.BUCKETS) -> None:
    """Empty tables of accounts, owners and top lists; tables that are there stay."""
    for name, schema, keys in [("accounts", ACCOUNT, ["account"]), ("owners", BALANCE, OWNER), ("top", TOP, ["mint"])]:
        if stored_schema(spark, f"{root}/{name}") is None:
            keyed.create_keyed(spark.createDataFrame([], schema), f"{root}/{name}", keys, buckets)


def renew(known: DataFrame, newest: DataFrame, batch: int, path: str) -> DataFrame:
    """Accounts with their newest entries; those that a batch changes get its number and what they held before.

    Both sides have one entry per account.  An entry that is not newer than the known one changes nothing.
    """
    for column, kind in (("batch", "bigint"), ("was", "struct<mint:string,owner:string,amount:decimal(20,0)>")):
        if column not in known.columns:  # a table from before accounts had them
            known = known.withColumn(column, F.lit(None).cast(kind))
    entry = F.struct("mint", "owner", F.col("amount").cast("decimal(20,0)").alias("amount"), "slot", "seq")
    # Marks of earlier batches are of no use any more.
    mark = F.when(F.col("batch") == batch, F.struct("batch", "was"))
    sides = known.select("account", entry.alias("_entry"), F.lit(True).alias("_known"), mark.alias("_mark")).unionByName(
        newest.select("account", entry.alias("_entry"), F.lit(False).alias("_known")), allowMissingColumns=True
    )
    rows, keys = keyed.deal(sides, path)
    both = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("_known"), F.col("_entry"))).alias("_old"),
        F.max(F.when(~F.col("_known"), F.col("_entry"))).alias("_new"),
        F.max("_mark").alias("_mark"),
    )

    def at(side: str) -> Column:
        return F.struct(f"{side}.slot", f"{side}.seq")

    def tie(side: str) -> Column:
        amount = F.col(f"{side}.amount")
        return F.struct(f"{side}.mint", f"{side}.owner", amount.isNull().alias("none"), (-amount).alias("amount"))

    # The order of last_entries.
    later = (at("_new") > at("_old")) | ((at("_new") == at("_old")) & (tie("_new") < tie("_old")))
    newer = F.col("_new").isNotNull() & (F.col("_old").isNull() | later)
    before = F.when(F.col("_old").isNotNull(), F.struct("_old.mint", "_old.owner", "_old.amount"))
    marked = both.withColumn("_newer", newer)
    return marked.select(
        keyed.BUCKET,
        "account",
        *[F.when(F.col("_newer"), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in ("mint", "owner", "amount", "slot", "seq")],
        F.when(F.col("_newer"), F.lit(batch)).otherwise(F.col("_mark.batch")).cast("bigint").alias("batch"),
        F.when(F.col("_newer"), before).otherwise(F.col("_mark.was")).alias("was"),
    )


def deltas(accounts: DataFrame, batch: int) -> DataFrame:
    """What owners win and lose by the accounts that a batch changed, zero sums left out.

    A balance that is not positive counts as none, and so does one without mint or owner.
    """
    sides = F.array(
        *[
            F.struct(
                F.col(f"{prefix}mint").alias("mint"),
                F.col(f"{prefix}owner").alias("owner"),
                (F.greatest(F.col(f"{prefix}amount"), F.lit(0)) * sign).cast("decimal(38,0)").alias("delta"),
            )
            for prefix, sign in [("", 1), ("was.", -1)]
        ]
    )
    moved = accounts.filter(F.col("batch") == batch).select(F.inline(sides))
    named = moved.filter(F.col("mint").isNotNull() & F.col("owner").isNotNull() & (F.col("delta") != 0))
    summed = named.groupBy(*OWNER).agg(F.sum("delta").cast("decimal(38,0)").alias("delta"))
    return summed.filter(F.col("delta") != 0)


def add_deltas(owners: DataFrame, changes: DataFrame, batch: int, path: str) -> DataFrame:
    """Balances with the deltas of a batch added once.

    A balance that falls to zero stays until a later batch, so that a repeated batch finds that it was added already.
    """
    known = owners.select(*OWNER, F.col("amount").alias("_value"), F.coalesce("batch", F.lit(-1)).alias("batch"))
    new = changes.select(*OWNER, F.col("delta").alias("_value"))
    # Known balances have a batch, changes have none.
    sides, keys = keyed.deal(known.unionByName(new, allowMissingColumns=True), path)
    both = sides.groupBy(*keys).agg(
        F.max(F.when(F.col("batch").isNotNull(), F.col("_value"))).alias("amount"),
        F.max(F.when(F.col("batch").isNull(), F.col("_value"))).alias("delta"),
        F.max("batch").alias("batch"),
    )
    due = F.col("delta").isNotNull() & (F.coalesce("batch", F.lit(-1)) < batch)
    amount = F.coalesce("amount", F.lit(0).cast("decimal(38,0)"))
    rows = both.select(
        keyed.BUCKET,
        *OWNER,
        F.when(due, amount + F.col("delta")).otherwise(amount).cast("decimal(38,0)").alias("amount"),
        F.when(due, F.lit(batch)).otherwise(F.col("batch")).cast("bigint").alias("batch"),
    )
    return rows.filter((F.col("amount") != 0) | (F.col("batch") >= batch))


def mend_top(top: DataFrame, changed: DataFrame, owners: DataFrame, k: int = TOP_HOLDERS) -> DataFrame:
    """Top lists after some owners changed: ``changed`` has their new balances, ``owners`` all balances.

    An owner who is on no list ranks behind the last of a full list.  So the listed and the changed owners hold the new
    list as long as its last one ranks no lower than the old last one; only lists that got thinner are counted again.
    """
    mints = changed.select("mint").distinct()
    listed = top.join(mints, "mint", "left_semi").select(*OWNER, "amount", "rank")
    # Few of the changed owners are listed: they are found first, so that only they meet the lists.
    gone = changed.select(*OWNER).join(listed.select(*OWNER), OWNER, "left_semi")
    standing = listed.drop("rank").join(gone, OWNER, "left_anti")
    held = top_holders(standing.unionByName(changed.select(*OWNER, "amount").filter(F.col("amount") > 0)), k)
    held = materialise(held, "top-lists")

    def last(rows: DataFrame, name: str) -> DataFrame:
        place = F.struct((-F.col("amount")).alias("amount"), "owner")
        return rows.filter(F.col("rank") == k).select("mint", place.alias(name))

    both = last(listed, "_before").join(last(held, "_after"), "mint", "left")
    thin = materialise(both.filter(F.col("_after").isNull() | (F.col("_after") > F.col("_before"))).select("mint"), "thin")
    rest = top.join(mints, "mint", "left_anti").unionByName(held)
    if thin.isEmpty():
        return rest
    again = owners.filter(F.col("amount") > 0).select(*OWNER, "amount").join(thin, "mint", "left_semi")
    return rest.join(thin, "mint", "left_anti").unionByName(top_holders(again, k))


def _written(spark: SparkSession, path: str) -> bool:
    files, marker = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(marker)


def apply_updates(updates: DataFrame, root: str, batch: int, k: int = TOP_HOLDERS) -> None:
    """Bring the tables below ``root`` up to date with a batch of account updates.

    Batches have rising numbers and one writer; a batch that failed half way is run again with its number and ends with
    the same tables.  Updates may come late and repeat.  Those without account are left out.
    """
    spark = updates.sparkSession
    accounts, owners, top = f"{root}/accounts", f"{root}/owners", f"{root}/top"
    log = f"{root}/deltas"
    with kept_until_end(spark):
        named = updates.filter(F.col("account").isNotNull())
        touched = keyed.merge_keyed(named, accounts, lambda known, new: renew(known, last_entries(new), batch, accounts))
        if not _written(spark, f"{log}/batch={batch}"):
            found = deltas(keyed.read_keyed(spark, accounts, touched), batch)
            found.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").parquet(f"{log}/batch={batch}")
        changes = spark.read.schema(DELTA).parquet(f"{log}/batch={batch}")
        touched = keyed.merge_keyed(changes, owners, lambda known, new: add_deltas(known, new, batch, owners))
        if touched:
            now = keyed.read_keyed(spark, owners, touched).filter(F.col("batch") == batch).select(*OWNER, "amount")
            balances = keyed.read_keyed(spark, owners)
            keyed.merge_keyed(now, top, lambda known, new: mend_top(known, new, balances, k))
    for old in batches(spark, log):
        if old < batch:
            files, folder = _file_system(spark, f"{log}/batch={old}")
            files.delete(folder, True)


def owner_balances(spark: SparkSession, root: str) -> DataFrame:
    """Balance per mint and owner, as of the last batch."""
    return keyed.read_keyed(spark, f"{root}/owners").filter(F.col("amount") > 0).select(*OWNER, "amount")


def top_lists(spark: SparkSession, root: str) -> DataFrame:
    """The largest owners of every mint, as of the last batch."""
    return keyed.read_keyed(spark, f"{root}/top")


def follow_owners(
    updates: DataFrame, root: str, checkpoint: str, available_now: bool = False, buckets: int = keyed.BUCKETS
) -> StreamingQuery:
    """Apply a stream of account updates batch by batch; a batch that is run again changes nothing twice."""
    start(updates.sparkSession, root, buckets)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return (
        updates.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, number: apply_updates(rows, root, number))
        .trigger(**trigger)
        .start()
    )
