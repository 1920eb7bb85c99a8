"""Table files: read, append, replace, versions, external views.

The format is one argument everywhere, so a session with a table format on its classpath can use that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerlens.functions.times import moment
from ledgerlens.operators.merge import insert_absent
from ledgerlens.operators.skew import materialise
from ledgerlens.operators.supply import daily_sketches, same_day_merge

#: Holds a table's schema, beside its files.
SCHEMA_FILE = "_schema.json"


def read_object(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """One Parquet object; a declared schema spares reading the footers first."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_prefix(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """All Parquet files below a path; unreadable and vanished files are skipped, other files ignored.

    :func:`skipped_files` names the files of such a read that gave no rows.
    """
    reader = (
        spark.read.option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
    )
    return (reader if schema is None else reader.schema(schema)).parquet(path)


def skipped_files(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Files below a path that :func:`read_prefix` finds but gets no row from: unreadable, vanished or empty ones."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path")
    )
    read = read_prefix(spark, path, schema).select(F.col("_metadata.file_path").alias("path")).distinct()
    return listed.join(read, "path", "left_anti")


def read_table(
    spark: SparkSession, path: str, format: str = "parquet", schema: str | StructType | None = None
) -> DataFrame:
    """A table; columns added over time are null in older files.

    The schema is the declared one, else the one kept with the table.  Only for a table that was written by other means,
    and has none, the footers of all files are read and merged.
    """
    schema = stored_schema(spark, path) if schema is None else schema
    reader = spark.read.format(format)
    reader = reader.option("mergeSchema", "true") if schema is None else reader.schema(schema)
    return reader.load(path)


def _schema_file(spark: SparkSession, path: str):
    """The file that holds a table's schema, which readers of data skip by its name, and its file system."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{SCHEMA_FILE}")
    return file, file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def stored_schema(spark: SparkSession, path: str) -> StructType | None:
    """The schema kept with a table, None where there is none."""
    file, files = _schema_file(spark, path)
    if not files.exists(file):
        return None
    stream = files.open(file)
    try:
        return StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def evolved(known: StructType, new: StructType, path: str, partition: str | None = "date") -> StructType:
    """The known columns, then the new ones; a changed type is an error, but for the partition column."""
    types = {f.name: f.dataType for f in known}
    changed = [
        f"{f.name}: {types[f.name].simpleString()} -> {f.dataType.simpleString()}"
        for f in new
        if f.name in types and f.name != partition and types[f.name] != f.dataType
    ]
    if changed:
        raise ValueError(f"types differ from the table at {path}: {', '.join(changed)}")
    return StructType([*known, *(f for f in new if f.name not in types)])


def _keep_schema(df: DataFrame, path: str, partition: str | None, format: str) -> None:
    """Evolve the schema kept with a table by that of rows to be written; the table's files are not opened.

    It is written before the rows: a column without rows is null, rows without their column would be lost.
    """
    spark = df.sparkSession
    known = stored_schema(spark, path)
    if known is None:
        older = read_table_or_none(spark, path, format)
        known = StructType() if older is None else older.schema
    schema = evolved(known, df.schema, path, partition)
    # Files may hold nulls whatever the rows of one write say.
    schema = StructType([StructField(f.name, f.dataType, True, f.metadata) for f in schema])
    if schema != known:
        file, files = _schema_file(spark, path)
        stream = files.create(file, True)
        try:
            stream.write(bytearray(schema.json().encode()))
        finally:
            stream.close()


def read_table_or_none(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame | None:
    """A table, or None when there is none yet."""
    try:
        return read_table(spark, path, format)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace_object(df: DataFrame, path: str) -> None:
    """Replace a Parquet object."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_table(
    df: DataFrame, path: str, mode: str = "append", partition: str | None = "date", format: str = "parquet"
) -> None:
    """Append to a table, or replace exactly the partitions the rows belong to.

    New columns are welcome and a changed type is an error.
    """
    if format == "parquet":
        _keep_schema(df, path, partition, format)
    writer = df.write.format(format).mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition in df.columns:
        writer = writer.partitionBy(partition)
    writer.save(path)


def append_evolving(df: DataFrame, path: str, partition: str | None = "date", format: str = "parquet") -> None:
    """Append where new columns are welcome and a changed type is an error; nothing is ever overwritten."""
    write_table(df, path, "append", partition, format)


def merge_into_day(df: DataFrame, path: str, at: str = "scraped_at") -> None:
    """Add a snapshot to its day; rows that only repeat known values keep the newest time."""
    spark = df.sparkSession
    known = read_table_or_none(spark, path)
    merged = df
    if known is not None:
        same = same_days(known, df).select(*[F.col(f.name).cast(f.dataType) for f in df.schema])
        # The result replaces files it was computed from, so it is written elsewhere first.
        merged = materialise(same_day_merge(same, df, at), "day-merge")
    write_table(merged, path, "overwrite")


def append_json(
    spark: SparkSession, source: str, path: str, as_of: datetime | str | Column, schema: str | None = None
) -> int:
    """Append landed JSON rows, with ``ingested_at`` where it is missing; no rows is an error."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.json(source)
    if not rows.columns or (schema is None and rows.isEmpty()):
        raise ValueError("no rows to append")
    if "ingested_at" not in rows.columns:
        rows = rows.withColumn("ingested_at", moment(as_of))
    # Counted while they are written: with a declared schema the input is read once.
    seen = Observation()
    append_evolving(rows.observe(seen, F.count(F.lit(1)).alias("rows")), path, None)
    count = seen.get["rows"]
    if not count:
        raise ValueError("no rows to append")
    return count


def push_absent(df: DataFrame, path: str, keys: list[str], date: str = "date", at: str | None = None) -> None:
    """Append rows whose key the table does not have; only the days of the new rows are looked at in the table.

    The day must follow from the key, as equal keys would otherwise hide on other days: ``date`` is among the keys, or
    ``at`` is, and the day is then taken from it.  Without either the whole table is looked at.
    """
    if at is not None:
        if at not in keys:
            raise ValueError(f"the day follows from {at}, which is no key")
        df = df.withColumn(date, F.to_date(at))
    known = read_table_or_none(df.sparkSession, path)
    if known is not None and (at is not None or date in keys):
        known = same_days(known, df, date)
    write_table(df if known is None else insert_absent(known, df, keys), path, "append")


def same_days(known: DataFrame, new: DataFrame, date: str = "date") -> DataFrame:
    """Rows of a table partitioned by ``date`` that lie on the days of other rows.

    Partitions outside the first and last of these days are never listed into the scan.
    """
    days = new.select(date).distinct()
    first, last = days.agg(F.min(date)).scalar(), days.agg(F.max(date)).scalar()
    near = known.filter((F.col(date) >= first) & (F.col(date) <= last))
    return near.join(days, date, "left_semi")


def add_sketches(holders: DataFrame, path: str) -> None:
    """Store the daily sketches of the days that the table does not have; of stored days only the dates are read."""
    spark = holders.sparkSession
    known = read_table_or_none(spark, path)
    if known is not None:
        rows = holders.withColumn("_day", F.to_date("snapshot_at"))
        holders = rows.join(known.select(F.col("date").alias("_day")).distinct(), "_day", "left_anti").drop("_day")
    write_table(daily_sketches(holders), path, "append", None)


def register_views(spark: SparkSession, paths: Mapping[str, str]) -> None:
    """Name tables by path for SQL."""
    for name, path in paths.items():
        read_table(spark, path).createOrReplaceTempView(name)


def register_tables(spark: SparkSession, paths: Mapping[str, str], format: str = "parquet") -> None:
    """External tables over paths: the catalog keeps their schema, dropping a table leaves its files.

    A name that is taken is pointed at its path anew; partition folders are found once, here.
    """
    for name, path in paths.items():
        location = path.replace("'", "\\'")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} USING {format} OPTIONS (mergeSchema 'true') LOCATION '{location}'")
        if any(column.isPartition for column in spark.catalog.listColumns(name)):
            spark.catalog.recoverPartitions(name)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of a versioned table, oldest first."""
    files, location = _file_system(spark, root)
    if not files.exists(location):
        return []
    found = []
    for entry in files.listStatus(location):
        name = entry.getPath().getName()
        marker = entry.getPath().suffix("/_SUCCESS")
        if name.startswith("version=") and files.exists(marker):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def publish_version(df: DataFrame, root: str) -> str:
    """Write the next version of a table; readers see it once its job has committed.

    The rows are written to a folder of their own, which is then renamed to the next free number.  The rename fails
    where another writer was faster, and the number after that is tried: no writer replaces another's version.
    """
    spark = df.sparkSession
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    df.write.option("partitionOverwriteMode", "static").parquet(draft)
    files, location = _file_system(spark, draft)
    number = (versions(spark, root) or [0])[-1] + 1
    while True:
        path = f"{root}/version={number}"
        _, target = _file_system(spark, path)
        if not files.exists(target) and files.rename(location, target):
            # A rename onto a folder made meanwhile moves into it: that number belongs to the other writer.
            inside = _file_system(spark, f"{path}/{location.getName()}")[1]
            if not files.exists(inside):
                return path
            location = inside
        number += 1


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """A version of a table, by default the newest; None when there is none."""
    known = versions(spark, root)
    if not known:
        return None
    return spark.read.parquet(f"{root}/version={known[-1] if number is None else number}")
