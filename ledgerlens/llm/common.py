"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separators of several contracts.  Fixed value.
ASCII_SPACE = "\t\n\x0b\x0c\r "

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset, as in tests, a folder of the warehouse is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints").rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that a lost executor costs no recomputation of what led here."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later step reads."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the table already has such a column."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def held_back(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held back."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def slices(
    batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of one text column, or a single row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + (size or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def repeated(df: DataFrame, copies: str, run: int = 1000) -> DataFrame:
    """Each row as often as its column ``copies`` says, and that column gone.

    A row with very many copies is cut into runs first, which are dealt to all tasks before they are written out.
    """
    (part,) = fresh(df, "run_part")
    few = df.filter(F.col(copies) <= run).withColumn(part, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))))
    runs = (
        df.filter(F.col(copies) > run)
        .withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(copies) - 1) / run))))
        .withColumn(copies, F.least(F.lit(run).cast("bigint"), F.col(copies) - F.col(part) * run))
    )
    dealt = runs.repartition(part).withColumn(part, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))))
    return few.unionByName(dealt).drop(copies, part)
