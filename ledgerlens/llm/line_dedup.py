"""Boilerplate lines by their frequency relative to the site.

Per host, the pages that contain a line are counted and divided by the pages of the host; lines beyond a ratio are
boilerplate and are dropped from the pages of that host.  Rows are counted per (host, line) after a partial count in
every task, so a host with a third of all pages moves no more rows than its distinct lines per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage, fresh

#: A line is boilerplate when more than this share of the pages of its host contain it.
RATIO = 0.1

#: ... and at least this many pages do: on a host with few pages a share says nothing.
LEAST_PAGES = 5

#: Hashes and hosts that are sent to every task at most (16 MB); beyond that pages and lines are shuffled, salted.
BROADCAST_HASHES, SALTS = 1_000_000, 64


def line_keys(text: Column) -> Column:
    """Hashes of the lines of a text that hold anything, in order."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line) != "")
    return F.transform(lines, lambda line: F.xxhash64(F.trim(line)))


def boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """Rows of (host, lines): the hashes of the boilerplate lines of each host that has any.

    A host has fewer than (mean distinct lines of its pages) / ratio of them, however many pages it has.
    """
    held = pages.filter(F.col(host).isNotNull())
    totals = held.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("_pages"))
    containing = (
        held.select(F.col(host).alias("_host"), F.explode(F.array_distinct(line_keys(F.col(text)))).alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("_containing"))
        .filter(F.col("_containing") >= least_pages)
    )
    return (
        containing.join(totals, "_host")
        .filter(F.col("_containing") > ratio * F.col("_pages"))
        .groupBy("_host")
        .agg(F.sort_array(F.collect_list("_line")).alias("_lines"))
    )


def drop_boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    count: str | None = "n_dropped",
) -> DataFrame:
    """Every page with its boilerplate lines taken out of ``text``, and how many lines went in the column ``count``.

    Lines are compared without surrounding blanks; blank lines are never boilerplate and stay.  A null text stays null,
    an empty one empty; pages with a null host belong to no site and keep their lines.  Repeated rows are pages of their
    own and stay repeated.  Other columns stay as they are; one named like ``count`` is replaced.  Without ``count`` the
    columns are those of the pages.
    """
    on, drop, salt = fresh(pages, "host", "lines_to_drop", "salt")
    found = cut_lineage(boilerplate(pages, host, text, ratio, least_pages).toDF(on, drop))
    kept = [c for c in pages.columns if c != count]
    hashes = found.agg(F.sum(F.size(drop)), F.count(F.lit(1))).first()
    if (hashes[0] or 0) + hashes[1] <= BROADCAST_HASHES:
        joined = pages.join(F.broadcast(found), F.col(host) == F.col(on), "left")
    else:
        # Too many hosts to send to every task: the pages of a host are dealt to SALTS tasks, each with its lines.
        copies = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = pages.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        joined = dealt.join(copies.withColumnRenamed(salt, f"{salt}_of"), (F.col(host) == F.col(on)) & (F.col(salt) == F.col(f"{salt}_of")), "left")
    lines = F.split(F.col(text), "\n", -1)
    rest = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col(drop), F.xxhash64(F.trim(line))))
    dropped = F.when(F.col(drop).isNotNull() & F.col(text).isNotNull(), F.size(lines) - F.size(rest)).otherwise(0)
    cleaned = F.when(dropped > 0, F.array_join(rest, "\n")).otherwise(F.col(text)).alias(text)
    told = [dropped.cast("bigint").alias(count)] if count else []
    return joined.select(*[cleaned if c == text else F.col(c) for c in kept], *told)
