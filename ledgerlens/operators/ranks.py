"""Order statistics of groups that may hold any share of all rows, without sorting a group in one task.

Borders that cut all rows into stretches of about equal size come from a mergeable quantile sketch, which is partially
aggregated like a sum.  They decide how the work is dealt, not what comes out: rows are ranked exactly within their group
and stretch, and the stretches' sums are added up apart.  However large a group is, its part of a stretch is no more than
the stretch.  The plan is the same whatever the sizes of the groups are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.exact import running_total
from ledgerlens.operators.skew import materialise, middle_value

#: Stretches that all rows are cut into at least; a cluster with a wider shuffle gets as many as that.
LEAST_STRETCHES = 64

#: Parts that the rows of one group are dealt into when they meet a value of their group.
SALTS = 64


def spread_join(rows: DataFrame, values: DataFrame, keys: Sequence[str], salt: str, salts: int = SALTS) -> DataFrame:
    """Left join of ``rows`` with one row per group of ``values``.

    The rows of a group are dealt into ``salts`` parts by the column ``salt``, and each value is repeated as often, so a
    large group is shared by many tasks; where the values are small, Spark sends them to the rows instead.
    """
    keys = list(keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    repeated = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], "left").drop("_salt")


def ranked(df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, str], like: DataFrame | None = None) -> DataFrame:
    """Running and total sums within each group in the order of a number that occurs once in its group.

    For every entry ``name`` of ``sums`` (SQL expressions) the result has ``name_before``, the sum over the rows with
    smaller numbers, and ``name_total``, the sum over the group.  Null numbers come first.  The borders are taken from the
    numbers of ``like``, a table that is cheaper to read than ``df``, if given.
    """
    width = max(LEAST_STRETCHES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    coarse = math.isqrt(width - 1) + 1
    stretches = coarse * coarse
    shares = ", ".join(str(i / stretches) for i in range(1, stretches))
    sketch = (df if like is None else like).agg(F.expr(f"percentile_approx({order}, array({shares}), {10 * stretches}) AS _borders"))
    cut = df.withColumn("_borders", sketch.scalar())
    # The coarse borders first, then those between two of them.
    found = cut.selectExpr(
        "*", f"size(filter(sequence(1, {coarse - 1}), i -> get(_borders, i * {coarse} - 1) < {order})) AS _coarse"
    )
    fine = f"size(filter(slice(coalesce(_borders, array()), _coarse * {coarse} + 1, {coarse - 1}), b -> b < {order}))"
    dealt = found.selectExpr(*df.columns, f"_coarse * {coarse} + {fine} AS _stretch")
    return running_total(dealt, list(keys), [order], "_stretch", sums, totals=True).drop("_stretch")


def exact_medians(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    alias: str = "median",
    extra: Mapping[str, Column] | None = None,
    once: bool = False,
) -> DataFrame:
    """Exact median of ``value`` per group.

    Equal values are counted before anything is ranked, so copies of one value cost one row.  A group without values has
    a null median.  ``extra`` adds aggregates over the distinct values ``_value``, their counts ``n`` and the rows that
    have them, ``n_rows``, nulls included.  With ``once`` the counted values are written before they are ranked: for rows
    that are costly to make.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_value"))
    counted = rows.groupBy(*keys, "_value").agg(F.count("_value").alias("n"), F.count(F.lit(1)).alias("n_rows"))
    if once:
        counted = rows = materialise(counted, "counted")
    more = [column.alias(name) for name, column in (extra or {}).items()]
    return ranked(counted, keys, "_value", {"n": "n"}, like=rows).groupBy(*keys).agg(middle_value("_value").alias(alias), *more)
