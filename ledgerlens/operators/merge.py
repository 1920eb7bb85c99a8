"""Table maintenance without row updates: one full outer join and a rule per column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import first_per_group

Rule = str | Callable[[Column, Column], Column]

RULES: dict[str, Callable[[Column, Column], Column]] = {
    "keep": lambda old, new: old,
    "replace": lambda old, new: new,
    "coalesce_new": lambda old, new: F.coalesce(new, old),
    "greatest": lambda old, new: F.greatest(new, old),
    "array_union": lambda old, new: F.array_distinct(F.concat(old, new)),
    "array_concat": lambda old, new: F.concat(old, new),
}


def merge_by_key(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    rules: Mapping[str, Rule],
    defaults: Mapping[str, Column] | None = None,
    insert: bool = True,
) -> DataFrame:
    """Target with the updates applied; one row per key when both inputs have one row per key.

    ``rules`` names what happens to a column of a matched row; other columns are kept.  New keys are
    inserted (unless ``insert`` is off) with their own values, then ``defaults``, then null.
    """
    keys, defaults = list(keys), defaults or {}
    types = {f.name: f.dataType for f in target.schema}
    fresh = updates.select(
        *keys,
        *[F.col(c).alias(f"_new_{c}") for c in updates.columns if c not in keys],
        F.lit(True).alias("_updated"),
    )
    both = target.withColumn("_known", F.lit(True)).join(fresh, keys, "outer" if insert else "left")

    def column(name: str) -> Column:
        old = F.col(name)
        given = name in updates.columns
        new = F.col(f"_new_{name}").cast(types[name]) if given else F.lit(None).cast(types[name])
        rule = rules.get(name, "keep")
        combine = RULES[rule] if isinstance(rule, str) else rule
        default = defaults.get(name, F.lit(None)).cast(types[name])
        return (
            F.when(F.col("_known").isNull(), F.coalesce(new, default))
            .when(F.col("_updated"), combine(old, new))
            .otherwise(old)
            .cast(types[name])
            .alias(name)
        )

    return both.select(*[F.col(c) if c in keys else column(c) for c in target.columns])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty for a sound table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def insert_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing`` yet; of several with one key, the smallest row."""
    rest = [F.col(c) for c in new.columns if c not in keys]
    once = first_per_group(new, keys, rest) if rest else new.distinct()
    return once.join(existing.select(*keys), list(keys), "left_anti")
