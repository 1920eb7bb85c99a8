"""Text helpers: short addresses, list fields, humanised numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_address(address: Column) -> Column:
    """First and last four characters."""
    return F.concat(F.left(address, F.lit(4)), F.lit("..."), F.right(address, F.lit(4)))


def first_eight(address: Column) -> Column:
    return F.substring(address, 1, 8)


def split_list(text: Column) -> Column:
    """Comma-separated text as an array of trimmed, non-empty entries; null text gives an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.length(p) > 0)


def currency(value: Column) -> Column:
    """$1.2B, $3.4M, $5.6K or $7.89."""
    return (
        F.when(value >= 1e9, F.format_string("$%.1fB", value / 1e9))
        .when(value >= 1e6, F.format_string("$%.1fM", value / 1e6))
        .when(value >= 1e3, F.format_string("$%.1fK", value / 1e3))
        .otherwise(F.format_string("$%.2f", value))
    )


def compact_number(value: Column) -> Column:
    """1.2M, 3.4K, or the number itself without a trailing .0."""
    whole = value == F.floor(value)
    return (
        F.when(value >= 1e6, F.format_string("%.1fM", value / 1e6))
        .when(value >= 1e3, F.format_string("%.1fK", value / 1e3))
        .when(whole, value.cast("bigint").cast("string"))
        .otherwise(value.cast("string"))
    )


def signed_percent(ratio: Column) -> Column:
    """Ratio as a percentage with an explicit plus sign."""
    sign = F.when(ratio >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, F.format_string("%.2f%%", ratio * 100))


def grouped_thousands(text: Column) -> Column:
    """Commas between thousands of the whole part; the fraction is left as written."""
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"\B(?=(\d{3})+(?!\d))", ",")
    fraction = F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1))
    return F.concat_ws(".", whole, F.when(fraction != "", fraction))


def relative_time(at: Column, as_of: Column) -> Column:
    """Age as '12s ago', '5m ago', '3h ago' or '2d ago'."""
    seconds = F.floor((F.unix_micros(as_of) - F.unix_micros(at)) / 1_000_000)
    return (
        F.when(seconds < 60, F.format_string("%ds ago", seconds))
        .when(seconds < 3600, F.format_string("%dm ago", F.floor(seconds / 60)))
        .when(seconds < 86400, F.format_string("%dh ago", F.floor(seconds / 3600)))
        .when(seconds >= 86400, F.format_string("%dd ago", F.floor(seconds / 86400)))
    )


def title_case(text: Column) -> Column:
    """Words of a snake_case name, each with its first letter raised."""
    words = F.filter(F.split(F.translate(text, "_", " "), " "), lambda w: w != "")
    raised = F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
    return F.array_join(raised, " ")


def contains_ignore_case(text: Column, needle: str) -> Column:
    return F.lower(text).contains(needle.lower())
