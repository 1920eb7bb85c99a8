"""Token amounts: exact base units, decimal text, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed text formats of amounts.
DECIMAL_TEXT = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"
PLAIN_DECIMAL_TEXT = r"^[0-9]+(\.[0-9]+)?$"
INTEGER_TEXT = r"^[0-9]+$"

UNITS = "decimal(38,0)"


def ui_amount(raw: Column, decimals: Column) -> Column:
    """Base units as a double in display units."""
    return raw.cast("double") / F.pow(F.lit(10.0), decimals)


def is_decimal_text(text: Column) -> Column:
    """True for digits with at most one dot; false for null and blank text."""
    return F.coalesce(F.trim(text).rlike(DECIMAL_TEXT), F.lit(False))


def decimal_text(text: Column) -> Column:
    """Decimal text of any length without superfluous zeros, null for other text: equal numbers have equal texts."""
    trimmed = F.trim(text)
    whole = F.regexp_replace(F.substring_index(trimmed, ".", 1), "^0+(?=[0-9])", "")
    fraction = F.regexp_replace(_fraction(trimmed), "0+$", "")
    front = F.when(whole == "", "0").otherwise(whole)
    return F.when(is_decimal_text(text), F.when(fraction == "", front).otherwise(F.concat_ws(".", front, fraction)))


def decimal_order(text: Column) -> Column:
    """A value that compares like the number in decimal text of any length; null for other text."""
    trimmed = F.trim(text)
    whole = F.regexp_replace(F.substring_index(trimmed, ".", 1), "^0+", "")
    fraction = F.regexp_replace(_fraction(trimmed), "0+$", "")
    return F.when(is_decimal_text(text), F.struct(F.length(whole).alias("digits"), whole.alias("whole"), fraction.alias("fraction")))


def finite_number(text: Column) -> Column:
    """Double value of a text, null for text that is no number and for NaN and infinities."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def is_finite(value: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def is_integer_text(text: Column) -> Column:
    """True for digits of any length; false for null, signs and points."""
    return F.coalesce(F.trim(text).rlike(INTEGER_TEXT), F.lit(False))


def parse_integer(text: Column) -> Column:
    """Exact value of an unsigned integer text, null for anything else."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(INTEGER_TEXT), trimmed.try_cast(UNITS))


def _fraction(text: Column) -> Column:
    return F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1)).otherwise(F.lit(""))


def to_base_units(text: Column, decimals: Column) -> Column:
    """Decimal text in base units; null when malformed or with more digits than ``decimals``."""
    trimmed = F.trim(text)
    fraction = _fraction(trimmed)
    digits = F.concat(F.substring_index(trimmed, ".", 1), F.rpad(fraction, decimals, F.lit("0")))
    valid = is_decimal_text(text) & (decimals >= 0) & (F.length(fraction) <= decimals)
    return F.when(valid, digits.try_cast(UNITS))


def truncate_to_base_units(text: Column, decimals: Column) -> Column:
    """Like :func:`to_base_units`, but extra fraction digits are cut off and a bare dot is malformed."""
    trimmed = F.trim(text)
    fraction = F.rpad(F.substring(_fraction(trimmed), F.lit(1), decimals), decimals, F.lit("0"))
    digits = F.concat(F.substring_index(trimmed, ".", 1), fraction)
    return F.when(trimmed.rlike(PLAIN_DECIMAL_TEXT), digits.try_cast(UNITS))


def format_base_units(raw: Column, decimals: Column) -> Column:
    """Base units as decimal text without trailing zeros."""
    text = with_point(F.abs(raw.cast(UNITS)).cast("string"), decimals)
    return F.when(raw < 0, F.concat(F.lit("-"), text)).when(raw >= 0, text)


def with_point(units: Column, decimals: Column) -> Column:
    """Digits of base units, however many, as decimal text without trailing zeros."""
    padded = F.when(F.length(units) <= decimals, F.lpad(units, decimals + 1, F.lit("0"))).otherwise(units)
    whole = F.substring(padded, F.lit(1), F.length(padded) - decimals)
    fraction = F.regexp_replace(F.substring(padded, F.length(padded) - decimals + 1, decimals), "0+$", "")
    return F.when((decimals == 0) | (fraction == ""), whole).otherwise(F.concat_ws(".", whole, fraction))


def plain_text(value: Column) -> Column:
    """Exact decimal as text without trailing zeros."""
    text = value.cast("string")
    return F.when(
        F.instr(text, ".") > 0, F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    ).otherwise(text)


def half_up(value: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(value + 0.5)


def half_even(value: Column, places: int) -> Column:
    """Rounded with halves to the even digit."""
    return F.bround(value, places)
