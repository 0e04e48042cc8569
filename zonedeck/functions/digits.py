"""Digit strings of decimals: what every numeric encoder starts from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unscaled(x: Column, scale: int) -> tuple[Column, Column, Column]:
    """(digits at that scale without leading zeros, whether non-zero digits were cut off, whether negative) of a decimal."""
    wide = x.cast("decimal(38,18)")
    parts = F.split(F.abs(wide).cast("string"), r"\.")
    fraction = F.rpad(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 18, "0")
    kept = F.concat(parts[0], F.substring(fraction, 1, scale)) if scale else parts[0]
    digits = F.regexp_replace(kept, r"^0+(?=\d)", "")
    return digits, F.substring(fraction, scale + 1, 18).rlike("[1-9]"), wide < 0


def units(x: Column, scale: int, total: int = 18) -> tuple[Column, Column, Column]:
    """(digits at that scale as a number, null if there are more than `total`; whether non-zero digits were cut off; whether negative) of a decimal.

    bigint up to 18 digits, else a decimal. Numbers, not strings, so that what encodes them stays small code.
    """
    wide = x.cast("decimal(38,18)")
    size = F.abs(wide)
    kept = F.floor(size, F.lit(scale))
    number = kept.try_cast(f"decimal({total},{scale})")
    if scale:
        number = number * F.lit("1" + "0" * scale).cast(f"decimal({scale + 1},0)")
    return number.cast("bigint" if total <= 18 else f"decimal({total},0)"), kept != size, wide < 0


def as_decimal(digits: Column, total: int, scale: int, negative: Column) -> Column:
    """The decimal(total, scale) whose unscaled digits these are, 18 at most; null if they aren't digits."""
    total = max(total, 1)
    number = (digits.try_cast("bigint") * F.when(negative, -1).otherwise(1)).cast("decimal(18,0)")
    return scaled(number, scale).cast(f"decimal({total},{scale})")


def scaled(number: Column, scale: int) -> Column:
    """The whole number over ten to the scale."""
    return number * F.lit("0." + "1".rjust(scale, "0")).cast(f"decimal({scale},{scale})") if scale else number


def ladder(*steps: tuple[Column, str]) -> Column:
    """The code of the first step whose condition holds, null if none does."""
    out = None
    for condition, code in steps:
        out = F.when(condition, code) if out is None else out.when(condition, code)
    return out.otherwise(F.lit(None).cast("string"))
