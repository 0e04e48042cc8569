"""Arithmetic with size errors: a target keeps its old value where the new one doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits that a quotient keeps.
QUOTIENT = "decimal(38,18)"


def divide(a: Column, b: Column) -> Column:
    """Quotient on widened operands; null for a zero divisor."""
    return F.when(b != 0, F.try_divide(a.cast("decimal(38,14)"), F.when(b != 0, b.cast("decimal(19,4)"))))


def fitted(value: Column, digits: int, scale: int, rounded: bool = False, signed: bool = True) -> Column:
    """The value at the target's shape; null is a size error. Without ROUNDED extra fraction digits are one too."""
    wide = value.cast("decimal(38,18)")
    at = F.round(wide, scale)  # half away from zero
    fits = (F.abs(at) < F.lit("1" + "0" * (digits - scale)).cast("decimal(38,18)")) & (F.lit(signed) | (at >= 0))
    if not rounded:
        fits = fits & (at == wide)
    return F.when(fits, at.cast(f"decimal({max(digits, 1)},{scale})"))


def compute(value: Column, old: Column, digits: int, scale: int = 0, rounded: bool = False, signed: bool = True) -> Column:
    """COMPUTE ... ON SIZE ERROR: struct<value, size_error>; on a size error the old value stays."""
    new = fitted(value, digits, scale, rounded, signed)
    return F.struct(F.coalesce(new, old.cast(f"decimal({max(digits, 1)},{scale})")).alias("value"), new.isNull().alias("size_error"))


def strict(op: str, a: Column, b: Column, digits: int, scale: int = 0) -> Column:
    """Plain ADD, SUBTRACT, MULTIPLY, DIVIDE: raises where the result doesn't fit or the divisor is zero."""
    got = fitted({"+": a + b, "-": a - b, "*": a * b, "/": divide(a, b)}[op], digits, scale)
    return F.when(got.isNull(), F.raise_error(F.lit("CBL-RT-DECIMAL: size error"))).otherwise(got)


def numval(text: Column) -> Column:
    """FUNCTION NUMVAL: the trimmed text as a decimal; raises if it isn't one."""
    got = F.trim(text).try_cast("decimal(38,18)")
    return F.when(text.isNotNull() & got.isNull(), F.raise_error(F.lit("CBL-RT-DECIMAL: NUMVAL"))).otherwise(got)


def ord_of(text: Column) -> Column:
    """FUNCTION ORD: the first byte's value."""
    return F.ascii(text)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)
