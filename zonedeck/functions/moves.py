"""Moves between fields, reference modification, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .digits import unscaled

#: What each figurative constant fills with.
FIGURATIVE = {"ZERO": "0", "SPACE": " ", "HIGH-VALUE": "ÿ", "LOW-VALUE": "\u0000", "QUOTE": '"'}


def move_text(source: Column, length: int, justified_right: bool = False) -> Column:
    """Left-justified, padded with spaces, cut at the right."""
    return F.lpad(F.right(source, F.lit(length)), length, " ") if justified_right else F.rpad(source, length, " ")


def move_display(source: Column, digits: int, scale: int = 0, signed: bool = False) -> Column:
    """Digits of a DISPLAY field: right-justified, zero-filled, high-order digits cut. More fraction digits than the scale raise."""
    text, lost, negative = unscaled(source, scale)
    kept = F.right(F.lpad(text, 38, "0"), F.lit(digits))
    shown = F.when(negative, F.concat(F.lit("-"), kept)).otherwise(kept) if signed else kept
    return F.when(lost, F.raise_error(F.lit("CBL-RT-DECIMAL: fraction digits would be lost"))).otherwise(shown)


def move_figurative(name: str, length: int) -> Column:
    return F.repeat(F.lit(FIGURATIVE[name]), F.lit(length))


def move_group(source: Column, length: int) -> Column:
    """A byte copy: cut or padded with spaces, never decoded."""
    return F.concat(F.substring(source, 1, length), F.substring(F.lit(b" " * length), 1, F.greatest(F.lit(0), F.lit(length) - F.octet_length(source))))


def group_bytes(*children: Column) -> Column:
    return F.concat(*children)


def move_corresponding(df: DataFrame, source: str, target: str) -> Column:
    """The target struct with the source's values where simple names agree."""
    have = {f.name for f in df.schema[source].dataType.fields}
    return F.struct(*[(F.col(source)[f.name].cast(f.dataType) if f.name in have else F.col(target)[f.name]).alias(f.name) for f in df.schema[target].dataType.fields])


def reference_modified(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """X(start:length), from 1; an omitted length takes the rest. A range outside the text raises."""
    start = F.lit(start) if isinstance(start, int) else start
    size = F.length(text)
    n = size - start + 1 if length is None else F.lit(length) if isinstance(length, int) else length
    bad = (start < 1) | (start > size + 1) | (n < 0) | (start + n - 1 > size)
    return F.when(bad, F.raise_error(F.lit("CBL-RT-REFERENCE-MODIFICATION"))).otherwise(F.substring(text, start, n))


def subscripted(table: Column, index: Column | int) -> Column:
    """Element from 1; outside the table raises."""
    index = F.lit(index) if isinstance(index, int) else index
    return F.when((index < 1) | (index > F.size(table)), F.raise_error(F.lit("CBL-RT-SUBSCRIPT"))).otherwise(F.try_element_at(table, index))


def resize_table(table: Column, count: Column, template: Column) -> Column:
    """An ODO table at a new count: cut, or grown with the template."""
    return F.concat(F.slice(table, F.lit(1), count), F.array_repeat(template, F.greatest(F.lit(0), count - F.size(table))))


def display_line(*operands: Column) -> Column:
    """DISPLAY: the operands one after another."""
    return F.concat(*[F.coalesce(o.cast("string"), F.lit("")) for o in operands])


def signed_display(value: Column, width: int) -> Column:
    """A sign in front of zero-filled digits where the value is negative."""
    text, _, negative = unscaled(value, 0)
    return F.concat(F.when(negative, "-").otherwise(""), F.lpad(text, width - 1, "0"))


def read_signed_display(text: Column) -> Column:
    """The number of digits with one leading or trailing sign."""
    plain = F.trim(text)
    turned = F.when(plain.rlike(r"[+-]$"), F.concat(F.right(plain, F.lit(1)), F.regexp_replace(plain, r"[+-]$", ""))).otherwise(plain)
    return turned.try_cast("decimal(38,0)")
