"""INSPECT, EXAMINE, STRING and UNSTRING."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tally_all(text: Column, what: str) -> Column:
    """INSPECT TALLYING ALL: occurrences that don't overlap."""
    return F.regexp_count(text, F.lit(re.escape(what))).cast("long")


def replace_all(text: Column, what: str, by: str, length: int | None = None) -> Column:
    """INSPECT REPLACING ALL; length: of the field, to which the result is padded or cut."""
    out = F.replace(text, F.lit(what), F.lit(by))
    return out if length is None else F.rpad(out, length, " ")


def convert(text: Column, source: str, target: str) -> Column:
    """INSPECT CONVERTING: letter by letter."""
    if len(source) != len(target):
        raise ValueError("CBL-RT-UNSUPPORTED-OPERAND: CONVERTING needs equal lengths")
    return F.translate(text, source, target)


def examine(text: Column, what: str, by: str | None = None) -> Column:
    """EXAMINE TALLYING ALL ... REPLACING BY: struct<tally, text>."""
    return F.struct(tally_all(text, what).alias("tally"), (replace_all(text, what, by) if by is not None else text).alias("text"))


def string_into(parts: Sequence[tuple[Column, str | None]], length: int, target: Column | None = None, pointer: Column | None = None) -> Column:
    """STRING: each part up to its delimiter (None: by size). struct<text, pointer, overflow>.

    Without a pointer the rest of the target is blank; with one the target is overlaid from there.
    """
    joined = F.concat(*[p if d is None else F.substring_index(p, d, 1) for p, d in parts])
    if pointer is None:
        return F.struct(F.rpad(joined, length, " ").alias("text"), (F.least(F.length(joined), F.lit(length)) + 1).alias("pointer"), (F.length(joined) > length).alias("overflow"))
    room = F.lit(length) - pointer + 1
    put = F.substring(joined, F.lit(1), F.greatest(room, F.lit(0)))
    bad = (pointer < 1) | (pointer > length)
    text = F.concat(F.substring(F.rpad(target, length, " "), F.lit(1), pointer - 1), put, F.substring(F.rpad(target, length, " "), pointer + F.length(put), F.lit(length)))
    return F.struct(F.when(bad, target).otherwise(text).alias("text"), F.when(bad, pointer).otherwise(pointer + F.length(put)).alias("pointer"), (bad | (F.length(joined) > room)).alias("overflow"))


def unstring(text: Column, delimiter: str, targets: int, every: bool = False, pointer: Column | None = None) -> Column:
    """UNSTRING: struct<parts array of `targets` texts (blank where there is none), counts, tally, overflow>. every: ALL delimiter."""
    rest = text if pointer is None else F.substring(text, pointer, F.length(text))
    pieces = F.split(rest, f"({re.escape(delimiter)})+" if every else re.escape(delimiter))
    got = [F.coalesce(F.get(pieces, F.lit(k)), F.lit("")) for k in range(targets)]
    return F.struct(
        F.array(*got).alias("parts"), F.array(*map(F.length, got)).alias("counts"),
        F.least(F.size(pieces), F.lit(targets)).alias("tally"), (F.size(pieces) > targets).alias("overflow"),
    )
