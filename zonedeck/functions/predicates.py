"""Conditions: relations, class and sign tests, condition names, EVALUATE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digits import ladder

ANY = object()


def padded(a: Column, b: Column) -> tuple[Column, Column]:
    """Both texts, the shorter with spaces up to the longer."""
    n = F.greatest(F.length(a), F.length(b))
    return F.rpad(a, n, F.lit(" ")), F.rpad(b, n, F.lit(" "))


def ebcdic_rank(text: Column) -> Column:
    """A text that sorts by bytes as the EBCDIC collation does: space, lower case, upper case, digits; others keep their code."""
    letters = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    # Ranks lie above every other byte, in order.
    ranks = "".join(chr(0x0400 + k) for k in range(len(letters)))
    return F.translate(text, letters, ranks)


def compare(a: Column, op: str, b: Column, text: bool = False, collation: str = "ascii") -> Column:
    """a op b. Numbers compare as decimals; texts with the shorter padded, by bytes or in EBCDIC order."""
    if text:
        a, b = padded(a, b)
        if collation == "ebcdic":
            a, b = ebcdic_rank(a), ebcdic_rank(b)
    else:
        a, b = a.cast("decimal(38,18)"), b.cast("decimal(38,18)")
    return {"=": a == b, "<>": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def is_numeric(text: Column, signed: bool = True) -> Column:
    """Digits, with one leading or trailing sign where the picture has one."""
    return F.coalesce(text.rlike(r"^([+-]?[0-9]+|[0-9]+[+-])$" if signed else r"^[0-9]+$"), F.lit(False))


def is_alphabetic(text: Column, case: str | None = None) -> Column:
    """Letters and spaces only; case: upper or lower. An empty text is."""
    return F.coalesce(text.rlike({None: "^[A-Za-z ]*$", "upper": "^[A-Z ]*$", "lower": "^[a-z ]*$"}[case]), F.lit(False))


def sign_test(x: Column, sign: str) -> Column:
    return {"positive": x > 0, "negative": x < 0, "zero": x == 0}[sign]


def condition_name(parent: Column, singles: Sequence = (), ranges: Sequence[tuple] = ()) -> Column:
    """An 88-level condition: any single value equals, or any range holds its ends too."""
    out = F.lit(False)
    if singles:
        out = parent.isin(*singles)
    for low, high in ranges:
        out = out | parent.between(low, high)
    return F.coalesce(out, F.lit(False))


def first_value(singles: Sequence = (), ranges: Sequence[tuple] = ()):
    """What SET condition TO TRUE writes: the first value, or the first range's start."""
    return singles[0] if singles else ranges[0][0]


def evaluate(subjects: Sequence[Column], whens: Sequence[tuple[Sequence, Column]], other: Column | None = None) -> Column:
    """EVALUATE with ALSO: the result of the first row whose patterns all match.

    A pattern is ANY, a value, a (low, high) range, or a boolean Column.
    """
    out = None
    for patterns, result in whens:
        if len(patterns) != len(subjects):
            raise ValueError("CBL-RT-CONDITION: as many patterns as subjects are needed")
        hit = F.lit(True)
        for s, p in zip(subjects, patterns):
            if p is ANY:
                continue
            hit = hit & (p if isinstance(p, Column) else s.between(*p) if isinstance(p, tuple) else s == p)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise(other) if other is not None else out


__all__ = ["ANY", "compare", "condition_name", "ebcdic_rank", "evaluate", "first_value", "is_alphabetic", "is_numeric", "ladder", "padded", "sign_test"]
