"""Zoned-decimal (DISPLAY) fields: EBCDIC zones and ASCII overpunch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digits import as_decimal, ladder, units

#: The last byte's letters in ASCII overpunch, for digits 0 to 9.
PLUS, MINUS = "{ABCDEFGHI", "}JKLMNOPQR"


@dataclass(frozen=True)
class Zoned:
    """policy: preferred (C, F, D), non-preferred (A to F), permissive (also zone 0, and zone 4 with digit 0)."""

    digits: int
    scale: int = 0
    signed: bool = True
    encoding: str = "ebcdic"
    policy: str = "preferred"

    def __post_init__(self) -> None:
        if not 1 <= self.digits <= 18 or not 0 <= self.scale <= self.digits:
            raise ValueError("E_SCHEMA: zoned digits must be in 1..=18 and scale at most that")
        if self.encoding not in ("ebcdic", "ascii-overpunch") or self.policy not in ("preferred", "non-preferred", "permissive"):
            raise ValueError("E_SCHEMA: zoned decimal needs ebcdic or ascii-overpunch and a known policy")

    @property
    def byte_len(self) -> int:
        return self.digits

    def decode(self, data: Column) -> Column:
        """struct<value decimal, sign_nibble, sign_class, error_code>."""
        n = self.digits
        short = F.octet_length(data) != n
        if self.encoding == "ebcdic":
            h = F.hex(data)
            zone, digit = F.substring(h, 2 * n - 1, 1), F.substring(h, 2 * n, 1)
            lead = F.substring(h, 1, 2 * n - 2)
            plus, minus = {"preferred": ("CF", "D"), "non-preferred": ("ACEF", "BD"), "permissive": ("ACEF0", "BD")}[self.policy]
            ok = zone.isin(*plus) | (zone.isin(*minus) if self.signed else F.lit(False))
            if self.policy == "permissive":
                ok = ok | ((zone == "4") & (digit == "0"))
            error = ladder((short, "E_LENGTH"), (~lead.rlike("^(F[0-9])*$"), "E_DIGIT"), (~digit.rlike("^[0-9]$"), "E_DIGIT"), (~ok, "E_SIGN"))
            digits = F.concat(F.regexp_replace(lead, "F(.)", "$1"), digit)
            negative, nibble = zone.isin(*minus), F.concat(F.lit("0x"), zone)
        else:
            text = F.decode(data, "ISO-8859-1")
            last = F.substring(text, n, 1)
            lead = F.substring(text, 1, n - 1)
            allowed = "^[0-9{A-I}J-R]$" if self.signed else "^[0-9{A-I]$"
            error = ladder((short, "E_LENGTH"), (~lead.rlike("^[0-9]*$"), "E_DIGIT"), (~last.rlike("^[0-9{A-I}J-R]$"), "E_DIGIT"), (~last.rlike(allowed), "E_SIGN"))
            digits = F.concat(lead, F.translate(last, PLUS + MINUS, "01234567890123456789"))
            negative, nibble = last.rlike("^[}J-R]$"), F.concat(F.lit("0x"), F.right(F.hex(data), F.lit(2)))
        good = error.isNull()
        return F.when(
            data.isNotNull(),
            F.struct(
                F.when(good, as_decimal(digits, n, self.scale, negative)).alias("value"), F.when(good, nibble).alias("sign_nibble"),
                F.when(good, F.when(negative, "negative").otherwise("positive")).alias("sign_class"), error.alias("error_code"),
            ),
        )

    def encode(self, value: Column) -> Column:
        """struct<bytes, error_code>; never drops digits."""
        number, lost, negative = units(value, self.scale)
        minus = negative & F.coalesce(number != 0, F.lit(True))
        steps = [] if self.signed else [(minus, "E_SIGN")]
        error = ladder(*steps, (lost, "E_PRECISION"), (number.isNull() | (number >= 10**self.digits), "E_OVERFLOW"))
        full = F.lpad(number.cast("string"), self.digits, "0")
        lead, last = F.substring(full, 1, self.digits - 1), F.substring(full, self.digits, 1)
        if self.encoding == "ebcdic":
            sign = F.when(minus, "D").otherwise("C") if self.signed else F.lit("F")
            data = F.unhex(F.concat(F.regexp_replace(lead, "(.)", "F$1"), sign, last))
        else:
            punched = F.when(minus, F.translate(last, "0123456789", MINUS)).otherwise(F.translate(last, "0123456789", PLUS)) if self.signed else last
            data = F.encode(F.concat(lead, punched), "ISO-8859-1")
        return F.when(value.isNotNull(), F.struct(F.when(error.isNull(), data).alias("bytes"), error.alias("error_code")))
