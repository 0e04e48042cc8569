"""Packed-decimal (COMP-3) fields as Column expressions.

A field of D digits takes D // 2 + 1 bytes: digit nibbles, then a sign nibble; an even
D has a zero pad nibble in front. Checks run in the order length, pad, digits, sign.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digits import as_decimal, ladder, units

#: Sign nibbles that each mode accepts, for signed and unsigned fields.
ACCEPTED = {
    ("pfd", True): "CD", ("pfd", False): "CF",
    ("nopfd", True): "ABCDEF", ("nopfd", False): "ACEF",
    ("program", True): "CDF", ("program", False): "CF",
}


@dataclass(frozen=True)
class Packed:
    """Shape of a packed field. mode: pfd, nopfd, or program (the program engine's rules)."""

    digits: int
    scale: int = 0
    signed: bool = True
    mode: str = "pfd"

    def __post_init__(self) -> None:
        if not 1 <= self.digits <= 18:
            raise ValueError("E_SCHEMA: packed digits must be in 1..=18")
        if not 0 <= self.scale <= self.digits:
            raise ValueError("E_SCHEMA: scale exceeds the digits")
        if (self.mode, self.signed) not in ACCEPTED:
            raise ValueError(f"E_SCHEMA: unknown sign mode {self.mode}")

    @property
    def byte_len(self) -> int:
        return self.digits // 2 + 1

    @property
    def max_unscaled(self) -> int:
        return 10**self.digits - 1

    @property
    def min_unscaled(self) -> int:
        return -self.max_unscaled if self.signed else 0

    def nibbles(self, data: Column) -> Column:
        """The nibbles, high before low, one letter each."""
        return F.split(F.hex(data), "")

    def decode(self, data: Column) -> Column:
        """struct<value decimal, sign_nibble, sign_class, error_code>; value is null where there is an error."""
        h, n = F.hex(data), self.byte_len
        pad = self.digits % 2 == 0
        digits = F.substring(h, 2 if pad else 1, self.digits)
        sign = F.substring(h, 2 * n, 1)
        steps = [(F.octet_length(data) != n, "E_LENGTH")]
        if pad:
            steps.append((F.substring(h, 1, 1) != "0", "E_PADDING"))
        steps += [(~digits.rlike("^[0-9]+$"), "E_DIGIT"), (~sign.isin(*ACCEPTED[self.mode, self.signed]), "E_SIGN")]
        error = ladder(*steps)
        value = F.when(error.isNull(), as_decimal(digits, self.digits, self.scale, sign.isin("B", "D")))
        last = F.right(h, F.lit(1))
        return F.when(
            data.isNotNull(),
            F.struct(
                value.alias("value"), F.when(h != "", F.concat(F.lit("0x"), last)).alias("sign_nibble"),
                F.when(h != "", sign_class(last, F.when(error.isNull(), F.lit(self.signed)).otherwise(True))).alias("sign_class"), error.alias("error_code"),
            ),
        )

    def encode(self, value: Column, strict: bool = False, sign: Column | None = None) -> Column:
        """struct<bytes, error_code>. Truncates toward zero to the scale, or with `strict` refuses to.

        sign: nibble to write instead of the canonical one; it must agree with the value (zero takes any).
        """
        number, lost, negative = units(value, self.scale)
        zero = F.coalesce(number == 0, F.lit(False))
        minus = negative & ~zero
        canonical = F.when(minus, "D").otherwise("C") if self.signed else F.lit("F")
        steps = []
        if not self.signed:
            steps.append((minus, "E_SIGN"))
        if strict:
            steps.append((lost, "E_PRECISION"))
        steps.append((number.isNull() | (number > self.max_unscaled), "E_OVERFLOW"))
        nibble = canonical
        if sign is not None:
            nibble = F.regexp_replace(F.upper(sign), "^0X", "")
            allowed = F.when(zero, nibble.rlike("^[A-F]$" if self.signed else "^[ACEF]$")).when(minus, nibble.isin("B", "D")).otherwise(nibble.isin("A", "C", "E", "F"))
            steps.append((~F.coalesce(allowed, F.lit(False)), "E_SIGN"))
        error = ladder(*steps)
        data = F.unhex(F.concat(F.lpad(number.cast("string"), 2 * self.byte_len - 1, "0"), nibble))
        return F.when(value.isNotNull(), F.struct(F.when(error.isNull(), data).alias("bytes"), error.alias("error_code")))

    def decode_lossless(self, data: Column) -> Column:
        """As decode(): a decimal has no negative zero, so the nibble beside the value is what makes it lossless."""
        return self.decode(data)

    def encode_lossless(self, decoded: Column) -> Column:
        """The bytes that decode_lossless() read."""
        return self.encode(decoded["value"], sign=decoded["sign_nibble"])["bytes"]


def sign_class(nibble: Column, signed: Column) -> Column:
    positive = F.when(signed, "positive").otherwise("unsigned-positive")
    return F.when(nibble.isin("A", "C", "E", "F"), positive).when(nibble.isin("B", "D"), "negative").otherwise("invalid")


def is_negative_zero(decoded: Column) -> Column:
    return F.coalesce((decoded["value"] == 0) & decoded["sign_nibble"].isin("0xB", "0xD"), F.lit(False))
