"""Binary (COMP, COMP-4, COMP-5) integers of 2, 4 or 8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digits import ladder, scaled, units


@dataclass(frozen=True)
class Binary:
    byte_len: int
    signed: bool = True
    endian: str = "big"
    scale: int = 0

    def __post_init__(self) -> None:
        if self.byte_len not in (2, 4, 8) or self.endian not in ("big", "little"):
            raise ValueError("E_SCHEMA: binary fields have 2, 4 or 8 bytes, big or little")

    @staticmethod
    def width(digits: int) -> int:
        """Bytes of a field of so many digits."""
        if not 1 <= digits <= 18:
            raise ValueError("E_SCHEMA: binary digits must be in 1..=18")
        return 2 if digits <= 4 else 4 if digits <= 9 else 8

    def _turn(self, h: Column) -> Column:
        """The hexadecimal digits in the other byte order, if the field has it."""
        if self.endian == "big":
            return h
        return F.regexp_replace(h, "(..)" * self.byte_len, "".join(f"${k}" for k in range(self.byte_len, 0, -1)))

    def decode(self, data: Column) -> Column:
        """struct<value decimal(20 or 19, scale), sign_nibble, sign_class, error_code>."""
        error = ladder((F.octet_length(data) != self.byte_len, "E_LENGTH"))
        h, bits = self._turn(F.hex(data)), 8 * self.byte_len
        if self.byte_len == 8:
            number = F.conv(h, 16, -10 if self.signed else 10)
        else:
            number = F.conv(h, 16, 10).cast("bigint")
            if self.signed:  # the sign bit to the top and back
                number = F.shiftright(F.shiftleft(number, 64 - bits), 64 - bits)
        value = scaled(number.cast("decimal(20,0)"), self.scale).cast(f"decimal(20,{self.scale})")
        none = F.lit(None).cast("string")
        return F.when(data.isNotNull(), F.struct(F.when(error.isNull(), value).alias("value"), none.alias("sign_nibble"), none.alias("sign_class"), error.alias("error_code")))

    def encode(self, value: Column) -> Column:
        bits = 8 * self.byte_len
        kind, total = ("decimal(20,0)", 20) if bits == 64 else ("bigint", 18)
        number, lost, negative = units(value, self.scale, total)
        # The largest magnitudes on either side of zero.
        low, high = (2 ** (bits - 1), 2 ** (bits - 1) - 1) if self.signed else (0, 2**bits - 1)
        limit = F.when(negative, F.lit(str(low)).cast(kind)).otherwise(F.lit(str(high)).cast(kind))
        error = ladder((lost, "E_PRECISION"), (F.coalesce(number > limit, F.lit(True)), "E_OVERFLOW"))
        if self.signed or bits < 64:
            h = F.hex(F.when(negative, -number).otherwise(number).try_cast("bigint"))  # two's complement
        else:
            h = F.conv(number.cast("string"), 10, 16)
        h = F.right(F.lpad(h, 16, "0"), F.lit(2 * self.byte_len))
        return F.when(value.isNotNull(), F.struct(F.when(error.isNull(), F.unhex(self._turn(h))).alias("bytes"), error.alias("error_code")))
