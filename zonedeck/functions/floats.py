"""Hexadecimal (COMP-1, COMP-2) and IEEE floating-point fields."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .digits import ladder


def _reversed_hex(h: Column, n: int) -> Column:
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(n - 1, -1, -1)])


@dataclass(frozen=True)
class HexFloat:
    """Sign bit, exponent of 16 in excess 64, fraction of 24 or 56 bits."""

    byte_len: int
    endian: str = "big"

    def decode(self, data: Column) -> Column:
        h = F.hex(data) if self.endian == "big" else _reversed_hex(F.hex(data), self.byte_len)
        error = ladder((F.octet_length(data) != self.byte_len, "E_LENGTH"))
        first = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
        nibbles = 2 * self.byte_len - 2
        fraction = F.conv(F.substring(h, 3, nibbles), 16, 10).cast("double")
        size = fraction * F.pow(F.lit(16.0), (first.bitwiseAND(F.lit(0x7F)) - 64 - nibbles).cast("double"))
        value = F.when(fraction == 0, F.lit(0.0)).when(first >= 128, -size).otherwise(size)
        none = F.lit(None).cast("string")
        return F.when(data.isNotNull(), F.struct(F.when(error.isNull(), value).alias("value"), none.alias("sign_nibble"), none.alias("sign_class"), error.alias("error_code")))

    def encode(self, value: Column) -> Column:
        """Bytes, null where the value doesn't fit; by Arrow batches, in whole columns."""
        n, endian = self.byte_len, self.endian

        @F.pandas_udf("binary")
        def run(values: pd.Series) -> pd.Series:
            return pd.Series(hex_float_bytes(values.to_numpy(np.float64), n, endian), dtype=object)

        return run(value.cast("double"))


def hex_float_bytes(x: np.ndarray, n: int, endian: str = "big") -> list[bytes | None]:
    """Rounds half away from zero; underflow is zero, overflow and non-finite None."""
    bits = 8 * (n - 1)
    fine = np.isfinite(x)
    size = np.abs(np.where(fine, x, 0.0))
    power = -(-np.frexp(size)[1] // 4)  # of 16, so that the fraction is at least a sixteenth and below one
    scaled = np.ldexp(size, bits - 4 * power)
    whole = np.floor(scaled)
    mantissa = whole.astype(np.uint64) + (scaled - whole >= 0.5).astype(np.uint64)
    full = mantissa == np.uint64(1 << bits)
    mantissa, power = np.where(full, mantissa >> np.uint64(4), mantissa), power + full + 64
    fits = fine & (power <= 127)
    nothing = (size == 0) | (power < 0)
    head = np.where(nothing, 0, np.clip(power, 0, 127) | np.where(x < 0, 0x80, 0)).astype(np.uint64)
    number = (head << np.uint64(bits)) | np.where(nothing, np.uint64(0), mantissa)
    rows = number.astype(">u8").view("V8").astype(object) if n == 8 else number.astype(">u4").view("V4").astype(object)
    step = 1 if endian == "big" else -1
    return [bytes(r)[::step] if ok else None for r, ok in zip(rows, fits)]


@dataclass(frozen=True)
class IeeeFloat:
    byte_len: int

    def decode(self, data: Column) -> Column:
        """double; null if the length is wrong or the number isn't finite."""
        form, n = {4: ">f4", 8: ">f8"}[self.byte_len], self.byte_len

        @F.pandas_udf("double")
        def run(values: pd.Series) -> pd.Series:
            right = values.map(lambda b: b is not None and len(b) == n).to_numpy(bool)
            out = np.full(len(values), np.nan)
            out[right] = np.frombuffer(b"".join(values[right]), form)
            return pd.Series(out).where(np.isfinite(out), None).astype("object")

        return run(data)

    def encode(self, value: Column) -> Column:
        form = {4: ">f4", 8: ">f8"}[self.byte_len]

        @F.pandas_udf("binary")
        def run(values: pd.Series) -> pd.Series:
            x = values.to_numpy(np.float64)
            with np.errstate(over="ignore"):
                packed = x.astype(form)
            fits = np.isfinite(x) & np.isfinite(packed.astype(np.float64))
            rows = packed.view(f"V{packed.itemsize}").astype(object)
            return pd.Series([bytes(r) if ok else None for r, ok in zip(rows, fits)], dtype=object)

        return run(value.cast("double"))
