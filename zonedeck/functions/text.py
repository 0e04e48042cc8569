"""Text fields: ASCII, EBCDIC code pages, UTF-16."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digits import ladder

#: Code pages and the Python codec each is read by; 1148 is 500 with the euro sign at 0x9F.
CODEPAGES = {37: "cp037", 500: "cp500", 1140: "cp1140", 1148: "cp500"}


@cache
def _tables(codepage: int) -> tuple[str, str]:
    """Latin-1 characters of bytes, and what they mean in the code page; without those that mean themselves (translate() would drop NUL)."""
    if codepage not in CODEPAGES:
        raise ValueError(f"E_SCHEMA: unsupported codepage cp{codepage}")
    meant = list(bytes(range(256)).decode(CODEPAGES[codepage]))
    if codepage == 1148:
        meant[0x9F] = "€"
    differ = [(chr(b), c) for b, c in enumerate(meant) if chr(b) != c]
    return "".join(a for a, _ in differ), "".join(c for _, c in differ)


def ebcdic_text(data: Column, codepage: int = 37) -> Column:
    """The text, control characters and all."""
    latin, meant = _tables(codepage)
    return F.translate(F.decode(data, "ISO-8859-1"), latin, meant)


def ebcdic_bytes(text: Column, codepage: int = 37) -> Column:
    """Bytes of a text; null if a character has none."""
    latin, meant = _tables(codepage)
    known = {*meant, *(chr(b) for b in range(256) if chr(b) not in latin)}
    outside = "[^" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(known)) + "]"
    return F.when(~text.rlike(outside), F.encode(F.translate(text, meant, latin), "ISO-8859-1"))


def decode_text(data: Column, encoding: str = "ascii", codepage: int = 37) -> Column:
    """struct<value string, sign_nibble, sign_class, error_code>; control characters and non-ASCII are E_ENCODING."""
    if encoding == "ascii":
        text = F.decode(data, "ISO-8859-1")
        bad = text.rlike(r"[^\x20-\x7E]")
    elif encoding == "ebcdic":
        text = ebcdic_text(data, codepage)
        bad = text.rlike(r"[\x00-\x1F\x7F-\x9F]")
    else:
        raise ValueError("E_SCHEMA: text is ascii or ebcdic")
    none = F.lit(None).cast("string")
    error = ladder((bad, "E_ENCODING"))
    return F.when(data.isNotNull(), F.struct(F.when(error.isNull(), text).alias("value"), none.alias("sign_nibble"), none.alias("sign_class"), error.alias("error_code")))


def encode_text(text: Column, length: int, encoding: str = "ascii", codepage: int = 37) -> Column:
    """Bytes of a fixed-width field, padded with spaces and cut at the right."""
    fixed = F.rpad(text, length, " ")
    return F.encode(fixed, "US-ASCII") if encoding == "ascii" else ebcdic_bytes(fixed, codepage)


def national_text(data: Column) -> Column:
    """UTF-16 big-endian; null for an odd number of bytes."""
    return F.when(F.octet_length(data) % 2 == 0, F.decode(data, "UTF-16BE"))


def parse_hex(text: Column) -> Column:
    """struct<bytes, error_code>: separators and a 0x prefix are passed over, an odd number of digits is E_HEX."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "^0[xX]", ""), r"[\s_:,-]", "")
    good = plain.rlike("^([0-9a-fA-F]{2})*$")
    return F.when(text.isNotNull(), F.struct(F.when(good, F.unhex(plain)).alias("bytes"), F.when(~good, "E_HEX").alias("error_code")))
