"""String hashes as built-in expressions: the bytes are read from a hex string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a, 32 bit.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK_32 = 0xFFFFFFFF
MASK_31 = 0x7FFFFFFF


def _code_units(text: Column, charset: str, hex_digits: int) -> Column:
    """Array of hex strings, one per byte or per UTF-16 unit."""
    digits = F.hex(F.encode(text.cast("string"), charset))
    return F.regexp_extract_all(digits, F.lit(f"(.{{{hex_digits}}})"), 1)


def _number(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("long")


def fnv1a_32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as an unsigned value in a long."""
    return F.aggregate(
        _code_units(text, "UTF-8", 2),
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, byte: (h.bitwiseXOR(_number(byte)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK_32)),
    )


def fnv1a_bucket(text: Column, n: int = 100) -> Column:
    """Bucket in ``[0, n)`` of a key."""
    return (fnv1a_32(text) % F.lit(n)).cast("int")


def java_hash_31(text: Column) -> Column:
    """``String.hashCode`` of the JVM with the sign bit cleared, over UTF-16 units."""
    full = F.aggregate(
        _code_units(text, "UTF-16BE", 4),
        F.lit(0).cast("long"),
        lambda h, unit: (h * F.lit(31) + _number(unit)).bitwiseAND(F.lit(MASK_32)),
    )
    return full.bitwiseAND(F.lit(MASK_31))
