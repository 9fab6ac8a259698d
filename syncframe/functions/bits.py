"""Bitmaps of chunks: bits packed low first in each byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(bitmap: Column, index: Column) -> Column:
    """The value of a byte, or null beyond the end."""
    return F.conv(F.hex(F.substring(bitmap, index + 1, F.lit(1))), 16, 10).cast("int")


def bit_test(bitmap: Column, bit: Column) -> Column:
    """Whether a bit is set; false out of range."""
    inside = (bit >= 0) & (bit < 8 * F.octet_length(bitmap))
    at = F.greatest(bit, F.lit(0)).cast("int")
    value = F.call_function("shiftright", byte_at(bitmap, F.shiftright(at, 3)), at.bitwiseAND(F.lit(7)))
    return F.coalesce(inside & (value.bitwiseAND(F.lit(1)) == 1), F.lit(False))


def _with_byte(bitmap: Column, bit: Column, change) -> Column:
    at = F.greatest(bit, F.lit(0)).cast("int")
    index = F.shiftright(at, 3)
    value = change(byte_at(bitmap, index), F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7))))
    byte = F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))
    whole = F.concat(F.substring(bitmap, F.lit(1), index), byte, F.substring(bitmap, index + 2, F.octet_length(bitmap)))
    return F.when((bit >= 0) & (bit < 8 * F.octet_length(bitmap)), whole).otherwise(bitmap)


def bit_set(bitmap: Column, bit: Column) -> Column:
    """The bitmap with a bit set; unchanged out of range."""
    return _with_byte(bitmap, bit, lambda byte, one: byte.bitwiseOR(one))


def bit_clear(bitmap: Column, bit: Column) -> Column:
    """The bitmap with a bit cleared; unchanged out of range."""
    return _with_byte(bitmap, bit, lambda byte, one: byte.bitwiseAND(F.bitwise_not(one)))


def popcount(bitmap: Column) -> Column:
    """Set bits: the ones of each hex digit."""
    digits = F.split(F.hex(bitmap), "")
    ones = F.transform(digits, lambda d: F.coalesce(F.bit_count(F.conv(d, 16, 10).cast("int")), F.lit(0)))
    return F.aggregate(ones, F.lit(0), lambda a, b: a + b).cast("long")


def bits_of(bitmap: Column) -> Column:
    """The set bits of a bitmap as a sorted array of indexes; null where the bitmap is null."""
    last = 8 * F.octet_length(bitmap) - 1
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), last), lambda b: bit_test(bitmap, b)))


def packed_byte(bits: Column) -> Column:
    """Aggregate: the byte that has the given bits (0-7) of a group, as two hex digits."""
    return F.lower(F.lpad(F.hex(F.bit_or(F.call_function("shiftleft", F.lit(1), bits.cast("int"))).cast("long")), 2, "0"))
