"""The chunk grid of a file and the identity of its chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB, GIB, TIB = 1 << 10, 1 << 20, 1 << 30, 1 << 40
MAX_FILE, MAX_CHUNKS = 16 * TIB, 1 << 20


def div(a: Column, b: Column) -> Column:
    """Integer division."""
    return F.call_function("div", a, b)


def chunk_size_for(size: Column) -> Column:
    """The ladder: 4 MiB up to 64 MiB, 8 MiB up to 1 GiB, then 16 MiB."""
    return F.when(size <= 64 * MIB, 4 * MIB).when(size <= GIB, 8 * MIB).otherwise(16 * MIB).cast("long")


def normalize_chunk_size(override: Column, size: Column) -> Column:
    """The override if it is a power of two from 512 KiB to 16 MiB, else the ladder's size."""
    fits = override.between(512 * KIB, 16 * MIB) & (override.bitwiseAND(override - 1) == 0)
    return F.when(fits, override).otherwise(chunk_size_for(size)).cast("long")


def chunk_count(size: Column, chunk_size: Column) -> Column:
    sound = (size > 0) & (chunk_size > 0) & (size <= 1 << 62)
    return F.when(sound, div(size - 1, chunk_size) + 1).otherwise(0).cast("long")


def chunk_offset(index: Column, chunk_size: Column) -> Column:
    return (index * chunk_size).cast("long")


def chunk_len(size: Column, chunk_size: Column, index: Column) -> Column:
    return F.least(chunk_size, size - index * chunk_size).cast("long")


def range_header(offset: Column, length: Column) -> Column:
    """The HTTP range of a chunk; the end is inclusive."""
    return F.concat(F.lit("bytes="), offset.cast("string"), F.lit("-"), (offset + length - 1).cast("string"))


def uvarint(n: Column) -> Column:
    """The variable-length encoding of a number below 2^21: seven bits a byte, low bits first."""
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    low = lambda x: F.shiftright(n.cast("long"), x).bitwiseAND(F.lit(127))
    more = lambda x: low(x).bitwiseOR(F.lit(128))
    return (
        F.when(n < 1 << 7, byte(low(0)))
        .when(n < 1 << 14, F.concat(byte(more(0)), byte(low(7))))
        .otherwise(F.concat(byte(more(0)), byte(more(7)), byte(low(14))))
    )


def chunk_id(path: Column, index: Column, payload: Column) -> Column:
    """SHA-256 of a tag byte 1, the path with its length, the index and the payload."""
    return F.sha2(F.concat(F.unhex(F.lit("01")), uvarint(F.octet_length(path)), F.encode(path, "UTF-8"), uvarint(index), payload), 256)


def all_zero(payload: Column) -> Column:
    return F.hex(payload).rlike("^(00)*$")


def geometry_reason(size: Column, chunk_size: Column) -> Column:
    """Why a size and a chunk size cannot be right; null if they can."""
    return (
        F.when(size < 0, "negative size").when(size > MAX_FILE, "too large")
        .when(chunk_size != chunk_size_for(size), "chunk size")
        .when(chunk_count(size, chunk_size) > MAX_CHUNKS, "too many chunks")
    )
