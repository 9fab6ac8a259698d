"""Formats, codes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from syncframe.functions.grid import div

# Fixed values of the data model.
KINDS = {0: "file", 1: "dir", 2: "symlink", 3: "hardlink", 4: "fifo", 5: "chardev", 6: "blockdev", 7: "socket"}
ERROR_CODES = {
    0: "ok", 1: "io", 2: "no-space", 3: "invalid-path", 4: "source-changed", 5: "permission", 6: "exists", 7: "protocol", 8: "canceled",
}
PRESERVE_BITS = {
    1: "xattr", 2: "hardlink", 4: "sparse", 8: "devices", 16: "uname", 32: "owners", 64: "dry-run", 128: "delete",
}
FATAL_ERRORS = ("refused", "not allowed", "token", "--pass", "encryption", "protocol", "major mismatch")
CODE_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def name_of(number: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, number.cast("int")), F.lit("unknown"))


def human_bytes(n: Column) -> Column:
    """Bytes below 1,024, else one decimal and a binary unit.

    The decimal is that of the quotient itself, in integers, with ties to the even one, as C and Go print it; a format of Java's rounds
    ties up."""
    out = F.format_string("%dB", n)
    exact = n.cast("double").cast("long")  # what the quotient of doubles is taken of
    for k, unit in enumerate("KMGTPE", start=1):
        size, half = F.lit(1 << (10 * k)).cast("long"), F.lit(1 << (10 * k - 1)).cast("long")
        fives = (exact % size) * 5  # tenths are fives to the half: ten times the rest could leave 64 bits
        tenths, rest = div(fives, half), fives % half
        up = (rest * 2 > half) | ((rest * 2 == half) & (tenths % 2 == 1))
        tenths = div(exact, size) * 10 + tenths + up.cast("long")
        out = F.when(n >= 1 << (10 * k), F.concat(div(tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """Bytes of a size with an optional unit G, M, K or B; empty is 0; null if it cannot be read."""
    clean = F.upper(F.trim(text))
    number = F.regexp_extract(clean, r"^([+]?[0-9]+) *[GMKB]?$", 1).try_cast("long")
    unit = F.substring(clean, -1, 1)
    scale = F.when(unit == "G", 1 << 30).when(unit == "M", 1 << 20).when(unit == "K", 1 << 10).otherwise(1).cast("long")
    return F.when(clean == "", F.lit(0).cast("long")).otherwise(number * scale)


def octal_mode(mode: Column) -> Column:
    return F.conv(mode.cast("long").bitwiseAND(F.lit(4095).cast("long")), 10, 8)


def strip_suid(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(~0xC00))


def code_normalize(code: Column) -> Column:
    """Upper case without dashes, spaces and tabs."""
    return F.upper(F.regexp_replace(code, r"[- \t]", ""))


def code_reason(code: Column) -> Column:
    clean = code_normalize(code)
    return F.when(F.length(clean) < 25, "short").when(~clean.rlike(f"^[{CODE_ALPHABET}]*$"), "alphabet")


def code_format(code: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(code_normalize(code), "(.{5})", "$1-"), "-$", "")


def code_id(code: Column, tag: str = "code/1:") -> Column:
    return F.sha2(F.concat(F.lit(tag), code_normalize(code)), 256)


def room_id(code: Column, artifact: Column, tag: str = "room/1") -> Column:
    return F.sha2(F.concat_ws("/", F.lit(tag), code_id(code), artifact), 256)


def fmt_duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m, r = div(s, F.lit(3600)), div(s, F.lit(60)) % 60, s % 60
    return (
        F.when(seconds <= 0, "--").when(seconds > 3600, F.format_string("%dh%dm", h, m))
        .when(seconds > 60, F.format_string("%dm%02ds", div(s, F.lit(60)), r)).otherwise(F.format_string("%ds", s))
    )


def trunc_end(text: Column, width: int) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def trunc_mid(text: Column, width: int) -> Column:
    head = (width - 1) // 2
    tail = width - 1 - head
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…"), F.substring(text, -tail, tail)))


def preserved(mask: Column) -> Column:
    """Names of the bits that are set."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in PRESERVE_BITS.items()]))


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt - 1)).cast("long")


def retryable(message: Column, fatal: tuple[str, ...] = FATAL_ERRORS) -> Column:
    """Whether another attempt makes sense: the message holds none of the fatal phrases."""
    final = F.lit(False)
    for text in fatal:
        final = final | F.contains(message, F.lit(text))
    return ~final
