"""Literal cases and properties of the column functions."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syncframe import functions as S

MIB = 1 << 20


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_ladder(spark):
    sizes = [0, 1, 64 * MIB, 64 * MIB + 1, 1 << 30, (1 << 30) + 1, 1 << 40]
    got = values(spark, S.chunk_size_for(F.col("s")), [(s,) for s in sizes], "s long")
    assert got == [4 * MIB] * 3 + [8 * MIB] * 2 + [16 * MIB] * 2


def test_grid_sums_to_size(spark):
    from syncframe.operators.filters import grid_of

    sizes = [0, 1, 4 * MIB, 4 * MIB + 1, 12 * MIB + 12345, 48 * MIB]
    files = spark.createDataFrame([(str(s), s) for s in sizes], "path string, size long")
    sums = {r.path: r.n for r in grid_of(files).groupBy("path").agg(F.sum("len").alias("n")).collect()}
    assert sums == {str(s): s for s in sizes if s}


def uvarint(n):
    out = b""
    while n >= 128:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def test_chunk_identity(spark):
    rows = [("a", 0, b"x"), ("b", 0, b"x"), ("a", 1, b"x"), ("p" * 300, 20000, b""), ("ä" * 64, 128, b"\0")]
    got = values(spark, S.chunk_id(F.col("p"), F.col("i"), F.col("b")), rows, "p string, i long, b binary")
    want = [hashlib.sha256(b"\1" + uvarint(len(p.encode())) + p.encode() + uvarint(i) + b).hexdigest() for p, i, b in rows]
    assert got == want and len(set(got)) == len(rows)


def test_all_zero(spark):
    payloads = [b"", b"\0" * 4096] + [b"\0" * (n - 1) + b"\1" for n in (1, 3, 9, 4096)]
    assert values(spark, S.all_zero(F.col("b")), [(p,) for p in payloads], "b binary") == [True, True, False, False, False, False]


GLOBS = [
    ("*.log", "a.log", True), ("*.log", "a/b.log", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True),
    ("[^a-c]x", "bx", False), ("\\*", "*", True), ("\\*", "a", False), ("d[0-9]", "d5", True), ("a.b", "axb", False), ("[]a]", "a", None), ("[", "[", None), ("a\\", "a", None),
]


@pytest.mark.parametrize(("pattern", "name", "matched"), GLOBS)
def test_glob(spark, pattern, name, matched):
    regex = S.glob_to_regex(pattern)
    if matched is None:
        assert regex is None
    else:
        assert values(spark, F.col("n").rlike(regex), [(name,)], "n string") == [matched]


def test_segments(spark):
    regex = S.segments_regex("**/*.txt")
    assert values(spark, F.col("n").rlike(regex), [("f.txt",), ("a/b/c/f.txt",), ("a/f.md",)], "n string") == [True, True, False]


def test_formats(spark):
    got = values(spark, S.human_bytes(F.col("n")), [(1023,), (1024,), (1536,), (5 << 30,)], "n long")
    assert got == ["1023B", "1.0K", "1.5K", "5.0G"]
    got = values(spark, S.parse_size(F.col("s")), [("",), ("5g",), (" 7 K",), ("-1",), ("x",), ("12B",)], "s string")
    assert got == [0, 5 << 30, 7 << 10, None, None, 12]
    got = values(spark, S.fmt_duration(F.col("n")), [(0,), (59,), (60,), (61,), (3600,), (3661,)], "n long")
    assert got == ["--", "59s", "60s", "1m01s", "60m00s", "1h1m"]


def test_bytes_round_as_the_quotient_does(spark):
    """a tie goes to the even tenth, and a quotient just below a tie goes down."""
    sizes = [k * 1024 + r for k in (1, 2, 3, 306, 1023) for r in range(0, 1024, 51)] + [(1 << 20) * 306 + (1 << 18), (1 << 20) * 656 + (1 << 18), (1 << 20) * 7 + 3 * (1 << 18)]
    sizes += [(1 << e) + d for e in (20, 30, 40, 50, 52, 53, 59, 60, 62) for d in (-1, 0, 1, 1 << (e - 2), 3 << (e - 3))] + [(1 << 63) - 1, -5]
    got = values(spark, S.human_bytes(F.col("n")), [(n,) for n in sizes], "n long")
    want = [next((f"{n / float(1 << 10 * k):.1f}{u}" for k, u in reversed(list(enumerate("KMGTPE", start=1))) if n >= 1 << 10 * k), f"{n}B") for n in sizes]
    assert got == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sets(st.integers(0, 70), min_size=1), min_size=1, max_size=6))
def test_bitmaps_round_trip(spark, sets):
    from syncframe.operators.aggregates import bitmap_agg

    bits = spark.createDataFrame([(k, b) for k, s in enumerate(sets) for b in s], "k long, b long")
    packed = bitmap_agg(bits, ["k"], "b").withColumn("raw", F.unhex("bitmap"))
    for r in packed.select("k", S.bits_of(F.col("raw")).alias("bits"), S.popcount(F.col("raw")).alias("n")).collect():
        assert set(r.bits) == sets[r.k] and r.n == len(sets[r.k])
