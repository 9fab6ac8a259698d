"""Numbers, running values, folds and hash trees against plain Python, with keys that fill many parts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from syncframe.operators import aggregates, joins, windows
from syncframe.operators.folds import fold_sorted, spark_seconds
from syncframe.operators.scans import numbered, running
from syncframe.streaming import apply_envelopes


@pytest.fixture()
def parts(spark):
    """Many more parts than rows of most keys."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def table(seed, n=700):
    """One key has a third of all rows, another is null, others are small."""
    chance = random.Random(seed)
    return [(chance.choice(["hot", None, f"k{chance.randrange(40)}"]), k, chance.choice([None, *range(-9, 9)])) for k in range(n)]


@pytest.mark.parametrize(("how", "fold"), [(F.sum, sum), (F.max, max), (F.min, min)])
@pytest.mark.parametrize("before", [False, True])
def test_running(spark, parts, how, fold, before):
    rows = table(3)
    got = running(spark.createDataFrame(rows, "key string, at long, v long"), ["key"], ["at"], {"x": F.col("v")}, how, before)
    want, seen = [], {}
    for key, at, v in rows:
        held = seen.setdefault(key, [])
        now = [*held, v] if not before else held
        known = [x for x in now if x is not None]
        want.append((key, at, v, fold(known) if known else None))
        held.append(v)
    assert sorted((tuple(r) for r in got.select("key", "at", "v", "x").collect()), key=repr) == sorted(want, key=repr)


def test_running_of_nothing(spark):
    assert running(spark.createDataFrame([], "key string, at long"), ["key"], ["at"], {"n": F.lit(1).cast("long")}).collect() == []


def test_numbered(spark, parts):
    order = random.Random(5).sample(range(1000), 400)
    got = numbered(spark.createDataFrame([(k,) for k in order], "k long"), ["k"]).collect()
    assert sorted((r.number, r.k) for r in got) == list(enumerate(sorted(order), 1))
    assert numbered(spark.createDataFrame([], "k long"), ["k"]).collect() == []


def test_one_top_directory_is_cut(spark, parts):
    paths = [f"top/d{k % 7}/f{k}" for k in range(500)] + ["top", "top/d0"]
    chosen = numbered(spark.createDataFrame([(p,) for p in paths], "path string").withColumn("walk", F.split("path", "/")), ["walk"])
    got = sorted((r.number, r.path) for r in windows.number_entries(spark.createDataFrame([(p,) for p in paths], "path string")).collect())
    assert [p for _, p in got] == sorted(paths, key=lambda p: p.split("/"))
    sizes = [r["count"] for r in chosen.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) > 6


def test_fold_sorted(spark):
    rows = table(8, 200)
    step = lambda key, held, row: ((held or 0) + (row[1] or 0), ((held or 0) + (row[1] or 0), key[0]))
    got = fold_sorted(spark.createDataFrame(rows, "key string, at long, v long"), ["key"], ["at"], step, "x long, again string")
    sums, want = {}, []
    for key, _, v in rows:
        sums[key] = sums.get(key, 0) + (v or 0)
        want.append((key, sums[key], key))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert spark_seconds("1 day 2 hours").total_seconds() == 26 * 3600 and spark_seconds("90 seconds").total_seconds() == 90


def test_hash_tree(spark):
    values = [(k, f"row {k}") for k in range(300)]
    frame = spark.createDataFrame(values, "id long, name string")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for bits in (2, 4, 16):
        level = [(k, sha(name)) for k, name in values]
        for _ in range(max(2, -(-(299).bit_length() // bits)) - 1):
            nodes = {}
            for k, h in sorted(level):
                nodes[k >> bits] = nodes.get(k >> bits, "") + h
            level = [(k, sha(text)) for k, text in nodes.items()]
        want = sha("".join(h for _, h in sorted(level)))
        assert aggregates.manifest_digest(frame, F.col("name"), F.col("id"), bits).first().digest == want
    assert aggregates.manifest_digest(frame.limit(0), F.col("name"), F.col("id")).first().digest == sha("")


def test_hard_links_go_past_entries_without_an_inode(spark):
    rows = [(1, "file", 1, 7, 9), (2, "file", 1, 7, 9), (3, "file", 2, 7, 9), (4, "file", 1, 0, 9), (5, "file", 1, 0, 9), (6, "dir", 1, 7, 0), (7, "file", None, 7, 1), (8, "file", None, 7, 1), (9, None, 1, 7, 1)]
    out = {r.id: (r.kind, r.link_ref, r.size) for r in windows.mark_hardlinks(spark.createDataFrame(rows, "id long, kind string, dev long, ino long, size long")).collect()}
    assert out[2] == ("hardlink", 1, 0) and [k for k, v in out.items() if v[1] is not None] == [2] and len(out) == len(rows)


def test_what_a_member_is_told(spark):
    rows = [(1, f"m{k}", k < 2) for k in range(12)] + [(2, "alone", False), (3, "s", True), (3, "t", True)]
    for most in (1, 2, 5, 64):
        told = {}
        for r in joins.room_members(spark.createDataFrame(rows, "room long, addr string, seed boolean"), most).collect():
            told.setdefault((r.room, r.addr), []).append(r.other)
        for room, addr, _ in rows:
            others = sorted((not s, hashlib.md5(f"{a}#0".encode()).hexdigest(), a) for o, a, s in rows if o == room and a != addr)
            want = [a for k, (plain, _, a) in enumerate(others) if not plain or k < most]
            assert sorted(told.get((room, addr), [])) == sorted(want), (most, addr)


def test_a_member_is_told_all_others(spark):
    """without a number nobody is left out, and one room is the work of many tasks."""
    rows = [(1, f"m{k}", k < 2) for k in range(90)] + [(2, "alone", False), (3, "s", True), (3, "t", True)]
    told = joins.room_members(spark.createDataFrame(rows, "room long, addr string, seed boolean"), None)
    assert sorted((r.room, r.addr, r.other) for r in told.collect()) == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1])


def test_envelopes_of_one_node(spark, parts):
    import datetime

    chance, now = random.Random(1), datetime.datetime(2024, 1, 1)
    rows = [(1, now + datetime.timedelta(days=chance.randrange(-60, 30)), chance.randrange(-1, 60), chance.random() < 0.8, chance.random() < 0.9) for _ in range(400)]
    rows += [(2, now, 5, False, True), (3, now, 1, True, True)]
    out = apply_envelopes(spark.createDataFrame(rows, "node long, ts timestamp_ntz, version long, sig_ok boolean, key_ok boolean"), "2024-01-01")
    want, held = [], {}
    for node, ts, version, sig_ok, key_ok in sorted(rows):
        have = held.get(node, 0)
        old = have == 0 and ts < now - datetime.timedelta(days=30)
        verdict = (
            "foreign key" if not key_ok else "same" if version == have and sig_ok else "stale" if version <= have else "bad signature" if not sig_ok else "too old" if old else "applied"
        )
        held[node] = version if verdict == "applied" else have
        want.append((node, version, verdict, held[node]))
    assert sorted(map(tuple, out.collect())) == sorted(want)
