"""Streams with timers: expiry without a later event, order across micro-batches, handed-over state, and mirrors that die."""

import collections
import datetime
import pathlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from syncframe import sinks
from syncframe.operators import scans
from syncframe.operators.aggregates import file_states
from syncframe.streaming import timed
from syncframe.streaming.mirror import continuous_mirror

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture()
def own(spark):
    session = timed.with_timers(spark.newSession())
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def feed(session, folder, schema, files):
    """A stream that reads each list of rows as a micro-batch of its own."""
    for rows in files:
        frame = session.createDataFrame(rows, schema).coalesce(1)
        frame.write.mode("append").parquet(str(folder))
    return session.readStream.schema(session.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def ran(session, stream, state):
    """What the stream has emitted once all is read, and its last progress."""
    name = f"q{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in session.table(name).collect()], query.lastProgress


def kept(progress):
    return sum(s["numRowsTotal"] for s in progress["stateOperators"])


ANNOUNCES = "room long, addr string, seed boolean, ts timestamp"


def test_members_leave_without_being_asked(own, tmp_path):
    files = [[(1, "a", False, at(0)), (1, "s", True, at(0))], [(1, "a", False, at(30))], [(2, "late", False, at(10_000))], [(3, "x", False, at(20_000))]]
    out, progress = ran(own, timed.room_stream(feed(own, tmp_path / "in", ANNOUNCES, files), "10 seconds"), tmp_path / "state")
    assert sorted(out) == sorted([
        (1, "a", "joined", at(0)), (1, "s", "joined", at(0)), (1, "a", "refreshed", at(30)), (1, "a", "expired", at(90)), (1, "s", "expired", at(300)),
        (2, "late", "joined", at(10_000)), (2, "late", "expired", at(10_060)),
    ])
    assert kept(progress) == 1  # only the row that still waits for the watermark


def test_a_full_room_loses_its_stalest_member_that_is_no_seed(own, tmp_path):
    rows = [(1, "seed", True, at(0)), *[(1, f"m{k}", False, at(1 + k)) for k in range(3)], (1, "m0", False, at(5)), (1, "new", False, at(6)), (9, "end", False, at(50))]
    out, _ = ran(own, timed.room_stream(feed(own, tmp_path / "in", ANNOUNCES, [rows, [(9, "end", False, at(90))]]), "10 seconds", cap=4), tmp_path / "state")
    assert [r for r in sorted(out, key=lambda r: r[3]) if r[2] == "evicted"] == [(1, "m1", "evicted", at(6))]


def test_a_room_without_a_cap_loses_nobody(own, tmp_path):
    """the query's rooms have no cap; one of more than 256 members evicted some of them."""
    rows = [(1, f"m{k}", k % 25 == 0, at(k / 10)) for k in range(300)] + [(9, "end", False, at(50))]
    out, _ = ran(own, timed.room_stream(feed(own, tmp_path / "in", ANNOUNCES, [rows]), "10 seconds", cap=None), tmp_path / "state")
    assert sorted(r[1:3] for r in out) == sorted((f"m{k}", "joined") for k in range(300))


def test_keys_share_their_state(own, tmp_path, monkeypatch):
    """F9 to F12: state is a few pages for each bucket, however many keys wait or hold a value."""
    monkeypatch.setattr(timed, "BUCKETS", 4)
    files = [[(k, at(k / 100)) for k in range(500)], [(k, at(60 + k / 100)) for k in range(500)]]
    out, progress = ran(own, timed.stall_stream(feed(own, tmp_path / "in", "session long, ts timestamp", files), "10 seconds"), tmp_path / "state")
    assert out == [] and kept(progress) <= 8


def test_waiting_rows_in_pages(own, tmp_path, monkeypatch):
    """F9 to F12: a key whose rows fill several pages, with nulls beside large numbers, in batches that leave rows behind."""
    monkeypatch.setattr(timed, "ROWS", 7)
    schema = "event_id long, path string, kind string, bytes long, ts timestamp"
    big = 2**53 + 1
    rows = [(k, "hot" if k % 3 else f"p{k % 5}", "chunk" if k < 60 else "done", None if k % 4 == 0 else big, at(k)) for k in range(90)]
    stream = feed(own, tmp_path / "in", schema, [rows[:40], rows[20:60], rows[60:], [(999, "end", "done", 0, at(5_000))]])
    out, _ = ran(own, timed.lifecycle_stream(stream, "60 seconds"), tmp_path / "state")
    events = rows[:40] + rows[20:60] + rows[60:]
    for path in {r[1] for r in rows}:
        mine = sorted((r for r in events if r[1] == path), key=lambda r: r[4])
        end = next(k for k, r in enumerate(mine) if r[2] == "done")
        size = sum(r[3] or 0 for r in mine[: end + 1] if r[2] == "chunk")
        assert sorted(r[1:3] for r in out if r[0] == path) == sorted([("active", mine[0][3] or 0), ("done", size)])


def brute_rooms(rows, until, member, seed):
    """Each member's announces in order of time."""
    out, groups = [], collections.defaultdict(list)
    for room, addr, flag, ts in rows:
        if ts <= until:
            groups[room, addr].append((ts, flag))
    for (room, addr), seen in groups.items():
        last = flag = None
        for ts, f in sorted(seen):
            ends = None if last is None else last + datetime.timedelta(seconds=seed if flag else member)
            if ends is None or ends < ts:
                if ends is not None:
                    out.append((room, addr, "expired", ends))
                flag = f
                out.append((room, addr, "joined", ts))
            else:
                out.append((room, addr, "refreshed", ts))
            last = ts
        ends = last + datetime.timedelta(seconds=seed if flag else member)
        if ends <= until:
            out.append((room, addr, "expired", ends))
    return sorted(out)


def test_batches_do_not_matter(own, tmp_path):
    chance = random.Random(2)
    rows = [(chance.randrange(3), f"a{chance.randrange(6)}", chance.random() < 0.2, at(k * 7 + chance.randrange(-20, 20) + 40)) for k in range(200)]
    files = [rows[k : k + 23] for k in range(0, len(rows), 23)]
    newest = max(r[3] for r in rows)
    for name, parts in {"one": [rows], "many": files}.items():
        out, _ = ran(own, timed.room_stream(feed(own, tmp_path / name, ANNOUNCES, parts), "120 seconds"), tmp_path / f"state-{name}")
        assert sorted(out) == brute_rooms(rows, newest - datetime.timedelta(seconds=120), 60, 300), name


def test_offers_leave_no_state(own, tmp_path):
    schema = "id long, ts timestamp, kind string, ref long"
    files = [[(1, at(0), "offer", 10), (2, at(0), "offer", 20), (3, at(1), "take", 30)], [(1, at(100), "offer", 11), (1, at(200), "take", 31)], [(2, at(601), "take", 32)], [(8, at(5_000), "take", 33)], [(9, at(9_000), "take", 34)]]
    out, progress = ran(own, timed.pair_stream(feed(own, tmp_path / "in", schema, files), "10 seconds"), tmp_path / "state")
    assert sorted(out, key=repr) == sorted([
        ("offer", 10, 1, None, "open"), ("offer", 20, 2, None, "open"), ("take", 30, 3, None, "rejected"), ("offer", 11, 1, None, "duplicate"), ("take", 31, 1, 10, "paired"),
        ("take", 32, 2, None, "rejected"), ("take", 33, 8, None, "rejected"),
    ], key=repr)
    assert kept(progress) == 1


def test_a_stall_is_told_at_its_time(own, tmp_path):
    schema = "session long, ts timestamp"
    files = [[(1, at(0)), (2, at(0))], [(1, at(100)), (2, at(50))], [(2, at(400))], [(9, at(1_000))], [(9, at(1_001))]]
    out, _ = ran(own, timed.stall_stream(feed(own, tmp_path / "in", schema, files), "10 seconds"), tmp_path / "state")
    assert sorted(out) == sorted([
        (1, at(100), "stalled", at(220)), (2, at(50), "stalled", at(170)), (2, at(50), "resumed", at(400)), (2, at(400), "stalled", at(520)),
    ])


def test_a_first_envelope_must_be_young(own, tmp_path):
    schema = "node long, ts timestamp, version long, sig_ok boolean, key_ok boolean"
    day = 86400
    rows = [(1, at(-40 * day), 3, True, True), (1, at(-day), 5, True, True), (1, at(0), 5, True, True), (1, at(1), 4, True, True), (1, at(2), 9, False, True), (1, at(3), 9, True, False), (7, at(99), 1, True, True)]
    out, _ = ran(own, timed.envelope_stream(feed(own, tmp_path / "in", schema, [rows]), "10 seconds", "2024-01-01"), tmp_path / "state")
    assert out == [(1, 3, "too old", 0), (1, 5, "applied", 5), (1, 5, "same", 5), (1, 4, "stale", 5), (1, 9, "bad signature", 5), (1, 9, "foreign key", 5)]


def test_arrivals_in_pages(own, tmp_path):
    schema = "path string, idx long, chunk_count long, ts long"
    n = 3 * timed.PAGE + 5
    order = list(range(n))
    random.Random(4).shuffle(order)
    rows = [("f", k, n, t) for t, k in enumerate(order)]
    files = [rows[: n // 2], [*rows[n // 3 : n // 2], *rows[n // 2 :], ("f", n, n, n), ("f", -1, n, n)], [("f", 0, n, n + 1)]]
    out, progress = ran(own, timed.arrivals_stream(feed(own, tmp_path / "in", schema, files)), tmp_path / "state")
    counted = collections.Counter(r[2] for r in out)
    assert counted == {"new": n, "complete": 1, "out of range": 2} and len({r[1] for r in out if r[2] == "new"}) == n
    assert kept(progress) <= 4 + 2  # pages, and the count


def test_files_share_a_shelf(own, tmp_path):
    """state is a value for each shelf, not pages and a count for each file; files of 63 to 66 chunks go past its first bits."""
    schema = "path string, idx long, chunk_count long, ts long"
    sizes = {f"f{k}": 63 + k % 4 if k < 8 else 1 + k % 3 for k in range(120)}
    rows = [(path, k, n, t) for t, (path, k, n) in enumerate((p, k, n) for p, n in sizes.items() for k in range(n))]
    random.Random(1).shuffle(rows)
    files = [rows[:300], rows[200:], rows[:50]]
    out, progress = ran(own, timed.arrivals_stream(feed(own, tmp_path / "in", schema, files), 4), tmp_path / "state")
    assert sorted(r[:2] for r in out if r[2] == "new") == sorted((p, k) for p, n in sizes.items() for k in range(n))
    assert sorted(r[0] for r in out if r[2] == "complete") == sorted(sizes)
    assert kept(progress) <= 4 + sum(n > 64 for n in sizes.values())


def test_arrivals_are_dealt_by_their_number(spark):
    """parts of a bounded number of arrivals, with the results of few parts."""
    from syncframe.streaming import chunk_arrivals

    rows = spark.createDataFrame([(f"p{k % 50}", k % 7, k) for k in range(1000)], "path string, idx long, ts long")
    counts = spark.createDataFrame([(f"p{k}", 3 + k % 4) for k in range(50)], "path string, chunk_count long")
    many = chunk_arrivals(rows, counts, 25)
    assert "hashpartitioning(path" in (plan := many._jdf.queryExecution().toString()) and ", 40)" in plan
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, chunk_arrivals(rows, counts).collect()))


def test_lifecycle_goes_on_from_a_batch(own, tmp_path):
    schema = "event_id long, path string, kind string, bytes long, ts timestamp"
    chance = random.Random(6)
    rows = [(k, f"p{chance.randrange(12)}", chance.choice(["chunk", "chunk", "chunk", "active", "done", "error"]), chance.randrange(9), at(k)) for k in range(120)]
    before, after = rows[:60], rows[60:]
    events = lambda part: own.createDataFrame(part, schema)
    states = file_states(events(before))
    stream = feed(own, tmp_path / "in", schema, [after, [(999, "end", "done", 0, at(5_000))]])
    out, _ = ran(own, timed.lifecycle_stream(stream, "10 seconds", states), tmp_path / "state")
    held = {r.path: r.state for r in states.collect()}
    for path, state, _, _ in sorted(out, key=lambda r: r[3]):
        held[path] = state
    whole = {r.path: (r.state, r.bytes) for r in file_states(events(rows)).collect()}
    assert held == {p: s for p, (s, _) in whole.items()}
    done = {p: b for p, s, b, _ in out if s in ("done", "error")}
    assert all(b <= whole[p][1] for p, b in done.items())


def test_sweeps_go_on_from_a_batch(own, tmp_path):
    schema = "session long, path string, kind string, ts timestamp"
    day = 86400
    rows = [(1, "a", "done", at(0)), (1, "a", "done", at(day)), (1, "b", "done", at(2 * day)), (2, "a", "done", at(day)), (9, "end", "done", at(9 * day))]
    events = own.createDataFrame(rows, schema)
    from syncframe.streaming import sweep

    batch = {tuple(r) for r in sweep(events, "1 day").collect()}
    mark = events.where("session = 1 and ts < '2024-01-02'").groupBy("session").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", "path", "kind"))), "\n"), 256).alias("fingerprint"))
    stream = feed(own, tmp_path / "in", schema, [rows[1:], [(9, "end", "done", at(12 * day))]])
    out, _ = ran(own, timed.sweep_stream(stream, "1 day", "1 hour", mark), tmp_path / "state")
    assert {(s, f) for s, _, f in out if s != 9} == {(s, f) for s, _, f in batch if s != 9} and len([r for r in out if r[0] == 1]) == 1


CHANGES = "path string, version long, deleted boolean, size long, mtime_ns long, content binary"


def change(path, version, content=None):
    return (path, version, content is None, None if content is None else len(content), version * 10, None if content is None else content)


def contents(spark, folder):
    rows = spark.read.parquet(f"{folder}/chunks").orderBy("path", "idx").collect()
    out = collections.defaultdict(bytes)
    for r in rows:
        out[r.path] += bytes(r.payload)
    return dict(out)


def test_a_mirror_that_dies_between_two_steps(own, tmp_path):
    files = [
        [change("a", 1, b"a" * 40), change("b", 1, b"b" * 10), change("c", 1, b"c" * 99)],
        [change("a", 2, b"a" * 20 + b"x" * 20), change("b", 2), change("c", 0, b"old")],
        [change("d", 3, b"dd"), change("a", 3, b"short")],
    ]
    folder, state = str(tmp_path / "mirror"), str(tmp_path / "state")
    seen, dies = [], {(1, "applied")}

    def after(batch, step):
        seen.append((batch, step))
        if (batch, step) in dies:
            dies.discard((batch, step))
            raise RuntimeError("killed")

    for part in files:
        own.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: continuous_mirror(own.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), folder, state, 16, 4, after)
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination()
    run().awaitTermination()
    assert contents(own, folder) == {"a": b"short", "c": b"c" * 99, "d": b"dd"}
    assert seen.count((1, "applied")) == 2 and (2, "entered") in seen
    assert {r.path: r.version for r in own.read.parquet(f"{folder}/files").collect()} == {"a": 3, "c": 1, "d": 3}


def test_a_replayed_batch_is_passed_over(own, tmp_path):
    folder, told = str(tmp_path / "mirror"), []
    own.createDataFrame([change("a", 1, b"one")], CHANGES).write.parquet(str(tmp_path / "in"))
    for k in range(2):  # a checkpoint that was lost: the same batch number comes again
        continuous_mirror(own.readStream.schema(CHANGES).parquet(str(tmp_path / "in")), folder, str(tmp_path / f"state{k}"), 16, 4, lambda b, s: told.append(s)).awaitTermination()
    assert told == ["applied", "entered", "passed over"] and contents(own, folder) == {"a": b"one"}


def test_a_large_bucket_is_written_by_several_tasks(own, tmp_path):
    """F8: a batch is dealt by its size and a bucket by several tasks, whatever the parts of the stream's session."""
    from syncframe.streaming import mirror

    parts = {"advisoryPartitionSizeInBytes": "64k", "coalescePartitions.minPartitionSize": "16k", "enabled": "false"}
    settings = {"spark.sql.shuffle.partitions": "1"} | {f"spark.sql.adaptive.{k}": v for k, v in parts.items()}
    kept = {k: own.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            own.conf.set(k, v)
        rows = own.range(0, 600, 1, 8).selectExpr("concat('f', id) path", "1L version", "false deleted", "2048L size", "id mtime_ns", "cast(array_join(transform(sequence(1, 16), k -> sha2(concat(id, '/', k), 512)), '') as binary) content")
        mirror.apply_changes(rows, str(tmp_path / "m"), 512, buckets=1)
        assert own.conf.get("spark.sql.adaptive.enabled") == "false"
        assert len(list((tmp_path / "m" / "chunks" / "bucket=0").glob("*.parquet"))) > 2
        assert own.read.parquet(str(tmp_path / "m" / "chunks")).agg(F.count("*"), F.sum("len")).first()[:] == (2400, 600 * 2048)
    finally:
        for k, v in kept.items():
            own.conf.unset(k) if v is None else own.conf.set(k, v)


def lies(session):
    """Bytes in the shared checkpoint folder, and of shuffles."""
    context = session.sparkContext
    size = lambda folder, pattern: sum(p.stat().st_size for p in pathlib.Path(folder).rglob(pattern) if p.is_file())
    return size(context.getCheckpointDir().removeprefix("file:"), "*"), size(context.getConf().get("spark.local.dir"), "shuffle_*")


def state_of(session, version, rows):
    """Changes of files with 2,048 bytes each, half of them those of every version; from the second on every tenth is deleted."""
    content = f"cast(array_join(transform(sequence(1, 16), k -> sha2(concat(id, '/', if(k < 8, 0, {version}), k), 512)), '') as binary) content"
    return session.range(rows).selectExpr("concat('f', id) path", f"{version}L version", f"id % 10 = 9 and {version} > 1 deleted", "2048L size", f"id + {version} mtime_ns", content)


def test_a_mirror_leaves_nothing_behind(own, tmp_path):
    """what was staged or shuffled for a change set is gone once it has been applied."""
    from syncframe.streaming.mirror import apply_changes

    scans.cut(own.range(1))  # names the folder
    for k in range(2):
        before = lies(own)
        apply_changes(state_of(own, k + 1, 600), str(tmp_path / "m"), 512, buckets=4)
        sinks.mirror_into(own.read.parquet(str(tmp_path / "m" / "chunks")).drop("bucket"), str(tmp_path / "copy"), buckets=4)
        after = lies(own)
        assert after[0] - before[0] < 1 << 17 and after[1] - before[1] < 3 << 20  # 1.2 MB of content, which was staged four times and shuffled
    apply_changes(state_of(own, 3, 0), str(tmp_path / "m"), 512, buckets=4)
    for folder in ("m/chunks", "copy"):
        assert own.read.parquet(str(tmp_path / folder)).agg(F.countDistinct("path"), F.sum("len")).first()[:] == (540, 540 * 2048)


def test_changes_are_applied_by_shares_of_the_buckets(own, tmp_path, monkeypatch):
    """besides the mirror, the disk holds the changes that are left and what one share needs."""
    from syncframe.streaming import mirror

    scans.cut(own.range(1))
    folder, seen, apply_share = str(tmp_path / "m"), [], mirror._apply_share

    def watched(changes, *rest):
        apply_share(changes, *rest)
        seen.append((rest[3], *lies(own)))

    for name, value in (("SHARE_BYTES", 1 << 16), ("SHARES", 4), ("_apply_share", watched)):
        monkeypatch.setattr(mirror, name, value)
    before = lies(own)
    for version, rows in ((1, 600), (2, 400)):
        mirror.apply_changes(state_of(own, version, rows), folder, 512, buckets=32)
    want = {(f"f{k}", 2 if k < 400 else 1) for k in range(600) if k >= 400 or k % 10 != 9}
    assert {(r.path, r.version) for r in own.read.parquet(f"{folder}/files").collect()} == want
    texts = state_of(own, 1, 600).where("cast(substring(path, 2) as int) >= 400").unionByName(state_of(own, 2, 400).where("not deleted"))
    assert contents(own, folder) == {r.path: bytes(r.content) for r in texts.collect()}
    assert len(seen) == 8 and all(sorted(b for held, *_ in seen[k : k + 4] for b in held) == list(range(32)) for k in (0, 4))
    assert lies(own)[0] == before[0]
    assert seen[0][1] > seen[2][1] > before[0]  # what is left of the changes, less with each share
    assert max(n for *_, n in seen) < before[1] + (1 << 18)  # a version has 1.2 MB of content


def test_mirror_into_rewrites_only_what_differs(spark, tmp_path):
    folder = str(tmp_path / "dst")
    row = "path string, idx long, hash string"
    rows = [(f"p{k}", 0, f"h{k}") for k in range(40)]
    frame = lambda r: spark.createDataFrame(r, row)
    sinks.mirror_into(frame([*rows, ("q/.fs-part-1", 0, "part"), ("gone", 0, "g"), ("gone", 1, "g")]), folder, buckets=8)
    before = {str(p) for p in (tmp_path / "dst").rglob("*.parquet")}
    changed = [*rows[:5], ("p5", 0, "other"), *rows[6:], ("new", 0, "n")]
    out = sinks.mirror_into(frame(changed), folder, buckets=8).collect()
    got = sorted(tuple(r) for r in spark.read.parquet(folder).select("path", "idx", "hash").collect())
    assert got == sorted([*changed, ("q/.fs-part-1", 0, "part")])
    assert (sum(r.added for r in out), sum(r.changed for r in out), sum(r.deleted for r in out)) == (1, 1, 1)
    touched = {f"bucket={r.bucket}" for r in out}
    after = {str(p) for p in (tmp_path / "dst").rglob("*.parquet")}
    assert {p for p in before & after if p.split("/")[-2] in touched} == set() and {p for p in before if p.split("/")[-2] not in touched} <= after
    assert sinks.mirror_into(frame(changed), folder, buckets=8).collect() == []
    assert sinks.mirror_into(frame([]), folder, buckets=8, delete=False).collect() == []
    sinks.mirror_into(frame([]), folder, buckets=8)
    assert [r.path for r in spark.read.parquet(folder).collect()] == ["q/.fs-part-1"]
