"""Sources and sinks over temporary files, and streams against their batch forms."""

import functools
import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from syncframe import sinks, sources, streaming
from syncframe.operators import aggregates, windows
from syncframe.operators.filters import chunks_of
from syncframe.streaming import stateful


def tree(top):
    for path, data in {"keep.txt": b"k" * 10, "skip.log": b"s", "sub/x.tmp": b"t", "sub/deep/y.txt": b"y" * 3000, "sub/zero": bytes(2048)}.items():
        full = top / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)
    os.symlink("keep.txt", top / "link")
    os.link(top / "keep.txt", top / "hard.txt")


def test_inventory(spark, tmp_path):
    tree(tmp_path)
    for levels in (0, 1, 2):
        rows = {r.path: r for r in sources.read_inventory(spark, [str(tmp_path)], ["*.log", "*.tmp"], levels).collect()}
        assert set(rows) == {"keep.txt", "hard.txt", "link", "sub", "sub/deep", "sub/deep/y.txt", "sub/zero"}
        assert rows["link"].kind == "symlink" and rows["link"].link_target == "keep.txt"
        assert rows["keep.txt"].mtime_ns == os.stat(tmp_path / "keep.txt").st_mtime_ns and rows["keep.txt"].ino == rows["hard.txt"].ino
    numbered = windows.number_entries(sources.read_inventory(spark, [str(tmp_path)]))
    paths = [r.path for r in numbered.orderBy("number").collect()]
    assert paths == sorted(paths, key=lambda p: p.split("/"))


def test_inventory_reads_what_is_asked(spark, tmp_path, monkeypatch):
    from syncframe.operators import filters, joins
    from syncframe.sources import files

    tree(tmp_path)
    os.mkfifo(tmp_path / "sub/pipe")
    everything = {r.path: r for r in sources.read_inventory(spark, [str(tmp_path)]).collect()}
    keep = everything["keep.txt"]
    s = os.stat(tmp_path / "keep.txt")
    assert (keep.uid, keep.atime_ns, keep.rdev, everything["sub/pipe"].kind) == (s.st_uid, s.st_atime_ns, None, "fifo") and keep.uname and keep.gname
    cheap = sources.read_inventory(spark, [str(tmp_path)], columns=["path"])
    assert {r.path for r in cheap.collect()} == set(everything)

    walk = files._Walk({"roots": json.dumps([str(tmp_path)]), "levels": "0"}, ["path"])
    looked, lstat = [], os.lstat
    with monkeypatch.context() as patch:
        patch.setattr(files.os, "lstat", lambda p, **k: looked.append(p) or lstat(p, **k))
        names = [r[0] for p in walk.partitions() for r in walk.read(p)]
    assert set(names) == set(everything) and looked == []

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        walk = files._FilteredWalk({"roots": json.dumps([str(tmp_path)]), "levels": "1"}, ["path", "kind"])
        rest = list(walk.pushFilters([files.EqualTo(("kind",), "file"), files.StringStartsWith(("path",), "sub/deep"), files.EqualTo(("size",), 3)]))
        assert len(rest) == 1 and [p.path for p in walk.partitions()] == ["", "sub"]
        assert [r for p in walk.partitions() for r in walk.read(p)] == [("sub/deep/y.txt", "file")]
        for condition in ("kind = 'file' and path like 'sub/%'", "kind in ('fifo', 'symlink')", "path = 'sub/zero'", "kind = 'dir'", "size > 5"):
            pushed = sources.read_inventory(spark, [str(tmp_path)]).where(condition)
            assert {r.path for r in pushed.collect()} == {r.path for r in spark.createDataFrame(list(everything.values()), pushed.schema).where(condition).collect()}, condition
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    manifest = sources.read_manifest(spark, [str(tmp_path)])
    linked = {r.path: (r.kind, r.link_ref) for r in windows.mark_hardlinks(manifest).collect()}
    number = {r.path: r.id for r in manifest.collect()}
    assert linked["keep.txt"] == ("hardlink", number["hard.txt"]) and linked["hard.txt"] == ("file", None)
    users = spark.createDataFrame([(keep.uname, 4242)], "name string, id long")
    assert {r.uid for r in joins.map_owners(manifest, users, users.limit(0), "name").collect()} == {4242}
    assert {r.n for r in manifest.select(F.size(filters.safe_xattrs(F.col("xattrs"))).alias("n")).collect()} <= {0, 1}


def test_large_files_are_hashed_in_blocks(spark, tmp_path):
    import tracemalloc

    from syncframe.sources.files import hash_of

    with open(tmp_path / "big", "wb") as f:
        f.truncate(300 << 20)
    for k in range(20):
        (tmp_path / f"f{k:02d}").write_bytes(bytes([k]) * (k * 1000))
    tracemalloc.start()
    sha = hash_of(str(tmp_path / "big"))
    assert tracemalloc.get_traced_memory()[1] < 2 << 20
    tracemalloc.stop()
    out = {r.path: r.sha for r in sources.hash_files(sources.read_inventory(spark, [str(tmp_path)]), 3).collect()}
    assert out["big"] == sha and len(out) == 21 and all(out[f"f{k:02d}"] == hashlib.sha256(bytes([k]) * (k * 1000)).hexdigest() for k in range(20))
    assert hash_of(str(tmp_path / "none")) is None


def test_chunks_and_assembly(spark, tmp_path):
    tree(tmp_path / "src")
    (tmp_path / "dst").mkdir()
    inventory = sources.read_inventory(spark, [str(tmp_path / "src")])
    chunks = sources.read_chunks(inventory, 1024)
    got = {(r.path, r.idx): (r.sha, r.all_zero) for r in chunks.collect()}
    assert got["sub/zero", 1] == (hashlib.sha256(bytes(1024)).hexdigest(), True) and len(got) == 1 + 1 + 1 + 1 + 3 + 2
    blobs = sources.read_blobs(spark, str(tmp_path / "src")).select(F.regexp_replace("path", ".*/src/", "").alias("path"), "size", "content")
    payloads = chunks_of(blobs, 1024).select("path", "idx", (F.col("idx") * 1024).alias("off"), "payload", F.sha2("payload", 256).alias("sha"))
    wanted = blobs.select("path", F.when(F.col("path") == "skip.log", "wrong").otherwise(F.sha2("content", 256)).alias("sha"))
    done = {r.path: r.ok for r in sinks.assemble_files(payloads, wanted, str(tmp_path / "dst")).collect()}
    assert done.pop("skip.log") is False and all(done.values())
    none = spark.createDataFrame([], "path string, idx long, off long, payload binary, sha string")
    empty = spark.createDataFrame([("e/empty", hashlib.sha256(b"").hexdigest())], "path string, sha string")
    assert [r.ok for r in sinks.assemble_files(none, empty, str(tmp_path / "dst")).collect()] == [True] and (tmp_path / "dst/e/empty").read_bytes() == b""
    assert (tmp_path / "dst/sub/deep/y.txt").read_bytes() == b"y" * 3000 and not (tmp_path / "dst/skip.log").exists()


def lines(n):
    prev, out = "", []
    for k in range(1, n + 1):
        detail = json.dumps({"path": "a<b", "n": k}).replace("<", "\\u003c")
        mark = hashlib.sha256(f"{prev}\0{k}\0t{k}\0done\0{detail}".encode()).hexdigest()
        out.append(f'{{"seq":{k},"ts":"t{k}","event":"done","detail":{detail},"prev":"{prev}","hash":"{mark}"}}')
        prev = mark
    return out


def test_journal_variants(spark, tmp_path):
    from syncframe.operators.journal import with_computed

    good = lines(5)
    texts = {
        "good": "\n".join(good) + "\n", "torn": "\n".join(good) + "\n" + good[0][:20], "junk": "\n".join([*good[:2], "{nope", *good[3:]]) + "\n",
        "edited": "\n".join([*good[:2], good[2].replace("t3", "t9"), *good[3:]]) + "\n", "lost": "\n".join([good[0], *good[2:]]) + "\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    read = sources.read_journal(spark, str(tmp_path)).withColumn("journal", F.regexp_extract("journal", "([^/]+)$", 1))
    got = {r.journal: (r.intact, r.problem) for r in windows.verify_chain(with_computed(read)).collect()}
    assert got == {"good": (5, None), "torn": (5, None), "junk": (2, None), "edited": (2, "altered entry"), "lost": (1, "broken link")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # every file in many splits
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        split = sources.read_journal(spark, str(tmp_path)).withColumn("journal", F.regexp_extract("journal", "([^/]+)$", 1))
        assert split.rdd.getNumPartitions() >= 1 and sources.journal_lines(spark, str(tmp_path)).count() == 5 + 6 + 5 + 5 + 4
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, read.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


ENTRIES = "journal string, ord long, ts string, event string, detail string"


def entries_of(spark, name, first, n):
    return spark.createDataFrame([(name, k, f"t{k}", 'an "event"', json.dumps({"n": k})) for k in range(first, first + n)], ENTRIES)


def verdicts(spark, folder):
    from syncframe.operators.journal import with_computed

    read = sources.read_journal(spark, folder).withColumn("journal", F.regexp_extract("journal", "journal=([^/]+)$", 1))
    return {r.journal: (r.intact, r.problem) for r in windows.verify_chain(with_computed(read)).collect()}


def pieces(tmp_path):
    return {str(p): p.read_bytes() for p in (tmp_path / "j").rglob("*.txt")}


def test_many_journals_together(spark, tmp_path):
    """an append is a few files whatever the number of journals; tails and evidence count as for journals of their own."""
    folder, odd = str(tmp_path / "j"), 'a +b%c=d "q\\'
    entries = lambda first, n, names: functools.reduce(lambda a, b: a.unionByName(b), [entries_of(spark, name, first, n) for name in names])
    names = [odd, *(f"n{k}" for k in range(20))]
    for first, n in ((0, 2), (2, 1)):
        sinks.append_to_journal(entries(first, n, names).coalesce(2), folder, together=True)
    assert len(pieces(tmp_path)) <= 8 and len(verdicts(spark, folder)) == 21
    assert set(verdicts(spark, folder).values()) == {(3, None)}

    def write(text, how):
        (at,) = [p for p in (tmp_path / "j" / "gen=00000001").glob("*.txt") if '"journal":"n3"' in p.read_text()]
        for crc in (tmp_path / "j").rglob(".*.crc"):
            crc.unlink()
        at.write_text(how(at.read_text(), text))

    write('{"journal":"n3","seq":4,"ts":"2026-01-', lambda old, new: old + new)  # a torn tail
    sinks.append_to_journal(entries(3, 1, ["n3", odd, "new"]), folder, together=True)
    told = verdicts(spark, folder)
    assert told["n3"] == (4, None) and told["n4"] == (3, None) and told["new"] == (1, None) and sorted(n for n, _ in told.values()) == [1, *[3] * 19, 4, 4]
    write('{"journal":"n3", tampered\n', lambda old, new: re.sub(r'\{"journal":"n3".*?\}\n', new, old, count=1))
    before = pieces(tmp_path)
    with pytest.raises(ValueError, match="n3"):
        sinks.append_to_journal(entries(4, 1, ["n3", "n4"]), folder, together=True)
    assert pieces(tmp_path) == before and verdicts(spark, folder)["n3"] == (2, None) and verdicts(spark, folder)["n4"] == (3, None)
    write("no telling whose\n", lambda old, new: old.replace('{"journal":"n3", tampered\n', new).replace('{"journal":"n3"', new + '{"journal":"n3"', 1))
    (at,) = [p.read_text() for p in (tmp_path / "j" / "gen=00000001").glob("*.txt") if "no telling" in p.read_text()]
    beside = [n for n in names[1:] if n != "n3" and f'"journal":"{n}"' in at]
    told = verdicts(spark, folder)
    assert all(told[n][0] == (2 if n in beside else 3) or at.index(f'"{n}"') < at.index("no telling") for n in names[1:] if n != "n3")
    with pytest.raises(ValueError, match="nothing is appended"):
        sinks.append_to_journal(entries(4, 1, ["new"]), folder, together=True)


def test_appends_go_on_after_a_torn_tail(spark, tmp_path):
    folder = str(tmp_path / "j")
    odd = "a +b%c=d"
    sinks.append_to_journal(entries_of(spark, odd, 0, 3).unionByName(entries_of(spark, "c", 0, 2)), folder)
    assert sorted(verdicts(spark, folder).values()) == [(2, None), (3, None)]
    sinks.append_to_journal(entries_of(spark, odd, 3, 1), folder)
    assert sorted(verdicts(spark, folder).values()) == [(2, None), (4, None)]
    (torn,) = [p for p in (tmp_path / "j").rglob("*.txt") if p.parent.parent.name == "journal=c"]
    with open(torn, "ab") as f:
        f.write(b'{"seq":3,"ts":"2026-01-01T00:00:0')
    for crc in (tmp_path / "j").rglob(".*.crc"):
        crc.unlink()
    sinks.append_to_journal(entries_of(spark, "c", 2, 1), folder)
    sinks.append_to_journal(entries_of(spark, "c", 3, 2).unionByName(entries_of(spark, "new", 0, 1)), folder)
    assert verdicts(spark, folder)["c"] == (5, None) and verdicts(spark, folder)["new"] == (1, None)
    seqs = [r.seq for r in sources.read_journal(spark, folder).where("journal like '%journal=c'").orderBy("line_no").collect()]
    assert seqs == [1, 2, 3, 4, 5]


def test_appends_are_refused_after_corruption(spark, tmp_path):
    folder = str(tmp_path / "j")
    sinks.append_to_journal(entries_of(spark, "a", 0, 5).unionByName(entries_of(spark, "b", 0, 2)), folder)
    (path,) = [p for p in (tmp_path / "j").rglob("*.txt") if p.parent.parent.name == "journal=a"]
    lines_ = path.read_text().split("\n")
    lines_[2] = "{ tampered, not json"
    path.write_text("\n".join(lines_))
    for crc in (tmp_path / "j").rglob(".*.crc"):
        crc.unlink()
    before = pieces(tmp_path)
    with pytest.raises(ValueError, match="a"):
        sinks.append_to_journal(entries_of(spark, "b", 2, 1).unionByName(entries_of(spark, "a", 5, 1)), folder)
    assert pieces(tmp_path) == before and verdicts(spark, folder) == {"a": (2, None), "b": (2, None)}
    sinks.append_to_journal(entries_of(spark, "b", 2, 1), folder)  # other journals go on
    assert verdicts(spark, folder) == {"a": (2, None), "b": (3, None)}


def test_a_descriptor_is_read_in_splits(spark, tmp_path):
    """a row is an entry, not the document; other layouts of the same document give the same rows."""
    files = spark.createDataFrame([(f"a {k}\n,x", k, 0o644, f"{k:064x}") for k in range(300)], "path string, size long, mode int, sha string")
    chunks = spark.createDataFrame([(f"a {k}\n,x", i, f"{i:064x}") for k in range(300) for i in range(k % 4)], "path string, idx long, sha string")
    sinks.write_spec(files, chunks, aggregates.spec_hash(files, chunks), str(tmp_path / "spec"), "demo")
    other = tmp_path / "other.json"
    other.write_text(json.dumps(json.loads(next((tmp_path / "spec").glob("part-*")).read_text()), indent=1))
    reader, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(reader, "8192b")
    try:
        for path in (tmp_path / "spec", other):
            back, parts = sources.read_spec(spark, str(path))
            assert sorted(map(tuple, back.collect())) == sorted(map(tuple, files.collect()))
            assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, chunks.collect()))
        assert sources.read_spec(spark, str(tmp_path / "spec"))[0].rdd.getNumPartitions() > 4
    finally:
        spark.conf.set(reader, before)


def test_documents_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("m.bin", 9, 0o644, "aa"), ("n.txt", 0, 0o600, "bb")], "path string, size long, mode int, sha string")
    chunks = spark.createDataFrame([("m.bin", 0, "c0"), ("m.bin", 1, "c1")], "path string, idx long, sha string")
    sinks.write_spec(files, chunks, aggregates.spec_hash(files, chunks), str(tmp_path / "spec"), "demo")
    back, parts = sources.read_spec(spark, str(tmp_path / "spec"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, files.collect())) and parts.count() == 2
    states = spark.createDataFrame([("f", "n1", 2500, 1_000_000_007, 256)], "path string, nonce string, size long, mtime_ns long, chunk_size long")
    marks = spark.createDataFrame([("f", k, "" if k % 3 else "Z") for k in range(10)], "path string, idx long, mark string")
    sinks.write_sidecars(marks, states, str(tmp_path / "side"))
    state = sources.read_sidecars(spark, str(tmp_path / "side")).first()
    assert state.mtime_ns == 1_000_000_007 and state.chunk_count == 10 and bytes(state.have) == bytes([0b01001001, 0b10])
    for text, want in (("", bytes(2)), ("/w==", b"\xff\0"), ("////", b"\xff\xff"), ("?", bytes(2))):  # cut or filled up to the grid
        doc = {"version": 1, "path": "g", "chunkCount": 9, "hashes": [""] * 9, "have": text}
        (tmp_path / "have.json").write_text(json.dumps(doc))
        assert bytes(sources.read_sidecars(spark, str(tmp_path / "have.json")).first().have) == want
    none = aggregates.spec_hash(files.limit(0), chunks.limit(0))
    sinks.write_spec(files.limit(0), chunks.limit(0), none, str(tmp_path / "none"), 'a "b"')
    assert sources.read_spec(spark, str(tmp_path / "none"))[0].collect() == []
    report = spark.createDataFrame([(2, 9, 0, 0)], "files long, bytes long, skipped long, errors long")
    sinks.write_receipt(report, spark.createDataFrame([("dd",)], "digest string"), str(tmp_path / "receipt"), "send", "host", "2024-01-01T00:00:00Z")
    assert spark.read.json(str(tmp_path / "receipt")).first().ok
    (tmp_path / "env.json").write_text(json.dumps({"version": 3, "origin": "o", "ts": "t", "endpoints": {"a": {"addr": "h:1"}}}))
    assert sources.read_envelopes(spark, str(tmp_path / "env.json")).first().addr == "h:1"
    (tmp_path / "pol.json").write_text(json.dumps({"endpoints": {"a": {"addr": "h:1", "include": ["*.txt"], "delete": True}}}))
    assert sources.read_policies(spark, str(tmp_path / "pol.json")).first().include == ["*.txt"]
    events = spark.createDataFrame([("2024-01-01 00:00:00.123", "done", "p", "m")], "ts string, type string, path string, msg string").withColumn("ts", F.col("ts").cast("timestamp"))
    sinks.write_events(events, str(tmp_path / "events"))
    assert sources.read_events(spark, str(tmp_path / "events")).exceptAll(events).isEmpty()


def streamed(spark, tmp_path, rows, run, mode="append"):
    where = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(where)
    stream = spark.readStream.schema(rows.schema).parquet(where)
    query = run(stream).writeStream.outputMode(mode).format("memory").queryName(f"q{abs(hash(where))}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(f"q{abs(hash(where))}")


def events_of(spark, sf_dir):
    from syncframe.plans.registry import view

    return view(spark, sf_dir, "transfer_events").withColumn("ts", F.col("ts").cast("timestamp"))


def test_stream_windows_equal_batch(spark, sf_dir, tmp_path):
    events = events_of(spark, sf_dir)
    run = lambda s: streaming.event_counters(s, "1 day", "1 hour")
    got = streamed(spark, tmp_path, events, run, "complete")
    assert got.exceptAll(run(events)).isEmpty() and got.count() == run(events).count()


def test_stream_debounce_equals_batch(spark, sf_dir, tmp_path):
    events = events_of(spark, sf_dir)
    run = lambda s: streaming.debounce(s, "6 hours", "40 days")
    assert streamed(spark, tmp_path, events, run, "complete").exceptAll(run(events)).isEmpty()


def test_other_folds(spark, tmp_path):
    rows = spark.createDataFrame([("j", k, f"t{k}", "e", "{}") for k in range(4)], "journal string, ord long, ts string, event string, detail string")
    from syncframe.operators.journal import append_journal

    got = streamed(spark, tmp_path / "j", rows, stateful.journal_stream)
    assert got.exceptAll(append_journal(rows).select(got.columns)).isEmpty() and got.count() == 4
    fetches = spark.createDataFrame([(1, "p", 1, 1, True), (1, "p", 2, 2, False), (1, "p", 3, 3, True)], "session long, peer string, ts long, ref long, ok boolean")
    got = {r.ref: r.banned for r in streamed(spark, tmp_path / "b", fetches, stateful.ban_stream).collect()}
    assert got == {1: False, 2: False, 3: True}
