"""Cases of the planning operators that the tables do not hold."""

import collections
import hashlib

from pyspark.sql import functions as F

from syncframe.operators import aggregates, journal, joins, sets, windows


def test_prune_nested_looks_at_all_ancestors(spark):
    chosen = spark.createDataFrame([("a",), ("a-b",), ("a/c",)], "path string")
    assert {r.path for r in joins.prune_nested(chosen).collect()} == {"a", "a-b"}


def test_delta_moves_only_changed_chunks(spark):
    body = bytes(range(256)) * 3
    row = lambda b, ns: [("f", "file", b, len(b), ns)]
    schema = "path string, kind string, content binary, size long, mtime_ns long"
    src = spark.createDataFrame(row(b"#" + body[1:256] + bytes(256) + body[512:], 2), schema)
    dst = spark.createDataFrame(row(body, 1), schema)
    sent = {r.idx: r.send for r in joins.delta_chunks(src, dst, 256).collect()}
    assert sent == {0: True, 1: True, 2: False}
    zero = spark.createDataFrame(row(bytes(768), 1), schema)
    assert all(r.send and not r.claimed for r in joins.delta_chunks(src, zero, 256).collect())


def test_spec_hash_is_byte_exact(spark):
    files = spark.createDataFrame([("meta.txt", 11, 0o640, "aa"), ("model.bin", 9, 0o104755, "bb")], "path string, size long, mode int, sha string")
    chunks = spark.createDataFrame([("model.bin", 1, "c1"), ("model.bin", 0, "c0")], "path string, idx long, sha string")
    text = "meta.txt\x0011\x00640\x00aa\x00" + "model.bin\x009\x004755\x00bb\x00" + "c0\x00c1\x00"
    assert aggregates.spec_hash(files, chunks).first()[0] == hashlib.sha256(text.encode()).hexdigest()


def test_spec_hash_of_each_source_as_a_stream(spark):
    rows = [(src, f"{src}/f{k}", k, 0o644, f"s{k}") for src in ("a", "b") for k in range(3)]
    parts = [(src, f"{src}/f{k}", i, f"{src}{k}{i:02}") for src in ("a", "b") for k in range(1, 3) for i in range(12)]
    files = spark.createDataFrame(rows, "source string, path string, size long, mode int, sha string")
    chunks = spark.createDataFrame(parts[::-1], "source string, path string, idx int, sha string")
    text = collections.defaultdict(str)
    for src, path, size, _, sha in rows:
        text[src] += f"{path}\0{size}\x00644\0{sha}\0" + "".join(f"{x[3]}\0" for x in parts if x[:2] == (src, path))
    hashed = {src: hashlib.sha256(t.encode()).hexdigest() for src, t in text.items()}
    out = aggregates.spec_hash(files, chunks, ["source"])
    assert {r.source: r.spec_hash for r in out.collect()} == hashed
    assert aggregates.spec_hash(files.limit(0), chunks).first()[0] == hashlib.sha256().hexdigest()
    one = aggregates.spec_hash(files.where("source = 'a'"), chunks)
    assert one.first()[0] == hashed["a"] and "collect_list" not in one._jdf.queryExecution().toString()



def test_journal_continues_behind_its_head(spark):
    rows = lambda a, b: spark.createDataFrame([("j", k, f"t{k}", "e", "{}") for k in range(a, b)], "journal string, ord long, ts string, event string, detail string")
    whole = journal.append_journal(rows(0, 5)).orderBy("seq").collect()
    first = journal.append_journal(rows(0, 3))
    head = first.groupBy("journal").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
    assert journal.append_journal(rows(3, 5), head).orderBy("seq").collect() == whole[3:]
    mark = hashlib.sha256(b"\x001\x00t0\x00e\x00{}").hexdigest()
    assert whole[0].hash == mark and whole[1].prev == mark
    assert windows.verify_chain(journal.with_computed(journal.append_journal(rows(0, 5)))).first().intact == 5


def test_digest_follows_the_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "id long, v string")
    digest = lambda d: aggregates.manifest_digest(d, F.col("v"), F.col("id")).first()[0]
    assert digest(a) == digest(a.repartition(3)) != digest(b)


def test_mirror_state_equals_source(spark):
    src = spark.createDataFrame([("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3")], "path string, idx long, hash string")
    dst = spark.createDataFrame([("a", 0, "1"), ("a", 1, "x"), ("old", 0, "9")], "path string, idx long, hash string")
    plan = src.join(dst.withColumnRenamed("hash", "h"), ["path", "idx"], "left").select("path", "idx", (~F.col("hash").eqNullSafe(F.col("h"))).alias("send"))
    state = sets.mirror_state(src, dst, plan)
    assert state.exceptAll(src).isEmpty() and src.exceptAll(state).isEmpty()


def test_lying_peer_is_banned(spark):
    holdings = spark.createDataFrame([("good", 0, 0), ("bad", 0, 0)], "peer string, file_idx long, chunk_idx long")
    fetches = spark.createDataFrame([("bad", True), ("bad", False), ("http", False), ("good", True)], "peer string, ok boolean")
    assert [r.peer for r in joins.exclude_banned(holdings, fetches).collect()] == ["good"]


def test_evict_keeps_seeds(spark):
    rows = [(1, f"m{k}", False, k) for k in range(4)] + [(1, f"s{k}", True, 0) for k in range(3)]
    kept = windows.evict_stalest(spark.createDataFrame(rows, "room long, addr string, seed boolean, seen long"), 4)
    assert {r.addr for r in kept.collect()} == {"s0", "s1", "s2", "m3"}


def test_bounds_of_range_headers(spark):
    """the least and the greatest header as text, with no row for a chunk: a file of 2^62 bytes would have 2^38 of them."""
    from syncframe.operators import filters

    sizes = [0, 1, 9, 10, 11, 99, 100, 101, 998, 1000, 1001, 4096, 12345, 20000]
    files = spark.createDataFrame([(f"f{n}", n) for n in sizes], "path string, size long")
    for step in (1, 3, 7, 10, 64):
        got = {r.path: (r.n, r.low, r.high) for r in filters.header_bounds(files, step).collect()}
        for n in sizes:
            headers = [f"bytes={k}-{min(k + step, n) - 1}" for k in range(0, n, step)]
            assert got.get(f"f{n}") == ((len(headers), min(headers), max(headers)) if n else None), (n, step)
    assert filters.header_bounds(spark.createDataFrame([("big", 1 << 62)], "path string, size long")).first().n == 1 << 38
