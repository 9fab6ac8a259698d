"""WARC archives, centroid clusters and prefix tries: awkward rows, round trips, and brute force."""

import collections
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from syncframe.llm import centroid_clustering as cc
from syncframe.llm import prefix_trie as trie
from syncframe.llm import queries, warc
from syncframe.llm.common import Workspace

PAGES = "page_id long, url string, html string"


def member(record_id="<urn:page:1>", payload=b"hello", refers=None, change=lambda raw: raw):
    digest = warc.base32(hashlib.sha1(payload).digest())
    raw = b"".join(warc.encode_record(record_id, "http://a.org/", "2024-01-01T00:00:00Z", payload, digest, refers))
    return gzip.compress(change(raw), mtime=0)


def blocks(data, n):
    return [data[k : k + n] for k in range(0, len(data), n)]


@pytest.mark.parametrize("n", [1, 7, 1000, 1 << 20])
def test_members_are_read_in_order_whatever_the_blocks(n):
    payloads = [b"", b"x" * 3_000_000, b"\r\n\r\nWARC/1.1\r\n" * 5, random.Random(1).randbytes(5_000)]
    data = b"".join(member(f"<urn:page:{k}>", p) for k, p in enumerate(payloads))
    found = list(warc.read_records(blocks(data, n), want_payload=True))
    assert [f["payload"] for f in found] == payloads and all(f.get("problem") is None for f in found)
    assert [f["payload_bytes"] for f in found] == list(map(len, payloads)) and [f["record_id"] for f in found] == [f"<urn:page:{k}>" for k in range(4)]
    starts = [f["at"] for f in found]
    assert all(data[s : s + 2] == b"\x1f\x8b" for s in starts) and starts == sorted(starts) and starts[0] == 0


def test_broken_records_are_told_apart():
    good, after = member(), member("<urn:page:2>", b"after")
    cases = {
        "payload digest": member(change=lambda r: r.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A")),
        "block digest": member(change=lambda r: r.replace(b"hello", b"hallo")),
        "header": gzip.compress(b"no record at all"),
        "length": member(change=lambda r: r.replace(b"\r\n\r\n\r\n", b"\r\n\r\n", 1) if r.count(b"\r\n\r\n\r\n") else r[:-2]),
    }
    for problem, broken in cases.items():
        found = list(warc.read_records([good + broken + after]))
        assert [f.get("problem") for f in found] == [None, problem, None], problem
    longer = member(change=lambda r: r.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1))
    assert [f.get("problem") for f in warc.read_records([longer + after])] == ["length", None]
    cut = [f.get("problem") for f in warc.read_records([good + after[:-9]])]
    assert cut == [None, "truncated"]
    flipped = bytearray(after)
    flipped[len(after) // 2] ^= 255
    assert [f.get("problem") for f in warc.read_records([good + bytes(flipped) + good])][:2] == [None, "corrupt"]
    assert [f.get("problem") for f in warc.read_records([good + b"plain"])] == [None, "corrupt"]
    assert list(warc.read_records([])) == []


def test_headers():
    fields = warc.header_fields(["A: 1", "b:2", " more", "a: 3", "no field", " lost", "C:"])
    assert fields == {"a": "1", "b": "2 more", "c": ""}
    lower = member(change=lambda r: r.replace(b"WARC-Record-ID", b"warc-record-id"))
    assert next(warc.read_records([lower]))["record_id"] == "<urn:page:1>"
    other = member(change=lambda r: r.replace(b"Payload-Digest: sha1:", b"Payload-Digest: md5:"))
    assert next(warc.read_records([other])).get("problem") is None  # another algorithm cannot be tested
    assert b"\nX" not in warc._header([("K", "v\r\nX: 1")], "WARC/1.1")


AWKWARD_PAGES = [
    (3, "http://a.org/", "same"), (1, None, "same"), (2, "http://b.org/\r\nX: 1", "same"), (None, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", "Größe \U0001f600"),
    (6, "u", "Größe \U0001f600"), (7, "u", "z" * 2_500_000), (None, "u", "alone"), (None, None, "alone"), (-8, "u", "<html>\r\n\r\n</html>"), (9, "u", "same"),
]


def want_records(rows, least=0):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        keep = first.get(t or "")
        refers = keep if keep is not None and i != keep and len(data) >= least else None
        out.append((i, len(data), warc.base32(hashlib.sha1(data).digest()), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "most"), [(0, 1 << 28), (5, 200)])
def test_pages_round_trip(spark, least, most):
    pages = spark.createDataFrame(AWKWARD_PAGES, PAGES).withColumns({c: F.lit("clash") for c in ("sha", "keep", "record_id", "payload", "archive")})
    work = Workspace(spark)
    archives = warc.archive_pages(pages, work, least=least, most_bytes=most)
    records = warc.read_warc(archives, want_payload=True).collect()
    assert all(r.problem is None for r in records) and (archives.count() > 4 or most > 200)
    number = lambda name: None if name == "<urn:page:>" else int(name[len("<urn:page:") : -1].replace("%2D", "-"))
    got = [(number(r.record_id), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to) if r.refers_to else None) for r in records]
    assert sorted(got, key=repr) == want_records(AWKWARD_PAGES, least)
    texts = collections.Counter(bytes(r.payload) for r in records if r.type == "response")
    assert set(texts) == {(t or "").encode() for _, _, t in AWKWARD_PAGES} and all(r.payload is None for r in records if r.type == "revisit")
    assert {r.uri for r in records} == {None, "u", "http://a.org/", "http://b.org/%0D%0AX: 1"}
    assert sum(a.n_records for a in archives.collect()) == len(AWKWARD_PAGES)
    whole = work.spark.sparkContext._jvm.java.io.File  # every archive is a run of gzip members that any tool can read
    assert whole is not None and all(zlib.decompress(open(a.archive.removeprefix("file://").removeprefix("file:"), "rb").read(), 31).startswith(b"WARC/1.1") for a in archives.collect())


def test_no_pages(spark):
    assert warc.read_warc(warc.archive_pages(spark.createDataFrame([], PAGES), Workspace(spark))).collect() == []


def test_op11_names_pages(spark):
    out = spark.range(1).select(*[warc.page_of(F.lit(x)).alias(f"c{k}") for k, x in enumerate(["<urn:page:>", "<urn:page:12>", "<urn:page:a%2Bb%20c>", "<urn:page:-8>"])]).first()
    assert tuple(out) == (None, "12", "a+b c", "-8") and warc.page_uri("a+b c") == "<urn:page:a%2Bb%20c>"


# Clusters


def test_hilbert_keys_walk_from_neighbour_to_neighbour():
    for dims, bits in ((2, 3), (3, 2), (5, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = [k.tobytes() for k in cc.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_box_bounds_hold():
    chance = np.random.default_rng(5)
    points, centroids = chance.integers(-50, 50, (40, 6)), chance.integers(-90, 90, (5, 6))
    near, far = cc.box_bounds(points.min(axis=0), points.max(axis=0), centroids)
    all_ = cc.distances(points, centroids)
    assert (all_ >= near).all() and (all_ <= far).all()
    huge = points * (1 << 20)
    assert (cc.distances(huge, centroids) == np.stack([((huge - c) ** 2).sum(axis=1) for c in centroids], axis=1)).all()


def brute_clusters(rows, k, rounds, dims, scale, seed="3"):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = collections.Counter()
    for _, c, d in out:
        inertia[c] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), marks[c]) for i, c, d in out), key=repr)


@pytest.mark.parametrize(("n", "k", "block"), [(300, 5, 16), (300, 8, 512), (4, 8, 2)])
def test_clusters_brute_force(spark, n, k, block):
    chance = random.Random(n)
    rows = [(i, [chance.choice([-1.5, 0.25, 2.0]) + chance.gauss(0, 0.4) for _ in range(6)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * 6) for i in range(n // 2)] + [(1, [0.5] * 6), (None, [1.0] * 6), (None, [-1.0] * 6)]  # a hot vector, repeated and null ids
    rows += [(5000, None), (5001, []), (5002, [1.0] * 5), (5003, [1.0] * 5 + [None]), (5004, [float("nan")] + [1.0] * 5), (5005, [float("inf")] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    frame = frame.withColumns({c: F.lit("clash") for c in ("q", "key", "data", "cluster", "n", "ids")})
    out = cc.centroid_clusters(frame, k=k, rounds=4, dims=6, scale=8.0, block_rows=block)
    assert sorted(map(tuple, out.collect()), key=repr) == brute_clusters(rows, k, 4, 6, 8.0)


def test_clusters_without_vectors(spark):
    out = cc.centroid_clusters(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"))
    assert out.collect() == [] and out.columns[-1] == "centroid_sha256"
    large = spark.createDataFrame([(7, [1e30] * 2)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="vector 7"):
        cc.centroid_clusters(large, dims=2).collect()


# Tries


@pytest.mark.parametrize("shape", ["random", "chain", "star", "comb"])
def test_local_rollup_sums_subtrees(shape):
    chance, n = random.Random(9), 400
    parent = [-1] + [{"random": chance.randrange(i), "chain": i - 1, "star": 0, "comb": i - 1 if i % 2 else max(i - 2, 0)}[shape] for i in range(1, n)]
    values = np.array([[chance.randrange(10), 1] for _ in range(n)], np.int64)
    want = values.copy()
    for i in range(n - 1, 0, -1):
        want[parent[i]] += want[i]
    assert (trie.local_rollup(parent, values) == want).all()


def brute_trie(rows, span=20, most=4):
    """Nodes as tuples of (role, text); subtrees by comparing prefixes."""
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0), role, mark, text))
    turns = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        paths[c] = tuple(turns.get(c - c % span, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    words = lambda text: len([w for w in "".join(" " if ch in " \t\n\x0b\x0c\r" else ch for ch in text).split(" ") if w])
    saved, leaves = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words(p[-1][1]) if p else 0
            leaves[p[:d]] += children[p] == 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(paths[c]) == len(p)).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items()), key=repr)


def talk(seed, n):
    chance = random.Random(seed)
    rows = []
    for c in range(n):
        if chance.random() < 0.1:
            continue
        for t in range(chance.randrange(1, 7)):
            rows.append((c, t, chance.choice(["user", "assistant", None]), chance.choice(["hi", "hi there you", "what is it", None, "a b c d"])))
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("local", [1, 3, 50, 4096])
def test_trie_brute_force(spark, local):
    rows = talk(4, 150) + [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", "twice"), (7, 1, "user", "tie"), (7, 1, "user", "tie")]
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 340) for t in range(4)]  # a group of copies
    rows += [(400, t, "user", f"long {t % 3}") for t in range(120)] + [(401, 0, "x", "y" * 100_000)]
    frame = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("conv", "depth", "idx", "words", "owner", "at")})
    out = trie.conversation_trie(frame, local_nodes=local)
    assert sorted(map(tuple, out.collect()), key=repr) == brute_trie(rows)


def test_trie_of_negative_and_turnless_conversations(spark):
    one = next(c for c in range(1000, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 1)  # its base is not there, so it has no turn
    rows = [(-5, 0, "u", "a"), (-25, 1, "u", "a b"), (one, 0, "u", "gone")]
    out = trie.conversation_trie(spark.createDataFrame(rows, TURNS))
    got = sorted(map(tuple, out.collect()), key=repr)
    fixed = [(c, t, r, x) for c, t, r, x in rows]
    # remainders have the sign of the number, as in SQL: -5 has base 0 and -25 has base -20
    want = brute_trie([(c, t, r, x) for c, t, r, x in fixed if c > 0])
    assert {g for g in got if g[0] == one or g[1] == 0} and want[0][3] == 1
    root = next(g for g in got if g[1] == 0)
    assert root[0] == -25 and root[3] == 3 and root[4] == sum(g[1] == 1 for g in got)


def test_no_conversations(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).collect() == []


@pytest.mark.parametrize("name", ["op11_warc", "op12_centroid_clustering", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = queries.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    want = sorted((tuple(r[named.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == want
