"""Queries over the planning operators: joins, aggregates, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncframe import functions as S
from syncframe.operators import aggregates, filters, joins, sets, windows
from syncframe.plans.registry import query
from syncframe.plans.scalar import LADDER

STATUS = """qc AS (SELECT s.path, s.size, CASE WHEN d.size = s.size AND d.mtime_ns = s.mtime_ns THEN 'skip' WHEN s.size = 0 THEN 'empty'
  WHEN d.path IS NULL THEN 'new' WHEN d.size = s.size THEN 'delta' ELSE 'full' END AS status FROM src_files s LEFT JOIN dst_files d ON s.path = d.path)"""
IDENT = """sha256(unhex('01') || unhex(CASE WHEN octet_length(encode(path)) < 128 THEN printf('%02x', octet_length(encode(path)))
         ELSE printf('%02x%02x', octet_length(encode(path)) & 127 | 128, octet_length(encode(path)) >> 7) END) || encode(path)
       || unhex(CASE WHEN idx < 128 THEN printf('%02x', idx) ELSE printf('%02x%02x', idx & 127 | 128, idx >> 7) END) || payload)"""


def _chunks(files: str, name: str) -> str:
    return f"""{name}g AS (SELECT path, content, size, unnest(generate_series(0, (size + 255) // 256 - 1)) AS idx FROM {files} WHERE size > 0),
{name} AS (SELECT path, idx, least(256, size - idx * 256) AS len, array_slice(content, idx * 256 + 1, idx * 256 + 256) AS payload FROM {name}g)"""


DELTA = f"""{STATUS}, {_chunks("(SELECT * FROM src_files WHERE path IN (SELECT path FROM qc WHERE status = 'delta'))", "sc")},
{_chunks("(SELECT * FROM dst_files WHERE path IN (SELECT path FROM qc WHERE status = 'delta'))", "dc")},
sh AS (SELECT path, idx, len, {IDENT} AS hash FROM sc), dh AS (SELECT path, idx, {IDENT} AS hash, regexp_matches(hex(payload), '^(00)*$') AS zero FROM dc),
dl AS (SELECT sh.path, sh.idx, sh.len, coalesce(NOT zero, false) AS claimed, NOT (coalesce(NOT zero, false) AND sh.hash = dh.hash) AS send
       FROM sh LEFT JOIN dh ON sh.path = dh.path AND sh.idx = dh.idx)"""


@query(f"WITH {STATUS} SELECT * FROM qc")
def quick_check(src_files, dst_files):
    return joins.quick_check(src_files, dst_files)


@query(f"WITH {DELTA} SELECT path, idx, len, claimed, coalesce(send, true) AS send FROM dl")
def delta_chunks(src_files, dst_files):
    return joins.delta_chunks(src_files, dst_files, 256)


@query(f"""WITH {DELTA} SELECT path, sum(claimed::INT)::BIGINT AS claims, sum((claimed AND send)::INT)::BIGINT AS cleared,
CASE WHEN sum((claimed AND send)::INT) = 0 THEN 'commit' ELSE 'claim_result' END AS verdict FROM dl GROUP BY path""")
def verify_claims(src_files, dst_files):
    return joins.verify_claims(joins.delta_chunks(src_files, dst_files, 256))


@query("SELECT path, size FROM dst_files WHERE path NOT IN (SELECT path FROM src_files)")
def mirror_deletes(src_files, dst_files):
    return joins.mirror_deletes(src_files, dst_files)


@query(f"""WITH {DELTA}, a AS (SELECT status, count(*) AS files, sum(size)::BIGINT AS bytes FROM qc GROUP BY status),
m AS (SELECT sum(CASE WHEN send THEN len ELSE 0 END)::BIGINT AS moved FROM dl)
SELECT status, files, bytes, (CASE status WHEN 'skip' THEN 0 WHEN 'delta' THEN (SELECT coalesce(moved, 0) FROM m) ELSE bytes END)::BIGINT AS moved_bytes FROM a
UNION ALL SELECT 'delete', count(*), coalesce(sum(size), 0)::BIGINT, 0 FROM dst_files WHERE path NOT IN (SELECT path FROM src_files)""")
def mirror_plan(src_files, dst_files):
    """What a mirror would send, skip and delete, by status."""
    checked = joins.quick_check(src_files, dst_files)
    by_status = checked.groupBy("status").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    moved = joins.delta_chunks(src_files, dst_files, 256).where("send").groupBy(F.lit("delta").alias("status")).agg(F.sum("len").alias("moved"))
    bytes_ = F.when(F.col("status") == "skip", F.lit(0)).when(F.col("status") == "delta", F.coalesce("moved", F.lit(0))).otherwise(F.col("bytes"))
    deleted = joins.mirror_deletes(src_files, dst_files).agg(F.lit("delete").alias("status"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.lit(0).cast("long").alias("moved_bytes"))
    return by_status.join(moved, "status", "left").select("status", "files", "bytes", bytes_.cast("long").alias("moved_bytes")).unionByName(deleted)


MARKED = """mh AS (SELECT *, CASE WHEN ino <> 0 THEN min(id) OVER (PARTITION BY dev, ino) END AS f FROM linked),
ml AS (SELECT id, path, CASE WHEN f <> id THEN 'hardlink' ELSE kind END AS kind, CASE WHEN f <> id THEN f END AS link_ref, CASE WHEN f <> id THEN 0 ELSE size END AS size FROM mh)"""


@query(f"WITH {MARKED} SELECT * FROM ml")
def mark_hardlinks(linked):
    return windows.mark_hardlinks(linked).select("id", "path", "kind", "link_ref", "size")


@query(f"""WITH {MARKED}, d AS (SELECT id, path FROM ml WHERE kind = 'file' AND id % 13 <> 0)
SELECT l.id, l.link_ref, d.path AS target, d.path IS NOT NULL AS ok FROM ml l LEFT JOIN d ON l.link_ref = d.id WHERE l.kind = 'hardlink'""")
def resolve_hardlinks(linked):
    return joins.resolve_hardlinks(windows.mark_hardlinks(linked), linked.where("id % 13 = 0"))


@query("""WITH c AS (SELECT id, path, size + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS size, mtime_ns + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS ns,
  CASE WHEN id % 19 = 0 THEN 2 ELSE 1 END AS v, CASE WHEN id % 17 = 0 THEN 0 ELSE 256 END AS cs, (size + 255) // 256 + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS n, id % 23 = 0 AS moved FROM src_files)
SELECT CASE WHEN moved THEN path || 'x' ELSE path END AS path, CASE WHEN v <> 1 THEN 'version' WHEN moved THEN 'path' WHEN id % 11 = 0 THEN 'size' WHEN id % 7 = 0 THEN 'mtime' WHEN cs <= 0 THEN 'grid'
  WHEN n <> (size + 255) // 256 THEN 'count' END AS reason FROM c""")
def validate_sidecars(src_files):
    side = src_files.selectExpr(
        "if(id % 23 = 0, concat(path, 'x'), path) as path", "size + if(id % 11 = 0, 1, 0) as size", "mtime_ns + if(id % 7 = 0, 1, 0) as mtime_ns",
        "if(id % 19 = 0, 2, 1) as version", "if(id % 17 = 0, 0, 256) as chunk_size", "(size + 255) div 256 + if(id % 13 = 0, 1, 0) as chunk_count",
    )
    return joins.validate_sidecars(side, src_files)


@query(f"""WITH {_chunks('src_files', 'c')}, p AS (SELECT path, idx, sha256(payload) AS hash, (idx + length(path)) % 5 = 0 AS zero FROM c),
k AS (SELECT * FROM p WHERE length(path) % 3 <> 0)
SELECT path, idx, CASE WHEN length(path) % 3 = 0 THEN CASE WHEN zero THEN 'drop' ELSE 'untrusted' END WHEN idx % 4 = 3 THEN 'drop' WHEN zero AND idx % 2 = 0 THEN 'keep' WHEN zero THEN 'drop' WHEN idx % 6 = 0 THEN 'drop' ELSE 'keep' END AS action FROM p""")
def rehash_resume(src_files):
    part = filters.chunks_of(src_files, 256).select("path", "idx", F.sha2("payload", 256).alias("hash"), F.expr("(idx + length(path)) % 5 = 0").alias("zero"))
    mark = F.expr("case when idx % 4 = 3 then '' when zero and idx % 2 = 0 then 'Z' when zero then hash when idx % 6 = 0 then 'other' else hash end")
    return joins.rehash_resume(part, part.where("length(path) % 3 <> 0").select("path", "idx", mark.alias("mark")))


@query("""SELECT s.file_idx, s.chunk_idx, s.len FROM spec_chunks s WHERE NOT EXISTS (SELECT 1 FROM holdings h WHERE h.file_idx = s.file_idx AND h.chunk_idx = s.chunk_idx)""")
def missing_chunks(spec_chunks, holdings):
    """What no peer has."""
    return joins.missing_chunks(spec_chunks, holdings.select("file_idx", "chunk_idx"))


@query(f"""WITH {_chunks('src_files', 'sc')}, {_chunks('dst_files', 'dc')},
spec AS (SELECT path, idx, sha256(payload) AS want FROM sc WHERE length(path) % 4 <> 0)
SELECT d.path, d.idx, CASE WHEN d.path NOT IN (SELECT path FROM spec) THEN 'deferred' WHEN s.want IS NULL THEN 'short' WHEN s.want = sha256(d.payload) THEN 'ok' ELSE 'bad' END AS verdict
FROM dc d LEFT JOIN spec s ON s.path = d.path AND s.idx = d.idx""")
def verify_chunks(src_files, dst_files):
    spec = filters.chunks_of(src_files, 256).where("length(path) % 4 <> 0").select("path", "idx", F.sha2("payload", 256).alias("want"))
    return joins.verify_chunks(spec, filters.chunks_of(dst_files, 256).select("path", "idx", F.sha2("payload", 256).alias("sha")))


@query("""SELECT coalesce(s.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'missing' WHEN s.path IS NULL THEN 'extra' WHEN sha256(s.content) = sha256(d.content) THEN 'ok' ELSE 'mismatch' END AS verdict
FROM src_files s FULL JOIN dst_files d ON s.path = d.path""")
def verify_files(src_files, dst_files):
    sha = F.sha2("content", 256).alias("sha")
    return joins.verify_files(src_files.select("path", sha), dst_files.select("path", sha))


FETCHES = "f AS (SELECT concat('peer', l_suppkey) AS peer, CAST(l_partkey % 100 AS BIGINT) AS file_idx, CAST(l_linenumber AS BIGINT) AS chunk_idx, l_shipdate AS ts, l_quantity > 2 OR l_suppkey % 4 <> 0 AS ok FROM lineitem)"


def _fetches(lineitem):
    return lineitem.selectExpr("concat('peer', l_suppkey) as peer", "cast(l_partkey % 100 as bigint) as file_idx", "cast(l_linenumber as bigint) as chunk_idx", "l_shipdate as ts", "l_quantity > 2 or l_suppkey % 4 <> 0 as ok")


@query(f"WITH {FETCHES} SELECT * FROM holdings WHERE peer NOT IN (SELECT peer FROM f WHERE NOT ok)")
def exclude_banned(holdings, lineitem):
    return joins.exclude_banned(holdings, _fetches(lineitem))


ASSIGNED = """l AS (SELECT file_idx, chunk_idx, peer, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY file_idx, chunk_idx) AS n FROM holdings JOIN spec_chunks USING (file_idx, chunk_idx) WINDOW w AS (PARTITION BY file_idx, chunk_idx ORDER BY peer)),
t AS (SELECT file_idx, chunk_idx, peer, ((place - (file_idx * 31 + chunk_idx)) % n + n) % n + 1 AS try_no FROM l),
a AS (SELECT * FROM t UNION ALL SELECT s.file_idx, s.chunk_idx, 'http', coalesce(max(t.try_no), 0) + 1 FROM spec_chunks s LEFT JOIN t ON s.file_idx = t.file_idx AND s.chunk_idx = t.chunk_idx GROUP BY 1, 2)"""


@query(f"WITH {ASSIGNED} SELECT file_idx, chunk_idx, peer, try_no FROM a")
def chunk_sources(spec_chunks, holdings):
    return joins.assign_sources(spec_chunks.select("file_idx", "chunk_idx"), holdings)


@query(f"WITH {ASSIGNED} SELECT peer, count(*) AS first_tries FROM a WHERE try_no = 1 GROUP BY peer")
def assign_sources(spec_chunks, holdings):
    chosen = joins.assign_sources(spec_chunks.select("file_idx", "chunk_idx"), holdings).where("try_no = 1")
    return chosen.groupBy("peer").agg(F.count("*").alias("first_tries"))


@query(r"""SELECT 'all' AS target, path FROM src_files UNION ALL SELECT 'english', path FROM src_files WHERE len(list_filter(string_split(path, '/'), lambda p: p = 'en')) > 0
UNION ALL SELECT 'some', path FROM src_files WHERE regexp_matches(path, '/d[^/]*1\.txt$') AND NOT regexp_matches(path, '^src[23](/|$)')""")
def apply_policy(src_files):
    return joins.apply_policies(src_files, [{"target": "all"}, {"target": "english", "include": ["en"]}, {"target": "some", "include": ["d*1.txt"], "exclude": ["src[23]"]}])


SNAP = "SELECT concat(node, '/', name) AS name, min(addr) AS addr FROM envelopes WHERE {} GROUP BY node, name"


@query(f"""WITH e AS ({SNAP.format("version % 2 = 0")}), l AS (SELECT concat(node, '/', name) AS name, min(addr) AS addr, min(version) % 3 = 0 AS managed FROM envelopes WHERE version % 3 < 2 GROUP BY node, name)
SELECT coalesce(e.name, l.name) AS name, coalesce(e.addr, l.addr) AS addr, e.name IS NOT NULL AS managed FROM l FULL JOIN e ON l.name = e.name WHERE e.name IS NOT NULL OR NOT l.managed""")
def merge_snapshot(envelopes):
    """Names are those of each node."""
    named = envelopes.withColumn("name", F.concat_ws("/", "node", "name"))
    local = named.where("version % 3 < 2").groupBy("name").agg(F.min("addr").alias("addr"), (F.min("version") % 3 == 0).alias("managed"))
    new = named.where("version % 2 = 0").groupBy("name").agg(F.min("addr").alias("addr"))
    return joins.merge_snapshot(local, new)


@query("""WITH e AS (SELECT c_custkey AS id, c_custkey % 7 + 1000 AS uid, c_custkey % 5 + 2000 AS gid, concat('u', c_nationkey % 30) AS uname, lower(c_mktsegment) AS gname FROM customer),
u AS (SELECT concat('u', n_nationkey) AS name, n_nationkey * 10 AS id FROM nation WHERE n_nationkey % 2 = 0)
SELECT e.id, coalesce(u.id, e.uid)::BIGINT AS uid, CASE gname WHEN 'building' THEN 50 WHEN 'machinery' THEN 51 ELSE e.gid END::BIGINT AS gid FROM e LEFT JOIN u ON e.uname = u.name""")
def map_owners(customer, nation):
    entries = customer.selectExpr("c_custkey as id", "c_custkey % 7 + 1000 as uid", "c_custkey % 5 + 2000 as gid", "concat('u', c_nationkey % 30) as uname", "lower(c_mktsegment) as gname")
    users = nation.where("n_nationkey % 2 = 0").selectExpr("concat('u', n_nationkey) as name", "cast(n_nationkey * 10 as bigint) as id")
    groups = customer.select(F.lower("c_mktsegment").alias("name")).distinct().where("name in ('building', 'machinery')").withColumn("id", F.expr("cast(if(name = 'building', 50, 51) as bigint)"))
    return joins.map_owners(entries, users, groups, "name")


@query("""WITH s AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS link FROM tree WHERE kind = 'symlink' AND id % 3 = 0)
SELECT DISTINCT path FROM tree WHERE len(string_split(path, '/')) > 2 AND array_to_string(string_split(path, '/')[1:2], '/') IN (SELECT link FROM s)""")
def unsafe_parents(tree):
    links = tree.where("kind = 'symlink' and id % 3 = 0").select(F.array_join(F.slice(S.components(F.col("path")), 1, 2), "/").alias("path")).distinct()
    return joins.unsafe_parents(tree, links)


@query("""WITH s AS (SELECT DISTINCT path FROM listing UNION SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') FROM listing WHERE id % 9 = 0)
SELECT path FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE starts_with(s.path, p.path || '/'))""")
def prune_nested(listing):
    some = listing.where("id % 9 = 0").select(F.array_join(F.slice(S.components(F.col("path")), 1, 2), "/").alias("path"))
    return joins.prune_nested(listing.select("path").unionByName(some).distinct())


@query("WITH m AS (SELECT DISTINCT room, addr FROM announces) SELECT a.addr, a.room, b.addr AS other FROM m a JOIN m b ON a.room = b.room AND a.addr <> b.addr")
def room_members(announces):
    """What each announce is told where no number bounds it: all others."""
    return joins.room_members(_members(announces), None)


@query("""WITH RECURSIVE r AS (SELECT id, ts, 'offer' AS kind, offer AS ref FROM offers UNION ALL SELECT id, ts, 'take', take FROM takes),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, kind, ref) AS n FROM r),
w AS (SELECT id, n, kind, ref, CASE WHEN kind = 'offer' THEN ref END AS live, CASE WHEN kind = 'offer' THEN ts + INTERVAL 3 DAYS END AS until, CAST(NULL AS BIGINT) AS offer, CASE WHEN kind = 'offer' THEN 'open' ELSE 'rejected' END AS verdict FROM o WHERE n = 1
 UNION ALL SELECT o.id, o.n, o.kind, o.ref,
  CASE WHEN o.kind = 'offer' THEN CASE WHEN w.live IS NOT NULL AND o.ts <= w.until THEN w.live ELSE o.ref END END,
  CASE WHEN o.kind = 'offer' THEN CASE WHEN w.live IS NOT NULL AND o.ts <= w.until THEN w.until ELSE o.ts + INTERVAL 3 DAYS END END,
  CASE WHEN o.kind = 'take' AND w.live IS NOT NULL AND o.ts <= w.until THEN w.live END,
  CASE WHEN o.kind = 'offer' THEN CASE WHEN w.live IS NOT NULL AND o.ts <= w.until THEN 'duplicate' ELSE 'open' END WHEN w.live IS NOT NULL AND o.ts <= w.until THEN 'paired' ELSE 'rejected' END
 FROM w JOIN o ON o.id = w.id AND o.n = w.n + 1)
SELECT id, kind, ref, offer, verdict FROM w""")
def pair_offers(offers, takes):
    return joins.pair_offers(offers, takes, "3 days")


@query("SELECT s.path, 4::BIGINT AS code FROM src_files s JOIN dst_files d ON s.path = d.path WHERE s.size <> d.size OR s.mtime_ns <> d.mtime_ns")
def changed_during(src_files, dst_files):
    return joins.changed_during(src_files, dst_files)


@query("""WITH r AS (SELECT user_id AS id, event_type AS status, event_id AS seq FROM events) SELECT c_custkey AS id, (SELECT arg_min(status, seq) FROM r WHERE r.id = c_custkey) AS result FROM customer""")
def attach_results(customer, events):
    return joins.attach_results(customer.select(F.col("c_custkey").alias("id")), events.selectExpr("user_id as id", "event_type as status", "event_id as seq"))


@query("""SELECT count(*) AS files, sum(CASE WHEN kind = 'file' THEN size ELSE 0 END)::BIGINT AS bytes, count(*) FILTER (kind = 'dir') AS dirs, false AS has_hardlinks FROM tree""")
def manifest_totals(tree):
    return aggregates.manifest_totals(tree)


REPORT = "r AS (SELECT s.id, qc.size, CASE WHEN s.id % 29 = 0 THEN 'error' ELSE status END AS status, CASE WHEN s.id % 29 = 0 OR status = 'skip' THEN 0 ELSE qc.size END AS moved FROM qc JOIN src_files s USING (path))"


@query(f"""WITH {STATUS}, {REPORT} SELECT count(*) FILTER (status <> 'error') AS files, sum(moved)::BIGINT AS sender_bytes, coalesce(sum(size) FILTER (status <> 'error'), 0)::BIGINT AS receiver_bytes,
coalesce(sum(size) FILTER (status = 'skip'), 0)::BIGINT AS skipped_bytes, count(*) FILTER (status = 'error') AS errors FROM r""")
def transfer_report(src_files, dst_files):
    rows = joins.quick_check(src_files, dst_files).join(src_files.select("path", "id"), "path").withColumn("status", F.expr("if(id % 29 = 0, 'error', status)"))
    return aggregates.transfer_report(rows.withColumn("moved", F.expr("if(status in ('error', 'skip'), 0, size)")))


@query(f"""WITH {DELTA}, h AS (SELECT path, count(*) FILTER (NOT send) AS have, sum(len) FILTER (send)::BIGINT AS missing FROM dl GROUP BY path),
p AS (SELECT qc.*, (size + 255) // 256 AS chunks, CASE WHEN status = 'skip' THEN (size + 255) // 256 ELSE coalesce(have, 0) END AS have, CASE WHEN status = 'delta' THEN coalesce(missing, 0) ELSE size END AS missing FROM qc LEFT JOIN h USING (path))
SELECT count(*) FILTER (status <> 'skip') AS to_send, coalesce(sum(size) FILTER (status = 'skip'), 0)::BIGINT AS skipped_bytes,
  coalesce(sum(size // greatest(chunks, 1) * (chunks - have)) FILTER (status <> 'skip'), 0)::BIGINT AS estimated_bytes, coalesce(sum(missing) FILTER (status <> 'skip'), 0)::BIGINT AS exact_bytes FROM p""")
def plan_totals(src_files, dst_files):
    delta = joins.delta_chunks(src_files, dst_files, 256).groupBy("path").agg(F.count_if(~F.col("send")).alias("kept"), F.sum(F.when(F.col("send"), F.col("len"))).alias("left"))
    plan = joins.quick_check(src_files, dst_files).join(delta, "path", "left").withColumn("chunks", S.chunk_count(F.col("size"), F.lit(256)))
    plan = plan.withColumn("have", F.expr("if(status = 'skip', chunks, coalesce(kept, 0))")).withColumn("missing", F.expr("if(status = 'delta', coalesce(left, 0), size)"))
    return aggregates.plan_totals(plan)


@query("""WITH h AS (SELECT DISTINCT file_idx, chunk_idx, true AS have FROM holdings)
SELECT concat('f', s.file_idx) AS path, count(h.have) AS have_count, count(*) AS chunk_count, count(h.have) = count(*) AS complete
FROM spec_chunks s LEFT JOIN h ON h.file_idx = s.file_idx AND h.chunk_idx = s.chunk_idx GROUP BY s.file_idx""")
def completeness(spec_chunks, holdings):
    """How much of each file the peers have together."""
    held = holdings.select("file_idx", "chunk_idx", F.lit(True).alias("have")).distinct()
    rows = spec_chunks.join(held, ["file_idx", "chunk_idx"], "left").select(F.concat(F.lit("f"), "file_idx").alias("path"), F.col("chunk_idx").alias("idx"), F.coalesce("have", F.lit(False)).alias("have"))
    return aggregates.completeness(rows)


@query("""WITH b AS (SELECT peer, file_idx // 8 AS byte, bit_or(CAST(1 << (file_idx % 8) AS INT)) AS v FROM holdings GROUP BY peer, byte),
m AS (SELECT peer, max(byte) AS top FROM b GROUP BY peer), g AS (SELECT peer, unnest(generate_series(0, top)) AS byte FROM m)
SELECT g.peer, string_agg(printf('%02x', coalesce(v, 0)), '' ORDER BY g.byte) AS bitmap FROM g LEFT JOIN b ON g.peer = b.peer AND g.byte = b.byte GROUP BY g.peer""")
def bitmap_agg(holdings):
    return aggregates.bitmap_agg(holdings.select("peer", "file_idx").distinct(), ["peer"], "file_idx")


@query("""SELECT s.file_idx, s.chunk_idx, count(DISTINCT h.peer) AS rarity FROM spec_chunks s LEFT JOIN holdings h ON h.file_idx = s.file_idx AND h.chunk_idx = s.chunk_idx GROUP BY 1, 2""")
def chunk_rarity(spec_chunks, holdings):
    return aggregates.chunk_rarity(spec_chunks, holdings)


@query("""WITH h AS (SELECT id >> 16 AS bucket, id, sha256(concat(path, '|', size, '|', mtime_ns)) AS h FROM src_files),
p AS (SELECT bucket, sha256(string_agg(h, '' ORDER BY id)) AS p FROM h GROUP BY bucket) SELECT sha256(string_agg(p, '' ORDER BY bucket)) AS digest FROM p""")
def manifest_digest(src_files):
    return aggregates.manifest_digest(src_files, F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime_ns").cast("string")), F.col("id"))


@query(f"""WITH {_chunks("src_files", 'c')}, k AS (SELECT path, string_agg(sha256(payload) || chr(0), '' ORDER BY idx) AS list FROM c GROUP BY path),
t AS (SELECT s.source, s.path, s.path || chr(0) || size || chr(0) || printf('%o', mode & 4095) || chr(0) || sha256(content) || chr(0) || coalesce(list, '') AS text FROM src_files s LEFT JOIN k ON s.path = k.path)
SELECT source, sha256(string_agg(text, '' ORDER BY path)) AS spec_hash FROM t GROUP BY source""")
def spec_hash(src_files):
    """One descriptor for each source."""
    chunks = filters.chunks_of(src_files, 256).select("path", "idx", F.sha2("payload", 256).alias("sha"))
    chunks = chunks.join(src_files.select("path", "source"), "path")
    return aggregates.spec_hash(src_files.select("source", "path", "size", "mode", F.sha2("content", 256).alias("sha")), chunks, ["source"])


@query("SELECT path, sha256(content) AS sha FROM src_files")
def whole_file_sha(src_files):
    return src_files.select("path", F.sha2("content", 256).alias("sha"))


@query("SELECT sum(size)::BIGINT AS total FROM src_files")
def total_bytes(src_files):
    return src_files.agg(F.sum("size").alias("total"))


SERVER = "e AS (SELECT CASE kind WHEN 'skip' THEN 'start' WHEN 'done' THEN 'file' WHEN 'error' THEN 'error' WHEN 'active' THEN 'end' ELSE 'chunk' END AS event, CASE WHEN kind = 'chunk' THEN bytes ELSE 0 END AS bytes FROM transfer_events)"
COUNTERS = "k AS (SELECT count(*) FILTER (event = 'start') AS sessions, count(*) FILTER (event = 'file') AS files, sum(bytes)::BIGINT AS bytes, count(*) FILTER (event = 'error') AS errors, count(*) FILTER (event = 'start') - count(*) FILTER (event = 'end') AS active FROM e)"


def _server(transfer_events):
    event = F.expr("case kind when 'skip' then 'start' when 'done' then 'file' when 'error' then 'error' when 'active' then 'end' else 'chunk' end")
    return aggregates.server_counters(transfer_events.select(event.alias("event"), F.expr("if(kind = 'chunk', bytes, 0)").alias("bytes")))


@query(f"WITH {SERVER}, {COUNTERS} SELECT * FROM k")
def server_counters(transfer_events):
    return _server(transfer_events)


@query(f"""WITH {SERVER}, {COUNTERS} SELECT name, type, value, printf('# TYPE server_%s %s%sserver_%s %d', name, type, chr(10), name, value) AS line FROM (
SELECT 'sessions' AS name, 'counter' AS type, sessions AS value FROM k UNION ALL SELECT 'files', 'counter', files FROM k UNION ALL SELECT 'bytes', 'counter', bytes FROM k UNION ALL SELECT 'errors', 'counter', errors FROM k UNION ALL SELECT 'active', 'gauge', active FROM k)""")
def counters_exposition(transfer_events):
    from syncframe.sinks import exposition

    return exposition(_server(transfer_events))


STATES = """ends AS (SELECT path, arg_min(kind, (ts, event_id)) AS state FROM transfer_events WHERE kind IN ('done', 'error', 'skip') GROUP BY path),
fs AS (SELECT t.path, coalesce(any_value(e.state), 'active') AS state, sum(CASE WHEN kind = 'chunk' THEN bytes ELSE 0 END)::BIGINT AS bytes FROM transfer_events t LEFT JOIN ends e ON t.path = e.path GROUP BY t.path)"""


@query(f"""WITH {STATES} SELECT count(*) AS total, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'error') AS errors, count(*) FILTER (state = 'skip') AS skipped, sum(bytes)::BIGINT AS sent_bytes FROM fs""")
def progress_snapshot(transfer_events):
    return aggregates.progress_snapshot(transfer_events)


@query(f"WITH {STATES} SELECT * FROM fs")
def file_lifecycle(transfer_events):
    return aggregates.file_states(transfer_events)


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN kind IN ('fifo', 'chardev', 'blockdev') THEN 'device' WHEN kind = 'socket' THEN 'socket' END AS reason FROM tree) WHERE reason IS NOT NULL GROUP BY reason""")
def skip_summary(tree):
    return tree.select(filters.kind_reason(F.col("kind"), devices=False).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {_chunks('src_files', 'c')} SELECT sum(CASE WHEN hash_zero THEN len ELSE 0 END)::BIGINT AS saved, sum(len)::BIGINT AS total FROM (SELECT len, (idx + length(path)) % 3 = 0 AS hash_zero FROM c)""")
def sparse_savings(src_files):
    payload = F.when((F.col("idx") + F.length("path")) % 3 == 0, F.unhex(F.expr("repeat('00', int(len))"))).otherwise(F.concat(F.unhex(F.lit("01")), F.col("payload")))
    chunks = filters.chunks_of(src_files, 256).select("len", payload.alias("payload"))
    return chunks.agg(F.sum(F.when(S.all_zero(F.col("payload")), F.col("len")).otherwise(0)).alias("saved"), F.sum("len").alias("total"))


@query(f"""WITH {FETCHES.replace("l_quantity > 2 OR l_suppkey % 4 <> 0", "l_quantity > 40 AND l_partkey % 3 <> 0")},
s AS (SELECT file_idx, chunk_idx, min(ts) AS first FROM f WHERE ok GROUP BY 1, 2)
SELECT f.file_idx, f.chunk_idx, count(*) AS failures, count(*) >= 6 AND any_value(s.first) IS NULL AS fatal FROM f LEFT JOIN s USING (file_idx, chunk_idx) WHERE s.first IS NULL OR f.ts < s.first GROUP BY 1, 2""")
def chunk_failures(lineitem):
    fetches = lineitem.selectExpr("cast(l_partkey % 100 as bigint) as file_idx", "cast(l_linenumber as bigint) as chunk_idx", "l_shipdate as ts", "l_quantity > 40 and l_partkey % 3 <> 0 as ok")
    return aggregates.chunk_failures(fetches)


@query("""WITH p AS (SELECT source, lang, string_split('data/' || path, '/') AS p FROM src_files), e AS (SELECT source, lang, min(p) AS a, max(p) AS b, count(*) AS n FROM p GROUP BY source, lang)
SELECT source, lang, array_to_string(CASE WHEN n = 1 THEN a[1:len(a) - 1] ELSE list_transform(list_filter(generate_series(1, len(a)), lambda i: a[1:i] = b[1:i]), lambda i: a[i]) END, '/') AS ancestor FROM e""")
def common_ancestor(src_files):
    return aggregates.common_ancestor(src_files.select("source", "lang", F.concat(F.lit("data/"), "path").alias("path")), ["source", "lang"])


@query("""SELECT CASE event_id % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'io' WHEN 2 THEN 'no-space' WHEN 3 THEN 'invalid-path' WHEN 4 THEN 'source-changed' WHEN 5 THEN 'permission' WHEN 6 THEN 'exists' WHEN 7 THEN 'protocol' ELSE 'canceled' END AS code, count(*) AS n FROM transfer_events WHERE kind = 'error' GROUP BY 1""")
def errors_by_code(transfer_events):
    code = S.name_of(F.col("event_id") % 9, S.ERROR_CODES)
    return transfer_events.where("kind = 'error'").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query("SELECT peer, count(*) AS chunks FROM holdings GROUP BY peer")
def serveable_count(holdings):
    return holdings.groupBy("peer").agg(F.count("*").alias("chunks"))


@query("""SELECT h.peer, sum(s.len)::BIGINT AS done_bytes, (SELECT sum(len) FROM spec_chunks)::BIGINT AS total_bytes, (sum(s.len) * 100 // (SELECT sum(len) FROM spec_chunks))::BIGINT AS percent FROM holdings h JOIN spec_chunks s USING (file_idx, chunk_idx) GROUP BY h.peer""")
def artifact_progress(spec_chunks, holdings):
    return aggregates.artifact_progress(spec_chunks, holdings)


@query("SELECT id, path, row_number() OVER (ORDER BY string_split(path, '/')) AS number FROM src_files")
def number_entries(src_files):
    return windows.number_entries(src_files.select("id", "path"))


@query("""WITH p AS (SELECT concat(source, '/f', id % 37, '.fs-part-', id) AS path, concat(source, '/f', id % 37) AS final, size, mtime_ns FROM src_files)
SELECT path, final, row_number() OVER (PARTITION BY final ORDER BY mtime_ns DESC, size DESC, path) > 1 AS stale FROM p""")
def newest_part(src_files):
    return windows.newest_part(src_files.select(F.expr("concat(source, '/f', id % 37, '.fs-part-', id)").alias("path"), "size", "mtime_ns"))


SAMPLES = "sm AS (SELECT event_id, session, path, ts, sum(CASE WHEN kind = 'chunk' THEN bytes ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id)::BIGINT AS sent FROM transfer_events)"


def _samples(transfer_events):
    from pyspark.sql import Window

    sent = F.sum(F.expr("if(kind = 'chunk', bytes, 0)")).over(Window.partitionBy("session").orderBy("ts", "event_id"))
    return transfer_events.select("event_id", "session", "path", "ts", sent.alias("sent"))


RATES = f"""{SAMPLES}, rt AS (SELECT event_id, session, sent, CASE WHEN (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 > 0.1 THEN (sent - first_value(sent) OVER w) / ((epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6) END AS rate FROM sm
WINDOW w AS (PARTITION BY session ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {RATES} SELECT event_id, round(rate, 6) AS rate FROM rt")
def transfer_rate(transfer_events):
    return windows.transfer_rate(_samples(transfer_events), 86400).select("event_id", F.round("rate", 6).alias("rate"))


@query(f"""WITH {RATES} SELECT event_id, CASE WHEN rate > 0 AND 900000 - 1000 - sent > 0 THEN round((900000 - 1000 - sent) / rate, 4) END AS eta FROM rt""")
def eta(transfer_events):
    rated = windows.transfer_rate(_samples(transfer_events), 86400)
    return rated.select("event_id", F.round(windows.eta_seconds(F.lit(900000), F.lit(1000), F.col("sent"), F.col("rate")), 4).alias("eta"))


@query(f"""WITH RECURSIVE {SAMPLES}, o AS (SELECT path, ts, sent, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS n FROM sm),
w AS (SELECT path, n, ts, sent, CAST(NULL AS DOUBLE) AS rate FROM o WHERE n = 1
UNION ALL SELECT o.path, o.n, o.ts, o.sent, CASE WHEN (epoch_us(o.ts) - epoch_us(w.ts)) / 1e6 > 0.05 AND (o.sent - w.sent) / ((epoch_us(o.ts) - epoch_us(w.ts)) / 1e6) > 0
  THEN CASE WHEN w.rate IS NULL THEN (o.sent - w.sent) / ((epoch_us(o.ts) - epoch_us(w.ts)) / 1e6) ELSE 0.6::DOUBLE * w.rate + 0.4::DOUBLE * ((o.sent - w.sent) / ((epoch_us(o.ts) - epoch_us(w.ts)) / 1e6)) END ELSE w.rate END
FROM w JOIN o ON o.path = w.path AND o.n = w.n + 1)
SELECT path, round(arg_max(rate, n), 6) AS rate FROM (SELECT path, n, rate FROM w QUALIFY n = max(n) OVER (PARTITION BY path)) GROUP BY path""")
def smoothed_rate(transfer_events):
    return windows.smoothed_rate(_samples(transfer_events)).select("path", F.round("rate", 6).alias("rate"))


@query(f"""WITH {SAMPLES} SELECT event_id, sent - lag(sent) OVER w AS delta, CASE WHEN epoch_us(ts) > lag(epoch_us(ts)) OVER w THEN round((sent - lag(sent) OVER w) / ((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6), 6) END AS rate FROM sm WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)""")
def counter_deltas(transfer_events):
    return windows.counter_deltas(_samples(transfer_events)).select("event_id", "delta", F.round("rate", 6).alias("rate"))


@query("""WITH e AS (SELECT id, CASE WHEN id % 5 = 0 THEN upper(concat(source, '/', id % 41)) ELSE concat(source, '/', id % 41) END AS path FROM src_files),
w AS (SELECT *, first_value(path) OVER k AS first, row_number() OVER k AS n FROM e WINDOW k AS (PARTITION BY lower(path) ORDER BY id))
SELECT id, path, CASE WHEN n = 1 THEN 'keep' WHEN path = first THEN 'skip' ELSE 'case clash' END AS verdict, first FROM w""")
def first_path_wins(src_files):
    return windows.first_path_wins(src_files.select("id", F.expr("if(id % 5 = 0, upper(concat(source, '/', id % 41)), concat(source, '/', id % 41))").alias("path")))


@query("""WITH r AS (SELECT s.file_idx, s.chunk_idx, count(DISTINCT h.peer) AS rarity FROM spec_chunks s LEFT JOIN holdings h USING (file_idx, chunk_idx) GROUP BY 1, 2),
m AS (SELECT p.peer, r.* FROM (SELECT DISTINCT peer, file_idx FROM holdings) p JOIN r USING (file_idx) WHERE NOT EXISTS (SELECT 1 FROM holdings h WHERE h.peer = p.peer AND h.file_idx = r.file_idx AND h.chunk_idx = r.chunk_idx))
SELECT peer, file_idx, chunk_idx, rarity, row_number() OVER (PARTITION BY peer ORDER BY rarity, file_idx, chunk_idx) AS rank FROM m""")
def rarest_first(spec_chunks, holdings):
    """For each peer what it lacks of the files that it has begun."""
    rarity = aggregates.chunk_rarity(spec_chunks, holdings)
    joiners = holdings.select("peer", "file_idx").distinct().join(rarity, "file_idx")
    return windows.rarest_first(joiners.join(holdings, ["peer", "file_idx", "chunk_idx"], "left_anti")).select("peer", "file_idx", "chunk_idx", "rarity", "rank")


@query("SELECT addr, room, seen, have FROM announces QUALIFY row_number() OVER (PARTITION BY addr, room ORDER BY seen DESC, event_id DESC) = 1")
def session_latest(announces):
    return windows.latest_per(announces, ["addr", "room"], ["seen", "event_id"]).select("addr", "room", "seen", "have")


@query("SELECT id, path FROM src_files ORDER BY string_split(path, '/')")
def manifest_order(src_files):
    return src_files.select("id", "path").orderBy(windows.manifest_order(F.col("path")))


@query("SELECT id, path FROM src_files ORDER BY path")
def spec_order(src_files):
    return src_files.select("id", "path").orderBy("path")


@query("SELECT id, path, is_dir FROM listing ORDER BY is_dir DESC, lower(path), id")
def listing_order(listing):
    return listing.select("id", "path", "is_dir").orderBy(F.desc("is_dir"), F.lower("path"), "id")


@query("SELECT id, path, (SELECT count(*) FROM listing) AS total, (SELECT count(*) FROM listing) > 30 AS truncated FROM (SELECT id, path FROM listing ORDER BY path, id LIMIT 20 OFFSET 10)")
def list_page(listing):
    return windows.list_page(listing.select("id", "path"), 10, 20)


@query("SELECT session AS journal, turn AS line_no, event FROM sessions_log QUALIFY row_number() OVER (PARTITION BY session ORDER BY turn DESC) <= 3")
def journal_tail(sessions_log):
    return windows.journal_tail(sessions_log.select(F.col("session").alias("journal"), F.col("turn").alias("line_no"), "event"), 3)


@query("""WITH f AS (SELECT session, path || '/' || event_id AS path, CASE kind WHEN 'active' THEN 'active' WHEN 'chunk' THEN 'wait' WHEN 'error' THEN 'error' ELSE 'done' END AS state, ts FROM transfer_events),
r AS (SELECT *, row_number() OVER (PARTITION BY session, state ORDER BY ts DESC, path) AS n, least(count(*) FILTER (state = 'active') OVER s, 2) AS a, least(count(*) FILTER (state = 'wait') OVER s, 4) AS w0 FROM f WINDOW s AS (PARTITION BY session)),
q AS (SELECT *, least(w0, 4 - a) AS w FROM r)
SELECT session, path, state FROM q WHERE n <= CASE state WHEN 'active' THEN 2 WHEN 'wait' THEN w WHEN 'error' THEN 7 - a - w ELSE 0 END""")
def progress_table(transfer_events):
    state = F.expr("case kind when 'active' then 'active' when 'chunk' then 'wait' when 'error' then 'error' else 'done' end")
    files = transfer_events.select("session", F.concat("path", F.lit("/"), "event_id").alias("path"), state.alias("state"), "ts")
    return windows.progress_table(files, 2, 4, 7)


@query("SELECT path FROM (SELECT path FROM dst_files WHERE path NOT IN (SELECT path FROM src_files)) ORDER BY path DESC")
def delete_order(src_files, dst_files):
    return joins.mirror_deletes(src_files, dst_files).select("path").orderBy(F.desc("path"))


LATEST = "lt AS (SELECT room, addr, bool_or(seed) AS seed, max(seen) AS seen FROM announces GROUP BY room, addr)"


def _members(announces):
    return announces.groupBy("room", "addr").agg(F.bool_or("seed").alias("seed"), F.max("seen").alias("seen"))


@query(f"WITH {LATEST}, n AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY seed DESC, md5(addr || '#0'), addr) AS n FROM lt) SELECT room, addr, seed FROM n WHERE n <= 4 OR seed")
def sample_peers(announces):
    return windows.sample_peers(_members(announces), 4)


@query(f"""WITH {LATEST}, n AS (SELECT *, greatest(count(*) OVER (PARTITION BY room) - 8, 0) AS over, row_number() OVER (PARTITION BY room, seed ORDER BY seen, addr) AS age FROM lt) SELECT room, addr, seed, seen FROM n WHERE seed OR age > over""")
def evict_stalest(announces):
    return windows.evict_stalest(_members(announces), 8)


@query("SELECT s_name, s_suppkey FROM supplier ORDER BY s_name, s_suppkey")
def peer_order(supplier):
    return supplier.select("s_name", "s_suppkey").orderBy("s_name", "s_suppkey")


@query("""WITH u AS (SELECT path, 0 AS root, id FROM src_files WHERE id % 3 <> 0 UNION ALL SELECT path, 1, id FROM src_files WHERE id % 2 = 0)
SELECT id, path, root::BIGINT AS root FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY root) = 1""")
def union_roots(src_files):
    roots = [src_files.where("id % 3 <> 0"), src_files.where("id % 2 = 0")]
    listed = [r.select(F.col("id").alias("entry"), "path", F.lit(k).cast("long").alias("root"), (F.lit(k * (1 << 40)) + F.col("id")).alias("id")) for k, r in enumerate(roots)]
    both = listed[0].unionByName(listed[1])
    kept = windows.first_path_wins(both).where("verdict = 'keep'").select("id")
    return both.join(kept, "id").select(F.col("entry").alias("id"), "path", "root")


DIFF = """sd AS (SELECT coalesce(s.path, d.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'removed' WHEN s.size <> d.size OR s.mtime_ns <> d.mtime_ns THEN 'modified' END AS change FROM src_files s FULL JOIN dst_files d ON s.path = d.path)"""


@query(f"WITH {DIFF} SELECT * FROM sd WHERE change IS NOT NULL")
def snapshot_diff(src_files, dst_files):
    return sets.snapshot_diff(src_files, dst_files)


@query("SELECT node, name, addr FROM envelopes WHERE version % 7 = 0 EXCEPT SELECT node, name, addr FROM envelopes WHERE version % 60 = 0")
def revoked_names(envelopes):
    """Endpoints that a node's earlier envelopes had and its later ones do not."""
    names = lambda rule: envelopes.where(rule).select("node", "name", "addr")
    return names("version % 7 = 0").subtract(names("version % 60 = 0"))


@query(f"WITH {_chunks('src_files', 'c')} SELECT path, idx, {IDENT} AS hash FROM c")
def mirror_state(src_files, dst_files):
    """The destination after a mirror: its oracle is the source."""
    ident = S.chunk_id(F.col("path"), F.col("idx"), F.col("payload")).alias("hash")
    src, dst = (filters.chunks_of(x, 256).select("path", "idx", ident) for x in (src_files, dst_files))
    there = dst.withColumnRenamed("hash", "other")
    plan = src.join(there, ["path", "idx"], "left").select("path", "idx", (~F.col("hash").eqNullSafe(F.col("other"))).alias("send"))
    return sets.mirror_state(src, dst, plan)


@query(f"""WITH {_chunks('src_files', 's')}, {_chunks('dst_files', 'd')} SELECT coalesce(s.path, d.path) AS path, coalesce(s.idx, d.idx) AS idx,
CASE WHEN d.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM s FULL JOIN d ON s.path = d.path AND s.idx = d.idx WHERE s.path IS NULL OR d.path IS NULL OR sha256(s.payload) <> sha256(d.payload)""")
def spec_diff(src_files, dst_files):
    old, new = (filters.chunks_of(x, 256).select("path", "idx", F.sha2("payload", 256).alias("sha")) for x in (dst_files, src_files))
    return sets.spec_diff(old, new)


@query(f"SELECT volume, count(*) AS files, sum(size)::BIGINT AS bytes, sum(ceil(size / {LADDER}))::BIGINT AS chunks FROM big_files GROUP BY volume")
def volume_totals(big_files):
    sized = big_files.withColumn("chunks", S.chunk_count(F.col("size"), S.chunk_size_for(F.col("size"))))
    return sized.groupBy("volume").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("chunks").alias("chunks"))
