"""Queries over event streams in their batch form, and over journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncframe import streaming
from syncframe.operators import journal as chains
from syncframe.operators import windows
from syncframe.plans.registry import query


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, kind, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM transfer_events GROUP BY 1, 2")
def event_counters(transfer_events):
    return streaming.event_counters(transfer_events, "1 day")


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start, bytes FROM transfer_events WHERE kind = 'chunk')
SELECT start, start + INTERVAL 12 HOUR AS stop, sum(bytes)::BIGINT AS bytes FROM w GROUP BY start""")
def sliding_rate(transfer_events):
    return streaming.sliding_rate(transfer_events, "12 hours", "6 hours")


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM transfer_events WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, event_id) AS k FROM g)
SELECT session, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM b GROUP BY session, k""")
def debounce(transfer_events):
    return streaming.debounce(transfer_events, "6 hours")


@query("""WITH c AS (SELECT session, time_bucket(INTERVAL 1 DAY, ts) AS start, sha256(array_to_string(list_sort(list(DISTINCT concat_ws('|', path, kind))), chr(10))) AS fingerprint FROM transfer_events GROUP BY 1, 2),
l AS (SELECT *, lag(fingerprint) OVER (PARTITION BY session ORDER BY start) AS before FROM c) SELECT session, start, fingerprint FROM l WHERE before IS NOT NULL AND before <> fingerprint""")
def sweep(transfer_events):
    return streaming.sweep(transfer_events, "1 day")


@query("""WITH k AS (SELECT *, CASE WHEN seed THEN INTERVAL 72 HOUR ELSE INTERVAL 12 HOUR END AS ttl, lag(seen) OVER o AS prev FROM announces WHERE seen <= TIMESTAMP '2024-01-20' WINDOW o AS (PARTITION BY room, addr ORDER BY seen, event_id)),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR seen > prev + ttl THEN 1 ELSE 0 END) OVER (PARTITION BY room, addr ORDER BY seen, event_id) AS spell FROM k),
m AS (SELECT room, addr, arg_min(seed, (seen, event_id)) AS seed, max(seen) AS seen, arg_max(have, (seen, event_id)) AS have FROM s GROUP BY room, addr, spell)
SELECT * FROM m WHERE seen + CASE WHEN seed THEN INTERVAL 72 HOUR ELSE INTERVAL 12 HOUR END >= TIMESTAMP '2024-01-20'""")
def room_state(announces):
    return streaming.room_state(announces, "2024-01-20", "12 hours", "72 hours")


@query("SELECT time_bucket(INTERVAL 1 DAY, seen) AS start, addr, max(seen) AS seen, arg_max(have, (seen, event_id)) AS have FROM announces GROUP BY 1, 2")
def presence(announces):
    return streaming.presence(announces, "1 day")


@query("""WITH u AS (SELECT session, ts AS since, coalesce(lead(ts) OVER (PARTITION BY session ORDER BY ts, event_id), TIMESTAMP '2024-02-01') AS until FROM transfer_events WHERE kind <> 'active')
SELECT * FROM u WHERE until > since + INTERVAL 1 DAY""")
def stalled(transfer_events):
    return streaming.stalled(transfer_events, "1 day", "2024-02-01")


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts, version, sig_ok, key_ok) AS n FROM envelopes),
v AS (SELECT node, 0::BIGINT AS n, 0::BIGINT AS version, 'none' AS verdict, 0::BIGINT AS applied FROM (SELECT DISTINCT node FROM o)
 UNION ALL SELECT o.node, o.n, o.version,
  CASE WHEN NOT key_ok THEN 'foreign key' WHEN o.version = v.applied AND sig_ok THEN 'same' WHEN o.version <= v.applied THEN 'stale' WHEN NOT sig_ok THEN 'bad signature' WHEN v.applied = 0 AND o.ts < TIMESTAMP '1999-06-01' - INTERVAL 30 DAY THEN 'too old' ELSE 'applied' END,
  CASE WHEN key_ok AND o.version > v.applied AND sig_ok AND NOT (v.applied = 0 AND o.ts < TIMESTAMP '1999-06-01' - INTERVAL 30 DAY) THEN o.version ELSE v.applied END
 FROM v JOIN o ON o.node = v.node AND o.n = v.n + 1)
SELECT node, version, verdict, applied FROM v WHERE n > 0""")
def apply_envelopes(envelopes):
    return streaming.apply_envelopes(envelopes, "1999-06-01")


@query("""WITH a AS (SELECT concat('o', l_orderkey) AS path, l_linenumber - 1 AS idx, l_shipdate AS ts, 2 + l_orderkey % 4 AS chunk_count FROM lineitem),
e AS (SELECT path, chunk_count, idx, min(ts) AS first, count(*) AS n FROM a GROUP BY ALL)
SELECT path, count(*) FILTER (idx < chunk_count) AS arrived, coalesce(sum(n - 1) FILTER (idx < chunk_count), 0)::BIGINT AS duplicates, coalesce(sum(n) FILTER (idx >= chunk_count), 0)::BIGINT AS out_of_range,
CASE WHEN count(*) FILTER (idx < chunk_count) = chunk_count THEN max(first) FILTER (idx < chunk_count) END AS complete_at FROM e GROUP BY path, chunk_count""")
def chunk_arrivals(lineitem):
    arrivals = lineitem.selectExpr("concat('o', l_orderkey) as path", "l_linenumber - 1 as idx", "l_shipdate as ts")
    counts = lineitem.selectExpr("concat('o', l_orderkey) as path", "2 + l_orderkey % 4 as chunk_count").distinct()
    return streaming.chunk_arrivals(arrivals, counts)


@query("""WITH f AS (SELECT concat('peer', l_suppkey) AS peer, l_partkey % 10 AS session, l_shipdate AS ts, l_quantity > 3 AS ok FROM lineitem),
b AS (SELECT *, min(CASE WHEN NOT ok THEN ts END) OVER (PARTITION BY session, peer) AS first FROM f) SELECT peer, session, count(*) AS n, count(*) FILTER (ts > first) AS banned FROM b GROUP BY peer, session""")
def ban_stream(lineitem):
    fetches = lineitem.selectExpr("concat('peer', l_suppkey) as peer", "l_partkey % 10 as session", "l_shipdate as ts", "l_quantity > 3 as ok")
    return streaming.after_ban(fetches).groupBy("peer", "session").agg(F.count("*").alias("n"), F.count_if("banned").alias("banned"))


@query("""WITH RECURSIVE o AS (SELECT session, event_id, epoch_us(ts) AS us, bytes, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS n FROM transfer_events),
t AS (SELECT session, 0::BIGINT AS n, 0::BIGINT AS event_id, NULL::BIGINT AS us, 50000::DOUBLE AS tokens, false AS admitted, NULL::DOUBLE AS wait, false AS oversize FROM (SELECT DISTINCT session FROM o)
 UNION ALL SELECT o.session, o.n, o.event_id, o.us,
  CASE WHEN least(50000, t.tokens + coalesce((o.us - t.us) / 1e6, 0) * 50000) >= o.bytes THEN least(50000, t.tokens + coalesce((o.us - t.us) / 1e6, 0) * 50000) - o.bytes ELSE least(50000, t.tokens + coalesce((o.us - t.us) / 1e6, 0) * 50000) END,
  least(50000, t.tokens + coalesce((o.us - t.us) / 1e6, 0) * 50000) >= o.bytes,
  CASE WHEN least(50000, t.tokens + coalesce((o.us - t.us) / 1e6, 0) * 50000) < o.bytes AND o.bytes <= 50000 THEN (o.bytes - least(50000, t.tokens + coalesce((o.us - t.us) / 1e6, 0) * 50000)) / 50000 END, o.bytes > 50000
 FROM t JOIN o ON o.session = t.session AND o.n = t.n + 1)
SELECT session, event_id, admitted, round(wait, 6) AS wait, oversize FROM t WHERE n > 0""")
def token_bucket(transfer_events):
    return streaming.token_bucket(transfer_events, 50000.0).withColumn("wait", F.round("wait", 6))


CHAIN = """RECURSIVE r AS (SELECT session, turn + 1 AS seq, 't' || turn AS ts, event, '{"bytes": ' || bytes || '}' AS detail FROM sessions_log),
j AS (SELECT session, 0::BIGINT AS seq, '' AS ts, '' AS event, '' AS detail, '' AS prev, '' AS hash FROM (SELECT DISTINCT session FROM r)
 UNION ALL SELECT r.session, r.seq, r.ts, r.event, r.detail, j.hash, sha256(j.hash || chr(0) || r.seq || chr(0) || r.ts || chr(0) || r.event || chr(0) || r.detail) FROM j JOIN r ON r.session = j.session AND r.seq = j.seq + 1)"""


def _journal(sessions_log):
    detail = F.concat(F.lit('{"bytes": '), "bytes", F.lit("}"))
    return chains.append_journal(sessions_log.select(F.col("session").alias("journal"), F.col("turn").alias("ord"), F.concat(F.lit("t"), "turn").alias("ts"), "event", detail.alias("detail")))


@query(f"WITH {CHAIN} SELECT session AS journal, seq, ts, event, detail, prev, hash FROM j WHERE seq > 0")
def append_journal(sessions_log):
    return _journal(sessions_log)


@query("""WITH n AS (SELECT session AS journal, count(*) AS n FROM sessions_log GROUP BY session)
SELECT journal, CASE WHEN n >= 3 AND journal % 3 = 1 THEN 2 WHEN n >= 3 AND journal % 3 = 2 THEN 1 ELSE n END AS intact, CASE WHEN n >= 3 AND journal % 3 = 1 THEN 'altered entry' WHEN n >= 3 AND journal % 3 = 2 THEN 'broken link' END AS problem FROM n""")
def verify_chain(sessions_log):
    """Journals of which a third has its third entry altered and a third has lost its second."""
    from pyspark.sql import Window

    whole = chains.with_computed(_journal(sessions_log).withColumn("n", F.count("*").over(Window.partitionBy("journal"))))
    altered = (F.col("n") >= 3) & (F.col("journal") % 3 == 1) & (F.col("seq") == 3)
    lost = (F.col("n") >= 3) & (F.col("journal") % 3 == 2) & (F.col("seq") == 2)
    return windows.verify_chain(whole.where(~lost).withColumn("computed", F.when(altered, "other").otherwise(F.col("computed"))))
