"""Queries over the parsers of text protocols, on lines derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from syncframe import sources
from syncframe.operators.filters import chunks_of
from syncframe.plans.registry import query

LINES = """ln AS (SELECT event_id, concat_ws(' ', 'SWARM1', CASE WHEN event_id % 11 = 0 THEN 'leave' ELSE 'announce' END, CASE WHEN event_id % 7 = 0 THEN 'short' ELSE sha256(CAST(user_id AS VARCHAR)) END,
  CASE WHEN event_id % 5 = 0 THEN '0.0.0.0:7000' WHEN event_id % 13 = 0 THEN 'nowhere' ELSE concat('10.0.0.', user_id % 250, ':7000') END, printf('%02x', user_id % 256), '-', CAST(event_id % 2 AS VARCHAR)) AS line, concat('192.168.0.', user_id % 250) AS source_ip FROM events)"""


@query(f"""WITH {LINES}, f AS (SELECT *, string_split(line, ' ') AS f FROM ln)
SELECT f[3] AS room, CASE WHEN f[4] = '0.0.0.0:7000' THEN source_ip || ':7000' ELSE f[4] END AS addr, f[5] AS have, f[7] = '1' AS seed,
CASE WHEN f[2] <> 'announce' THEN 'protocol' WHEN length(f[3]) <> 64 THEN 'args' WHEN f[4] = 'nowhere' THEN 'addr' END AS reject FROM f""")
def parse_announces(events):
    line = F.concat_ws(
        " ", F.lit("SWARM1"), F.expr("if(event_id % 11 = 0, 'leave', 'announce')"), F.expr("if(event_id % 7 = 0, 'short', sha2(cast(user_id as string), 256))"),
        F.expr("case when event_id % 5 = 0 then '0.0.0.0:7000' when event_id % 13 = 0 then 'nowhere' else concat('10.0.0.', user_id % 250, ':7000') end"),
        F.format_string("%02x", F.col("user_id") % 256), F.lit("-"), (F.col("event_id") % 2).cast("string"),
    )
    return sources.parse_announces(events.select(line.alias("line"), F.expr("concat('192.168.0.', user_id % 250)").alias("source_ip")))


@query("""SELECT concat(ip, ':', port) AS addr, name, root, ver FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'fe80::1' ELSE concat('10.0.1.', user_id % 250) END AS ip, (event_id % 70000)::BIGINT AS port, concat('n', user_id) AS name, '/srv' AS root, '1.0' AS ver, event_id FROM events)
WHERE ip <> 'fe80::1' AND event_id % 10 <> 3 AND port BETWEEN 1 AND 65535""")
def parse_beacons(events):
    doc = F.to_json(F.struct(F.expr("if(event_id % 10 = 3, 2, 1)").alias("proto"), F.expr("concat('n', user_id)").alias("name"), (F.col("event_id") % 70000).alias("port"), F.lit("/srv").alias("root"), F.lit("1.0").alias("ver")))
    return sources.parse_beacons(events.select(doc.alias("json"), F.expr("if(event_id % 9 = 0, 'fe80::1', concat('10.0.1.', user_id % 250))").alias("source_ip")))


@query("""SELECT date_trunc('second', ts) AS ts, kind, path, 'n ' || event_id AS msg FROM transfer_events""")
def read_transfer_log(transfer_events):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = transfer_events.select(F.concat(stamp, F.lit(" "), F.rpad("kind", 10, " "), F.lit(" "), "path", F.lit(" n "), F.col("event_id").cast("string")).alias("value"))
    return sources.parse_transfer_log(lines).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT ts, type, path, msg FROM (SELECT date_trunc('millisecond', ts) AS ts, kind AS type, path, 'bytes ' || bytes AS msg FROM transfer_events)""")
def read_events(transfer_events):
    doc = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.col("kind").alias("type"), "path", F.concat(F.lit("bytes "), "bytes").alias("msg")))
    parsed = transfer_events.select(F.from_json(doc, sources.EVENT).alias("e")).select("e.*")
    return parsed.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT peer, file_idx, chunk_idx FROM holdings""")
def announced_holdings(holdings):
    """Bitmaps packed for the announce line and unpacked again: the oracle is what went in."""
    from syncframe.operators.aggregates import bitmap_agg

    packed = bitmap_agg(holdings, ["peer", "file_idx"], "chunk_idx")
    entries = packed.groupBy("peer").agg(F.map_from_entries(F.collect_list(F.struct(F.col("file_idx").cast("int"), "bitmap"))).alias("m"))
    have = F.array_join(F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), "/")
    return sources.holdings_of(entries.select(F.col("peer").alias("addr"), have.alias("have")))


@query()
def compressibility(src_files):
    measured = sources.compressibility(chunks_of(src_files, 1024))
    return measured.groupBy("how").agg(F.count("*").alias("chunks"), F.sum("len").alias("bytes"), F.sum("stored").alias("stored"))
