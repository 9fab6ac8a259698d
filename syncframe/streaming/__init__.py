"""Event streams.  Functions with a ``watermark`` work on batch and on streaming DataFrames alike; the others are
the batch forms of the rules in ``timed``.  All spans of time are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syncframe.operators.scans import running


def _marked(events: DataFrame, watermark: str | None) -> DataFrame:
    return events.withWatermark("ts", watermark) if watermark and events.isStreaming else events


def event_counters(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """(start, kind, n, bytes) per tumbling window and kind."""
    counted = _marked(events, watermark).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return counted.select(F.col("w.start").alias("start"), "kind", "n", "bytes")


def sliding_rate(events: DataFrame, width: str, slide: str, watermark: str | None = None) -> DataFrame:
    """(start, stop, bytes) of transferred bytes per sliding window."""
    sent = _marked(events.where("kind = 'chunk'"), watermark).groupBy(F.window("ts", width, slide).alias("w")).agg(F.sum("bytes").alias("bytes"))
    return sent.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "bytes")


def debounce(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """(session, start, stop, n): one action per burst, which a quiet gap ends."""
    bursts = _marked(events, watermark).groupBy(F.session_window("ts", gap).alias("w"), "session").agg(F.count("*").alias("n"))
    return bursts.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def presence(announces: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """(start, addr, seen, have): the latest beacon of each address in each listening window."""
    heard = _marked(announces.withColumnRenamed("seen", "ts"), watermark).groupBy(F.window("ts", width).alias("w"), "addr").agg(F.max_by(F.struct("ts", "have"), F.struct("ts", "event_id")).alias("x"))
    return heard.select(F.col("w.start").alias("start"), "addr", F.col("x.ts").alias("seen"), F.col("x.have").alias("have"))


def sweep(events: DataFrame, every: str) -> DataFrame:
    """(session, start, fingerprint) of periodic checks whose snapshot differs from the check before; the first is
    the baseline and is not reported."""
    shot = F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", "path", "kind"))), "\n"), 256)
    checks = events.groupBy("session", F.window("ts", every).alias("w")).agg(shot.alias("fingerprint")).select("session", F.col("w.start").alias("start"), "fingerprint")
    before = F.lag("fingerprint").over(Window.partitionBy("session").orderBy("start"))
    return checks.withColumn("before", before).where("before is not null and before <> fingerprint").drop("before")


def room_state(announces: DataFrame, at: str, member_ttl: str, seed_ttl: str) -> DataFrame:
    """(room, addr, seed, seen, have) of the members alive at a time.  A member expires when its last announce is
    older than its span; an announce after that is a new membership; only a new one sets the seed flag."""
    now = F.to_timestamp(F.lit(at)).cast("timestamp_ntz")
    ttl = lambda seed: F.when(seed, F.expr(f"interval {seed_ttl}")).otherwise(F.expr(f"interval {member_ttl}"))
    order = Window.partitionBy("room", "addr").orderBy("seen", "event_id")
    known = announces.where(F.col("seen") <= now)
    fresh = F.lag("seen").over(order).isNull() | (F.col("seen") > F.lag("seen").over(order) + ttl(F.col("seed")))
    spells = known.withColumn("spell", F.sum(fresh.cast("int")).over(order))
    last = spells.groupBy("room", "addr", "spell").agg(
        F.min_by("seed", F.struct("seen", "event_id")).alias("seed"), F.max("seen").alias("seen"), F.max_by("have", F.struct("seen", "event_id")).alias("have")
    )
    return last.where(F.col("seen") + ttl(F.col("seed")) >= now).select("room", "addr", "seed", "seen", "have")


def stalled(events: DataFrame, idle: str, end: str) -> DataFrame:
    """(session, since, until): spans without new bytes or a newly resolved file longer than the idle period; the
    last may be open until the end of the data."""
    useful = events.where("kind in ('chunk', 'done', 'error', 'skip')")
    after = F.lead("ts").over(Window.partitionBy("session").orderBy("ts", "event_id"))
    gaps = useful.select("session", F.col("ts").alias("since"), F.coalesce(after, F.to_timestamp(F.lit(end)).cast("timestamp_ntz")).alias("until"))
    return gaps.where(F.col("until") > F.col("since") + F.expr(f"interval {idle}"))


def apply_envelopes(envelopes: DataFrame, now: str, age: str = "30 days") -> DataFrame:
    """(node, version, verdict, applied): each node's envelopes in the order of time, against the version it holds.

    What a node holds before an envelope is the greatest version among its earlier sound envelopes that are young enough:
    as rows come by time, none of the older ones can have been taken, and after the first no age counts.  So it is a running
    maximum, carried from part to part; no array or window holds a node's rows."""
    old = F.to_timestamp(F.lit(now)).cast("timestamp_ntz") - F.expr(f"interval {age}")
    sound = F.col("key_ok") & F.col("sig_ok")
    taken = F.when(sound & (F.col("ts") >= old) & (F.col("version") > 0), F.col("version"))
    seen = running(envelopes.select("node", "ts", "version", "sig_ok", "key_ok"), ["node"], ["ts", "version", "sig_ok", "key_ok"], {"held": taken}, F.max, before=True)
    held, version = F.coalesce("held", F.lit(0).cast("long")), F.col("version")
    verdict = (
        F.when(~F.col("key_ok"), "foreign key").when((version == held) & F.col("sig_ok"), "same").when(version <= held, "stale")
        .when(~F.col("sig_ok"), "bad signature").when((held == 0) & (F.col("ts") < old), "too old").otherwise("applied")
    )
    return seen.select("node", "version", verdict.alias("verdict"), F.when(verdict == "applied", version).otherwise(held).alias("applied"))


def chunk_arrivals(arrivals: DataFrame, counts: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """(path, arrived, duplicates, out_of_range, complete_at) from (path, idx, ts) and (path, chunk_count).

    Arrivals are counted and dealt by path to parts of about ``rows``, in which all that follows is done: what a task
    holds does not grow with their number."""
    parts = max(int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-arrivals.count() // rows))
    inside = (F.col("idx") >= 0) & (F.col("idx") < F.col("chunk_count"))
    each = arrivals.repartition(parts, "path").join(counts.repartition(parts, "path"), "path").groupBy("path", "chunk_count", "idx").agg(F.min("ts").alias("first"), F.count("*").alias("n"))
    whole = F.count_if(inside)
    return each.groupBy("path", "chunk_count").agg(
        whole.alias("arrived"), F.sum(F.when(inside, F.col("n") - 1).otherwise(0)).alias("duplicates"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("out_of_range"),
        F.when(whole == F.col("chunk_count"), F.max(F.when(inside, F.col("first")))).alias("complete_at"),
    ).drop("chunk_count")


def after_ban(fetches: DataFrame) -> DataFrame:
    """(peer, session, ts, banned): rows of a session after a peer's first failing chunk in it."""
    first = F.min(F.when(~F.col("ok") & (F.col("peer") != "http"), F.col("ts"))).over(Window.partitionBy("session", "peer"))
    return fetches.select("peer", "session", "ts", F.coalesce(F.col("ts") > first, F.lit(False)).alias("banned"))


def token_bucket(requests: DataFrame, rate: float, most: float = float(64 << 20)) -> DataFrame:
    """(session, event_id, admitted, wait, oversize): each session's requests in the order of time against a bucket
    that starts full, refills at ``rate`` and holds a second's worth at most.  A request larger than the
    bucket would wait for ever; it is flagged and takes nothing."""
    burst = min(rate, most)
    row = "struct<event_id:bigint,admitted:boolean,wait:double,oversize:boolean>"
    start = F.struct(F.lit(burst).alias("tokens"), F.lit(None).cast("bigint").alias("at"), F.array().cast(f"array<{row}>").alias("out"))

    def step(state, r):
        at = F.unix_micros(r["ts"].cast("timestamp"))
        tokens = F.least(F.lit(burst), state["tokens"] + F.coalesce((at - state["at"]) / 1e6, F.lit(0.0)) * rate)
        fits, large = tokens >= r["bytes"], r["bytes"] > burst
        out = F.struct(r["event_id"].alias("event_id"), fits.alias("admitted"), F.when(~fits & ~large, (r["bytes"] - tokens) / rate).alias("wait"), large.alias("oversize"))
        left = F.when(fits, tokens - r["bytes"]).otherwise(tokens)
        return F.struct(left.alias("tokens"), at.alias("at"), F.concat(state["out"], F.array(out)).alias("out"))

    ordered = requests.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "bytes"))).alias("all"))
    return ordered.select("session", F.explode(F.aggregate("all", start, step)["out"]).alias("x")).select("session", "x.*")
